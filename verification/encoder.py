"""A stand-in for an embedding model, for queries and tests that must not need one."""

from __future__ import annotations

from hashlib import md5

import numpy as np


class HashingEncoder:
    """Deterministic stand-in for a model: signed token counts by MD5, not semantic.

    Token position is ``first 32 bits of md5 mod dimension``; the sign is the parity of
    what is left after dividing by the dimension.
    """

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self.known: dict[str, tuple[int, float]] = {}

    def place(self, token: str) -> tuple[int, float]:
        if token not in self.known:
            if len(self.known) >= 1_000_000:
                self.known.clear()
            number = int(md5(token.encode()).hexdigest()[:8], 16)
            self.known[token] = (number % self.dimension, 1.0 - 2.0 * (number // self.dimension % 2))
        return self.known[token]

    def encode(self, texts: list[str]) -> np.ndarray:
        vectors = np.zeros((len(texts), self.dimension))
        for at, text in enumerate(texts):
            places = [self.place(token) for token in text.split(" ") if token]
            if places:
                slots, signs = zip(*places)
                vectors[at] = np.bincount(slots, signs, self.dimension)
        return vectors
