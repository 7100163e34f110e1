"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character 1- to 4-grams, hashed into a fixed number of
bins. Document frequencies are counted over every learning row; the weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a sample whose expected size
is a parameter; one part of the sample sets the temperature of the softmax.

Defined cases: null text, empty text or text without a letter is ``und`` with score 0.
Texts of any length are read whole; input columns named like a new one are replaced, others
are kept. Repeated rows each get their own (equal) prediction. Without any learning row every text is
``und``. Ties between classes go to the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import collected, decoded, quoted, release_memory, slices, with_arrow_columns, written
from pairloom.llm.linear import fit_ftrl, fit_temperature, softmax

BINS = 1 << 14
FIT_ROWS = 4_000
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the 1- to 4-grams of the lower-cased text, and how often each occurs.

    Everything but letters counts as a space, so digits, markup and layout say nothing.
    Both are empty if the text has no letter.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    total = np.zeros(BINS, np.int64)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, 5):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        total += np.bincount(mixed >> np.uint32(18), minlength=BINS)
    at = np.flatnonzero(total)
    return at, total[at]


def unit_weights(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights with damped counts and length 1."""
    x = (1.0 + np.log(counts)) * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: bytes | None) -> tuple[str, float]:
        at, counts = gram_counts(decoded(text))
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        x = unit_weights(at, counts, self.idf)
        p = softmax((x @ self.weights[at]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _document_frequencies(texts: DataFrame) -> dict[int, int]:
    """In how many texts each bin occurs; one bounded vector leaves each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS + 1, np.int64)
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                total[gram_counts(decoded(text))[0]] += 1
                total[BINS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bin", "texts"])

    counted = texts.mapInArrow(count, "bin long, texts long")
    return {r["bin"]: r["texts"] for r in counted.groupBy("bin").agg(F.sum("texts").alias("texts")).collect()}


def fit(df: DataFrame, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on the rows of ``df`` that have a text and a language.

    Every row counts towards document frequencies. The weights see each distinct text once
    for a language, if its digest falls below ``fit_rows`` / languages / distinct texts of
    the language: about ``fit_rows`` texts however often one repeats, evenly from all
    languages, and the same ones in every run.
    """
    rows = df.select(quoted(text).cast("binary").alias("text"), quoted(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    texts = rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("texts"))
    per_language = {r["lang"]: r["texts"] for r in texts.collect()}
    languages = tuple(sorted(per_language))
    if not languages:
        return LanguageModel((), np.zeros(BINS), np.zeros((BINS, 0)), 1.0)
    frequency = _document_frequencies(rows.select("text"))
    total = frequency.pop(BINS, 0)
    idf = np.full(BINS, np.log((1 + total) / 1) + 1)
    for at, texts in frequency.items():
        idf[at] = np.log((1 + total) / (1 + texts)) + 1

    share = F.pmod(F.xxhash64("text"), F.lit(1 << 32)) / float(1 << 32)
    rate = F.lit(0.0)
    for name in languages:
        rate = F.when(F.col("lang") == name, min(1.0, fit_rows / len(languages) / per_language[name])).otherwise(rate)
    sample = rows.filter(share < rate).distinct().withColumn("part", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(5)))
    packed = with_arrow_columns(sample, "text", "bins binary, counts binary", _packed, drop=("text",))
    kept = written(packed, "fit-grams")
    # The driver learns how many rows the sample has, not what is in them.
    if not collected(kept.select("lang"), 2 * fit_rows + 1000, "fit-sample"):
        return LanguageModel(languages, idf, np.zeros((BINS, len(languages))), 1.0)
    weights, temperature = _fitted(kept, languages, idf)
    return LanguageModel(languages, idf, weights, temperature)


def _fitted(kept: DataFrame, languages: tuple[str, ...], idf: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and temperature from the counted rows of the sample, learned in a task: grams
    take many times the memory of the model, which alone comes to the driver."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("lang", "bins", "counts", "part")))]
        got.sort(key=lambda r: r[:3])
        rows_, truth, held = [], [], []
        for lang, bins, counts, part in got:
            at = np.frombuffer(bins, np.uint16).astype(np.int64)
            if len(at):
                rows_.append((at, unit_weights(at, np.frombuffer(counts, np.uint32), idf)))
                truth.append(languages.index(lang))
                held.append(part == 0)
        truth, held = np.array(truth, int), np.array(held, bool)
        fit_on = np.flatnonzero(~held)
        targets = np.eye(len(languages))[truth[fit_on]] if len(fit_on) else np.zeros((0, len(languages)))
        weights = fit_ftrl([rows_[i] for i in fit_on], targets, BINS, alpha=1.0, l1=0.05, l2=0.05)
        check = np.flatnonzero(held)
        scores = np.array([rows_[i][1] @ weights[rows_[i][0]] for i in check]).reshape(len(check), len(languages))
        fitted = {"weights": [weights.tobytes()], "temperature": [fit_temperature(scores, truth[check])]}
        yield pa.RecordBatch.from_pydict(fitted, pa.schema({"weights": pa.binary(), "temperature": pa.float64()}))
        del got, rows_, scores
        release_memory()

    row = kept.coalesce(1).mapInArrow(learn, "weights binary, temperature double").first()
    return np.frombuffer(row["weights"]).reshape(BINS, len(languages)), row["temperature"]


def _packed(texts: list[bytes]) -> list:
    grams = [gram_counts(decoded(text)) for text in texts]
    return [[at.astype(np.uint16).tobytes() for at, _ in grams], [counts.astype(np.uint32).tobytes() for _, counts in grams]]


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; the model is broadcast (a bounded size)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def predict(texts: list[bytes]) -> list:
        return list(zip(*map(shared.value.predict, texts))) or [[], []]

    return with_arrow_columns(df, text, "lang_pred string, score double", predict)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the key as text leaves that remainder; a null key does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))
