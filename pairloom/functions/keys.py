"""Stable identifiers, hash buckets and seeded orderings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pairloom.checks import require

BUCKETS = 1_000_000


def digest(value: Column) -> Column:
    return F.sha2(value.cast("string"), 256)


def pair_digest(left: Column, right: Column) -> Column:
    return F.sha2(F.concat_ws(":", left, right), 256)


def seeded_digest(seed: int, *values: Column) -> Column:
    """SHA-256 of ``seed|v1|v2...``: an order that looks random and never changes."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[v.cast("string") for v in values]), 256)


def hash_bucket(
    key: Column, seed: int, buckets: int = BUCKETS, method: str = "xxhash64"
) -> Column:
    """Bucket number of a key in ``[0, buckets)``.

    ``xxhash64`` is the fast default (the seed enters as an int); ``sha256`` gives the
    same number on any engine, from the first 32 bits of ``sha256(seed|key)``.
    """
    require(method in ("xxhash64", "sha256"), "method must be xxhash64 or sha256")
    if method == "xxhash64":
        return F.pmod(F.xxhash64(key, F.lit(int(seed))), F.lit(buckets))
    head = F.substring(seeded_digest(seed, key), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("bigint"), F.lit(buckets))
