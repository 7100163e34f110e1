"""Shards of nearly equal size by sampled splitters, in DataFrame functions only.

Records are ordered by a 64-bit hash of their text and then of their id, so copies of a text
lie next to each other. A sample drawn with probabilities in proportion to size, plus an equal
share for each record, gives the quantiles that cut this order into many more ranges than
shards; ranges that hold too much are sampled more densely and cut again, which is how a text
with a third of all records gets split by id, an empty one too. Each record then gets its exact position in bytes and rows from the totals of
the ranges before its own and a running sum inside its own, and the position its shard.

The law is ``bytes``: every shard ends within one record, or half a small group of copies, of
its equal part of the bytes. A group of equal texts of at most ``GROUP_SHARE`` of a shard
stays in one shard unless a range ends inside it; larger groups are split where the part ends.

Defined cases: texts of any length are one record; columns other than those asked for are not read;
a null text has size 8 and the CRC-32 of the empty text; null ids hash alike
and are placed like any other; wholly equal rows are neighbours in any order; empty tables
give no rows; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.llm.common import quoted, written

OVERHEAD = 8
RANGES_PER_SHARD = 16
ROWS_PER_RANGE = 1_000_000
SAMPLES_PER_RANGE = 25
OVERFULL = 2.0
ROUNDS = 4
GROUP_SHARE = 0.02
LOWEST = -(1 << 63)


def _literals(values: Sequence[int]) -> Column:
    """A constant array as one literal, which the optimiser folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(h: Column, d: Column, splitters: Sequence[tuple[int, int]]) -> Column:
    """How many splitters are not above ``(h, d)``, by binary search over literal arrays."""
    if not splitters:
        return F.lit(0)
    hs, ds = _literals([s[0] for s in splitters]), _literals([s[1] for s in splitters])
    steps = F.lit([1 << k for k in reversed(range(len(splitters).bit_length()))])

    def step(at: Column, by: Column) -> Column:
        h_, d_ = F.get(hs, at + by - 1), F.get(ds, at + by - 1)
        return F.when((h_ < h) | ((h_ == h) & (d_ <= d)), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _quantiles(sample: DataFrame, every: Column) -> list[tuple[int, int]]:
    """Each ``every``-th record of the (bounded) sample, in order, within its range."""
    place = F.row_number().over(Window.partitionBy("range").orderBy("h", "d"))
    rows = sample.withColumn("place", place).filter(F.col("place") % every == 0).select("h", "d").distinct().collect()
    return [(r["h"], r["d"]) for r in rows]


def _tidy(found: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted splitters; the first of each text lies before the text, not inside it."""
    out: list[tuple[int, int]] = []
    for h, d in sorted(found):
        out.append((h, d) if out and out[-1][0] == h else (h, LOWEST))
    return out


def splitters(keys: DataFrame, total: int, ranges: int) -> list[tuple[int, int]]:
    """Bounds of about ``ranges`` ranges of ``keys (h, d, size)``; none holds more than
    ``OVERFULL`` equal parts unless a single key does."""
    if not total:
        return []
    part = total / ranges
    chance = F.pmod(F.xxhash64("h", "d", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    first = keys.filter(chance < F.col("size") * (SAMPLES_PER_RANGE / part)).withColumn("range", F.lit(0))
    found = set(_quantiles(first, F.lit(SAMPLES_PER_RANGE)))
    for _ in range(ROUNDS):
        bounds = _tidy(found)
        ranged = keys.withColumn("range", _range_of(F.col("h"), F.col("d"), bounds))
        full = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > OVERFULL * part)
        over = {r["range"]: r["bytes"] for r in full.collect()}
        if not over:
            break
        # A text that fills several ranges keeps its splitters by id, so mark it as split.
        dense = ranged.filter(F.col("range").isin(list(over))).withColumn("chance", F.pmod(F.xxhash64("h", "d", F.lit(13)), F.lit(1 << 40)) / float(1 << 40))
        more = _quantiles(dense.filter(F.col("chance") < F.col("size") * (SAMPLES_PER_RANGE / part)), F.lit(SAMPLES_PER_RANGE))
        held = {h for h, _ in found}
        grown = found | set(more) | {(h, LOWEST) for h, _ in more if h not in held}
        if grown == found:
            break
        found = grown
    return _tidy(found)


def weighted(keys: DataFrame, total: int, rows: int) -> DataFrame:
    """``(h, d, size)`` with an equal share of ``total`` added to every record, so that ranges
    which are even in this sum hold at most twice their part of the bytes and of the rows."""
    return keys.select("h", "d", (F.col("size") + F.lit(total / max(rows, 1))).alias("size"))


def assign_shards(
    df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` and the columns ``keep``.

    ``shard`` runs from 0; ``slot`` numbers the records of a shard without gaps;
    ``grown_shard`` is null, as the law ``bytes`` says nothing about another shard.
    """
    names = [f"keep_{i}" for i in range(len(keep))]
    content = F.coalesce(quoted(text), F.lit(""))
    keys = written(
        df.select(
            quoted(key).alias("id"),
            (F.octet_length(content) + OVERHEAD).cast("long").alias("size"),
            F.crc32(content.cast("binary")).alias("crc"),
            F.xxhash64(content).alias("h"),
            F.xxhash64(quoted(key), F.lit(3)).alias("d"),
            *(quoted(c).alias(n) for c, n in zip(keep, names)),
        ),
        "shard-keys",
    )
    all_ = keys.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    total = all_["bytes"]
    ranges = max(RANGES_PER_SHARD * shards, -(-all_["rows"] // ROWS_PER_RANGE))
    bounds = splitters(weighted(keys, total, all_["rows"]), 2 * total, ranges)
    ranged = keys.withColumn("range", _range_of(F.col("h"), F.col("d"), bounds))
    totals = {r["range"]: r for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}
    bytes_before, rows_before = [0], [0]
    for at in range(len(bounds) + 1):
        one = totals.get(at)
        bytes_before.append(bytes_before[-1] + (one["bytes"] if one else 0))
        rows_before.append(rows_before[-1] + (one["rows"] if one else 0))

    inside = Window.partitionBy("range").orderBy("h", "d", "id", "crc", *names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({
        "stop": F.sum("size").over(inside) + F.get(_literals(bytes_before), F.col("range")),
        "row": F.count(F.lit(1)).over(inside) + F.get(_literals(rows_before), F.col("range")) - 1,
    })
    group = Window.partitionBy("range", "h")
    grouped = placed.withColumns({
        "group_bytes": F.sum("size").over(group), "group_start": F.min(F.col("stop") - F.col("size")).over(group),
    })
    small = F.col("group_bytes") <= GROUP_SHARE * total / shards
    twice_middle = F.when(small, 2 * F.col("group_start") + F.col("group_bytes")).otherwise(2 * F.col("stop") - F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor(twice_middle * shards / F.lit(2 * max(total, 1)))).cast("int")
    done = written(grouped.select("id", "size", "crc", "row", shard.alias("shard"), *names), "shards")
    first = {r["shard"]: r["row"] for r in done.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    firsts = _literals([first.get(s, 0) for s in range(shards)])
    return done.select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.get(firsts, F.col("shard"))).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *(F.col(n).alias(c) for c, n in zip(keep, names)),
    )


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = 24) -> None:
    """Write the whole records of ``df`` as one folder for each shard, in the order of slots."""
    others = tuple(c for c in df.columns if c not in (key, "shard", "slot"))
    placed = assign_shards(df, key, text, shards, keep=others).drop("size", "text_crc32", "law", "grown_shard")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
