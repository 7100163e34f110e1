"""Near-duplicate groups by 64-bit SimHash and multi-index hashing.

Words are runs of anything but ASCII white space, ASCII letters in lower case. A bit of the
fingerprint is set if it is set in more than half of the XXH64 (seed 42) values of the
4-word shingles, repeats included. Fingerprints of at most ``RADIUS`` differing bits link.

Search: a layout cuts the fingerprint into segments with a radius each, so that two
fingerprints of at most four differing bits are within the radius of at least one segment:
otherwise the segments together would differ in five bits (radii 1, 1 and 0: 2 + 2 + 1;
radii 2 and 1: 3 + 2). One side is stored under its segments and the other asks for the balls
around its segments: hash-join keys for each distinct fingerprint, whatever the number of
copies. Longer segments mean more keys and fewer chance matches, so the layout is chosen by
the counted number of fingerprints. Complete distances are verified in the join.

Defined cases: null, empty or blank text has fingerprint zero and links like any other.
Copies share one fingerprint and are one node. Null ids take part but are never the
smallest id; a component without any id has a null ``component_id``. Rows that repeat an
id are kept, each with its own fingerprint. Texts of any length are read whole; other columns
are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import checkpointed, quoted, with_arrow_columns, written

SHINGLE = 4
SEED = 42
RADIUS = 4
EDGES_PER_TASK = 100_000
# Segments as first bit, width and radius of the ball.
LAYOUTS = (((0, 20, 1), (20, 20, 1), (40, 24, 0)), ((0, 32, 2), (32, 32, 1)))


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, from shingles of ``size`` words, as an unsigned number."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) < size:
        starts, stops = [0], [len(joined)]
    else:
        starts = np.concatenate(([0], ends[: -size] + 1))[: len(words) - size + 1].tolist()
        stops = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(texts: list[bytes | None], size: int = SHINGLE) -> np.ndarray:
    """The fingerprints of UTF-8 texts as signed longs."""
    return np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fp", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the fingerprint as a signed long."""
    return with_arrow_columns(df, text, f"`{name}` long", lambda texts: [fingerprints(texts)], drop=drop)


def _segment(fp, at: int, width: int):
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def ball(width: int, radius: int) -> list[int]:
    """All numbers of ``width`` bits of which at most ``radius`` are set."""
    return [sum(1 << bit for bit in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def layout(n: int):
    """The layout with the fewest key rows and chance matches for ``n`` fingerprints."""

    def rows(segments) -> float:
        keys = sum(len(ball(width, radius)) for _, width, radius in segments)
        return n * keys + n * n * sum(len(ball(width, radius)) / 2.0**width for _, width, radius in segments) / 2

    return min(LAYOUTS, key=rows)


def links(nodes: DataFrame, segments=None) -> DataFrame:
    """Pairs ``(a, b)`` with a < b of the distinct fingerprints ``fp`` that link, each once.

    A pair that several segments find is kept for the first of them only.
    """
    segments = segments or layout(nodes.count())
    stored = nodes.select(
        F.col("fp").alias("b"),
        F.posexplode(F.array(*(_segment(F.col("fp"), at, width) for at, width, _ in segments))).alias("segment", "key"),
    )

    def around(s: int, at: int, width: int, radius: int):
        own, masks = _segment(F.col("fp"), at, width), F.lit(ball(width, radius)).cast("array<bigint>")
        return F.transform(masks, lambda mask: F.struct(F.lit(s).alias("segment"), own.bitwiseXOR(mask).alias("key")))

    asked = [around(s, *segment) for s, segment in enumerate(segments)]
    probes = nodes.select(F.col("fp").alias("a"), F.explode(F.concat(*asked)).alias("q")).select("a", "q.segment", "q.key")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(False)
    first = F.lit(False)
    for s, (at, width, radius) in enumerate(segments):
        first = first | ((F.col("asked.segment") == s) & ~earlier)
        earlier = earlier | (F.bit_count(_segment(differing, at, width)) <= radius)
    condition = (
        (F.col("asked.segment") == F.col("stored.segment"))
        & (F.col("asked.key") == F.col("stored.key"))
        & (F.col("a") < F.col("b"))
        & (F.bit_count(differing) <= RADIUS)
        & first
    )
    return probes.alias("asked").join(stored.alias("stored"), condition).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``: the smallest node it reaches.

    Large-star and small-star steps alternate until the edges no longer change. Every step
    aggregates the smallest neighbour map-side and joins it back, so no neighbourhood is
    gathered, and is cut off by a checkpoint in the shared folder: plans and tasks of a small
    graph stay few, however many partitions the edges come in.
    """

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = state(edges)

    def few(frame: DataFrame) -> DataFrame:
        # An edge is two numbers: a task takes many, and a small graph needs no more tasks.
        tasks = 8 + before[0] // EDGES_PER_TASK
        return frame.coalesce(tasks) if tasks < 64 else frame

    while before[0]:
        edges = few(edges)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = few(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        # Cut off too: it is used three times, and the driver would plan each use with all before it.
        large = checkpointed(few(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()))
        low = few(large.groupBy("a").agg(F.min("b").alias("m")))
        small = few(large.join(low, "a")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(few(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def fingerprint_components(fingerprints: DataFrame) -> DataFrame:
    """``(fp, root)`` of every distinct fingerprint; ``root`` names its component."""
    nodes = checkpointed(fingerprints.select("fp").distinct())
    found = components(links(nodes)).withColumnRenamed("node", "fp")
    return nodes.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicate_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row of ``df``."""
    slim = df.select(quoted(key).alias("id"), quoted(text).alias("text"))
    rows = written(with_fingerprint(slim, "text", "fp", drop=("text",)), "fingerprints")
    copies = rows.groupBy("fp").agg(F.min("id").alias("least"))
    named = copies.join(fingerprint_components(rows), "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(ids, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each near-duplicate group: the smallest id, then the smallest
    digest of the row; of wholly equal rows one stays. Null ids come last."""
    whole = F.sha2(F.to_json(F.struct(*map(quoted, df.columns))), 256)
    keyed = df.withColumn("_row_digest", whole)
    slim = keyed.select(F.col("_row_digest"), quoted(key).alias("id"), quoted(text).alias("text"))
    rows = written(with_fingerprint(slim, "text", "fp", drop=("text",)), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "_row_digest")
    best = rows.groupBy("fp").agg(F.min(order).alias("best")).join(fingerprint_components(rows), "fp")
    kept = best.groupBy("root").agg(F.min("best").alias("best")).select("best._row_digest")
    return keyed.join(kept, "_row_digest", "left_semi").dropDuplicates(["_row_digest"]).drop("_row_digest")
