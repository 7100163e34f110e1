"""Random-projection candidates, their rerank, and a whole parameter grid in one pass.

Spark ML fits the projections and hashes both sides. A pair is a candidate when the
buckets of at least one table agree and its Euclidean distance is below the threshold.
A query side of one block is shared with all tasks, and the catalog streams past it: no
vector moves. A larger side meets the catalog in its buckets, block by block, if those tell
vectors apart, and block after block in narrow passes if they do not. What leaves a task are
the best K rows and counters of each query. The parameter grid is an audit of many settings at once, wide ones included
in which nearly all pairs share a bucket; it counts pairs as the catalog passes the bounded
query side, and takes recall from the exact pairs alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from itertools import pairwise
from math import gcd, lcm, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.checks import fits, require, require_columns, write_through
from pairloom.functions.vectors import distance_to_cosine, lsh_buckets, sparse_dot, sparse_parts, squared_norm
from pairloom.operators.lexical import SCORE_DECIMALS, best_per_query
from pairloom.operators.scoring import (
    BLOCK_NUMBERS,
    BLOCK_QUERIES,
    CACHED_CELLS,
    STRIPE_ROWS,
    SparseBlock,
    _cuts,
    directed,
    id_columns,
    one_batch,
    over_blocks,
    pair_batch,
    ragged,
    round_half_up,
    sparse_stripe,
    sparse_top_k,
    stripes,
)

# Defaults and the tuning grid.
BUCKET_LENGTH = 0.8
NUM_HASH_TABLES = 3
DISTANCE_THRESHOLD = 1.2
SEED = 5110
BUCKET_LENGTHS = (0.5, 0.8, 1.0, 1.2, 1.5)
HASH_TABLE_COUNTS = (3, 5, 8, 12)
DISTANCE_THRESHOLDS = (1.2, 1.3, 1.4)


# Rows of a catalog bucket above which it is dealt into parts.
HEAVY_BUCKET = 10_000
# Vectors are brought to their buckets only if those leave less than 1/CROWDED of all pairs.
CROWDED = 8
# Pairs that a block holds at a time.
BLOCK_PAIRS = 1_000_000
# A row with fewer products than this part of a block's queries is compared in their cells alone.
FEW_CELLS = 8
# Terms that more than this part of a block's queries have are multiplied as a matrix, so many at most.
COMMON, MATRIX_TERMS = 16, 512
# Squared distances below this are taken again by exact order.
CLOSE = 1e-6
# Parts of a bucket that tell how near a border is, and the numbers of probes of a report.
FINE = 32
PROBE_COUNTS = (0, 1, 2, 4, 8)


def discriminating_width(num_features: int) -> float:
    """Spread of a unit vector's projection on a random unit direction: ``1/sqrt(dim)``.

    Widths far above it put nearly every vector into the two buckets around zero.
    """
    return 1.0 / sqrt(num_features)


def fit_index(
    catalog_features: DataFrame,
    bucket_length: float = BUCKET_LENGTH,
    num_hash_tables: int = NUM_HASH_TABLES,
    seed: int = SEED,
) -> BucketedRandomProjectionLSHModel:
    require_columns(catalog_features, ["source_id", "features"])
    estimator = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length,
        numHashTables=num_hash_tables, seed=seed,
    )
    return estimator.fit(catalog_features)


def hashed_rows(model: BucketedRandomProjectionLSHModel, features: DataFrame) -> DataFrame:
    """``(source_id, indices, values, buckets)`` of either side."""
    indices, values = sparse_parts(F.col("features"))
    return model.transform(features).select(
        "source_id", indices.alias("indices"), values.alias("values"),
        lsh_buckets(F.col("hashes")).alias("buckets"),
    )


def _vectors(features: DataFrame) -> DataFrame:
    indices, values = sparse_parts(F.col("features"))
    return features.select("source_id", indices.alias("indices"), values.alias("values"))


def _first_tables(catalog: np.ndarray, queries: np.ndarray, multiples: list[int]) -> np.ndarray:
    """Per width, the first table in which a row and a query agree (table count if none).

    Hashes were taken at a base width; ``floor(floor(x / a) / n) == floor(x / (a n))``
    gives the bucket at every integer multiple of it.
    """
    tables = catalog.shape[1]
    first = np.full((len(multiples), len(catalog), len(queries)), tables, np.int16)
    for at, multiple in enumerate(multiples):
        left, right = catalog // multiple, queries // multiple
        for table in reversed(range(tables)):
            first[at][left[:, table, None] == right[None, :, table]] = table
    return first


@dataclass
class HashedBlock:
    """Query vectors together with their bucket in every table."""

    ids: np.ndarray
    vectors: dict
    buckets: np.ndarray
    probes: np.ndarray

    @staticmethod
    def build(table: pa.Table) -> "HashedBlock":
        vectors, rows = SparseBlock.build(table), directed(one_batch(table))
        buckets = bucket_matrix(rows)
        probes = np.zeros_like(buckets)
        if "probes" in table.column_names and len(vectors.ids):
            probes = ragged(rows.column("probes"))[0].astype(np.int64).reshape(buckets.shape)
        return HashedBlock(vectors.ids, vars(vectors), buckets, probes)

    def agree(self, buckets: np.ndarray, table: int) -> np.ndarray:
        """Which rows of ``buckets`` lie in a bucket of ``table`` that a query asks for."""
        return self._reached(buckets[:, table, None] - self.buckets[None, :, table], self.probes[None, :, table])

    def agree_at(self, buckets: np.ndarray, query: np.ndarray, table: int) -> np.ndarray:
        """The same for one query of each row."""
        return self._reached(buckets[:, table] - self.buckets[query, table], self.probes[query, table])

    @staticmethod
    def _reached(step: np.ndarray, crossed: np.ndarray) -> np.ndarray:
        if not crossed.any():
            return step == 0
        return (step == 0) | ((step == -1) & (crossed & 1 > 0)) | ((step == 1) & (crossed & 2 > 0))


def bucket_matrix(rows: pa.RecordBatch) -> np.ndarray:
    values, _ = ragged(rows.column("buckets"))
    return values.astype(np.int64).reshape(rows.num_rows, -1) if rows.num_rows else np.empty((0, 0), np.int64)


def _candidates(queries: DataFrame, catalog: DataFrame, threshold: float, multiples: list[int], **bounds) -> DataFrame:
    """``(query_id, document_id, distance, first_table)`` of every pair under the threshold
    that agrees in some table at some width; ``first_table`` has one entry per width."""

    def pairs(block, batches):
        vectors, tables = SparseBlock(**block.vectors), block.buckets.shape[1]
        for batch in batches:
            for stripe in stripes(batch):
                stripe = directed(stripe)
                if not stripe.num_rows:
                    continue
                first = _first_tables(bucket_matrix(stripe), block.buckets, multiples)
                meet = (first < tables).any(axis=0)
                ids, indices, values, owners = sparse_stripe(stripe)
                live = meet.any(axis=1)[owners]
                dots = vectors.dot(indices[live], values[live], owners[live], len(ids))
                squares = np.bincount(owners, values * values, len(ids))
                gap = squares[:, None] + vectors.norms[None, :] - 2.0 * dots
                distance = np.sqrt(np.maximum(gap, 0.0))
                row, query = np.nonzero(meet & (distance < threshold))
                ends = pa.array(np.arange(len(row) + 1, dtype=np.int32) * len(multiples))
                yield pair_batch(
                    vectors.ids[query],
                    ids[row],
                    distance=pa.array(distance[row, query]),
                    first_table=pa.ListArray.from_arrays(ends, pa.array(first[:, row, query].T.ravel())),
                )

    schema = f"{id_columns(queries, catalog)}, distance double, first_table array<smallint>"
    return over_blocks(queries, catalog, F.size("indices"), HashedBlock, pairs, schema, **bounds)


def _unique_rows(model: BucketedRandomProjectionLSHModel, features: DataFrame, probes: int = 0) -> DataFrame:
    """Hashed rows, one for each id: rows that share an id share a text and so a vector.

    Ids are counted on their own, so only rows whose id comes again are brought together.
    Rows without direction may remain.
    """
    rows = probed_rows(model, features, probes) if probes else hashed_rows(model, features)
    counted = features.groupBy(F.col("source_id").alias("repeated_id")).agg(F.count(F.lit(1)).alias("n"))
    repeated = write_through(counted.filter("n > 1").select("repeated_id"))
    if repeated.isEmpty():
        return rows
    repeated = F.broadcast(repeated) if fits(repeated) else repeated
    same = F.col("source_id").eqNullSafe(F.col("repeated_id"))
    row = F.min(F.struct(*[c for c in rows.columns if c != "source_id"])).alias("row")
    merged = rows.join(repeated, same, "left_semi").filter(F.size("indices") > 0).groupBy("source_id").agg(row)
    return rows.join(repeated, same, "left_anti").unionByName(merged.select("source_id", "row.*"))


def _written_rows(rows: DataFrame) -> DataFrame:
    """Written once, where buckets and vectors are read at different times."""
    return write_through(rows).filter(F.size("indices") > 0)


def probed_rows(model: BucketedRandomProjectionLSHModel, features: DataFrame, probes: int) -> DataFrame:
    """Hashed rows and, in ``probes``, which neighbouring buckets they ask for in each table.

    1 stands for the bucket below, 2 for the one above, 3 for both. Of all tables' borders
    the ``probes`` nearest are crossed; ties go to the lower table, then to the bucket below.
    Where a vector lies in its bucket is read from a hash that is ``FINE`` times finer.
    """
    require(probes >= 0, "probes must not be negative")
    fine = model.transform(features, {model.bucketLength: model.getBucketLength() / FINE})
    indices, values = sparse_parts(F.col("features"))
    places = lsh_buckets(F.col("hashes"))
    rows = model.transform(fine.select("source_id", "features", places.alias("fine"))).select(
        "source_id", indices.alias("indices"), values.alias("values"), lsh_buckets(F.col("hashes")).alias("buckets"), "fine"
    )
    inside = F.zip_with("fine", "buckets", lambda f, b: F.greatest(F.lit(0.0), F.least(F.lit(FINE - 1.0), f - b * FINE)))
    borders = F.flatten(F.transform(inside, lambda place, table: F.array(
        F.struct(place.alias("way"), table.alias("table"), F.lit(1).alias("flag")),
        F.struct((FINE - 1 - place).alias("way"), table.alias("table"), F.lit(2).alias("flag")),
    )))
    rows = rows.withColumn("crossed", F.slice(F.sort_array(borders), 1, probes) if probes else F.slice(borders, 1, 0))

    def flags(table):
        of = lambda flag: F.exists("crossed", lambda c: (c["table"] == table) & (c["flag"] == flag))
        return F.when(of(1), 1).otherwise(0) + F.when(of(2), 2).otherwise(0)

    return rows.withColumn("probes", F.transform("buckets", lambda _, table: flags(table))).drop("crossed", "fine")


def _entries(rows: DataFrame) -> DataFrame:
    """One row per table and asked bucket, with all that the block of that bucket needs."""
    if "probes" not in rows.columns:
        return rows.select("source_id", "indices", "values", "buckets", F.posexplode("buckets").alias("table", "bucket"))
    # A bucket below or above is asked for where its flag is set.
    asked = F.zip_with("buckets", "probes", lambda b, p: F.array_compact(F.array(
        b, F.when(p.bitwiseAND(1) > 0, b - 1), F.when(p.bitwiseAND(2) > 0, b + 1)
    )))
    tables = rows.select("source_id", "indices", "values", "buckets", "probes", F.posexplode(asked).alias("table", "near"))
    return tables.withColumn("bucket", F.explode("near")).drop("near")


def _grid(queries: DataFrame, catalog: DataFrame, heavy: int, emit_all: bool) -> DataFrame:
    """``(table, bucket, parts, query_parts)`` of every bucket that both sides have.

    A block holds at most ``heavy`` catalog rows and one query block of ``scoring``; where
    every pair is emitted, no more pairs than ``BLOCK_PAIRS``.
    """
    key = ["table", "bucket"]

    def sizes(side: DataFrame, prefix: str) -> DataFrame:
        numbers = F.sum(F.size("indices")).alias(f"{prefix}numbers")
        return _entries(side).groupBy(*key).agg(F.count(F.lit(1)).alias(f"{prefix}rows"), numbers)

    both = sizes(catalog, "").join(sizes(queries, "query_"), key)
    rows = F.greatest(F.col("rows") / heavy, F.col("numbers") / BLOCK_NUMBERS)
    asked = F.greatest(F.col("query_rows") / BLOCK_QUERIES, F.col("query_numbers") / BLOCK_NUMBERS)
    asked = F.ceil(F.when(asked > 1, 2 * asked).otherwise(F.lit(1.0)))
    if emit_all:
        rows = F.greatest(rows, F.col("rows") * F.col("query_rows") / asked / BLOCK_PAIRS)
    return both.select(*key, F.ceil(rows).cast("int").alias("parts"), asked.cast("int").alias("query_parts"))


class Nearest:
    """The nearest K rows per query among the pairs of one block, or all of them.

    ``reach`` says how far a pair of each of ``queries`` may be to be among them still.
    """

    def __init__(self, top_k: int | None, queries: int = 0):
        self.top_k, self.found, self.held, self.kept = top_k, [], 0, 0
        self.reach = np.full(queries, np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        self.found.append((query, ids, distance))
        self.held += len(query)
        if self.top_k is not None and self.held > max(BLOCK_PAIRS, 2 * self.kept):
            self.found = [self.rows()]
            self.held = self.kept = len(self.found[0][0])
            if len(self.reach):
                query, _, distance = self.found[0]
                last = np.flatnonzero(np.bincount(query, minlength=len(self.reach)) >= self.top_k)
                # A little more than the K-th distance, which counts as rounded.
                self.reach[last] = distance[np.searchsorted(query, last, "right") - 1] + 2 * 10.0**-SCORE_DECIMALS

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        empty = (np.empty(0, np.int64), np.empty(0, object), np.empty(0))
        query, ids, distance = (np.concatenate(parts) for parts in zip(empty, *self.found))
        if self.top_k is None or not len(query):
            return query, ids, distance
        # Rounded, so that the order in which terms were summed swaps no ties.
        rank = round_half_up(distance, SCORE_DECIMALS)
        order = np.lexsort((rank, query))
        # Only a query's rows up to its K-th distance are compared by id.
        query, ids, distance, rank = query[order], ids[order], distance[order], rank[order]
        first = np.searchsorted(query, query)
        last = np.minimum(first + self.top_k, np.searchsorted(query, query, "right")) - 1
        near = rank <= rank[last]
        query, ids, distance, rank = query[near], ids[near], distance[near], rank[near]
        order = np.lexsort((ids, rank, query))
        query, ids, distance = query[order], ids[order], distance[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.top_k
        return query[keep], ids[keep], distance[keep]


def bucket_blocks(
    queries: DataFrame, catalog: DataFrame, threshold: float, top_k: int | None = None, heavy: int = HEAVY_BUCKET
) -> DataFrame:
    """``(query_id, document_id, distance, pairs)`` of the pairs below ``threshold`` that share a
    bucket: the nearest ``top_k`` per query and block, or all pairs.

    Both sides are hashed rows with unique ids. Vectors are brought to their buckets once
    and compared there, blocks of catalog rows with the block of the bucket's queries; a
    large bucket on either side is cut into a grid of blocks by its counted size. A pair
    counts in the first table in which it agrees. Rows without a document carry in
    ``pairs`` how many pairs a block had for a query.
    """
    key, block_key = ["table", "bucket"], ["table", "bucket", "part", "query_part"]
    grid = _grid(queries, catalog, heavy, top_k is None)

    def part(of: str):
        return F.pmod(F.xxhash64("source_id"), F.col(of)).cast("int")

    def every(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    vector = ["source_id", "indices", "values", "buckets"]
    stored = _entries(catalog).join(grid, key)
    stored = stored.select(*key, part("parts").alias("part"), every("query_parts").alias("query_part"), *vector)
    own = [*vector, "probes"] if "probes" in queries.columns else vector
    asked = _entries(queries).join(grid, key)
    asked = asked.select(*key, every("parts").alias("part"), part("query_parts").alias("query_part"), *own)
    schema = f"{id_columns(queries, catalog)}, distance double, pairs bigint"
    output = to_arrow_schema(catalog.sparkSession.createDataFrame([], schema).schema)

    def compare(of: tuple, rows: pa.Table, questions: pa.Table) -> pa.Table:
        table = of[0].as_py()
        block = HashedBlock.build(questions.select(own))
        found = Found(block, top_k)

        def first(agree) -> np.ndarray:
            return reduce(np.logical_and, [~agree(earlier) for earlier in range(table)], True)

        for stripe in stripes(one_batch(rows.select(vector))) if len(block.ids) else ():
            for pairs in found.pairs(stripe, first, threshold):
                found.nearest.add(*pairs)
        return pa.Table.from_batches([part.cast(output) for part in (nearest_batch(block, *found.nearest.rows()), found.totals())])

    return stored.groupBy(*block_key).cogroup(asked.groupBy(*block_key)).applyInArrow(compare, schema)


def nearest_batch(block: HashedBlock, query: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    return pair_batch(block.ids[query], ids, distance=pa.array(distance), pairs=pa.nulls(len(ids), pa.int64()))


class Found:
    """What one task has found for a block of queries: nearest rows and counters."""

    def __init__(self, block: HashedBlock, top_k: int | None):
        self.block, self.vectors = block, SparseBlock(**block.vectors)
        self.nearest, self.counts = Nearest(top_k, len(block.ids)), np.zeros(len(block.ids), np.int64)
        vectors, width = self.vectors, len(block.ids)
        asked = np.diff(vectors.starts)
        common = np.argsort(-asked, kind="stable")[:MATRIX_TERMS]
        common = np.sort(common[asked[common] > width / COMMON])
        self.slots = np.full(max(len(vectors.terms), 1), -1)
        self.slots[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), -(-width // 96) * 96))
        postings = np.repeat(np.arange(len(vectors.terms)), asked)
        some = np.flatnonzero(self.slots[postings] >= 0) if len(postings) else np.empty(0, np.int64)
        self.matrix[self.slots[postings[some]], vectors.queries[some]] = vectors.weights[some]

    def pairs(self, stripe: pa.RecordBatch, meets: Callable, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, id and distance of the pairs of a stripe that meet, are below the threshold
        and may be among the nearest; all below the threshold are counted.

        ``meets`` tells from a function of tables where buckets meet. Two vectors that are both long
        enough are below the threshold only if they share a term. Rows that share few terms with the
        block are compared in the cells of those terms alone, the others with every query.
        """
        ids, indices, values, owners = sparse_stripe(stripe)
        buckets, width = bucket_matrix(stripe), len(self.block.ids)
        squares = np.bincount(owners, values * values, len(ids))
        at, runs = self.vectors.runs(indices)
        light = (squares >= self.long(threshold)) & (np.bincount(owners, runs, len(ids)) < width / FEW_CELLS)
        for rows, few in ((np.flatnonzero(light), True), (np.flatnonzero(~light), False)):
            if not len(rows):
                continue
            used = light[owners] == few
            place = np.cumsum(light == few) - 1
            if few:
                cells, products = self.vectors.products(at[used], runs[used], values[used], place[owners[used]])
                short = np.flatnonzero(self.vectors.norms < self.long(threshold))
                extra = (np.arange(len(rows))[:, None] * width + short).ravel()
                cells, inverse = np.unique(np.append(cells, extra), return_inverse=True)
                dots = np.bincount(inverse[: len(products)], products, len(cells))
                row, query = np.divmod(cells, width)
                gap = squares[rows[row]] + self.vectors.norms[query] - 2.0 * dots
                distance = np.sqrt(np.maximum(gap, 0.0))
                near = (distance < threshold) & meets(lambda table: self.block.agree_at(buckets[rows[row]], query, table))
                row, query, distance = row[near], query[near], distance[near]
                self.counts += np.bincount(query, minlength=width)
                near = distance <= self.nearest.reach[query]
                yield query[near], ids[rows[row[near]]], distance[near]
                continue
            meet = np.broadcast_to(meets(lambda table: self.block.agree(buckets[rows], table)), (len(rows), width))
            used &= np.isin(owners, rows[meet.any(axis=1)])
            gap = squares[rows, None] + self.vectors.norms[None, :]
            gap -= 2.0 * self.dots(at[used], runs[used], values[used], place[owners[used]], len(rows))
            close = (gap < CLOSE).any(axis=1)
            if close.any():
                # Sums in the order of the lengths', so that equal vectors are at distance 0.
                again = used & np.isin(owners, rows[close])
                order = np.cumsum(close) - 1
                dots = self.vectors.dot(indices[again], values[again], order[place[owners[again]]], int(close.sum()))
                exact = squares[rows[close], None] + self.vectors.norms[None, :] - 2.0 * dots
                gap[close] = np.where(gap[close] < CLOSE, exact, gap[close])
            distance = np.sqrt(np.maximum(gap, 0.0))
            near = meet & (distance < threshold)
            self.counts += near.sum(axis=0)
            row, query = np.nonzero(near & (distance <= self.nearest.reach))
            yield query, ids[rows[row]], distance[row, query]

    def dots(self, at: np.ndarray, runs: np.ndarray, values: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
        """Dot products with every query: of terms that many queries have as matrices, of the others one by one.

        All shapes are the same, so that equal vectors get equal sums wherever they stand.
        """
        slot = self.slots[at]
        dense = (slot >= 0) & (runs > 0)
        matrix = np.zeros((max(count, STRIPE_ROWS), self.matrix.shape[0]))
        matrix[rows[dense], slot[dense]] = values[dense]
        dots = (matrix @ self.matrix)[:count, : len(self.block.ids)]
        step = max(1, CACHED_CELLS // len(self.block.ids))
        at, runs, values, rows = at[~dense], runs[~dense], values[~dense], rows[~dense]
        edges = np.searchsorted(rows, np.arange(0, count + step, step))
        for start, (a, b) in zip(range(0, count, step), pairwise(edges)):
            cells, products = self.vectors.products(at[a:b], runs[a:b], values[a:b], rows[a:b] - start)
            some = dots[start : start + step]
            some += np.bincount(cells, products, some.size).reshape(some.shape)
        return dots

    @staticmethod
    def long(threshold: float) -> float:
        """The squared length from which two vectors without a common term are not below the threshold."""
        return threshold * threshold / 2 * (1 + 1e-9)

    def totals(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.counts)
        return pair_batch(
            self.block.ids[some], np.full(len(some), None), distance=pa.nulls(len(some), pa.float64()), pairs=pa.array(self.counts[some])
        )


def block_passes(queries: DataFrame, catalog: DataFrame, threshold: float, top_k: int | None = None) -> DataFrame:
    """What ``bucket_blocks`` gives, from the catalog as it lies: it streams past one block of
    queries after the other, and no vector of it moves."""

    def compared(block, batches):
        found = Found(block, top_k)

        def some(agree) -> np.ndarray:
            return reduce(np.logical_or, [agree(table) for table in range(block.buckets.shape[1])])

        for batch in batches:
            for stripe in stripes(batch):
                stripe = directed(stripe)
                if not stripe.num_rows:
                    continue
                for pairs in found.pairs(stripe, some, threshold):
                    if top_k is None:
                        yield nearest_batch(block, *pairs)
                    else:
                        found.nearest.add(*pairs)
        yield nearest_batch(block, *found.nearest.rows())
        yield found.totals()

    schema = f"{id_columns(queries, catalog)}, distance double, pairs bigint"
    bounds = {"max_rows": BLOCK_QUERIES, "max_numbers": BLOCK_NUMBERS}
    return over_blocks(queries, catalog, F.size("indices"), HashedBlock, compared, schema, **bounds)


def _telling(queries: DataFrame, catalog: DataFrame) -> bool:
    """Whether the buckets leave less than ``1/CROWDED`` of all pairs."""
    key = ["table", "bucket"]
    here, there = (_entries(side).groupBy(*key).agg(F.count(F.lit(1)).alias(n)) for side, n in ((catalog, "rows"), (queries, "asked")))
    met = here.join(there, key).agg(F.sum(F.col("rows").cast("double") * F.col("asked"))).first()[0]
    return CROWDED * (met or 0.0) < float(catalog.count()) * queries.count()


def _met(queries: DataFrame, catalog: DataFrame, threshold: float, top_k: int | None, heavy: int) -> DataFrame:
    """The pairs below ``threshold`` that share a bucket, by the way that moves least."""
    if _cuts(queries, F.size("indices"), BLOCK_QUERIES, BLOCK_NUMBERS) > 1:
        catalog = _written_rows(catalog)
        if _telling(queries, catalog):
            return bucket_blocks(queries, catalog, threshold, top_k, heavy)
    return block_passes(queries, catalog, threshold, top_k)


@dataclass
class LshResult:
    """Ranked rows of a search, and how many candidates each query had."""

    ranked: DataFrame
    counts: DataFrame


def lsh_candidates(
    model: BucketedRandomProjectionLSHModel,
    query_features: DataFrame,
    catalog_features: DataFrame,
    threshold: float = DISTANCE_THRESHOLD,
    heavy: int = HEAVY_BUCKET,
) -> DataFrame:
    """``(query_id, document_id, distance)`` of candidate pairs, distance below the threshold."""
    for side in (query_features, catalog_features):
        require_columns(side, ["source_id", "features"])
    queries, catalog = _written_rows(_unique_rows(model, query_features)), _unique_rows(model, catalog_features)
    found = _met(queries, catalog, threshold, None, heavy)
    return found.filter(F.col("document_id").isNotNull()).drop("pairs")


def lsh_search(
    model: BucketedRandomProjectionLSHModel,
    query_features: DataFrame,
    catalog_features: DataFrame,
    threshold: float = DISTANCE_THRESHOLD,
    top_k: int = 10,
    heavy: int = HEAVY_BUCKET,
    probes: int = 0,
) -> LshResult:
    """The reranked top K of every query and the number of its candidates, from one pass.

    Equal to ``rerank`` of ``lsh_candidates``, but no row per pair leaves a task: a block
    hands on at most K rows and one counter per query. With ``probes`` a query also asks
    for as many neighbouring buckets, those whose borders it lies nearest to.
    """
    require(top_k >= 1, "top_k must be at least 1")
    for side in (query_features, catalog_features):
        require_columns(side, ["source_id", "features"])
    queries, catalog = _written_rows(_unique_rows(model, query_features, probes)), _unique_rows(model, catalog_features)
    found = write_through(_met(queries, catalog, threshold, top_k, heavy))
    ranked = rerank(found.filter(F.col("document_id").isNotNull()).drop("pairs"), top_k)
    return LshResult(ranked, found.filter(F.col("document_id").isNull()).groupBy("query_id").agg(F.sum("pairs").alias("candidates")))


def measured_pairs(
    pairs: DataFrame, model: BucketedRandomProjectionLSHModel, query_features: DataFrame, catalog_features: DataFrame
) -> DataFrame:
    """``(query_id, document_id, distance, query_buckets, buckets)`` of given pairs.

    Only the few rows of ``pairs`` fetch vectors; distances are taken inside the row.
    """

    def side(features: DataFrame, wanted: str, prefix: str) -> DataFrame:
        ids = pairs.select(F.col(wanted).alias("source_id")).distinct()
        ids = F.broadcast(ids) if fits(ids) else ids  # else all features would move to meet them
        rows = hashed_rows(model, features.join(ids, "source_id", "left_semi"))
        row = F.min(F.struct("indices", "values", "buckets")).alias("row")
        return rows.groupBy(F.col("source_id").alias(wanted)).agg(row).select(
            wanted, F.struct("row.indices", "row.values").alias(f"{prefix}vector"), F.col("row.buckets").alias(f"{prefix}buckets")
        )

    met = pairs.select("query_id", "document_id").distinct()
    met = met.join(side(query_features, "query_id", "query_"), "query_id").join(side(catalog_features, "document_id", ""), "document_id")
    q, d = F.col("query_vector"), F.col("vector")
    gap = squared_norm(q["values"]) + squared_norm(d["values"]) - 2 * sparse_dot(q, d)
    return met.select("query_id", "document_id", F.sqrt(F.greatest(gap, F.lit(0.0))).alias("distance"), "query_buckets", "buckets")


def found_pairs(
    pairs: DataFrame, model: BucketedRandomProjectionLSHModel, query_features: DataFrame, catalog_features: DataFrame, threshold: float
) -> DataFrame:
    """Those of given pairs that are candidates of the index: recall needs no candidate list."""
    agrees = F.exists(F.zip_with("query_buckets", "buckets", lambda q, d: q == d), lambda same: same)
    measured = measured_pairs(pairs, model, query_features, catalog_features)
    return measured.filter(agrees & (F.col("distance") < threshold)).select("query_id", "document_id")


def rerank(candidates: DataFrame, top_k: int) -> DataFrame:
    """Top K candidates per query by distance, which is by cosine, then by id.

    Distances are rounded for the order, so that the order of summation swaps no ties.
    """
    require_columns(candidates, ["query_id", "document_id", "distance"])
    scored = candidates.withColumn("score", distance_to_cosine(F.col("distance")))
    order = [F.round("distance", SCORE_DECIMALS), F.asc("document_id")]
    return best_per_query(scored, top_k, order, "score", "distance")


def probe_uncovered(
    model: BucketedRandomProjectionLSHModel,
    ranked: DataFrame,
    query_features: DataFrame,
    catalog_features: DataFrame,
    threshold: float,
    top_k: int,
    probes: int,
) -> DataFrame:
    """``ranked`` and the lists of those queries it has none for, found by ``probes`` more buckets."""
    missed = query_features.join(ranked.select(F.col("query_id").alias("source_id")).distinct(), "source_id", "left_anti")
    more = lsh_search(model, missed, catalog_features, threshold, top_k, probes=probes).ranked
    return ranked.withColumn("found_by", F.lit("lsh")).unionByName(more.withColumn("found_by", F.lit("probe")))


def probe_report(
    model: BucketedRandomProjectionLSHModel,
    query_features: DataFrame,
    catalog_features: DataFrame,
    exact: DataFrame,
    threshold: float = DISTANCE_THRESHOLD,
    probe_counts=PROBE_COUNTS,
) -> DataFrame:
    """``(probes, queries_covered, candidate_pairs, candidate_recall)``: what more buckets buy.

    One search for each count; recall is the share of the ``exact`` pairs among the pairs
    whose buckets meet, taken from the exact pairs alone.
    """
    truth = exact.select("query_id", "document_id").distinct()
    size = F.greatest(truth.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    pairs = write_through(measured_pairs(truth, model, query_features, catalog_features))
    report = None
    for probes in probe_counts:
        counts = lsh_search(model, query_features, catalog_features, threshold, 1, probes=probes).counts
        asked = probed_rows(model, query_features, probes).groupBy(F.col("source_id").alias("query_id")).agg(F.min("probes").alias("probes"))
        measured = pairs.join(asked, "query_id")
        steps = F.zip_with("buckets", "query_buckets", lambda d, q: d - q)
        meets = F.exists(F.zip_with(steps, "probes", lambda s, p: (s == 0) | ((s == -1) & (p.bitwiseAND(1) > 0)) | ((s == 1) & (p.bitwiseAND(2) > 0))), lambda x: x)
        hits = measured.filter(meets & (F.col("distance") < threshold)).agg(F.count(F.lit(1))).scalar()
        row = counts.agg(
            F.lit(probes).alias("probes"), F.count(F.lit(1)).alias("queries_covered"),
            F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidate_pairs"), F.round(hits / size, 6).alias("candidate_recall"),
        )
        report = row if report is None else report.unionByName(row)
    return report


def with_fallback(
    ranked: DataFrame, query_rows: DataFrame, catalog_rows: DataFrame, top_k: int
) -> DataFrame:
    """Queries the index left without any result get the exact search instead."""
    missed = query_rows.join(
        ranked.select(F.col("query_id").alias("source_id")).distinct(), "source_id", "left_anti"
    )
    exact = sparse_top_k(missed, catalog_rows, top_k)
    columns = ["query_id", "rank", "document_id", "score"]
    return (
        ranked.select(*columns, F.lit("lsh").alias("found_by"))
        .unionByName(exact.select(*columns, F.lit("exact").alias("found_by")))
    )


def common_width(widths) -> tuple[float, list[int]]:
    """The largest width that all ``widths`` are whole multiples of, and the multiples.

    Widths are taken as the decimal fractions they are written as, never rounded; widths
    that have no common base of at least a thousandth of the largest are refused.
    """
    exact = [Fraction(str(width)) for width in widths]
    require(min(exact) > 0, "bucket lengths must be positive")
    scale = lcm(*(width.denominator for width in exact))
    units = [int(width * scale) for width in exact]
    shared = gcd(*units)
    multiples = [unit // shared for unit in units]
    require(max(multiples) <= 1000, f"bucket lengths {tuple(widths)} have no common base")
    return float(Fraction(shared, scale)), multiples


def grid_candidates(
    query_features: DataFrame,
    catalog_features: DataFrame,
    widths=BUCKET_LENGTHS,
    tables: int = max(HASH_TABLE_COUNTS),
    threshold: float = max(DISTANCE_THRESHOLDS),
    seed: int = SEED,
    **bounds,
) -> DataFrame:
    """Candidates of every width and table count from a single hashing pass.

    The projections of a model with fewer tables are the first ones of a model with more,
    and all widths are multiples of one base width, so one model serves the whole grid.
    """
    base, multiples = common_width(widths)
    model = fit_index(catalog_features, base, tables, seed)
    return _candidates(
        hashed_rows(model, query_features), hashed_rows(model, catalog_features), threshold, multiples, **bounds
    )


def _grid_counts(queries: DataFrame, catalog: DataFrame, multiples: list[int], thresholds, **bounds) -> DataFrame:
    """``(query_id, counts)``: pairs per width, threshold and first agreeing table, flattened.

    Tasks pass the catalog by the query block once and hand on one row of counters per
    query, never a pair.
    """

    def counted(block, batches):
        vectors, tables = SparseBlock(**block.vectors), block.buckets.shape[1]
        width = len(block.ids)
        counts = np.zeros((len(multiples), len(thresholds), width * tables), np.int64)
        for batch in batches:
            for stripe in stripes(batch):
                stripe = directed(stripe)
                if not stripe.num_rows or not width:
                    continue
                first = _first_tables(bucket_matrix(stripe), block.buckets, multiples)
                ids, indices, values, owners = sparse_stripe(stripe)
                squares = np.bincount(owners, values * values, len(ids))
                gap = squares[:, None] + vectors.norms[None, :] - 2.0 * vectors.dot(indices, values, owners, len(ids))
                distance = np.sqrt(np.maximum(gap, 0.0))
                cells = [np.nonzero(distance < limit) for limit in thresholds]
                for w in range(len(multiples)):
                    for d, (row, query) in enumerate(cells):
                        table = first[w, row, query]
                        hit = table < tables
                        counts[w, d] += np.bincount(query[hit] * tables + table[hit], minlength=width * tables)
        per_query = counts.reshape(len(multiples), len(thresholds), width, tables).transpose(2, 0, 1, 3).reshape(width, -1)
        some = np.flatnonzero(per_query.any(axis=1))
        ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * per_query.shape[1])
        ids = pa.array(block.ids[some].tolist(), None if len(some) else pa.string())
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(per_query[some].ravel()))], names=["query_id", "counts"])

    schema = f"query_id {queries.schema['source_id'].dataType.simpleString()}, counts array<bigint>"
    parts = over_blocks(queries, catalog, F.size("indices"), HashedBlock, counted, schema, **bounds)
    summed = parts.select("query_id", F.posexplode("counts").alias("cell", "n")).groupBy("query_id", "cell").agg(F.sum("n").alias("n"))
    return summed.filter("n > 0")


def audit_grid(
    query_features: DataFrame,
    catalog_features: DataFrame,
    exact: DataFrame,
    top_k: int = 10,
    widths=BUCKET_LENGTHS,
    table_counts=HASH_TABLE_COUNTS,
    thresholds=DISTANCE_THRESHOLDS,
    seed: int = SEED,
    **bounds,
) -> DataFrame:
    """One row per setting, as ``evaluate_grid`` gives it, without a table of candidates.

    ``exact`` holds at least the ``top_k`` nearest documents of each query. Volumes come as
    counters; recall comes from the exact pairs alone: a candidate nearer than an exact pair
    is an exact pair itself, or a vector without direction, which is as far from every query
    as the query is long. So ranks among the exact pairs and the ``top_k`` lowest ids of such
    vectors decide who is in the final list.
    """
    base, multiples = common_width(widths)
    tables = max(table_counts)
    model = fit_index(catalog_features, base, tables, seed)
    per_cell = write_through(
        _grid_counts(hashed_rows(model, query_features), hashed_rows(model, catalog_features), multiples, thresholds, **bounds)
    )
    settings = [(w, d, t) for w in range(len(widths)) for d in range(len(thresholds)) for t in table_counts]

    def named(w, d, t) -> list:
        return [
            F.lit(float(widths[w])).alias("bucket_length"), F.lit(t).alias("num_hash_tables"),
            F.lit(float(thresholds[d])).alias("distance_threshold"),
        ]

    def of(w, d, t):
        start = (w * len(thresholds) + d) * tables
        return F.col("cell").between(start, start + t - 1)

    per_query = per_cell.groupBy("query_id").agg(
        *[F.coalesce(F.sum(F.when(of(*s), F.col("n"))), F.lit(0)).alias(f"n{i}") for i, s in enumerate(settings)]
    )
    volumes = per_query.agg(F.array(*[
        F.struct(*named(*s), F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias("candidate_pairs"), F.count_if(F.col(f"n{i}") > 0).alias("queries_covered"))
        for i, s in enumerate(settings)
    ]).alias("s")).select(F.inline("s"))

    truth = exact.select("query_id", "document_id").distinct()
    blank = _vectors(catalog_features).filter(squared_norm(F.col("values")) == 0).select("source_id").distinct()
    lowest = blank.orderBy("source_id").limit(top_k).agg(F.sort_array(F.collect_list("source_id")).alias("ids")).scalar()
    others = truth.select("query_id").distinct().withColumn("document_id", F.explode(lowest))
    ranked_pairs = truth.unionByName(others).distinct()
    measured = measured_pairs(ranked_pairs, model, query_features, catalog_features)

    def first_table(multiple: int):
        bucket = lambda value: F.floor(value / multiple)
        same = F.zip_with("query_buckets", "buckets", lambda q, d: bucket(q) == bucket(d))
        at = F.array_position(same, F.lit(True))
        return F.when(at > 0, at - 1)

    firsts = F.array(*[first_table(m) for m in multiples])
    located = write_through(
        measured.select("query_id", "document_id", "distance", firsts.alias("first"))
        .join(truth.withColumn("exact", F.lit(True)), ["query_id", "document_id"], "left")
    )
    keys = ["bucket_length", "num_hash_tables"]
    indexes = F.array(*[
        F.when(F.get("first", F.lit(w)) < t, F.struct(F.lit(float(widths[w])).alias("bucket_length"), F.lit(t).alias("num_hash_tables")))
        for w in range(len(widths)) for t in table_counts
    ])
    per_index = located.select("query_id", "document_id", "distance", "exact", F.explode(F.array_compact(indexes)).alias("index")).select(
        "index.*", "query_id", "document_id", "distance", "exact"
    )
    place = F.row_number().over(Window.partitionBy(*keys, "query_id").orderBy(F.round("distance", SCORE_DECIMALS), "document_id"))
    hits = per_index.withColumn("place", place).filter("exact").groupBy(*keys).agg(
        *[F.count_if(F.col("distance") < limit).alias(f"c{d}") for d, limit in enumerate(thresholds)],
        *[F.count_if((F.col("distance") < limit) & (F.col("place") <= top_k)).alias(f"f{d}") for d, limit in enumerate(thresholds)],
    ).select(*keys, F.inline(F.array(*[
        F.struct(F.lit(float(limit)).alias("distance_threshold"), F.col(f"c{d}").alias("candidate_hits"), F.col(f"f{d}").alias("final_hits"))
        for d, limit in enumerate(thresholds)
    ])))
    size = F.greatest(truth.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    setting = [*keys, "distance_threshold"]
    return volumes.join(hits, setting, "left").select(
        *setting, "candidate_pairs", "queries_covered",
        F.round(F.coalesce("candidate_hits", F.lit(0)) / size, 6).alias("candidate_recall"),
        F.round(F.coalesce("final_hits", F.lit(0)) / size, 6).alias("final_recall"),
    )


def evaluate_grid(
    candidates: DataFrame,
    exact: DataFrame,
    top_k: int = 10,
    widths=BUCKET_LENGTHS,
    table_counts=HASH_TABLE_COUNTS,
    thresholds=DISTANCE_THRESHOLDS,
) -> DataFrame:
    """One row per setting: candidate pairs, covered queries, candidate and final recall.

    ``candidates`` is read several times; hand in a checkpointed frame. Pairs are counted
    per query map-side for all settings at once. Ranks are taken per width and table
    count only: a tighter threshold keeps a prefix of the same ranking.
    """
    grid = [(w, t, d) for w in range(len(widths)) for t in table_counts for d in thresholds]

    def inside(w: int, t: int):
        return F.get("first_table", F.lit(w)) < t

    per_query = candidates.groupBy("query_id").agg(
        *[F.count_if(inside(w, t) & (F.col("distance") < d)).alias(f"n{i}") for i, (w, t, d) in enumerate(grid)]
    )
    counts = per_query.agg(
        F.array(
            *[
                F.struct(
                    F.lit(widths[w]).alias("bucket_length"),
                    F.lit(t).alias("num_hash_tables"),
                    F.lit(d).alias("distance_threshold"),
                    F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias("candidate_pairs"),
                    F.count_if(F.col(f"n{i}") > 0).alias("queries_covered"),
                )
                for i, (w, t, d) in enumerate(grid)
            ]
        ).alias("settings")
    ).select(F.inline("settings"))

    indexes = F.array(
        *[F.when(inside(w, t), F.struct(F.lit(widths[w]).alias("bucket_length"), F.lit(t).alias("num_hash_tables")))
          for w in range(len(widths)) for t in table_counts]
    )

    def per_index(pairs: DataFrame) -> DataFrame:
        return pairs.select(
            "query_id", "document_id", "distance", F.explode(F.array_compact(indexes)).alias("index")
        ).select("index.*", "query_id", "document_id", "distance")

    pair, keys = ["query_id", "document_id"], ["bucket_length", "num_hash_tables"]
    truth = exact.select(*pair).distinct()
    met = candidates.join(truth, pair, "left_semi")
    # Only pairs at least as near as a query's farthest true pair can push a true pair
    # out of the first K, so nothing farther needs a rank.
    reach = met.groupBy("query_id").agg(F.max("distance").alias("reach"))
    # One row per query; shipped when few, so that a query with very many pairs stays put.
    reach = F.broadcast(reach) if fits(reach) else reach
    near = candidates.join(reach, "query_id").filter(F.col("distance") <= F.col("reach"))
    order = Window.partitionBy(*keys, "query_id").orderBy("distance", "document_id")
    final = (
        per_index(near)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_k)
        .join(truth, pair, "left_semi")
    )

    def hits(frame: DataFrame, name: str) -> DataFrame:
        sums = frame.groupBy(*keys).agg(
            *[F.count_if(F.col("distance") < d).alias(f"d{j}") for j, d in enumerate(thresholds)]
        )
        cells = F.array(
            *[F.struct(F.lit(d).alias("distance_threshold"), F.col(f"d{j}").alias(name)) for j, d in enumerate(thresholds)]
        )
        return sums.select(*keys, F.inline(cells))

    size = F.greatest(truth.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    setting = [*keys, "distance_threshold"]
    return (
        counts.join(hits(per_index(met), "candidate_hits"), setting, "left")
        .join(hits(final, "final_hits"), setting, "left")
        .select(
            *setting,
            "candidate_pairs",
            "queries_covered",
            F.round(F.coalesce("candidate_hits", F.lit(0)) / size, 6).alias("candidate_recall"),
            F.round(F.coalesce("final_hits", F.lit(0)) / size, 6).alias("final_recall"),
        )
    )
