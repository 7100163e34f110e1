"""Exhaustive vector search as one narrow pass over the catalog.

Spark splits the catalog; each task streams its Arrow batches past a bounded block of
query vectors and keeps only the best K rows per query, so nothing but those rows is
shuffled. A query side beyond one block is cut by hash, and each block gets a narrow pass of
its own; results stay exact. Python is used because no built-in expression multiplies sparse
vectors or matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.checks import require, require_columns, write_through
from pairloom.operators.lexical import SCORE_DECIMALS, rank_top_k
from pairloom.operators.packed import round_half_up

# Bounds of one query block: rows, and stored numbers over all rows.
BLOCK_QUERIES = 4_096
BLOCK_NUMBERS = 4_000_000
# Catalog rows scored at a time inside a task.
STRIPE_ROWS = 256
# Dot products that are summed at a time.
CACHED_CELLS = 32_768


# ---------------------------------------------------------------- query blocks


def _cuts(side: DataFrame, size: Column, max_rows: int, max_numbers: int) -> int:
    """How many parts keep each within both bounds. Unique ids hash evenly; beyond one
    part, aiming at half of a bound leaves room for chance."""
    total = side.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("numbers")).first()
    fill = max(total["n"] / max_rows, (total["numbers"] or 0) / max_numbers)
    return 1 if fill <= 1 else int(np.ceil(2 * fill))


def over_blocks(
    queries: DataFrame,
    catalog: DataFrame,
    size: Column,
    kind: type,
    score: Callable,
    schema: str,
    max_rows: int = BLOCK_QUERIES,
    max_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """Run ``score(block, catalog batches)`` so that every catalog row meets every query.

    ``kind.build`` turns an Arrow table of queries into a block. ``score`` is told nothing
    about the split and yields record batches of ``schema``.
    """
    spark = catalog.sparkSession
    output = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def one_pass(asked: DataFrame) -> DataFrame:
        block = kind.build(asked.toArrow())
        if not len(block.ids):
            return spark.createDataFrame([], schema)
        shared = spark.sparkContext.broadcast(vars(block))

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return (batch.cast(output) for batch in score(kind(**shared.value), batches))

        return catalog.mapInArrow(stream, schema)

    blocks = _cuts(queries, size, max_rows, max_numbers)
    if blocks == 1:
        return one_pass(queries)
    # Only the queries are cut: one narrow pass over the catalog for each block of them. No
    # catalog vector moves, and the driver holds one block at a time.
    held = write_through(queries)
    part = F.pmod(F.xxhash64("source_id"), F.lit(blocks))
    passes = [one_pass(held.filter(part == at)) for at in range(blocks)]
    return reduce(DataFrame.unionByName, passes)


# ---------------------------------------------------------------- blocks as arrays


@dataclass
class SparseBlock:
    """Query vectors by term: ``slot`` maps a term to its run of (query, weight)."""

    ids: np.ndarray
    norms: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    queries: np.ndarray
    weights: np.ndarray

    @staticmethod
    def build(table: pa.Table) -> "SparseBlock":
        ids, terms, weights, owners = sparse_stripe(directed(one_batch(table)))
        order = np.argsort(terms, kind="stable")
        unique, starts = np.unique(terms[order], return_index=True)
        return SparseBlock(
            ids=ids,
            norms=np.bincount(owners, weights * weights, len(ids)),
            terms=unique,
            starts=np.append(starts, len(terms)),
            queries=owners[order],
            weights=weights[order],
        )

    def runs(self, indices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each index stands among the terms, and how many queries have it."""
        if not len(self.terms):
            return np.zeros(len(indices), np.int64), np.zeros(len(indices), np.int64)
        at = np.minimum(np.searchsorted(self.terms, indices), len(self.terms) - 1)
        return at, np.where(self.terms[at] == indices, self.starts[at + 1] - self.starts[at], 0)

    def products(self, at: np.ndarray, runs: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell (row by row, a query each) and value of every product of two weights."""
        first = np.repeat(self.starts[at] - (np.cumsum(runs) - runs), runs)
        picked = first + np.arange(len(first))
        return np.repeat(rows, runs) * len(self.ids) + self.queries[picked], np.repeat(values, runs) * self.weights[picked]

    def dot(self, indices: np.ndarray, values: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
        """Dot products of ``count`` catalog rows, given as flat triples, with every query.

        A few rows at a time, so that products and cells stay in the processor's cache.
        """
        width = len(self.ids)
        at, runs = self.runs(indices)
        dots, step = np.zeros((count, width)), max(16, CACHED_CELLS // max(width, 1))
        edges = np.searchsorted(rows, np.arange(0, count + step, step))
        for start, (a, b) in zip(range(0, count, step), pairwise(edges)):
            cells, products = self.products(at[a:b], runs[a:b], values[a:b], rows[a:b] - start)
            some = dots[start : start + step]
            some += np.bincount(cells, products, some.size).reshape(some.shape)
        return dots


def pair_batch(query_ids: np.ndarray, document_ids: np.ndarray, **values: pa.Array) -> pa.RecordBatch:
    """Result rows; ids are Python objects, so an empty batch needs a type that casts."""

    def ids(found: np.ndarray) -> pa.Array:
        return pa.array(found.tolist(), None if len(found) else pa.string())

    arrays = [ids(query_ids), ids(document_ids), *values.values()]
    return pa.RecordBatch.from_arrays(arrays, names=["query_id", "document_id", *values])


class BestRows:
    """The best K catalog rows per query seen so far in one task."""

    def __init__(self, queries: int, top_k: int, decimals: int, keep_zero: bool):
        self.top_k, self.decimals, self.keep_zero = top_k, decimals, keep_zero
        self.scores = [np.empty(0)] * queries
        self.ids = [np.empty(0, dtype=object)] * queries
        self.floor = np.full(queries, -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = round_half_up(scores, self.decimals)
        open_cells = scores >= self.floor
        if not self.keep_zero:
            open_cells &= scores != 0
        for query in np.flatnonzero(open_cells.any(axis=0)):
            chosen = np.flatnonzero(open_cells[:, query])
            merged = np.concatenate([self.scores[query], scores[chosen, query]])
            names = np.concatenate([self.ids[query], ids[chosen]])
            order = np.lexsort((names, -merged))[: self.top_k]
            self.scores[query], self.ids[query] = merged[order], names[order]
            if len(order) == self.top_k:
                self.floor[query] = merged[order[-1]]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        sizes = [len(found) for found in self.ids]
        return pair_batch(
            np.repeat(query_ids, sizes), np.concatenate(self.ids), score=pa.array(np.concatenate(self.scores))
        )


def one_batch(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


def stripes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, STRIPE_ROWS):
        yield batch.slice(start, STRIPE_ROWS)


def ragged(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and per-row lengths of a list column, without copying per row."""
    return (
        column.flatten().to_numpy(zero_copy_only=False),
        np.diff(column.offsets.to_numpy()),
    )


def directed(stripe: pa.RecordBatch) -> pa.RecordBatch:
    """Rows with at least one non-zero entry; the others have no direction to compare."""
    _, lengths = ragged(stripe.column("indices"))
    return stripe if lengths.all() else stripe.filter(pa.array(lengths > 0))


def sparse_stripe(stripe: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    indices, lengths = ragged(stripe.column("indices"))
    values, _ = ragged(stripe.column("values"))
    rows = np.repeat(np.arange(stripe.num_rows), lengths)
    ids = np.array(stripe.column("source_id").to_pylist(), dtype=object)
    return ids, indices.astype(np.int64), values, rows


# ---------------------------------------------------------------- searches


def id_columns(queries: DataFrame, catalog: DataFrame) -> str:
    """DDL of the two id columns of a result."""
    kinds = [side.schema["source_id"].dataType.simpleString() for side in (queries, catalog)]
    return f"query_id {kinds[0]}, document_id {kinds[1]}"


def _search(queries, catalog, size, kind, scores, top_k, decimals, fill_zero, **bounds) -> DataFrame:
    """Shared shape of both searches: partial top K per task or cell, then the final rank."""
    require(top_k >= 1, "top_k must be at least 1")

    def partial(block, batches):
        best = BestRows(len(block.ids), top_k, decimals, fill_zero)
        for batch in batches:
            for stripe in stripes(batch):
                best.add(*scores(block, stripe))
        yield best.batch(block.ids)

    schema = f"{id_columns(queries, catalog)}, score double"
    return rank_top_k(over_blocks(queries, catalog, size, kind, partial, schema, **bounds), top_k)


def _score_sparse(block: SparseBlock, stripe: pa.RecordBatch):
    ids, indices, values, rows = sparse_stripe(directed(stripe))
    return ids, block.dot(indices, values, rows, len(ids))


def sparse_top_k(
    queries: DataFrame,
    catalog: DataFrame,
    top_k: int = 10,
    decimals: int = SCORE_DECIMALS,
    fill_zero: bool = False,
    **bounds,
) -> DataFrame:
    """Exact cosine top-K of unit sparse vectors, both sides ``(source_id, indices, values)``.

    Ties go to the lowest id. With ``fill_zero`` documents that share nothing with a
    query may fill its list with score 0.
    """
    for side in (queries, catalog):
        require_columns(side, ["source_id", "indices", "values"])
    return _search(
        queries.select("source_id", "indices", "values"),
        catalog.select("source_id", "indices", "values"),
        F.size("indices"), SparseBlock, _score_sparse, top_k, decimals, fill_zero, **bounds,
    )


@dataclass
class DenseBlock:
    ids: np.ndarray
    matrix: np.ndarray

    @staticmethod
    def build(table: pa.Table) -> "DenseBlock":
        batch = one_batch(table)
        values, lengths = ragged(batch.column("embedding"))
        require(len(set(lengths)) <= 1, f"query vectors have several lengths: {sorted(set(lengths))[:5]}")
        matrix = values.astype(np.float64).reshape(len(lengths), -1) if len(lengths) else np.empty((0, 0))
        return DenseBlock(np.array(batch.column("source_id").to_pylist(), dtype=object), matrix.T)


def _score_dense(block: DenseBlock, stripe: pa.RecordBatch):
    values, lengths = ragged(stripe.column("embedding"))
    if len(lengths) and (lengths != block.matrix.shape[0]).any():
        raise ValueError(f"catalog vectors have {sorted(set(lengths))[:5]} numbers, query vectors {block.matrix.shape[0]}; embed both sides with one model")
    ids = np.array(stripe.column("source_id").to_pylist(), dtype=object)
    return ids, values.astype(np.float64).reshape(len(lengths), -1) @ block.matrix


def dense_top_k(
    queries: DataFrame,
    catalog: DataFrame,
    top_k: int = 10,
    decimals: int = SCORE_DECIMALS,
    **bounds,
) -> DataFrame:
    """Exact cosine top-K of unit dense vectors, both sides ``(source_id, embedding)``."""
    for side in (queries, catalog):
        require_columns(side, ["source_id", "embedding"])

    def present(side):
        return side.select("source_id", "embedding").filter(F.col("embedding").isNotNull())

    return _search(
        present(queries), present(catalog), F.size("embedding"),
        DenseBlock, _score_dense, top_k, decimals, True, **bounds,
    )
