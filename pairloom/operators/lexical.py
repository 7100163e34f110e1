"""Exact-vocabulary TF-IDF search.

Queries that may be broadcast are answered from packed postings (see ``packed``). Others go by
joins and aggregates, in which terms stay strings; the catalog's counted terms are written and read:

    text -> (term, count) pairs inside the row -> vocabulary -> idf by join on term
         -> squares summed to one norm per document; it meets the terms any query asks for
         -> join with the query terms -> sum per (document, query), same partitioning
         -> top K per query, cut before the shuffle
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import pairwise
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from pairloom.checks import BROADCAST_BYTES, BROADCAST_ROWS, cut_lineage, discard, fits, require, require_columns, write_through
from pairloom.functions.text import tokens, with_bigrams
from pairloom.operators import packed
from pairloom.operators.documents import CONTRACT
from pairloom.operators.features import MIN_DOCUMENT_FREQUENCY

# A term in more than 1/HEAVY_TERMS of all postings is joined by broadcast. Counts add
# up to the number of postings, so there can be at most HEAVY_TERMS such terms.
HEAVY_TERMS = 20_000
# Such a term may be this long at most, which bounds the broadcast in bytes as well.
HEAVY_TERM_BYTES = 1_024
# Bytes of words that a task counts at a time.
PART_BYTES = 16 * 1024 * 1024
# Rows of query terms that one group may have to be broadcast.
QUERY_GROUP_ROWS = 1_000_000
SCORE_DECIMALS = 12
# Parts of one query that are ranked apart before the final rank, for very large K.
RANK_SPREAD = 64


def with_terms(documents: DataFrame, ngrams: bool = False) -> DataFrame:
    """Add ``terms`` of ``combined_text``: tokens, or prefixed unigrams and bigrams."""
    words = documents.withColumn("terms", tokens(F.col("combined_text")))
    return words.withColumn("terms", with_bigrams("terms")) if ngrams else words


def _counted(words: pa.ListArray, ngrams: bool) -> pa.ListArray:
    """The distinct terms of each row of words, and their counts.

    A term is a number made of its row and the places of its words among the distinct words
    of all rows, so equal terms of a row are equal numbers and one sort counts them all.
    """
    owners = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0))
    coded = words.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    known = len(names)
    span = known + known * known if ngrams else max(known, 1)
    found = owners * span + codes
    if ngrams:
        pairs = np.flatnonzero(owners[1:] == owners[:-1])
        found = np.append(found, owners[pairs] * span + known + codes[pairs] * known + codes[pairs + 1])
    found, counts = np.unique(found, return_counts=True)
    owners, places = np.divmod(found, max(span, 1))
    if ngrams:
        single = places < known
        first, second = np.divmod(places[~single] - known, max(known, 1))
        terms = pa.concat_arrays([
            pc.binary_join_element_wise("u", names.take(pa.array(places[single])), "_"),
            pc.binary_join_element_wise("b", names.take(pa.array(first)), names.take(pa.array(second)), "_"),
        ])
        order = np.empty(len(places), dtype=np.int64)
        order[single] = np.arange(len(places) - len(first))
        order[~single] = np.arange(len(places) - len(first), len(places))
        terms = terms.take(pa.array(order))
    else:
        terms = names.take(pa.array(places))
    offsets = np.append(0, np.cumsum(np.bincount(owners, minlength=len(words)))).astype(np.int32)
    runs = pa.StructArray.from_arrays([terms, pa.array(counts.astype(np.int64))], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(offsets), runs, mask=words.is_null())


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in parts of about ``PART_BYTES`` of words; a longer row is a part of its own."""
    words = batch.column("terms")
    owners = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0))
    sizes = np.bincount(owners, pc.binary_length(words.flatten()).to_numpy() + 8, len(words))
    part = (np.cumsum(sizes) - sizes) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
    for start, stop in pairwise(cuts):
        yield batch.slice(start, stop - start)


def term_rows(documents: DataFrame, ngrams: bool = False, key: str = "source_id") -> DataFrame:
    """``(key, runs)``: the distinct terms of each row and their counts, without a shuffle.

    Spark cuts the words; tasks count the Arrow batches of words as arrays.
    """
    require_columns(documents, [key, "combined_text"])
    words = documents.select(key, tokens(F.col("combined_text")).alias("terms"))
    schema = StructType([words.schema[key], *StructType.fromDDL("runs array<struct<term:string,tf:bigint>>")])
    output = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                arrays = [part.column(key), _counted(part.column("terms"), ngrams)]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "runs"]).cast(output)

    return words.mapInArrow(count, schema)


def postings(documents: DataFrame, ngrams: bool = False, key: str = "source_id") -> DataFrame:
    """``(key, term, tf)`` of every row."""
    return exploded(term_rows(documents, ngrams, key), key)


def exploded(written_rows: DataFrame, key: str = "source_id") -> DataFrame:
    """``(key, term, tf)`` of ``term_rows``."""
    return written_rows.select(key, F.explode("runs").alias("run")).select(key, "run.term", "run.tf")


class Vocabulary:
    """Catalog statistics: ``table(term, df, idf)`` and the totals that size the joins.

    The table is written when it is first asked for. A search of the ``catalog`` that it was fitted
    on takes the same weights from packed postings and needs no such table.
    """

    def __init__(self, counted: DataFrame, catalog: DataFrame, min_document_frequency: int, ngrams: bool):
        self._counted, self.catalog = counted, catalog
        self.min_document_frequency, self.ngrams = min_document_frequency, ngrams

    @cached_property
    def _counts(self) -> DataFrame:
        # Most phrases stand in one document: terms without a weight are not written.
        return write_through(self._counted.filter(F.col("term").isNull() | (F.col("df") >= self.min_document_frequency)))

    @cached_property
    def _totals(self) -> Row:
        known = F.col("term").isNotNull()
        return self._counts.agg(
            F.max(F.when(F.col("term").isNull(), F.col("df"))).alias("documents"),
            F.count_if(known).alias("terms"),
            F.sum(F.when(known, F.octet_length("term"))).alias("term_bytes"),
            F.sum(F.when(known, F.col("df"))).alias("postings"),
        ).first()

    @property
    def documents(self) -> int:
        return self._totals["documents"] or 0

    @property
    def terms(self) -> int:
        return self._totals["terms"]

    @property
    def term_bytes(self) -> int:
        return self._totals["term_bytes"] or 0

    @property
    def postings(self) -> int:
        return self._totals["postings"] or 0

    @cached_property
    def table(self) -> DataFrame:
        idf = F.log((F.lit(self.documents) + 1) / (F.col("df") + 1))
        return self._counts.filter(F.col("term").isNotNull()).select("term", "df", idf.alias("idf"))

    def broadcastable(self, limit: int) -> bool:
        return self.terms <= limit and self.term_bytes <= BROADCAST_BYTES


def term_frequencies(rows: DataFrame) -> DataFrame:
    """``(term, df)`` over counted rows; the NULL term counts the documents themselves."""
    every = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("runs.term", F.array().cast("array<string>")))
    return (
        rows.select(F.explode(every).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def fit_vocabulary(
    catalog: DataFrame,
    min_document_frequency: int = MIN_DOCUMENT_FREQUENCY,
    ngrams: bool = False,
    rows: DataFrame | None = None,
) -> Vocabulary:
    """One pass over the catalog, or over its counted ``rows`` if they are there already;
    terms below the least frequency have no weight."""
    require_columns(catalog, CONTRACT)
    counted = term_frequencies(term_rows(catalog, ngrams) if rows is None else rows)
    return Vocabulary(counted, catalog, min_document_frequency, ngrams)


def attach_terms(
    rows: DataFrame, table: DataFrame, vocabulary: Vocabulary, key: str,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner join of postings with a per-term table, whatever the term distribution.

    A small vocabulary is broadcast. Otherwise the few heavy terms are, and only postings of
    the tail are shuffled; those that a heavy term serves stay where they are.
    """
    if vocabulary.broadcastable(broadcast_rows):
        return rows.join(F.broadcast(table), "term")
    columns = [name for name in table.columns if name != "term"]
    packed = table.select("term", F.struct(*columns).alias("found"))
    heavy_from = max(1, vocabulary.postings // HEAVY_TERMS)
    is_heavy = (F.col("found.df") > heavy_from) & (F.octet_length("term") <= HEAVY_TERM_BYTES)
    heavy = packed.filter(is_heavy).select("term", F.col("found").alias("heavy"))
    marked = rows.join(F.broadcast(heavy), "term", "left")
    served = marked.filter(F.col("heavy").isNotNull()).select(*rows.columns, "heavy.*")
    tail = marked.filter(F.col("heavy").isNull()).join(packed.filter(~is_heavy), "term")
    return served.unionByName(tail.select(*rows.columns, "found.*"))


def weighted_documents(
    rows: DataFrame, wanted: Column | None = None, carry: tuple[str, ...] = (), key: str = "source_id"
) -> DataFrame:
    """One row per document from postings with ``idf``: its ``norm`` and the wanted
    ``entries(term, weight, *carry)``. The norm runs over all known terms of the document."""
    entry = F.struct("term", "weight", *carry)
    grouped = (
        rows.withColumn("weight", F.col("tf") * F.col("idf"))
        .groupBy(key)
        .agg(
            F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
            F.collect_list(entry if wanted is None else F.when(wanted, entry)).alias("entries"),
        )
    )
    return grouped.filter((F.col("norm") > 0) & (F.size("entries") > 0))


def asked_documents(rows: DataFrame, wanted: DataFrame, key: str = "source_id") -> DataFrame:
    """Like ``weighted_documents``, with the wanted postings in a frame of their own.

    The many postings that only count for the norm are summed as numbers before any list is made.
    """
    weight = F.col("tf") * F.col("idf")
    kept = StructType.fromDDL("term string, weight double")
    squares = rows.groupBy(key).agg(F.sum(weight * weight).alias("square"))
    entries = wanted.select(key, F.lit(None).cast("double").alias("square"), F.struct("term", weight.alias("weight")).alias("entry"))
    grouped = (
        squares.withColumn("entry", F.lit(None).cast(kept))
        .unionByName(entries)
        .groupBy(key)
        .agg(F.sqrt(F.sum("square")).alias("norm"), F.collect_list("entry").alias("entries"))
    )
    return grouped.filter((F.col("norm") > 0) & (F.size("entries") > 0))


def unit_postings(weighted: DataFrame, key: str = "source_id") -> DataFrame:
    """``(key, term, weight, ...)`` with each document scaled to length one."""
    return weighted.select(key, "norm", F.explode("entries").alias("e")).select(
        key, "e.*", "norm"
    ).withColumn("weight", F.col("weight") / F.col("norm")).drop("norm")


def sparse_scores(
    queries: DataFrame,
    catalog: DataFrame,
    vocabulary: Vocabulary,
    decimals: int = SCORE_DECIMALS,
    broadcast_rows: int = BROADCAST_ROWS,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Cosine of every (query, document) pair that shares a weighted term; ``rows`` are
    written ``term_rows`` of the catalog, if there are any.

    Over the catalog of the vocabulary, for queries that may be broadcast, postings are packed.
    """
    ngrams = vocabulary.ngrams
    asked_terms = cut_lineage(postings(queries, ngrams))
    shipped = fits(asked_terms, broadcast_rows)
    if shipped and rows is None and catalog is vocabulary.catalog and _spelled(queries, catalog):
        return _packed_scores(asked_terms, vocabulary, decimals)[1]
    found = exploded(write_through(term_rows(catalog, ngrams)) if rows is None else rows)
    if shipped:
        known = cut_lineage(vocabulary.table.join(F.broadcast(asked_terms), "term"))
    else:
        known = attach_terms(asked_terms, vocabulary.table, vocabulary, "source_id", broadcast_rows)
    query_terms = cut_lineage(
        unit_postings(weighted_documents(known)).select(
            F.col("source_id").alias("query_id"), "term", F.col("weight").alias("query_weight")
        )
    )
    if shipped:
        wanted = found.join(F.broadcast(known.select("term", "idf").distinct()), "term")
        weighted = asked_documents(attach_terms(found, vocabulary.table, vocabulary, "source_id", broadcast_rows), wanted)
    else:
        asked = query_terms.groupBy("term").agg(F.count(F.lit(1)).alias("query_df"))
        table = vocabulary.table.join(asked, "term", "left").withColumn("wanted", F.col("query_df").isNotNull())
        weighted = weighted_documents(
            attach_terms(found, table, vocabulary, "source_id", broadcast_rows), F.col("wanted")
        )
    documents = unit_postings(weighted)

    def scored(some: DataFrame) -> DataFrame:
        return (
            documents.join(F.broadcast(some), "term")
            .groupBy("source_id", "query_id")
            .agg(F.sum(F.col("weight") * F.col("query_weight")).alias("score"))
            .select(
                "query_id", F.col("source_id").alias("document_id"),
                F.round("score", decimals).alias("score"),
            )
        )

    # Queries beyond one broadcast are cut into groups. Every group meets the documents where
    # their one shuffle put them: the groups share it, and no match is shuffled to be summed.
    groups = _query_groups(query_terms)
    part = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    if groups == 1:
        return scored(query_terms)
    return reduce(DataFrame.unionByName, [scored(query_terms.filter(part == at)) for at in range(groups)])


def _spelled(queries: DataFrame, catalog: DataFrame) -> bool:
    return all(side.schema["source_id"].dataType == StringType() for side in (queries, catalog))


def _packed_scores(
    asked_terms: DataFrame, vocabulary: Vocabulary, decimals: int, top_k: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The written sums of all parts, and the scores of the vocabulary's catalog that are made of them."""
    catalog, ngrams = vocabulary.catalog, vocabulary.ngrams
    spark = catalog.sparkSession
    cores, parts = spark.sparkContext.defaultParallelism, packed.PARTS
    while parts < cores:
        parts *= 2
    tasks = min(parts, max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asked = packed.Asked.build(asked_terms.select("source_id", "term", "tf").toArrow(), ngrams, parts)
    words = catalog.select("source_id", tokens(F.col("combined_text")).alias("terms"))
    found = packed.packed_postings(words, ngrams, parts, _parts)
    sums = write_through(packed.weigh(found, asked, vocabulary.min_document_frequency, parts, tasks), drop_shuffles=True)
    return sums, packed.scored(sums, asked, packed.frequencies(sums, asked), decimals, tasks, top_k)


def _query_groups(query_terms: DataFrame) -> int:
    """How many groups of queries keep each within half of what may be broadcast."""
    size = query_terms.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("b")).first()
    fill = max(size["n"] / QUERY_GROUP_ROWS, (size["b"] or 0) / BROADCAST_BYTES)
    return 1 if fill <= 1 else ceil(2 * fill)


def best_per_query(
    pairs: DataFrame, top_k: int, order: list[Column], *columns: str, spread: int = RANK_SPREAD
) -> DataFrame:
    """First ``top_k`` rows per query in ``order``, with their ``rank``.

    Spark cuts each partition to ``top_k`` rows per query before the shuffle, so a query
    with very many matches does not overload the task that ranks it. It does so for
    moderate K only; beyond that, parts of each query are ranked apart first.
    """
    require(top_k >= 1, "top_k must be at least 1")
    limit = int(pairs.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))

    def ranked(rows: DataFrame, *keys: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("rank", place).filter(F.col("rank") <= top_k)

    if top_k > limit:
        part = F.pmod(F.xxhash64("document_id"), F.lit(spread))
        pairs = ranked(pairs.withColumn("part", part), "query_id", "part").drop("rank", "part")
    return ranked(pairs, "query_id").select("query_id", "rank", "document_id", *columns)


def rank_top_k(scores: DataFrame, top_k: int) -> DataFrame:
    """Best ``top_k`` documents per query by score, ties by lowest id."""
    return best_per_query(scores, top_k, [F.desc("score"), F.asc("document_id")], "score")


def fill_with_zeros(top: DataFrame, queries: DataFrame, catalog: DataFrame, top_k: int) -> DataFrame:
    """Give every query ``top_k`` rows: the lowest unused ids join with score 0.

    A query that is short has fewer than ``top_k`` matches, so the lowest ``2 * top_k``
    ids always hold enough unused ones.
    """
    lowest = (
        catalog.select("source_id").distinct().orderBy("source_id").limit(2 * top_k)
        .agg(F.sort_array(F.collect_list("source_id")).alias("ids"))
        .scalar()
    )
    spare = (
        queries.select(F.col("source_id").alias("query_id"))
        .withColumn("document_id", F.explode(lowest))
        .join(top, ["query_id", "document_id"], "left_anti")
        .withColumn("score", F.lit(0.0))
    )
    return rank_top_k(top.select("query_id", "document_id", "score").unionByName(spare), top_k)


def lexical_top_k(
    queries: DataFrame,
    catalog: DataFrame,
    top_k: int = 10,
    ngrams: bool = False,
    min_document_frequency: int = MIN_DOCUMENT_FREQUENCY,
    decimals: int = SCORE_DECIMALS,
    fill_zero: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Exact TF-IDF cosine top-K over both sides' contract tables."""
    require_columns(queries, CONTRACT)
    require(top_k >= 1, "top_k must be at least 1")
    vocabulary = fit_vocabulary(catalog, min_document_frequency, ngrams)
    asked_terms = cut_lineage(postings(queries, ngrams))
    if fits(asked_terms, broadcast_rows) and _spelled(queries, catalog):
        sums, scores = _packed_scores(asked_terms, vocabulary, decimals, top_k)
        top = write_through(rank_top_k(scores, top_k), drop_shuffles=True)
        discard(sums)
    else:
        rows = write_through(term_rows(catalog, ngrams))
        vocabulary = fit_vocabulary(catalog, min_document_frequency, ngrams, rows)
        top = rank_top_k(sparse_scores(queries, catalog, vocabulary, decimals, broadcast_rows, rows), top_k)
    return fill_with_zeros(top, queries, catalog, top_k) if fill_zero else top
