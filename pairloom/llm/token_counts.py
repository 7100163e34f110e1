"""Exact token counts for every context limit from one length histogram.

Texts are cut into pre-tokens as in ``bpe``, whole and whatever their length, and counted; equal lengths are one row of the histogram, summed
map-side. Suffix sums over the histogram answer, for every limit that is a length that
occurs, the texts that are longer and the tokens left when each text is cut to the limit; a
limit in between follows from the next lower one. Sums are taken in two steps, over spans of
``SPAN`` lengths and inside each span, so no window holds all lengths.

Defined cases: null and empty texts have length 0 and are counted; repeated rows count each;
a column with the name of the new one is replaced; an empty table has an empty histogram, and quantiles of it are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm.bpe import blocks, encoding, only_known_pattern, pre_tokens, ranks
from pairloom.llm.common import decoded, with_arrow_columns

SPAN = 512


def with_length(df: DataFrame, path: str, pattern: str, text: str = "text", name: str = "n_tokens", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the number of tokens of the whole text under a rank file."""
    only_known_pattern(pattern)

    def compute(texts: list[bytes]) -> list:
        return [pa.array(np.concatenate([np.empty(0, np.int64), *(lengths(block, path, pattern) for block in blocks([decoded(t) for t in texts]))]))]

    return with_arrow_columns(df, text, f"`{name}` long", compute, drop=drop)


def lengths(texts: list[str], path: str, pattern: str) -> np.ndarray:
    """Tokens of each text: each distinct pre-token is merged once for all of them."""
    words, counts = pre_tokens(texts)
    coded = words.dictionary_encode()
    known, merge = ranks(path), encoding(path, pattern)._core_bpe.encode_single_piece
    sizes = np.array([1 if w in known else len(merge(w)) for w in coded.dictionary.to_pylist()] or [0], np.int64)
    ends = np.cumsum(np.concatenate(([0], sizes[coded.indices.to_numpy()])))
    stops = np.cumsum(counts)
    return ends[stops] - ends[stops - counts]


def histogram(lengths: DataFrame, name: str = "n_tokens") -> DataFrame:
    """``(length, docs)`` of every length that occurs."""
    return lengths.groupBy(F.col(name).alias("length")).agg(F.count(F.lit(1)).alias("docs"))


def limits(counted: DataFrame) -> DataFrame:
    """For each length of a histogram, as a context limit:

    ``docs`` of that length, ``docs_over`` that are longer, ``tokens_over`` of those,
    ``docs_total`` and ``tokens_total`` of all, ``truncated_tokens`` (all texts cut to the
    limit), ``lost_tokens``, and ``quantile``, the share of texts that fit.
    """
    spans = counted.withColumn("span", F.floor(F.col("length") / SPAN))
    per_span = spans.groupBy("span").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("length")).alias("t"))
    # One row for each SPAN of lengths: the longest text bounds them, not the number of texts.
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    outer = per_span.select(
        "span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
        F.sum("d").over(everywhere).alias("docs_total"), F.sum("t").over(everywhere).alias("tokens_total"),
    )
    inside = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    joined = spans.withColumns({
        "d_in": F.coalesce(F.sum("docs").over(inside), F.lit(0)),
        "t_in": F.coalesce(F.sum(F.col("docs") * F.col("length")).over(inside), F.lit(0)),
    }).join(outer, "span")
    over = joined.withColumns({"docs_over": F.col("d_in") + F.col("d_later"), "tokens_over": F.col("t_in") + F.col("t_later")})
    truncated = F.col("tokens_total") - F.col("tokens_over") + F.col("docs_over") * F.col("length")
    return over.select(
        "length", "docs", "docs_over", "tokens_over", "docs_total", "tokens_total", truncated.alias("truncated_tokens"),
        (F.col("tokens_total") - truncated).alias("lost_tokens"),
        (1 - F.col("docs_over") / F.col("docs_total")).alias("quantile"),
    )


def truncated_total(answers: DataFrame, limit: int) -> DataFrame:
    """One row: all tokens when every text is cut to ``limit``, whether it occurs or not."""
    fits = F.col("length") <= limit
    return answers.agg(
        F.coalesce(F.sum(F.when(fits, F.col("docs") * F.col("length")).otherwise(F.col("docs") * limit)), F.lit(0)).alias("truncated_tokens")
    )


def length_quantile(answers: DataFrame, share: float) -> DataFrame:
    """One row: the least length that at least ``share`` of the texts do not exceed."""
    return answers.filter(F.col("docs_total") - F.col("docs_over") >= share * F.col("docs_total")).agg(F.min("length").alias("length"))
