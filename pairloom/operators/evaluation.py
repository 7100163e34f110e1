"""Recall, overlap, labelled-pair scores and ranking quality."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.checks import BROADCAST_ROWS, discard, require, require_columns, write_through
from pairloom.functions.vectors import sparse_dot, sparse_parts, squared_norm
from pairloom.operators.lexical import Vocabulary, attach_terms, best_per_query, postings

PAIR = ["query_id", "document_id"]


def _pairs(df: DataFrame) -> DataFrame:
    return require_columns(df, PAIR).select(*PAIR).distinct()


def recall_report(exact: DataFrame, candidates: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Share of the exact pairs that the candidates and the final lists contain; one row."""
    found = (
        _pairs(exact)
        .join(_pairs(candidates).withColumn("in_candidates", F.lit(1.0)), PAIR, "left")
        .join(_pairs(recommendations).withColumn("in_final", F.lit(1.0)), PAIR, "left")
    )

    def share(name: str) -> Column:
        return F.coalesce(F.avg(F.coalesce(F.col(name), F.lit(0.0))), F.lit(0.0))

    return found.agg(
        share("in_candidates").alias("candidate_recall"), share("in_final").alias("final_recall")
    )


def pair_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """``|L and R| / |L|`` over all pairs, 0 when the left side is empty; one row."""
    found = _pairs(left).join(_pairs(right).withColumn("found", F.lit(1.0)), PAIR, "left")
    share = F.avg(F.coalesce("found", F.lit(0.0)))
    return found.agg(F.coalesce(share, F.lit(0.0)).alias("mean_overlap"))


def overlap_matrix(systems: dict[str, DataFrame], top_k: int) -> DataFrame:
    """Mean over queries of ``|A and B| / k`` for every pair of systems.

    Per (query, document) row one flag per system is enough: the number of systems is
    fixed, so the matrix is a handful of sums and no pairs are joined with each other.
    """
    require(len(systems) >= 2, "an overlap matrix needs at least two systems")
    names = list(systems)
    tagged = None
    for name in names:
        rows = _pairs(systems[name]).withColumn("system", F.lit(name))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    flags = tagged.groupBy(*PAIR).agg(
        *[F.max(F.when(F.col("system") == name, 1).otherwise(0)).alias(f"s{i}") for i, name in enumerate(names)]
    )
    queries = flags.groupBy("query_id").agg(*[F.max(f"s{i}").alias(f"s{i}") for i in range(len(names))])
    ranks = range(len(names))
    uneven = F.count_if(F.least(*[F.col(f"s{i}") for i in ranks]) == 0)
    guard = queries.agg(F.count(F.lit(1)).alias("n"), uneven.alias("uneven"))
    total = guard.select(
        F.when(F.col("uneven") > 0, F.raise_error(F.lit("Systems answer different queries")).cast("bigint"))
        .otherwise(F.col("n"))
    ).scalar()
    cells = [
        F.struct(
            F.lit(names[a]).alias("system_a"),
            F.lit(names[b]).alias("system_b"),
            F.sum(F.col(f"s{a}") * F.col(f"s{b}")).alias("shared"),
        )
        for a in ranks
        for b in ranks
    ]
    return flags.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).select(
        "system_a", "system_b", (F.col("shared") / (total * top_k)).alias("mean_overlap")
    )


def method_comparison(rows: dict[str, tuple[float, DataFrame]]) -> DataFrame:
    """Method, measured seconds, overlap with the baseline and the share that changed.

    Each entry is ``method -> (seconds, one-row frame with mean_overlap)``.
    """
    table = None
    for method, (seconds, overlap) in rows.items():
        row = overlap.select(
            F.lit(method).alias("method"),
            F.lit(float(seconds)).alias("measured_seconds"),
            F.col("mean_overlap").alias("overlap_with_baseline"),
            (1.0 - F.col("mean_overlap")).alias("changed_vs_baseline"),
        )
        table = row if table is None else table.unionByName(row)
    return table


def evaluate_thresholds(
    candidates: DataFrame, exact: DataFrame, thresholds: tuple[float, ...], top_k: int
) -> DataFrame:
    """Candidate pairs, covered queries and recalls at each distance threshold.

    ``candidates(query_id, document_id, distance)`` may repeat a pair; its least distance
    counts. Distances below a threshold qualify. The best K under a threshold are those
    of the whole ranking that qualify, so a single ranking serves every threshold.
    """
    require_columns(candidates, [*PAIR, "distance"])
    least = candidates.groupBy(*PAIR).agg(F.min("distance").alias("distance"))
    truth = _pairs(exact)

    def per_threshold(frame: DataFrame, *measures: str) -> DataFrame:
        aggregates = {
            "rows": lambda t: F.count_if(F.col("distance") < t),
            "queries": lambda t: F.count_if(F.col("nearest") < t),
        }
        cells = [
            F.struct(
                F.lit(t).alias("distance_threshold"), *[aggregates[m](t).alias(m) for m in measures]
            )
            for t in thresholds
        ]
        return frame.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))

    nearest = least.groupBy("query_id").agg(F.min("distance").alias("nearest"))
    best = best_per_query(least, top_k, [F.asc("distance"), F.asc("document_id")], "distance")
    hits = per_threshold(least.join(truth, PAIR, "left_semi"), "rows").withColumnRenamed("rows", "hits")
    final = per_threshold(best.join(truth, PAIR, "left_semi"), "rows").withColumnRenamed("rows", "final_hits")
    size = F.greatest(truth.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    key = "distance_threshold"
    return (
        per_threshold(least, "rows")
        .join(per_threshold(nearest, "queries"), key)
        .join(hits, key)
        .join(final, key)
        .select(
            key,
            F.col("rows").alias("candidate_pairs"),
            F.col("queries").alias("queries_covered"),
            (F.col("hits") / size).alias("candidate_recall"),
            (F.col("final_hits") / size).alias("final_recall"),
        )
    )


def best_setting(grid: DataFrame, queries: int, least_recall: float = 0.9, tie_breakers: tuple[str, ...] = ()) -> DataFrame:
    """The setting that covers all queries with enough recall from the fewest candidates."""
    return (
        grid.filter((F.col("candidate_recall") >= least_recall) & (F.col("queries_covered") == queries))
        .orderBy("candidate_pairs", *tie_breakers)
        .limit(1)
    )


def leaderboard(grid: DataFrame, rows: int = 10, tie_breakers: tuple[str, ...] = ()) -> DataFrame:
    """Settings by recall, then by fewest candidates."""
    return grid.orderBy(F.desc("candidate_recall"), F.asc("candidate_pairs"), *tie_breakers).limit(rows)


# ---------------------------------------------------------------- labelled pairs


def _pair_scores(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine per pair from two ``(pair_id, term, weight)`` tables of raw weights.

    Both sides are keyed by (pair, term), so the join is one to one and a pair with very
    long texts is spread over tasks by its terms.
    """

    def norms(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("pair_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(name))

    dots = (
        left.join(right.withColumnRenamed("weight", "other"), ["pair_id", "term"])
        .groupBy("pair_id")
        .agg(F.sum(F.col("weight") * F.col("other")).alias("dot"))
    )
    joined = (
        pairs.join(norms(left, "left_norm"), "pair_id", "left")
        .join(norms(right, "right_norm"), "pair_id", "left")
        .join(dots, "pair_id", "left")
    )
    length = F.col("left_norm") * F.col("right_norm")
    cosine = F.coalesce(F.when(length > 0, F.col("dot") / length), F.lit(0.0))
    return joined.withColumn("similarity_score", cosine).drop("left_norm", "right_norm", "dot")


def score_pair_texts(
    left: DataFrame,
    right: DataFrame,
    pairs: DataFrame,
    vocabulary: Vocabulary,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Similarity of the two texts of each pair, with the catalog's term weights.

    ``left`` and ``right`` are ``(pair_id, combined_text)``; a side may come in several
    rows per pair, whose terms are added up. ``pairs`` carries ``pair_id`` and any labels;
    it keeps its rows and gains ``similarity_score``.
    """

    def weights(side: DataFrame) -> DataFrame:
        terms = postings(side, vocabulary.ngrams, "pair_id")
        counts = terms.groupBy("pair_id", "term").agg(F.sum("tf").alias("tf"))
        known = attach_terms(counts, vocabulary.table, vocabulary, "pair_id", broadcast_rows)
        return known.select("pair_id", "term", (F.col("tf") * F.col("idf")).alias("weight"))

    return _pair_scores(weights(left), weights(right), pairs)


def _cosine(left: Column, right: Column) -> Column:
    """Cosine of two sparse vectors of a row; 0 if one has no direction."""
    length = F.sqrt(squared_norm(left["values"]) * squared_norm(right["values"]))
    return F.when(length > 0, sparse_dot(left, right) / length).otherwise(F.lit(0.0))


def score_labeled_pairs(query_features: DataFrame, evaluation_features: DataFrame) -> DataFrame:
    """Cosine of each query with its paired document, from ML vectors.

    Every row of ``evaluation_features`` whose query is known gives one score, repeated ids
    included. Query rows that share an id share a text, so one vector stands for them (the
    least one, should they differ). The two vectors meet in one join, sparse as they are.
    """
    require_columns(query_features, ["source_id", "features"])
    require_columns(evaluation_features, ["document_id", "resume_id", "label", "split", "features"])

    def vector() -> Column:
        indices, values = sparse_parts(F.col("features"))
        return F.struct(indices.alias("indices"), values.alias("values"))

    known = query_features.groupBy(F.col("source_id").alias("resume_id")).agg(F.min(vector()).alias("asked"))
    pairs = evaluation_features.select("document_id", "resume_id", "label", "split", vector().alias("described"))
    return pairs.join(known, "resume_id").select(
        "document_id", "resume_id", "label", "split", _cosine(F.col("asked"), F.col("described")).alias("similarity_score")
    )


def ranking_quality(scores: DataFrame) -> DataFrame:
    """Exact ROC-AUC and PR-AUC of score against label; pairs without a label are counted
    and left out. One row."""
    require_columns(scores, ["label", "similarity_score"])
    held = write_through(scores.select(F.col("label").cast("double").alias("label"), "similarity_score"))
    try:
        counts = held.agg(
            F.count("label").alias("n"), F.count_if(F.col("label").isNull()).alias("unlabelled")
        ).first()
        labelled = held.filter(F.col("label").isNotNull())
        areas = {
            metric: BinaryClassificationEvaluator(
                labelCol="label", rawPredictionCol="similarity_score", metricName=metric, numBins=0
            ).evaluate(labelled)
            for metric in ("areaUnderROC", "areaUnderPR")
        }
    finally:
        discard(held)
    return scores.sparkSession.range(1).select(
        F.lit(counts["n"]).cast("bigint").alias("evaluated_pairs"),
        F.lit(counts["unlabelled"]).cast("bigint").alias("unlabelled_pairs"),
        F.lit(float(areas["areaUnderROC"])).alias("roc_auc"),
        F.lit(float(areas["areaUnderPR"])).alias("pr_auc"),
    )
