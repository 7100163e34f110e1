"""Pooled, blinded review packets and what comes back from the reviewers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.checks import fits, require, require_columns
from pairloom.functions.keys import seeded_digest
from pairloom.operators.selection import pick_diverse

# Excerpt lengths, field order of both files, and the rating columns.
QUERY_EXCERPT = 1200
DOCUMENT_EXCERPT = 1600
JOB_FIELDS = [
    "job_title", "company", "job_location", "job_level", "job_type", "job_summary_excerpt",
]
RATINGS = [
    "role_relevance_1_to_5", "skills_alignment_1_to_5", "seniority_alignment_1_to_5",
    "overall_relevance_1_to_5",
]
ANSWERS = [*RATINGS, "cannot_judge", "reviewer_notes"]
REVIEW_FIELDS = ["review_id", "query_id", "resume_role", "resume_excerpt", *JOB_FIELDS, *ANSWERS]


def pool_systems(systems: dict[str, DataFrame]) -> DataFrame:
    """One row per (query, document) with every system's rank and score.

    A tagged union and one grouping do the work of a chain of full outer joins.
    """
    require(len(systems) > 0, "pooling needs at least one system")
    columns = ["query_id", "document_id", "rank", "score"]
    tagged = reduce(
        DataFrame.unionByName,
        [
            require_columns(top, columns).select(*columns, F.lit(name).alias("system"))
            for name, top in systems.items()
        ],
    )
    own = {name: F.col("system") == name for name in systems}
    return tagged.groupBy("query_id", "document_id").agg(
        *[
            F.max(F.when(own[name], F.col(value))).alias(f"{name}_{value}")
            for name in systems
            for value in ("rank", "score")
        ]
    )


def shared_queries(systems: dict[str, DataFrame]) -> DataFrame:
    """Queries that every system answered."""
    return reduce(DataFrame.intersect, [top.select("query_id") for top in systems.values()])


def pooled_documents(systems: dict[str, DataFrame]) -> DataFrame:
    """Documents that at least one system returned."""
    return reduce(DataFrame.union, [top.select("document_id") for top in systems.values()]).distinct()


def query_metadata(resumes: DataFrame, systems: dict[str, DataFrame]) -> DataFrame:
    """Role and excerpt of the queries all systems answered."""
    require_columns(resumes, ["resume_id", "role_normalized", "resume_normalized"])
    known = shared_queries(systems).withColumnRenamed("query_id", "resume_id")
    return resumes.join(known, "resume_id", "left_semi").select(
        F.col("resume_id").alias("source_id"),
        F.coalesce("role_normalized", F.lit("")).alias("resume_role"),
        F.coalesce(F.substring("resume_normalized", 1, QUERY_EXCERPT), F.lit("")).alias("resume_excerpt"),
    )


def document_metadata(postings: DataFrame, summaries: DataFrame, systems: dict[str, DataFrame]) -> DataFrame:
    """Posting fields and summary excerpt of the pooled documents only."""
    links = pooled_documents(systems).withColumnRenamed("document_id", "job_link")
    links = F.broadcast(links) if fits(links) else links  # else all texts would move to meet them
    wanted = postings.join(links, "job_link", "left_semi")
    texts = summaries.join(links, "job_link", "left_semi").select(
        "job_link", F.substring("job_summary", 1, DOCUMENT_EXCERPT).alias("job_summary_excerpt")
    )
    return wanted.join(texts, "job_link", "left").select(
        F.col("job_link").alias("source_id"),
        *[F.coalesce(F.col(name), F.lit("")).alias(name) for name in JOB_FIELDS],
    )


def numbered_pool(
    systems: dict[str, DataFrame], queries: DataFrame, query_count: int, seed: int
) -> DataFrame:
    """Pooled rows of the chosen queries with ``query_number`` and ``review_id``.

    ``queries`` carries ``source_id`` and ``resume_role``. Inside a query, candidates stand
    in seeded digest order, which says nothing about rank or system. A query has at most
    systems x K candidates, so its window is small.
    """
    pooled = pool_systems(systems)
    answered = queries.join(
        pooled.select(F.col("query_id").alias("source_id")).distinct(), "source_id", "left_semi"
    )
    picks = pick_diverse(answered, "source_id", "resume_role", query_count, seed)
    chosen = picks.select(
        F.col("source_id").alias("resume_id"), F.format_string("Q%03d", "pick").alias("query_number")
    )
    order = Window.partitionBy("resume_id").orderBy(
        seeded_digest(seed, F.col("resume_id"), F.col("job_link")), "job_link"
    )
    rows = pooled.withColumnsRenamed({"query_id": "resume_id", "document_id": "job_link"}).join(
        chosen, "resume_id"
    )
    return rows.withColumn(
        "review_id", F.format_string("%s-C%02d", "query_number", F.row_number().over(order))
    )


def review_sheet(numbered: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """What a reviewer sees: no system, rank, score, id or label; blanks to fill in."""
    about_query = queries.select(F.col("source_id").alias("resume_id"), "resume_role", "resume_excerpt")
    about_job = documents.select(F.col("source_id").alias("job_link"), *JOB_FIELDS)
    joined = numbered.join(about_query, "resume_id", "left").join(about_job, "job_link", "left")
    shown = ["resume_role", "resume_excerpt", *JOB_FIELDS]
    return joined.select(
        "review_id",
        F.col("query_number").alias("query_id"),
        *[F.coalesce(F.col(name), F.lit("")).alias(name) for name in shown],
        *[F.lit("").alias(name) for name in ANSWERS],
    )


def answer_key(numbered: DataFrame, systems: list[str]) -> DataFrame:
    """Which systems returned each row, with rank and score; opened after the review."""
    provenance = [
        column
        for name in systems
        for column in (
            F.col(f"{name}_rank").isNotNull().alias(f"in_{name}"),
            F.col(f"{name}_rank"),
            F.col(f"{name}_score"),
        )
    ]
    return numbered.select(
        "review_id", F.col("query_number").alias("query_id"), "resume_id", "job_link", *provenance
    )


def check_sheet(filled: DataFrame, issued: DataFrame) -> DataFrame:
    """Findings about a returned sheet: ``(review_id, problem)``; none means it is valid."""
    require_columns(filled, ["review_id", *RATINGS, "cannot_judge"])
    given = {name: F.coalesce(F.trim(F.col(name)), F.lit("")) for name in [*RATINGS, "cannot_judge"]}
    skipped = given["cannot_judge"] == "1"
    problems = [
        F.when((given[name] == "") & ~skipped, F.lit(f"{name} missing")).when(
            (given[name] != "") & ~given[name].rlike("^[1-5]$"), F.lit(f"{name} not in 1-5")
        )
        for name in RATINGS
    ] + [F.when(~given["cannot_judge"].isin("", "0", "1"), F.lit("cannot_judge not 0 or 1"))]
    wrong = filled.select("review_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))
    ids = ["review_id"]
    absent = issued.select(*ids).join(filled.select(*ids), ids, "left_anti")
    foreign = filled.select(*ids).join(issued.select(*ids), ids, "left_anti")
    repeated = filled.groupBy(*ids).count().filter("count > 1").select(*ids)
    return (
        wrong.unionByName(absent.withColumn("problem", F.lit("row missing")))
        .unionByName(foreign.withColumn("problem", F.lit("row not issued")))
        .unionByName(repeated.withColumn("problem", F.lit("row repeated")))
    )


def merge_reviews(sheets: list[DataFrame], tolerance: int = 1) -> DataFrame:
    """Per row and rating over all reviewers: mean, spread, and whether they disagree."""
    columns = ["review_id", *RATINGS, "cannot_judge"]
    stacked = reduce(DataFrame.unionByName, [sheet.select(*columns) for sheet in sheets])
    numbers = stacked.select(
        "review_id",
        *[
            F.when(F.coalesce(F.trim("cannot_judge"), F.lit("")) != "1", F.col(name).try_cast("int")).alias(name)
            for name in RATINGS
        ],
    )
    merged = numbers.groupBy("review_id").agg(
        F.count("overall_relevance_1_to_5").alias("judgements"),
        *[F.avg(name).alias(f"mean_{name}") for name in RATINGS],
        *[(F.max(name) - F.min(name)).alias(f"spread_{name}") for name in RATINGS],
    )
    spreads = F.greatest(*[F.coalesce(F.col(f"spread_{name}"), F.lit(0)) for name in RATINGS])
    return merged.withColumn("disagreement", spreads > tolerance)


def relevance_at_k(merged: DataFrame, key: DataFrame, systems: list[str], top_k: int) -> DataFrame:
    """Mean judged relevance of each system's first K per query, and per-query wins.

    Rows: ``system, queries, relevance_at_k, wins``; systems that tie both win.
    """
    judged = key.join(merged.select("review_id", "mean_overall_relevance_1_to_5"), "review_id")
    entries = F.array(
        *[F.struct(F.lit(n).alias("system"), F.col(f"{n}_rank").alias("rank")) for n in systems]
    )
    per_query = (
        judged.select("query_id", F.col("mean_overall_relevance_1_to_5").alias("rating"), F.explode(entries).alias("e"))
        .filter((F.col("e.rank") <= top_k) & F.col("rating").isNotNull())
        .groupBy("query_id", F.col("e.system").alias("system"))
        .agg(F.avg("rating").alias("relevance"))
    )
    # Rounded, so that equal means tie whatever order they were summed in.
    best = Window.partitionBy("query_id").orderBy(F.round("relevance", 9).desc())
    return (
        per_query.withColumn("place", F.rank().over(best))
        .groupBy("system")
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.avg("relevance").alias("relevance_at_k"),
            F.count_if(F.col("place") == 1).alias("wins"),
        )
    )


def title_overlap(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 when both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))
