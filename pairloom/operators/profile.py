"""Counts, coverage rates and histograms that describe a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.checks import require_columns
from pairloom.functions.text import length_bucket, word_count
from pairloom.operators.documents import CONTRACT


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows go beyond the first of their key."""
    require_columns(df, keys)
    extra = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return extra.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"))


def category_counts(df: DataFrame, column: str, count_name: str) -> DataFrame:
    """Rows per category, NULL as ``unknown``, most frequent first."""
    require_columns(df, [column])
    named = df.select(F.coalesce(F.col(column), F.lit("unknown")).alias(column))
    return (
        named.groupBy(column)
        .agg(F.count(F.lit(1)).alias(count_name))
        .orderBy(F.desc(count_name), F.asc(column))
    )


def length_histogram(*sides: DataFrame) -> DataFrame:
    """Documents per type and word-count bucket over both sides."""
    documents = None
    for side in sides:
        rows = require_columns(side, CONTRACT).select("document_type", "combined_text")
        documents = rows if documents is None else documents.unionByName(rows)
    bucket = length_bucket(word_count(F.col("combined_text")))
    return documents.groupBy("document_type", bucket.alias("length_bucket")).agg(
        F.count(F.lit(1)).alias("document_count")
    )


def coverage_rates(df: DataFrame, flags: dict[str, str], count_name: str) -> DataFrame:
    """Row count and the share of true values of each flag (flag column -> rate name)."""
    require_columns(df, flags)
    return df.agg(
        F.count(F.lit(1)).alias(count_name),
        *[F.avg(F.col(flag).cast("double")).alias(rate) for flag, rate in flags.items()],
    )


def job_metrics(postings: DataFrame, silver: DataFrame) -> DataFrame:
    """One row of counts and coverage; ratios are 0.0 on an empty table.

    Grouping by key first gives the duplicate count and every total in one pass.
    """
    total = {
        "silver_count": F.lit(1),
        "summary_count": F.col("has_summary").cast("int"),
        "skills_count": F.col("has_skills").cast("int"),
        "eligible_for_ml_count": F.col("eligible_for_ml").cast("int"),
    }
    per_key = silver.groupBy("job_link").agg(
        *[F.sum(value).alias(name) for name, value in total.items()]
    )
    sums = per_key.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in total],
        F.coalesce(F.sum(F.col("silver_count") - 1), F.lit(0)).alias("duplicate_job_links"),
    )

    def share(name: str):
        some = F.col("silver_count") > 0
        return F.when(some, F.try_divide(F.col(name), F.col("silver_count"))).otherwise(0.0)

    return sums.select(
        postings.agg(F.count(F.lit(1))).scalar().alias("posting_count"),
        "silver_count",
        "duplicate_job_links",
        share("summary_count").alias("summary_coverage"),
        share("skills_count").alias("skills_coverage"),
        "eligible_for_ml_count",
    )


def resume_metrics(source: DataFrame, silver: DataFrame) -> DataFrame:
    """One row of counts, selected labels and residual e-mail warnings."""
    per_key = silver.groupBy("resume_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("label").alias("selected"),
        F.sum(F.col("pii_masking_warning").cast("int")).alias("warnings"),
    )
    none = F.lit(0)
    return per_key.agg(
        F.coalesce(F.sum("rows"), none).alias("silver_count"),
        F.coalesce(F.sum(F.col("rows") - 1), none).alias("duplicate_resume_ids"),
        F.coalesce(F.sum("selected"), none).alias("selected_count"),
        F.coalesce(F.sum("warnings"), none).alias("pii_warning_count"),
    ).select(
        source.agg(F.count(F.lit(1))).scalar().alias("source_count"),
        "silver_count",
        "duplicate_resume_ids",
        "selected_count",
        "pii_warning_count",
    )
