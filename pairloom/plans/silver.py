"""Jobs that turn raw tables into checked silver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.checks import discard, require, write_through
from pairloom.operators import profile, silver
from pairloom.operators.quality import TableRules
from pairloom.operators.selection import hash_sample
from pairloom.sources.tables import read_source, source_columns, write_parquet

# The declared expectations about the raw tables.
FLAG_VALUES = (["t", "f"], "error")
SOURCE_RULES = {
    "linkedin_job_postings": TableRules(
        required=source_columns("linkedin_job_postings"),
        primary_key=["job_link"],
        non_null=["job_link"],
        allowed={
            "got_summary": FLAG_VALUES,
            "got_ner": FLAG_VALUES,
            "is_being_worked": FLAG_VALUES,
            "job_level": (["Associate", "Mid senior"], "warning"),
            "job_type": (["Onsite", "Hybrid", "Remote"], "warning"),
        },
    ),
    "job_summary": TableRules(
        required=source_columns("job_summary"),
        primary_key=["job_link"],
        non_null=["job_link"],
        text_length={"job_summary": (1, "warning")},
    ),
    "job_skills": TableRules(
        required=source_columns("job_skills"),
        primary_key=["job_link"],
        non_null=["job_link"],
        list_size={"job_skills": (",", 1, 100)},
    ),
    "resume_screening": TableRules(
        required=source_columns("resume_screening"),
        non_null=["Role", "Resume", "Decision", "Job_Description"],
        allowed={"Decision": (["select", "reject"], "error")},
        text_length={"Resume": (1, "error"), "Job_Description": (1, "error")},
    ),
}


def gate(metrics: DataFrame, before: str, after: str, duplicates: str) -> DataFrame:
    """Raise unless the row count is unchanged and no key repeats; hands the metrics on."""
    row = metrics.first()
    require(row[before] == row[after], f"Row count changed from {row[before]} to {row[after]}")
    require(row[duplicates] == 0, f"{row[duplicates]} rows repeat a key ({duplicates})")
    values = tuple(row)
    return metrics.sparkSession.createDataFrame([values], metrics.schema)


def land(df: DataFrame, path: str | None, files: int | None) -> DataFrame:
    """Write ``df`` and hand back the written table; without a path, ``df`` itself."""
    if path is None:
        return df
    write_parquet(df, path, files)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(staged: DataFrame, path: str | None, files: int | None) -> DataFrame:
    """Land a table that ``write_through`` staged and remove the staged copy."""
    published = land(staged, path, files)
    if path is not None:
        discard(staged)
    return published


def build_silver_jobs(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str | None = None,
    fraction: float = 1.0,
    seed: int = silver.SEED,
    skill_count_warning: int = silver.SKILL_COUNT_WARNING,
    files: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Scan, sample, restrict children, enrich, gate and write; returns table and metrics."""
    postings = hash_sample(
        read_source(spark, raw_dir, "linkedin_job_postings"), "job_link", fraction, seed
    )
    children = [read_source(spark, raw_dir, name) for name in ("job_summary", "job_skills")]
    if fraction < 1:
        children = silver.restrict_children(postings, *children)
    # Written aside first: what fails its gate is never published.
    table = write_through(silver.silver_jobs(postings, *children, skill_count_warning))
    metrics = gate(profile.job_metrics(postings, table), "posting_count", "silver_count", "duplicate_job_links")
    name = "jobs" if fraction == 1 else "jobs_sample"
    return publish(table, out_dir and f"{out_dir}/{name}", files), metrics


def build_silver_resumes(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str | None = None,
    seed: int = silver.SEED,
    train: float = silver.TRAIN_RATIO,
    validation: float = silver.VALIDATION_RATIO,
    files: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Mask, label, split, gate and write; returns table and metrics."""
    source = read_source(spark, raw_dir, "resume_screening")
    table = write_through(silver.silver_resumes(source, seed, train, validation))
    metrics = gate(profile.resume_metrics(source, table), "source_count", "silver_count", "duplicate_resume_ids")
    return publish(table, out_dir and f"{out_dir}/resumes", files), metrics
