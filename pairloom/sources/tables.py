"""Registered Parquet sources with fixed schemas, and the sinks jobs write to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from pairloom.checks import require

# Dataset names, file names and column order of the raw tables.
# Every raw column is a nullable string; typing happens in the silver step.
SOURCES = {
    "linkedin_job_postings": (
        "linkedin_job_postings.parquet",
        [
            "job_link", "last_processed_time", "got_summary", "got_ner", "is_being_worked", "job_title", "company",
            "job_location", "first_seen", "search_city", "search_country", "search_position", "job_level", "job_type",
        ],
    ),
    "job_summary": ("job_summary.parquet", ["job_link", "job_summary"]),
    "job_skills": ("job_skills.parquet", ["job_link", "job_skills"]),
    "resume_screening": (
        "resume_screening_train.parquet",
        ["Role", "Resume", "Decision", "Reason_for_decision", "Job_Description"],
    ),
}


def _registered(name: str) -> tuple[str, list[str]]:
    if name not in SOURCES:
        raise KeyError(f"no table is registered as {name!r}; registered are {sorted(SOURCES)}")
    return SOURCES[name]


def source_schema(name: str) -> StructType:
    """All-string schema of a registered raw table."""
    _, columns = _registered(name)
    return StructType([StructField(column, StringType(), True) for column in columns])


def source_columns(name: str) -> list[str]:
    return source_schema(name).names


def read_source(spark: SparkSession, raw_dir: str, name: str) -> DataFrame:
    """Scan a registered table from a local or object-store folder."""
    file_name, _ = _registered(name)
    return read_table(spark, f"{str(raw_dir).rstrip('/')}/{file_name}", source_schema(name))


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Scan Parquet; with a given schema no file is opened to infer one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(str(path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no Parquet table at {path}; check the raw folder") from error
        raise


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Share a scan with fewer splits than cores out by key, before CPU-heavy text work.

    Splits follow files and row groups, so a small table may arrive as one task. A large
    table has more splits than cores and is returned unchanged, without a shuffle. For
    plain scans only: the split count must be known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def write_parquet(
    df: DataFrame, path: str, files: int | None = None, shuffle: bool = True
) -> None:
    """Overwrite ``path``; ``files`` bounds the number of output files.

    Rows are redistributed by default, because coalescing would also shrink the
    number of tasks that compute them. ``shuffle=False`` is for small results.
    """
    if files is not None:
        require(files >= 1, "files must be at least 1")
        df = df.repartition(files) if shuffle else df.coalesce(files)
    df.write.mode("overwrite").parquet(str(path))


def write_metrics(metrics: DataFrame, path: str, **parameters) -> None:
    """Write a one-row metrics frame plus the run's parameters as JSON, keys sorted."""
    from pyspark.sql import functions as F

    named = metrics.withColumns({key: F.lit(value) for key, value in parameters.items()})
    named.select(*sorted(named.columns)).coalesce(1).write.mode("overwrite").json(str(path))


def write_csv(df: DataFrame, path: str) -> None:
    """Write a header CSV of a small review or tuning table as one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option(
        "escape", '"'
    ).csv(str(path))


def save_model(model, path: str) -> None:
    """Overwrite a fitted Spark ML model."""
    model.write().overwrite().save(str(path))
