"""The document contract that catalog and query side share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.checks import require_columns
from pairloom.functions.keys import digest, pair_digest
from pairloom.functions.text import join_parts

CONTRACT = ["document_id", "document_type", "source_id", "combined_text"]


def contract(df: DataFrame, kind: str, document_id: Column, source_id: Column, *parts: Column) -> DataFrame:
    """Contract rows from any table; rows whose joined text is empty are dropped."""
    return df.select(
        document_id.alias("document_id"),
        F.lit(kind).alias("document_type"),
        source_id.cast("string").alias("source_id"),
        join_parts(*parts).alias("combined_text"),
    ).filter(F.length("combined_text") > 0)


def job_documents(jobs: DataFrame) -> DataFrame:
    """Title, summary and skills of each posting."""
    title, summary = "job_title_normalized", "job_summary_normalized"
    require_columns(jobs, ["job_link", title, summary, "skills"])
    link = F.col("job_link")
    skills = F.array_join("skills", " ")
    return contract(jobs, "job", digest(link), link, F.col(title), F.col(summary), skills)


def resume_documents(resumes: DataFrame) -> DataFrame:
    """Role and masked text only; the paired description and the label stay out."""
    require_columns(resumes, ["resume_id", "role_normalized", "resume_normalized"])
    key = F.col("resume_id")
    return contract(resumes, "resume", key, key, F.col("role_normalized"), F.col("resume_normalized"))


def evaluation_documents(resumes: DataFrame) -> DataFrame:
    """Paired descriptions, for evaluation only; rows without a description are dropped."""
    description = "job_description_normalized"
    require_columns(resumes, ["resume_id", "job_description_id", description, "label", "split"])
    return (
        resumes.filter(F.col(description).isNotNull())
        .withColumn("pair", pair_digest(F.col("resume_id"), F.col("job_description_id")))
        .select(
            F.col("pair").alias("document_id"),
            F.lit("evaluation_job_description").alias("document_type"),
            F.col("pair").alias("source_id"),
            F.col(description).alias("combined_text"),
            "resume_id",
            "label",
            "split",
        )
    )
