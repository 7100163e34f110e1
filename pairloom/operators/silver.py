"""Typed, normalised and privacy-masked tables from raw ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.checks import require_columns
from pairloom.functions import text as T
from pairloom.functions.keys import digest
from pairloom.operators.selection import group_split, restrict_to
from pairloom.sources.tables import source_columns

SEED = 5110
TRAIN_RATIO = 0.70
VALIDATION_RATIO = 0.15
SKILL_COUNT_WARNING = 100


def typed_postings(postings: DataFrame) -> DataFrame:
    """Raw posting columns plus parsed times, boolean flags and normalised names."""
    require_columns(postings, source_columns("linkedin_job_postings"))
    flags = ("got_summary", "got_ner", "is_being_worked")
    names = ("job_title", "company", "job_location")
    return postings.withColumns(
        {
            "last_processed_at": F.try_to_timestamp(F.col("last_processed_time")),
            "first_seen_date": F.col("first_seen").try_cast("date"),
            **{f"{name}_flag": T.flag(F.col(name)) for name in flags},
            **{f"{name}_normalized": T.normalize(F.col(name)) for name in names},
        }
    )


def typed_summaries(summaries: DataFrame) -> DataFrame:
    require_columns(summaries, source_columns("job_summary"))
    return summaries.withColumn(
        "job_summary_normalized", T.collapse_spaces(F.col("job_summary"))
    )


def typed_skills(skills: DataFrame, delimiter: str = ",") -> DataFrame:
    require_columns(skills, source_columns("job_skills"))
    return skills.withColumn("skills", T.parse_list(F.col("job_skills"), delimiter))


def silver_jobs(
    postings: DataFrame,
    summaries: DataFrame,
    skills: DataFrame,
    skill_count_warning: int = SKILL_COUNT_WARNING,
    delimiter: str = ",",
) -> DataFrame:
    """One enriched row per posting; postings without children stay, flags false.

    A posting without a skills row has ``skill_count`` 0.
    """
    enriched = (
        typed_postings(postings)
        .join(typed_summaries(summaries), "job_link", "left")
        .join(typed_skills(skills, delimiter), "job_link", "left")
    )
    count = F.when(F.col("skills").isNull(), 0).otherwise(F.size("skills"))
    return (
        enriched.withColumns(
            {"has_summary": F.col("job_summary").isNotNull(), "skill_count": count}
        )
        .withColumns(
            {
                "has_skills": F.col("skill_count") > 0,
                "skills_count_warning": F.col("skill_count") > skill_count_warning,
            }
        )
        .withColumn(
            "eligible_for_ml",
            F.col("has_summary") & F.col("has_skills") & F.col("job_link").isNotNull(),
        )
    )


def restrict_children(postings: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """Child tables cut down to the kept postings before any costly transform."""
    links = postings.select("job_link")
    return [restrict_to(child, links, "job_link") for child in children]


def silver_resumes(
    resumes: DataFrame,
    seed: int = SEED,
    train: float = TRAIN_RATIO,
    validation: float = VALIDATION_RATIO,
    method: str = "xxhash64",
) -> DataFrame:
    """Masked and normalised text, label, stable ids and a leakage-safe split.

    Masking runs on the raw text, before lower-casing. A NULL decision gives a NULL
    label. Identical texts share ``resume_id``; the duplicate-key check reports them.
    """
    require_columns(resumes, source_columns("resume_screening"))
    masked = resumes.withColumns(
        {
            "role_normalized": T.normalize(F.col("Role")),
            "job_description_normalized": T.normalize(F.col("Job_Description")),
            "resume_masked": T.mask_identifiers(F.col("Resume")),
            "decision_normalized": T.normalize(F.col("Decision")),
            "resume_id": digest(F.col("Resume")),
        }
    ).withColumns(
        {
            "resume_normalized": T.normalize(F.col("resume_masked")),
            "label": (F.col("decision_normalized") == "select").cast("int"),
            "job_description_id": digest(F.col("job_description_normalized")),
        }
    ).withColumn("pii_masking_warning", T.has_email(F.col("resume_normalized")))
    return group_split(masked, "job_description_id", seed, train, validation, method)
