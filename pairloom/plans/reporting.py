"""Jobs for people: the blinded review packet and the data summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.checks import cut_lineage
from pairloom.operators import profile, review
from pairloom.operators.silver import SEED
from pairloom.sources.tables import write_csv


def review_packet(
    systems: dict[str, DataFrame],
    silver_resumes: DataFrame,
    postings: DataFrame,
    summaries: DataFrame,
    out_dir: str | None = None,
    *,
    query_count: int,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Review sheet and answer key from the top-K tables of several systems."""
    queries = review.query_metadata(silver_resumes, systems)
    jobs = review.document_metadata(postings, summaries, systems)
    numbered = cut_lineage(review.numbered_pool(systems, queries, query_count, seed))
    sheet = review.review_sheet(numbered, queries, jobs).select(*review.REVIEW_FIELDS)
    key = review.answer_key(numbered, list(systems))
    if out_dir is not None:
        write_csv(sheet.orderBy("review_id"), f"{out_dir}/review_sheet")
        write_csv(key.orderBy("review_id"), f"{out_dir}/answer_key")
    return sheet, key


def data_summary(
    silver_jobs: DataFrame, job_documents: DataFrame, resume_documents: DataFrame, out_dir: str | None = None
) -> dict[str, DataFrame]:
    """Category counts, length histogram and coverage rates; written as JSON when asked."""
    summary = {
        "job_types": profile.category_counts(silver_jobs, "job_type", "job_count"),
        "lengths": profile.length_histogram(job_documents, resume_documents),
        "coverage": profile.coverage_rates(
            silver_jobs, {"has_summary": "summary_coverage", "has_skills": "skills_coverage"}, "job_count"
        ).withColumn("resume_count", resume_documents.agg(F.count(F.lit(1))).scalar()),
    }
    if out_dir is not None:
        for name, table in summary.items():
            table.coalesce(1).write.mode("overwrite").json(f"{out_dir}/{name}")
    return summary
