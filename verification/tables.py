"""The test tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions.text import normalize
from pairloom.operators.documents import contract
from pairloom.functions.keys import digest
from pairloom.sources.tables import spread_small

SEED = 5110


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text table, shared out over the cores when it is small."""
    return spread_small(table(spark, sf_dir, "documents"), "doc_id")


# Openings that hold a header name, a repeat of it in other case, and a profile address.
HEADERS = (
    "Here is a professional resume for Mary O'Neil-Wu:  mary o'neil-wu wrote to www.linkedin.com/in/mary now. ",
    "Professional Resume for Jo Ann Li: Jon Li wrote https://linkedin.com/in/jo-li down. ",
)


def headed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text table; two of every four texts open with one of ``HEADERS``."""
    kind = F.col("doc_id") % 4
    opening = F.when(kind == 0, HEADERS[0]).when(kind == 1, HEADERS[1]).otherwise("")
    return documents(spark, sf_dir).withColumn("text", F.concat(opening, "text"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return contract(documents(spark, sf_dir), "catalog", digest(key), key, F.col("text"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("item_id").cast("string")
    return contract(table(spark, sf_dir, "benchmark"), "query", digest(key), key, F.col("text"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw postings: all strings, some dates and flags not parseable."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("job_link"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_processed_time"),
        F.when(kind.isin("view", "click"), "t").otherwise("f").alias("got_summary"),
        F.when(kind == "signup", "t").when(kind != "error", "f").alias("got_ner"),
        F.when(F.col("value") > 50, "t").otherwise("f").alias("is_being_worked"),
        F.concat(F.lit("  Event \n of  "), kind).alias("job_title"),
        F.concat(F.lit(" User  "), F.col("user_id").cast("string")).alias("company"),
        F.upper("props").alias("job_location"),
        F.when(kind == "error", "not known").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("first_seen"),
        F.lit("Boston").alias("search_city"),
        F.lit("United States").alias("search_country"),
        kind.alias("search_position"),
        F.when(F.col("value") > 50, "Mid senior").otherwise("Associate").alias("job_level"),
        F.when(kind != "error", kind).alias("job_type"),
    )


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("job_link"), F.col("text").alias("job_summary")
    )


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as delimited lists with blanks, repeats and mixed case."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("job_link"),
        F.concat(
            F.replace(F.col("p_name"), F.lit(" "), F.lit(" , ")), F.lit(",, "),
            F.upper("p_name"), F.lit(","), F.col("p_type"),
        ).alias("job_skills"),
    )


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as resumes, each paired with one benchmark text as its description."""
    items = table(spark, sf_dir, "benchmark")
    paired = F.pmod(F.col("doc_id"), items.agg(F.count(F.lit(1))).scalar())
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    decision = F.when(F.col("quality") == 1, " Select").when(F.col("quality") == 0, "reject")
    return (
        documents(spark, sf_dir)
        .join(labels, "doc_id", "left")
        .withColumn("item_id", paired)
        .join(items.select("item_id", F.col("text").alias("description")), "item_id", "left")
        .select(
            F.col("lang").alias("Role"),
            F.col("text").alias("Resume"),
            decision.alias("Decision"),
            F.col("source").alias("Reason_for_decision"),
            F.col("description").alias("Job_Description"),
        )
    )


def benchmark_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts in the silver form the review packet reads."""
    text = normalize(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("resume_id"),
        F.split(text, " ")[0].alias("role_normalized"),
        text.alias("resume_normalized"),
    )


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the posting form the review packet reads."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("job_link"),
        F.concat_ws(" ", "lang", "source").alias("job_title"),
        F.col("source").alias("company"),
        F.col("lang").alias("job_location"),
        F.lit(None).cast("string").alias("job_level"),
        F.lit("text").alias("job_type"),
    )


def centroids(embeddings: DataFrame) -> DataFrame:
    """Unit mean vector per label: one query vector for each class."""
    means = (
        embeddings.select("label", F.posexplode("embedding").alias("at", "value"))
        .groupBy("label", "at")
        .agg(F.avg(F.col("value").cast("double")).alias("value"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("cells"))
    )
    vector = F.transform("cells", lambda cell: cell["value"])
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, v: total + v * v))
    return means.select(
        F.col("label").cast("string").alias("source_id"),
        vector.alias("mean"),
        norm.alias("norm"),
    ).select("source_id", F.transform("mean", lambda v: v / F.col("norm")).alias("embedding"))
