"""Jobs that match query documents with a catalog and compare the ways of doing it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from pairloom.checks import cut_lineage, require, write_through
from pairloom.functions.keys import pair_digest
from pairloom.operators import documents, embedding, evaluation, features, lsh, scoring
from pairloom.operators.selection import select_queries
from pairloom.plans.silver import land
from pairloom.sources.tables import save_model, write_csv, write_metrics

TOP_K = 10
QUERY_SPLIT = "validation"
METRIC_DECIMALS = 6


@dataclass
class Sides:
    """Catalog and query documents, with features of one fitted pipeline."""

    catalog: DataFrame
    queries: DataFrame
    model: Any
    catalog_features: DataFrame
    query_features: DataFrame

    def exact(self, top_k: int) -> DataFrame:
        return scoring.sparse_top_k(
            features.sparse_rows(self.query_features), features.sparse_rows(self.catalog_features), top_k
        )


def featurise(
    catalog: DataFrame,
    queries: DataFrame,
    ngrams: bool = False,
    num_features: int | None = None,
    min_document_frequency: int = features.MIN_DOCUMENT_FREQUENCY,
    out_dir: str | None = None,
    files: int | None = None,
) -> Sides:
    """Fit on the catalog and transform both sides, reading the catalog text once.

    With ``out_dir`` the features of both sides are written and read back from there.
    """
    model, catalog_features = features.fit_and_add_features(
        catalog, num_features, min_document_frequency, ngrams
    )
    query_features = features.add_features(model, queries).select(*catalog_features.columns)
    if out_dir is None:
        query_features = cut_lineage(query_features)
    else:
        catalog_features = land(catalog_features, f"{out_dir}/job_features", files)
        query_features = land(query_features, f"{out_dir}/resume_features", files)
    return Sides(catalog, queries, model, catalog_features, query_features)


def pick_sides(
    silver_jobs: DataFrame, silver_resumes: DataFrame, split: str, limit: int | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalog documents, query documents and the chosen silver resumes.

    A resume that came with several roles asks one question for each. Its first role keeps
    the resume's id, the others get ids of their own in ``resume_id``; ``owner`` names the
    resume of all of them. Rows that repeat a resume and role ask once.
    """
    # Written, as the filter on joined text would else sink to the scan and mask the texts of all splits.
    chosen = write_through(select_queries(silver_resumes, "resume_id", split, limit), drop_shuffles=True)
    role = F.coalesce("role_normalized", F.lit(""))
    first = chosen.groupBy("resume_id").agg(F.min(role).alias("first_role"))
    question = F.when(role == F.col("first_role"), F.col("resume_id")).otherwise(pair_digest(F.col("resume_id"), role))
    asked = chosen.join(first, "resume_id").withColumns({"owner": F.col("resume_id"), "resume_id": question}).drop("first_role")
    documents_ = documents.resume_documents(asked)
    row = F.min(F.struct(*[c for c in documents_.columns if c != "source_id"])).alias("row")
    queries = documents_.groupBy("source_id").agg(row).select("source_id", "row.*").select(*documents_.columns)
    return documents.job_documents(silver_jobs), queries, asked


def merge_questions(ranked: DataFrame, asked: DataFrame, top_k: int) -> DataFrame:
    """One list per resume from the lists of its questions: a document counts as near as it
    is to the nearest of them. The first K of all questions hold the first K of the resume."""
    owners = asked.select(F.col("resume_id").alias("query_id"), "owner").distinct()
    nearest = ranked.join(owners, "query_id").groupBy(F.col("owner").alias("query_id"), "document_id").agg(F.min("distance").alias("distance"))
    return lsh.rerank(nearest, top_k)


def refuse_test_split(split: str) -> None:
    require(split != "test", "methods are compared on train or validation; the test split stays unseen until the end")


def match(
    silver_jobs: DataFrame,
    silver_resumes: DataFrame,
    out_dir: str | None = None,
    split: str = QUERY_SPLIT,
    limit: int | None = None,
    num_features: int | None = None,
    min_document_frequency: int = features.MIN_DOCUMENT_FREQUENCY,
    bucket_length: float = lsh.BUCKET_LENGTH,
    num_hash_tables: int = lsh.NUM_HASH_TABLES,
    distance_threshold: float = lsh.DISTANCE_THRESHOLD,
    top_k: int = TOP_K,
    seed: int = lsh.SEED,
    files: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Documents, features, approximate candidates, rerank, proxy evaluation, sinks.

    Returns the recommendations and a one-row metrics frame.
    """
    catalog, queries, chosen = pick_sides(silver_jobs, silver_resumes, split, limit)
    sides = featurise(catalog, queries, False, num_features, min_document_frequency, out_dir, files)
    index = lsh.fit_index(sides.catalog_features, bucket_length, num_hash_tables, seed)
    search = lsh.lsh_search(index, sides.query_features, sides.catalog_features, distance_threshold, top_k)
    ranked = cut_lineage(merge_questions(search.ranked, chosen, top_k))

    labelled = documents.evaluation_documents(chosen)
    scores = cut_lineage(
        evaluation.score_labeled_pairs(
            sides.query_features, features.add_features(sides.model, labelled)
        )
    )
    quality = evaluation.ranking_quality(scores)

    def count(frame: DataFrame):
        return frame.agg(F.count(F.lit(1))).scalar()

    metrics = quality.select(
        count(sides.catalog_features.select("source_id")).alias("job_documents"),
        count(chosen.select("owner").distinct()).alias("resume_queries"),
        search.counts.agg(F.coalesce(F.sum("candidates"), F.lit(0))).scalar().alias("candidate_pairs"),
        count(ranked.select("query_id").distinct()).alias("matched_resumes"),
        count(ranked).alias("recommendation_rows"),
        "evaluated_pairs",
        F.round("roc_auc", METRIC_DECIMALS).alias("roc_auc"),
        F.round("pr_auc", METRIC_DECIMALS).alias("pr_auc"),
    )
    if out_dir is not None:
        land(ranked, f"{out_dir}/top_k_recommendations", files)
        land(scores, f"{out_dir}/evaluation_scores", files)
        save_model(sides.model, f"{out_dir}/models/tfidf")
        save_model(index, f"{out_dir}/models/lsh")
        write_metrics(
            metrics, f"{out_dir}/metrics", resume_query_split=split, top_k=top_k,
            distance_threshold=distance_threshold, bucket_length=bucket_length,
            num_hash_tables=num_hash_tables,
        )
    return ranked, metrics


def audit_index(
    catalog: DataFrame,
    queries: DataFrame,
    out_dir: str | None = None,
    bucket_length: float = lsh.BUCKET_LENGTH,
    num_hash_tables: int = lsh.NUM_HASH_TABLES,
    distance_threshold: float = lsh.DISTANCE_THRESHOLD,
    top_k: int = TOP_K,
    seed: int = lsh.SEED,
    num_features: int | None = None,
) -> DataFrame:
    """Approximate against exact search on the same features; one row of metrics."""
    sides = featurise(catalog, queries, num_features=num_features, out_dir=out_dir)
    exact = cut_lineage(sides.exact(top_k))
    index = lsh.fit_index(sides.catalog_features, bucket_length, num_hash_tables, seed)
    search = lsh.lsh_search(index, sides.query_features, sides.catalog_features, distance_threshold, top_k)
    ranked = cut_lineage(search.ranked)
    found = cut_lineage(lsh.found_pairs(exact, index, sides.query_features, sides.catalog_features, distance_threshold))
    jobs = catalog.agg(F.count(F.lit(1))).scalar()
    asked = queries.agg(F.count(F.lit(1))).scalar()
    metrics = evaluation.recall_report(exact, found, ranked).select(
        jobs.alias("job_documents"),
        asked.alias("resume_queries"),
        (jobs * asked).alias("exhaustive_pairs"),
        search.counts.agg(F.coalesce(F.sum("candidates"), F.lit(0))).scalar().alias("candidate_pairs"),
        ranked.select("query_id").distinct().agg(F.count(F.lit(1))).scalar().alias("matched_resumes"),
        F.round("candidate_recall", METRIC_DECIMALS).alias("candidate_recall"),
        F.round("final_recall", METRIC_DECIMALS).alias("final_recall"),
    )
    if out_dir is not None:
        land(exact, f"{out_dir}/exact_top_k", None)
        land(ranked, f"{out_dir}/lsh_top_k", None)
        write_metrics(metrics, f"{out_dir}/metrics", top_k=top_k, bucket_length=bucket_length)
    return metrics


def tune_index(
    catalog: DataFrame,
    queries: DataFrame,
    out_dir: str | None = None,
    top_k: int = TOP_K,
    widths=lsh.BUCKET_LENGTHS,
    table_counts=lsh.HASH_TABLE_COUNTS,
    thresholds=lsh.DISTANCE_THRESHOLDS,
    seed: int = lsh.SEED,
    num_features: int | None = None,
    split: str = QUERY_SPLIT,
) -> DataFrame:
    """The whole parameter grid from one hashing pass; one row per setting.

    Settings are chosen by it, so the locked test split is refused.
    """
    refuse_test_split(split)
    sides = featurise(catalog, queries, num_features=num_features, out_dir=out_dir)
    exact = cut_lineage(sides.exact(top_k))
    grid = lsh.audit_grid(
        sides.query_features, sides.catalog_features, exact, top_k, widths, table_counts, thresholds, seed
    )
    if out_dir is not None:
        grid = cut_lineage(grid)
        write_csv(grid, f"{out_dir}/results_csv")
        grid.coalesce(1).write.mode("overwrite").json(f"{out_dir}/results_json")
    return grid


def compare_ngrams(
    catalog: DataFrame,
    queries: DataFrame,
    split: str = QUERY_SPLIT,
    out_dir: str | None = None,
    top_k: int = TOP_K,
    num_features: int | None = None,
    ngram_features: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unigram and n-gram top-K and their mean overlap; the locked test split is refused."""
    refuse_test_split(split)
    plain = cut_lineage(featurise(catalog, queries, num_features=num_features).exact(top_k))
    grams = cut_lineage(featurise(catalog, queries, True, ngram_features).exact(top_k))
    overlap = evaluation.pair_overlap(plain, grams)
    if out_dir is not None:
        land(plain, f"{out_dir}/unigram_top_k", None)
        land(grams, f"{out_dir}/ngram_top_k", None)
        write_metrics(overlap, f"{out_dir}/metrics", resume_query_split=split, top_k=top_k)
    return plain, grams, overlap


def cached_embeddings(
    side: DataFrame, path: str | None, encoder_factory: Callable[[], Any], model_name: str,
    max_tokens: int, overlap_tokens: int, batch_size: int, force: bool, keep_undirected: bool = False,
) -> DataFrame:
    """Embeddings of one side; rows of an earlier run are reused when text and settings match.

    The cache is a folder of parts, ``generation=N``. A run adds a part with the documents
    whose text or settings no part has; nothing that was written is written again. With
    ``force`` all documents are encoded into a part that replaces the earlier ones.
    """
    settings = (encoder_factory, model_name, max_tokens, overlap_tokens, batch_size)
    key = embedding.cache_key(model_name, max_tokens, overlap_tokens)
    keyed = side.withColumn("cache_key", key)
    if path is None:
        return cut_lineage(embedding.embed_documents(keyed, *settings, carry=("cache_key",), keep_undirected=keep_undirected))
    last, cache = _cached_parts(side.sparkSession, path)
    restart = cache is None or force
    missing = keyed if restart else embedding.missing_from_cache(side, cache, key)
    if restart or not missing.isEmpty():
        fresh = embedding.embed_documents(missing, *settings, carry=("cache_key",), keep_undirected=keep_undirected)
        fresh.withColumn("restart", F.lit(restart)).write.parquet(f"{path}/generation={last + 1}")
        _, cache = _cached_parts(side.sparkSession, path)
    return cache.join(keyed.select("source_id", "cache_key"), ["source_id", "cache_key"], "left_semi").select(*cache.columns)


def _cached_parts(spark, path: str) -> tuple[int, DataFrame | None]:
    """The number of the last part (-1 if there is none), and the rows since the last restart."""
    from pyspark.errors import AnalysisException

    try:
        parts = spark.read.option("mergeSchema", False).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return -1, None
    # A constant and a folder name: neither reads an embedding.
    seen = parts.agg(F.max("generation").alias("last"), F.max(F.when(F.col("restart"), F.col("generation"))).alias("since")).first()
    rows = parts.filter(F.col("generation") >= F.lit(seen["since"] or 0)).drop("generation", "restart")
    return (-1, None) if seen["last"] is None else (seen["last"], rows)


def compare_dense(
    catalog: DataFrame,
    queries: DataFrame,
    encoder_factory: Callable[[], Any],
    model_name: str,
    out_dir: str | None = None,
    top_k: int = TOP_K,
    max_tokens: int = embedding.MAX_TOKENS,
    overlap_tokens: int = embedding.OVERLAP_TOKENS,
    batch_size: int = embedding.BATCH_SIZE,
    num_features: int | None = None,
    force: bool = False,
    split: str = QUERY_SPLIT,
    keep_undirected: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dense and TF-IDF top-K of the same documents, and a one-row comparison.

    Documents without direction are an error; ``keep_undirected`` keeps them as they are."""
    refuse_test_split(split)

    def embedded(name: str, side: DataFrame) -> DataFrame:
        return cached_embeddings(
            side, out_dir and f"{out_dir}/{name}_embeddings", encoder_factory, model_name,
            max_tokens, overlap_tokens, batch_size, force, keep_undirected,
        )

    job_vectors, query_vectors = embedded("job", catalog), embedded("resume", queries)
    dense = cut_lineage(scoring.dense_top_k(query_vectors, job_vectors, top_k))
    sparse = cut_lineage(featurise(catalog, queries, num_features=num_features).exact(top_k))
    jobs, asked = embedding.embedding_totals(job_vectors), embedding.embedding_totals(query_vectors)
    metrics = evaluation.pair_overlap(dense, sparse).select(
        jobs.select("documents").scalar().alias("job_documents"),
        asked.select("documents").scalar().alias("resume_queries"),
        jobs.select("dimension").scalar().alias("embedding_dimension"),
        jobs.select("chunks").scalar().alias("job_chunks"),
        asked.select("chunks").scalar().alias("resume_chunks"),
        F.round("mean_overlap", METRIC_DECIMALS).alias("mean_overlap"),
    )
    if out_dir is not None:
        land(dense, f"{out_dir}/transformer_top_k", None)
        land(sparse, f"{out_dir}/tfidf_top_k", None)
        write_metrics(metrics, f"{out_dir}/metrics", model_name=model_name, top_k=top_k,
                      max_tokens=max_tokens, overlap_tokens=overlap_tokens)
    return dense, sparse, metrics
