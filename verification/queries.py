"""One query per operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.checks import cut_lineage, write_through
from pairloom.functions import keys, text as T, vectors
from pairloom.operators import (
    documents as D,
    embedding as E,
    evaluation as V,
    features as FE,
    lexical as L,
    lsh,
    profile as P,
    quality as Q,
    review as R,
    scoring as S,
    selection as SE,
    silver as SI,
)
from pairloom.plans import matching, reporting
from verification import tables as X
from verification.encoder import HashingEncoder
from verification.tables import SEED, table

DECIMALS = 6
SPLIT_SHARES = {"train": SI.TRAIN_RATIO, "validation": SI.VALIDATION_RATIO, "test": 1 - SI.TRAIN_RATIO - SI.VALIDATION_RATIO}
REVIEW_QUERIES = 25
# Chunk sizes that cut most test texts into several chunks.
MAX_TOKENS, OVERLAP = 120, 20
ENCODER = partial(HashingEncoder, 64)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# ---------------------------------------------------------------- text and keys


@query
def normalize_text(spark, sf):
    text = T.normalize(F.col("text"))
    return X.documents(spark, sf).select("doc_id", keys.digest(text).alias("digest"), F.length(text).cast("bigint").alias("chars"))


@query
def collapse_spaces(spark, sf):
    text = T.collapse_spaces(F.col("text"))
    return X.documents(spark, sf).select("doc_id", keys.digest(text).alias("digest"), F.length(text).cast("bigint").alias("chars"))


@query
def stable_ids(spark, sf):
    return X.documents(spark, sf).select(
        "doc_id",
        keys.digest(F.col("text")).alias("text_id"),
        keys.digest(T.normalize(F.col("text"))).alias("normal_id"),
        keys.pair_digest(F.col("source"), F.col("lang")).alias("pair_id"),
        keys.seeded_digest(SEED, F.col("source"), F.col("doc_id")).alias("order_key"),
    )


@query
def mask_email_url(spark, sf):
    masked = T.mask_profile_url(T.mask_email(F.col("text")))
    return X.documents(spark, sf).select(
        "doc_id", keys.digest(masked).alias("digest"), T.has_email(F.col("text")).alias("had_email"),
        T.has_email(masked).alias("has_email"),
    )


@query
def mask_phone(spark, sf):
    masked = T.mask_phone(F.col("text"))
    return X.documents(spark, sf).select("doc_id", keys.digest(masked).alias("digest"), (masked != F.col("text")).alias("masked"))


@query
def mask_identifiers(spark, sf):
    masked = T.mask_identifiers(F.col("text"))
    return X.headed_documents(spark, sf).select("doc_id", keys.digest(masked).alias("digest"), (masked != F.col("text")).alias("masked"))


@query
def parse_list(spark, sf):
    items = T.parse_list(F.col("text"))
    return X.documents(spark, sf).select(
        "doc_id", F.size(items).cast("bigint").alias("items"), keys.digest(F.array_join(items, "|")).alias("digest")
    )


@query
def typed_postings(spark, sf):
    return SI.typed_postings(X.postings(spark, sf)).select(
        "job_link",
        F.date_format("last_processed_at", "yyyy-MM-dd HH:mm:ss").alias("last_processed_at"),
        "first_seen_date", "got_summary_flag", "got_ner_flag", "is_being_worked_flag",
        "job_title_normalized", "company_normalized", "job_location_normalized",
    )


@query
def review_excerpts(spark, sf):
    return X.documents(spark, sf).select(
        "doc_id", F.substring("text", 1, R.QUERY_EXCERPT).alias("short"),
        keys.digest(F.substring("text", 1, R.DOCUMENT_EXCERPT)).alias("long_digest"),
    )


# ---------------------------------------------------------------- selection


def _sample(spark, sf, method):
    frames = [
        SE.hash_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", fraction, SEED, method=method)
        .withColumn("fraction", F.lit(fraction))
        for fraction in (0.05, 0.25)
    ]
    return frames[0].unionByName(frames[1])


@query
def hash_sample(spark, sf):
    return _sample(spark, sf, "sha256")


@query
def hash_sample_fast(spark, sf):
    """What holds for any hash: the share, nesting, and that a second run takes the same rows."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    small, again, large = (
        SE.hash_sample(orders, "o_orderkey", fraction, SEED, method="xxhash64").withColumn(name, F.lit(1))
        for name, fraction in (("small", 0.05), ("again", 0.05), ("large", 0.25))
    )
    rows = orders
    for side in (small, again, large):
        rows = rows.join(side, "o_orderkey", "left")
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("rows"),
        (F.abs(F.count("small") / n - 0.05) < 0.02).alias("small_share_holds"),
        (F.abs(F.count("large") / n - 0.25) < 0.03).alias("large_share_holds"),
        (F.count_if(F.col("small").isNotNull() & F.col("large").isNull()) == 0).alias("nested"),
        (F.count_if(F.col("small").isNull() != F.col("again").isNull()) == 0).alias("repeatable"),
    )


def _split(spark, sf, method):
    rows = X.documents(spark, sf).select("doc_id", keys.digest(T.normalize(F.col("text"))).alias("text_id"))
    return SE.group_split(rows, "text_id", SEED, SI.TRAIN_RATIO, SI.VALIDATION_RATIO, method)


@query
def group_split(spark, sf):
    return _split(spark, sf, "sha256")


@query
def group_split_fast(spark, sf):
    """What holds for any hash: every group in one split, and shares near the plan."""
    groups = _split(spark, sf, "xxhash64").groupBy("text_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("split").alias("split"), F.max("split").alias("other")
    )
    share = F.count_if(F.col("split") == "train") / F.count(F.lit(1))
    return groups.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"),
        (F.count_if(F.col("split") != F.col("other")) == 0).alias("groups_whole"),
        (F.count_if(F.col("split").isin(*SE.SPLITS)) == F.count(F.lit(1))).alias("splits_known"),
        (F.abs(share - SI.TRAIN_RATIO) < 0.08).alias("train_share_holds"),
    )


@query
def split_counts(spark, sf):
    return P.category_counts(_split(spark, sf, "sha256"), "split", "rows")


@query
def select_queries(spark, sf):
    return SE.select_queries(_split(spark, sf, "sha256"), "doc_id", "validation", 100).select("doc_id", "split")


@query
def semi_restrict(spark, sf):
    kept = SE.hash_sample(X.postings(spark, sf), "job_link", 0.25, SEED, method="sha256")
    texts, lists = SI.restrict_children(kept, X.summaries(spark, sf), X.skills(spark, sf))
    return texts.select("job_link", F.lit("summary").alias("child")).unionByName(
        lists.select("job_link", F.lit("skills").alias("child"))
    )


@query
def diverse_queries(spark, sf):
    resumes = X.benchmark_resumes(spark, sf)
    return SE.pick_diverse(resumes, "resume_id", "role_normalized", REVIEW_QUERIES, SEED)


# ---------------------------------------------------------------- silver tables


def _silver_jobs(spark, sf):
    return SI.silver_jobs(X.postings(spark, sf), X.summaries(spark, sf), X.skills(spark, sf), 3)


def _silver_resumes(spark, sf):
    return SI.silver_resumes(X.resumes(spark, sf), method="sha256")


@query
def silver_jobs(spark, sf):
    return _silver_jobs(spark, sf).select(
        "job_link", "job_title_normalized",
        keys.digest(F.col("job_summary_normalized")).alias("summary_digest"),
        F.array_join("skills", "|").alias("skills"), F.col("skill_count").cast("bigint").alias("skill_count"),
        "has_summary", "has_skills", "skills_count_warning", "eligible_for_ml",
    )


@query
def silver_resumes(spark, sf):
    return _silver_resumes(spark, sf).select(
        "resume_id", "role_normalized", keys.digest(F.col("resume_normalized")).alias("resume_digest"),
        "label", "job_description_id", "pii_masking_warning", "split",
    )


@query
def catalog_documents(spark, sf):
    docs = D.job_documents(_silver_jobs(spark, sf))
    return docs.withColumn("combined_text", keys.digest(F.col("combined_text")))


@query
def query_documents(spark, sf):
    docs = D.resume_documents(_silver_resumes(spark, sf))
    return docs.withColumn("combined_text", keys.digest(F.col("combined_text")))


@query
def evaluation_documents(spark, sf):
    docs = D.evaluation_documents(_silver_resumes(spark, sf))
    return docs.withColumn("combined_text", keys.digest(F.col("combined_text")))


@query
def job_metrics(spark, sf):
    return P.job_metrics(X.postings(spark, sf), _silver_jobs(spark, sf))


@query
def resume_metrics(spark, sf):
    return P.resume_metrics(X.resumes(spark, sf), _silver_resumes(spark, sf))


# ---------------------------------------------------------------- profile and quality


@query
def duplicate_keys(spark, sf):
    rows = X.documents(spark, sf).select(keys.digest(T.normalize(F.col("text"))).alias("text_id"))
    return P.duplicate_rows(rows, ["text_id"])


@query
def category_counts(spark, sf):
    return P.category_counts(X.postings(spark, sf), "job_type", "job_count")


@query
def top_categories(spark, sf):
    return P.category_counts(table(spark, sf, "documents"), "source", "rows").limit(12)


@query
def length_histogram(spark, sf):
    return P.length_histogram(X.catalog(spark, sf), X.queries(spark, sf))


@query
def quality_rates(spark, sf):
    flags = {"has_summary": "summary_coverage", "has_skills": "skills_coverage"}
    return P.coverage_rates(_silver_jobs(spark, sf), flags, "job_count")


@query
def eda_summary(spark, sf):
    summary = reporting.data_summary(_silver_jobs(spark, sf), X.catalog(spark, sf), X.queries(spark, sf))
    return summary["coverage"]


@query
def quality_report(spark, sf):
    posts, docs = X.postings(spark, sf), X.documents(spark, sf)
    rules = Q.TableRules(
        required=["job_link", "job_type", "salary"],
        primary_key=["job_link"],
        non_null=["job_link", "got_ner", "absent"],
        allowed={"got_ner": (["t", "f"], "error"), "job_type": (["view", "click"], "warning")},
    )
    text_rules = Q.TableRules(
        primary_key=["text"],
        text_length={"text": (200, "warning")},
        list_size={"text": (",", 1, 100)},
    )
    silver = _silver_jobs(spark, sf)
    labels, orders = table(spark, sf, "labels"), table(spark, sf, "orders")
    return Q.quality_report(
        Q.check_table(posts, "postings", rules),
        Q.check_table(docs, "documents", text_rules),
        Q.check_parent_match(labels, docs, "doc_id", "doc_id", "labels"),
        Q.check_parent_match(docs, labels, "doc_id", "doc_id", "documents", 0.95, "warning"),
        Q.check_parent_match(table(spark, sf, "lineitem"), orders, "l_orderkey", "o_orderkey", "lineitem"),
        Q.check_coverage(silver, F.col("has_summary"), "silver", "has_summary", 0.95),
        Q.check_row_count(posts, silver, "silver"),
        Q.check_disjoint_groups(_split(spark, sf, "sha256"), "text_id", "split", "splits"),
        Q.check_split_shares(_split(spark, sf, "sha256"), "split", SPLIT_SHARES, "splits", 0.02),
    )


# ---------------------------------------------------------------- lexical search


@query
def tokens(spark, sf):
    words = T.tokens(F.col("combined_text"))
    return X.catalog(spark, sf).select(
        "source_id", F.size(words).cast("bigint").alias("tokens"), keys.digest(F.array_join(words, " ")).alias("digest")
    )


@query
def ngram_terms(spark, sf):
    return L.with_terms(X.catalog(spark, sf), ngrams=True).select(
        "source_id", F.size("terms").cast("bigint").alias("terms"),
        keys.digest(F.array_join("terms", " ")).alias("digest"),
    )


@query
def document_frequency(spark, sf):
    vocabulary = L.fit_vocabulary(X.catalog(spark, sf))
    return vocabulary.table.select("term", "df", F.round("idf", DECIMALS).alias("idf"))


def _lexical(spark, sf, ngrams=False, top_k=10, **options):
    return L.lexical_top_k(
        X.queries(spark, sf), X.catalog(spark, sf), top_k, ngrams, decimals=DECIMALS, **options
    )


@query
def tfidf_topk(spark, sf):
    return _lexical(spark, sf)


@query
def ngram_tfidf_topk(spark, sf):
    return _lexical(spark, sf, ngrams=True)


@query
def tfidf_topk_filled(spark, sf):
    return _lexical(spark, sf, ngrams=True, top_k=60, fill_zero=True)


# ---------------------------------------------------------------- hashed features and LSH


def _sides(spark, sf, ngrams=False) -> matching.Sides:
    return matching.featurise(X.catalog(spark, sf), X.queries(spark, sf), ngrams)


@query
def tfidf_ml_features(spark, sf):
    rows = FE.sparse_rows(_sides(spark, sf).catalog_features)
    norm = F.aggregate("values", F.lit(0.0), lambda total, v: total + v * v)
    return rows.select("source_id", F.size("indices").alias("terms"), F.round(F.sqrt(norm), 9).alias("norm"))


def _rounded(frame, *names):
    return frame.withColumns({name: F.round(name, DECIMALS) for name in names})


@query
def tfidf_ml_topk(spark, sf):
    return _rounded(_sides(spark, sf).exact(10), "score")


@query
def ngram_ml_topk(spark, sf):
    return _rounded(_sides(spark, sf, ngrams=True).exact(10), "score")


def _indexed(spark, sf):
    sides = _sides(spark, sf)
    index = lsh.fit_index(sides.catalog_features, lsh.discriminating_width(FE.UNIGRAM_FEATURES), 12)
    return sides, (index, sides.query_features, sides.catalog_features)


@query
def lsh_candidates(spark, sf):
    return _rounded(lsh.lsh_candidates(*_indexed(spark, sf)[1], 1.3), "distance")


@query
def lsh_topk(spark, sf):
    return _rounded(lsh.lsh_search(*_indexed(spark, sf)[1], 1.3, 10).ranked, "score", "distance")


@query
def lsh_with_fallback(spark, sf):
    sides, index = _indexed(spark, sf)
    ranked = cut_lineage(lsh.lsh_search(*index, 1.2, 10).ranked)
    return _rounded(
        lsh.with_fallback(ranked, FE.sparse_rows(sides.query_features), FE.sparse_rows(sides.catalog_features), 10), "score"
    )


@query
def lsh_probes(spark, sf):
    sides = _sides(spark, sf)
    index = lsh.fit_index(sides.catalog_features, lsh.discriminating_width(FE.UNIGRAM_FEATURES), 4)
    exact = cut_lineage(sides.exact(10))
    return lsh.probe_report(index, sides.query_features, sides.catalog_features, exact, 1.3)


@query
def lsh_recall(spark, sf):
    return matching.audit_index(X.catalog(spark, sf), X.queries(spark, sf), distance_threshold=1.4)


@query
def lsh_grid(spark, sf):
    return matching.tune_index(X.catalog(spark, sf), X.queries(spark, sf))


# ---------------------------------------------------------------- dense vectors


@query
def dense_topk(spark, sf):
    vectors_ = table(spark, sf, "embeddings")
    stored = vectors_.select(F.col("vec_id").cast("string").alias("source_id"), "embedding")
    return S.dense_top_k(X.centroids(vectors_), stored, 10, DECIMALS)


@query
def chunk_counts(spark, sf):
    return E.chunked(X.catalog(spark, sf), MAX_TOKENS, OVERLAP).select(
        "source_id", F.size("chunks").cast("bigint").alias("chunks"),
        keys.digest(F.array_join("chunks", "|")).alias("digest"),
    )


def _embed(side):
    return E.embed_documents(side, ENCODER, "hashing-64", MAX_TOKENS, OVERLAP, keep_undirected=True)


@query
def chunk_embed_pool(spark, sf):
    embedded = _embed(X.catalog(spark, sf))
    return embedded.select(
        "source_id", F.col("chunk_count").cast("bigint").alias("chunk_count"),
        F.posexplode("embedding").alias("dim", "value"),
    ).select(
        "source_id", "chunk_count", F.col("dim").cast("bigint").alias("dim"),
        F.round(F.col("value").cast("double"), 5).alias("value"),
    )


@query
def embedding_totals(spark, sf):
    return E.embedding_totals(_embed(X.catalog(spark, sf))).select(
        *[F.col(name).cast("bigint").alias(name) for name in ("documents", "chunks", "dimension")]
    )


def _stale_cache(spark, sf):
    """A cache in which labelled documents are current and the others have an old text."""
    labelled = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("source_id"), F.lit(True).alias("current"))
    side = X.catalog(spark, sf).join(labelled, "source_id", "left")
    old = F.when(F.col("current"), F.col("combined_text")).otherwise(F.concat("combined_text", F.lit(" old")))
    key = E.cache_key("hashing-64", MAX_TOKENS, OVERLAP)
    cached = side.withColumn("combined_text", old).withColumn("cache_key", key)
    return X.catalog(spark, sf), cached.withColumn("embedding_model", F.lit("hashing-64")), key


@query
def embedding_cache_delta(spark, sf):
    side, cache, key = _stale_cache(spark, sf)
    return E.missing_from_cache(side, cache, key).select("source_id", "document_type")


@query
def embedding_cache_status(spark, sf):
    side, cache, _ = _stale_cache(spark, sf)
    return E.cache_status(cache, side, "hashing-64")


def _dense_text(spark, sf):
    return S.dense_top_k(_embed(X.queries(spark, sf)), _embed(X.catalog(spark, sf)), 10, DECIMALS)


@query
def dense_text_topk(spark, sf):
    return _dense_text(spark, sf)


@query
def dense_comparison(spark, sf):
    _, _, metrics = matching.compare_dense(
        X.catalog(spark, sf), X.queries(spark, sf), ENCODER, "hashing-64", max_tokens=MAX_TOKENS, overlap_tokens=OVERLAP,
        keep_undirected=True,
    )
    return metrics


@query
def ngram_comparison(spark, sf):
    return matching.compare_ngrams(X.catalog(spark, sf), X.queries(spark, sf))[2]


# ---------------------------------------------------------------- evaluation


def _systems(spark, sf, *names):
    """Top-10 tables of the named systems, or of all three."""
    builders = {
        "tfidf": lambda: _lexical(spark, sf),
        "ngram": lambda: _lexical(spark, sf, ngrams=True),
        "transformer": lambda: _dense_text(spark, sf),
    }
    return {name: cut_lineage(build()) for name, build in builders.items() if not names or name in names}


@query
def overlap_pairs(spark, sf):
    systems = _systems(spark, sf, "tfidf", "ngram")
    return V.pair_overlap(systems["tfidf"], systems["ngram"]).select(F.round("mean_overlap", DECIMALS).alias("mean_overlap"))


@query
def overlap_matrix(spark, sf):
    matrix = V.overlap_matrix(_systems(spark, sf), 10)
    return matrix.withColumn("mean_overlap", F.round("mean_overlap", DECIMALS))


@query
def method_comparison(spark, sf):
    systems = _systems(spark, sf)
    rows = {name: (0.0, V.pair_overlap(systems["tfidf"], top)) for name, top in systems.items()}
    table = V.method_comparison(rows)
    return table.select(
        "method", F.round("overlap_with_baseline", DECIMALS).alias("overlap_with_baseline"),
        F.round("changed_vs_baseline", DECIMALS).alias("changed_vs_baseline"),
    )


@query
def recall_metrics(spark, sf):
    exact = cut_lineage(_lexical(spark, sf))
    wide = cut_lineage(_lexical(spark, sf, ngrams=True, top_k=20))
    report = V.recall_report(exact, wide, wide.filter(F.col("rank") <= 10))
    return report.select(*[F.round(name, DECIMALS).alias(name) for name in report.columns])


THRESHOLDS = (1.1, 1.2, 1.3, 1.4)


def _threshold_grid(spark, sf):
    catalog, asked = X.catalog(spark, sf), X.queries(spark, sf)
    grams = L.sparse_scores(asked, catalog, L.fit_vocabulary(catalog, ngrams=True), DECIMALS)
    distance = F.round(vectors.cosine_to_distance(F.col("score")), DECIMALS)
    near = grams.select("query_id", "document_id", distance.alias("distance")).filter(F.col("distance") < max(THRESHOLDS))
    grid = V.evaluate_thresholds(write_through(near, drop_shuffles=True), cut_lineage(_lexical(spark, sf)), THRESHOLDS, 10)
    return grid.select(
        "distance_threshold", "candidate_pairs", "queries_covered",
        F.round("candidate_recall", DECIMALS).alias("candidate_recall"),
        F.round("final_recall", DECIMALS).alias("final_recall"),
    )


@query
def threshold_evaluation(spark, sf):
    return _threshold_grid(spark, sf)


@query
def best_setting(spark, sf):
    grid = cut_lineage(_threshold_grid(spark, sf))
    covered = X.queries(spark, sf).count()
    return V.best_setting(grid, covered, 0.5, ("distance_threshold",))


@query
def leaderboard(spark, sf):
    return V.leaderboard(_threshold_grid(spark, sf), 3, ("distance_threshold",))


def _pair_scores(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("pair_id", F.col("conv_id").cast("string"))
    pairs = turns.groupBy("pair_id").agg(F.max((F.col("role") == "system").cast("int")).alias("label"))

    def side(role):
        return turns.filter(F.col("role") == role).select("pair_id", F.col("text").alias("combined_text"))

    vocabulary = L.fit_vocabulary(X.catalog(spark, sf))
    scored = V.score_pair_texts(side("user"), side("assistant"), pairs, vocabulary)
    return scored.withColumn("similarity_score", F.round("similarity_score", DECIMALS))


@query
def pair_scores(spark, sf):
    return _pair_scores(spark, sf)


@query
def roc_pr_auc(spark, sf):
    quality = V.ranking_quality(cut_lineage(_pair_scores(spark, sf)))
    return quality.withColumns({name: F.round(name, DECIMALS) for name in ("roc_auc", "pr_auc")})


@query
def labeled_pairs_ml(spark, sf):
    resumes = cut_lineage(_silver_resumes(spark, sf))
    model = FE.fit_features(X.catalog(spark, sf))
    asked = FE.add_features(model, D.resume_documents(resumes))
    return _rounded(V.score_labeled_pairs(asked, FE.add_features(model, D.evaluation_documents(resumes))), "similarity_score")


@query
def match_end_to_end(spark, sf):
    jobs = _silver_jobs(spark, sf)
    ranked, _ = matching.match(jobs, _silver_resumes(spark, sf), distance_threshold=1.4)
    return _rounded(ranked, "score", "distance")


@query
def title_overlap(spark, sf):
    score = R.title_overlap(T.tokens(T.normalize(F.col("p_name"))), T.tokens(F.concat_ws(" ", "p_type", "p_name")))
    return table(spark, sf, "part").select("p_partkey", F.round(score, DECIMALS).alias("overlap"))


# ---------------------------------------------------------------- review


@query
def review_pool(spark, sf):
    return R.pool_systems(_systems(spark, sf))


def _packet(spark, sf):
    return reporting.review_packet(
        _systems(spark, sf), X.benchmark_resumes(spark, sf), X.document_postings(spark, sf),
        X.summaries(spark, sf), query_count=REVIEW_QUERIES, seed=SEED,
    )


@query
def review_sheet(spark, sf):
    return _packet(spark, sf)[0]


@query
def answer_key(spark, sf):
    return _packet(spark, sf)[1]


def _filled_sheets(sheet):
    """Three reviewers' answers, derived from the row ids; some rows cannot be judged."""

    def rating(reviewer, name):
        bucket = keys.hash_bucket(F.concat_ws("|", "review_id", F.lit(name)), reviewer, 5, "sha256")
        return (bucket + 1).cast("string")

    return [
        sheet.select(
            "review_id",
            *[rating(reviewer, name).alias(name) for name in R.RATINGS],
            F.when(keys.hash_bucket(F.col("review_id"), reviewer, 7, "sha256") == 0, "1").otherwise("0").alias("cannot_judge"),
        )
        for reviewer in (1, 2, 3)
    ]


@query
def reviewer_merge(spark, sf):
    merged = R.merge_reviews(_filled_sheets(_packet(spark, sf)[0]))
    return merged.select(
        "review_id", "judgements",
        *[F.round(f"mean_{name}", DECIMALS).alias(f"mean_{name}") for name in R.RATINGS],
        *[f"spread_{name}" for name in R.RATINGS], "disagreement",
    )


@query
def sheet_check(spark, sf):
    """Rows without a role rating, with a rating of 9, and rows that were never issued."""
    sheet = _packet(spark, sf)[0]
    filled = _filled_sheets(sheet)[0]
    bucket = keys.hash_bucket(F.col("review_id"), 9, 5, "sha256")
    broken = filled.withColumn(
        "role_relevance_1_to_5", F.when(bucket == 0, "").when(bucket == 1, "9").otherwise(F.col("role_relevance_1_to_5"))
    ).withColumn("review_id", F.when(bucket == 2, F.concat("review_id", F.lit("-x"))).otherwise(F.col("review_id")))
    return R.check_sheet(broken, sheet)


@query
def relevance_at_k(spark, sf):
    sheet, key = _packet(spark, sf)
    merged = R.merge_reviews(_filled_sheets(sheet))
    report = R.relevance_at_k(merged, key, ["tfidf", "ngram", "transformer"], 10)
    return report.withColumn("relevance_at_k", F.round("relevance_at_k", DECIMALS))
