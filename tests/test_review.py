import pytest
from pyspark.sql import functions as F

from pairloom.operators import review as R
from pairloom.plans import reporting


def top(spark, *rows):
    return spark.createDataFrame([(q, r, d, s) for q, d, r, s in rows], "query_id string, rank int, document_id string, score double")


@pytest.fixture(scope="module")
def systems(spark):
    return {
        "tfidf": top(spark, ("r1", "j1", 1, 0.8), ("r1", "j2", 2, 0.7)),
        "ngram": top(spark, ("r1", "j2", 1, 0.75), ("r1", "j4", 2, 0.65)),
        "transformer": top(spark, ("r1", "j3", 1, 0.9), ("r1", "j1", 2, 0.6)),
    }


@pytest.fixture(scope="module")
def packet(spark, systems, tmp_path_factory):
    resumes = spark.createDataFrame([("r1", "engineer", "python " * 400), ("r2", "nurse", "care")], "resume_id string, role_normalized string, resume_normalized string")
    names = ["job_link", "job_title", "company", "job_location", "job_level", "job_type"]
    postings = spark.createDataFrame([(f"j{n}", f"title, \"{n}\"", None, "x", "y", "z") for n in range(1, 10)], ", ".join(f"{n} string" for n in names))
    summaries = spark.createDataFrame([("j1", "s" * 2000), ("j9", "unused")], "job_link string, job_summary string")
    folder = str(tmp_path_factory.mktemp("packet"))
    return (*reporting.review_packet(systems, resumes, postings, summaries, folder, query_count=5), folder)


def test_pool_keeps_rank_and_score_of_every_system(spark, systems):
    rows = {r.document_id: r for r in R.pool_systems(systems).collect()}
    assert set(rows) == {"j1", "j2", "j3", "j4"}
    assert (rows["j1"].tfidf_rank, rows["j1"].ngram_rank, rows["j1"].transformer_score) == (1, None, 0.6)
    assert [r[0] for r in R.shared_queries(systems).collect()] == ["r1"]


def test_sheet_is_blind_and_key_knows(packet):
    sheet, key, _ = packet
    assert sheet.columns == R.REVIEW_FIELDS
    rows = {r.review_id: r for r in sheet.collect()}
    answers = {r.job_link: r for r in key.collect()}
    assert set(rows) == {f"Q001-C0{n}" for n in range(1, 5)} == {r.review_id for r in answers.values()}
    assert answers["j1"].in_tfidf and answers["j1"].in_transformer and not answers["j1"].in_ngram
    first = rows[answers["j1"].review_id]
    assert first.job_title == 'title, "1"' and first.company == "" and len(first.job_summary_excerpt) == 1600
    assert first.resume_role == "engineer" and len(first.resume_excerpt) == 1200
    assert all(getattr(r, name) == "" for r in rows.values() for name in R.ANSWERS)


def test_packet_files_read_back(spark, packet):
    sheet, _, folder = packet
    back = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/review_sheet")
    assert back.columns == R.REVIEW_FIELDS
    assert [r.job_title for r in back.orderBy("review_id").collect()] == [r.job_title for r in sheet.orderBy("review_id").collect()]


def filled(spark, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"{n} string" for n in ["review_id", *R.RATINGS, "cannot_judge"]))


def test_returned_sheets_are_checked(spark):
    issued = filled(spark, *[(f"c{n}", "", "", "", "", "") for n in range(4)])
    good = filled(spark, ("c0", "1", "2", "3", "4", ""), ("c1", "", "", "", "", "1"), ("c2", "5", "5", "5", "5", "0"), ("c3", "1", "1", "1", "1", None))
    assert R.check_sheet(good, issued).isEmpty()
    bad = filled(spark, ("c0", "6", "", "3", "4", "0"), ("c1", "1", "1", "1", "1", "x"), ("c2", "1", "1", "1", "1", "0"), ("c2", "1", "1", "1", "1", "0"), ("new", "1", "1", "1", "1", "0"))
    problems = sorted(tuple(r) for r in R.check_sheet(bad, issued).collect())
    assert problems == [
        ("c0", "role_relevance_1_to_5 not in 1-5"), ("c0", "skills_alignment_1_to_5 missing"), ("c1", "cannot_judge not 0 or 1"),
        ("c2", "row repeated"), ("c3", "row missing"), ("new", "row not issued"),
    ]


def test_reviews_merge_into_means_and_disagreement(spark):
    one = filled(spark, ("c0", "1", "2", "3", "4", "0"), ("c1", "5", "5", "5", "5", "0"))
    two = filled(spark, ("c0", "2", "2", "3", "2", "0"), ("c1", "1", "1", "1", "1", "1"))
    rows = {r.review_id: r for r in R.merge_reviews([one, two]).collect()}
    assert (rows["c0"].judgements, rows["c0"].mean_overall_relevance_1_to_5, rows["c0"].spread_overall_relevance_1_to_5) == (2, 3.0, 2)
    assert rows["c0"].disagreement and not rows["c1"].disagreement and rows["c1"].judgements == 1


def test_relevance_and_wins(spark, systems, packet):
    _, key, _ = packet
    rating = F.when(F.col("job_link") == "j1", 5.0).when(F.col("job_link") == "j2", 3.0).otherwise(1.0)
    merged = key.select("review_id", rating.alias("mean_overall_relevance_1_to_5"))
    rows = {r.system: (r.queries, r.relevance_at_k, r.wins) for r in R.relevance_at_k(merged, key, list(systems), 2).collect()}
    assert rows == {"tfidf": (1, 4.0, 1), "ngram": (1, 2.0, 0), "transformer": (1, 3.0, 0)}


def test_title_overlap(spark):
    frame = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "l array<string>, r array<string>")
    assert [r[0] for r in frame.select(R.title_overlap(F.col("l"), F.col("r"))).collect()] == [pytest.approx(1 / 3), 0.0]


def test_texts_do_not_move_to_meet_the_few_pooled_documents(spark, systems):
    """The pool is a few thousand ids; they go to the texts, whatever Spark thinks of their size."""
    texts = spark.createDataFrame([(f"j{n}", "text") for n in range(9)], "job_link string, job_summary string")
    postings = spark.createDataFrame([(f"j{n}", *["x"] * 5) for n in range(9)], "job_link string, " + ", ".join(f"{n} string" for n in R.JOB_FIELDS[:-1]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = R.document_metadata(postings, texts, systems)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("BroadcastHashJoin [job_link") == 2
