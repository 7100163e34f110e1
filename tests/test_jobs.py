"""The composite jobs on small raw tables, written to disk and read back."""

import json
import pathlib

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import BucketedRandomProjectionLSHModel
from pyspark.sql import functions as F

from pairloom.operators import documents as D, embedding as E
from pairloom.plans import matching, reporting, silver as PS
from pairloom.sources import tables as TB
from verification.encoder import HashingEncoder

TOPICS = ["python spark data", "nursing patient care", "steel welding shop", "tax audit ledger", "garden soil plant"]


@pytest.fixture(scope="module")
def raw_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("raw"))
    topic = F.element_at(F.array(*[F.lit(t) for t in TOPICS]), (F.col("id") % 5 + 1).cast("int"))
    number = F.col("id").cast("string")
    link = F.concat(F.lit("job-"), number)
    rows = spark.range(100)
    fixed = {
        "last_processed_time": "2024-01-21 07:12:29", "got_summary": "t", "got_ner": "t", "is_being_worked": "f",
        "company": "Corp", "job_location": "Boston", "first_seen": "2024-01-14", "search_city": "Boston",
        "search_country": "US", "search_position": "any", "job_level": "Associate", "job_type": "Onsite",
    }
    posts = rows.select(link.alias("job_link"), topic.alias("job_title"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    posts.select(*TB.source_columns("linkedin_job_postings")).write.parquet(f"{folder}/linkedin_job_postings.parquet")
    rows.select(link.alias("job_link"), F.concat_ws(" ", topic, F.concat(F.lit("w"), (F.col("id") % 7).cast("string"))).alias("job_summary")).write.parquet(f"{folder}/job_summary.parquet")
    rows.filter("id < 90").select(link.alias("job_link"), F.replace(topic, F.lit(" "), F.lit(",")).alias("job_skills")).write.parquet(f"{folder}/job_skills.parquet")
    spark.range(60).select(
        F.lit("Role").alias("Role"), F.concat_ws(" ", topic, F.concat(F.lit("person"), number)).alias("Resume"),
        F.when(F.col("id") % 2 == 0, "select").otherwise("reject").alias("Decision"), F.lit("why").alias("Reason_for_decision"),
        F.when(F.col("id") % 2 == 0, topic).otherwise(F.lit("unrelated words only")).alias("Job_Description"),
    ).write.parquet(f"{folder}/resume_screening_train.parquet")
    return folder


@pytest.fixture(scope="module")
def silver(spark, raw_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("silver"))
    jobs, job_metrics = PS.build_silver_jobs(spark, raw_dir, out, files=2)
    resumes, resume_metrics = PS.build_silver_resumes(spark, raw_dir, out)
    return jobs, job_metrics, resumes, resume_metrics, out


def test_registered_sources(spark, raw_dir):
    table = TB.read_source(spark, raw_dir, "job_skills")
    assert table.columns == ["job_link", "job_skills"] and {t for _, t in table.dtypes} == {"string"}
    assert TB.source_schema("resume_screening").names[-1] == "Job_Description"
    with pytest.raises(KeyError, match=r"registered are \[\'job_skills\', \'job_summary\'"):
        TB.source_schema("nope")
    with pytest.raises(FileNotFoundError, match="job_summary"):
        TB.read_source(spark, raw_dir + "/elsewhere", "job_summary")


def test_silver_jobs_are_written_and_measured(spark, silver):
    jobs, metrics, _, _, out = silver
    row = metrics.first()
    assert (row.posting_count, row.silver_count, row.duplicate_job_links, row.eligible_for_ml_count) == (100, 100, 0, 90)
    assert row.summary_coverage == 1.0 and row.skills_coverage == 0.9
    assert spark.read.parquet(f"{out}/jobs").count() == jobs.count() == 100
    assert len(list(pathlib.Path(f"{out}/jobs").glob("*.parquet"))) == 2


def test_silver_sample_is_smaller_and_goes_elsewhere(spark, raw_dir, tmp_path):
    jobs, metrics = PS.build_silver_jobs(spark, raw_dir, str(tmp_path), fraction=0.3)
    assert 10 < jobs.count() < 50 and metrics.first().summary_coverage == 1.0
    assert (tmp_path / "jobs_sample").exists()


def test_silver_resumes_are_written_and_measured(silver):
    _, _, resumes, metrics, _ = silver
    assert tuple(metrics.first()) == (60, 60, 0, 30, 0) and resumes.count() == 60


def test_repeated_keys_stop_the_job(spark, raw_dir, tmp_path):
    for name in ("linkedin_job_postings", "job_summary", "job_skills"):
        table = TB.read_source(spark, raw_dir, name)
        (table.union(table.limit(1)) if name == "job_summary" else table).write.parquet(f"{tmp_path}/{name}.parquet")
    with pytest.raises(ValueError, match="Row count changed from 100 to 101"):
        PS.build_silver_jobs(spark, str(tmp_path))


def test_match_writes_every_output(spark, silver, tmp_path):
    jobs, _, resumes, _, _ = silver
    out = str(tmp_path / "gold")
    ranked, metrics = matching.match(
        jobs, resumes, out, split="all", limit=20, num_features=4096, bucket_length=0.5, distance_threshold=1.3, top_k=4
    )
    row = metrics.first()
    assert (row.job_documents, row.resume_queries, row.matched_resumes, row.recommendation_rows, row.evaluated_pairs) == (100, 20, 20, 80, 20)
    assert row.roc_auc == 1.0
    top = ranked.filter("rank = 1").join(resumes, F.col("query_id") == F.col("resume_id")).join(jobs, F.col("document_id") == F.col("job_link"))
    assert top.filter(~F.startswith("resume_normalized", "job_title_normalized")).isEmpty()
    for name in ("job_features", "resume_features", "top_k_recommendations", "evaluation_scores"):
        assert spark.read.parquet(f"{out}/{name}").count() > 0
    assert len(PipelineModel.load(f"{out}/models/tfidf").stages) == 5
    assert BucketedRandomProjectionLSHModel.load(f"{out}/models/lsh").getNumHashTables() == 3
    (line,) = spark.read.text(f"{out}/metrics").collect()
    record = json.loads(line[0])
    assert list(record) == sorted(record) and record["top_k"] == 4 and record["candidate_pairs"] == row.candidate_pairs


def test_audit_tuning_and_ngram_comparison(silver, tmp_path, spark):
    jobs, _, resumes, _, _ = silver
    catalog, asked, _ = matching.pick_sides(jobs, resumes, "all", 10)
    audit = matching.audit_index(catalog, asked, str(tmp_path / "audit"), 0.5, 5, 1.4, 4, num_features=4096).first()
    assert audit.exhaustive_pairs == 1000 and 0 < audit.final_recall <= audit.candidate_recall <= 1
    grid = matching.tune_index(catalog, asked, str(tmp_path / "grid"), 4, (0.5, 1.0), (2, 4), (1.2, 1.4), num_features=4096)
    assert grid.count() == 8
    back = spark.read.option("header", True).csv(str(tmp_path / "grid" / "results_csv"))
    assert back.columns == grid.columns and back.count() == 8
    # More tables or a wider threshold never lose candidates.
    rows = {(r.bucket_length, r.num_hash_tables, r.distance_threshold): r.candidate_recall for r in grid.collect()}
    assert all(rows[w, 2, d] <= rows[w, 4, d] for w in (0.5, 1.0) for d in (1.2, 1.4))
    plain, grams, overlap = matching.compare_ngrams(catalog, asked, "all", str(tmp_path / "ngrams"), 4, 4096, 8192)
    assert 0 < overlap.first()[0] <= 1 and plain.count() == grams.count() == 40
    with pytest.raises(ValueError, match="stays unseen"):
        matching.compare_ngrams(catalog, asked, "test")


def test_dense_comparison_reuses_and_refreshes_embeddings(spark, silver, tmp_path):
    jobs, _, resumes, _, _ = silver
    catalog, asked, _ = matching.pick_sides(jobs, resumes, "all", 10)
    out = tmp_path / "dense"

    def run(documents):
        return matching.compare_dense(documents, asked, HashingEncoder, "hashing", str(out), 4, 8, 2, num_features=4096)

    dense, _, metrics = run(catalog)
    row = metrics.first()
    assert (row.job_documents, row.resume_queries, row.embedding_dimension) == (100, 10, 64) and 0 <= row.mean_overlap <= 1
    first = sorted(map(tuple, dense.collect()))
    generations = lambda: sorted(p.name for p in (out / "job_embeddings").iterdir() if p.is_dir())
    assert generations() == ["generation=0"]
    assert sorted(map(tuple, run(catalog)[0].collect())) == first and generations() == ["generation=0"]
    changed = catalog.withColumn("combined_text", F.when(F.col("source_id") == "job-3", "all new text").otherwise(F.col("combined_text")))
    assert run(changed)[2].first().job_documents == 100
    assert generations() == ["generation=0", "generation=1"]
    # Only the changed text was written; going back to the old one writes nothing.
    assert spark.read.parquet(f"{out}/job_embeddings/generation=1").select("source_id").collect() == [("job-3",)]
    size = lambda part: sum(f.stat().st_size for f in (out / "job_embeddings" / part).glob("*.parquet"))
    assert size("generation=1") < size("generation=0") / 4
    assert sorted(map(tuple, run(catalog)[0].collect())) == first and len(generations()) == 2
    few = catalog.filter("source_id <> 'job-5'")
    assert run(few)[2].first().job_documents == 99 and len(generations()) == 2
    # A forced run replaces what was there.
    vectors = matching.cached_embeddings(few, str(out / "job_embeddings"), HashingEncoder, "hashing", 8, 2, 32, True)
    assert vectors.count() == 99 == vectors.select("source_id").distinct().count() and len(generations()) == 3
    assert run(catalog)[2].first().job_documents == 100
    assert spark.read.parquet(f"{out}/job_embeddings/generation=3").count() == 1


def test_data_summary(silver, tmp_path, spark):
    jobs, _, resumes, _, _ = silver
    summary = reporting.data_summary(jobs, D.job_documents(jobs), D.resume_documents(resumes), str(tmp_path))
    assert tuple(summary["coverage"].first()) == (100, 1.0, 0.9, 60)
    assert [tuple(r) for r in summary["job_types"].collect()] == [("Onsite", 100)]
    assert spark.read.json(f"{tmp_path}/lengths").count() == 2


def test_source_rules_pass_on_clean_tables(spark, raw_dir):
    from pairloom.operators import quality as Q

    parts = [Q.check_table(TB.read_source(spark, raw_dir, name), name, rules) for name, rules in PS.SOURCE_RULES.items()]
    report = Q.enforce(Q.quality_report(*parts))
    assert report.filter("NOT passed").isEmpty()


def test_a_resume_with_two_roles_asks_two_questions(spark, silver, tmp_path):
    jobs, _, resumes, _, _ = silver
    one = resumes.orderBy("resume_id").limit(1)
    other = one.withColumn("role_normalized", F.lit("zz other role")).withColumn("resume_row", F.lit("second")).select(*resumes.columns)
    both = resumes.unionByName(other).unionByName(one)
    _, plain, _ = matching.pick_sides(jobs, resumes, "all", None)
    _, queries, asked = matching.pick_sides(jobs, both, "all", None)
    assert queries.count() == plain.count() + 1 == queries.select("source_id").distinct().count()
    assert queries.join(plain, ["source_id", "combined_text"], "left_anti").first().combined_text.startswith("zz other role")
    assert asked.count() == both.count() and asked.select("owner").distinct().count() == plain.count()
    owner = one.first().resume_id
    second = asked.filter((F.col("owner") == owner) & (F.col("resume_id") != owner)).first().resume_id
    lists = spark.createDataFrame(
        [(owner, "a", 0.1), (owner, "b", 0.4), (second, "b", 0.2), (second, "c", 0.3)], "query_id string, document_id string, distance double"
    )
    merged = matching.merge_questions(lists, asked, 3).orderBy("rank").collect()
    assert [(r.query_id, r.document_id, r.distance) for r in merged] == [(owner, "a", 0.1), (owner, "b", 0.2), (owner, "c", 0.3)]
    ranked, metrics = matching.match(jobs, both, split="all", num_features=4096, distance_threshold=1.3, top_k=4)
    assert metrics.first().resume_queries == plain.count() and ranked.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 4
