import pytest
from pyspark.sql import functions as F

from pairloom.operators import profile as P, quality as Q


def by_rule(report):
    return {(row.rule, row.column): row for row in report.collect()}


def test_duplicate_rows_counts_beyond_the_first(spark):
    frame = spark.createDataFrame([("job-1",)] * 3 + [("job-2",)], "job_link string")
    assert P.duplicate_rows(frame, ["job_link"]).first()[0] == 2
    assert P.duplicate_rows(frame.limit(0), ["job_link"]).first()[0] == 0
    with pytest.raises(ValueError, match="Missing required columns: other"):
        P.duplicate_rows(frame, ["other"])


def test_category_counts_name_unknown(spark):
    frame = spark.createDataFrame([("full-time",), ("full-time",), (None,)], "job_type string")
    assert [tuple(row) for row in P.category_counts(frame, "job_type", "n").collect()] == [("full-time", 2), ("unknown", 1)]


def test_length_histogram_covers_both_sides(spark, docs):
    jobs, resumes = docs([("j1", "word " * 120)]), docs([("r1", "short text")], "resume")
    rows = {(r.document_type, r.length_bucket): r.document_count for r in P.length_histogram(jobs, resumes).collect()}
    assert rows == {("job", "100-249"): 1, ("resume", "<100"): 1}


def test_table_rules(spark):
    frame = spark.createDataFrame(
        [("a", "t", "x,y,z", "word"), ("a", "q", "", ""), (None, None, None, None)],
        "k string, flag string, list string, text string",
    )
    rules = Q.TableRules(
        required=["k", "gone"], primary_key=["k"], non_null=["k"], allowed={"flag": (["t", "f"], "warning")},
        text_length={"text": (1, "error")}, list_size={"list": (",", 1, 2)},
    )
    found = by_rule(Q.check_table(frame, "d", rules))
    assert found["required_columns", "gone"].failed == 1
    assert found["unique_key", "k"].failed == 1
    assert found["non_null", "k"].failed == 1 and found["non_null", "k"].checked == 3
    assert found["allowed_values", "flag"].failed == 1 and found["allowed_values", "flag"].severity == "warning"
    assert found["text_length", "text"].failed == 1
    assert found["list_size_min", "list"].failed == 1 and found["list_size_max", "list"].failed == 1
    gone = Q.TableRules(primary_key=["k", "lost"], non_null=["lost"], allowed={"lost": (["t"], "warning")})
    broken = by_rule(Q.check_table(frame, "d", gone))
    assert {(r, c): (v.failed, v.passed) for (r, c), v in broken.items()} == {
        ("non_null", "lost"): (3, False), ("allowed_values", "lost"): (3, False), ("unique_key", "k, lost"): (3, False),
    }
    assert not by_rule(Q.check_table(frame.limit(0), "d", gone))["non_null", "lost"].passed
    assert abs(found["non_null", "k"].rate - 2 / 3) < 1e-12 and not found["non_null", "k"].passed


def test_parent_match_counts_rows_of_a_hot_key_once_each(spark):
    child = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("p"))
    parent = spark.createDataFrame([(1,), (1,), (950,)], "p bigint")
    row = Q.check_parent_match(child, parent, "p", "p", "c", 0.9).first()
    assert (row.checked, row.failed, row.passed) == (1000, 99, True)
    assert not Q.check_parent_match(child, parent, "p", "p", "c", 1.0).first().passed


def test_coverage_row_count_and_disjoint_groups(spark):
    frame = spark.createDataFrame([("a", True, "x"), ("b", None, "x"), ("b", False, "y")], "g string, has boolean, split string")
    assert Q.check_coverage(frame, F.col("has"), "d", "has", 0.3).first().passed
    assert Q.check_coverage(frame, F.col("has"), "d", "has", 0.95).first().failed == 2
    assert Q.check_row_count(frame, frame.limit(2), "d").first().failed == 1
    assert Q.check_disjoint_groups(frame, "g", "split", "d").first().failed == 1


def test_only_errors_stop_a_run(spark):
    frame = spark.createDataFrame([("a",), ("a",)], "k string")
    warning = Q.check_table(frame, "d", Q.TableRules(allowed={"k": (["b"], "warning")}))
    assert Q.enforce(warning).count() == 1
    with pytest.raises(ValueError, match=r"d.unique_key\(k\): 1 failed"):
        Q.enforce(Q.quality_report(warning, Q.check_table(frame, "d", Q.TableRules(primary_key=["k"]))))


def test_metrics_of_an_empty_table(spark):
    from pairloom.operators.silver import silver_jobs
    from pairloom.sources.tables import source_schema

    none = {n: spark.createDataFrame([], source_schema(n)) for n in ("linkedin_job_postings", "job_summary", "job_skills")}
    row = P.job_metrics(none["linkedin_job_postings"], silver_jobs(*none.values())).first()
    assert tuple(row) == (0, 0, 0, 0.0, 0.0, 0)


def test_split_shares_and_the_number_of_broken_rules(spark):
    frame = spark.range(100).select(F.when(F.col("id") < 80, "train").otherwise("test").alias("split"))
    found = by_rule(Q.check_split_shares(frame, "split", {"train": 0.7, "test": 0.2, "validation": 0.1}, "d", 0.05, "error"))
    assert {c: v.failed for (_, c), v in found.items()} == {"split=train": 5, "split=test": 0, "split=validation": 5}
    many = Q.TableRules(non_null=[f"c{n}" for n in range(30)])
    with pytest.raises(ValueError, match="30 data quality errors"):
        Q.enforce(Q.check_table(frame, "d", many))
