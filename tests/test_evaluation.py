import pytest
from pyspark.sql import functions as F

from pairloom.operators import evaluation as V, features as FE, lexical as L

PAIRS = "query_id string, document_id string"


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), PAIRS)


def test_recall_of_candidates_and_final_lists(spark):
    exact = pairs(spark, ("r", "a"), ("r", "b"))
    row = V.recall_report(exact, exact.union(exact), pairs(spark, ("r", "a"), ("r", "c"))).first()
    assert tuple(row) == (1.0, 0.5)
    assert tuple(V.recall_report(exact.limit(0), exact, exact).first()) == (0.0, 0.0)


def test_pair_overlap(spark):
    left, right = pairs(spark, ("r", "a"), ("r", "b")), pairs(spark, ("r", "b"), ("r", "c"), ("s", "a"))
    assert V.pair_overlap(left, right).first()[0] == 0.5
    assert V.pair_overlap(left.limit(0), right).first()[0] == 0.0


def test_overlap_matrix_is_per_query_and_refuses_other_queries(spark):
    a, b = pairs(spark, ("q", "1"), ("q", "2"), ("r", "1")), pairs(spark, ("q", "2"), ("q", "3"), ("r", "1"))
    cells = {(r.system_a, r.system_b): r.mean_overlap for r in V.overlap_matrix({"a": a, "b": b}, 2).collect()}
    assert cells == {("a", "a"): 0.75, ("a", "b"): 0.5, ("b", "a"): 0.5, ("b", "b"): 0.75}
    with pytest.raises(Exception, match="different queries"):
        V.overlap_matrix({"a": a, "b": b.filter("query_id = 'q'")}, 2).collect()


def test_method_comparison(spark):
    table = V.method_comparison({"plain": (1, spark.sql("select 1.0D mean_overlap")), "dense": (7.5, spark.sql("select 0.25D mean_overlap"))})
    assert [tuple(r) for r in table.orderBy("measured_seconds").collect()] == [("plain", 1.0, 1.0, 0.0), ("dense", 7.5, 0.25, 0.75)]


def test_thresholds(spark):
    candidates = spark.createDataFrame(
        [("u", "m", 0.61), ("u", "k", 0.55), ("u", "k", 0.97), ("v", "k", 0.7), ("v", "n", 0.7), ("w", "m", 0.99)], PAIRS + ", distance double"
    )
    exact = pairs(spark, ("u", "m"), ("v", "k"), ("w", "m"), ("w", "n"), ("x", "k"))
    rows = {r.distance_threshold: tuple(r)[1:] for r in V.evaluate_thresholds(candidates, exact, (0.55, 0.7, 0.8, 1.0), 1).collect()}
    assert rows == {0.55: (0, 0, 0.0, 0.0), 0.7: (2, 1, 0.2, 0.0), 0.8: (4, 2, 0.4, 0.2), 1.0: (5, 3, 0.6, 0.4)}


def test_best_setting_and_leaderboard(spark):
    grid = spark.createDataFrame(
        [(1, 100, 10, 0.95), (2, 80, 10, 0.91), (3, 10, 9, 0.99), (4, 5, 10, 0.2)],
        "id int, candidate_pairs int, queries_covered int, candidate_recall double",
    )
    assert V.best_setting(grid, 10).first().id == 2
    assert V.best_setting(grid, 99).isEmpty()
    assert [r.id for r in V.leaderboard(grid, 2).collect()] == [3, 1]


def test_labelled_pairs_separate_clear_cases(spark, docs):
    sea, farm = "harbour sails anchor", "orchard tractor barley"
    model = FE.fit_features(docs([("sea", sea), ("farm", farm), ("both", f"{sea} {farm}")]), 4096, 1)
    # One text asked twice and one pair described twice: a score for each described row.
    asked = FE.add_features(model, docs([("ada", sea), ("ada", sea), ("bo", farm)], "resume"))
    described = spark.createDataFrame(
        [(key, "evaluation", key, text, who, label, "train") for key, text, who, label in (
            ("x", sea, "ada", 1), ("x", sea, "ada", 1), ("y", farm, "ada", 0), ("z", farm, "bo", 1), ("z", f"{sea} {farm}", "bo", None), ("w", sea, "nobody", 1),
        )],
        "document_id string, document_type string, source_id string, combined_text string, resume_id string, label int, split string",
    )
    for shuffled in (asked, asked.repartition(3)):
        scores = V.score_labeled_pairs(shuffled, FE.add_features(model, described))
        rows = sorted((r.document_id, round(r.similarity_score, 6)) for r in scores.collect())
        assert rows == [("x", 1.0), ("x", 1.0), ("y", 0.0), ("z", round(2**-0.5, 6)), ("z", 1.0)]
    assert tuple(V.ranking_quality(scores).first()) == (4, 1, 1.0, 1.0)


def test_pair_texts_may_come_in_many_rows(spark, docs):
    vocabulary = L.fit_vocabulary(docs([("a", "alpha beta"), ("b", "alpha gamma beta"), ("c", "gamma delta")]), 1)
    side = lambda *rows: spark.createDataFrame(list(rows), "pair_id string, combined_text string")
    known = spark.createDataFrame([("p",), ("q",), ("none",)], "pair_id string")
    split = V.score_pair_texts(side(("p", "alpha"), ("p", "beta"), ("q", "delta")), side(("p", "beta alpha"), ("q", "gamma")), known, vocabulary, 0)
    rows = {r.pair_id: r.similarity_score for r in split.collect()}
    assert rows == {"p": pytest.approx(1.0), "q": 0.0, "none": 0.0}


def test_ranking_quality_leaves_out_unlabelled_pairs(spark):
    scores = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1), (None, 0.5)], "label int, similarity_score double")
    row = V.ranking_quality(scores).first()
    assert (row.evaluated_pairs, row.unlabelled_pairs, row.roc_auc) == (4, 1, 0.75)
    assert row.pr_auc == pytest.approx(0.5 * 1.0 + 0.5 * (0.5 + 2 / 3) / 2)
