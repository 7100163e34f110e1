import math
import random
from collections import Counter

import pytest
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import functions as F

from pairloom.operators import features as FE, lexical as L, lsh, scoring as S

WORDS = [f"term{n}" for n in range(60)] + ["common"] * 20


def corpus(size, seed, length=25):
    """Random texts with one very common word; the last ones are copies of the first."""
    pick = random.Random(seed)
    rows = [(f"k{n:03d}", " ".join(pick.choice(WORDS) for _ in range(pick.randint(1, length)))) for n in range(size)]
    return rows + [(f"z{n:03d}", rows[0][1]) for n in range(size // 2)]


def brute(queries, catalog, k, min_df=2, ngrams=False, decimals=6):
    def terms(text):
        words = text.split()
        return ["u_" + w for w in words] + [f"b_{a}_{b}" for a, b in zip(words, words[1:])] if ngrams else words

    df = Counter(t for _, text in catalog for t in set(terms(text)))
    idf = {t: math.log((len(catalog) + 1) / (n + 1)) for t, n in df.items() if n >= min_df}

    def unit(text):
        weights = {t: n * idf[t] for t, n in Counter(terms(text)).items() if t in idf}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()} if norm else {}

    vectors = [(key, unit(text)) for key, text in catalog]
    result = []
    for query, text in queries:
        mine = unit(text)
        scored = [
            (round(sum(w * other[t] for t, w in mine.items() if t in other), decimals), key)
            for key, other in vectors if any(t in other for t in mine)
        ]
        best = sorted(scored, key=lambda pair: (-pair[0], pair[1]))[:k]
        result += [(query, rank, key, score) for rank, (score, key) in enumerate(best, 1)]
    return sorted(result)


def found(frame):
    return sorted((r.query_id, r.rank, r.document_id, round(r.score, 6)) for r in frame.collect())


@pytest.fixture(scope="module")
def texts():
    return corpus(8, 1), corpus(60, 2)


@pytest.mark.parametrize("ngrams", [False, True])
@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_lexical_top_k_equals_brute_force(docs, texts, ngrams, broadcast_rows, monkeypatch):
    # With nothing broadcast, small query groups and few heavy terms force every skew path.
    monkeypatch.setattr(L, "QUERY_GROUP_ROWS", 30)
    monkeypatch.setattr(L, "HEAVY_TERMS", 30)
    queries, catalog = texts
    top = L.lexical_top_k(docs(queries), docs(catalog), 5, ngrams, decimals=6, broadcast_rows=broadcast_rows)
    assert found(top) == brute(queries, catalog, 5, ngrams=ngrams)


def test_postings_count_terms_inside_the_row(docs):
    rows = L.postings(docs([("a", "spark Spark the python spark"), ("b", "the of"), ("c", "")])).collect()
    assert sorted((r.source_id, r.term, r.tf) for r in rows) == [("a", "python", 1), ("a", "spark", 3)]


def test_vocabulary_counts_documents_without_terms(docs):
    vocabulary = L.fit_vocabulary(docs([("a", "spark python"), ("b", "spark"), ("c", "the")]))
    (row,) = vocabulary.table.collect()
    assert (row.term, row.df, vocabulary.documents, vocabulary.terms) == ("spark", 2, 3, 1)
    assert row.idf == pytest.approx(math.log(4 / 3))


def test_bigrams_join_neighbours(docs):
    terms = L.with_terms(docs([("a", "Machine learning engineer"), ("b", "solo"), ("c", "the")]), True)
    rows = {r.source_id: r.terms for r in terms.collect()}
    assert rows["a"] == ["u_machine", "u_learning", "u_engineer", "b_machine_learning", "b_learning_engineer"]
    assert rows["b"] == ["u_solo"] and rows["c"] == []


def test_fill_with_zeros_uses_lowest_free_ids(docs):
    catalog = docs([("c", "spark"), ("a", "spark"), ("b", "nurse"), ("d", "nurse")])
    top = L.lexical_top_k(docs([("q", "spark"), ("r", "unknown")]), catalog, 3, decimals=6, fill_zero=True)
    ids = {}
    for row in sorted(top.collect(), key=lambda r: (r.query_id, r.rank)):
        ids.setdefault(row.query_id, []).append((row.document_id, row.score))
    assert ids["q"] == [("a", 1.0), ("c", 1.0), ("b", 0.0)]
    assert ids["r"] == [("a", 0.0), ("b", 0.0), ("c", 0.0)]


@pytest.mark.parametrize("limit", ["1000", "2"])
def test_large_k_is_ranked_in_parts(spark, limit):
    scores = spark.range(4000).select(
        F.lit("q").alias("query_id"), F.col("id").cast("string").alias("document_id"), (F.col("id") % 7).cast("double").alias("score")
    )
    expected = sorted(((n % 7, str(n)) for n in range(4000)), key=lambda p: (-p[0], p[1]))[:5]
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", limit)
    try:
        rows = L.rank_top_k(scores, 5).orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert [(r.score, r.document_id) for r in rows] == expected


def test_integer_ids_and_empty_results(spark):
    frame = lambda rows: spark.createDataFrame(rows, "source_id bigint, embedding array<double>")
    catalog = frame([(n, [1.0, float(n)]) for n in range(9)]).repartition(16)
    top = S.dense_top_k(frame([(1, [0.0, 1.0])]), catalog, 2)
    assert [(r.query_id, r.document_id) for r in top.orderBy("rank").collect()] == [(1, 8), (1, 7)]
    assert S.dense_top_k(frame([(1, [0.0, 1.0])]), catalog.limit(0), 2).count() == 0


def vectors(spark, rows):
    return FE.sparse_rows(spark.createDataFrame(rows, ["source_id", "features"]))


def test_sparse_search_ranks_unit_vectors(spark):
    jobs = vectors(spark, [("job-b", Vectors.sparse(3, {1: 1.0})), ("job-a", Vectors.dense([1.0, 0, 0])), ("job-0", Vectors.sparse(3, {}))])
    resumes = vectors(spark, [("resume-1", Vectors.sparse(3, {0: 1.0})), ("resume-0", Vectors.sparse(3, {}))])
    filled = S.sparse_top_k(resumes, jobs, 2, fill_zero=True).orderBy("rank").collect()
    assert [(r.query_id, r.document_id, r.score) for r in filled] == [("resume-1", "job-a", 1.0), ("resume-1", "job-b", 0.0)]
    assert [r.document_id for r in S.sparse_top_k(resumes, jobs, 2).collect()] == ["job-a"]
    with pytest.raises(ValueError, match="top_k"):
        S.sparse_top_k(resumes, jobs, 0)


@pytest.mark.parametrize("ngrams", [False, True])
def test_hashed_features_agree_with_exact_terms(docs, texts, ngrams):
    # Enough buckets that no two of the few terms share one.
    size = 1 << 22
    queries, catalog = texts
    model, features = FE.fit_and_add_features(docs(catalog), size, ngrams=ngrams)
    asked = FE.add_features(model, docs(queries))
    top = S.sparse_top_k(FE.sparse_rows(asked), FE.sparse_rows(features), 5, decimals=6, max_rows=3)
    assert found(top) == brute(queries, catalog, 5, ngrams=ngrams)
    plain = FE.add_features(FE.fit_features(docs(catalog), size, ngrams=ngrams), docs(catalog)).select("source_id", "features")
    both = plain.join(features.select("source_id", F.col("features").alias("other")), "source_id").collect()
    assert len(both) == len(catalog) and all(row.features == row.other for row in both)


def test_features_skip_rows_without_text(spark, docs):
    model = FE.fit_features(docs([("a", "spark"), ("b", "spark"), ("c", None)]), 1024)
    assert FE.add_features(model, docs([("q", None), ("r", "spark")])).count() == 1


def test_model_survives_a_save(docs, tmp_path):
    from pyspark.ml import PipelineModel

    from pairloom.sources.tables import save_model

    model, features = FE.fit_and_add_features(docs([("a", "spark ml"), ("b", "spark ml")]), 1024, ngrams=True)
    save_model(model, tmp_path / "m")
    save_model(model, tmp_path / "m")
    again = FE.add_features(PipelineModel.load(str(tmp_path / "m")), docs([("a", "spark ml")]))
    assert again.first().features == features.filter("source_id = 'a'").first().features


def test_a_third_of_the_catalog_may_be_one_text(docs):
    """Ties of many copies are cut by id, and every query keeps its K rows."""
    catalog = [(f"d{n:04d}", "alpha beta gamma") for n in range(700)] + [(f"e{n:04d}", f"alpha w{n % 50}") for n in range(700)]
    top = L.lexical_top_k(docs([("q", "alpha beta")]), docs(catalog), 4, decimals=6).orderBy("rank").collect()
    assert [row.document_id for row in top] == ["d0000", "d0001", "d0002", "d0003"]


def dense(spark, rows):
    return spark.createDataFrame(rows, "source_id string, embedding array<double>")


def test_dense_search_orders_by_cosine(spark):
    jobs = dense(spark, [("job-b", [0.0, 1.0]), ("job-a", [1.0, 0.0]), ("job-n", None)])
    top = S.dense_top_k(dense(spark, [("r", [1.0, 0.0])]), jobs, 2).orderBy("rank").collect()
    assert [(r.document_id, r.score) for r in top] == [("job-a", 1.0), ("job-b", 0.0)]
    with pytest.raises(Exception, match="embed both sides"):
        S.dense_top_k(dense(spark, [("r", [1.0])]), jobs, 2).collect()
    assert S.dense_top_k(dense(spark, []), jobs, 2).count() == 0


def test_dense_search_over_blocks_equals_numpy(spark):
    import numpy as np

    source = np.random.default_rng(3)
    catalog, asked = source.normal(size=(300, 8)), source.normal(size=(40, 8))
    frame = lambda m, p: dense(spark, [(f"{p}{n:03d}", row.tolist()) for n, row in enumerate(m)])
    top = S.dense_top_k(frame(asked, "q"), frame(catalog, "d").repartition(7), 6, max_rows=9)
    # Several passes, and nothing of the catalog moves but its repartition above and the results.
    assert top._jdf.queryExecution().executedPlan().toString().count("MapInArrow") > 2
    best = np.argsort(-(asked @ catalog.T), axis=1)[:, :6]
    expected = {(f"q{q:03d}", rank + 1, f"d{d:03d}") for q, row in enumerate(best) for rank, d in enumerate(row)}
    assert {(r.query_id, r.rank, r.document_id) for r in top.collect()} == expected


def test_postings_of_heavy_terms_stay_where_they_are(docs, spark, monkeypatch):
    monkeypatch.setattr(L, "HEAVY_TERMS", 4)
    catalog = docs([(f"k{n}", f"oak oak elm rare{n // 2}") for n in range(8)])
    vocabulary = L.fit_vocabulary(catalog, 1)
    rows = L.postings(catalog)
    whole = L.attach_terms(rows, vocabulary.table, vocabulary, "source_id")
    parted = L.attach_terms(rows, vocabulary.table, vocabulary, "source_id", broadcast_rows=0)
    assert sorted(map(tuple, parted.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    # Two of three postings have a heavy term: one branch of the union without a shuffle.
    plan = parted._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "spread" not in plan.toString()


# ---------------------------------------------------------------- LSH


@pytest.fixture(scope="module")
def hashed(docs, texts):
    queries, catalog = texts
    model, features = FE.fit_and_add_features(docs(catalog), 4096)
    return FE.add_features(model, docs(queries)), features


@pytest.mark.parametrize("bounds", [{}, {"heavy": 3}])
def test_candidates_equal_the_native_similarity_join(hashed, bounds):
    asked, features = hashed
    model = lsh.fit_index(features, lsh.discriminating_width(4096), 4)
    native = model.approxSimilarityJoin(asked, features, 1.38, "d").select("datasetA.source_id", "datasetB.source_id", "d")
    expected = sorted((q, d, round(x, 9)) for q, d, x in native.collect())
    mine = lsh.lsh_candidates(model, asked, features, 1.38, **bounds).collect()
    assert sorted((r.query_id, r.document_id, round(r.distance, 9)) for r in mine) == expected
    everything = asked.count() * features.count()
    assert 0 < len(expected) < everything


def test_rerank_turns_distance_into_cosine(spark):
    pairs = spark.createDataFrame(
        [("r", "b", 1.0), ("r", "a", 1.0), ("r", "c", 0.0), ("r", "far", 3.0)], "query_id string, document_id string, distance double"
    )
    rows = lsh.rerank(pairs, 4).orderBy("rank").collect()
    assert [(r.document_id, r.score) for r in rows] == [("c", 1.0), ("a", 0.5), ("b", 0.5), ("far", -1.0)]
    assert [r.document_id for r in lsh.rerank(pairs, 1).collect()] == ["c"]


def test_index_finds_the_match(docs):
    catalog = docs([("boat", "harbour sails rigging anchor tides"), ("farm", "orchard tractor barley harvest"), ("mine", "shaft ore drill lamp")])
    model, features = FE.fit_and_add_features(catalog, 1024, 1)
    asked = FE.add_features(model, docs([("q", "barley and a late harvest by tractor")], "resume"))
    index = lsh.fit_index(features, 2.0, 3)
    row = lsh.rerank(lsh.lsh_candidates(index, asked, features, 1.3), 1).first()
    assert (row.document_id, row.rank) == ("farm", 1) and row.score > 0.7


def test_grid_equals_one_fit_per_setting(hashed):
    from pairloom.checks import cut_lineage

    asked, features = hashed
    widths, counts, thresholds, k = (0.01, 0.015, 0.04), (2, 5), (1.3, 1.38), 3
    exact = cut_lineage(S.sparse_top_k(FE.sparse_rows(asked), FE.sparse_rows(features), k))
    truth = {(r.query_id, r.document_id) for r in exact.collect()}
    pairs = cut_lineage(lsh.grid_candidates(asked, features, widths, 5, 1.38))
    grid = lsh.evaluate_grid(pairs, exact, k, widths, counts, thresholds).collect()
    assert len(grid) == 12
    for row in grid:
        index = lsh.fit_index(features, row.bucket_length, row.num_hash_tables)
        alone = lsh.lsh_candidates(index, asked, features, row.distance_threshold).collect()
        best = {}
        for q, d, x in sorted(alone, key=lambda r: (r.query_id, r.distance, r.document_id)):
            best.setdefault(q, []).append(d)
        assert row.candidate_pairs == len(alone) and row.queries_covered == len(best)
        hits = sum((r.query_id, r.document_id) in truth for r in alone)
        final = sum((q, d) in truth for q, ds in best.items() for d in ds[:k])
        assert row.candidate_recall == pytest.approx(hits / len(truth), abs=1e-6)
        assert row.final_recall == pytest.approx(final / len(truth), abs=1e-6)


@F.udf(VectorUDT())
def _without_weights(vector):
    return SparseVector(vector.size, vector.indices, [0.0] * len(vector.indices))


@pytest.mark.parametrize("bounds", [{}, {"heavy": 3}])
def test_search_equals_the_rerank_of_all_candidates(hashed, bounds):
    asked, features = hashed
    model = lsh.fit_index(features, lsh.discriminating_width(4096), 4)
    pairs = lsh.lsh_candidates(model, asked, features, 1.38)
    expected = {(r.query_id, r.rank, r.document_id) for r in lsh.rerank(pairs, 3).collect()}
    found = lsh.lsh_search(model, asked, features, 1.38, 3, **bounds)
    assert {(r.query_id, r.rank, r.document_id) for r in found.ranked.collect()} == expected
    sizes = {r.query_id: r.candidates for r in found.counts.collect()}
    assert sizes == {r.query_id: r["count"] for r in pairs.groupBy("query_id").count().collect()}
    # Vectors meet in buckets: nothing after the blocks is joined, and no block hands on its pairs.
    assert found.ranked._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_search_cuts_many_queries_and_keeps_ties_by_id(hashed, monkeypatch):
    asked, features = hashed
    model = lsh.fit_index(features, 0.8, 2)
    whole = lsh.lsh_search(model, asked, features, 1.4, 2).ranked.collect()
    monkeypatch.setattr(lsh, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(lsh, "BLOCK_PAIRS", 5)
    cut = lsh.lsh_search(model, asked, features, 1.4, 2, heavy=7).ranked.collect()
    assert sorted(cut) == sorted(whole)
    import numpy as np

    nearest = lsh.Nearest(2)
    nearest.add(np.array([0, 0, 0, 1]), np.array(["c", "a", "b", "z"], object), np.array([0.5, 0.5, 0.5, 0.1]))
    assert [x.tolist() for x in nearest.rows()] == [[0, 0, 1], ["a", "b", "z"], [0.5, 0.5, 0.1]]


@pytest.mark.parametrize("probes", [0, 3])
def test_every_way_to_meet_gives_the_same_pairs(hashed, monkeypatch, probes):
    """One block, several passes and the bucket join, with ids that come again."""
    asked, features = hashed
    again = features.limit(3)
    features = features.unionByName(again).unionByName(again.withColumn("features", _without_weights("features")))
    model = lsh.fit_index(features, lsh.discriminating_width(4096), 4)
    ways = []
    for queries, crowded in ((4096, 8), (4, 10**9), (4, 0)):
        monkeypatch.setattr(lsh, "BLOCK_QUERIES", queries)
        monkeypatch.setattr(lsh, "CROWDED", crowded)
        monkeypatch.setattr(lsh, "BLOCK_PAIRS", 20)
        found = lsh.lsh_search(model, asked, features, 1.41, 3, probes=probes)
        ways.append((sorted(map(tuple, found.ranked.withColumn("distance", F.round("distance", 9)).drop("score").collect())), sorted(map(tuple, found.counts.collect()))))
    assert ways[0] == ways[1] == ways[2] and len(ways[0][0]) > 3


def test_no_vector_moves_to_one_block_of_queries(hashed):
    asked, features = hashed
    model = lsh.fit_index(features, lsh.discriminating_width(4096), 4)
    plan = lsh.lsh_candidates(model, asked, features, 1.38)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_audit_equals_the_grid_over_all_candidates(hashed):
    from pairloom.checks import cut_lineage

    asked, features = hashed
    # Two rows without direction: they are near every query, and no exact pair.
    odd = features.limit(2).select("document_id", "document_type", F.concat(F.lit("0-"), "source_id").alias("source_id"), _without_weights("features").alias("features"))
    features = features.unionByName(odd)
    widths, counts, thresholds, k = (0.01, 0.015, 0.04, 0.8), (2, 5), (1.3, 1.38), 3
    exact = cut_lineage(S.sparse_top_k(FE.sparse_rows(asked), FE.sparse_rows(features), k))
    pairs = cut_lineage(lsh.grid_candidates(asked, features, widths, 5, 1.38))
    expected = sorted(map(tuple, lsh.evaluate_grid(pairs, exact, k, widths, counts, thresholds).collect()))
    assert sorted(map(tuple, lsh.audit_grid(asked, features, exact, k, widths, counts, thresholds).collect())) == expected
    assert sorted(map(tuple, lsh.audit_grid(asked, features, exact, k, widths, counts, thresholds, max_rows=5).collect())) == expected


def test_found_pairs_are_those_of_the_candidates(hashed):
    asked, features = hashed
    exact = S.sparse_top_k(FE.sparse_rows(asked), FE.sparse_rows(features), 5)
    model = lsh.fit_index(features, lsh.discriminating_width(4096), 3)
    candidates = lsh.lsh_candidates(model, asked, features, 1.35)
    expected = {(r.query_id, r.document_id) for r in exact.join(candidates, ["query_id", "document_id"], "left_semi").collect()}
    got = [(r.query_id, r.document_id) for r in lsh.found_pairs(exact, model, asked, features, 1.35).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and 0 < len(expected) < exact.count()


def _probed_by_hand(model, asked, features, probes, threshold):
    """Candidates by comparing all pairs, with borders taken from the fine hash."""
    rows = {r.source_id: r for r in lsh.hashed_rows(model, asked).collect()}
    fine = {r.source_id: r.buckets for r in lsh.hashed_rows(lsh.fit_index(features, model.getBucketLength() / lsh.FINE, 4), asked).collect()}
    stored = {r.source_id: r for r in lsh.hashed_rows(model, features).collect() if r.indices}
    found = set()
    for q, row in rows.items():
        wanted = {(t, b) for t, b in enumerate(row.buckets)}
        borders = []
        for t, b in enumerate(row.buckets):
            place = fine[q][t] - lsh.FINE * b
            borders += [(place, t, 1, (t, b - 1)), (lsh.FINE - 1 - place, t, 2, (t, b + 1))]
        wanted |= {w for *_, w in sorted(borders)[:probes]}
        x = dict(zip(row.indices, row["values"]))
        for d, other in stored.items():
            y = dict(zip(other.indices, other["values"]))
            gap = sum((x.get(i, 0) - y.get(i, 0)) ** 2 for i in {*x, *y})
            if x and math.sqrt(gap) < threshold and any((t, b) in wanted for t, b in enumerate(other.buckets)):
                found.add((q, d))
    return found


@pytest.mark.parametrize("probes", [1, 3, 8])
def test_probes_equal_all_pairs(hashed, probes):
    asked, features = hashed
    model = lsh.fit_index(features, lsh.discriminating_width(4096), 4)
    expected = _probed_by_hand(model, asked, features, probes, 1.38)
    found = lsh.lsh_search(model, asked, features, 1.38, 1000, heavy=40, probes=probes)
    assert {(r.query_id, r.document_id) for r in found.ranked.collect()} == expected
    assert sum(r.candidates for r in found.counts.collect()) == len(expected)


def test_probes_serve_uncovered_queries(hashed):
    asked, features = hashed
    model = lsh.fit_index(features, lsh.discriminating_width(4096) / 8, 2)
    plain = lsh.lsh_search(model, asked, features, 1.3, 3).ranked
    served = lsh.probe_uncovered(model, plain, asked, features, 1.3, 3, 4)
    before, after = ({r.query_id for r in f.collect()} for f in (plain, served))
    assert before < after
    assert {r.found_by for r in served.collect() if r.query_id in before} == {"lsh"}
    exact = S.sparse_top_k(FE.sparse_rows(asked), FE.sparse_rows(features), 5)
    report = lsh.probe_report(model, asked, features, exact, 1.3, (0, 2, 4)).orderBy("probes").collect()
    for name in ("queries_covered", "candidate_pairs", "candidate_recall"):
        values = [r[name] for r in report]
        assert values == sorted(values) and values[0] < values[-1]


def test_sparse_dot_of_a_row(spark):
    from pairloom.functions.vectors import sparse_dot

    rows = [(([1, 4, 9], [1.0, 2.0, 3.0]), ([4, 9, 11], [5.0, 7.0, 1.0])), (([], []), ([1], [1.0])), (([2], [0.5]), ([2], [4.0]))]
    kind = "a struct<indices array<int>, values array<double>>, b struct<indices array<int>, values array<double>>"
    frame = spark.createDataFrame(rows, kind).select(sparse_dot(F.col("a"), F.col("b")).alias("dot"))
    assert [r.dot for r in frame.collect()] == [31.0, 0.0, 2.0]


def test_fallback_serves_uncovered_queries_only(hashed):
    asked, features = hashed
    index = lsh.fit_index(features, 0.8, 3)
    nearest = lsh.rerank(lsh.lsh_candidates(index, asked, features, 1.4), 1).orderBy("distance").collect()
    half_covered = nearest[len(nearest) // 2].distance
    ranked = lsh.rerank(lsh.lsh_candidates(index, asked, features, half_covered), 5)
    rows = lsh.with_fallback(ranked, FE.sparse_rows(asked), FE.sparse_rows(features), 5).collect()
    by_query = {}
    for row in rows:
        by_query.setdefault(row.query_id, set()).add(row.found_by)
    assert all(len(kinds) == 1 for kinds in by_query.values())
    assert {"lsh", "exact"} == set.union(*by_query.values())


def test_bucket_lengths_are_exact():
    assert lsh.common_width((0.5, 0.8, 1.0, 1.2, 1.5)) == (0.1, [5, 8, 10, 12, 15])
    assert lsh.common_width((0.001953125, 0.00390625)) == (0.001953125, [1, 2])
    assert lsh.common_width((4e-7,)) == (4e-7, [1])
    for widths in ((0.1, 0.1000001), (0.0, 1.0)):
        with pytest.raises(ValueError, match="bucket lengths"):
            lsh.common_width(widths)


def _by_hand(words, ngrams):
    counts = {}
    terms = [f"u_{w}" for w in words] + [f"b_{a}_{b}" for a, b in zip(words, words[1:])] if ngrams else words
    for term in terms:
        counts[term] = counts.get(term, 0) + 1
    return counts


def test_terms_are_counted_as_by_hand_whatever_the_parts(docs, monkeypatch):
    """Rows without words, repeated words, words beyond ASCII, and parts of one row each."""
    texts = ["", "data data data", "ñandú größe 東京 ñandú größe", "the of", "b_ u_ x_y spark b_ u_", "spark data spark data spark"]
    frame = docs([(f"k{i}", text) for i, text in enumerate(texts)]).coalesce(1)
    for part_bytes in (L.PART_BYTES, 1):
        monkeypatch.setattr(L, "PART_BYTES", part_bytes)
        for ngrams in (False, True):
            cut = frame.select("source_id", L.tokens(F.col("combined_text")).alias("w"))
            expected = {r["source_id"]: _by_hand(r["w"], ngrams) for r in cut.collect()}
            found = {r["source_id"]: {x["term"]: x["tf"] for x in r["runs"]} for r in L.term_rows(frame, ngrams).collect()}
            assert found == expected


def test_terms_without_weight_are_not_written(docs):
    """Of a catalog's phrases most stand in one document; they must not reach the table that later joins read."""
    vocabulary = L.fit_vocabulary(docs([("a", "spark python rare"), ("b", "spark python"), ("c", "lonely")]), 2)
    written = vocabulary.table.sparkSession.read.parquet(*vocabulary.table.inputFiles())
    assert {(r["term"], r["df"]) for r in written.collect()} == {(None, 3), ("spark", 2), ("python", 2)}
    assert (vocabulary.documents, vocabulary.terms, vocabulary.postings) == (3, 2, 4)


def test_no_list_of_all_postings_is_made(docs):
    """Norms are sums of numbers: lists hold one row a document and the terms that queries ask for."""
    catalog = docs([("a", "spark python java scala"), ("a", "spark java"), ("b", "spark python"), (None, "python scala"), ("c", "java")])
    rows = L.postings(catalog)
    vocabulary = L.fit_vocabulary(catalog, 1)
    known = L.attach_terms(rows, vocabulary.table, vocabulary, "source_id")
    asked = known.filter(F.col("term") == "python")
    split = L.asked_documents(known, asked.select("source_id", "term", "tf", "idf"))
    whole = L.weighted_documents(known, F.col("term") == "python")

    def plain(frame):
        return sorted((str(r["source_id"]), round(r["norm"], 9), sorted((e["term"], round(e["weight"], 9)) for e in r["entries"])) for r in frame.collect())

    assert plain(split) == plain(whole) and len(plain(split)) == 3
