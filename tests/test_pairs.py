import numpy as np
import pyarrow as pa
import pytest

from pairloom.operators import lsh, scoring as S
from pairloom.plans import matching


def table(vectors, buckets, prefix):
    rows = [np.flatnonzero(v >= 0) for v in vectors]
    return pa.table({
        "source_id": [f"{prefix}{n:04d}" for n in range(len(vectors))], "indices": pa.array([r.tolist() for r in rows], pa.list_(pa.int32())),
        "values": [v[r].tolist() for v, r in zip(vectors, rows)], "buckets": buckets.astype(float).tolist(),
    })


def sides():
    """Long and short rows, rows that share no term with a query, copies, and vectors of zeros."""
    pick = np.random.default_rng(5)
    catalog, asked = np.full((300, 400), -1.0), np.full((40, 400), -1.0)
    for side, low in ((catalog, 200), (asked, 0)):
        for n, row in enumerate(side):
            own = np.arange(30) if n % 3 == 0 else low + pick.integers(0, 200, 3 + n % 5)
            row[own] = pick.random(len(own)) + 0.01
            row[row >= 0] /= np.sqrt((row[row >= 0] ** 2).sum())
    catalog[7], catalog[9], asked[3] = asked[0], asked[0], catalog[12]
    catalog[20][catalog[20] >= 0], asked[5][asked[5] >= 0] = 0.0, 0.0
    return catalog, asked, pick.integers(0, 2, (300, 3)), pick.integers(0, 2, (40, 3))


def found(block, rows, threshold):
    search, pairs = lsh.Found(block, None), []
    for stripe in S.stripes(S.one_batch(rows)):
        for query, ids, distance in search.pairs(stripe, lambda agree: agree(0) | agree(1) | agree(2), threshold):
            pairs += zip(block.ids[query], ids, distance)
    return search, {(q, d): x for q, d, x in pairs}, len(pairs)


@pytest.mark.parametrize("threshold", [0.5, 1.2, 1.4, 1.6])
@pytest.mark.parametrize("common", [1, 16, 1000])
def test_pairs_equal_all_pairs(threshold, common, monkeypatch):
    monkeypatch.setattr(lsh, "COMMON", common)
    catalog, asked, here, there = sides()
    block = lsh.HashedBlock.build(table(asked, there, "q"))
    search, pairs, emitted = found(block, table(catalog, here, "d"), threshold)
    a, b = np.maximum(catalog, 0), np.maximum(asked, 0)
    distance = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))
    meet = (here[:, None, :] == there[None]).any(axis=2) & (distance < threshold)
    assert emitted == len(pairs) == meet.sum() == search.counts.sum()
    for d, q in zip(*np.nonzero(meet)):
        assert pairs[f"q{q:04d}", f"d{d:04d}"] == pytest.approx(distance[d, q], abs=1e-7)
    assert all(pairs.get(("q0000", d), 0.0) == 0.0 for d in ("d0007", "d0009"))
    assert (search.counts == meet.sum(axis=0)).all()


def test_rows_without_a_common_term_are_not_compared(monkeypatch):
    """Of 200 short rows one shares a term; before, every row met every query as numbers."""
    catalog, asked = np.full((200, 400), -1.0), np.full((40, 400), -1.0)
    catalog[:, 300], asked[:, :10] = 1.0, np.sqrt(0.1)
    catalog[8, 300], catalog[8, 4] = -1.0, 1.0
    block = lsh.HashedBlock.build(table(asked, np.zeros((40, 3)), "q"))
    monkeypatch.setattr(S.SparseBlock, "dot", lambda *_: pytest.fail("a row was compared with every query"))
    monkeypatch.setattr(lsh, "FEW_CELLS", 1 / 2)
    search, pairs, _ = found(block, table(catalog, np.zeros((200, 3)), "d"), 1.4)
    assert {d for _, d in pairs} == {"d0008"} and search.counts.tolist() == [1] * 40


def test_only_the_texts_of_the_split_are_masked(spark):
    """The chosen resumes are written; no filter of theirs sinks to the scan of all of them."""
    names = "resume_id role_normalized resume_normalized job_description_id job_description_normalized split".split()
    rows = [(f"r{n}", "role", f"text {n}", f"j{n}", "words", ("train", "validation")[n % 2]) for n in range(6)]
    resumes = spark.createDataFrame(rows, names)
    jobs = spark.createDataFrame([("a", "title", "summary", ["x"])], "job_link string, job_title_normalized string, job_summary_normalized string, skills array<string>")
    _, queries, asked = matching.pick_sides(jobs, resumes, "validation", None)
    assert queries.inputFiles() and all("/table-" in file for file in [*queries.inputFiles(), *asked.inputFiles()])
    assert {r.source_id for r in queries.collect()} == {"r1", "r3", "r5"}
