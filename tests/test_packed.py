import os

import numpy as np
import pyarrow as pa
import pytest

from pairloom.checks import shared_folder
from pairloom.operators import lexical as L, packed
from pairloom.operators.lexical import fit_vocabulary, lexical_top_k, sparse_scores


def rows(frame):
    return sorted(((r.query_id, r.document_id, round(r.score, 6)) for r in frame.collect()), key=str)


CATALOG = [
    ("a", "oak elm oak ash shared"), ("a", "elm fir shared"), (None, "oak fir shared"), (None, "ash shared"), ("b", "oak elm shared"),
    ("c", "oak elm shared"), ("d", "shared"), ("e", "lonely shared ñandú"), ("f", "ñandú shared the of"), ("g", None), ("g", "shared fir elm oak"),
]
QUERIES = [("q", "oak elm ñandú"), ("q", "oak"), (None, "fir ash"), ("r", "shared"), ("s", "unknown"), ("t", "")]


@pytest.mark.parametrize("ngrams", [False, True])
def test_packed_scores_equal_those_of_joins(docs, ngrams, monkeypatch):
    """Ids that repeat or are missing, a word of every text, ties, few cells at a time."""
    monkeypatch.setattr(packed, "CELLS", 7)
    asked = docs(QUERIES)
    for least, texts in ((1, [row for row in CATALOG if row[1]]), (2, CATALOG)):
        catalog = docs(texts)
        joined = sparse_scores(asked, catalog, fit_vocabulary(catalog, least, ngrams), 6, broadcast_rows=0)
        mine = sparse_scores(asked, catalog, fit_vocabulary(catalog, least, ngrams), 6)
        assert rows(mine) == rows(joined) and len(rows(mine)) > 5
    for k in (1, 3):
        ranked = [lexical_top_k(asked, catalog, k, ngrams, decimals=6, broadcast_rows=n) for n in (0, 1_000_000)]
        joined, mine = (sorted((str(r.query_id), r["rank"], str(r.document_id), round(r.score, 6)) for r in top.collect()) for top in ranked)
        assert mine == joined


def test_a_search_leaves_only_its_result_on_disk(spark, docs):
    """Counted terms, vocabulary and sums of a search are larger than its texts; they may not pile up."""
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    top = lexical_top_k(docs(QUERIES), docs(CATALOG), 2, True)
    left = [name for name in os.listdir(folder) if name.startswith("table-") and name not in before]
    assert len(left) == 1 and top.count() > 0


def test_a_posting_takes_a_few_bytes(docs):
    """Not a row with the term as it is spelled."""
    texts = [(f"k{n}", " ".join(f"word{n * 7 + at * 13 % 900:04d}" for at in range(300))) for n in range(60)]
    words = docs(texts).selectExpr("source_id", "split(combined_text, ' ') AS terms").coalesce(1)
    found = packed.packed_postings(words, True, 4, L._parts).filter("step >= 0").toArrow()
    bodies = [packed.unpack(body) for body in found.column("body")]
    postings = sum(body.num_rows for body in bodies)
    assert postings == sum(len(set(t.split())) + len(set(zip(t.split(), t.split()[1:]))) for _, t in texts)
    assert sum(len(body.as_py()) for body in found.column("body")) < 14 * postings + 1000 * len(bodies)


def test_terms_spelled_and_counted_have_the_same_bits():
    words = pa.array([["spark", "java", "spark", "c++"], None, []], pa.list_(pa.string()))
    owners, bits, counts = packed.count_prints(words, True)
    spelled = ["u_spark", "u_java", "u_c++", "b_spark_java", "b_java_spark", "b_spark_c++"]
    assert sorted(map(tuple, bits)) == sorted(map(tuple, packed.term_prints(spelled, True)))
    assert owners.tolist() == [0] * 6 and sorted(counts) == [1, 1, 1, 1, 1, 2]
    assert len({tuple(row) for row in packed.prints(["", None, "a"])}) == 3


def test_the_best_of_a_task_keep_ties_by_id(monkeypatch):
    monkeypatch.setattr(packed, "CELLS", 3)
    best = packed.Highest(2, 2)
    for names in (["d", "c"], [None, "b"], ["a", "e"], ["z", "y"]):
        best.add(np.zeros(2, np.int64), np.array(names, object), np.ones(2))
    best.add(np.array([0, 1]), np.array(["low", "f"], object), np.array([0.5, 0.1]))
    query, names, score = best.rows()
    assert sorted(zip(query, map(str, names), score)) == [(0, "None", 1.0), (0, "a", 1.0), (0, "b", 1.0), (1, "f", 0.1)]
