import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import setsketch


def plain_set(text, size=4):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_groups(rows, size=4, least=80):
    """The result by comparing all pairs of rows."""
    sets = [plain_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= least * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        component = min((k for k in ids[find(i)] if k is not None), default=None) if sets[i] else key
        out.append((key, len(sets[i]), component, key == component))
    return sorted(out, key=str)


def found(frame, **options):
    return sorted((tuple(r) for r in setsketch.near_duplicate_groups(frame, **options).collect()), key=str)


def edited(pick, words, edits):
    words = list(words)
    for at in pick.sample(range(len(words)), edits):
        words[at] = f"edit{pick.randrange(10**6)}"
    return words


def families(pick, n, width=150):
    rows = []
    for _ in range(n):
        base = [f"w{pick.randrange(3000)}" for _ in range(width)]
        rows += [" ".join(edited(pick, base, edits)) for edits in (0, 0, 1, 2, 3, 4, 5, 8, 20)]
    pick.shuffle(rows)
    return list(enumerate(rows))


def test_shingles_are_distinct_windows():
    for text in ("", " \n", "One", "a b c", "A b c D", "a b c d e", "x y z w " * 40, "É é e a b"):
        assert len(setsketch.shingle_set(text.encode())) == len(plain_set(text))
    same = setsketch.shingle_set("A b\tc  D e".encode())
    assert np.array_equal(same, setsketch.shingle_set("a B c d E".encode())) and len(setsketch.shingle_set(None)) == 0


def test_registers_merge_and_tell_similarity():
    random_ = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.8, 0.95):
        for n in (60, 700):
            both = round(2 * n * j / (1 + j))
            pool = random_.integers(0, 1 << 64, (20, 2 * n - both), np.uint64)
            sides = [(np.sort(p[:n]), np.sort(p[n - both :])) for p in pool]
            regs = [(setsketch.registers(a), setsketch.registers(b)) for a, b in sides]
            for (a, b), (x, y) in zip(sides, regs):
                assert np.array_equal(setsketch.registers(np.union1d(a, b)), setsketch.merged(x, y))
            x, y = (np.array(side) for side in zip(*regs))
            sizes = np.full(20, float(n))
            estimate, beaten = setsketch.estimates(sizes, sizes, (x > y).sum(1), (x < y).sum(1), (x == y).sum(1))
            true = both / (2 * n - both)
            assert abs(estimate.mean() - true) < 0.05
            if true >= 0.8:
                assert (beaten <= setsketch.SLACK).all()


def test_sizes_far_apart_are_not_plausible():
    same = np.array([setsketch.REGISTERS] * 3)
    zero = np.zeros(3, int)
    assert setsketch.plausible(np.array([80.0, 79.0, 100.0]), np.array([100.0, 100.0, 80.0]), zero, zero, same).tolist() == [True, False, True]


def test_groups_equal_all_pairs(spark, documents):
    rows = families(random.Random(3), 25)
    expected = plain_groups(rows)
    assert found(documents(rows).repartition(3)) == expected
    assert 25 < sum(kept for *_, kept in expected) < len(rows)


@pytest.mark.parametrize(("size", "least"), [(5, 80), (3, 60)])
def test_other_rules(spark, documents, size, least):
    rows = families(random.Random(4), 6)
    assert found(documents(rows), size=size, least=least) == plain_groups(rows, size, least)


def test_near_misses_in_one_bucket(spark, documents, monkeypatch):
    """Members whose pairs lie on both sides of the threshold, in few and in many parts."""
    pick = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(edited(pick, base, pick.randrange(1, 5)))) for i in range(90)]
    expected = plain_groups(rows)
    assert found(documents(rows)) == expected
    monkeypatch.setattr(setsketch, "OPEN", 0)
    monkeypatch.setattr(setsketch, "PART", 7)
    assert found(documents(rows)) == expected


def test_blocks_join_what_their_pairs_join(spark, monkeypatch):
    """Members of one family over several parts: only pairs of different groups are compared,
    in the first band in which they agree, and the links span what all pairs would join."""
    monkeypatch.setattr(setsketch, "PART", 4)
    pick = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(edited(pick, base, pick.randrange(1, 4))).encode() for _ in range(30)]
    sets = [setsketch.shingle_set(t) for t in texts]
    regs = [setsketch.registers(s) for s in sets]
    nodes = spark.createDataFrame([(i, len(s), r.tobytes()) for i, (s, r) in enumerate(zip(sets, regs))], "node long, n long, regs binary")
    members = setsketch.buckets(nodes).withColumn("root", F.expr("node DIV 3 * 3"))
    rows = setsketch.placed(members, setsketch._open(members))
    hashes = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, hashes binary")
    asked = setsketch.with_partners(rows, nodes, 80)
    found = [tuple(r) for r in setsketch.block_links(asked, nodes, hashes, 80).collect()]
    assert asked.count() <= rows.count() and all(setsketch.linked(sets[a], sets[b]) and a // 3 != b // 3 for a, b in found)

    def joined(pairs):
        root = [i // 3 * 3 for i in range(30)]
        for a, b in pairs:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
        return root

    shares = lambda a, b: (regs[a].reshape(-1, setsketch.ROWS) == regs[b].reshape(-1, setsketch.ROWS)).all(1).any()
    assert joined(found) == joined((a, b) for a in range(30) for b in range(a) if shares(a, b) and setsketch.linked(sets[a], sets[b]))


def test_a_large_group_of_near_copies(spark, documents):
    pick = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(pick, base, 1))) for i in range(400)] + [(1000 + i, " ".join(base)) for i in range(200)]
    got = found(documents(rows))
    assert {component for _, _, component, _ in got} == {0} and sum(kept for *_, kept in got) == 1


def test_odd_rows(spark, documents, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd) == plain_groups(rows)
    assert found(documents([])) == [] and found(documents([(None, None)])) == [(None, 0, None, True)]
    clashing = odd.withColumnsRenamed({"lang": "node", "source": "text_key", "n_chars": "regs"})
    assert found(clashing) == found(odd)
