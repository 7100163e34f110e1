import random

import pytest
import xxhash

from pairloom.llm import simhash
from pyspark.sql import functions as F


def plain_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = list(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B c", "a b c D", "É é A b c d e", "x y z w " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_a_layout_finds_every_split_of_four_bits():
    for segments in simhash.LAYOUTS:
        assert sum(width for _, width, _ in segments) == 64 and sum(radius + 1 for *_, radius in segments) > simhash.RADIUS
    assert simhash.layout(10**5) == simhash.LAYOUTS[0] and simhash.layout(10**9) == simhash.LAYOUTS[1]
    assert len(simhash.ball(32, 2)) == len(set(simhash.ball(32, 2))) == 1 + 32 + 496


@pytest.mark.parametrize("segments", simhash.LAYOUTS)
def test_links_equal_all_pairs(spark, segments):
    pick = random.Random(3)
    points = [pick.getrandbits(64) for _ in range(60)]
    points += [p ^ sum(1 << b for b in pick.sample(range(64), pick.randrange(7))) for p in points for _ in range(12)]
    points = sorted({p - (1 << 64) if p >> 63 else p for p in points} | {0})
    nodes = spark.createDataFrame([(p,) for p in points], "fp long").repartition(3)
    got = [tuple(r) for r in simhash.links(nodes, segments).collect()]
    mask = (1 << 64) - 1
    expected = {(a, b) for i, b in enumerate(points) for a in points[:i] if ((a ^ b) & mask).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200)]
    found = dict(tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_groups_of_odd_rows(odd):
    got = simhash.near_duplicate_groups(odd).collect()
    rows = odd.collect()
    assert len(got) == len(rows)
    root = plain_components({plain_fingerprint(r["text"]) for r in rows})
    least = {}
    for r in rows:
        k = root[plain_fingerprint(r["text"])]
        least[k] = min([x for x in (least.get(k), r["doc_id"]) if x is not None], default=None)
    expected = sorted(((r["doc_id"], f"{plain_fingerprint(r['text']):016x}", least[root[plain_fingerprint(r["text"])]]) for r in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == expected


def test_one_of_each_group_stays(odd, documents):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [g["component_id"] for g in simhash.near_duplicate_groups(odd).select("component_id", "fingerprint").distinct().collect()]
    assert kept.count() == len(ids)
    assert kept.filter("doc_id = 4").count() == 2  # two texts under one id, the repeated row once
    base = " ".join(f"term{i}" for i in range(300))
    copies = documents([(9, base), (7, base), (8, base + " extra"), (3, "quite another text of some words")])
    assert sorted(r["doc_id"] for r in simhash.keep_one(copies).collect()) == [3, 7]


def test_empty_table_and_clashing_columns(documents):
    assert simhash.near_duplicate_groups(documents([])).collect() == []
    assert simhash.keep_one(documents([])).collect() == []
    clash = documents([(1, "a b c d e")]).withColumn("fp", F.lit("x")).withColumn("root", F.lit(2)).withColumn("id", F.lit(3))
    assert simhash.near_duplicate_groups(clash).count() == 1 and simhash.keep_one(clash).columns == clash.columns


def test_components_plan_no_step_several_times(spark, monkeypatch):
    scans = []

    def counting(df, own=simhash.checkpointed):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD"))
        return own(df)

    monkeypatch.setattr(simhash, "checkpointed", counting)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long").repartition(3)
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(31)}
    assert len(scans) > 3 and max(scans[1:]) <= 4
