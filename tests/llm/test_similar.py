import random

from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import setsketch, similar, simhash


def plain_shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """The smallest id of every group of texts that are at least 0.8 similar, all pairs."""
    rows = sorted(rows)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for at, (i, x) in enumerate(rows):
        for j, y in rows[:at]:
            a, b = plain_shingles(x), plain_shingles(y)
            if 5 * len(a & b) >= 4 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted(i for i in root if find(i) == i)


def edited(pick, words, edits):
    words = list(words)
    for at in pick.sample(range(len(words)), edits):
        words[at] = f"edit{pick.randrange(10**6)}"
    return words


def test_edited_copies_go(spark, documents):
    pick = random.Random(5)
    rows, far = [], 0
    for _ in range(25):
        base = [f"w{pick.randrange(5000)}" for _ in range(300)]
        rows += [(len(rows) + k, " ".join(edited(pick, base, edits))) for k, edits in enumerate((0, 3, 5, 7, 12, 25))]
        prints = [simhash.fingerprint(t.encode()) for _, t in rows[-6:-2]]
        far += sum((p ^ prints[0]).bit_count() > simhash.RADIUS for p in prints)
    rows += [(1000, None), (1001, " \n"), (1002, "four words of text"), (1003, "Four words OF text"), (1004, "four words of it")]
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, documents(rows), "").collect())
    assert kept == plain_kept(rows) and far > 30


def test_one_rule_for_all_sizes_of_buckets(spark, documents, monkeypatch):
    monkeypatch.setattr(setsketch, "PART", 2)
    pick = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(pick, base, pick.randrange(6)))) for i in range(40)] + [(90 + i, " ".join(base)) for i in range(5)]
    assert sorted(r["doc_id"] for r in similar.keep_one(documents(rows)).collect()) == plain_kept(rows)


def test_odd_rows_keep_one_of_each_text(odd, documents):
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 5
    assert kept.filter("doc_id = 4").count() == 2
    assert similar.keep_one(documents([])).collect() == []


def test_of_equal_rows_one_stays(documents):
    rows = [(7, "the same five words here")] * 300 + [(7, "The same FIVE words here")] * 5 + [(9, None)] * 40
    kept = similar.keep_one(documents(rows).repartition(7)).collect()
    assert sorted(r["doc_id"] for r in kept) == [7, 9]


def no_buckets(nodes):
    return nodes.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("band"), "node").limit(0)


def test_simhash_finds_and_full_sets_confirm(documents, monkeypatch):
    # Without any sketch bucket only SimHash can find the copies.
    monkeypatch.setattr(setsketch, "buckets", no_buckets)
    pick = random.Random(6)
    base = [f"w{pick.randrange(5000)}" for _ in range(400)]
    near = [(i, " ".join([*base[:-1], f"last{i}"])) for i in range(8)]
    # One shingle is most of either text: equal fingerprints, other sets.
    alike = [(50, "x " * 100 + "one two three four five"), (51, "x " * 100 + "six seven eight nine ten")]
    prints = [simhash.fingerprint(t.encode(), similar.SHINGLE) for _, t in near + alike]
    assert all((p ^ prints[0]).bit_count() <= simhash.RADIUS for p in prints[:8]) and prints[8] == prints[9]
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(None, documents(near + alike), "").collect())
    assert kept == plain_kept(near + alike) == [0, 50, 51]


def test_fingerprints_of_any_shingle_length():
    for size in (1, 4, 5):
        for n in range(9):
            words = [f"w{i}" for i in range(n)]
            shingles = [" ".join(words[i : i + size]) for i in range(max(1, n - size + 1))] if n else []
            sums = [sum(simhash.xxhash.xxh64_intdigest(s.encode(), simhash.SEED) >> bit & 1 for s in shingles) for bit in range(64)]
            assert simhash.fingerprint(" ".join(words).encode(), size) == sum(1 << bit for bit in range(64) if 2 * sums[bit] > len(shingles))
