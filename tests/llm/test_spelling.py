import random
import re
import zlib
from collections import Counter

from pairloom.llm import spelling


def plain_words(rows):
    """Counts by the definition, one run at a time."""
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    """All pairs of words, forms and roots."""
    forms, out = {}, {}
    for word, n in counts.items():
        partners = [w for w in counts if near(word, w)]
        best = min(partners, key=lambda w: (-counts[w], w), default=None)
        forms[word] = best if best is not None and counts[best] >= 2 * n else None
        out[word] = (len(partners), forms[word])
    result = set()
    for word, (n_near, form) in out.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        result.add((word, form, root, counts[word], n_near, None if form is None else counts[form]))
    return result


def found(frame):
    rows = [tuple(r) for r in spelling.spelling_groups(frame).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def variants(pick, size):
    """Words of few letters and their one-edit neighbours, so that many are near each other."""
    words = []
    for _ in range(size):
        word = "".join(pick.choices("abé", k=pick.randrange(5, 11)))
        words += [word] * pick.randrange(3, 40)
        for _ in range(4):
            at = pick.randrange(len(word))
            edit = pick.choice([word[:at] + word[at + 1 :], word[:at] + "ü" + word[at + 1 :], word[:at] + "o" + word[at:], word + "é"])
            words += [edit] * pick.randrange(1, 9)
    pick.shuffle(words)
    return words


def test_groups_equal_all_pairs(spark, documents):
    pick = random.Random(11)
    words = variants(pick, 120)
    rows = [(i, " ".join(words[at : at + 50]).title()) for i, at in enumerate(range(0, len(words), 50))]
    expected = plain_groups(plain_words(rows))
    assert found(documents(rows).repartition(3)) == expected
    assert sum(form is not None for _, form, *_ in expected) > 30


def test_hot_chunks_are_dealt(spark, documents, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 3)
    pick = random.Random(12)
    words = ["aaaaa" + "".join(pick.choices("abc", k=5)) for _ in range(60)] * 3
    rows = [(i, " ".join(words)) for i in range(2)]
    assert found(documents(rows)) == plain_groups(plain_words(rows))


def test_every_kind_of_edit_is_found(spark):
    pick = random.Random(13)
    base = ["".join(pick.choices("abcdé", k=n)) for n in range(5, 16) for _ in range(3)]
    words = set(base)
    for w in base:
        words |= {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + "x" + w[i:] for i in range(len(w) + 1)} | {w[:i] + "y" + w[i + 1 :] for i in range(len(w))}
    words = sorted(w for w in words if len(w) >= 4)
    got = [(r["a"], r["b"]) for r in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()]
    expected = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if near(a, b)}
    assert len(got) == len(expected) and {frozenset(p) for p in got} == expected


def test_long_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(45)] + [("x", "y")], "word string, form string")
    assert dict(tuple(r) for r in spelling.last_forms(forms).collect()) == {**{f"w{i}": "w45" for i in range(45)}, "x": "y"}


def test_odd_rows(spark, documents, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd) == plain_groups(plain_words(rows))
    assert found(documents([])) == set() and found(documents([(None, None)])) == set()
    clashing = odd.withColumnsRenamed({"lang": "word", "source": "n", "n_chars": "key"})
    assert found(clashing) == found(odd)


def test_one_very_long_word(spark, documents):
    long = "ab" * 400_000
    rows = [(1, long), (2, long), (3, f"{long} {long}x"), (4, f"{long}x {long}x")]
    got = found(documents(rows))
    counts = plain_words(rows)
    assert {(w, n) for w, _, _, n, _, _ in got} == set(counts.items())
    assert len(counts) < 2 or all(near_n == 1 for *_, near_n, _ in got)
