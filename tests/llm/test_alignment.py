import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
from collections import Counter

from pairloom.llm import alignment
from pairloom.llm.queries import OFFSETS, PIECES

SF_DIR = "/root/testdata/sf0.001"


def intervals(tokens, table):
    ends = np.cumsum([len(table[t]) for t in tokens]).tolist()
    return list(zip([0, *ends], ends))


def plain(text):
    """Group listing and links of one whole text, by interval arithmetic."""
    first, a_bytes = alignment.byte_level(OFFSETS)
    second, b_bytes = alignment.pieces(PIECES)
    whole = f" {text}".encode()
    a, b = first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)
    if not text or b"".join(a_bytes[t] for t in a) != whole or b"".join(b_bytes[t] for t in b) != whole:
        return None
    a_spans, b_spans = intervals(a, a_bytes), intervals(b, b_bytes)
    groups, start = [], 0
    for end in sorted({e for _, e in a_spans} & {e for _, e in b_spans}):
        inside = lambda spans, ids: ",".join(str(t) for t, (x, y) in zip(ids, spans) if start <= x and y <= end)  # noqa: B023, E731
        groups.append(f"{inside(a_spans, a)}|{inside(b_spans, b)}")
        start = end
    links = [(s, t) for s, (x, y) in zip(a, a_spans) for t, (u, v) in zip(b, b_spans) if x < v and u < y]
    return len(a), len(b), groups, links


def plain_rows(rows):
    read = [(key, plain(text or "")) for key, text in rows]
    counts = Counter(pair for _, r in read if r for pair in set(r[3]))
    highest = {}
    for (a, _), n in counts.items():
        highest[a] = max(n, highest.get(a, 0))
    out = []
    for key, r in read:
        if r is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = r
            best = sum(counts[p] == highest[p[0]] for p in links)
            out.append((key, n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in alignment.align(frame, OFFSETS, PIECES).collect()), key=str)


ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "<s>", "<0x41>", "<|endoftext|>", "１", " ", "▁", "word", " the", "ﬁ", "́", "\U0001f600", "..", "9", "​", "\x1c", "\x85", "\x00"]


def test_rows_equal_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 300)
    pick = random.Random(2)
    rows = [(i, "".join(pick.choices(ALPHABET, k=pick.randrange(14)))) for i in range(600)]
    expected = plain_rows(rows)
    assert found(documents(rows).repartition(3)) == expected
    assert sum(r[1] == 0 for r in expected) > 20


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("length(text) < 6000")
    assert found(docs) == plain_rows([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_units_are_numbered_and_aligned_once(monkeypatch):
    asked = []
    own = alignment.Aligned
    monkeypatch.setattr(alignment, "Aligned", lambda units, *paths: asked.append(list(units)) or own(units, *paths))
    # Sorting a slice's ends or listing its tokens by a sort costs more than all other steps.
    for name in ("union1d", "intersect1d"):
        monkeypatch.setattr(alignment.np, name, None)
    chunk = alignment._Chunk(0)
    chunk.add([1, 2], ["one two one", "two \x00three"], (OFFSETS, PIECES))
    chunk.add([3, 4], ["one four", ""], (OFFSETS, PIECES))
    assert asked == [["one", "two", "\x00three"], ["four"]] and chunk.codes.new == []
    for digest, text in zip(chunk.digests, ["one two one", "two \x00three", "one four", ""]):
        read = plain(text)
        assert digest == (hashlib.sha256(";".join(read[2]).encode()).hexdigest() if read else "")


def test_scores_by_parts(spark, documents, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 40)
    monkeypatch.setattr(alignment, "PART", 3)
    rows = [(i, f"the cat number {i % 7} sat on mats and mats") for i in range(120)]
    monkeypatch.setattr("pairloom.llm.common.SLICE_ROWS", 4)
    assert found(documents(rows).repartition(4)) == plain_rows(rows)


def test_postings_survive_their_bytes():
    pick = np.random.default_rng(4)
    for n_docs in (1, 7, 300, 5000):
        key = np.unique(pick.integers(0, 40 * n_docs, 12 * n_docs))
        pair, doc = key // n_docs * 977, key % n_docs
        # The first pair is in every document, so that its planes are dense.
        pair, doc = np.concatenate((pair[pair > 0], np.zeros(n_docs, np.int64))), np.concatenate((doc[pair > 0], np.arange(n_docs)))
        links = pick.integers(1, 9, len(pair))
        mixed = pick.permutation(len(pair))
        own = alignment.Postings.of(pair[mixed], doc[mixed], links[mixed], n_docs)
        back = alignment.Postings.from_bytes(own.to_bytes())
        number, documents_, counts = back.entries()
        got = set(zip(back.pairs[number].tolist(), documents_.tolist(), counts.tolist()))
        assert got == set(zip(pair.tolist(), doc.tolist(), links.tolist())) and len(number) == len(pair)
        docs, total = back.popcounts()
        for at, p in enumerate(back.pairs.tolist()):
            assert docs[at] == (pair == p).sum() and total[at] == links[pair == p].sum()
    empty = alignment.Postings.of(*[np.empty(0, np.int64)] * 3, 5)
    assert len(alignment.Postings.from_bytes(empty.to_bytes()).entries()[0]) == 0


def test_pair_table_counts_links(spark, documents):
    rows = [(1, "mats and mats and mats"), (2, "mats"), (3, None)]
    chunks = alignment.chunked(documents(rows), (OFFSETS, PIECES), "doc_id", "text")
    got = {(r["pair_a"], r["pair_b"]): (r["docs"], r["links"]) for r in alignment.pair_counts(chunks).collect()}
    links = [plain(t)[3] for _, t in rows if t]
    assert got == {p: (sum(p in own for own in links), sum(own.count(p) for own in links)) for p in set(sum(links, []))}


def test_odd_rows(spark, documents, odd):
    short = odd.filter("text IS NULL OR length(text) < 1000")
    assert found(short) == plain_rows([(r["doc_id"], r["text"]) for r in short.collect()])
    assert found(documents([])) == [] and len(found(odd)) == odd.count()
    clashing = short.withColumnsRenamed({"lang": "id", "source": "chunk", "n_chars": "n_a"})
    assert found(clashing) == found(short)


def test_very_long_runs(documents):
    rows = [(1, " " * 300_000 + "x"), (2, "a" * 200_000), (3, "7," * 100_000), (4, "\n" * 100_000)]
    got = {r[0]: r for r in found(documents(rows))}
    assert set(got) == {1, 2, 3, 4}
    assert all(got[k][1] > 0 and got[k][4] >= max(got[k][1:3]) for k in got)
