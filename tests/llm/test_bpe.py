import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from pairloom.llm import bpe, token_counts
from tests.llm.conftest import LONG

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return bpe.encoding(RANKS, PATTERN)


def cut(texts):
    words, counts = bpe.pre_tokens(texts)
    words, out, at = words.to_pylist(), [], 0
    for n in counts.tolist():
        out.append(words[at : at + n])
        at += n
    return out


def test_cuts_match_the_library_on_random_texts(library):
    pick = random.Random(5)
    alphabet = [*"abstrevmld' '  \n\t\r\x1c\x85.!?12é漢٣　'\"\0", "'s", "'ll", "'re", "'ve", "  ", "́", "🙂"]
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randrange(30))) for _ in range(4000)]
    for text, words in zip(texts, cut(texts)):
        assert [t for w in words for t in library._core_bpe.encode_single_piece(w)] == library.encode_ordinary(text), repr(text)


def test_every_class_of_code_points_is_cut_as_the_library_does(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 101 == 0)]
    texts = [chr(c).join(["a", "1", " b", " ", "'s", "\n", "!"]) for c in points]
    expected = library.encode_ordinary_batch(texts, num_threads=2)
    for text, words, ids in zip(texts, cut(texts), expected):
        assert [t for w in words for t in library._core_bpe.encode_single_piece(w)] == ids, repr(text)


def test_round_trip_of_odd_rows(odd, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 10)
    outputs = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    got = bpe.encode_decode(odd, RANKS, PATTERN, keep=("doc_id", "n_chars"), outputs=outputs, buckets=3).collect()
    given = odd.collect()
    def key(r):
        return (r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"] or -1)
    assert len(got) == len(given)
    for a, b in zip(sorted(got, key=key), sorted(given, key=key)):
        ids = library.encode_ordinary(b["text"] or "")
        assert (a["n_tokens"], a["ids"], bytes(a["decoded"])) == (len(ids), ids, (b["text"] or "").encode())
        assert a["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert a["decoded_sha256"] == hashlib.sha256((b["text"] or "").encode()).hexdigest()


def test_columns_may_have_names_of_outputs(documents):
    rows = documents([(1, "hello world")]).withColumnRenamed("source", "chunk")
    got = bpe.encode_decode(rows, RANKS, PATTERN, keep=("chunk", "doc_id"), outputs=("n_tokens",)).collect()
    assert [tuple(r) for r in got] == [("web", 1, 2)]


def test_empty_table(documents):
    assert bpe.encode_decode(documents([]), RANKS, PATTERN).collect() == []
    assert token_counts.limits(token_counts.histogram(token_counts.with_length(documents([]), RANKS, PATTERN))).collect() == []


def test_histogram_answers_equal_brute_force(odd, library):
    lengths = [len(library.encode_ordinary(r["text"] or "")) for r in odd.collect()]
    assert max(lengths) > len(LONG) // 20
    found = token_counts.limits(token_counts.histogram(token_counts.with_length(odd, RANKS, PATTERN))).persist()
    for r in found.collect():
        n = r["length"]
        assert r["docs"] == lengths.count(n) and r["docs_over"] == sum(x > n for x in lengths)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths) and r["tokens_total"] == sum(lengths)
        assert r["lost_tokens"] == sum(max(x - n, 0) for x in lengths)
    assert {r["length"] for r in found.collect()} == set(lengths)
    for limit in (0, 3, 700, 10**9):
        assert token_counts.truncated_total(found, limit).first()[0] == sum(min(x, limit) for x in lengths)
    for share in (0.1, 0.5, 0.9, 1.0):
        assert token_counts.length_quantile(found, share).first()[0] == next(x for x in sorted(lengths) if sum(y <= x for y in lengths) >= share * len(lengths))


def test_other_patterns_are_refused(documents):
    for run in (bpe.encode_decode, token_counts.with_length):
        with pytest.raises(ValueError, match="PATTERN"):
            run(documents([(1, "a")]), RANKS, r"\w+")


def test_counts_equal_the_library(library):
    pick = random.Random(6)
    alphabet = [*"abst '  \n\t.!?12é漢\0", "'s", "  ", "🙂", " the"]
    texts = ["".join(pick.choices(alphabet, k=pick.randrange(60))) for _ in range(800)] + ["", LONG]
    assert token_counts.lengths(texts, RANKS, PATTERN).tolist() == [len(library.encode_ordinary(t)) for t in texts]


def test_long_runs_are_counted_and_encoded(documents):
    """A run of blanks that the library itself cannot take, and others without any cut."""
    texts = ["a" + " " * 2_000_000 + "x", "ab" * 200_000, "7" * 200_000, "\n" * 300_000, "!?" * 100_000]
    rows = documents(list(enumerate(texts)))
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.with_length(rows, RANKS, PATTERN).select("doc_id", "n_tokens").collect()}
    encoded = {r["doc_id"]: r for r in bpe.encode_decode(rows, RANKS, PATTERN, outputs=("n_tokens", "decoded_sha256")).collect()}
    for i, text in enumerate(texts):
        assert counted[i] == encoded[i]["n_tokens"] > 0
        assert encoded[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_a_task_forgets_words(documents, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    rows = [(i, f"unwordly{i % 5}x strangeness{i % 7}y qqzz{i}") for i in range(60)]
    library = bpe.encoding(RANKS, PATTERN)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_decode(documents(rows), RANKS, PATTERN).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in rows}
