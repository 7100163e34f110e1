"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Words are maximal runs of Latin letters (A-Z in lower case) of all texts, some of them
damaged by rule, see ``damaged``. They are counted per text, per task and then globally, so
only distinct words are shuffled, however frequent one is.

Search: of two words the shorter one (of equal lengths the smaller) contributes two disjoint
chunks, its halves, the other its positional grams. One edit touches at most one of two
disjoint chunks, so the other is a gram of the longer word, at the same place or one further.
The half that the edit touches has two halves again, of which one is whole in the same way.
So a key joins a whole half with the whole quarter of the other, which leaves out the one
quarter that the edit may touch: eight rows for each word on either side, whatever its
length; grams that no chunk could meet within shift one are not made. A pair is kept for the
first quarter that can be left out, and verified in the join. Keys with more than ``PART``
chunks are dealt into parts, and their grams repeated for each part.

Variants: the form of a word is its near word with the most occurrences (ties: the smallest),
if that has at least ``TIMES`` as many; forms are followed to the last one by doubling, so
chains of any length take a logarithmic number of joins.

Defined cases: null and empty texts have no words; repeated rows count each; a null id reads
as the empty text; texts and words of any length are read whole; other columns are not read;
an empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import decoded, quoted, slices, written

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH = 5
LEAST_COUNT = 3
DAMAGE = 97
TIMES = 2
# Chunks of one key that stay together in the join.
PART = 2000
# Distinct words that a task counts before it hands them on.
HELD = 200_000


def damaged(word: str, prefix: int) -> str:
    """``word`` without one code point, for one (document, word) in ``DAMAGE``; ``prefix`` is
    the CRC-32 of the document's part of the key."""
    h = zlib.crc32(word.encode(), prefix)
    if h % DAMAGE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counted_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: words of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences."""
    slim = df.select(F.coalesce(quoted(key).cast("string"), F.lit("")).alias("key"), quoted(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for part in slices(batches):
            for name, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if raw is None:
                    continue
                prefix = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(RUN.findall(decoded(raw.lower()))).items():  # bytes: A-Z only
                    word = damaged(word, prefix)
                    if len(word) >= LEAST_LENGTH:
                        held[word] = held.get(word, 0) + n
            if len(held) >= HELD:
                yield handed()
        yield handed()

    words = slim.mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# Which quarter the edit may touch, and how much longer the other word is.
PLACES = tuple((touched, more) for more in (0, 1) for touched in range(4))


def _chunks(word: Column, length: Column, touched: int, more: int) -> tuple[Column, Column]:
    """What lies before and after the touched quarter of a word of ``length``, read from
    ``word``, which is ``more`` longer: what follows the edit is shifted by as much."""
    cut = lambda k: F.floor(length * k / 4).cast("int")
    return F.substring(word, F.lit(1), cut(touched)), F.substring(word, cut(touched + 1) + (1 + more), length)


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, a_n, b, b_n)``: every pair one edit apart, once, from distinct ``(word, n)``."""
    size, word = F.length("word"), F.col("word")

    def keys(shorter: bool) -> Column:
        found = []
        for place, (touched, more) in enumerate(PLACES):
            length = size if shorter else size - more
            found.append(F.xxhash64(F.lit(place), length, *_chunks(word, length, touched, 0 if shorter else more)))
        return F.posexplode(F.array(*found)).alias("place", "key")

    chunks = words.select(word.alias("a"), F.col("n").alias("a_n"), keys(True)).drop("place")
    grams = words.select(word.alias("b"), F.col("n").alias("b_n"), keys(False))
    parts = chunks.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).filter("parts > 1")
    dealt = chunks.join(parts, "key", "left").select("a", "a_n", "key", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0)).cast("long").alias("part"))
    spread = grams.join(parts, "key", "left").select(
        "b", "b_n", "place", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("part")
    )
    a, b, length = F.col("a"), F.col("b"), F.length("a")
    met, earlier = F.lit(False), {0: F.lit(False), 1: F.lit(False)}
    for place, (touched, more) in enumerate(PLACES):
        agrees = F.length("b") == length + more
        for own, other in zip(_chunks(a, length, touched, 0), _chunks(b, length, touched, more)):
            agrees = agrees & (own == other)
        met = met | ((F.col("place") == place) & agrees & ~earlier[more])
        earlier[more] = earlier[more] | agrees
    ordered = (length < F.length("b")) | ((length == F.length("b")) & (a < b))
    near = ordered & (F.levenshtein(a, b, 1) == 1) & met
    return dealt.join(spread, ["key", "part"]).filter(near).select("a", "a_n", "b", "b_n")


def last_forms(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: where the forms end, by pointer doubling."""
    pointers = written(forms.select("word", F.col("form").alias("root")), "pointers")
    while True:
        onward = pointers.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(
            pointers.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "pointers"
        )
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        pointers = moved.select("word", "root")


def spelling_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``df``."""
    words = written(counted_words(df, key, text), "words")
    pairs = written(near_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    # The near words of one word are bounded by its length and the alphabet; both sums are map-side.
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= TIMES * F.col("n")
    formed = written(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = last_forms(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
