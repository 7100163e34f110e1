"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers encode each text; bytes tell which token occurrences of the one overlap which
of the other. A text is cut before each space that follows anything but white space: no
pre-token of the byte-level tokenizer and no piece of the other crosses such a place, so each
distinct unit between two cuts is encoded and aligned once per chunk and looked up after that.

Postings: a chunk is some ``CHUNK_BYTES`` of consecutive rows of one task. For each pair of
ids it holds bitmaps of the chunk's documents, one plane for each binary digit of the number
of links, so planes give link counts and their OR is the set of documents. Dense planes are
bit strings, sparse ones sorted places. Documents of different chunks differ, so a pair's
document count is the sum of its chunks' popcounts; only (pair, popcount) rows are shuffled,
summed map-side first. Chunks are written before they are asked about and in buckets by chunk;
the scores return to them, and the postings hand them to their documents. Pairs that occur in
very many chunks are dealt into parts, so no task gets all chunks of one.

Defined cases: null and empty texts, and texts whose tokens do not spell them, have no tokens
and zero counts; invalid UTF-8 reads as U+FFFD; texts of any length are aligned whole; repeated rows count each;
null ids are kept; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from pairloom.llm.common import bucketed, decoded, quoted, release_memory, slices

CHUNK_BYTES = 8 << 20
CHUNK_ROWS = 1 << 16  # so that a place fits 16 bits
# Units that a chunk remembers; beyond, it is closed.
CHUNK_UNITS = 300_000
# Chunks of one pair that stay together when scores are asked for.
PART = 2000
CUT = re.compile(r"(?<=\S) (?=.)", re.S)
ROW_FIELDS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@lru_cache(2)
def byte_level(path: str) -> tuple[Tokenizer, list[bytes]]:
    """The byte-level tokenizer of a file, special strings as plain text, and its tokens' bytes."""
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    # The alphabet of byte-level tokens: printable bytes stand for themselves, others follow 255.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary = own.get_vocab(with_added_tokens=False)
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        table[number] = bytes(byte_of[c] for c in token)
    return own, table


@lru_cache(2)
def pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """The piece tokenizer of a file and the bytes of its pieces."""
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for number in range(own.get_piece_size()):
        piece = own.id_to_piece(number)
        table.append(bytes([int(piece[3:-1], 16)]) if own.is_byte(number) else piece.replace("▁", " ").encode())
    return own, table


@lru_cache(2)
def cuts_apply(path_a: str, path_b: str) -> bool:
    """Whether no token crosses a place that ``CUT`` finds: pre-tokens are byte-level ones and
    no piece has a space after anything else."""
    with open(path_a, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec.get("pre_tokenizer") or {}
    level = before.get("type") == "ByteLevel" and before.get("use_regex") and not spec.get("normalizer")
    own, _ = pieces(path_b)
    marks = (own.id_to_piece(i) for i in range(own.get_piece_size()))
    return bool(level) and not any("▁" in piece.lstrip("▁") for piece in marks)


@lru_cache(2)
def _spellings(path_a: str, path_b: str) -> list[str]:
    """Every id with each of its separators: ids of the first tokenizer before "," and "|",
    then those of the second before "," and ";"."""
    sizes = [len(byte_level(path_a)[1])] * 2 + [len(pieces(path_b)[1])] * 2
    return [f"{number}{end}" for size, end in zip(sizes, ",|,;") for number in range(size)]


@lru_cache(2)
def _widths(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes each id of either tokenizer has."""
    return tuple(np.array([len(b) for b in table], np.int64) for table in (byte_level(path_a)[1], pieces(path_b)[1]))


class Aligned:
    """The alignment of a list of units, each taken with the space before it.

    ``spelled`` tells whose tokens spell it; the others have none. ``links`` holds all id
    pairs, unit after unit, the first id in the upper half.
    """

    def __init__(self, units: list[str], path_a: str, path_b: str):
        first, a_bytes = byte_level(path_a)
        second, b_bytes = pieces(path_b)
        a_lists = [coded.ids for coded in first.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        b_lists = second.encode(units, num_threads=1)
        whole = [(" " + u).encode() for u in units]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        a_width, b_width = _widths(path_a, path_b)
        (a, self.n_a, a_bad), (b, self.n_b, b_bad) = (
            self._flat(lists, table, width, whole, sizes) for lists, table, width in ((a_lists, a_bytes, a_width), (b_lists, b_bytes, b_width))
        )
        self.spelled = ~(a_bad | b_bad)
        if not self.spelled.all():
            a, b = a[np.repeat(self.spelled, self.n_a)], b[np.repeat(self.spelled, self.n_b)]
            self.n_a, self.n_b, sizes = self.n_a * self.spelled, self.n_b * self.spelled, sizes * self.spelled
        # All units one after the other: both sides spell the same bytes, so places agree.
        a_ends, b_ends = np.cumsum(a_width[a]), np.cumsum(b_width[b])
        unit_ends = np.cumsum(sizes)
        # Between two neighbouring ends lies a piece of one token of either side: a link.
        # No token is empty, so each end belongs to one token of a side and counting orders all.
        mark = np.zeros(int(sizes.sum()) + 1, np.uint8)
        mark[a_ends] = 1
        mark[b_ends] |= 2
        ends = np.flatnonzero(mark)
        mark = mark[ends]
        is_a, is_b, common = (mark & 1).astype(bool), mark > 1, mark == 3
        self.links = a[np.cumsum(is_a) - is_a] << 32 | b[np.cumsum(is_b) - is_b]
        self.n_links = np.diff(np.searchsorted(ends, unit_ends, "right"), prepend=0)
        self.n_groups = np.diff(np.searchsorted(ends[common], unit_ends, "right"), prepend=0)
        group = np.cumsum(common) - common
        self.listings = self._listings(a, b, group[is_a], group[is_b], _spellings(path_a, path_b), len(a_bytes), len(b_bytes))

    @staticmethod
    def _flat(lists, table, width, whole, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, how many each unit has, and which units their tokens do not spell."""
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = list(chain.from_iterable(lists))
        flat = np.array(ids, np.int64)
        ends = np.cumsum(np.concatenate(([0], width[flat])))
        stops = np.cumsum(counts)
        bad = ends[stops] - ends[stops - counts] != sizes
        if bad.any() or b"".join(map(table.__getitem__, ids)) != b"".join(whole):
            bad = np.array([b"".join(map(table.__getitem__, own)) != w for own, w in zip(lists, whole)])
        return flat, counts, bad

    def _listings(self, a, b, a_group, b_group, spellings, size_a, size_b) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each unit: tokens by group, first side first, each with the
        separator that follows it."""
        last_a, last_b = np.diff(a_group, append=-1) != 0, np.diff(b_group, append=-1) != 0
        # A token's place: its own side's earlier tokens and the other side's of earlier groups,
        # for the second side also those of its own group. Every group has tokens of both sides.
        a_until, b_until = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.concatenate(([0], b_until))[a_group]] = a + last_a * size_a
        code[np.arange(len(b)) + a_until[b_group]] = 2 * size_a + b + last_b * size_b
        parts = list(map(spellings.__getitem__, code.tolist()))
        stops = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(parts[x:y])[:-1] for x, y in zip([0, *stops], stops)]


def packed(values: np.ndarray, kind: str) -> bytes:
    """Unsigned numbers, compressed by byte planes."""
    width = np.dtype(kind).itemsize
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, width).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    width, n = np.dtype(kind).itemsize, int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


class Postings:
    """Bitmaps of the documents ``0 .. n_docs - 1`` of a chunk for each pair, by planes.

    ``pairs`` are sorted. Plane ``k`` of a pair holds the documents whose number of links has
    the binary digit ``k``. A plane of more than a sixteenth of the documents is a bit string,
    another one a sorted list of places, whichever is shorter.
    """

    def __init__(self, pairs, n_docs, plane_pair, plane_digit, plane_size, places, bits):
        self.pairs, self.n_docs = pairs, n_docs
        self.plane_pair, self.plane_digit, self.plane_size = plane_pair, plane_digit, plane_size
        self.places, self.bits = places, bits

    @classmethod
    def of(cls, pair: np.ndarray, doc: np.ndarray, links: np.ndarray, n_docs: int) -> Postings:
        """From ``(pair, doc, links)``, one entry for each pair and document, in any order."""
        pairs, number = np.unique(pair, return_inverse=True)
        found = []
        for digit in range(int(links.max(initial=0)).bit_length()):
            has = np.flatnonzero(links >> digit & 1)
            found.append(np.stack((number[has], np.full(len(has), digit), doc[has])))
        entries = np.concatenate([np.empty((3, 0), np.int64), *found], axis=1)
        entries = entries[:, np.lexsort((entries[2], entries[1], entries[0]))]
        key = entries[0] * 64 + entries[1]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(key)))
        dense = sizes > n_docs / 16
        per_entry = np.repeat(dense, sizes)
        row = np.repeat(np.cumsum(dense) - 1, sizes)[per_entry]
        bits = np.zeros((int(dense.sum()), -(-n_docs // 8)), np.uint8)
        at = entries[2][per_entry]
        np.bitwise_or.at(bits, (row, at >> 3), (1 << (at & 7)).astype(np.uint8))
        return cls(pairs, n_docs, entries[0][starts], entries[1][starts], sizes, entries[2][~per_entry], bits)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(number of the pair, doc, links)``, one entry for each, by merging the planes."""
        dense = self.plane_size > self.n_docs / 16
        planes = np.flatnonzero(dense)
        row, doc = np.nonzero(np.unpackbits(self.bits, axis=1, count=self.n_docs, bitorder="little"))
        plane = np.concatenate((planes[row], np.repeat(np.flatnonzero(~dense), self.plane_size[~dense]))).astype(np.int64)
        doc = np.concatenate((doc, self.places)).astype(np.int64)
        key, entry = np.unique(self.plane_pair[plane].astype(np.int64) * self.n_docs + doc, return_inverse=True)
        links = np.zeros(len(key), np.int64)
        np.add.at(links, entry, 1 << self.plane_digit[plane].astype(np.int64))
        return key // max(1, self.n_docs), key % max(1, self.n_docs), links

    def popcounts(self) -> tuple[np.ndarray, np.ndarray]:
        """For each pair the size of the OR of its planes, and its links by the planes' sizes."""
        number, _, _ = self.entries()
        links = np.zeros(len(self.pairs), np.int64)
        np.add.at(links, self.plane_pair.astype(np.int64), self.plane_size.astype(np.int64) << self.plane_digit.astype(np.int64))
        return np.bincount(number, minlength=len(self.pairs)), links

    def to_bytes(self) -> bytes:
        parts = [
            packed(np.diff(self.pairs, prepend=0), "<u8"), packed(np.diff(self.plane_pair, prepend=0), "<u4"),
            packed(self.plane_digit, "<u1"), packed(self.plane_size, "<u4"), packed(self.places, "<u2"),
            packed(self.bits.reshape(-1), "<u1"),
        ]
        return b"".join([self.n_docs.to_bytes(8, "little"), *(len(p).to_bytes(8, "little") + p for p in parts)])

    @classmethod
    def from_bytes(cls, data: bytes) -> Postings:
        n_docs, at, read = int.from_bytes(data[:8], "little"), 8, []
        for kind in ("<u8", "<u4", "<u1", "<u4", "<u2", "<u1"):
            size = int.from_bytes(data[at : at + 8], "little")
            read.append(unpacked(data[at + 8 : at + 8 + size], kind))
            at += 8 + size
        pairs, plane_pair = np.cumsum(read[0].astype(np.int64)), np.cumsum(read[1].astype(np.int64))
        return cls(pairs, n_docs, plane_pair, read[2], read[3].astype(np.int64), read[4], read[5].reshape(-1, -(-n_docs // 8) or 1))


CHUNKS = "chunk long, rows binary, postings binary, pair_a int, pair_b int, docs long, links long"


class _Codes(dict):
    """Numbers of units, given when they are first asked for; ``new`` lists those without alignment."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number


class _Chunk:
    """The documents of a chunk while they are read."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.codes = _Codes()
        self.units: list[Aligned] = []
        self.listing, self.spelled = [], []
        self.all_spelled = True
        self.ids, self.doc_units, self.digests = [], [], []

    def add(self, ids: list, texts: list[str], paths: tuple[str, str]) -> None:
        codes = self.codes
        cut = CUT.split if cuts_apply(*paths) else lambda text: [text]
        code = codes.__getitem__
        coded = [list(map(code, cut(t))) if t else [] for t in texts]
        if codes.new:
            found = Aligned(codes.new, *paths)
            codes.new = []
            self.listing += found.listings
            self.spelled += found.spelled.tolist()
            self.all_spelled &= bool(found.spelled.all())
            found.listings = []
            self.units.append(found)
        listed, spelled = self.listing.__getitem__, self.spelled.__getitem__
        for key, text, numbers in zip(ids, texts, coded):
            good = bool(numbers) and (self.all_spelled or all(map(spelled, numbers)))
            self.ids.append(key)
            self.doc_units.append(np.array(numbers if good else [], np.int32))
            self.digests.append(hashlib.sha256(";".join(map(listed, numbers)).encode()).hexdigest() if good else "")
            self.size += len(text)

    def full(self) -> bool:
        return self.size >= CHUNK_BYTES or len(self.ids) >= CHUNK_ROWS - 4096 or len(self.codes) >= CHUNK_UNITS

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The row of the chunk, and one for each of its pairs."""
        n_docs, n_units = len(self.ids), len(self.codes)
        sizes = np.array([len(u) for u in self.doc_units], np.int64)
        doc = np.repeat(np.arange(n_docs), sizes)
        code = np.concatenate([np.empty(0, np.int32), *self.doc_units]).astype(np.int64)
        none = np.empty(0, np.int64)

        def known(name: str) -> np.ndarray:
            return np.concatenate([none, *(getattr(part, name) for part in self.units)])

        sums = [np.bincount(doc, known(name)[code], n_docs).astype(np.int64) for name in ("n_a", "n_b", "n_groups")]
        key, often = np.unique(doc * max(1, n_units) + code, return_counts=True)
        doc, code = key // max(1, n_units), key % max(1, n_units)
        per_unit, flat = known("n_links"), known("links")
        at = (np.cumsum(per_unit) - per_unit)[code]
        reps = per_unit[code]
        take = np.repeat(at - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
        pairs, number = np.unique(flat, return_inverse=True)
        entry, inverse = np.unique(number[take] * max(1, n_docs) + np.repeat(doc, reps), return_inverse=True)
        links = np.zeros(len(entry), np.int64)
        np.add.at(links, inverse, np.repeat(often, reps))
        number, doc = entry // max(1, n_docs), entry % max(1, n_docs)
        postings = Postings.of(pairs[number], doc, links, n_docs)
        docs, total = postings.popcounts()
        kept = pa.RecordBatch.from_arrays(
            [pa.array(self.ids), *map(pa.array, sums), pa.array(np.bincount(doc, links, n_docs).astype(np.int64)), pa.array(self.digests, pa.string())],
            names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"],
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(kept)
        yield self._batch([sink.getvalue().to_pybytes()], [postings.to_bytes()], [None], [None], [None], [None])
        for start in range(0, len(postings.pairs), 50_000):
            part = slice(start, start + 50_000)
            own = postings.pairs[part]
            empty = [None] * len(own)
            yield self._batch(empty, empty, own >> 32, own & 0xFFFFFFFF, docs[part], total[part])

    def _batch(self, *columns) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number] * len(arrays[0]), pa.int64()), *arrays],
            names=["chunk", "rows", "postings", "pair_a", "pair_b", "docs", "links"],
        )


def chunked(df: DataFrame, paths: tuple[str, str], key: str, text: str) -> DataFrame:
    """Chunks of ``df`` and the pairs of each, see ``CHUNKS``."""
    source = df.select(quoted(key).alias("id"), quoted(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for part in slices(batches):
            chunk.add(part.column(0).to_pylist(), [decoded(t) for t in part.column(1).to_pylist()], paths)
            if chunk.full():
                yield from chunk.batches()
                number += 1
                chunk = _Chunk(number)
        if chunk.ids:
            yield from chunk.batches()
        del chunk
        release_memory()

    return source.mapInArrow(run, CHUNKS)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``(pair_a, pair_b, docs, links)``: documents and links of each pair in the whole corpus."""
    return chunks.filter("pair_a IS NOT NULL").groupBy("pair_a", "pair_b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))


def pair_scores(chunks: DataFrame) -> DataFrame:
    """``(of, pair_a, pair_b, docs, best)``: the corpus-wide counts of each pair of a chunk."""
    counts = pair_counts(chunks)
    highest = counts.groupBy("pair_a").agg(F.max("docs").alias("highest"))
    scored = counts.join(highest, "pair_a").select("pair_a", "pair_b", "docs", (F.col("docs") == F.col("highest")).alias("best"))
    n_chunks = chunks.filter("pair_a IS NULL").count()
    parts = max(1, -(-n_chunks // PART))
    asked = chunks.filter("pair_a IS NOT NULL").select("chunk", "pair_a", "pair_b", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("part"))
    spread = scored.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return asked.join(spread, ["pair_a", "pair_b", "part"]).select(F.col("chunk").alias("of"), "pair_a", "pair_b", "docs", "best")


def align(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: its key and ``ROW_FIELDS``."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = bucketed(chunked(df, (path_a, path_b), key, text), "chunk", buckets, "pairs")
    answers = pair_scores(chunks)
    id_field = df.select(quoted(key).alias("id")).schema.fields[0]
    schema = StructType([id_field, *StructType.fromDDL(ROW_FIELDS).fields])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        if not left.num_rows:
            raise ValueError("scores without their chunk")
        rows = pa.ipc.open_stream(left.column("rows")[0].as_py()).read_all()
        postings = Postings.from_bytes(left.column("postings")[0].as_py())
        pair = right.column("pair_a").to_numpy().astype(np.int64) << 32 | right.column("pair_b").to_numpy().astype(np.int64)
        order = np.argsort(pair)
        if not np.array_equal(pair[order], postings.pairs):
            raise ValueError("a chunk's pairs and scores differ")
        count = right.column("docs").to_numpy()[order]
        best = right.column("best").to_numpy()[order].astype(np.int64)
        number, doc, links = postings.entries()
        n = rows.num_rows
        n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(n_best, doc, links * best[number])
        np.add.at(count_sum, doc, links * count[number])
        made = {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
        columns = [made[f.name] if f.name in made else rows.column(f.name).combine_chunks() for f in kinds]
        release_memory()
        return pa.table([c.cast(f.type) for c, f in zip(columns, kinds)], schema=kinds)

    asked = chunks.filter("pair_a IS NULL").select("chunk", "rows", "postings")
    joined = asked.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(assemble, schema)
    return joined.select(F.col("id").alias(key), *(f.name for f in schema.fields[1:]))
