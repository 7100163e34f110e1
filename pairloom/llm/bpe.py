"""Byte-level BPE by a global distinct-word shuffle, and its decoding.

1. Texts are cut into pre-tokens, vectorised over blocks of texts. A chunk (about
   ``CHUNK_BYTES`` of consecutive rows of one task) becomes its list of distinct words and,
   for each position, the number of its word: the exploded (position, word) rows in
   dictionary form, so a word travels once per chunk and not once per occurrence.
2. Words that are one token resolve by the rank table at once. All other words of all
   chunks are hashed into buckets and shuffled, and every distinct word of a bucket is
   merged once, whichever chunks it came from.
3. The ids go back to the chunks and are put together by position.
4. Decoding looks every id up in the token-byte table (of fixed size) and joins the bytes.

Chunks are written to the shared folder before they are asked about, so a lost executor
cannot renumber them, and in buckets by chunk, so only ids move to them at the end.

Defined cases: null and empty texts have no tokens; invalid UTF-8 counts as U+FFFD; texts are never cut, whatever their length; repeated rows are encoded
each; columns to keep may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from pairloom.llm.common import bucketed, quoted, release_memory

CHUNK_BYTES = 32 << 20
BLOCK_BYTES = 2 << 20
# Words whose ids a task remembers.
KNOWN_WORDS = 1_000_000
OUTPUTS = {
    "n_tokens": "long", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string",
}
OTHER, LETTER, NUMBER, SPACE, END = range(5)


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file and their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: start offsets by id (one more than ids) and all bytes."""
    table = ranks(path)
    size = max(table.values()) + 1
    by_id = [b""] * size
    for token, rank in table.items():
        by_id[rank] = token
    return np.concatenate(([0], np.cumsum([len(t) for t in by_id]))), np.frombuffer(b"".join(by_id), np.uint8)


@lru_cache(1)
def _classes() -> np.ndarray:
    """For each code point the class that the pre-token pattern tells apart.

    The library itself is asked, as its tables may be of another Unicode version: with only
    single bytes as tokens and a class as its pattern it keeps just the points of that class.
    """
    out = np.zeros(0x110000, np.uint8)
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(own.encode_ordinary(points)).decode("utf-8")
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def pretoken_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks each code point at which a pre-token starts; ``ends`` are separators.

    The same cuts as ``public_tokenizers.PATTERN`` makes in each text between separators.
    """
    kind = _classes()[codes]
    kind[ends] = END
    n = len(codes)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start[ends] = True
    # The last white space before anything else is cut off; a plain space joins what follows.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    # Contractions: an apostrophe that starts a pre-token, and the letters right after it.
    quotes = np.flatnonzero((codes == 39) & start)
    quotes = quotes[quotes + 1 < n]
    padded = np.concatenate((codes, [0, 0]))
    one = np.isin(padded[quotes + 1], [ord(c) for c in "stmd"])
    pairs = padded[quotes + 1].astype(np.int64) << 32 | padded[quotes + 2]
    two = np.isin(pairs, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
    for at, width in ((quotes[one], 1), (quotes[two], 2)):
        start[at + 1] = False
        after = at + 1 + width
        after = after[after < n]
        start[after[kind[after] == LETTER]] = True
    return start


def only_known_pattern(pattern: str) -> None:
    """Cuts are made by character classes, which hold for one pattern alone."""
    if pattern != public_tokenizers.PATTERN:
        raise ValueError("pre-tokens can only be cut by public_tokenizers.PATTERN")


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in blocks of ``BLOCK_BYTES`` code points or one text."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= BLOCK_BYTES):
            size += len(texts[stop])
            stop += 1
        yield texts[at:stop]
        at = stop


def pre_tokens(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of ``texts`` as one binary array, and how many each text has."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = np.flatnonzero(pretoken_starts(codes, ends))
    widths = 1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int32) + (codes > 0xFFFF)
    offsets = np.concatenate(([0], np.cumsum(widths)))
    cuts = np.append(offsets[starts], offsets[-1]).astype(np.int32)
    data = joined.encode("utf-8", "surrogatepass")
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    closing = np.searchsorted(starts, ends)  # the separators are pre-tokens of their own
    counts = np.diff(np.concatenate(([-1], closing))) - 1
    kept = np.ones(len(starts), bool)
    kept[closing] = False
    return words.filter(pa.array(kept)), counts


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers below 2**32, compressed by byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b""


def _unpack(packed: bytes) -> np.ndarray:
    if not packed:
        return np.empty(0, np.int64)
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _pack_words(words: list[bytes]) -> bytes:
    data = b"".join(words)
    lengths = _pack(np.array([len(w) for w in words]))
    return len(lengths).to_bytes(8, "little") + lengths + len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpack_words(packed: bytes) -> list[bytes]:
    size = int.from_bytes(packed[:8], "little")
    cuts = np.concatenate(([0], np.cumsum(_unpack(packed[8 : 8 + size])))).tolist()
    length = int.from_bytes(packed[8 + size : 16 + size], "little")
    data = pa.decompress(packed[16 + size :], length, "zstd", asbytes=True)
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


CHUNKS = "chunk long, bucket int, kept binary, counts binary, codes binary, words binary"


def _chunk_rows(chunk: int, rows: list[pa.RecordBatch], words: list[pa.Array], counts: list[np.ndarray], table: dict, buckets: int):
    """The row of a chunk (null bucket) and one row of asked words for each bucket."""
    coded = pa.chunked_array(words, pa.binary()).dictionary_encode().unify_dictionaries().combine_chunks()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.chunk(0) if coded.num_chunks else pa.array([], pa.binary()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    code_of = np.array([table.get(w, -1) for w in distinct], np.int64)
    unknown = np.flatnonzero(code_of < 0).tolist()
    unknown.sort(key=lambda i: (zlib.crc32(distinct[i]) % buckets, distinct[i]))
    # A word that is no token gets the number of its place in the asked words, after all ids.
    code_of[unknown] = max(table.values()) + 1 + np.arange(len(unknown))
    codes = code_of[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in rows:
            out.write_batch(batch)
    yield chunk, None, sink.getvalue().to_pybytes(), _pack(np.concatenate(counts)), _pack(codes), None
    at = 0
    while at < len(unknown):
        bucket, stop = zlib.crc32(distinct[unknown[at]]) % buckets, at
        while stop < len(unknown) and zlib.crc32(distinct[unknown[stop]]) % buckets == bucket:
            stop += 1
        yield chunk, bucket, None, None, None, _pack_words([distinct[i] for i in unknown[at:stop]])
        at = stop


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)],
        names=["chunk", "bucket", "kept", "counts", "codes", "words"],
    )


def chunked(df: DataFrame, text: str, path: str, buckets: int) -> DataFrame:
    """Chunks of ``df`` and their asked words, see ``CHUNKS``."""
    source = df.select(*(quoted(c) for c in df.columns if c != text), quoted(text).cast("binary").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = ranks(path), TaskContext.get().partitionId() << 32
        rows, words, counts, size = [], [], [], 0
        for batch in batches:
            texts = ["" if t is None else t.decode("utf-8", "replace") for t in batch.column(batch.num_columns - 1).to_pylist()]
            slim = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema([batch.schema.field(i) for i in range(batch.num_columns - 1)])) if batch.num_columns > 1 else pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows)], names=["-"])
            at = 0
            for block in blocks(texts):
                found, n = pre_tokens(block)
                rows.append(slim.slice(at, len(block)))
                words.append(found)
                counts.append(n)
                size += found.nbytes
                at += len(block)
                if size >= CHUNK_BYTES:
                    for row in _chunk_rows(number, rows, words, counts, table, buckets):
                        yield _record([row])
                    rows, words, counts, size, number = [], [], [], 0, number + 1
        if rows:
            for row in _chunk_rows(number, rows, words, counts, table, buckets):
                yield _record([row])
        rows, words, counts = [], [], []
        release_memory()

    return source.mapInArrow(run, CHUNKS)


def merged_words(asked: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """``(chunk, bucket, lengths, ids)``: the ids of the words of each row of ``asked``.

    All rows of a bucket meet in one task, which merges each distinct word once, or once
    more after ``KNOWN_WORDS`` others, so its memory does not grow with the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, known = encoding(path, pattern)._core_bpe.encode_single_piece, {}
        for batch in batches:
            for chunk, bucket, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = []
                for word in _unpack_words(packed):
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        ids = known[word] = np.array(merge(word), "<u4").tobytes()
                    found.append(ids)
                lengths = np.array([len(i) // 4 for i in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_pack(lengths)], pa.binary()), pa.array([_pack(np.frombuffer(b"".join(found), "<u4"))], pa.binary())],
                    names=["chunk", "bucket", "lengths", "ids"],
                )

    rows = asked.select("chunk", "bucket", "words").repartition(buckets, "bucket")
    return rows.mapInArrow(run, "chunk long, bucket int, lengths binary, ids binary")


def _gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The slices ``flat[start : start + length]`` one after the other."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The bytes that ``ids`` stand for, by the token-byte table."""
    offsets, flat = token_bytes(path)
    return _gather(offsets[ids], offsets[ids + 1] - offsets[ids], flat).tobytes()


def _put_together(counts, codes, lengths, ids, path: str, outputs: tuple[str, ...]) -> dict[str, list]:
    """The outputs of every row of a chunk, a bounded block of rows at a time."""
    size = max(ranks(path).values()) + 1
    all_lengths = np.concatenate((np.ones(size, np.int64), lengths))
    flat = np.concatenate((np.arange(size), ids))
    starts = np.cumsum(all_lengths) - all_lengths
    stops = np.cumsum(counts)
    out: dict[str, list] = {name: [] for name in outputs}
    row = 0
    while row < len(counts):
        base = int(stops[row] - counts[row])
        last = max(row + 1, int(np.searchsorted(stops, base + 200_000, "right")))
        block = codes[base : int(stops[last - 1])]
        per_word = all_lengths[block]
        tokens = _gather(starts[block], per_word, flat)
        cuts = np.concatenate(([0], np.cumsum(per_word)))[np.concatenate(([0], stops[row:last] - base))]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = tokens[a:b]
            text = decode_ids(own, path) if "decoded" in out or "decoded_sha256" in out else b""
            for name, values in out.items():
                if name == "n_tokens":
                    values.append(b - a)
                elif name == "ids":
                    values.append(own.astype(np.int32))
                elif name == "ids_sha256":
                    values.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                else:
                    values.append(text if name == "decoded" else hashlib.sha256(text).hexdigest())
        row = last
    return out


def encode_decode(
    df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), buckets: int | None = None,
) -> DataFrame:
    """One row for each row of ``df``: the columns ``keep`` and ``outputs``, see ``OUTPUTS``.

    ``ids`` equal those of the tiktoken library without special tokens; ``decoded`` is read
    back from the ids. ``buckets`` defaults to the session's shuffle partitions.
    """
    only_known_pattern(pattern)
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"c{i}" for i in range(len(keep))]
    slim = df.select(*(quoted(c).alias(n) for c, n in zip(keep, names)), quoted(text).cast("binary").alias("text"))
    chunks = bucketed(chunked(slim, "text", path, buckets), "chunk", buckets, "chunks")
    answers = merged_words(chunks.filter("bucket IS NOT NULL"), path, pattern, buckets)
    schema = StructType([*slim.select(*names).schema.fields, *StructType.fromDDL(", ".join(f"o_{o} {OUTPUTS[o]}" for o in outputs)).fields])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        if not left.num_rows:
            raise ValueError("ids without their chunk")
        counts, codes = (_unpack(left.column(name)[0].as_py()) for name in ("counts", "codes"))
        parts = sorted(zip(*(right.column(name).to_pylist() for name in ("bucket", "lengths", "ids"))))
        lengths, ids = (np.concatenate([np.empty(0, np.int64), *(_unpack(p[i]) for p in parts)]) for i in (1, 2))
        rows = pa.ipc.open_stream(left.column("kept")[0].as_py()).read_all()
        made = _put_together(counts, codes, lengths, ids, path, outputs)
        columns = [rows.column(i).combine_chunks().cast(kinds.types[i]) for i in range(len(names))]
        columns += [pa.array(made[o], kind) for o, kind in zip(outputs, kinds.types[len(names):])]
        del made, codes, ids, lengths
        release_memory()
        return pa.table(columns, schema=kinds)

    asked = chunks.filter("bucket IS NULL").select("chunk", "kept", "counts", "codes")
    joined = asked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(assemble, schema)
    return joined.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), *(F.col(f"o_{o}").alias(o) for o in outputs))
