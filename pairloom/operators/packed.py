"""Weights and scores of exact terms from packed postings, which cross the network once.

Term lists are far larger than the text they come from. Here a term is a fingerprint of 64 bits
and of its bucket's bits, and postings travel as packed arrays instead of rows of strings:

    words -> fingerprints, counted in the row -> packed by (part, step) -> one shuffle by part
          -> a step sorts its fingerprints: document frequency, weight, squares summed per document
          -> one row per (part, range of documents): sums, postings of asked terms -> shuffle by range
          -> norms and scores of a range, against the asked terms and their queries

A part holds all postings of its terms and a step is a slice of it, so memory follows a step and
the documents of the catalog. Documents are known by a fingerprint of their id; rows that share an
id are one document, as they are for a grouping. Two terms or ids would have to agree in all bits
to be taken for one: for ids this is an error, for a billion terms the odds are 1 in 30,000.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Parts of the terms, which are tasks at most, and steps of a part, which bound its memory.
PARTS = 64
STEPS = 16
# Ranges of documents that are scored one after the other.
RANGES = 256
# Cells and products that are held at a time.
CELLS = 2_000_000

_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# ---------------------------------------------------------------- arrays


def round_half_up(values: np.ndarray, decimals: int) -> np.ndarray:
    """Rounds halves away from zero, as Spark's ``round`` does."""
    scale = 10.0**decimals
    return np.copysign(np.floor(np.abs(values) * scale + 0.5) / scale, values)


def pack(**columns) -> bytes:
    arrays = [column if isinstance(column, pa.Array) else pa.array(column) for column in columns.values()]
    batch = pa.RecordBatch.from_arrays(arrays, names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(body: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(body.as_buffer()).read_next_batch()


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs ``start .. start + size``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


# ---------------------------------------------------------------- fingerprints


def prints(names: list) -> np.ndarray:
    """128 bits of each string as two numbers; a missing one has bits of its own."""
    digest = (blake2b(b"" if n is None else n.encode(), digest_size=16, key=b"" if n is not None else b"missing").digest() for n in names)
    return np.frombuffer(b"".join(digest), dtype="<u8").astype(np.uint64).reshape(-1, 2)


def _mixed(bits: np.ndarray) -> np.ndarray:
    bits = (bits ^ (bits >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = (bits ^ (bits >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return bits ^ (bits >> np.uint64(31))


def pair_prints(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Bits of the phrases of two words, of which the order counts."""
    return _mixed(first * _FIRST + _mixed(second + _SECOND))


def term_prints(terms: list[str], ngrams: bool) -> np.ndarray:
    """Bits of terms as they are spelled; words hold no underscore, so a phrase falls apart again."""
    if not ngrams:
        return prints(terms)
    words = [term[2:].split("_") for term in terms]
    found = prints([w[0] for w in words])
    pairs = np.flatnonzero([len(w) == 2 for w in words])
    found[pairs] = pair_prints(found[pairs], prints([words[at][1] for at in pairs]))
    return found


def count_prints(words: pa.ListArray, ngrams: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bits and count of the distinct terms of each row, in the order of the rows."""
    owners = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0))
    coded = words.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy().astype(np.int64), prints(coded.dictionary.to_pylist())
    known = len(names)
    span = max(known + known * known if ngrams else known, 1)
    found = owners * span + codes
    if ngrams:
        pairs = np.flatnonzero(owners[1:] == owners[:-1])
        found = np.append(found, owners[pairs] * span + known + codes[pairs] * known + codes[pairs + 1])
    found, counts = np.unique(found, return_counts=True)
    owners, places = np.divmod(found, span)
    bits = np.empty((len(places), 2), np.uint64)
    single = places < known
    bits[single] = names[places[single]]
    if ngrams:
        first, second = np.divmod(places[~single] - known, max(known, 1))
        bits[~single] = pair_prints(names[first], names[second])
    return owners, bits, counts


def buckets(bits: np.ndarray, parts: int) -> np.ndarray:
    """The part and step of a term, as one number."""
    return (bits[:, 1] >> np.uint64(65 - (parts * STEPS).bit_length())).astype(np.int64)


# ---------------------------------------------------------------- what queries ask for


@dataclass
class Asked:
    """The terms of all queries in the order of their buckets and bits, and who asks for them.

    ``starts`` and ``queries`` list the queries of each term, ``counts`` how often they say it.
    """

    ids: list
    bits: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    queries: np.ndarray
    counts: np.ndarray

    @staticmethod
    def build(terms: pa.Table, ngrams: bool, parts: int) -> "Asked":
        """From ``(source_id, term, tf)``."""
        owners = terms.column("source_id").combine_chunks().dictionary_encode(null_encoding="encode")
        names = terms.column("term").combine_chunks().dictionary_encode()
        bits = term_prints(names.dictionary.to_pylist(), ngrams)
        bucket = buckets(bits, parts)
        order = np.lexsort((bits[:, 0], bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        asked = place[names.indices.to_numpy()]
        rows = np.argsort(asked, kind="stable")
        return Asked(
            ids=owners.dictionary.to_pylist(),
            bits=bits[order, 0],
            bounds=np.searchsorted(bucket[order], np.arange(parts * STEPS + 1)),
            starts=np.searchsorted(asked[rows], np.arange(len(order) + 1)),
            queries=owners.indices.to_numpy()[rows].astype(np.int64),
            counts=terms.column("tf").to_numpy()[rows],
        )

    def weights(self, idf: np.ndarray) -> np.ndarray:
        """Weight of each query's terms, scaled to queries of length one; NaN where a term is unknown
        or the query has no direction."""
        weight = self.counts * np.repeat(idf, np.diff(self.starts))
        known = ~np.isnan(weight)
        norms = np.sqrt(np.bincount(self.queries[known], weight[known] ** 2, len(self.ids)))
        return weight / np.where(norms > 0, norms, np.nan)[self.queries]


# ---------------------------------------------------------------- the two passes


def packed_postings(words: DataFrame, ngrams: bool, parts: int, cut) -> DataFrame:
    """``(part, step, batch, docs, body)`` of rows of ``source_id`` and ``terms``.

    A batch of rows gives each part one table of its documents (step -1) and the postings of each
    step that has any. One of the parts also gets the ids as they are spelled.
    """
    schema = StructType.fromDDL("part int, step int, batch bigint, docs binary, body binary")
    output = to_arrow_schema(schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in cut(whole):
                owners, bits, counts = count_prints(batch.column("terms"), ngrams)
                ids = batch.column("source_id")
                docs = prints(ids.to_pylist())[:, 0]
                table, spelled = pack(doc=docs), pack(doc=docs, name=ids)
                rows = [(part, -1, at, table, spelled if part == at % parts else None) for part in range(parts)]
                bucket = buckets(bits, parts)
                order = np.argsort(bucket.astype(np.uint16) if parts * STEPS <= 1 << 16 else bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(parts * STEPS + 1))
                term, doc, tf = bits[order, 0], owners[order].astype(np.uint32), counts[order].astype(np.uint32)
                for step, (a, b) in enumerate(pairwise(edges)):
                    if a < b:
                        body = pack(term=term[a:b], doc=np.diff(doc[a:b], prepend=np.uint32(0)), tf=tf[a:b])
                        rows.append((*divmod(step, STEPS), at, None, body))
                at += 1
                columns = [pa.array(column, field.type) for column, field in zip(zip(*rows), output)]
                yield pa.RecordBatch.from_arrays(columns, schema=output)

    return words.mapInArrow(packed, schema)


class _Part:
    """The documents and sums of one part, filled step by step."""

    def __init__(self, part: int, asked: Asked, least: int):
        self.part, self.asked, self.least = part, asked, least
        self.tables, self.names, self.rows, self.docs = {}, [], 0, None
        self.entries, self.known = [], []

    def add_table(self, batch: int, docs: pa.Scalar, spelled: pa.Scalar) -> None:
        self.tables[batch] = numbers(unpack(docs), "doc")
        if spelled.is_valid:
            self.names.append(unpack(spelled))

    def open(self) -> None:
        parts = list(self.tables.values())
        self.rows = sum(map(len, parts))
        self.docs, place = np.unique(np.concatenate(parts), return_inverse=True)
        cuts = np.cumsum([0, *map(len, parts)])
        self.tables = {batch: place[a:b] for batch, (a, b) in zip(self.tables, pairwise(cuts))}
        self.squares = np.zeros(len(self.docs))

    def step(self, step: int, bodies: list[tuple[int, pa.RecordBatch]]) -> None:
        """Weights of all terms of one step."""
        if self.docs is None:
            self.open()
        terms = np.concatenate([numbers(body, "term") for _, body in bodies])
        docs = np.concatenate([self.tables[batch][np.cumsum(numbers(body, "doc"), dtype=np.int64)] for batch, body in bodies])
        tf = np.concatenate([numbers(body, "tf") for _, body in bodies])
        order = np.argsort(terms)
        terms = terms[order]
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        df = np.diff(np.append(first, len(terms)))
        known = df >= self.least
        idf = np.where(known, np.log((self.rows + 1) / (df + 1)), 0.0)
        weight = tf[order] * np.repeat(idf, df)
        self.squares += np.bincount(docs[order], weight * weight, len(self.docs))
        bucket = self.part * STEPS + step
        a, b = self.asked.bounds[bucket], self.asked.bounds[bucket + 1]
        wanted, distinct = self.asked.bits[a:b], terms[first]
        at = np.minimum(np.searchsorted(distinct, wanted), len(distinct) - 1)
        found = np.flatnonzero((distinct[at] == wanted) & known[at])
        if len(found):
            at, found = at[found], found + a
            self.known.append((found, df[at]))
            postings = order[spans(first[at], df[at])]
            self.entries.append((docs[postings], np.repeat(found, df[at]), tf[postings]))

    def results(self) -> Iterator[tuple]:
        """``(range, rows, sums, entries, names, frequencies)``."""
        if self.docs is None:
            self.open()
        empty = (np.empty(0, np.int64),) * 3
        docs, terms, tf = (np.concatenate(column) for column in zip(empty, *self.entries))
        order = np.argsort(docs, kind="stable")
        docs, terms, tf = docs[order], terms[order].astype(np.uint32), tf[order].astype(np.uint32)
        edges = np.searchsorted(self.docs, np.arange(RANGES, dtype=np.uint64) << np.uint64(56))
        for at, (a, b) in enumerate(pairwise([*edges, len(self.docs)])):
            start, stop = np.searchsorted(docs, (a, b))
            here = np.zeros(b - a, bool)
            here[docs[start:stop] - a] = True
            here |= self.squares[a:b] > 0
            if here.any():
                place = np.cumsum(here) - 1
                sums = pack(doc=self.docs[a:b][here], square=self.squares[a:b][here])
                steps = np.diff(place[docs[start:stop] - a], prepend=0).astype(np.uint32)
                yield at, None, sums, pack(doc=steps, term=terms[start:stop], tf=tf[start:stop]), None, None
        if self.names:
            names = pa.Table.from_batches(self.names)
            owners = names.column("doc").to_numpy() >> np.uint64(56)
            for at in np.unique(owners):
                own = names.filter(pa.array(owners == at)).combine_chunks()
                yield int(at), None, None, None, pack(**{c: own.column(c).combine_chunks() for c in own.column_names}), None
        known = [np.concatenate(column) for column in zip((np.empty(0, np.int64),) * 2, *self.known)]
        yield -1, self.rows, None, None, None, pack(term=known[0], df=known[1])


def weigh(postings: DataFrame, asked: Asked, least: int, parts: int, tasks: int) -> DataFrame:
    """``(range, rows, sums, entries, names, frequencies)``: squares and asked postings of each part by
    ranges of documents; what is known of the catalog and the asked terms stands in range -1."""
    schema = StructType.fromDDL("range int, rows bigint, sums binary, entries binary, names binary, frequencies binary")
    output = to_arrow_schema(schema)
    shared = postings.sparkSession.sparkContext.broadcast(vars(asked))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, part, step, bodies = Asked(**shared.value), None, None, []

        def closed() -> Iterator[pa.RecordBatch]:
            if bodies:
                part.step(step, bodies)
            for rows in batched(part.results(), 32):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), output)], schema=output)

        for batch in batches:
            for of, at, number, docs, body in zip(*(batch.column(c) for c in ("part", "step", "batch", "docs", "body"))):
                of, at = of.as_py(), at.as_py()
                if part is None or of != part.part:
                    if part is not None:
                        yield from closed()
                    part, step, bodies = _Part(of, terms, least), None, []
                if at < 0:
                    part.add_table(number.as_py(), docs, body)
                    continue
                if at != step and bodies:
                    part.step(step, bodies)
                    bodies = []
                step = at
                bodies.append((number.as_py(), unpack(body)))
        if part is not None:
            yield from closed()

    dealt = postings.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part", "step")
    return dealt.mapInArrow(weighed, schema)


class Highest:
    """The best K documents per query seen so far in one task, by score and then by id.

    The one document without an id is always handed on.
    """

    def __init__(self, queries: int, top_k: int):
        self.top_k, self.found, self.held, self.kept = top_k, [], 0, 0
        self.floor = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, names: np.ndarray, score: np.ndarray) -> None:
        near = (score >= self.floor[query]) | np.equal(names, None).astype(bool)
        self.found.append((query[near], names[near], score[near]))
        self.held += int(near.sum())
        if self.held > max(CELLS, 2 * self.kept):
            query, names, score = self.rows()
            self.found, self.held, self.kept = [(query, names, score)], len(query), len(query)
            own = ~np.equal(names, None).astype(bool)
            full = np.bincount(query[own], minlength=len(self.floor)) >= self.top_k
            lowest = np.full(len(self.floor), np.inf)
            np.minimum.at(lowest, query[own], score[own])
            self.floor[full] = lowest[full]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        empty = (np.empty(0, np.int64), np.empty(0, object), np.empty(0))
        query, names, score = (np.concatenate(column) for column in zip(empty, *self.found))
        lone = np.equal(names, None).astype(bool)
        extra = (query[lone], names[lone], score[lone])
        query, names, score = query[~lone], names[~lone], score[~lone]
        order = np.lexsort((-score, query))
        query, names, score = query[order], names[order], score[order]
        # Only a query's rows down to its K-th score are compared by id.
        first = np.searchsorted(query, query)
        last = np.minimum(first + self.top_k, np.searchsorted(query, query, "right")) - 1
        near = score >= score[last]
        query, names, score = query[near], names[near], score[near]
        order = np.lexsort((names, -score, query))
        query, names, score = query[order], names[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.top_k
        return tuple(np.concatenate(column) for column in zip((query[keep], names[keep], score[keep]), extra))


def _documents(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and norms of a range, and document, term and count of its asked postings by document."""
    spelled = pa.Table.from_batches([unpack(row["names"]) for row in rows if row["names"].is_valid])
    spelled = spelled.group_by(["doc", "name"]).aggregate([])
    bits, ids = spelled.column("doc").to_numpy(), np.array(spelled.column("name").to_pylist(), dtype=object)
    order = np.argsort(bits)
    bits, ids = bits[order], ids[order]
    if (bits[1:] == bits[:-1]).any():
        raise ValueError("two document ids have one fingerprint")
    squares, entries = np.zeros(len(bits)), [(np.empty(0, np.int64),) * 3]
    for row in rows:
        if row["sums"].is_valid:
            sums, found = unpack(row["sums"]), unpack(row["entries"])
            place = np.searchsorted(bits, numbers(sums, "doc"))
            squares[place] += numbers(sums, "square")
            entries.append((place[np.cumsum(numbers(found, "doc"), dtype=np.int64)], numbers(found, "term"), numbers(found, "tf")))
    docs, terms, tf = (np.concatenate(column) for column in zip(*entries))
    order = np.argsort(docs, kind="stable")
    return ids, np.sqrt(squares), docs[order], terms[order].astype(np.int64), tf[order]


def scored(weighed: DataFrame, asked: Asked, idf: np.ndarray, decimals: int, tasks: int, top_k: int | None = None) -> DataFrame:
    """``(query_id, document_id, score)`` of all pairs that share a weighted term, or of those of a
    task that may be among a query's ``top_k``. ``idf`` is NaN for terms without weight."""
    schema = StructType.fromDDL("query_id string, document_id string, score double")
    output = to_arrow_schema(schema)
    shared = weighed.sparkSession.sparkContext.broadcast((vars(asked), idf, asked.weights(idf)))
    bare = bool((idf == 0).any())

    def pairs(rows: list[dict], terms: Asked, idf: np.ndarray, weights: np.ndarray):
        """Query, id and score of the pairs of a range, some documents at a time."""
        ids, norms, docs, term, tf = _documents(rows)
        weight = tf * idf[term] / np.where(norms > 0, norms, np.nan)[docs]
        some = ~np.isnan(weight)
        docs, term, weight = docs[some], term[some], weight[some]
        sizes, width = np.diff(terms.starts)[term], len(terms.ids)
        starts = np.searchsorted(docs, np.arange(len(ids) + 1))
        made = np.append(0, np.cumsum(sizes))[starts]
        a = 0
        while a < len(ids):
            b = min(a + CELLS // max(width, 1), int(np.searchsorted(made, made[a] + CELLS, "right")) - 1)
            b = min(max(b, a + 1), len(ids))
            here = slice(starts[a], starts[b])
            runs = sizes[here]
            picked = spans(terms.starts[term[here]], runs)
            products = np.repeat(weight[here], runs) * weights[picked]
            cells = np.repeat(docs[here] - a, runs) * width + terms.queries[picked]
            known = ~np.isnan(products)
            products, cells = products[known], cells[known]
            found = np.bincount(cells, products, (b - a) * width)
            # A shared term weighs nothing if all documents have it; the pair counts all the same.
            hit = np.flatnonzero(np.bincount(cells, minlength=len(found)) if bare else found)
            row, query = np.divmod(hit, width)
            yield query, ids[a:b][row], round_half_up(found[hit], decimals)
            a = b

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, idf, weights = shared.value
        terms = Asked(**fields)
        names = pa.array(terms.ids, pa.string())
        best = None if top_k is None else Highest(len(terms.ids), top_k)

        def batch_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(ids, pa.string()), pa.array(score)], schema=output)

        def closed(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            for found in pairs(rows, terms, idf, weights) if rows else ():
                if best is None:
                    yield batch_of(*found)
                else:
                    best.add(*found)

        at, rows = None, []
        for batch in batches:
            for of, *cells in zip(*(batch.column(c) for c in ("range", "sums", "entries", "names"))):
                if of.as_py() != at:
                    yield from closed(rows)
                    at, rows = of.as_py(), []
                rows.append(dict(zip(("sums", "entries", "names"), cells)))
        yield from closed(rows)
        if best is not None:
            yield batch_of(*best.rows())

    some = weighed.filter("range >= 0").select("range", "sums", "entries", "names")
    return some.repartitionById(tasks, F.col("range") % tasks).sortWithinPartitions("range").mapInArrow(score, schema)


def frequencies(weighed: DataFrame, asked: Asked) -> np.ndarray:
    """The idf of every asked term, NaN where it has no weight."""
    found = weighed.filter("range < 0").select("rows", "frequencies").toArrow()
    idf = np.full(len(asked.bits), np.nan)
    for rows, body in zip(found.column("rows"), found.column("frequencies")):
        known = unpack(body)
        idf[numbers(known, "term")] = np.log((rows.as_py() + 1) / (numbers(known, "df") + 1))
    return idf
