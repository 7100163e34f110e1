"""Near-duplicate groups by SetSketch registers, banding and joint estimation.

A text's set holds its distinct shingles of ``size`` words (ASCII letters in lower case; fewer
words: the whole sequence), each as a 64-bit hash. Texts link if 100 x intersection is at
least ``least`` x union.

Registers: register i keeps the smallest of the exponential values that its hash gives the
shingles, as an exponent: floor(1 - log_b(value)), truncated to 16 bits. Registers of a union
are the maxima of the registers, and equal registers tell of similarity: with b = 1.001 two
registers agree with a probability close to the Jaccard similarity J.

Search: ``BANDS`` bands of ``ROWS`` registers; texts that agree in a band are candidates. At
J = 0.8 a pair is no candidate with probability (1 - 0.8^5)^36 = 6e-7, closer ones more
rarely. For candidates J is estimated jointly: the numbers of registers where the one is
larger, the other is larger or both agree have a likelihood under J and both set sizes. A
pair is dropped where its greatest likelihood exceeds that of every J from the threshold on
by ``SLACK`` in logarithm (a linked pair falls there with probability 2e-8); all others are
verified on their full sets.

Groups: equal sets are one node. In a round every bucket names a leader, other members are
tested against it, linked ones are joined, and buckets inside one group are done: a group of
near copies costs its size, not its square. When the pairs still open are no more than
``OPEN`` times the members, or rounds no longer bring them down, they are compared by blocks:
the registers of an open bucket come to it once, members without a plausible partner drop
out, the sets of the others come to it once, and a block hands on only the links that join
its groups. A pair belongs to the first band in which it agrees. Buckets of more than
``PART`` members are dealt into pairs of parts.

Defined cases: null, empty and blank texts have an empty set and link with nothing; copies
and repeated rows are one node; a null id takes part and is never the smallest id; texts of
any length are read whole; other columns are not read; an empty table gives no rows. Nodes
are named by a 64-bit hash of the whole set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import quoted, release_memory, slices, with_arrow_columns, written
from pairloom.llm.simhash import SEED, components

SHINGLE = 4
LEAST = 80  # percent
BANDS, ROWS = 36, 5
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
SLACK = 15.0
PART = 1500
# Registers that are compared before all others, and pairs that are estimated at a time.
FIRST = 32
CHECKED = 20_000
OPEN = 8
ROUNDS = 2
# Words whose hash a task remembers, if they have at most so many bytes.
KNOWN_WORDS, KNOWN_BYTES = 500_000, 64
_RANDOM = np.random.default_rng(SEED)
_FACTORS, _SHIFTS = _RANDOM.integers(0, 1 << 32, (2, REGISTERS), np.uint32)
_FACTORS = _FACTORS | np.uint32(1)
_PLACES = _RANDOM.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


class _Words(dict):
    """Hashes of words, looked up or made; forgets all of them when there are too many."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= KNOWN_BYTES:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = found
        return found


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a UTF-8 text as 64-bit hashes, sorted."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    sums = np.full(n, size, np.uint64)
    for k in range(size):
        sums += hashed[k : k + n] * _PLACES[k]
    return np.unique(_mixed(sums))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512, None] * _FACTORS + _SHIFTS).min(0), out=least)
    value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def _differs(share: np.ndarray) -> np.ndarray:
    """Probability that a register is larger on the side that alone has ``share`` of the union."""
    return -np.log1p(-np.maximum(share, 0) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j, size_a, size_b, more, less, same):
    """Of similarity ``j``, given both set sizes and how many registers are larger, smaller, equal."""
    u = size_a / (size_a + size_b)
    p, q = _differs(u - (1 - u) * j), _differs((1 - u) - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0.0) for n, x in ((more, p), (less, q), (same, 1 - p - q))]
    return sum(parts)


def estimates(size_a, size_b, more, less, same, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest similarity of each pair, and by how much it beats the likeliest one that links."""
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    bound, limit = low / high, least / 100
    best, best_j = np.full(len(low), -np.inf), np.zeros(len(low))
    linked = np.full(len(low), -np.inf)
    for step in np.linspace(0, 1, 21):
        for j, links in ((np.minimum(limit, bound) * step, bound * 100 >= least if step == 1 else False), (limit + (bound - limit) * step, bound * 100 >= least)):
            j = np.clip(j, 0, bound)
            value = log_likelihood(j, size_a, size_b, more, less, same)
            better = value > best
            best, best_j = np.where(better, value, best), np.where(better, j, best_j)
            linked = np.where(links, np.maximum(linked, value), linked)
    return best_j, best - linked


def fewest_equal(registers_: int, least: int, deviations: int) -> int:
    """How many of some registers agree at the threshold, less so many standard deviations."""
    return max(0, int(registers_ * least / 100 - deviations * np.sqrt(registers_ * least * (100 - least)) / 100))


def plausible(size_a, size_b, more, less, same, least: int = LEAST) -> np.ndarray:
    """Whether each pair may link: the registers do not speak clearly against it."""
    # First what needs no logarithms: sizes too far apart, or eight deviations too few that agree.
    out = (100 * np.minimum(size_a, size_b) >= least * np.maximum(size_a, size_b)) & (same >= fewest_equal(REGISTERS, least, 8))
    at = np.flatnonzero(out)
    if len(at):
        out[at] = estimates(size_a[at], size_b[at], more[at], less[at], same[at], least)[1] <= SLACK
    return out


def linked(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    """Whether two sets are similar enough, in whole numbers."""
    if 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= least * (len(a) + len(b) - both)


def _names(sets: list[np.ndarray]) -> list[int | None]:
    """A signed 64-bit name for each set, None for an empty one."""
    names = np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED) for own in sets], np.uint64).view(np.int64).tolist()
    return [name if len(own) else None for name, own in zip(names, sets)]


SKETCH = "node long, n long, regs binary"


def sketches(texts: list[bytes | None], size: int) -> list:
    """The columns of ``SKETCH`` of UTF-8 texts."""
    sets = [shingle_set(raw, size) for raw in texts]
    return [_names(sets), [len(own) for own in sets], [registers(own).tobytes() if len(own) else None for own in sets]]


def sketched(df: DataFrame, text: str, size: int, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``node`` (names the set, null if empty), ``n`` (its size) and ``regs``."""
    return with_arrow_columns(df, text, SKETCH, lambda texts: sketches(texts, size), drop=drop)


def _with_sides(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``pairs (a, b)`` with the columns of ``table (node, ...)`` of both, as ``a_...`` and ``b_...``.

    The partners of a node with many of them are dealt into parts by their counted number.
    """
    rest = [c for c in table.columns if c != "node"]
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    side = lambda name: table.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in rest))
    left = parts.join(side("a"), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    return dealt.join(side("b"), "b").join(left, ["a", "part"]).drop("part")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), REGISTERS)


def estimated(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The ``(a, b)`` that may link by the registers of ``nodes``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x, y = _matrix(part.column(2)), _matrix(part.column(3))
            sizes = (part.column(i).to_numpy().astype(float) for i in (4, 5))
            keep = plausible(*sizes, (x > y).sum(1), (x < y).sum(1), (x == y).sum(1), least)
            yield part.select([0, 1]).filter(pa.array(keep))

    met = _with_sides(pairs, nodes.select("node", "regs", "n")).select("a", "b", "a_regs", "b_regs", "a_n", "b_n")
    return met.mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The ``(a, b)`` whose full sets, of ``sets (node, hashes)``, are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x, y = ([np.frombuffer(v, np.uint64) for v in part.column(i).to_pylist()] for i in (2, 3))
            yield part.select([0, 1]).filter(pa.array([linked(a, b, least) for a, b in zip(x, y)], pa.bool_()))

    return _with_sides(pairs, sets).select("a", "b", "a_hashes", "b_hashes").mapInArrow(check, "a long, b long")


def full_sets(texts: DataFrame, size: int, asked: DataFrame) -> DataFrame:
    """``(node, hashes)`` of the nodes that ``asked (node, text_key)`` names, from ``(text_key, text)``."""

    def compute(raw: list[bytes]) -> list:
        sets = [shingle_set(t, size) for t in raw]
        return [_names(sets), [own.tobytes() for own in sets]]

    few = texts.join(asked.select("text_key"), "text_key", "left_semi")
    made = with_arrow_columns(few, "text", "node long, hashes binary", compute, drop=("text",)).drop("text_key")
    return made.join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"])


def buckets(nodes: DataFrame) -> DataFrame:
    """``(key, band, node)`` of every band that several nodes share."""
    width = 2 * ROWS
    keys = F.array(*(F.xxhash64(F.lit(band), F.substring("regs", 1 + band * width, width)) for band in range(BANDS)))
    members = nodes.select("node", F.posexplode(keys).alias("band", "key"))
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("key")
    return members.join(several, "key").select("key", "band", "node")


def _open(members: DataFrame) -> DataFrame:
    """``(key, members, open)`` of buckets with several groups: how many pairs are of different groups."""
    per_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    per_key = per_root.groupBy("key").agg(
        F.sum("k").alias("members"), F.sum(F.col("k").cast("double") * F.col("k")).alias("squares"), F.count(F.lit(1)).alias("groups")
    ).filter("groups > 1")
    return per_key.select("key", "members", ((F.col("members").cast("double") * F.col("members") - F.col("squares")) / 2).alias("open"))


def star_pairs(members: DataFrame, round_: int) -> DataFrame:
    """``(a, b)``: the leader of each bucket with the members of other groups, from
    ``(key, node, root)``. The first leader is the smallest node, later ones are drawn."""
    rank = F.col("node") if round_ == 0 else F.xxhash64(F.lit(round_), "key", "node")
    leaders = members.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "node", "root")).alias("leader"))
    met = members.join(leaders, "key").filter("root <> leader.root").select(F.col("leader.node").alias("a"), F.col("node").alias("b"))
    return met.distinct()


BLOCK = "key long, row int, column int, part int, band int, node long, root long"
_BLOCK_ORDER = ["key", "row", "column", "part", "node"]


def placed(members: DataFrame, counted: DataFrame) -> DataFrame:
    """Members of open buckets in the blocks where they meet others, see ``BLOCK``: a bucket is
    a grid of parts by parts, and a member is in every block of its part."""
    grid = counted.select("key", F.ceil(F.col("members") / PART).cast("int").alias("parts"))
    dealt = members.join(grid, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return dealt.select("key", "band", "node", "root", "part", other.alias("other")).select(
        "key", F.least("part", "other").alias("row"), F.greatest("part", "other").alias("column"), "part", "band", "node", "root"
    )


def _block_by_block(rows: DataFrame, compute: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``compute`` of the rows of each block, which come to one task in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                if held and any(held[-1].column(i)[0] != batch.column(i)[start] for i in range(3)):
                    yield compute(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, stop - start))
        if held:
            yield compute(pa.Table.from_batches(held))
        held = []
        release_memory()

    # A number of partitions keeps blocks spread: they are small to move and long to compare.
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "key", "row", "column").sortWithinPartitions(*_BLOCK_ORDER).mapInArrow(run, schema)


def _plausible_in_block(table: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, later places)`` of the pairs of different groups in a block that may link and
    that agree in no earlier band, so that each pair belongs to one bucket."""
    row, column, part, band, root, n = (table.column(c).to_numpy() for c in ("row", "column", "part", "band", "root", "n"))
    regs, size, place = _matrix(table.column("regs").combine_chunks()), n.astype(float), np.arange(len(n))
    crossing = row[0] != column[0]
    # Most other pairs agree in fewer of the first registers than a linked pair does, less six
    # standard deviations.
    some = np.ascontiguousarray(regs[:, :FIRST].T)
    enough = fewest_equal(FIRST, least, 6)

    def checked(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.repeat([i for i, _ in held], [len(at) for _, at in held]), np.concatenate([at for _, at in held])
        equal = regs[x] == regs[y]
        keep = equal.sum(1) >= fewest_equal(REGISTERS, least, 8)
        keep[keep] = equal[keep].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[x[keep]]
        x, y = x[keep], y[keep]
        more, less = (regs[x] > regs[y]).sum(1), (regs[x] < regs[y]).sum(1)
        keep = plausible(size[x], size[y], more, less, REGISTERS - more - less, least)
        return x[keep], y[keep]

    held, pairs = [], 0
    for i in range(len(n) - 1):
        near = (some[:, i + 1 :] == some[:, i, None]).sum(0, dtype=np.uint8) >= enough
        near &= root[i + 1 :] != root[i]
        if crossing:
            near &= part[i + 1 :] != part[i]
        at = place[i + 1 :][near]
        if len(at):
            held.append((i, at))
            pairs += len(at)
        if pairs >= CHECKED:
            yield checked(held)
            held, pairs = [], 0
    if held:
        yield checked(held)


def with_partners(rows: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The rows of ``BLOCK`` that may link with another one of their block."""

    def compute(table: pa.Table) -> pa.RecordBatch:
        some = np.zeros(table.num_rows, bool)
        for x, y in _plausible_in_block(table, least):
            some[x] = some[y] = True
        kept = table.select(range(7)).filter(pa.array(some)).combine_chunks()
        return kept.to_batches()[0] if kept.num_rows else pa.RecordBatch.from_pylist([], kept.schema)

    full = rows.join(nodes.select("node", "n", "regs"), "node").select("key", "row", "column", "part", "band", "node", "root", "n", "regs")
    return _block_by_block(full, compute, BLOCK)


def block_links(rows: DataFrame, nodes: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """``(a, b)``: links that join all groups of a block that its verified pairs join.

    Sets come to the block once; a pair whose groups an earlier one joined is not compared
    again, so a block hands on fewer links than it has rows.
    """

    def compute(table: pa.Table) -> pa.RecordBatch:
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy().tolist()
        hashes = [np.frombuffer(v, np.uint64) for v in table.column("hashes").to_pylist()]
        parent = {r: r for r in root}

        def find(r: int) -> int:
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        found = []
        for first, second in _plausible_in_block(table, least):
            for i, j in zip(first.tolist(), second.tolist()):
                x, y = find(root[i]), find(root[j])
                if x != y and linked(hashes[i], hashes[j], least):
                    parent[max(x, y)] = min(x, y)
                    found.append((node[i], node[j]))
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    full = rows.join(nodes.select("node", "n", "regs"), "node").join(sets, "node").select(
        "key", "row", "column", "part", "band", "node", "root", "n", "regs", "hashes"
    )
    return _block_by_block(full, compute, "a long, b long")


def groups(nodes: DataFrame, sets_of, least: int = LEAST, stars: DataFrame | None = None) -> DataFrame:
    """``(node, root)`` of every node with a linked one; ``nodes`` holds ``(node, n, regs, text_key)``.

    ``sets_of`` gives ``(node, hashes)`` for a frame ``(node, text_key)``. ``stars`` may hold
    ``(a, b)`` with a < b of groups that another search found: the first round tests them beside
    the leaders of the buckets, so what links is one group for all later rounds.
    """
    def sets_for(asked: DataFrame) -> DataFrame:
        return written(sets_of(asked.select("node").distinct().join(nodes.select("node", "text_key"), "node")), "sets")

    shared = written(buckets(nodes), "buckets")
    edges, rooted, before = None, shared.withColumn("root", F.col("node")), float("inf")
    for round_ in range(ROUNDS + 1):
        counted = written(_open(rooted), "open")
        members, still = counted.agg(F.coalesce(F.sum("members"), F.lit(0)), F.coalesce(F.sum("open"), F.lit(0.0))).first()
        beside = stars if round_ == 0 else None
        if not members and beside is None:
            break
        # Blocks are the last step: they answer for every pair that is still open.
        last = round_ > 0 and (round_ == ROUNDS or still <= OPEN * members or still > 0.5 * before)
        before = still
        open_members = rooted.join(counted.select("key"), "key", "left_semi")
        if last:
            asked = written(with_partners(placed(open_members, counted), nodes, least), "blocks")
            found = block_links(asked, nodes, sets_for(asked), least)
        else:
            pairs = star_pairs(open_members, round_)
            pairs = pairs if beside is None else pairs.unionByName(beside).distinct()
            asked = written(estimated(written(pairs, "stars"), nodes, least), "asked")
            ends = asked.select(F.col("a").alias("node")).unionByName(asked.select(F.col("b").alias("node")))
            found = verified(asked, sets_for(ends), least)
        edges = written(found if edges is None else edges.unionByName(found), "links")
        if last:
            break
        roots = written(components(edges), "roots")
        rooted = written(shared.join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root")), "rooted")
    if edges is None:
        return nodes.select("node", F.col("node").alias("root")).limit(0)
    return components(edges)


def distinct_nodes(rows: DataFrame, *more: Column) -> DataFrame:
    """``(node, n, regs, text_key)`` and ``more``: one row for each different non-empty set of ``rows``."""
    return rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.max("n").alias("n"), F.min("regs").alias("regs"), F.min("text_key").alias("text_key"), *more
    )


def near_duplicate_groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` for every row of ``df``."""
    slim = df.select(quoted(key).alias("id"), F.xxhash64(quoted(text)).alias("text_key"), quoted(text).alias("text"))
    rows = written(sketched(slim, "text", size, drop=("text",)), "sketches")
    nodes = written(distinct_nodes(rows, F.min("id").alias("least_id")), "nodes")
    roots = written(groups(nodes, lambda asked: full_sets(slim.select("text_key", "text"), size, asked), least), "groups")
    named = nodes.select("node", "least_id").join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = named.join(ids, "root").select("node", "component_id")
    out = rows.select("id", "node", F.col("n").alias("n_shingles")).join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
