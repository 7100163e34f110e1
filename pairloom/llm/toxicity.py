"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Words are letter runs in lower case. Each text has hashed features: its whole words and the
3- to 7-letter beginnings of longer words, once each. From all labelled learning rows the
features that go with the label most are counted out; they are the lexicon. Voters are lexicon
entries (chosen so that each adds cover), fixed word lists, patterns of layout, and the
absence of the whole lexicon. The label model is a mixture of two classes in which voters
form a tree, estimated by expectation maximisation: each voter's accuracies and its
correlation with one other voter are learned together, so voters that say the same thing do
not count twice. Its posterior is the label that the linear classifier (FTRL, elastic net)
learns from; a known label is one more, imperfect, voter.

Counts cover every labelled row; the label model and the weights see a sample of about
``FIT_ROWS`` rows. Defined cases: null and empty texts have no features and get the
classifier's base score; without labelled rows of both classes only the fixed lists vote;
texts of any length are read whole; input columns named like a new one are replaced, others are
kept; repeated rows get the same score each; ties in rank go to the lower
feature number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import collected, decoded, quoted, slices, with_arrow_columns, written
from pairloom.llm.linear import fit_ftrl

BINS = 1 << 18
BEGINNINGS = range(3, 8)
LONGEST = 24  # letters of a word that its hash reads, with the length of the word
LEXICON = 2_048
VOTERS = 40
FIT_ROWS = 16_000
THRESHOLD = 0.3
LABEL_BROADCAST = 4_000_000
# English insults in everyday use, as public lists have them.
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "fool", "loser", "pathetic", "worthless", "clown", "imbecile", "scum", "trash", "garbage",
    "filth", "vermin", "disgusting", "pig", "ugly", "freak", "hate", "kill", "shut", "crap", "damn", "bastard",
)
# Patterns of layout: share of capitals, of "!" and of symbols among all characters.
PATTERNS = 3


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str, beginnings: bool = True) -> np.ndarray:
    """Distinct feature numbers of a text, ascending; on request of whole words only."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], _letters()[codes].view(np.int8), [0]))))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.int64)
    seen = np.zeros(BINS, bool)
    h = np.full(len(starts), 2166136261, np.uint32)
    live = np.arange(len(starts))
    for i in range(min(LONGEST, int(lengths.max()))):
        live = live[lengths[live] > i]
        h[live] = (h[live] ^ codes[starts[live] + i]) * np.uint32(16777619)
        if beginnings and i + 1 in BEGINNINGS:
            longer = live[lengths[live] > i + 1]
            seen[_bin(h[longer], i + 1)] = True
    seen[_bin(h ^ lengths.astype(np.uint32), 0)] = True
    return np.flatnonzero(seen)


def _bin(h: np.ndarray, kind: int) -> np.ndarray:
    mixed = (h ^ np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    return (mixed ^ (mixed >> np.uint32(15))) & np.uint32(BINS - 1)


def patterns(text: str) -> list[int]:
    """Numbers of the layout patterns that hold."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    marks, symbols = text.count("!"), sum(text.count(c) for c in "#*$%&|<>")
    return [k for k, n in enumerate((3 * upper, 50 * marks, 20 * symbols)) if n > len(text)]


@dataclass(frozen=True)
class LabelModel:
    """``prior`` of class 1 and, for each voter, the probability of a vote given the class
    and its parent's vote: ``table[voter, class, parent's vote]``; a root has parent -1."""

    prior: float
    parents: np.ndarray
    table: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row of 0/1 votes."""
        at = np.where(self.parents[None, :] >= 0, votes[:, np.maximum(self.parents, 0)], 0)
        voter = np.arange(votes.shape[1])[None, :]
        out = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        p1, p0 = self.table[voter, 1, at], self.table[voter, 0, at]
        return out + np.where(votes == 1, np.log(p1 / p0), np.log((1 - p1) / (1 - p0))).sum(1)


def _dependencies(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Parents in the spanning tree of largest mutual information given the class."""
    k = votes.shape[1]
    info = np.zeros((k, k))
    for w in (weight, 1 - weight):
        total = max(w.sum(), 1e-9)
        one = (w @ votes + 0.5) / (total + 1)
        both = (votes.T @ (votes * w[:, None]) + 0.25) / (total + 1)
        for a, b, joint in ((0, 0, 1 - one[:, None] - one[None, :] + both), (0, 1, one[None, :] - both), (1, 0, one[:, None] - both), (1, 1, both)):
            joint = np.maximum(joint, 1e-9)
            alone = (one if a else 1 - one)[:, None] * (one if b else 1 - one)[None, :]
            info += total / len(votes) * joint * np.log(joint / alone)
    parents, reached = np.full(k, -1), np.zeros(k, bool)
    reached[0] = True
    best, source = info[0].copy(), np.zeros(k, int)
    for _ in range(k - 1):
        best[reached] = -np.inf
        nxt = int(best.argmax())
        parents[nxt], reached[nxt] = source[nxt], True
        closer = info[nxt] > best
        best, source = np.where(closer, info[nxt], best), np.where(closer, nxt, source)
    return parents


def fit_label_model(votes: np.ndarray, label: np.ndarray, trust: float = 0.97, rounds: int = 25) -> tuple[LabelModel, np.ndarray]:
    """The model and the posterior of class 1 for each row; ``label`` is -1 where unknown.

    A label counts with the log odds of ``trust``; it anchors which class is which.
    """
    known = np.where(label < 0, 0.0, np.where(label == 1, 1, -1) * np.log(trust / (1 - trust)))
    start = votes.astype(float).mean(1)
    share = float((label == 1).sum() + 1) / float((label >= 0).sum() + 2) if (label >= 0).any() else 0.1
    weight = np.where(label >= 0, np.where(label == 1, trust, 1 - trust), np.clip(start / max(start.max(), 1e-9), 0.05, 0.95) * share)
    parents = np.full(votes.shape[1], -1)
    model = None
    for turn in range(rounds):
        if turn % 5 == 1:
            parents = _dependencies(votes.astype(float), weight)
        at = np.where(parents[None, :] >= 0, votes[:, np.maximum(parents, 0)], 0)
        table = np.empty((votes.shape[1], 2, 2))
        for y, w in ((1, weight), (0, 1 - weight)):
            # A rare pair of a parent's vote and a class leans on the voter's rate in that class.
            rate = (w @ votes + 0.5) / (w.sum() + 1)
            for parent in (0, 1):
                here = (at == parent) * w[:, None]
                table[:, y, parent] = ((here * votes).sum(0) + 2 * rate) / (here.sum(0) + 2)
        table = np.clip(table, 1e-4, 1 - 1e-4)
        model = LabelModel(float(np.clip(weight.mean(), 1e-3, 0.999)), parents.copy(), table)
        weight = 1 / (1 + np.exp(-np.clip(model.log_odds(votes) + known, -30, 30)))
    return model, weight


@dataclass(frozen=True)
class ToxicityModel:
    place: np.ndarray  # of each feature in the lexicon, or -1
    weights: np.ndarray  # of lexicon entries, fixed lists and patterns, lexicon size, bias

    def score(self, text: bytes | None) -> float:
        if not len(self.weights):
            return 0.0
        z = self.weights[compact(decoded(text), self.place)].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def compact(text: str, place: np.ndarray) -> np.ndarray:
    """Positions of a text's lexicon entries, layout patterns, and the constant."""
    size = int(place.max(initial=-1)) + 1
    own = place[features(text)]
    return np.concatenate((own[own >= 0], size + np.array(patterns(text), np.int64), [size + PATTERNS])).astype(np.int64)


def _feature_counts(labelled: DataFrame) -> DataFrame:
    """``(feature, toxic, clean)`` texts of each feature; -1 counts all texts.

    One bounded vector leaves each task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS + 1), np.int64)
        for part in slices(batches):
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                total[label, features(decoded(text))] += 1
                total[label, BINS] += 1
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(at == BINS, -1, at)), pa.array(total[1, at]), pa.array(total[0, at])], names=["feature", "toxic", "clean"]
        )

    counted = labelled.mapInArrow(count, "feature long, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(labelled: DataFrame) -> list[tuple[int, int, int]]:
    """``(feature, toxic, clean)`` of the features that go with the label most."""
    counts = _feature_counts(labelled)
    totals = {r["feature"]: r for r in counts.filter("feature < 0").collect()}
    if not totals or not totals[-1]["toxic"] or not totals[-1]["clean"]:
        return []
    odds = F.log((F.col("toxic") + 0.5) / (totals[-1]["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (totals[-1]["clean"] + 1))
    strength = (odds * F.sqrt("toxic")).alias("strength")
    best = counts.filter("feature >= 0 AND toxic >= 3").select("*", strength).filter("strength > 0").orderBy(F.desc("strength"), "feature")
    return [(r["feature"], r["toxic"], r["clean"]) for r in best.limit(LEXICON).collect()]


def _choose_voters(has: np.ndarray, label: np.ndarray) -> list[int]:
    """Lexicon entries that each cover labelled texts which the earlier ones do not."""
    toxic, clean = has[label == 1].astype(bool), has[label == 0].astype(bool)
    if not len(toxic):
        return list(range(min(VOTERS, has.shape[1])))
    open_, chosen = np.ones(len(toxic), bool), []
    cost = clean.sum(0) * (len(toxic) / max(len(clean), 1))
    for _ in range(min(VOTERS, has.shape[1])):
        gain = toxic[open_].sum(0) - 2 * cost
        gain[chosen] = -np.inf
        best = int(gain.argmax())
        if gain[best] < 1 and len(chosen) >= VOTERS // 2 or not np.isfinite(gain[best]):
            break
        chosen.append(best)
        open_ &= ~toxic[:, best]
    return chosen


def _votes(has: np.ndarray, label: np.ndarray, size: int, fixed: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """The vote matrix: chosen entries, the fixed list, layout, absence and repetition."""
    several = has[:, strong].sum(1) if len(strong) else np.zeros(len(has), int)
    listed = has[:, fixed].sum(1) if len(fixed) else np.zeros(len(has), int)
    columns = [has[:, _choose_voters(has[:, :size], label)], has[:, size : size + PATTERNS]]
    columns += [c[:, None] for c in (listed >= 1, listed >= 2, several == 0, several >= 2, several >= 4, several >= 8)]
    return np.concatenate([c.astype(np.uint8) for c in columns], axis=1)


def attach_labels(documents: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """``documents`` with their label, null where there is none or repeated ones differ.

    Labels go to the texts: they are broadcast while their counted number keeps them within
    ``LABEL_BROADCAST`` rows of two numbers. Beyond it the two sides are shuffled and the
    outcome is written, so that texts move once.
    """
    known = labels.groupBy(quoted(key).alias(key)).agg(
        F.when(F.min(quoted(label)) == F.max(quoted(label)), F.min(quoted(label))).alias(label)
    )
    if known.count() <= LABEL_BROADCAST:
        return documents.join(F.broadcast(known), key, "left")
    return written(documents.join(known, key, "left"), "labelled")


def fit(df: DataFrame, text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on the rows of ``df``; ``label`` is 1, 0 or null, and other values count as null."""
    rows = df.select(quoted(text).cast("binary").alias("text"), F.when(quoted(label).isin(0, 1), quoted(label).cast("int")).alias("label"))
    labelled = rows.filter("label IS NOT NULL")
    lexicon = _lexicon(labelled)
    entries = [f for f, _, _ in lexicon]
    fixed = [int(b) for b in features(" ".join(INSULTS), beginnings=False)]
    entries += [b for b in fixed if b not in set(entries)]
    place = np.full(BINS, -1, np.int64)
    place[entries] = np.arange(len(entries))

    # Texts count and enter once for each label, so that the sample keeps its size however often one repeats.
    digest = F.xxhash64("text")
    sizes = rows.groupBy(F.col("label").isNotNull().alias("known")).agg(F.count_distinct(digest, F.coalesce("label", F.lit(-1))).alias("texts"))
    sizes = {r["known"]: r["texts"] for r in sizes.collect()}
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 32)) / float(1 << 32)
    rates = [0.75 * fit_rows / max(sizes.get(True, 0), 1), 0.25 * fit_rows / max(sizes.get(False, 0), 1)]
    sample = rows.filter(share < F.when(F.col("label").isNotNull(), rates[0]).otherwise(rates[1])).distinct()
    shared = df.sparkSession.sparkContext.broadcast(place)

    def pack(texts: list[bytes]) -> list:
        return [[compact(decoded(t), shared.value).astype(np.uint16).tobytes() for t in texts]]

    got = collected(with_arrow_columns(sample, "text", "at binary", pack, drop=("text",)), 2 * fit_rows + 1000, "fit-sample")
    got.sort(key=lambda r: (-1 if r["label"] is None else r["label"], r["at"]))
    if not got:
        return ToxicityModel(place, np.empty(0))
    at = [np.frombuffer(r["at"], np.uint16).astype(np.int64) for r in got]
    known = np.array([-1 if r["label"] is None else r["label"] for r in got])
    has = np.zeros((len(got), len(entries) + PATTERNS + 1), np.uint8)
    for row, own in enumerate(at):
        has[row, own] = 1
    sure = np.array([i for i, (_, t, c) in enumerate(lexicon) if t >= 2 * c][:512], np.int64)
    votes = _votes(has, known, len(entries), place[fixed], sure if len(sure) else place[fixed])
    _, posterior = fit_label_model(votes, known)
    targets = np.stack([1 - posterior, posterior], axis=1)
    # Empty texts join as clean rows, so that the constant alone, as in short texts, says nothing bad.
    blank = compact("", place)
    anchors = 1 + len(at) // 10
    rows_ = [(own, np.ones(len(own))) for own in at] + [(blank, np.ones(len(blank)))] * anchors
    targets = np.concatenate((targets, np.tile([1.0, 0.0], (anchors, 1))))
    weights = fit_ftrl(rows_, targets, has.shape[1], epochs=4, alpha=0.1, l1=0.5, l2=0.5)
    return ToxicityModel(place, weights[:, 1] - weights[:, 0])


def score(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted``; the model (a bounded size) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[bytes]) -> list:
        scores = [shared.value.score(t) for t in texts]
        return [scores, [int(s >= THRESHOLD) for s in scores]]

    return with_arrow_columns(df, text, "score double, predicted int", compute)
