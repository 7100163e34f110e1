"""One document of each near-duplicate group, by the exact similarity of word shingles.

Two texts link if the Jaccard similarity of their sets of ``SHINGLE``-word shingles is at
least ``LEAST`` percent. First come the SimHash groups: fingerprints of the same shingles,
multi-index hashing and components of ``simhash``; each member that the full sets confirm
against the leader of its group is joined to it. Links between texts whose fingerprints differ
in more bits than ``simhash`` searches, and members that their leader does not confirm, are
left to the bands, rounds and blocks of ``setsketch``, whose first round also tests these pairs.

The rows are written once with a number each, so later steps name a row by its number:
however many rows are equal, they never meet in one task, and texts move only for rows that
are asked about or kept.

Defined cases: null, empty and blank texts are copies of each other; of rows with the same
id the one with the smallest digest stays, of wholly equal rows any one; null ids come last;
texts of any length are read whole; the columns may have any names and stay as they are; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import quoted, with_arrow_columns, written
from pairloom.llm.setsketch import SKETCH, distinct_nodes, full_sets, groups, sketches
from pairloom.llm.simhash import fingerprint_components, fingerprints

SHINGLE = 5
LEAST = 80


def described(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the columns of ``SKETCH`` and the fingerprint ``fp`` of the same shingles."""
    compute = lambda texts: [*sketches(texts, SHINGLE), fingerprints(texts, SHINGLE)]
    return with_arrow_columns(df, text, f"{SKETCH}, fp long", compute)


def simhash_stars(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: the smallest node of each SimHash group with each other one, from ``(node, fp)``.

    One pair for each member, however dense the group."""
    rooted = nodes.select("node", "fp").join(fingerprint_components(nodes), "fp")
    leaders = rooted.groupBy("root").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    return rooted.join(leaders, "root").filter("node <> a").select("a", F.col("node").alias("b"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group: the smallest id, then the smallest digest of the row."""
    own = [quoted(c).alias(f"own_{i}") for i, c in enumerate(df.columns)]
    at_text, at_key = f"own_{df.columns.index(text)}", f"own_{df.columns.index(key)}"
    numbered = df.select(*own, F.monotonically_increasing_id().alias("text_key"))
    rows = written(described(numbered, at_text), "rows")
    everything = [f"own_{i}" for i in range(len(df.columns))]
    digest = F.xxhash64(*everything, *(F.col(c).isNull() for c in everything))
    order = F.struct(F.col(at_key).isNull().alias("none"), F.col(at_key).alias("id"), digest.alias("digest"), F.col("text_key").alias("row"))
    # Texts without a word are one group, whose root no set has.
    best = rows.groupBy("node").agg(F.min(order).alias("best"))
    # Equal sets with other repeats may have other fingerprints; one of them speaks for the node.
    nodes = written(distinct_nodes(rows, F.min("fp").alias("fp")), "nodes")
    texts = rows.select("text_key", F.col(at_text).alias("text"))
    stars = written(simhash_stars(nodes), "simhash")
    roots = groups(nodes, lambda asked: full_sets(texts, SHINGLE, asked), LEAST, stars)
    rooted = best.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("text_key"))
    stays = rows.join(kept, "text_key", "left_semi")
    return stays.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(df.columns)))
