"""Similarity arithmetic on arrays and ML vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp_cosine(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def distance_to_cosine(distance: Column) -> Column:
    """Cosine of two unit vectors from their Euclidean distance."""
    return clamp_cosine(F.lit(1.0) - F.pow(distance, F.lit(2.0)) / F.lit(2.0))


def cosine_to_distance(cosine: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * cosine))


def sparse_parts(vector: Column) -> tuple[Column, Column]:
    """Non-zero positions and values of an ML vector, whether sparse or dense."""
    raw = F.unwrap_udt(vector)
    dense = F.filter(
        F.transform(raw["values"], lambda v, i: F.struct(i.alias("at"), v.alias("value"))),
        lambda entry: entry["value"] != 0.0,
    )
    is_sparse = raw["type"] == 0
    indices = F.when(is_sparse, raw["indices"]).otherwise(dense["at"])
    values = F.when(is_sparse, raw["values"]).otherwise(dense["value"])
    return indices, values


def lsh_buckets(hashes: Column) -> Column:
    """One bucket number per hash table from the LSH model's array of 1-vectors."""
    return F.transform(hashes, lambda h: F.unwrap_udt(h)["values"][0])


def sparse_dot(left: Column, right: Column) -> Column:
    """Dot product of two ``struct<indices, values>`` columns with distinct indices each.

    Both are merged into one array sorted by index, in which a common index is two
    neighbours; one fold over it adds their products. No array is searched and no Python
    worker is needed.
    """

    def entries(side: Column) -> Column:
        zipped = F.arrays_zip(side["indices"].alias("at"), side["values"].alias("value"))
        return F.transform(zipped, lambda e: F.struct(e["at"].cast("long").alias("at"), e["value"].alias("value")))

    def step(state: Column, entry: Column) -> Column:
        product = F.when(state["at"] == entry["at"], state["value"] * entry["value"]).otherwise(F.lit(0.0))
        return F.struct(entry["at"].alias("at"), entry["value"].alias("value"), (state["total"] + product).alias("total"))

    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0.0).alias("value"), F.lit(0.0).alias("total"))
    merged = F.sort_array(F.concat(entries(left), entries(right)))
    return F.aggregate(merged, start, step, lambda state: state["total"])


def squared_norm(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v * v)
