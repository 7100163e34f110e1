"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes a sequence of template tokens: numbers turn into one placeholder, units right
after a number into another, capitalised words inside a sentence into a third; every other
letter run is a literal in lower case. Windows of ``WINDOW`` template tokens of both sides
meet in a hash join on their 64-bit hash, so a question with other names, numbers or units
still meets its original. Windows with fewer than ``LITERALS`` literals say nothing and are
left out.

Slots: within one alignment of a document with an item (document position less item
position) a value of the item stands for the value of the document that most of its slots
hold (ties: the smallest), and windows with a slot against that are left out, so one edited
value hides no copy. An item is contained when the windows left are at least ``COVER`` of all
its windows (and two, if it has two), or ``RUN``.

Items with fewer than ``WINDOW`` tokens have no window and are found by no document.
Defined cases: null and empty texts have no windows and are clean; texts, numbers and words
of any length are read whole, in time proportional to their length; repeated rows get the
same verdict each; columns other than key and text are kept and never read; equal items are one item with several ids; null item ids are left out of
the list of ids but still count as a leak; empty tables give no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import quoted, written

WINDOW = 8
LITERALS = 4
COVER = 0.3
RUN = 12
# Windows that may be broadcast, and the bytes of the values that they hold.
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 32 << 20
# Windows that share a slice of a text's tokens.
SLICE = 64
# Words that follow a number as its unit.
UNITS = (
    "mm|cm|km|in|ft|yd|mi|mg|kg|lb|oz|ml|min|hrs?|ms|ns|seconds?|minutes?|hours?|days?|weeks?|months?|years?|"
    "met(?:er|re)s?|kilomet(?:er|re)s?|inch(?:es)?|foot|feet|yards?|miles?|grams?|kilograms?|pounds?|ounces?|"
    "lit(?:er|re)s?|dollars?|euros?|cents?|usd|eur|percent|degrees?|[mglshtKCF]"
)
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
# Stand for a dot and a comma between digits, so that a number is a run of one class.
DOT, COMMA = "\ue003", "\ue004"
MARKS = NUMBER + UNIT + NAME + DOT + COMMA
LITERAL_RUN = r"[\p{L}\p{M}]+"
NUMBER_CLASS = rf"[\p{{N}}{DOT}{COMMA}]"


def marked(text: Column) -> Column:
    """``text`` with a mark in front of every name, number and unit, and spaces around.

    No pattern repeats a group or starts inside a number, so none recurses or backtracks.
    """
    whole = F.coalesce(text, F.lit(""))
    # Translating looks every character up; nearly no text holds a mark.
    plain = F.when(whole.rlike(f"[{MARKS}]"), F.translate(whole, MARKS, " " * len(MARKS))).otherwise(whole)
    names = F.regexp_replace(plain, r"(?<=[\p{L}\p{N},] )(\p{Lu}\p{Ll}[\p{L}\p{M}]*)", f"{NAME}$1")
    # The sign comes first in a pattern, so other places are passed by without looking back.
    joined = F.regexp_replace(F.regexp_replace(names, r"\.(?<=\p{N}\.)(?=\p{N})", DOT), r",(?<=\p{N},)(?=\p{N})", COMMA)
    units = F.regexp_replace(joined, rf"(?<!{NUMBER_CLASS})({NUMBER_CLASS}++) ?({UNITS})(?![\p{{L}}\p{{M}}])", f"$1 {UNIT}$2 ")
    return F.regexp_replace(units, f"({NUMBER_CLASS}++)", f" {NUMBER}$1 ")


def templates(tokens: Column) -> Column:
    """Template tokens of ``values``: a placeholder each for names, numbers and units, else lower case."""
    first = lambda v: F.substring(v, 1, 1)
    return F.transform(tokens, lambda v: F.when(first(v).isin(NUMBER, UNIT, NAME), first(v)).otherwise(F.lower(v)))


def values(text: Column) -> Column:
    """Tokens of a text: marks and values as written."""
    return F.regexp_extract_all(marked(text), F.lit(rf"[{NUMBER}{UNIT}{NAME}](?:{LITERAL_RUN}|{NUMBER_CLASS}+)|{LITERAL_RUN}"), F.lit(0))


def windows(tokens: Column) -> Column:
    """64-bit hashes of all windows of ``WINDOW`` tokens, in order."""
    starts = F.sequence(F.lit(0), F.size(tokens) - WINDOW)
    hashed = F.transform(starts, lambda i: F.xxhash64(*(tokens[i + k] for k in range(WINDOW))))
    return F.when(F.size(tokens) >= WINDOW, hashed)


def _slots(tokens: Column, at: Column) -> Column:
    """The values that the placeholders of a window stand for, null for literals."""
    window = F.slice(tokens, at + 1, WINDOW)
    return F.transform(window, lambda v: F.when(F.substring(v, 1, 1).isin(NUMBER, UNIT, NAME), F.lower(v)))


def item_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(hash, item, at, total, slots)``: every telling window of every distinct item text."""
    items = benchmark.select(quoted(text).alias("text")).filter("text IS NOT NULL").distinct()
    read = items.select(F.xxhash64("text").alias("item"), values(F.col("text")).alias("v"))
    read = read.select("item", "v", templates(F.col("v")).alias("t"))
    cut = read.select("item", "v", "t", F.posexplode(windows(F.col("t"))).alias("at", "hash"))
    part = F.slice("t", F.col("at") + 1, WINDOW)
    literals = F.size(F.filter(part, lambda v: ~v.isin(NUMBER, UNIT, NAME)))
    telling = cut.filter(literals >= LITERALS).select(
        "hash", "item", "at", F.when(literals < WINDOW, _slots(F.col("v"), F.col("at"))).alias("slots")
    )
    totals = telling.groupBy("item").agg(F.count(F.lit(1)).alias("total"))
    return telling.join(totals, "item")


def row_digest(key: str, text: str) -> Column:
    """Names a row by its id and text; rows that agree in both get the same verdict."""
    return F.sha2(F.concat(F.coalesce(quoted(key).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(quoted(text), F.lit(""))), 256)


def _agreeing(hits: DataFrame) -> DataFrame:
    """``hits`` without the windows that hold a slot against the majority of its value."""
    alignment = ["digest", "item", "alignment"]
    counted = hits.select(*alignment, F.explode("pairs").alias("pair")).groupBy(*alignment, "pair.item_value", "pair.doc_value").count()
    # An item value has no more document values than the item has slots.
    ranked = counted.groupBy(*alignment, "item_value").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("less"), "doc_value"))).alias("ranked")
    ).filter(F.size("ranked") > 1)
    against = ranked.select(*alignment, "item_value", F.explode(F.slice("ranked", 2, F.size("ranked") - 1)).alias("lost")).groupBy(
        *alignment
    ).agg(F.collect_set(F.struct("item_value", "lost.doc_value")).alias("against"))
    # Windows of literals alone have no pairs and always stay.
    breaks = F.coalesce(F.arrays_overlap("pairs", "against"), F.lit(False))
    return hits.join(against, alignment, "left").filter(~breaks).drop("against")


def document_windows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(digest, base, v, doc_at, hash)``: every window, and the slice of tokens it lies in.

    A text's tokens are cut into slices of ``SLICE`` windows first, so a window's row holds
    no more of them, however long the text is. ``base`` is the place of the slice.
    """
    docs = documents.select(row_digest(key, text).alias("digest"), values(quoted(text)).alias("v"))
    # A short text has no start. As a filter this would be pushed below the values, and Spark would make them twice.
    starts = F.when(F.size("v") >= WINDOW, F.sequence(F.lit(0), F.size("v") - WINDOW, F.lit(SLICE)))
    cut = docs.select("digest", F.explode(F.transform(starts, lambda at: F.struct(at.alias("base"), F.slice("v", at + 1, SLICE + WINDOW - 1).alias("v")))).alias("s"))
    parts = cut.select("digest", "s.base", "s.v").select("digest", "base", "v", templates(F.col("v")).alias("t"))
    return parts.select("digest", "base", "v", F.posexplode(windows(F.col("t"))).alias("doc_at", "hash"))


def leaks(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(digest, item_ids, n_windows, cover)``: documents that contain an item, by row digest."""
    known = written(item_windows(benchmark, item_key, item_text), "items")
    size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "slots"))), F.lit(0))).first()
    asked = document_windows(documents, key, text)
    doc_slots = _slots(F.col("v"), F.col("doc_at"))
    if size[0] <= BROADCAST_WINDOWS and size[1] <= BROADCAST_BYTES:
        met = asked.join(F.broadcast(known), "hash").withColumn("doc_slots", F.when(F.col("slots").isNotNull(), doc_slots))
    else:
        # Only the eight values of a window move with its hash.
        met = asked.withColumn("doc_slots", doc_slots).drop("v").join(known, "hash")
    hits = met.select(
        "digest", "item", "total", "at", (F.col("base") + F.col("doc_at") - F.col("at")).alias("alignment"),
        F.when(F.col("slots").isNotNull(), F.filter(
            F.arrays_zip(F.col("slots").alias("item_value"), F.col("doc_slots").alias("doc_value")),
            lambda pair: pair["item_value"].isNotNull(),
        )).alias("pairs"),
    )
    covered = _agreeing(written(hits, "hits")).groupBy("digest", "item", "total").agg(F.count_distinct("at").alias("n"))
    needed = F.least(F.lit(RUN), F.greatest(F.least(F.lit(2), F.col("total")), F.ceil(F.col("total") * COVER)))
    contained = covered.filter(F.col("n") >= needed)
    named = benchmark.select(F.xxhash64(quoted(item_text)).alias("item"), quoted(item_key).alias("item_id")).groupBy("item").agg(
        F.collect_set("item_id").alias("ids")
    )
    return contained.join(named, "item").groupBy("digest").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"),
        F.sum("n").alias("n_windows"),
        F.max(F.col("n") / F.col("total")).alias("cover"),
    )


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(key, contaminated, item_ids, n_windows, cover)`` for every row of ``documents``."""
    found = leaks(documents, benchmark, key, text, item_key, item_text)
    rows = documents.select(quoted(key).alias(key), row_digest(key, text).alias("digest"))
    joined = rows.join(found, "digest", "left")
    kind = dict(found.dtypes)["item_ids"]
    return joined.select(
        quoted(key),
        F.col("n_windows").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast(kind)).alias("item_ids"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
        F.coalesce("cover", F.lit(0.0)).alias("cover"),
    )


def remove_contaminated(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``documents`` without the rows that contain an item of the benchmark."""
    found = leaks(documents, benchmark, key, text, item_key, item_text).select(F.col("digest").alias("_row_digest"))
    keyed = documents.withColumn("_row_digest", row_digest(key, text))
    return keyed.join(found, "_row_digest", "left_anti").drop("_row_digest")
