"""Line-first quality rules, in DataFrame functions only.

Every line with a word is judged alone: lines of symbols or of shouting, lines without any
sentence mark, menus and tables, and boilerplate are removed. A document is rejected when
the removed lines held more than ``MAX_LOSS`` of its characters in words, or when it fails
the base rules: fewer than ``MIN_WORDS`` words, or more than half of its words in repeated
three-word windows.

Windows are compared by a 64-bit hash inside one text. Defined cases: null is a text without
words (all counts zero, not kept); blank lines are neither judged nor counted; a text of any
length is read whole; repeated rows get the same verdict each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import quoted

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MENU_MARKS = "|»›•·"
MIN_WORDS = 50
MAX_LOSS = 0.4
MENU_LINE = r"(?i)^\W*(?:home|menu|log ?in|log ?out|sign ?(?:in|up)|register|next|previous|prev|back(?: to top)?|skip to \w+|share|search|contact(?: us)?|about(?: us)?|help|faq|sitemap|read more|more)\W*$"
# Phrases of pages and licences, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "copyright ©", "copyright (c)", "cookie policy", "uses cookies", "accept cookies",
    "privacy policy", "terms of use", "terms of service", "terms and conditions", "subscribe to our", "enable javascript",
    "lorem ipsum", "click here", "powered by", "spdx-license-identifier",
)
SENTENCE_ENDS = (".", "!", "?", "…", ":", ";", "\"", "'", "”", "»", ")", "]", "。", "！", "？")


def _without(text: Column, chars: str) -> Column:
    """``text`` less ``chars``; one byte search each, which skips a text that has none."""
    for char in chars:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def _any(text: Column, parts: Sequence[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def bad_line(line: Column, low: Column) -> Column:
    """Whether the rules remove a line; ``low`` is the line in lower case."""
    symbols = _count(line, SYMBOLS) * 10 > F.length(line)
    shouting = _count(line, "!") * 10 > F.length(line)
    ends = F.substring(F.rtrim(line, F.lit(BLANKS)), -1, 1).isin(*SENTENCE_ENDS)
    table = F.when(_any(line, MENU_MARKS), _count(line, MENU_MARKS) * 4 > _count(line, " \t") + 1).otherwise(F.lit(False))
    menu = F.when(F.length(line) <= 60, line.rlike(MENU_LINE)).otherwise(F.lit(False))
    return symbols | shouting | ~(ends | _any(line, (". ", "! ", "? "))) | table | menu | _any(low, BOILERPLATE)


def line_cleaned(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with base counts, ``n_lines``, ``n_removed``, ``lost`` (share), verdicts, and
    the ``cleaned`` text of the lines that stay. Input columns of these names are replaced."""
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed", "lost", "cleaned")
    own = [c for c in df.columns if c.lower() not in new and (keep_text or c != text)]
    base = df.select(*(quoted(c).alias(f"own_{i}") for i, c in enumerate(own)), F.coalesce(quoted(text), F.lit("")).alias("t"))
    # Each select is a column that the next one reads more than once: inside a lambda its expression would run again for every element.
    split = base.select(
        "*",
        F.array_remove(F.split("t", "[\\x20\\x09-\\x0D]+"), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "").alias("lines"),
    )
    n = F.size("w")
    hashed = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(*(F.col("w")[i + k] for k in range(3))).alias("h"), i.alias("i"))
    )
    judged = F.zip_with("lines", F.transform("lines", F.lower), lambda line, low: F.when(~bad_line(line, low), line))
    good = F.array_compact(judged)
    sorted_ = split.select("*", F.when(n >= 3, F.sort_array(hashed)).alias("s"), good.alias("good"))
    twice = F.transform(
        "s", lambda x, i: F.when((F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"]), x["i"])
    )
    found = sorted_.select("*", F.sort_array(F.array_compact(twice)).alias("r"))
    covered = F.aggregate(
        "r", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
    )["n"]
    counted = found.select(
        *(f"own_{i}" for i in range(len(own))), "good",
        F.size("w").cast("long").alias("n_words"),
        F.length(_without(F.col("t"), BLANKS)).cast("long").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.array_join("good", "\n").alias("cleaned"),
    )
    left = F.length(_without(F.col("cleaned"), BLANKS))
    lost = F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(
        *(F.col(f"own_{i}").alias(c) for i, c in enumerate(own)),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (lost <= MAX_LOSS)).alias("kept"),
        "n_lines", (F.col("n_lines") - F.size("good")).cast("long").alias("n_removed"), lost.alias("lost"), "cleaned",
    )
