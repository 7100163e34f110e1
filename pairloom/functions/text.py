"""Text cleaning, privacy masking and tokenising as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pairloom.functions.stopwords import ENGLISH_STOP_WORDS

# The masks and the token separator must match exactly these texts.
EMAIL_PATTERN = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PROFILE_URL_PATTERN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/\S+"
PHONE_PATTERN = (
    r"(?<!\d)(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}(?!\d)"
)
HEADER_NAME_PATTERN = r"(?i)(professional resume for)\s+([A-Z][A-Za-z'-]+(?:\s+[A-Z][A-Za-z'-]+){1,3}):(?:\s*\2)?"
TOKEN_GAP_PATTERN = r"[^\p{L}\p{N}+#.]+"
MIN_TOKEN_LENGTH = 2

# Upper edges of the word-count buckets, in reading order.
LENGTH_EDGES = ((100, "<100"), (250, "100-249"), (500, "250-499"), (1000, "500-999"))
LAST_LENGTH_BUCKET = "1000+"


def collapse_spaces(text: Column) -> Column:
    """Trim, then turn every whitespace run into one space; case is kept."""
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def normalize(text: Column) -> Column:
    """Trim, collapse whitespace and lower-case."""
    return F.lower(collapse_spaces(text))


def mask_email(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL_PATTERN, "[EMAIL]")


def mask_profile_url(text: Column) -> Column:
    return F.regexp_replace(text, PROFILE_URL_PATTERN, "[LINKEDIN]")


def mask_phone(text: Column) -> Column:
    return F.regexp_replace(text, PHONE_PATTERN, "[PHONE]")


def mask_header_name(text: Column) -> Column:
    return F.regexp_replace(text, HEADER_NAME_PATTERN, "$1 [NAME]: [NAME]")


def mask_identifiers(text: Column) -> Column:
    """Mask e-mails, profile links, phone numbers and the header name, in that order.

    Pattern rules only: a safeguard, not a full detector of personal data.
    """
    for mask in (mask_email, mask_profile_url, mask_phone, mask_header_name):
        text = mask(text)
    return text


def has_email(text: Column) -> Column:
    return text.rlike(EMAIL_PATTERN)


def flag(text: Column) -> Column:
    """Source flags are the strings ``t`` and ``f``; NULL stays NULL."""
    return text == F.lit("t")


def parse_list(text: Column, delimiter: str = ",") -> Column:
    """Delimited text to a sorted array of distinct, trimmed, lower-cased entries."""
    pieces = F.split(F.coalesce(text, F.lit("")), "\\Q" + delimiter + "\\E")
    cleaned = F.transform(pieces, lambda piece: F.lower(F.trim(piece)))
    return F.sort_array(F.array_distinct(F.filter(cleaned, lambda piece: piece != "")))


def join_parts(*parts: Column) -> Column:
    """Join the non-empty parts with one space, so that gaps leave no double space."""
    return F.trim(F.concat_ws(" ", *[F.nullif(F.trim(part), F.lit("")) for part in parts]))


def word_count(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+"))


def length_bucket(words: Column) -> Column:
    chain = None
    for edge, name in LENGTH_EDGES:
        chain = (F if chain is None else chain).when(words < edge, F.lit(name))
    return chain.otherwise(F.lit(LAST_LENGTH_BUCKET))


def tokens(text: Column) -> Column:
    """Lower-cased tokens of two characters or more, without English stop words."""
    pieces = F.split(F.lower(text), TOKEN_GAP_PATTERN)
    return F.filter(
        pieces,
        lambda token: (F.length(token) >= MIN_TOKEN_LENGTH)
        & ~token.isin(ENGLISH_STOP_WORDS),
    )


def with_bigrams(words: str) -> Column:
    """Unigrams as ``u_word`` followed by adjacent pairs as ``b_first_second``.

    Takes the name of a column, not an expression: a lambda would evaluate an expression
    again for every element.
    """
    unigrams = F.transform(words, lambda word: F.concat(F.lit("u_"), word))
    pairs = F.transform(
        words, lambda word, i: F.concat(F.lit("b_"), word, F.lit("_"), F.get(words, i + 1))
    )
    return F.concat(unigrams, F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def token_chunks(words: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """Overlapping token windows; a short tail window is kept even when covered."""
    step = max_tokens - overlap_tokens
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(step)))
    return F.coalesce(
        F.transform(starts, lambda start: F.slice(words, start + 1, max_tokens)),
        F.array().cast("array<array<string>>"),
    )
