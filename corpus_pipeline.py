"""A corpus in five stages: language, near-duplicates, decontamination, secrets, encoding.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and
works on every row its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm import bpe, decontaminate, language, secrets, similar
from pairloom.llm.common import quoted, release_memory, table, written

# A text stays if its language is known and at least this probable.
LEAST_SCORE = 0.5
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# The stages hold fitted models, fingerprints and BPE merges, which SQL cannot express.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is recognised stay; the others go. Without any learning row no
    text can be judged, and all stay."""
    model = language.fit(docs)
    release_memory()  # what the fit held on the driver
    if not model.languages:
        return docs
    # Columns of the documents may have the names of the new ones.
    own = docs.select(*(quoted(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)))
    said = language.identify(own, model, f"own_{docs.columns.index('text')}")
    kept = said.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: 5-word similarity of 0.8 or more."""
    return similar.keep_one(docs).select(*map(quoted, docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go, also where single values were edited."""
    benchmark = table(spark, sf_dir, "benchmark")
    return decontaminate.remove_contaminated(docs, benchmark).select(*map(quoted, docs.columns))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secrets.mask_secrets(docs, chars="n_chars")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of the bytes they decode to."""
    keep = tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns)
    return bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN, keep=keep, outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
