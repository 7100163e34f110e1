"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm import (
    alignment, bpe, chat, decontaminate, language, quality, secrets, setsketch, sharding, simhash, spelling, token_counts, toxicity,
)
from pairloom.llm.common import table, written
from pairloom.llm.oracle import ORACLE  # noqa: F401

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
OFFSETS = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"), 5, 0)
    model = language.fit(documents.filter(~held))
    rows = documents.select("doc_id", held.alias("held_out"), "text")
    return language.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(documents, RANKS, PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = language.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit(toxicity.attach_labels(documents.filter(~held), table(spark, sf_dir, "labels"), "doc_id", "toxic"))
    rows = documents.select("doc_id", held.alias("held_out"), "text")
    return toxicity.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("text")
    lengths = token_counts.with_length(documents, RANKS, PATTERN, drop=("text",))
    return token_counts.limits(written(token_counts.histogram(lengths), "histogram"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], rows.schema)
    segments = chat.format_conversations(rows.unionByName(extra), OFFSETS)
    return chat.read_back(segments).drop("n_tokens", "n_loss_tokens")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.line_cleaned(documents, keep_text=False).drop("cleaned", "lost")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find_secrets(documents, keep_text=False).drop("findings")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), OFFSETS, PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_language_id, op3_byte_bpe, op4_toxicity, op5_token_counts, op6_simhash_dedup, op7_chat_format,
        op8_quality_rules, op9_decontamination, op10_secret_scan, op11_spelling_variants, op12_minhash_dedup,
        op13_tokenizer_alignment,
    )
}
