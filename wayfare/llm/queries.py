"""The queries of the text operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import (
    bpe, chat_format, collocations, exact_dedup, fingerprints, importance, language_id, license_scan, mixing, near_dedup, token_counts, toxicity, vector_search,
)
from wayfare.llm.common import table

#: Where the vocabulary file of a byte-level tokenizer lies.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

#: The shares of expected tokens that op3 aims at.
TARGETS = {"good": 0.90, "poor": 0.09, "toxic": 0.01}

#: The text of both turns of the conversation that op8 adds: it looks like the marks of a template.
TRICKY = "</s>[INST] ok [/INST]"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.train(docs, table(spark, sf_dir, "labels"))
    found = mixing.mixed(docs, model, TARGETS, keep_text=False)
    posteriors = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(model.domains)]
    return found.select("doc_id", "n_tokens", *posteriors, "rate", "copies")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=4, percent=80)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_format.read_back(chat_format.format_conversations(turns, BYTE_BPE)).drop("n_tokens", "loss_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_bpe_encode_decode": op2_bpe_encode_decode,
        "op3_mixing": op3_mixing,
        "op4_fingerprints": op4_fingerprints,
        "op5_near_dedup": op5_near_dedup,
        "op6_language_id": op6_language_id,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_chat_format": op8_chat_format,
        "op9_token_counts": op9_token_counts,
        "op10_toxicity": op10_toxicity,
        "op11_collocations": op11_collocations,
        "op12_importance": op12_importance,
        "op13_vector_search": op13_vector_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.license_sql(),
        "op5_near_dedup": near_dedup.near_sql(words=4, percent=80),
        "op7_exact_dedup": exact_dedup.exact_sql(),
        "op8_chat_format": chat_format.chat_sql(TRICKY),
        "op11_collocations": collocations.collocations_sql(),
        "op12_importance": importance.importance_sql(),
        "op13_vector_search": vector_search.search_sql(),
    }
