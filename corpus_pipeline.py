"""The corpus pipeline: documents without toxic texts and copies, mixed to target weights, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it decides takes effect on the rows.  All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from wayfare.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The domains of the mixing stage, as conditions on the columns of labels, and the shares of expected tokens that it
#: aims at.  Toxic documents are gone by then.  No document's rate is below 1, so none is lost.
DOMAINS = {"good": "quality = 1", "poor": "quality = 0"}
TARGETS = {"good": 0.75, "poor": 0.25}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects; it is learned from the labelled ones among docs.

    As toxicity.train and keep_clean say: null and empty texts are texts without votes and stay; long texts are read
    whole; repeated rows are judged each for itself; an empty table gives no rows; other columns are passed on.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents whose texts are equal without white space.

    As exact_dedup.keep_first says: null and empty texts are one group; of ties the smallest id stays, of repeated rows
    one; long texts are compared whole; an empty table gives no rows; other columns are passed on.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents connected by similarities of 0.8 or more on shingles of five words.

    As near_dedup.keep_one says: null and empty texts and rows without id stay; long texts are compared whole; the
    smallest id of a group stays; an empty table gives no rows; other columns are passed on.
    """
    return near_dedup.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the fitted rates say, once at least.

    As mixing.mix says: null and empty texts have no tokens and stay; long texts are read whole; repeated rows are
    documents of their own; an empty table gives no rows; other columns are passed on, whatever they are called.
    """
    model = mixing.train(docs, table(spark, sf_dir, "labels"), DOMAINS)
    return mixing.mix(docs, model, TARGETS, least=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and the decoded text.

    As bpe.encode_decode says: null texts count as empty and have no tokens; long texts are encoded whole; repeated
    rows give a row each; an empty table gives no rows; other columns are not read.
    """
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL expresses the trained and hashed stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
