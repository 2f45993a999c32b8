"""The corpus pipeline: language ID, line dedup, near-dedup, packing.

Each stage takes all rows that the stage before kept and returns the columns of its
input; the last returns the pieces of packed sequences. ``run`` stores what a stage
returns as Parquet in the cluster's shared folder before the next reads it.

A document goes if it has no language (no text, no letter) or is foreign to all languages
that the labelled documents have, if each of its lines stands in an earlier document, or if it is near a document with a smaller id (five-word
shingles, similarity 0.8 or more). Of the others, only repeated lines are taken out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm import langid, line_dedup, minhash, packing
from turnweave.llm.common import read, stored

#: Language ID, verification on whole sets and tokenizers cannot be expressed in SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.learn_filters(docs, F.lit(False), with_floor=True))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, counts=False, keep_empty=False)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_near_duplicates(docs, words=5, percent=80, bands=28)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
