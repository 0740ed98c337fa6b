"""The corpus pipeline: language, lines, near copies, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from doctriage.llm import language, line_dedup, mixing, packing, simhash
from doctriage.llm.common import shipped
from doctriage.session import written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier, fitted on the table, doesn't reject."""
    return language.accepted(docs, language.fit(docs))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; one that held nothing else goes."""
    out = line_dedup.line_dedup(docs).filter(
        (F.col("n_removed") == 0) | (F.trim("text") != "") | F.col("text").isNull())
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint"))
                          .otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.near_dedup(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with its ``slot`` and ``place`` in the mixture of sources."""
    return mixing.in_mixture_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, which follow the mixture: groups are ranges of slots."""
    slots = packing.GROUP_DOCUMENTS // mixing.BLOCK_DOCUMENTS
    return packing.pack(docs, group=F.floor(F.col("slot") / slots).cast("bigint"))


STAGES = [("language_id", shipped(identify_languages)), ("line_dedup", shipped(drop_boilerplate)),
          ("simhash_near_dedup", shipped(drop_near_copies)), ("mix_sources", shipped(mix_sources)),
          ("packing", shipped(pack_sequences))]

# Fingerprints, the fitted model, the schedule and the tokenizer are beyond SQL; the tests
# hold each stage, and the whole, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
