"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doctriage.llm import (ann, exact_dedup, fingerprints, html_main, language, line_dedup, mixing,
                           packing, periodic, pseudo_lm, simhash, spelling, url_rules)
from doctriage.llm.common import read, shipped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL check."""
    def register(fn):
        QUERIES[fn.__name__] = shipped(fn)
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return register


@query()
def op1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(read(spark, folder, "embeddings", "vec_id", "embedding"))


@query()
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents", "doc_id", "source", "n_chars"))


@query(exact_dedup.SQL)
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, folder, "documents", "doc_id", "text"))


@query(url_rules.SQL)
def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in url_rules.RULES],
                                  "host string, path string, verdict string")
    return url_rules.url_verdicts(read(spark, folder, "pages", "page_id", "url"), rules)


@query()
def op5_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo_lm.pseudo_likelihood(read(spark, folder, "documents", "doc_id", "text"))


@query(line_dedup.SQL)
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "source", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


@query()
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, folder, "documents", "doc_id", "text"))


@query()
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text", "lang")
    return language.identify(docs, language.fit(docs))


@query()
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents", "doc_id", "text"))


@query()
def op10_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_main.main_texts(read(spark, folder, "pages", "page_id", "url", "html"))


@query(spelling.SQL)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return spelling.variant_groups(spelling.misspelt_words(docs))


@query(fingerprints.SQL)
def op12_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_digests(read(spark, folder, "documents", "doc_id", "text"))


@query()
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic.with_planted_runs(read(spark, folder, "documents", "doc_id", "text"))
    return periodic.run_digests(periodic.periodic_runs(docs))
