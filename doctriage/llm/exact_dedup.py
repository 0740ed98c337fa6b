"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries, one for each task, find the digests that may be frequent. They are
counted exactly, and the verified winners (at most ``counters`` of them) are broadcast, so
that rows of a large group never meet in one task. All other digests go through an
ordinary shuffle, in which no group holds more than ``rows / counters`` rows or so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from doctriage.llm.common import ascii_lower
from doctriage.session import written

COUNTERS = 1024


def text_digest(text: Column | str) -> Column:
    """SHA-256 of the text in lower case (A-Z only), as hex; null counts as empty."""
    return F.sha2(F.coalesce(ascii_lower(text), F.lit("")), 256)


def prune(counts: dict, counters: int) -> dict:
    """A Misra-Gries summary of ``counts`` with at most ``counters`` entries."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: n - cut for k, n in counts.items() if n > cut}


def summaries(column: str, counters: int):
    """For ``mapInArrow``: the Misra-Gries summary of each task's ``column``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            found = pc.value_counts(batch.column(column))
            for key, n in zip(found.field("values").to_pylist(),
                              found.field("counts").to_pylist()):
                counts[key] = counts.get(key, 0) + n
            counts = prune(counts, counters)
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                names=[column, "n"])
    return run


def frequent(digests: DataFrame, id_column: str, counters: int) -> DataFrame:
    """Digests of more than ``2 / counters`` of all rows, with exact size and largest id.

    A summary underestimates a count by at most ``rows / (counters + 1)`` over all tasks,
    so every such digest is among the ``counters`` largest estimates.
    """
    rows = digests.count()
    likely = (digests.select("digest").mapInArrow(summaries("digest", counters),
                                                  "digest binary, n bigint")
              .groupBy("digest").agg(F.sum("n").alias("n"))
              .orderBy(F.desc("n"), "digest").limit(counters).select("digest"))
    return (digests.join(F.broadcast(likely), "digest")
            .groupBy("digest").agg(F.max(id_column).alias("keep_id"),
                                   F.count(F.lit(1)).alias("group_size"))
            .filter(F.col("group_size") > max(1, rows // counters)))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                counters: int = COUNTERS) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; a null text is empty.
    Of equal texts the largest id stays. A null id never wins against another one, and in
    a group of null ids all stay. Rows that repeat an id and its text are one document and
    share its verdict, though each counts for ``group_size``. Other columns of the input
    are not read. An empty table gives an empty result.
    """
    digests = written(docs.select(F.col(id_column),
                                  F.unhex(text_digest(text_column)).alias("digest")), "digests")
    winners = written(frequent(digests, id_column, counters), "frequent-digests")
    hot = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    cold = (digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
            .withColumn("keep_id", F.max(id_column).over(group))
            .withColumn("group_size", F.count(F.lit(1)).over(group)))
    return hot.unionByName(cold).select(
        id_column, "keep_id", "group_size",
        F.col(id_column).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (SELECT doc_id, text_sha256, max(doc_id) OVER same AS keep_id,
             count(*) OVER same AS group_size
      FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
      WINDOW same AS (PARTITION BY text_sha256))
"""
