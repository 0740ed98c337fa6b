"""Line dedup by the spread of a line over distinct sites.

Each line's sites are counted with HyperLogLog sketches that merge by aggregation. Lines
whose estimate is near the threshold are counted exactly, and lines on enough sites are
taken out of the documents as boilerplate, but for their first occurrence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from doctriage.session import written

MIN_SITES = 10
MIN_CHARS = 16
SKETCH_LG_K = 12
BAND = 0.1          # over six standard errors of a sketch of 2^12 registers


def trimmed(line: Column) -> Column:
    """A line without spaces and line ends around it."""
    return F.trim(line, F.lit(" \t\r"))


def document_lines(docs: DataFrame, id_column: str, text_column: str, site_column: str,
                   min_chars: int) -> DataFrame:
    """One narrow row per counted line: document key, position, site and line hash.

    The key is the id with a hash of the text, so that rows that share an id keep apart
    unless they are repeats. The line's hash has 128 bits.
    """
    line = trimmed(F.col("line"))
    # The text's hash is worked out below the generator: beside it, once for every line.
    keyed = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"),
                        F.col(site_column).alias("site"), F.col(text_column).alias("text"))
    return (keyed.select("id", "text_hash", "site",
                         F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .filter(F.length(line) >= min_chars)
            .select("id", "text_hash", "site", "pos", F.xxhash64(line).alias("h1"),
                    F.xxhash64(F.lit(1), line).alias("h2")))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """``h1, h2, first``: lines on at least ``min_sites`` sites, and where each is first."""
    low, high = math.floor(min_sites * (1 - BAND)), math.ceil(min_sites * (1 + BAND)) + 1
    spread = written(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_LG_K)).alias("sites"),
             F.min(F.struct("id", "pos")).alias("first"))
        .filter(F.col("sites") >= low), "line-spread")
    near = spread.filter(F.col("sites") < high)
    exact = (lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
             .select("h1", "h2", "site").distinct()
             .groupBy("h1", "h2").agg(F.count("site").alias("n"))
             .filter(F.col("n") >= min_sites))
    return written(spread.filter(F.col("sites") >= high).select("h1", "h2", "first")
                   .unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi")
                                .select("h1", "h2", "first")), "boilerplate")


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               site_column: str = "source", min_sites: int = MIN_SITES,
               min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with boilerplate lines taken out, plus ``n_lines`` and ``n_removed``.

    A line is compared without the spaces around it, and counts if it has ``min_chars``
    characters then. It is boilerplate on ``min_sites`` distinct sites or more (a null site
    is none). Its first occurrence stays (smallest id, a null id before all, then
    position); rows that repeat an id and its text are the same document. All other lines
    and their order stay. A null text stays null, with no lines; an empty one has one line.
    Input columns of the two added names are replaced.
    """
    lines = document_lines(docs, id_column, text_column, site_column, min_chars)
    found = boilerplate(lines, min_sites)
    removed = (lines.join(found, ["h1", "h2"])
               .filter((~F.col("id").eqNullSafe(F.col("first.id")))
                       | (F.col("pos") != F.col("first.pos")))
               .groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"))
               .agg(F.collect_set("pos").alias("__removed")))
    # The lambda's variable stands for the lines, which are split once; positions are taken
    # out by a hash set, so that the work is linear in a document's lines.
    stays = F.array_except(F.sequence(F.lit(0), F.size(F.split(text_column, "\n")) - 1), "__removed")
    kept = F.transform(F.array(F.split(text_column, "\n")), lambda lines: F.array_join(
        F.transform(stays, lambda i: F.get(lines, i)), "\n"))[0]
    n_lines = F.coalesce(F.size(F.split(text_column, "\n")).cast("bigint"), F.lit(0))
    out = (docs.join(removed, F.col(id_column).eqNullSafe(F.col("__id"))
                     & (F.xxhash64(text_column) == F.col("__hash")), "left")
           .withColumns({
               "n_lines": F.when(F.col(text_column).isNull(), 0).otherwise(n_lines)
                          .cast("bigint"),
               "n_removed": F.when(F.col("__removed").isNull(), 0)
                             .otherwise(F.size("__removed")).cast("bigint")}))
    text = F.when(F.col("__removed").isNull(), F.col(text_column)).otherwise(kept)
    return out.withColumn(text_column, text).drop("__id", "__hash", "__removed")


SQL = f"""
WITH l AS (
  SELECT d, doc_id, source, i, line, trim(line, ' ' || chr(9) || chr(13)) AS t
  FROM (SELECT row_number() OVER () AS d, doc_id, source,
               unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents)),
b AS (
  SELECT t, min(doc_id) AS first_doc FROM l WHERE length(t) >= {MIN_CHARS}
  GROUP BY t HAVING count(DISTINCT source) >= {MIN_SITES}),
f AS (SELECT l.t, first_doc, min(i) AS first_i
      FROM l JOIN b ON l.t = b.t AND l.doc_id = b.first_doc GROUP BY 1, 2),
k AS (
  SELECT d, i, line, f.t IS NULL OR (doc_id = first_doc AND i = first_i) AS stays
  FROM l LEFT JOIN f ON l.t = f.t)
SELECT doc_id, g.n_lines, g.n_removed, g.text
FROM (SELECT row_number() OVER () AS d, doc_id FROM documents) n
JOIN (SELECT d, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS text
      FROM k GROUP BY d) g USING (d)
"""
