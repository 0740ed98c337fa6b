"""URL filters as a sort-merge range join.

A rule and a url get the same kind of key: the host's labels in reverse order, then the
path. All urls a rule fits then lie in one interval that starts at the rule's key, and the
intervals of two rules are nested or apart. So one sweep in key order is enough: what is
active at a url is the last rule before it with the rules around that one (the stack),
less those that the url has already left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from doctriage.llm.common import ascii_lower

END = "\x01"        # between host and path of a key
DEFAULT_VERDICT = "allow"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"),
         Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"),
         Rule("com", "/de/", "block")]


def url_host(url: Column | str) -> Column:
    """From the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column | str) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, labels: int) -> Column:
    """The last 1 to ``labels`` labels of a host, as arrays in reverse order."""
    parts = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
                       lambda n: F.slice(parts, 1, n))


def key_of(reversed_labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(reversed_labels, "."), F.lit(END), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``key, stack``: each rule's key, with the rule and all rules around it."""
    keyed = rules.select(
        key_of(F.reverse(F.split("host", r"\.")), F.col("path")).alias("key"),
        F.struct(F.length(F.concat("host", "path")).alias("length"),
                 F.length("host").alias("host_length"),
                 F.concat("host", "path").alias("rule"), F.col("verdict"),
                 F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
        .alias("entry")).dropDuplicates(["key"])
    prefixes = keyed.select("key", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", 1, n)))
        .alias("prefix"))
    around = keyed.select(F.col("key").alias("prefix"), "entry")
    return (prefixes.join(around, "prefix").groupBy("key")
            .agg(F.collect_list("entry").alias("stack")))


def url_verdicts(pages: DataFrame, rules: DataFrame, id_column: str = "page_id",
                 url_column: str = "url", default: str = DEFAULT_VERDICT,
                 lanes: int | None = None) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains, if the
    url's path starts with the rule's. The longest rule wins (host and path together, then
    the longer host); with no rule, ``rule`` is null and the verdict is ``default``. A null
    url, or one without ``://``, has empty host and path and fits no rule. Repeated rows
    each get a row. Other columns of the input are not read.

    Urls are dealt to ``lanes`` sweeps at random, so neither a hot host nor a much repeated
    url makes a large task; the rules go to each lane, rows = rules x lanes. A page's keys
    (one for each suffix of its host, up to the longest rule host) share a lane, so the
    best one is picked without another exchange.
    """
    spark = pages.sparkSession
    lanes = lanes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    urls = (pages.select(F.col(id_column), url_host(url_column).alias("host"),
                         url_path(url_column).alias("path"),
                         F.monotonically_increasing_id().alias("row"))
            .withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(lanes)))
            .withColumn("suffix", F.explode(suffixes(F.col("host"), labels)))
            .select("lane", key_of(F.col("suffix"), F.col("path")).alias("key"),
                    F.lit(1).alias("kind"), "row", id_column, "host", "path",
                    F.array_join(F.reverse("suffix"), ".").alias("suffix")))
    swept = rule_stacks(rules).select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lanes - 1).cast("bigint")))
        .alias("lane"),
        "key", F.lit(0).alias("kind"), "stack")
    order = (Window.partitionBy("lane").orderBy("key", "kind")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    active = (urls.unionByName(swept, allowMissingColumns=True)
              .withColumn("stack", F.last("stack", ignorenulls=True).over(order))
              .filter(F.col("kind") == 1)
              .withColumn("best", F.array_max(F.filter("stack", lambda r: (
                  r["rule_host"] == F.col("suffix"))
                  & F.startswith(F.col("path"), r["rule_path"])))))
    return (active.groupBy("lane", "row", id_column, "host", "path")
            .agg(F.max("best").alias("best"))
            .select(id_column, "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS n
  FROM pages),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT u.*, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC NULLS LAST,
                            length(rh) DESC) AS k
  FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
