"""Periodic runs of words, by descending-LCP Kruskal.

Suffixes of a document's word sequence are united into classes by decreasing longest common
prefix (LCP), with union-find over ordered sets of positions. Two positions that become
neighbours in a class at LCP ``l`` repeat each other for exactly ``l`` words; if their distance
``q`` is small against ``l``, they seed a run of period ``q``, which is ``l + q`` words long
where the word before it breaks the period.

Why neighbours suffice: a position between the two, in the same class, would repeat them at a
smaller distance, and two periods over such a length have their common divisor as a period.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MIN_LENGTH = 6
MIN_EXPONENT = 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first occurrence's rank among distinct words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeats(ids: np.ndarray, size: int) -> bool:
    """Whether some stretch of ``size`` words may occur twice (by hash: never a false no)."""
    if len(ids) <= size:
        return False
    mixed = np.zeros(len(ids) - size + 1, np.uint64)
    for i in range(size):
        mixed = (mixed ^ ids[i:i + len(mixed)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks of the stretches of 1, 2, 4, ... words."""
    n, levels, rank, width = len(ids), [ids], ids, 1
    while True:
        key = rank * (n + 1)
        key[:n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order, levels
        levels.append(rank)
        width *= 2


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix and the next one in order have in common."""
    n, common = len(order), np.zeros(len(order) - 1, np.int64)
    for level in reversed(range(len(levels))):
        a, b = order[:-1] + common, order[1:] + common
        inside = (a < n) & (b < n)
        same = levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)]
        common += np.where(inside & same, 1 << level, 0)
    return common


def unite(small: list[int], large: list[int]) -> list[int]:
    """Both ordered sets as one; the larger one is reused where that is cheaper."""
    if len(small) * 16 > len(large):
        return sorted(large + small)
    for place in small:
        insort(large, place)
    return large


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` by start, then period.

    A run is a stretch with smallest period q, at least ``min_exponent`` (3 or more) periods
    and ``min_length`` words long, that no neighbouring word extends with that period.
    """
    # A run's first word and the one a period later share all but one period of the run.
    least = min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))
    if not repeats(ids, least):
        return []
    order, levels = suffix_order(ids)
    lcp = neighbour_lcp(order, levels)
    links = np.flatnonzero(lcp >= least)
    links = links[np.argsort(-lcp[links], kind="stable")]
    first, second, shared = order[links].tolist(), order[links + 1].tolist(), lcp[links].tolist()
    word, found = ids.tolist(), []
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b, common in zip(first, second, shared):
        a, b = root(a), root(b)
        small, large = places.pop(a, [a]), places.pop(b, [b])
        if len(small) > len(large):
            small, large, a, b = large, small, b, a
        parent[a] = b
        added = set(small)
        places[b] = joint = unite(small, large)
        for place in small:
            at = bisect_left(joint, place)
            for i, j in ((at - 1, at), (at, at + 1)):
                if i < 0 or j == len(joint) or (joint[i] in added and joint[j] in added):
                    continue
                i, j = joint[i], joint[j]
                q = j - i
                if (common >= (min_exponent - 1) * q and common + q >= min_length
                        and (i == 0 or word[i - 1] != word[j - 1])):
                    found.append((i, common + q, q))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those behind the first period of a run, joined by one space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    keep = (np.cumsum(depth[:-1]) == 0).tolist()
    return b" ".join([w for w, stays in zip(words, keep) if stays])


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``id, runs, collapsed``: one row per row, with the runs of its words.

    Words are what ASCII white space separates; a null, empty or blank text has none, no runs
    and an empty collapsed text. Ids may be null or repeat; other columns are not read. A text is
    handled in one task, in O(n log n) sorting steps and some hundred bytes of memory a word,
    whatever its length; nothing is shuffled. An empty table gives an empty result.
    """
    if min_exponent < 3:
        raise ValueError("neighbours in a class are sure to show runs of three periods or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for value in batch.column(1):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                found = find_runs(word_numbers(words), min_length, min_exponent)
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(collapsed(words, found).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.string())],
                names=[id_column, "runs", "collapsed"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).alias("__text")).mapInArrow(
        run, f"`{id_column}` {kind}, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """``id, text``: a tenth of the documents, by a hash of the id, repeats its own words.

    Of such a document's n words, each from word a on becomes word ``a + (i - a) % p``. Texts
    of null ids, null texts and all others stay as they are.
    """
    words = F.filter(F.split(text_column, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col(id_column).cast("string").cast("binary"))
    g, n = F.floor(h / 10).cast("bigint"), F.size("__words").cast("bigint")
    a = F.col("__g") % F.col("__n")
    p = 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8)).cast("bigint")
    tail = F.transform(
        F.sequence(F.col("__a"), F.col("__n") - 1),
        lambda i: F.get("__words", (F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int")))
    edited = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a").cast("int")), tail), " ")
    return (docs.select(id_column, F.col(text_column), F.when(h % 10 == 0, words).alias("__words"),
                        g.alias("__g"))
            .withColumn("__n", n).withColumn("__a", F.when(F.col("__n") > 0, a)).withColumn("__p", p)
            .select(id_column, F.when(F.col("__n") > 0, edited).otherwise(F.col(text_column))
                    .alias(text_column)))


def run_digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The run with the greatest length by period, counts and digests of ``periodic_runs``."""
    runs = F.col("runs")
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.reduce(runs, none, lambda top, r: F.when(
        top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(
        ",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("__best", best)
            .select(id_column, F.size(runs).cast("bigint").alias("n_runs"),
                    F.col("__best.start").alias("start"), F.col("__best.length").alias("length"),
                    F.col("__best.period").alias("period"),
                    F.expr("1000 * __best.length div __best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))
