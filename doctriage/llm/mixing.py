"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of documents. In the fluid schedule all sources that still have
blocks are served at once, each at its weight's share of a slot; one that runs out leaves its
share to the others from that moment on. A block may not start before the slot in which the
fluid schedule begins to serve it, and is due by the end of the slot in which it is through.
Earliest deadline first among the released blocks meets every deadline, so that after any
number of slots each source is less than one block away from what the fluid schedule gave it.

The schedule is cut into rounds that tasks work out apart from each other. A round starts with
the queue that the one before left, so that the rounds together are one schedule.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from doctriage.session import written

BLOCK_DOCUMENTS = 16
ROUND_SLOTS = 1024          # of a round at least
SOURCE_SLOTS = 16           # of a round at least for each source
KEPT_ROUNDS = 2048          # rounds whose schedule a task keeps
BUCKET_DOCUMENTS = 4096     # documents that one task ranks at a time, on average
TEMPERATURE = 0.5           # weights follow the source sizes to this power
NEAR = 1e-6                 # a part of a slot that counts as none; sources are fewer than 1 / it
MAX_SOURCES = 100_000       # the list of sources is held by the driver and sent to tasks


class Fluid:
    """The fluid schedule of ``sizes`` blocks of each source: when blocks begin and end.

    After a source's ``k`` blocks the fluid level is ``k / weight``; the sources whose size
    is below that level are through, and all others have their weight times the level. What is
    within ``NEAR`` of a whole number of slots, as weights such as a third make it, counts as
    that number.
    """

    def __init__(self, sizes: np.ndarray, weights: np.ndarray) -> None:
        self.sizes, self.weights = sizes, weights.astype(np.longdouble)
        levels = sizes / self.weights
        order = np.argsort(levels, kind="stable")
        self.levels = levels[order]
        self.through = np.r_[0, np.cumsum(sizes[order])]        # blocks of the sources before
        self.rates = np.cumsum(self.weights[order][::-1])[::-1]
        self.ends = self.through[:-1] + self.rates * self.levels

    def time(self, source: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """When the source's first ``blocks`` are through, in slots."""
        level = blocks / self.weights[source]
        phase = np.minimum(np.searchsorted(self.levels, level), len(self.levels) - 1)
        return self.through[phase] + self.rates[phase] * level

    def release(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        return np.floor(self.time(source, block) + NEAR).astype(np.int64)

    def deadline(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        return np.ceil(self.time(source, block + 1) - NEAR).astype(np.int64)

    def due_by(self, slot: int) -> np.ndarray:
        """How many blocks of each source have a deadline at or before ``slot``."""
        every = np.arange(len(self.sizes))
        phase = min(np.searchsorted(self.ends, slot), len(self.ends) - 1)
        level = (slot - self.through[phase]) / self.rates[phase]
        due = np.clip(np.floor(self.weights * level).astype(np.int64), 0, self.sizes)
        while (late := (due > 0) & (self.deadline(every, due - 1) > slot)).any():
            due[late] -= 1
        while (more := (due < self.sizes) & (self.deadline(every, due) <= slot)).any():
            due[more] += 1
        return due


def earliest_deadline_first(start: int, release: list[int], deadline: list[int],
                            source: list[int]) -> list[int]:
    """The slot of each block, one a slot from ``start`` on; ties go to the smaller source."""
    order = sorted(range(len(release)), key=lambda i: (release[i], source[i]))
    slots = [0] * len(order)
    ready: list[tuple[int, int, int]] = []
    at = 0
    for slot in range(start, start + len(order)):
        while at < len(order) and (release[order[at]] <= slot or not ready):
            i = order[at]
            heapq.heappush(ready, (deadline[i], source[i], i))
            at += 1
        slots[heapq.heappop(ready)[2]] = slot
    return slots


def boundaries(fluid: Fluid, slots: int) -> np.ndarray:
    """Blocks of each source that are through before each round, and at the end, in the
    schedule by earliest deadline: rounds + 1 by sources.

    At the end of a round all blocks are through whose deadline has come. What slots these
    leave free take blocks with later deadlines, at most one of each source, so that only
    those are put in order one by one.
    """
    had = np.zeros(len(fluid.sizes), np.int64)
    every, out, start, total = np.arange(len(had)), [had], 0, int(fluid.sizes.sum())
    while start < total:
        end = min(start + slots, total)
        due = np.maximum(fluid.due_by(end), had)
        n = due - had
        source = np.repeat(every, n)
        block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + had[source]
        release = np.maximum(fluid.release(source, block), start) - start
        arrived = np.cumsum(np.bincount(release, minlength=end - start))[:end - start]
        # Blocks through after each slot, if these were all: a slot without one is free.
        lag = np.minimum.accumulate(np.minimum(0, arrived - np.arange(1, end - start + 1)))
        free = (np.flatnonzero(np.diff(lag, prepend=0) < 0) + start).tolist()
        had = due.copy()
        # A source that is ahead of its due has no other block before its deadline.
        begun = every[(due < fluid.sizes) & (due == fluid.due_by(end))]
        began = fluid.release(begun, due[begun])
        begun, began = begun[began < end], began[began < end]
        order = np.lexsort((begun, began))
        late = fluid.deadline(begun, due[begun])
        ready: list[tuple[int, int]] = []
        waiting = list(zip(began[order].tolist(), late[order].tolist(), begun[order].tolist()))[::-1]
        for slot in free:
            while waiting and (waiting[-1][0] <= slot or not ready):
                heapq.heappush(ready, waiting.pop()[1:])
            if ready:
                had[heapq.heappop(ready)[1]] += 1
        out.append(had)
        start = int(had.sum())
    return np.array(out)


def slot_finder(fluid: Fluid, bounds: np.ndarray):
    """A function from arrays of source and block to release, deadline and slot."""
    starts = bounds.sum(axis=1)
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def schedule(n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in kept:
            if len(kept) >= KEPT_ROUNDS:
                kept.clear()
            mine = bounds[n + 1] - bounds[n]
            first = np.cumsum(mine) - mine
            source = np.repeat(np.arange(len(mine)), mine)
            block = np.arange(len(source)) - first[source] + bounds[n, source]
            kept[n] = (np.array(earliest_deadline_first(
                int(starts[n]), fluid.release(source, block).tolist(),
                fluid.deadline(source, block).tolist(), source.tolist()), np.int64), first)
        return kept[n]

    def find(source: np.ndarray, block: np.ndarray) -> pd.DataFrame:
        number = np.zeros(len(source), np.int64)
        for s in np.unique(source):
            at = source == s
            number[at] = np.searchsorted(bounds[:, s], block[at], side="right") - 1
        slot = np.zeros(len(source), np.int64)
        for n in np.unique(number).tolist():
            slots, first = schedule(n)
            at = np.flatnonzero(number == n)
            slot[at] = slots[first[source[at]] + block[at] - bounds[n, source[at]]]
        return pd.DataFrame({"release": fluid.release(source, block),
                             "deadline": fluid.deadline(source, block), "slot": slot})
    return find


def shuffled(docs: DataFrame, id_column: str, n_buckets: int) -> DataFrame:
    """``docs`` with a hash of the row's key to order by, and its bucket."""
    extra = [F.col("n_chars")] if "n_chars" in docs.columns else []
    return (docs.withColumn("__order", F.xxhash64(F.col(id_column), *extra))
            .withColumn("__bucket", F.pmod(F.xxhash64("__order"), F.lit(n_buckets))))


def source_name(source: str) -> Column:
    """The source as text; a null one is told apart from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, id_column: str = "doc_id",
        source_column: str = "source", block_documents: int = BLOCK_DOCUMENTS,
        round_slots: int = ROUND_SLOTS) -> DataFrame:
    """``docs`` with ``block, release, deadline, slot, place``: the place in the mixture.

    Reading in the order of ``(slot, place)`` gives the mixture: of the blocks that any
    prefix holds, each source's share is its weight's, to less than one block. Every document
    is in the mixture once. A source that runs out leaves its share to the others, in
    proportion to their weights, from the moment at which its share is used up.

    ``weights`` maps sources to target weights, taken in proportion; a source that it
    doesn't name, or a weight of zero, counts as one block in ``round_slots``, or in 16 a
    source if that is more. Without it, a source's
    weight is its size to the power ``TEMPERATURE``. A null source is a source of its own.
    Within a source the order is by a hash of the id; repeated rows follow each other.
    Input columns of the added names are replaced. An empty table gives an empty result.
    """
    added = ("block", "release", "deadline", "slot", "place")
    docs = docs.drop(*added)
    spark = docs.sparkSession
    named = docs.withColumn("__source", source_name(source_column))
    n_buckets = max(1, docs.count() // BUCKET_DOCUMENTS)
    named = shuffled(named, id_column, n_buckets)
    counts = written(named.groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("n")),
                     "source-buckets")
    sources = (counts.groupBy("__source").agg(F.sum("n").alias("n")).orderBy("__source")
               .limit(MAX_SOURCES + 1).collect())
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix groups of sources instead")
    rows = np.array([r["n"] for r in sources], np.int64)
    sizes = -(-rows // block_documents)
    given = (np.array([(weights.get(r["__source"][1:]) if r["__source"] != "null" else None) or 0
                       for r in sources], float) if weights else rows.astype(float) ** TEMPERATURE)
    slots = max(round_slots, SOURCE_SLOTS * len(rows))
    given = (np.where(given > 0, given, given.sum() / slots) if given.sum() > 0
             else np.ones(len(rows)))
    fluid = Fluid(sizes, given)
    find = slot_finder(fluid, boundaries(fluid, slots))

    @F.pandas_udf("release bigint, deadline bigint, slot bigint")
    def scheduled(source: pd.Series, block: pd.Series) -> pd.DataFrame:
        return find(source.to_numpy(), block.to_numpy())

    numbered = spark.createDataFrame([(r["__source"], i) for i, r in enumerate(sources)],
                                     "__source string, __number bigint")
    before = (counts.withColumn("__before", F.coalesce(F.sum("n").over(
        Window.partitionBy("__source").orderBy("__bucket")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(F.broadcast(numbered), "__source").select("__source", "__bucket", "__before",
                                                        "__number"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__order")
    ranked = (named.withColumn("__rank", F.row_number().over(inside) - 1)
              .join(before.hint("shuffle_hash"), ["__source", "__bucket"])
              .withColumn("__rank", F.col("__rank") + F.col("__before"))
              .withColumn("block", F.floor(F.col("__rank") / block_documents).cast("bigint"))
              .withColumn("__at", scheduled("__number", "block")))
    return ranked.select(*docs.columns, "block", "__at.release", "__at.deadline", "__at.slot",
                         (F.col("__rank") % block_documents).cast("bigint").alias("place"))


def in_mixture_order(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the ``slot`` and ``place`` of ``mix``, its rows in the order of the
    mixture: by partition, and within each, so that files written from it hold it in order.

    Rows with nulls in any column, repeated rows and empty tables are as in ``mix``.
    """
    return (mix(docs, **settings).drop("block", "release", "deadline")
            .repartitionByRange("slot", "place").sortWithinPartitions("slot", "place"))
