"""Hold-out splits that do not depend on partitioning, and exact cuts by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 4096


def split_hash(key: str | Column, seed: int) -> Column:
    """Hex digest of seed and key: the same for a row wherever it is computed."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def is_test(key: str | Column, seed: int = 42, share: float = 0.3) -> Column:
    """True for about ``share`` of the rows; stable under any repartitioning."""
    bound = f"{int(share * 16 ** 8):08x}"
    return F.substring(split_hash(key, seed), 1, 8) < bound


def hold_out(df: DataFrame, key: str, seed: int = 42, share: float = 0.3,
             leak: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train and test part. ``leak`` trains and tests on all rows, for comparison only."""
    if leak:
        return df, df
    test = is_test(key, seed, share)
    return df.filter(~test), df.filter(test)


def cut_value(df: DataFrame, value: Column, rank: int) -> tuple[int, int]:
    """``(cut, n_below)``: the ``rank``-th smallest integer and the rows below it.

    A histogram of at most 4,096 counts is narrowed to the bucket that holds the rank
    until the bucket is one value wide. Each round is a partial aggregation over one
    integer column; no sort, no global window, no collected rows.
    """
    values = df.select(value.cast("long").alias("v")).filter("v IS NOT NULL")
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None or rank < 1:
        raise ValueError("no row at this rank")
    below = 0
    while True:
        width = (high - low) // BUCKETS + 1
        counts = (values.filter(F.col("v").between(low, high))
                  .groupBy(F.expr(f"v div {width}").alias("b")).agg(
                      F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                  .orderBy("b").collect())                 # at most BUCKETS + 2 rows
        seen = 0
        for row in counts:
            if below + seen + row["n"] >= rank:
                break
            seen += row["n"]
        else:
            raise ValueError("no row at this rank")
        below += seen
        low, high = row["lo"], row["hi"]
        if low == high:
            return low, below


def first_by_rank(df: DataFrame, value: Column, tie_break: str, rank: int,
                  flag: str) -> DataFrame:
    """Add ``flag``: true for exactly the ``rank`` smallest rows by value.

    Only rows equal to the cut value are ranked, to settle ties.
    """
    if rank < 1:
        return df.withColumn(flag, F.lit(False))
    cut, below = cut_value(df, value, rank)
    tied = df.filter(value == cut)
    if tied.count() == rank - below:
        return df.withColumn(flag, F.coalesce(value <= cut, F.lit(False)))
    chosen = tied.orderBy(tie_break).limit(rank - below).select(
        F.col(tie_break).alias("_chosen"))
    marked = df.join(chosen, F.col(tie_break) == F.col("_chosen"), "left")
    return (marked.withColumn(flag, F.coalesce(value < cut, F.lit(False))
                              | F.col("_chosen").isNotNull())
            .drop("_chosen"))


def hash_rank(key: str, seed: int) -> Column:
    """60 bits of the split hash as an integer, for exact-size splits."""
    return F.conv(F.substring(split_hash(key, seed), 1, 15), 16, 10).cast("long")


def exact_hold_out(df: DataFrame, key: str, seed: int = 42, tenths: int = 3,
                   flag: str = "is_test") -> DataFrame:
    """Mark exactly ``ceil(tenths * n / 10)`` rows as test rows."""
    size = -(-df.count() * tenths // 10)
    return first_by_rank(df, hash_rank(key, seed), key, size, flag)


def validation_tail(df: DataFrame, order: str, tenths: int = 1,
                    flag: str = "is_validation") -> DataFrame:
    """Mark the last tenth of the rows in key order as validation rows."""
    kept = df.count() * (10 - tenths) // 10
    return (first_by_rank(df, F.col(order), order, kept, "_kept")
            .withColumn(flag, ~F.col("_kept")).drop("_kept"))


def shuffled(df: DataFrame, key: str, epoch: int, seed: int = 0) -> DataFrame:
    """Rows in a new order per epoch: range-partitioned by a per-epoch hash."""
    order = split_hash(key, seed * 1_000_003 + epoch)
    return df.withColumn("order_key", order).orderBy("order_key")
