"""Connected components of an edge table, in a few shuffles a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from doctriage.session import written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the smallest node around it."""
    pairs = both_ways(edges)
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    return (pairs.filter(F.col("b") > F.col("a")).join(least, "a")
            .select(F.least("a", "m").alias("a"), "b").distinct())


def small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.col("b").alias("node"), F.col("a").alias("to"))
    least = down.groupBy("node").agg(F.min("to").alias("m"))
    return (down.join(least, "node").filter(F.col("to") > F.col("m"))
            .select(F.col("m").alias("a"), F.col("to").alias("b"))
            .union(least.select(F.col("m").alias("a"), F.col("node").alias("b"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; the root is its least member.

    Large-star and small-star rounds on integer nodes, until the edges stay as they are;
    each round is written to the shared folder. Loops and repeated edges are ignored.
    """
    edges = written(edges.filter(F.col("a") != F.col("b"))
                    .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        edges = written(small_star(large_star(edges)), "edges")
    return (edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            .union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()))
