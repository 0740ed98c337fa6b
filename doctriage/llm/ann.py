"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample and split it at medians of projections. Every
vector is then put into its leaf of each tree. A query searches all trees at once through
one priority queue, nearest split first, until the leaves it has visited hold its budget
of rows; the candidates in those leaves are ranked by their exact inner product.

How large a budget the data need is measured on the sample: data in clusters need little,
data spread evenly over all directions need a large share of the rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from doctriage.session import written

TREES = 8
ROUNDING = 1e-12            # of a product of vectors, relative to their norms
SAMPLE_ROWS = 20_000        # vectors the forest is fitted on, at most
LEAF_ROWS = 512             # aimed at, over the whole table
LEAF_SAMPLE = 16            # least sample rows of a leaf; bounds the number of leaves
TUNING_QUERIES = 100
TUNING_RECALL = 0.96
LEAST_BUDGET = 4096
CHUNK = 4096                # vectors, or queries, of a leaf that one task holds
FAN_IN = 1024               # lists of candidates of one query that are merged at a time


@dataclass
class Forest:
    normals: np.ndarray     # inner nodes x dimensions
    cuts: np.ndarray
    children: np.ndarray    # inner nodes x 2; a leaf l is -1 - l
    roots: list[int]

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        out = np.empty((len(points), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(points), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                side = (np.einsum("ij,ij->i", points[inner], self.normals[node])
                        > self.cuts[node]).astype(int)
                at[inner] = self.children[node, side]
            out[:, t] = -1 - at
        return out

    def visits(self, margins: list[float]) -> Iterator[int]:
        """Leaves in the order of the queue, for a query's signed distances to all splits."""
        children = self.lists
        queue = [(0.0, root) for root in self.roots]
        while queue:
            far, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node]
                low, high = children[node]
                near, other = (high, low) if m > 0 else (low, high)
                heapq.heappush(queue, (max(far, abs(m)), other))
                node = near
            yield -1 - node

    @property
    def lists(self) -> list[list[int]]:
        if not hasattr(self, "_lists"):
            self._lists = self.children.tolist()
        return self._lists

    def margins(self, points: np.ndarray) -> np.ndarray:
        return points @ self.normals.T - self.cuts


def grow(points: np.ndarray, trees: int, leaf_rows: int, seed: int = 11) -> Forest:
    """Trees of median splits along random directions, down to ``leaf_rows`` points."""
    rng = np.random.default_rng(seed)
    normals, cuts, children, roots = [], [], [], []
    leaves = 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf_rows:
            a, b = points[rng.choice(rows, 2, replace=False)]
            normal = a - b if (a != b).any() else rng.normal(size=points.shape[1])
            normal = normal / np.linalg.norm(normal)
            along = points[rows] @ normal
            cut = float(np.median(along))
            above = along > cut
            if above.any():
                node = len(normals)
                normals.append(normal)
                cuts.append(cut)
                children.append([0, 0])
                children[node] = [split(rows[~above]), split(rows[above])]
                return node
        leaves += 1
        return -leaves

    for _ in range(trees):
        roots.append(split(np.arange(len(points))))
    return Forest(np.array(normals).reshape(len(normals), points.shape[1]), np.array(cuts),
                  np.array(children, int).reshape(len(children), 2), roots)


def needed_share(forest: Forest, points: np.ndarray, k: int, recall: float,
                 queries: int) -> float:
    """Visited rows, as a share of all, after which ``recall`` of the true neighbours of
    sample queries have turned up."""
    members = forest.leaves(points)
    held: dict[int, list[int]] = {}
    for row, leaves in enumerate(members.tolist()):
        for leaf in leaves:
            held.setdefault(leaf, []).append(row)
    costs: list[int] = []
    step = max(1, len(points) // queries)
    for q in range(0, len(points), step):
        exact = points[:, :-1] @ points[q, :-1]
        exact[q] = -np.inf
        wanted = np.argpartition(-exact, min(k, len(points) - 1) - 1)[:k].tolist()
        probe = np.append(points[q, :-1], 0.0)
        left, seen = set(wanted) - {q}, 0
        for leaf in forest.visits(forest.margins(probe[None])[0].tolist()):
            rows = held.get(leaf, [])
            seen += len(rows)
            found = left.intersection(rows)
            costs += [seen] * len(found)
            left -= found
            if not left:
                break
    return float(np.quantile(costs, recall)) / len(points) if costs else 1.0


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    return (vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                                          & (F.abs(x) != float("inf")))
            & F.exists(vector, lambda x: x != 0))


def stacked(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """One more component, so that all have the norm ``top``: the largest inner product
    with a query (whose extra component is zero) is then the nearest point."""
    rest = np.sqrt(np.maximum(0, top * top - (vectors * vectors).sum(axis=1)))
    return np.hstack([vectors, rest[:, None]])


def best_rows(query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int,
              longest: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best ids and scores, ties to smaller ids. Scores are summed the same way
    wherever a pair is met: a matrix product picks all rows that lie within its rounding of
    the ``k``-th best; ``longest`` is the largest norm of the vectors."""
    rough = vectors @ query
    some = np.arange(len(rough))
    if len(rough) > k:
        margin = ROUNDING * longest * np.sqrt(query @ query)
        some = np.flatnonzero(rough >= np.partition(rough, -k)[-k] - margin)
    exact = (vectors[some] * query).sum(axis=1)
    order = np.lexsort((ids[some], -exact))[:k]
    return ids[some][order], exact[order]


def merged(found: DataFrame, parts: int, k: int) -> DataFrame:
    """The best ``k`` candidates of each query, from its lists dealt over ``parts`` parts.

    A node found in several trees has the same score in each list and is kept once. Lists
    are merged in rounds of about ``FAN_IN``, so that no row grows with the table.
    """
    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column("found")
            ids, scores = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            ends = lists.offsets.to_numpy()
            out_ids, out_scores = [], []
            for at, end in zip(ends[:-1] - ends[0], ends[1:] - ends[0]):
                order = at + np.lexsort((ids[at:end], -scores[at:end]))
                again = np.r_[False, ids[order][1:] == ids[order][:-1]]
                order = order[~again][:k]
                out_ids.append(ids[order])
                out_scores.append(scores[order])
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), batch.column("part"),
                 pa.array(out_ids, pa.list_(pa.int64())),
                 pa.array(out_scores, pa.list_(pa.float64()))],
                names=["query", "part", "ids", "scores"])

    while True:
        found = (found.groupBy("query", "part")
                 .agg(F.flatten(F.collect_list(F.arrays_zip("ids", "scores"))).alias("found"))
                 .mapInArrow(shorten, "query bigint, part bigint, ids array<bigint>, "
                                      "scores array<double>"))
        if parts == 1:
            return found.drop("part")
        parts = -(-parts // FAN_IN)
        found = found.withColumn("part", F.col("part") % parts)


def candidates(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query, ids, scores``: the best ``k`` nodes in the leaves that a query visits."""
    rows, top = nodes.agg(F.count(F.lit(1)), F.max(F.aggregate(
        "vec", F.lit(0.0), lambda s, x: s + x * x))).first()
    if not rows:
        return nodes.select(F.col("node").alias("query"), F.array("node").alias("ids"),
                            F.array(F.lit(0.0)).alias("scores"))
    top = float(np.sqrt(top))
    sample = (nodes.orderBy(F.xxhash64("node")).limit(SAMPLE_ROWS).select("vec")
              .toArrow().column("vec").combine_chunks())
    points = lifted(stacked(sample), top)
    forest = grow(points, TREES, max(LEAF_SAMPLE, LEAF_ROWS * len(points) // rows))
    share = needed_share(forest, points, k, TUNING_RECALL, TUNING_QUERIES)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaves = forest.leaves(lifted(stacked(batch.column("vec")), top))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(list(leaves), pa.list_(pa.int64()))],
                    names=["node", "vec", "leaves"])

    placed = written(nodes.select("node", "vec").mapInArrow(
        place, "node bigint, vec array<double>, leaves array<bigint>"), "leaves")
    held = {r["leaf"]: r["n"] for r in placed.select(F.explode("leaves").alias("leaf"))
            .groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    budget = max(LEAST_BUDGET, share * rows)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            vectors = stacked(batch.column("vec")) if len(batch) else []
            for at in range(0, len(vectors), 256):
                block = vectors[at:at + 256]
                block = np.hstack([block, np.zeros((len(block), 1))])
                for margins in forest.margins(block):
                    seen, leaves = 0, []
                    for leaf in forest.visits(margins.tolist()):
                        if n := held.get(leaf):
                            leaves.append(leaf)
                            seen += n
                        if seen >= budget:
                            break
                    out.append(leaves)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("vec"), pa.array(out, pa.list_(pa.int64()))],
                names=["node", "vec", "leaves"])

    visits = written(queries.select("node", "vec").mapInArrow(
        visit, "node bigint, vec array<double>, leaves array<bigint>"), "visits")
    visited = {r["leaf"]: r["n"] for r in visits.select(F.explode("leaves").alias("leaf"))
               .groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}

    # A leaf is cut into chunks of rows and of queries; both maps have an entry for each
    # leaf of the forest, whose number is bounded by the sample.
    sizes = nodes.sparkSession.createDataFrame(
        [(leaf, -(-n // CHUNK), -(-visited.get(leaf, 0) // CHUNK)) for leaf, n in held.items()],
        "leaf bigint, row_chunks int, query_chunks int")

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        return (df.select("node", "vec", F.explode("leaves").alias("leaf"))
                .join(F.broadcast(sizes), "leaf")
                .withColumn(mine, F.pmod(F.xxhash64("node"), F.col(f"{mine}_chunks")))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_chunks") - 1)))
                .select("leaf", F.col("row").cast("int"), F.col("query").cast("int"),
                        "node", "vec"))

    parts = -(-sum(-(-n // CHUNK) for n in held.values()) // FAN_IN)

    def rank(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asked):
            ids, vectors = rows["node"].to_numpy(), np.stack(rows["vec"].to_numpy())
            part = int(key[0] * 31 + key[1]) % parts
            longest = float(np.sqrt((vectors * vectors).sum(axis=1).max()))
            found = [(query, part, *best_rows(vec, ids, vectors, k, longest))
                     for query, vec in zip(asked["node"], asked["vec"])]
        return pd.DataFrame(found, columns=["query", "part", "ids", "scores"])

    keys = ("leaf", "row", "query")
    stored = dealt(placed, "row", "query").filter(F.col("query").isNotNull())
    asked = dealt(visits, "query", "row")
    ranked = stored.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        rank, "query bigint, part bigint, ids array<bigint>, scores array<double>")
    return merged(ranked, parts, k)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score``: for each row whose id is divisible by ``every``, the
    ``k`` rows of largest inner product that the search finds, other than the query's own.

    Nearest first, ties to smaller ids, rank from 1; all candidates when there are fewer.
    Vectors that are null, zero, of another length than most, or hold null or non-finite
    components take no part, nor do rows without an id. Equal vectors are searched once,
    however many rows hold them, and only their ``k + 1`` smallest ids can be among the
    nearest. Repeated rows are one row. Other columns are not read.
    """
    vec = F.col(vector_column).cast("array<double>")
    good = (vectors.select(F.col(id_column).cast("bigint").alias("id"), vec.alias("vec"))
            .filter(F.col("id").isNotNull() & usable(F.col("vec"))))
    length = (good.groupBy(F.size("vec").alias("size")).count()
              .orderBy(F.desc("count"), "size").first())
    good = good.filter(F.size("vec") == (length["size"] if length else 0))
    first_ids = Window.partitionBy("vec").orderBy("id")
    kept = written(good.distinct().withColumn("n", F.row_number().over(first_ids))
                   .filter(F.col("n") <= k + 1), "vectors")
    nodes = written(kept.filter(F.col("n") == 1).select(F.col("id").alias("node"), "vec"), "nodes")
    members = (kept.select("vec", "id").join(nodes, "vec").select("node", "id"))
    asked = (good.filter(F.col("id") % every == 0).distinct().join(nodes, "vec")
             .select(F.col("id").alias("query_id"), "node"))
    queries = nodes.join(asked.select("node").distinct(), "node", "left_semi")

    ranked = (candidates(nodes, queries, k + 1)
              .select("query", F.explode(F.arrays_zip("ids", "scores")).alias("b"))
              .select("query", F.col("b.ids").alias("node"), F.col("b.scores").alias("score"))
              .join(members, "node").select("query", "score", "id"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    lists = (ranked.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
             .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score")))
                                   .alias("best")))
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    return (asked.join(lists, asked["node"] == lists["query"])
            .select("query_id", F.posexplode(others).alias("at", "b"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias(id_column),
                    F.col("b.score").alias("score")))
