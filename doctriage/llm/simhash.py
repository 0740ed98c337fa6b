"""SimHash near-dedup by deletion-variant signatures.

A fingerprint is cut into so few segments that, of two fingerprints that link, at least
one segment differs by one bit at most. Each segment is indexed under its variants with
one bit wiped out, so such a pair meets under an equal key; the distance is then verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from doctriage.llm.common import small_side
from doctriage.llm.components import components
from doctriage.session import written

SEED = 42
BLOCK = 1 << 16                 # shingles hashed at a time
VARIANT_ROWS = 2_000_000        # variants that one task counts, about
CROWDED_ROWS = 1_000_000        # crowded keys, two numbers each, that are broadcast
LIGHT = 64                      # members of a key that are compared at once
CHUNK = 512                     # members on one side of a block of a heavier key
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


@dataclass(frozen=True)
class Signature:
    """Words to a shingle, segments of the fingerprint, bits of each, largest distance.

    Every pair within ``2 * segments - 1`` bits is found for certain, whatever the data.
    A fingerprint has at most 64 bits.
    """
    shingle: int
    segments: int
    segment_bits: int
    max_distance: int

    @property
    def bits(self) -> int:
        return self.segments * self.segment_bits


CONTRACT = Signature(shingle=3, segments=2, segment_bits=32, max_distance=2)


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of the lower-cased (A-Z) words, in blocks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    firsts, lasts = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        yield np.array([digest(joined[a:b], SEED) for a, b in
                        zip(firsts[at:at + BLOCK], lasts[at:at + BLOCK])], dtype="<u8")


def fingerprint_bits(blocks: Iterable[np.ndarray], bits: int) -> np.ndarray:
    """The fingerprint's bits, lowest first: 1 where over half of all hashes have a 1."""
    ones, total = np.zeros(64, np.int64), 0
    column = np.arange(8, dtype=np.int64) * 256
    for hashes in blocks:
        total += len(hashes)
        cells = hashes.view(np.uint8).reshape(-1, 8) + column
        counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256)
        ones += (counts @ _BYTE_BITS).ravel()
    return (ones * 2 > total)[:bits]


def segment_values(text: str | None, signature: Signature) -> list[int]:
    bits = fingerprint_bits(shingle_hashes(text, signature.shingle), signature.bits)
    powers = 1 << np.arange(signature.segment_bits, dtype=np.int64)
    return (bits.reshape(signature.segments, -1) @ powers).tolist()


def fingerprints(docs: DataFrame, id_column: str, text_column: str,
                 signature: Signature) -> DataFrame:
    """``id, segs``: the segments of each document's fingerprint, lowest bits first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segs = [segment_values(t.as_py(), signature) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(segs, pa.list_(pa.int64()))], names=["id", "segs"])

    return docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("t")
                       ).mapInArrow(run, "id bigint, segs array<bigint>")


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")),
                       F.lit(0), lambda total, n: total + n)


def wiped(value: Column, bit: Column) -> Column:
    one = F.lit(1).cast("bigint")
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, bit)))


def variants(nodes: DataFrame, signature: Signature) -> DataFrame:
    """``key, node``: a key for each segment and each bit of it that is wiped out."""
    b = signature.segment_bits
    keys = F.flatten(F.transform("segs", lambda seg, s: F.transform(
        F.sequence(F.lit(0), F.lit(b - 1)),
        lambda j: (s * b + j).cast("bigint") * F.lit(1 << b) + wiped(seg, j))))
    return nodes.select(F.explode(keys).alias("key"), "node")


Links = tuple[np.ndarray, np.ndarray, np.ndarray]       # a, b, d


def distances(segs: np.ndarray) -> np.ndarray:
    far = np.zeros((len(segs), len(segs)), np.int32)
    for column in segs.astype(np.uint64).T:
        far += np.bitwise_count(column[:, None] ^ column[None, :])
    return far


def forest(nodes: np.ndarray, segs: np.ndarray, max_distance: int) -> Links:
    """All pairs of nodes compared; a spanning forest of least distances comes back, as its
    links ``a, b, d`` within ``max_distance``."""
    order = np.argsort(nodes)
    nodes, segs = nodes[order], segs[order]
    far = distances(segs)
    reached = 1 << 20
    gap, tip, at = np.full(len(nodes), reached - 1), np.zeros(len(nodes), np.int64), 0
    found = []
    for _ in range(len(nodes) - 1):
        gap[at] = reached
        closer = (far[at] < gap) & (gap < reached)
        gap[closer], tip[closer] = far[at][closer], at
        at = int(gap.argmin())
        if gap[at] <= max_distance:
            found.append((tip[at], at, gap[at]))
    a, b, d = np.array(found, np.int64).reshape(-1, 3).T
    return np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b]), d


def light_links(members: DataFrame, max_distance: int) -> DataFrame:
    """Links within keys of at most ``LIGHT`` members, each set of members looked at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            ends = (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
            flat = column.flatten()
            nodes = flat.field("node").to_numpy()
            segs = flat.field("segs").flatten().to_numpy().reshape(len(nodes), -1)
            found = [forest(nodes[a:b], segs[a:b], max_distance) for a, b in zip(ends, ends[1:])]
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in columns],
                names=["a", "b", "d"])

    return (members.groupBy("key")
            .agg(F.sort_array(F.collect_set(F.struct("node", "segs"))).alias("members"))
            .select("members").distinct().mapInArrow(run, "a bigint, b bigint, d bigint"))


def two_bit_links(nodes: DataFrame, signature: Signature) -> DataFrame:
    """Links within two bits by all two-bit variants of whole 64-bit fingerprints.

    Linear in the nodes: a variant has at most four members, all of which link.
    """
    fp = F.call_function("shiftleft", F.col("segs")[1], F.lit(32)).bitwiseOR(F.col("segs")[0])
    firsts = F.sequence(F.lit(0), F.lit(signature.bits - 2))
    keyed = (nodes.select("node", fp.alias("fp"), F.explode(firsts).alias("i"))
             .repartition("node", "i")
             .select("node", "i", wiped(F.col("fp"), F.col("i")).alias("fp"),
                     F.explode(F.sequence(F.col("i") + 1, F.lit(signature.bits - 1))).alias("j"))
             .select("node", "i", "j", wiped(F.col("fp"), F.col("j")).alias("rest")))
    met = (keyed.groupBy("i", "j", "rest").agg(F.collect_set("node").alias("ns"))
           .filter(F.size("ns") > 1))
    return (met.select(F.array_min("ns").alias("a"), F.explode("ns").alias("b"))
            .filter(F.col("a") != F.col("b")).distinct()
            .withColumn("d", F.lit(signature.max_distance).cast("bigint")))


def block_links(members: DataFrame, max_distance: int) -> DataFrame:
    """Links within the heavy keys: blocks of chunk against chunk, in numpy.

    ``members`` has ``key, n, node, segs``. Every pair of a key is compared, in tasks of two
    chunks at most; a block returns no pairs but a spanning forest.
    """
    def trees(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip("abd", forest(
            pdf["node"].to_numpy(), np.stack(pdf["segs"].to_numpy()), max_distance))))

    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    placed = (members.withColumn("chunks", chunks)
              .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .select("key", F.least("mine", "other").alias("lo"),
                      F.greatest("mine", "other").alias("hi"), "node", "segs"))
    return placed.groupBy("key", "lo", "hi").applyInPandas(trees, "a bigint, b bigint, d bigint")


def meetings(nodes: DataFrame, signature: Signature) -> tuple[DataFrame, DataFrame]:
    """The keys that nodes share, and ``key, n, node`` of those that three or more share."""
    tasks = -(-nodes.count() * signature.bits // VARIANT_ROWS)
    keyed = variants(nodes.repartition(max(1, tasks), "node"), signature)
    met = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"),
                                           F.max("node").alias("b"))
                  .filter(F.col("n") > 1), "variant-keys")
    crowded = met.filter(F.col("n") > 2).select("key", "n")
    return met, written(keyed.join(small_side(crowded, CROWDED_ROWS), "key"), "variant-members")


def links(nodes: DataFrame, signature: Signature) -> DataFrame:
    """Edges ``a, b, d`` that join all nodes ``(node, segs)`` within the largest distance."""
    met, members = meetings(nodes, signature)
    light = light_links(members.filter(F.col("n") <= LIGHT).join(nodes, "node"),
                        signature.max_distance)
    pairs = met.filter(F.col("n") == 2).select("a", "b").distinct()
    left, right = (nodes.select(F.col("node").alias(x), F.col("segs").alias(f"segs_{x}"))
                   for x in "ab")
    near = (pairs.join(left, "a").join(right, "b")
            .select("a", "b", distance(F.col("segs_a"), F.col("segs_b")).cast("bigint").alias("d"))
            .filter(F.col("d") <= signature.max_distance).union(light))
    heavy = members.filter(F.col("n") > LIGHT)
    if signature.bits == 64 and signature.segments == 2 and signature.max_distance == 2:
        some = heavy.select("node").distinct()
        return near.union(two_bit_links(nodes.join(some, "node"), signature))
    return near.union(block_links(heavy.join(nodes, "node"), signature.max_distance))


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                signature: Signature = CONTRACT) -> DataFrame:
    """One row per document: ``id, segs, component_id``.

    Words are runs of characters other than ASCII white space, with A-Z in lower case. A
    text of fewer words than a shingle is one shingle; one without words, null or empty,
    has the fingerprint zero, which links like any other. Documents link when their
    fingerprints differ in at most ``max_distance`` bits. ``component_id`` is the smallest
    id that links reach. A null id takes part through its fingerprint if that has another
    id; with none, its component is null. Repeated rows each get a row.
    """
    prints = written(fingerprints(docs, id_column, text_column, signature), "fingerprints")
    nodes = written(prints.groupBy("segs").agg(F.min("id").alias("node"))
                    .filter(F.col("node").isNotNull()), "distinct-fingerprints")
    named = (nodes.join(components(links(nodes, signature)), "node", "left")
             .select("segs", F.coalesce("root", "node").alias("component_id")))
    return prints.join(named, "segs", "left").select("id", "segs", "component_id")


def simhash_groups(docs: DataFrame, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of 64-bit fingerprints of three-word shingles."""
    part = lambda i: F.lpad(F.hex(F.col("segs")[i]), 8, "0")
    return near_groups(docs, id_column, text_column).select(
        F.col("id").alias(id_column), F.lower(F.concat(part(1), part(0))).alias("fingerprint"),
        "component_id")


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               signature: Signature = CONTRACT) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies, the smallest id.

    Groups are those of ``near_groups``. Rows with a null id stay. Rows that share an id and
    its text, null included, are one document, of which the least row in the order of the
    other columns stays; different texts under one id all stay if the id does.
    """
    stays = (near_groups(docs, id_column, text_column, signature)
             .filter(F.col("id") == F.col("component_id")).select("id").distinct())
    others = [c for c in docs.columns if c not in (id_column, text_column)]
    row = F.struct(*others) if others else F.lit(0)
    with_id = (docs.join(stays, docs[id_column] == stays["id"], "left_semi")
               .groupBy(id_column, text_column).agg(F.min(row).alias("__row"))
               .select(id_column, text_column, *(F.col("__row")[c].alias(c) for c in others)))
    return (with_id.select(*docs.columns)
            .unionByName(docs.filter(F.col(id_column).isNull())))
