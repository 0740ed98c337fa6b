"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the range, so its size follows
the text's. Sketches of parts merge into the sketch of the whole, and the share of one sketch
found in another estimates containment, however unequal the two texts are in length.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SHINGLE = 5
SCALE = 8                   # one hash in so many is kept
HASH_DIGITS = 16
ROWS_A_BUCKET = 20_000      # rows that are sorted together, about
BUCKETS = 2_000             # at most; beyond it, buckets get larger


def limit(scale: int) -> bytes:
    """The first hash that is not kept."""
    return ((1 << 64) // scale).to_bytes(9, "big")[1:] if scale > 1 else b"\xff" * 9


def sketch(text: str | None, shingle: int = SHINGLE, scale: int = SCALE) -> frozenset[bytes]:
    """The kept hashes: 64 bits of the MD5 of each shingle of words in lower case (A-Z).

    A text of fewer words is one shingle; one without words has an empty sketch. Where no
    hash lies below the limit, the least one is kept, so that short texts can be told apart.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return frozenset()
    joined, starts, ends, at = b" ".join(words), [], [], 0
    for word in words:
        starts.append(at)
        at += len(word)
        ends.append(at)
        at += 1
    below, least = limit(scale), b"\xff" * 9
    kept = set()
    for a, b in zip(starts, ends[min(shingle, len(words)) - 1:]):
        value = md5(joined[a:b]).digest()[:8]
        if value < below:
            kept.add(value)
        elif value < least:
            least = value
    return frozenset(kept or {least})


def merged(a: frozenset[bytes], b: frozenset[bytes], scale: int = SCALE) -> frozenset[bytes]:
    """The sketch of all shingles of both."""
    both = a | b
    kept = frozenset(h for h in both if h < limit(scale))
    return kept or frozenset(sorted(both)[:1])


def as_text(hashes: frozenset[bytes]) -> str:
    """The hashes in order, as hex; equal sketches give equal strings."""
    return b"".join(sorted(hashes)).hex()


def likeness(a: frozenset[bytes], b: frozenset[bytes]) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    union = len(a | b)
    return len(a & b) / union if union else 1.0


def containment(a: frozenset[bytes], b: frozenset[bytes]) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 for an empty ``a``."""
    return len(a & b) / len(a) if a else 1.0


def hashes_of(fingerprint: Column | str) -> Column:
    """A fingerprint string as an array of its hashes."""
    return F.regexp_extract_all(fingerprint, F.lit(f"([0-9a-f]{{{HASH_DIGITS}}})"))


def merged_fingerprint(fingerprint: Column | str, scale: int = SCALE) -> Column:
    """Aggregate: the fingerprint of all shingles of a group's texts.

    Its hashes are held at once; a group's union grows with its distinct shingles.
    """
    every = F.array_distinct(F.flatten(F.collect_set(hashes_of(fingerprint))))
    kept = F.filter(every, lambda h: h < limit(scale).hex())
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.slice(F.array_sort(every), 1, 1))
    return F.array_join(F.array_sort(kept), "")


def fingerprint_likeness(a: Column | str, b: Column | str) -> Column:
    """``likeness`` of two fingerprint strings."""
    union = F.size(F.array_union(hashes_of(a), hashes_of(b)))
    both = F.size(F.array_intersect(hashes_of(a), hashes_of(b)))
    return F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1)))


def fingerprint_containment(a: Column | str, b: Column | str) -> Column:
    """``containment`` of two fingerprint strings."""
    own = F.size(hashes_of(a))
    both = F.size(F.array_intersect(hashes_of(a), hashes_of(b)))
    return F.when(own == 0, 1.0).otherwise(both / F.greatest(own, F.lit(1)))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``id, fingerprint`` of every row; a null text counts as empty, other columns are not
    read, repeated rows each have their row, and nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([as_text(sketch(t, shingle, scale)) for t in texts],
                                           pa.string())], names=[id_column, "fingerprint"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).alias("__text")).mapInArrow(
        run, f"`{id_column}` {kind}, fingerprint string")


# ---- neighbours by descending id ----------------------------------------------------------

def in_ranges(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``bucket, ghost, id, h, text``: ranges of descending ids, each closed by the next
    range's first row as a ghost (the last one by the first range's).

    Ranges are cut at quantiles of the ids, and so are bounded however ids are spread; the
    driver holds the cuts and one key a range. Null ids come last; rows of one id are ordered
    by a hash of their text.
    """
    keyed = docs.select(F.col(id_column).alias("id"),
                        F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("h"),
                        F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = docs.count()
    parts = max(1, min(BUCKETS, rows // ROWS_A_BUCKET,
                       4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(id_column, shares, 10_000)).first()[0] if shares else None
    cuts = sorted(set(found or []), reverse=True)
    bucket = F.lit(0)
    if cuts:
        bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]),
                                 lambda c: F.col("id").isNull() | (F.col("id") < c)))
    keyed = keyed.withColumn("bucket", bucket)
    firsts = (keyed.groupBy("bucket").agg(F.max(F.struct("id", "h")).alias("first"))
              .orderBy("bucket").collect())
    before = [(firsts[i - 1]["bucket"], r["first"]["id"], r["first"]["h"])
              for i, r in enumerate(firsts)]
    kind = docs.schema[id_column].dataType.simpleString()
    ends = docs.sparkSession.createDataFrame(before, f"closes int, id {kind}, h bigint")
    ghosts = (keyed.withColumnsRenamed({"id": "own_id", "h": "own_h"})
              .join(F.broadcast(ends), F.col("own_id").eqNullSafe(F.col("id"))
                    & (F.col("own_h") == F.col("h")))
              .dropDuplicates(["closes"])
              .select(F.col("closes").alias("bucket"), F.lit(True).alias("ghost"), "id", "h", "text"))
    return (keyed.select("bucket", F.lit(False).alias("ghost"), "id", "h", "text")
            .unionByName(ghosts).repartition("bucket")
            .sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("id"), F.desc("h")))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first as many characters of another."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id",
                        text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next text, by descending integer id.

    ``id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_edited, contained_next``. One exchange of the texts into ranges of ids; each
    range is read in order, two texts at a time. A null text is empty, a row that is alone is
    its own next, repeated rows follow each other. An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for bucket, ghost, key, text in zip(*(batch.column(c).to_pylist()
                                                  for c in ("bucket", "ghost", "id", "text"))):
                own = sketch(text)
                if last and last[0] == bucket:
                    _, last_key, last_text, last_own = last
                    edited = edited_text(last_text, text)
                    changed = sketch(edited)
                    out.append((last_key, len(last_text), edited, as_text(last_own),
                                as_text(changed), likeness(last_own, changed),
                                likeness(last_own, own), containment(last_own, changed),
                                containment(last_own, own)))
                last = None if ghost else (bucket, key, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 names=names)

    names = [id_column, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited",
             "near_next", "contained_edited", "contained_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    kind = docs.schema[id_column].dataType.simpleString()
    kinds[0] = {"bigint": pa.int64(), "int": pa.int32()}[kind]
    return in_ranges(docs, id_column, text_column).mapInArrow(
        run, f"`{id_column}` {kind}, n_chars bigint, edited string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double, "
             "contained_edited double, contained_next double")


def edited_digests(docs: DataFrame) -> DataFrame:
    """``edited_fingerprints`` with the edited text as its SHA-256."""
    found = edited_fingerprints(docs)
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        *found.columns[3:])


def _sketch_sql(text: str) -> str:
    lowered = ascii_lower_sql(text)
    words = (f"list_filter(regexp_split_to_array({lowered}, '[\\x20\\x09-\\x0D]+'), "
             "lambda w: w <> '')")
    return f"""(SELECT CASE WHEN len(k) > 0 THEN k ELSE list_sort(h)[1:1] END FROM (
      SELECT h, list_sort(list_filter(h, lambda x: x < '{limit(SCALE).hex()}')) AS k FROM (
        SELECT list_distinct(list_transform(s, lambda x: substr(md5(x), 1, 16))) AS h FROM (
          SELECT CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - {SHINGLE} + 2),
                                lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END AS s
          FROM (SELECT {words} AS w)))))"""


def ascii_lower_sql(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"translate({text}, '{upper}', '{upper.lower()}')"


def _share_sql(a: str, b: str, whole: str) -> str:
    return (f"CASE WHEN len({whole}) = 0 THEN 1 "
            f"ELSE len(list_intersect({a}, {b}))::DOUBLE / len({whole}) END")


def _near_sql(a: str, b: str) -> tuple[str, str]:
    """Likeness and containment of two lists of hashes."""
    return _share_sql(a, b, f"list_distinct(list_concat({a}, {b}))"), _share_sql(a, b, a)


SQL = f"""
WITH d AS (
  SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER o, first_value(t) OVER o) AS nxt
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substr(t, 1, n - n // 3) || substr(nxt, 1, n // 3) AS edited FROM d),
f AS (SELECT doc_id, n, edited, {_sketch_sql('t')} AS a, {_sketch_sql('edited')} AS b,
             {_sketch_sql('nxt')} AS c FROM e)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint,
  array_to_string(b, '') AS edited_fingerprint, {_near_sql('a', 'b')[0]} AS near_edited,
  {_near_sql('a', 'c')[0]} AS near_next, {_near_sql('a', 'b')[1]} AS contained_edited,
  {_near_sql('a', 'c')[1]} AS contained_next
FROM f
"""
