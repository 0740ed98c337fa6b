"""Spelling variant grouping by PartEnum signatures.

A word's letters are a binary vector over (letter, how many-eth of its kind). Two words one edit
apart are at Hamming distance two at most. The dimensions are dealt to ``PARTS`` partitions;
two differing ones spoil two partitions at most, so that the words agree on the ``PARTS - 2``
others: one signature is enumerated for each choice of those, and an equality join on
signatures misses no pair. Every pair that meets is then verified.

Signatures of short words over few letters are crowded, so a signature also holds half of
the word: of two words one edit apart, the shorter of ``m`` letters, either the first ``m // 2``
letters agree or the last ``m - m // 2`` do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from doctriage.llm.common import ascii_lower
from doctriage.session import written

LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 6
MIN_USES = 5
RATIO = 5                   # uses of a form against those of its variant
SLIP = 199                  # one run of letters in so many loses a letter
PARTS = 4
PART_BITS = 16
CHOICES = list(combinations(range(PARTS), PARTS - 2))


def misspelt_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   slip: int = SLIP, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word``: one row per run of letters, some of them made one letter short by a hash.

    Only A-Z are lower-cased. A null text has no runs; a null id counts as an empty string.
    Runs that end up shorter than ``min_length`` are left out.
    """
    runs = (docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
                        F.explode_outer(F.regexp_extract_all(
                            ascii_lower(text_column), F.lit(f"({LETTERS})"))).alias("run"))
            .filter(F.length("run") >= min_length))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at),
                     F.substring("run", at + 2, F.length("run")))
    return (runs.select(F.when(h % slip == 0, short).otherwise(F.col("run")).alias("word"))
            .filter(F.length("word") >= min_length))


def partition_hashes(word: str) -> int:
    """A hash of ``PART_BITS`` bits for each partition's share of the word's letters, packed."""
    shares: list[list[str]] = [[] for _ in range(PARTS)]
    for letter, many in sorted(Counter(word).items()):
        for nth in range(many):
            element = f"{letter}{nth}"
            shares[xxhash.xxh32_intdigest(element) % PARTS].append(element)
    packed = 0
    for share in shares:
        value = xxhash.xxh64_intdigest(",".join(share)) & ((1 << PART_BITS) - 1)
        packed = packed << PART_BITS | value
    return packed


def part_mask(part: int) -> int:
    return ((1 << PART_BITS) - 1) << (PART_BITS * (PARTS - 1 - part))


def signed(value: int) -> int:
    """A 64-bit pattern as a signed number."""
    return value - (1 << 64) if value >> 63 else value


def with_partitions(words: DataFrame) -> DataFrame:
    """``words`` and ``parts``, their packed partition hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [partition_hashes(w) for w in batch.column("word").to_pylist()]
            yield batch.append_column("parts", pa.array(np.array(packed, np.uint64).view(np.int64)))

    return words.mapInArrow(run, "word string, n bigint, parts bigint")


def masks(parts: tuple[int, ...]) -> Column:
    return F.lit(signed(sum(part_mask(p) for p in parts))).cast("bigint")


def first_choice(difference: Column, choice: Column) -> Column:
    """Whether ``choice`` is the first one whose partitions all agree, so that a pair that meets
    under several signatures is seen once."""
    first = F.coalesce(*[F.when(difference.bitwiseAND(masks(c)) == 0, i)
                         for i, c in enumerate(CHOICES)])
    return first == choice


def signatures(words: DataFrame) -> DataFrame:
    """``key, choice, tail, longer, m, word, n, parts``: the enumerated signatures of each word,
    as the shorter or equal (``m`` its length) and as the longer word of a pair."""
    m = F.col("m")
    half = F.floor(m / 2).cast("int")
    by_role = words.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    by_role = by_role.withColumn("m", F.length("word") - F.col("longer").cast("int"))
    each = by_role.select("*", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("parts").bitwiseAND(masks(c)).alias("kept"))
        for i, c in enumerate(CHOICES)])).alias("s"))
    each = each.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("tail"))
    piece = F.when(F.col("tail"), F.right("word", m - half)).otherwise(F.left("word", half))
    return each.select(F.xxhash64("s.choice", "s.kept", m, "tail", piece).alias("key"),
                       F.col("s.choice").alias("choice"), "tail", "longer", "m", "word", "n", "parts")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: all pairs of distinct words one edit apart, each once.

    ``words`` holds ``word, n`` with distinct words of two letters or more.
    """
    signed_words = written(signatures(with_partitions(words)), "spelling-signatures")
    a, b = signed_words.filter(~F.col("longer")).alias("a"), signed_words.alias("b")
    m, tail = F.col("a.m"), F.col("a.tail")
    half = F.floor(m / 2).cast("int")
    same_head = F.left("a.word", half) == F.left("b.word", half)
    meets = ((F.col("a.key") == F.col("b.key"))
             & (F.col("b.longer") | (F.col("a.word") < F.col("b.word")))
             & first_choice(F.col("a.parts").bitwiseXOR(F.col("b.parts")), F.col("a.choice"))
             & (tail != same_head)
             & (F.col("a.choice") == F.col("b.choice")) & (m == F.col("b.m"))
             & (tail == F.col("b.tail"))
             & (F.levenshtein("a.word", "b.word", 1) == 1))
    return a.join(b, meets).select(F.col("a.word").alias("word"), F.col("a.n").alias("n"),
                                   F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms (word, form)``: forms followed to the last, by doubling.

    A form is used several times as often as its word, so chains end, and are short.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(reached.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "spelling-roots")
        reached = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return reached


def variant_groups(words: DataFrame, min_uses: int = MIN_USES, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each distinct word used often enough.

    ``words`` has one row per use, in a column ``word``; nulls are left out, other columns are not
    read. Near words are one inserted, deleted or replaced character apart. The form is the near
    word used most (ties: the first in order), if that is ``ratio`` times as often; the root is
    where forms lead. Uses are counted before the shuffle, so that a frequent word is a few rows;
    candidate pairs are those of a signature, and only verified ones leave the join. An
    empty table gives an empty result.
    """
    used = written(words.filter(F.col("word").isNotNull()).groupBy("word")
                   .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_uses), "spelling-words")
    pairs = near_pairs(used)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("word"), F.col("other"), F.col("other_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("other"),
                 F.col("n").alias("other_n")))).alias("s")).select("s.*")
    near = sides.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("top"))
    most = -F.col("top.less")
    takes = most >= F.col("n") * ratio
    judged = written(used.join(near, "word", "left").select(
        "word", F.when(takes, F.col("top.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(takes, most).alias("form_n")), "spelling-forms")
    lead = roots(judged.filter(F.col("form").isNotNull()))
    return judged.join(lead, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = f"""
WITH RECURSIVE
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(
    list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1
    THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT id, run, count(*) AS uses FROM (
    SELECT doc_id::VARCHAR AS id, unnest(regexp_extract_all(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LETTERS}')) AS run
    FROM documents) WHERE length(run) >= {MIN_LENGTH} GROUP BY id, run),
hexed AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, uses, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(range(1, length(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]))) AS h FROM hexed, crc_table),
slipped AS (SELECT uses, CASE WHEN h % {SLIP} = 0
    THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
    ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(uses)::BIGINT AS n FROM slipped WHERE length(word) >= {MIN_LENGTH}
    GROUP BY word HAVING sum(uses) >= {MIN_USES}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b
      ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, w.word, w.n FROM cut a JOIN words w ON a.rest = w.word
    UNION SELECT w.word, a.word, a.n FROM cut a JOIN words w ON a.rest = w.word),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS top_n,
    first(other ORDER BY other_n DESC, other) AS top FROM pairs GROUP BY word),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN top_n >= {RATIO} * w.n THEN top END AS form,
    CASE WHEN top_n >= {RATIO} * w.n THEN top_n END AS form_n
    FROM words w LEFT JOIN near USING (word)),
led AS (SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS onward FROM judged
    UNION ALL SELECT l.word, j.form, true FROM led l JOIN judged j ON l.root = j.word
    WHERE l.onward AND j.form IS NOT NULL),
ends AS (SELECT word, root FROM led l WHERE NOT EXISTS (
    SELECT 1 FROM judged j WHERE j.word = l.root AND j.form IS NOT NULL))
SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)
"""
