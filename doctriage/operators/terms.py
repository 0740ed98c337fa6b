"""Term statistics and TF-IDF weights in long form ``(document, term, value)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from doctriage.functions.text import filterset_tokens, look_up, two_level_map, word_tokens
from doctriage.operators.splits import cut_value
from doctriage.session import keyed_by_document, written

# A term table is broadcast only up to this measured size. Above it, as many of the most
# frequent terms as surely fit are broadcast and the rest is shuffled.
BROADCAST_BYTES = 256 << 20
LONG_TERM = 256                     # bytes; longer terms are never in the broadcast part


def row_bytes(terms: DataFrame) -> int:
    """Bytes of a term row besides the term: 8 per column and the hash entry."""
    return 64 + 8 * len(terms.columns)


def term_counts(docs: DataFrame, key: str, text: str | Column, *carry: str) -> DataFrame:
    """``(key, *carry, term, tf)`` with one exchange: documents are hashed by key, and
    counting by (key, term) stays inside a document's partition."""
    return count_words(words_by_document(docs, key, text, *carry), key, *carry)


def words_by_document(docs: DataFrame, key: str, text: str | Column, *carry: str) -> DataFrame:
    """``(key, *carry, words)``, hashed by key. Texts travel, not their words: an array takes
    twice a text's bytes, also when compressed."""
    text = F.col(text) if isinstance(text, str) else text
    texts = keyed_by_document(docs, key, F.col(key), *[F.col(c) for c in carry],
                              text.alias("__text"))
    return texts.select(key, *carry, word_tokens("__text").alias("words"))


def each_term(docs: DataFrame, *columns: str | Column, words: str | Column) -> DataFrame:
    """One row per word of ``words``, in a column ``term``.

    The outer form with a filter behind it is deliberate: a plain ``explode`` makes the
    optimizer test the array for emptiness below the projection, which would clean and
    tokenise every text three times.
    """
    return (docs.select(*columns, F.explode_outer(words).alias("term"))
            .filter(F.col("term").isNotNull()))


def count_words(words: DataFrame, key: str, *carry: str) -> DataFrame:
    return (each_term(words, key, *carry, words="words")
            .groupBy(key, *carry, "term").agg(F.count("*").alias("tf")))


def document_frequency(docs: DataFrame, text: str | Column) -> DataFrame:
    """``(term, df)``. Distinct terms per document come from the row itself, so the
    only shuffle is of partial counts by term."""
    return (each_term(docs, words=F.array_distinct(word_tokens(text)))
            .groupBy("term").agg(F.count("*").alias("df")))


def join_terms(rows: DataFrame, terms: DataFrame, n_terms: int, term_bytes: int,
               how: str = "inner", frequency: str = "df", budget: int | None = None,
               wide: int = 0) -> DataFrame:
    """Join term rows with a table of one row per term, safe for hot terms.

    ``n_terms`` and ``term_bytes`` are the counted rows of ``terms`` and the summed
    length of its terms, and of its columns of varying width, of which a row has at most
    ``wide`` bytes. If the table fits the budget it is broadcast and the rows stay
    where they are. Otherwise the most frequent terms that fit are broadcast; they take
    the hot terms and most rows. Only rows of rare terms are shuffled, so no single term
    fills a partition; a frequent term too long to broadcast is left to the skew join.
    """
    budget = BROADCAST_BYTES if budget is None else budget
    if term_bytes + n_terms * row_bytes(terms) <= budget:
        return rows.join(F.broadcast(terms), "term", how)
    limit = max(1, budget // (LONG_TERM + row_bytes(terms) + wide))
    short = F.octet_length("term") <= LONG_TERM
    frequent = short
    if n_terms > limit:
        cut, _ = cut_value(terms, F.col(frequency), n_terms - limit)
        frequent = short & (F.col(frequency) > cut)      # at most ``limit`` rows
    head, tail = terms.filter(frequent), terms.filter(~frequent)
    rows = written(rows, "term-rows")
    common = rows.join(F.broadcast(head), "term")
    rest = rows.join(F.broadcast(head.select("term")), "term", "left_anti")
    if how == "left":
        # Rows without a term (empty documents) share a null key; keep them in place.
        added = [F.lit(None).cast(f.dataType).alias(f.name) for f in terms.schema
                 if f.name != "term"]
        empty = rest.filter(F.col("term").isNull()).select("*", *added)
        rest = rest.filter(F.col("term").isNotNull()).join(tail, "term", "left")
        return common.unionByName(rest).unionByName(empty)
    return common.unionByName(rest.join(tail, "term", how))


@dataclass(frozen=True)
class Idf:
    """A fitted inverse-document-frequency table, held as a written table."""
    table: DataFrame                    # term, df, idf
    n_docs: int
    n_terms: int
    term_bytes: int


def term_sizes(table: DataFrame) -> tuple[int, int]:
    """Rows of a term table and the summed length of its terms."""
    row = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return row[0], row[1]


def smoothed_idf(n_docs: int) -> Column:
    return F.log(F.lit(float(1 + n_docs)) / (F.col("df") + 1)) + 1


def fit_idf(docs: DataFrame, key: str, text: str | Column, n_docs: int | None = None) -> Idf:
    """``idf = ln((1 + n) / (1 + df)) + 1`` over the given documents."""
    n_docs = docs.select(key).count() if n_docs is None else n_docs
    table = document_frequency(docs, text).withColumn("idf", smoothed_idf(n_docs))
    table = written(table, "idf")
    return Idf(table, n_docs, *term_sizes(table))


def tfidf_weights(counts: DataFrame, key: str, idf: Idf,
                  budget: int | None = None, complete: bool = False) -> DataFrame:
    """``(key, ..., term, tf, df, idf, weight)``, each document of unit length; unseen
    terms drop.

    The window groups by document only, and a document is one input row's terms. A ``complete``
    table has all terms of ``counts``: what is not among those of two documents or more, which
    are most rows and few terms, is known to be of one, and needs no row of the table.
    """
    if complete:
        several = idf.table.filter(F.col("df") > 1)
        joined = (join_terms(counts, several, *term_sizes(several), "left", budget=budget)
                  .withColumn("df", F.coalesce("df", F.lit(1).cast("bigint")))
                  .withColumn("idf", F.coalesce("idf", smoothed_idf(idf.n_docs))))
    else:
        joined = join_terms(counts, idf.table, idf.n_terms, idf.term_bytes, budget=budget)
    raw = joined.withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.withColumn("weight", F.col("raw") / norm).drop("raw")


def top_terms(docs: DataFrame, text: str | Column, max_words: int = 1000) -> DataFrame:
    """``(term, n, index)``: the most used terms. Index 0 is reserved, so one fewer."""
    counts = (each_term(docs, words=filterset_tokens(text))
              .groupBy("term").agg(F.count("*").alias("n")))
    top = counts.orderBy(F.desc("n"), "term").limit(max_words - 1)
    order = Window.orderBy(F.desc("n"), "term")          # over max_words - 1 rows at most
    return top.withColumn("index", F.row_number().over(order).cast("long"))


def bag_indices(text: str | Column, top: DataFrame) -> Column:
    """The sorted indices of the top terms that a text holds; none for a null text.

    ``top`` has at most ``max_words`` rows, which become a literal map, so that a text is looked
    up where it is: no row per word, no join, no shuffle.
    """
    entries = {r["term"]: r["index"] for r in top.select("term", "index").collect()}
    none = F.array().cast("array<bigint>")
    if not entries:
        return none
    table = two_level_map(entries)
    found = F.transform(F.array_distinct(filterset_tokens(text)), lambda term: look_up(table, term))
    return F.coalesce(F.array_sort(F.filter(found, lambda i: i.isNotNull())), none)


def binary_bag(docs: DataFrame, key: str, text: str | Column, top: DataFrame) -> DataFrame:
    """``(key, indices)`` of each row: sorted indices of the top terms it holds."""
    return docs.select(key, bag_indices(text, top).alias("indices"))


def frequent_terms(docs: DataFrame, key: str, text: str | Column, size: int | None = None,
                   min_df: int = 1) -> DataFrame:
    """``(term, n, df)`` of all terms, or of the ``size`` most used ones (ties by term)."""
    terms = (term_counts(docs, key, text).groupBy("term")
             .agg(F.sum("tf").alias("n"), F.count("*").alias("df")))
    terms = written(terms.filter(F.col("df") >= min_df), "vocabulary")
    return terms if size is None else terms.orderBy(F.desc("n"), "term").limit(size)


def usage_cut(terms: DataFrame, size: int | None) -> int:
    """The use count above which at most ``size`` terms lie; 0 when all fit or size is None.

    Terms tied at the cut are left out together, so the choice needs no order.
    """
    excess = terms.count() - size if size is not None else 0
    return cut_value(terms, F.col("n"), excess)[0] if excess > 0 else 0
