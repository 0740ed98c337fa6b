"""Row-level and counting operators on a labelled corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from doctriage.functions.text import space_tokens, word_count


def labelled_rows(df: DataFrame, label: str = "category") -> DataFrame:
    """Rows whose label is known."""
    return df.filter(F.col(label).isNotNull())


def preview(df: DataFrame, n: int = 10, order: str = "row_id") -> DataFrame:
    """The first ``n`` rows in key order."""
    return df.orderBy(order).limit(n)


def rows_at(df: DataFrame, key: str, wanted: int | DataFrame,
            columns: list[str] | None = None) -> DataFrame:
    """Rows with the given key, or with any key of a key table; none when absent."""
    if isinstance(wanted, DataFrame):
        found = df.join(wanted.select(key), key, "left_semi")
    else:
        found = df.filter(F.col(key) == wanted)
    return found.select(*(columns or df.columns))


def label_set(df: DataFrame, label: str = "category") -> DataFrame:
    return df.select(label).distinct()


def first_result(annotation: str) -> Column:
    """The first result of an annotation column; null when there is none."""
    return F.get(F.col(f"{annotation}.result"), F.lit(0))


def word_total(df: DataFrame, *texts: Column, names: list[str]) -> DataFrame:
    """Word totals of several text columns, in one pass."""
    return df.agg(*[F.sum(word_count(t)).alias(n) for t, n in zip(texts, names)])


def label_distribution(df: DataFrame, label: str = "category") -> DataFrame:
    """Rows per known label, most frequent first."""
    return (labelled_rows(df, label).groupBy(label).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), label))


def tag_rows(df: DataFrame, prefix: str | Column, key: str, text: str | Column) -> DataFrame:
    """``(tag, words)`` rows. The key is the tag's number: no global numbering needed."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return df.select(F.concat(prefix, F.lit("_"), F.col(key).cast("string")).alias("tag"),
                     space_tokens(text).alias("words"))


def concat_parts(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)
