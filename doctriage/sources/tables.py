"""Parquet tables and ad-hoc rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from doctriage.session import spread

TEXT_ROWS = T.StructType([T.StructField("doc_id", T.LongType(), False),
                          T.StructField("text", T.StringType(), True)])


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table with only the named columns read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_spread(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """As ``read_table``, spread over the cores when the file has too few splits."""
    return spread(read_table(spark, folder, name, *columns), columns[0])


def texts_to_df(spark: SparkSession, texts: str | list[str]) -> DataFrame:
    """One text, or a list of texts, as a table to score."""
    texts = [texts] if isinstance(texts, str) else texts
    return spark.createDataFrame(list(enumerate(texts)), TEXT_ROWS)
