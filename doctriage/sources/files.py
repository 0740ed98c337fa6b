"""Labelled file trees, the media gate and labelled CSV files."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from doctriage.functions import fixed

LABELLED_TEXT = T.StructType([T.StructField("category", T.StringType(), True),
                              T.StructField("text", T.StringType(), True)])


def read_labelled_tree(spark: SparkSession, root: str, key: str | None = None) -> DataFrame:
    """Every file below ``root/<label>/``, at any depth: path, length, content and its label.

    The label is the folder right below the root, as it is named; with ``key``, folders are
    named ``key=<label>``. A file in the root itself has no label. ``content`` is read only
    when selected. Spark's reader leaves out files of no bytes.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))
    top = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    inside = F.split(F.substr("path", F.instr("path", top) + F.lit(len(top))), "/")
    folder = F.when(F.size(inside) > 1, inside[0])
    return files.withColumn("label", F.regexp_replace(folder, f"^{re.escape(key)}=", "")
                            if key else folder)


def write_labelled_tree(df: DataFrame, path: str, label: str = "label", text: str = "text") -> None:
    """Each row as a file of its own, of the text and a line end, below ``<label>=<its label>``.

    Tasks write to a local or mounted folder, which they must share, themselves: a
    file is one call there, where Hadoop's local file system takes many times as long. Any other store is written by Spark. A file is named by its task and its text, so
    that a task that runs again writes the same files.
    """
    rows = df.select(F.col(label).cast("string").alias(label), F.col(text).alias(text))
    spark = df.sparkSession
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    where = store.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(store).toUri()
    if where.getScheme() != "file":
        rows.write.option("maxRecordsPerFile", 1).partitionBy(label).text(path)
        return
    root = where.getPath()

    def below(name: str | None) -> str:
        """The folder of a label, named as Spark names the folders of a partitioned table."""
        escaped = re.sub("[\\x01-\\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]",
                         lambda c: f"%{ord(c[0]):02X}", name or "")
        return f"{root}/{label}={escaped or '__HIVE_DEFAULT_PARTITION__'}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, folders = TaskContext.get().partitionId(), Counter(), {}
        for batch in batches:
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in folders:
                    folders[name] = below(name)
                    os.makedirs(folders[name], exist_ok=True)
                content = ((line or "") + "\n").encode()
                file = f"{folders[name]}/part-{task:05d}-{hashlib.md5(content).hexdigest()}"
                seen[file] += 1
                with open(f"{file}-{seen[file]}.txt", "wb") as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    os.makedirs(root)
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def suffix(name: Column | str) -> Column:
    """What follows the last dot; a name without a dot is its own suffix."""
    return F.substring_index(F.col(name) if isinstance(name, str) else name, ".", -1)


def route(name: Column | str) -> Column:
    """``image``, ``pdf`` or ``rejected``; the suffix must match in exact case."""
    end = suffix(name)
    return (F.when(end.isin(fixed.IMAGE_SUFFIXES), "image")
            .when(end.isin(fixed.PDF_SUFFIXES), "pdf").otherwise("rejected"))


def route_media(df: DataFrame, name: str) -> DataFrame:
    """Add ``route``; rejected rows are invalid documents."""
    return df.withColumn("route", route(name))


def write_labelled_csv(df: DataFrame, path: str, label: str = "label", text: str = "text",
                       header: bool = False, rows_per_file: int = 100_000) -> None:
    """``[label, text]`` rows, quoted, without a header unless asked for.

    Multi-line CSV cannot be split by a reader, so files are kept to a bounded size.
    """
    (df.select(F.col(label).alias("category"), F.col(text).alias("text"))
     .write.mode("overwrite").option("header", header).option("quote", '"')
     .option("escape", '"').option("emptyValue", '""')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("maxRecordsPerFile", rows_per_file).csv(path))


def read_labelled_csv(spark: SparkSession, path: str, header: bool = True,
                      schema: T.StructType = LABELLED_TEXT) -> DataFrame:
    """Quoted, multi-line ``category,text`` rows. An empty text reads as null."""
    return (spark.read.schema(schema).option("header", header).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("lineSep", "\n")
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).csv(path))
