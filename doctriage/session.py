"""Session helpers: builder, shared scratch tables, scan parallelism."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_SETTING = "spark.checkpoint.dir"
TASKS_A_SPLIT = 8           # tasks that count the words of one split, of 128 MB by default


def build_session(app_name: str = "doctriage", master: str | None = None,
                  **settings) -> SparkSession:
    """A session with adaptive execution on. Cluster sizing stays with spark-submit."""
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC"))
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables, as named by the cluster.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors would not see it.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="doctriage-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/doctriage/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, schema: StructType | None = None,
            session: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, as ``schema`` if one is given,
    and in ``session`` if one is given.

    This cuts the lineage: a lost executor costs a re-read, not a re-fit.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return (session or df.sparkSession).read.schema(schema or df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop what belongs to plans that are no longer referred to."""
    gc.collect()
    spark._jvm.System.gc()


class Rounds:
    """Written tables of successive rounds, of which only the last is kept.

    A round's table may be computed from the one before, which is removed once it is written.
    Spark drops the shuffle files of earlier rounds when the driver has collected their plans,
    which is asked for here: a busy cluster would keep them all until the loop's end.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.last = spark, name, None

    def write(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        if self.last:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.last)
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
            release(self.spark)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Repartition a scan only when it has fewer partitions than the cluster has cores.

    A table of many files already splits well and is returned unchanged, so no
    shuffle of raw text is paid at scale; a single-row-group file is spread out.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)


def keyed_by_document(df: DataFrame, key: str, *columns: Column) -> DataFrame:
    """Project ``columns`` and hash-partition by ``key``, with one exchange.

    Everything per document afterwards (term counts, norms, scores) is then local
    to its partition. With many scan partitions the projection runs first, so the
    cleaned columns travel instead of the raw ones, and each split is dealt to several tasks:
    counting the words of a split takes many times its bytes. A scan with too few partitions
    is spread first, so that the projection runs in parallel.
    """
    wanted, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= wanted:
        return df.select(*columns).repartition(splits * TASKS_A_SPLIT, key)
    return df.repartition(wanted, key).select(*columns)
