"""What the operators of this subpackage share."""

from __future__ import annotations

import string
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import doctriage

# Rows below which a small side is broadcast; above, the join shuffles. The rows counted
# are narrow (a few long columns), so that this bounds the bytes as well.
BROADCAST_ROWS = 200_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_A_BATCH = 1000        # whole texts are long rows; a batch of them is held twice


def read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    """A table of the data folder, with the named columns only."""
    return spark.read.parquet(f"{folder}/{table}.parquet").select(*columns)


def ascii_lower(text: Column | str) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small; else as it is.

    ``df`` should be a written table, since it is counted here.
    """
    return F.broadcast(df) if df.count() <= rows else df


_SHIPPED: set[str] = set()


def shipped(run):
    """``run(spark, ...)`` with this package sent to the executors first, once a session.

    Functions that run there are then found wherever the driver was started. Batches of
    rows between Spark and Python are made smaller, if they have Spark's default size.
    """
    @wraps(run)
    def with_package(spark: SparkSession, *args):
        if int(spark.conf.get(ARROW_ROWS)) == 10_000:
            spark.conf.set(ARROW_ROWS, TEXTS_A_BATCH)
        context = spark.sparkContext
        if context.applicationId not in _SHIPPED:
            root = Path(doctriage.__file__).parent
            archive = Path(tempfile.mkdtemp(prefix="doctriage-package-")) / "doctriage.zip"
            with zipfile.ZipFile(archive, "w") as out:
                for file in sorted(root.rglob("*.py")):
                    out.write(file, file.relative_to(root.parent))
            context.addPyFile(str(archive))
            _SHIPPED.add(context.applicationId)
        return run(spark, *args)
    return with_package
