"""File-drop streams: the batch projections over files as they arrive.

Scoring keeps no state, so output is append-only and needs no watermark. Only telling files
that are dropped twice keeps state: one digest a file.

A model of tables is joined with the words of the documents, so a stream is scored by it batch by
batch: the projection is then the ``step`` of a drain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from doctriage.functions.text import clean_text
from doctriage.operators.learners import TableModel, predict
from doctriage.operators.rules import apply_flow, outcome
from doctriage.sources.files import route_media
from doctriage.sources.ocr import RESPONSE, assemble_lines, first_page_blocks

FILES_PER_BATCH = 1_000
BINARY_FILE = T.StructType([T.StructField("path", T.StringType()),
                            T.StructField("modificationTime", T.TimestampType()),
                            T.StructField("length", T.LongType()),
                            T.StructField("content", T.BinaryType())])


def open_drop(spark: SparkSession, folder: str, schema: T.StructType, form: str = "parquet",
              name_pattern: str | None = None, files_per_batch: int = FILES_PER_BATCH,
              tasks: int | None = None) -> DataFrame:
    """New files of a folder as a stream.

    ``tasks`` spreads each batch by round robin; it is meant for drops of few large
    files that do not split, and costs a shuffle of the texts otherwise.
    """
    reader = (spark.readStream.format(form).schema(schema)
              .option("maxFilesPerTrigger", files_per_batch))
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    drop = reader.load(folder)
    return drop.repartition(tasks) if tasks else drop


def open_ocr_drop(spark: SparkSession, folder: str) -> DataFrame:
    """Dropped OCR responses (JSON, one document per line) as ``(doc_id, text)``."""
    return open_drop(spark, folder, RESPONSE, "json").select(
        "doc_id", assemble_lines("Blocks").alias("text"))


def predict_clean(model: PipelineModel | TableModel, docs: DataFrame, *keep: str) -> DataFrame:
    """Predictions from the column ``_clean``, which is kept: null where the text is missing.
    The learner sees an empty text there; the outcome is still an error."""
    if isinstance(model, TableModel):
        return predict(model, docs, *keep, "_clean", text="_clean")
    ready = docs.select(*keep, "_clean", F.coalesce("_clean", F.lit("")).alias("text"))
    return predict(model, ready, *keep, "_clean")


def score(docs: DataFrame, model: PipelineModel | TableModel, flow: str, mode: str = "compat",
          key: str = "doc_id", text: str = "text") -> DataFrame:
    """Clean, predict, decide: one plan for batch and stream alike."""
    cleaned = docs.select(key, clean_text(text).alias("_clean"))
    scored = predict_clean(model, cleaned, key).withColumnRenamed("prediction", "model_label")
    decided = apply_flow(scored, flow, mode, "_clean")
    return decided.select(key, "model_label", "result.*")


def open_file_drop(spark: SparkSession, folder: str,
                   files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """New files below a folder, of any kind, as ``(file_name, content)``."""
    found = (spark.readStream.format("binaryFile").schema(BINARY_FILE)
             .option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
             .load(folder))
    return found.select(F.substring_index("path", "/", -1).alias("file_name"), "content")


def once(files: DataFrame) -> DataFrame:
    """``files`` without those that were dropped before, under the same name and content.

    On a stream the digests seen are its state, which restarts keep.
    """
    return (files.withColumn("digest", F.sha2("content", 256))
            .dropDuplicates(["file_name", "digest"]).drop("digest"))


def classify_files(files: DataFrame, model: PipelineModel | TableModel, flow: str,
                   mode: str = "compat") -> DataFrame:
    """From files to final labels: gate, lines of the first page, cleaning, model, flow, outcome.

    ``files`` has ``file_name`` and ``content``, the OCR response of the file as JSON; other columns
    are kept. A file of another kind is an invalid document whatever it holds; content that
    is no response is an error. One plan of projections, for batch and stream alike.
    """
    kept = [c for c in files.columns if c != "content"]
    rejected = F.col("route") == "rejected"
    lines = assemble_lines(first_page_blocks(F.col("content")))
    texts = route_media(files, "file_name").withColumn(
        "_clean", clean_text(F.when(~rejected, lines)))
    scored = (predict_clean(model, texts, *kept, "route")
              .withColumn("model_label", F.when(F.col("_clean").isNotNull(), F.col("prediction"))))
    decided = apply_flow(scored, flow, mode, "_clean")
    final = outcome(F.col("result.class"), F.col("result.outcome") == "error", rejected)
    return decided.select(*kept, "route", "model_label", final.alias("final")).select(
        *kept, "route", "model_label", "final.*")


Step = Callable[[DataFrame], DataFrame]


def drain_batches(stream: DataFrame, output: str, checkpoint: str, step: Step | None,
                  *parts: str) -> None:
    """Each batch, after ``step``, into its own folder, split by ``parts``.

    A batch that is repeated after a failure overwrites its own folder, so that each result
    is there once.
    """
    def write(batch: DataFrame, number: int) -> None:
        results = step(batch) if step else batch
        results.write.mode("overwrite").partitionBy(*parts).parquet(f"{output}/batch={number}")

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def drain_by_outcome(results: DataFrame, output: str, checkpoint: str, step: Step | None = None
                     ) -> None:
    """As ``drain``, into one folder for each batch and outcome."""
    drain_batches(results, output, checkpoint, step, "outcome")


def drain(stream: DataFrame, output: str, checkpoint: str, step: Step | None = None) -> None:
    """Process what has arrived and stop; a restart goes on where it left off.

    With a ``step``, a function of a batch's rows, there is a folder for each batch.
    """
    if step:
        return drain_batches(stream, output, checkpoint, step)
    (stream.writeStream.format("parquet").outputMode("append")
     .option("path", output).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
