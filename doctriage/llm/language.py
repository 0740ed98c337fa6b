"""Language identification: averaged hashed subword embeddings under a linear softmax.

The model is fitted by stochastic gradient descent in numpy on a bounded sample of
labelled rows; every row of the table is then scored from its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

BUCKETS = 1 << 13
DIMENSIONS = 16
EPOCHS = 12
LEAST_STEPS = 600           # a small sample is gone over more often
PER_LANGUAGE = 300          # labelled rows for each language, at most
SAMPLE_ROWS = 20_000        # and for all languages together, at most
CHUNK = 1 << 20             # characters hashed at a time
UNKNOWN = "und"


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket is hit by the text's 1-, 2-, 3- and 4-grams of characters."""
    counts = np.zeros(BUCKETS, np.float32)
    lowered = f" {text.lower()} "
    for at in range(0, len(lowered), CHUNK):
        codes = np.frombuffer(lowered[at:at + CHUNK + 3].encode("utf-32-le", "surrogatepass"),
                              "<u4")
        new = min(CHUNK, len(lowered) - at)         # grams that start in this chunk
        gram = np.zeros(len(codes), np.uint32)
        for n in range(1, 5):
            size = len(codes) - n + 1
            if size <= 0:
                break
            gram = gram[:size] * np.uint32(0x01000193) + codes[n - 1:n - 1 + size] + np.uint32(n)
            mixed = gram[:new] * np.uint32(0x9E3779B1)
            counts += np.bincount(mixed >> np.uint32(32 - 13), minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    vectors: np.ndarray         # buckets x dimensions
    weights: np.ndarray         # dimensions x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0      # a calibrated probability below it is a rejection

    def logits(self, averages: np.ndarray) -> np.ndarray:
        return averages @ self.vectors @ self.weights + self.bias

    def probabilities(self, averages: np.ndarray) -> np.ndarray:
        return softmax(self.logits(averages) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(averages: np.ndarray, targets: np.ndarray, languages: list[str], seed: int = 7,
          epochs: int = EPOCHS) -> Model:
    """Plain minibatch gradient descent, then calibration on the fifth that is held back."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(targets))
    held = order[:len(order) // 5] if len(order) >= 20 else order
    fitted = order[len(order) // 5:] if len(order) >= 20 else order
    vectors = rng.normal(0, 0.1, (averages.shape[1], DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    epochs = max(epochs, LEAST_STEPS * 32 // len(fitted))
    steps, step = epochs * -(-len(fitted) // 32), 0
    for _ in range(epochs):
        fitted = rng.permutation(fitted)
        for at in range(0, len(fitted), 32):
            rows = fitted[at:at + 32]
            x, rate = averages[rows], 8.0 * (1 - step / steps)
            hidden = x @ vectors
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(rows)), targets[rows]] -= 1
            error /= len(rows)
            back = error @ weights.T
            weights -= rate * hidden.T @ error
            bias -= rate * 0.1 * error.sum(axis=0)
            vectors -= rate * 8 * (x.T @ back)
            step += 1
    return calibrated(Model(languages, vectors, weights, bias), averages[held], targets[held])


def calibrated(model: Model, averages: np.ndarray, targets: np.ndarray) -> Model:
    """Temperature of least loss, and the threshold that one row in a thousand stays below,
    or one half if that is less."""
    logits = model.logits(averages)
    rows = np.arange(len(targets))
    temperature = min(np.geomspace(0.1, 10, 41), key=lambda t: -np.log(
        softmax(logits / t)[rows, targets] + 1e-12).mean())
    top = softmax(logits / temperature).max(axis=1)
    return Model(model.languages, model.vectors, model.weights, model.bias, float(temperature),
                 float(min(0.5, np.quantile(top, 0.001))))


def training_rows(docs: DataFrame, id_column: str, text_column: str, label_column: str
                  ) -> DataFrame:
    """``label, buckets, counts`` of at most ``PER_LANGUAGE`` rows for each language.

    Only rows with a label whose crc32 of the id, as text, leaves another remainder than 1
    modulo 3. Which ones is a matter of a hash of the id; the texts are turned into counts
    on the executors.
    """
    labelled = docs.filter(F.col(label_column).isNotNull()
                           & (F.crc32(F.col(id_column).cast("string")) % 3 != 1))
    ranks = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = (labelled.select(F.col(label_column).alias("label"), F.col(id_column).alias("id"))
              .withColumn("n", F.row_number().over(ranks)).filter(F.col("n") <= PER_LANGUAGE)
              .orderBy("n", "label").limit(SAMPLE_ROWS).select("id").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    counts = subword_counts(text)
                    hit = np.flatnonzero(counts)
                    out.append((label, hit.astype("<u2").tobytes(),
                                counts[hit].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_pydict(
                dict(zip(("label", "buckets", "counts"), zip(*out) if out else ([], [], []))),
                schema=pa.schema([("label", pa.string()), ("buckets", pa.binary()),
                                  ("counts", pa.binary())]))

    return (labelled.join(F.broadcast(chosen), labelled[id_column] == chosen["id"], "left_semi")
            .select(F.col(label_column).alias("label"), F.col(text_column).alias("text"))
            .mapInArrow(run, "label string, buckets binary, counts binary"))


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "lang") -> Model | None:
    """A model of the labels in ``docs``, or None when no labelled text has a letter.

    What reaches the driver is bounded: sparse counts of ``SAMPLE_ROWS`` rows.
    """
    rows = training_rows(docs, id_column, text_column, label_column).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["label"], bytes(r["buckets"]), bytes(r["counts"])))
    languages = sorted({r["label"] for r in rows})
    averages = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        averages[i, np.frombuffer(r["buckets"], "<u2")] = np.frombuffer(r["counts"], "<f4")
    averages /= averages.sum(axis=1, keepdims=True)
    return train(averages, np.array([languages.index(r["label"]) for r in rows]), languages)


def scores(model: Model | None, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """``language, score, rejected`` of each text, in blocks of 256 texts."""
    out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
    known = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    for at in range(0, len(known), 256):
        part = known[at:at + 256]
        counts = np.stack([subword_counts(texts[i]) for i in part])
        found = model.probabilities(counts / counts.sum(axis=1, keepdims=True))
        for i, p in zip(part, found):
            best = int(p.argmax())
            out[i] = (model.languages[best], float(p[best]), bool(p[best] < model.threshold))
    return out


def score_batches(model: Model | None, text_column: str):
    """For ``mapInArrow``: each batch with ``lang_pred, score, rejected`` after its columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(model, batch.column(text_column).to_pylist())
            names, values, flags = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(c for n, c in zip(batch.schema.names, batch.columns) if n != text_column),
                 pa.array(names, pa.string()), pa.array(values, pa.float64()),
                 pa.array(flags, pa.bool_())],
                names=[*(n for n in batch.schema.names if n != text_column),
                       "lang_pred", "score", "rejected"])
    return run


def identify(docs: DataFrame, model: Model | None, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """One row per document: ``id, held_out, lang_pred, score, rejected``.

    A null text, or one without a letter, is ``und`` with score 0 and rejected, as is all
    text without a model. Others get the likeliest language and its calibrated
    probability, and are rejected when that is below the model's threshold. Repeated rows
    each get a row; a null id is not held out. Other columns are not read.
    """
    held = F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))
    kind = dict(docs.dtypes)[id_column]
    return (docs.select(F.col(id_column).alias("id"), held.alias("held_out"),
                        F.col(text_column).alias("text"))
            .mapInArrow(score_batches(model, "text"),
                        f"id {kind}, held_out boolean, lang_pred string, score double, "
                        "rejected boolean").withColumnRenamed("id", id_column))


def accepted(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, all columns as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(model, batch.column(text_column).to_pylist())
            yield batch.filter(pa.array([not rejected for *_, rejected in found], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def crc_remainder(doc_id: int) -> int:
    """What decides on held-out rows, in plain Python."""
    return zlib.crc32(str(doc_id).encode()) % 3
