"""Vector features as ML stages: counts, smoothed TF-IDF, binary bag, embeddings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.feature import (CountVectorizer, CountVectorizerModel, ElementwiseProduct,
                                Normalizer, OneHotEncoder, RegexTokenizer, SQLTransformer,
                                StringIndexer, Word2Vec)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from doctriage.functions import fixed
from doctriage.functions.text import space_tokens
from doctriage.operators.terms import (Idf, each_term, frequent_terms, smoothed_idf, term_sizes,
                                       top_terms, usage_cut)
from doctriage.session import written

MEANS_A_PASS = 20_000               # class means that tasks hold at once
ROWS_A_PRODUCT = 256                # rows compared with them at once


def word_tokenizer(text: str = "text", output: str = "words") -> Transformer:
    return RegexTokenizer(inputCol=text, outputCol=output, gaps=False, toLowercase=True,
                          pattern=fixed.WORD_PATTERN)


def space_tokenizer(text: str = "text", output: str = "words") -> Transformer:
    return RegexTokenizer(inputCol=text, outputCol=output, gaps=True, toLowercase=False,
                          pattern=r"\s+")


@dataclass(frozen=True)
class TermTable:
    """What ``tfidf_stages`` fit, held as a table: the words of ``text`` and their weights;
    ``complete`` if these are all words."""
    text: str
    idf: Idf
    complete: bool


def tfidf_stages(docs: DataFrame, key: str, text: str = "text", output: str = "features",
                 vocabulary_size: int | None = None, min_df: int = 1, table: bool = False) -> list:
    """Fitted stages: words, counts, times ``ln((1+n)/(1+df)) + 1``, unit length.

    One grouped count gives vocabulary and document frequencies together, where fitting
    a count and an IDF stage would pass over the corpus twice. The vocabulary holds all
    terms, on the driver too, unless ``vocabulary_size`` bounds it. As a ``table`` it is one
    stage, a ``TermTable``, none of whose terms pass through the driver.
    """
    n_docs = docs.count()
    chosen = frequent_terms(docs, key, text, vocabulary_size, min_df)
    if table:
        numbers = written(chosen.select("term", "df", smoothed_idf(n_docs).alias("idf")), "term-table")
        idf = Idf(numbers, n_docs, *term_sizes(numbers))
        if not idf.n_terms:
            raise ValueError("no term to build a vocabulary from")
        return [TermTable(text, idf, vocabulary_size is None and min_df <= 1)]
    seen = chosen.select("term", "df").toArrow().to_pydict()
    df = dict(zip(seen["term"], seen["df"]))
    if not df:
        raise ValueError("no term to build a vocabulary from")
    # Fitting on the chosen terms, one per row, hands them over inside the JVM.
    counts = CountVectorizer(inputCol="words", outputCol="counts", vocabSize=len(df)).fit(
        chosen.select(F.array("term").alias("words")))
    weights = [math.log((1 + n_docs) / (1 + df[term])) + 1 for term in counts.vocabulary]
    return [word_tokenizer(text), counts,
            ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="counts",
                               outputCol="weighted"),
            Normalizer(p=2.0, inputCol="weighted", outputCol=output)]


def binary_bag_stages(docs: DataFrame, text: str = "text", output: str = "features",
                      max_words: int = 1000) -> list:
    """Fitted stages: presence of each of the ``max_words - 1`` most used terms."""
    terms = [r["term"] for r in top_terms(docs, text, max_words).orderBy("index").collect()]
    spaces = " " * len(fixed.TOKENIZER_FILTER)
    quoted = fixed.TOKENIZER_FILTER.replace("\\", "\\\\").replace("'", "\\'")
    words = SQLTransformer(statement=(
        f"SELECT *, filter(split(translate(lower({text}), '{quoted}', '{spaces}'), ' '), "
        f"w -> w <> '') AS words FROM __THIS__"))
    bag = CountVectorizerModel.from_vocabulary(terms, inputCol="words", outputCol=output)
    return [words, bag.setBinary(True)]


def document_embedding(docs: DataFrame, text: str = "text", output: str = "features",
                       size: int = 300, epochs: int = 30, step: float = 0.065,
                       min_count: int = 1, seed: int = 42,
                       vocabulary_size: int | None = None) -> list:
    """Fitted stages: mean of learnt word vectors per document.

    Training is split over as many partitions as the cluster has cores; one partition,
    the library's default, would pass the whole corpus through one task. The learner
    holds its vocabulary, of all words, on the driver; with a ``vocabulary_size`` the least
    used words are left out.
    """
    used = written(each_term(docs, words=space_tokens(text)).groupBy("term")
                   .agg(F.count("*").alias("n")), "words")
    words = space_tokenizer(text)
    learner = Word2Vec(vectorSize=size, minCount=max(min_count, usage_cut(used, vocabulary_size) + 1),
                       maxIter=epochs, stepSize=step,
                       numPartitions=docs.sparkSession.sparkContext.defaultParallelism,
                       inputCol="words", outputCol=output, seed=seed)
    return [words, learner.fit(words.transform(docs))]


def vector_lookup(tags: DataFrame, vectors: DataFrame, tag: str, vector_key: str) -> DataFrame:
    """The tagged rows with their vectors, by key; ``found`` is false where there is none."""
    return tags.join(vectors.withColumn("found", F.lit(True)), F.col(tag) == F.col(vector_key),
                     "left").withColumn("found", F.coalesce("found", F.lit(False)))


def label_index(label: str = "label", output: str = "label_index") -> StringIndexer:
    """Codes 0..k-1 in label order."""
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="alphabetAsc",
                         handleInvalid="error")


def label_one_hot(label: str = "label", index: str = "label_index",
                  output: str = "label_vector") -> Pipeline:
    """Label codes and their one-hot vectors of length k."""
    return Pipeline(stages=[label_index(label, index),
                            OneHotEncoder(inputCols=[index], outputCols=[output],
                                          dropLast=False)])


def embedding_features(df: DataFrame, embedding: str, output: str = "features") -> DataFrame:
    """A vector column from an existing array-of-float embedding column."""
    return df.withColumn(output, array_to_vector(F.col(embedding).cast("array<double>")))


# ---- nearest centroid: a closed-form classifier on embeddings ----------------------

def fit_centroids(df: DataFrame, embedding: str, label: str) -> DataFrame:
    """``(label, mean)`` as a written table; partial means per partition, one row per class.

    Rows without a label or an embedding are not counted.
    """
    known = df.filter(F.col(label).isNotNull() & F.col(embedding).isNotNull())
    return written(embedding_features(known, embedding).groupBy(F.col(label).alias("label")).agg(
        vector_to_array(Summarizer.mean(F.col("features"))).alias("mean")), "centroids")


def nearer(points: np.ndarray, names: list, means: np.ndarray) -> tuple[list, np.ndarray]:
    """The closest of some means to each point, and its distance; ties go to the first name.

    One matrix product ranks them; all that lie within its rounding of the best are then
    measured as they are.
    """
    rough = (means * means).sum(axis=1) - 2 * points @ means.T
    scale = (means * means).sum(axis=1).max() + (points * points).sum(axis=1)
    close = rough <= (rough.min(axis=1) + 1e-12 * (1 + scale))[:, None]
    best, distance = np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    row, place = np.nonzero(close)
    exact = np.sqrt(((points[row] - means[place]) ** 2).sum(axis=1))
    order = np.lexsort((place, exact, row))
    first = np.unique(row[order], return_index=True)[1]
    best[row[order][first]], distance[row[order][first]] = place[order][first], exact[order][first]
    return [names[i] for i in best], distance


def predict_centroids(df: DataFrame, embedding: str, centroids: DataFrame,
                      means_a_pass: int = MEANS_A_PASS) -> DataFrame:
    """``df`` with ``prediction`` and ``distance`` of the closest mean, for any number of classes.

    Means are sent to the tasks in parts of bounded size, in label order; each part is one
    matrix product a batch of rows and leaves the nearest so far, so that no row is ever paired
    with a class. A row without an embedding has no prediction; neither has any without classes.
    """
    label_type = centroids.schema["label"].dataType
    out = df.withColumns({"prediction": F.lit(None).cast(label_type),
                          "distance": F.lit(None).cast("double")})
    schema = out.schema

    def compare(names: list, means: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = {f: batch.column(f) for f in ("prediction", "distance")}
                rows = batch.column(embedding).to_pylist()
                places = [i for i, r in enumerate(rows) if r is not None]
                found, best = columns["prediction"].to_pylist(), columns["distance"].to_pylist()
                for at in range(0, len(places), ROWS_A_PRODUCT):
                    some = places[at:at + ROWS_A_PRODUCT]
                    near = nearer(np.array([rows[i] for i in some], np.float64), names, means)
                    for i, name, distance in zip(some, *near):
                        if best[i] is None or distance < best[i]:
                            found[i], best[i] = name, float(distance)
                for name, values in (("prediction", found), ("distance", best)):
                    index = batch.schema.get_field_index(name)
                    batch = batch.set_column(index, batch.schema.field(index),
                                             pa.array(values, batch.schema.field(index).type))
                yield batch
        return run

    ordered, after = centroids.orderBy("label"), None
    while True:
        rest = ordered if after is None else ordered.filter(F.col("label") > F.lit(after))
        part = rest.limit(means_a_pass).collect()
        if not part:
            return out
        after = part[-1]["label"]
        out = out.mapInArrow(compare([r["label"] for r in part],
                                     np.array([r["mean"] for r in part])), schema)
        if len(part) < means_a_pass:
            return out
