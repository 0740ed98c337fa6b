"""Classifiers as ML pipelines, or as tables: fit, score, history, comparison, save and load."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest)
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from doctriage.operators.bayes import BayesModel, fit_bayes, score_bayes
from doctriage.operators.metrics import classification_report
from doctriage.operators.vectors import TermTable, label_index
from doctriage.session import release, written

INVERSE_STRENGTH = 1e5              # fixed value: C of the logistic regression
SVM_PENALTY = 1e-3                  # fixed value: alpha of the linear SVM
HIDDEN_UNITS = 512                  # fixed value: width of the hidden layer
ROWS_PER_TASK = 5_000               # an iterating solver pays per task and iteration
ROWS_AT_ONCE = 160_000              # rows of all classes that are fitted side by side
ROW = "__row"


def naive_bayes(n_train: int, n_classes: int) -> Estimator:
    return NaiveBayes(modelType="multinomial", smoothing=1.0, labelCol="label_index")


def linear_svm(n_train: int, n_classes: int, max_iter: int = 100) -> Estimator:
    """Hinge loss, one against the rest; gives labels but no probabilities.

    Classes are fitted side by side while one alone leaves cores idle. Beyond that it gains
    nothing, and each fit holds some twenty vectors of all terms on the driver.
    """
    return OneVsRest(classifier=LinearSVC(regParam=SVM_PENALTY, maxIter=max_iter,
                                          standardization=False),
                     labelCol="label_index",
                     parallelism=max(1, min(4, ROWS_AT_ONCE // max(1, n_train))))


def logistic_regression(n_train: int, n_classes: int, max_iter: int = 100) -> Estimator:
    return LogisticRegression(family="multinomial", labelCol="label_index", maxIter=max_iter,
                              regParam=1.0 / (INVERSE_STRENGTH * n_train),
                              standardization=False)


def neural_network(inputs: int, hidden: int = HIDDEN_UNITS, max_iter: int = 100,
                   seed: int = 42) -> Callable[[int, int], Estimator]:
    def build(n_train: int, n_classes: int) -> Estimator:
        return MultilayerPerceptronClassifier(layers=[inputs, hidden, n_classes], seed=seed,
                                              maxIter=max_iter, blockSize=32,
                                              labelCol="label_index")
    return build


@dataclass(frozen=True)
class TableModel:
    """Naive Bayes on TF-IDF of the column ``text``, held as tables instead of ML stages.

    Nothing of it that grows with terms is on the driver or sent with a task whole.
    """
    text: str
    bayes: BayesModel


@dataclass(frozen=True)
class Fitted:
    pipeline: PipelineModel | TableModel
    learner: object                     # the fitted last stage, for its summary


def fit_classifier(train: DataFrame, feature_stages: list, label: str,
                   learner: Callable[[int, int], Estimator]) -> Fitted:
    """Chain feature stages, label index, learner and label names into one model.

    Features are computed once, in parallel, and kept while the solver iterates over
    them; a small training set is then held by few tasks, a large one by all. On a ``TermTable``
    naive Bayes is fitted as tables.
    """
    if feature_stages and isinstance(feature_stages[0], TermTable):
        return fit_tables(train, feature_stages[0], label, learner)
    features = PipelineModel(stages=feature_stages).transform(train)
    index = label_index(label).fit(train)
    ready = (index.transform(features).select("features", "label_index")
             .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        n_train = ready.count()
        tasks = -(-n_train // ROWS_PER_TASK)
        model = learner(n_train, len(index.labels)).fit(ready.coalesce(max(1, tasks)))
    finally:
        ready.unpersist()
    names = IndexToString(inputCol="prediction", outputCol="predicted_label",
                          labels=index.labels)
    return Fitted(PipelineModel(stages=[*feature_stages, model, names]), model)


def fit_tables(train: DataFrame, stage: TermTable, label: str,
               learner: Callable[[int, int], Estimator]) -> Fitted:
    """Naive Bayes as the built-in learner has it, priors smoothed too. Each row counts as a
    document, whatever its key; as there, a row without a label is an error."""
    if learner is not naive_bayes:
        raise ValueError("only naive Bayes is fitted on a table of terms")
    if not train.filter(F.col(label).isNull()).isEmpty():
        raise ValueError(f"{label} has nulls")
    rows = train.select(F.monotonically_increasing_id().alias(ROW), stage.text, label)
    release(train.sparkSession)         # what counting the terms has shuffled
    model = fit_bayes(rows, ROW, stage.text, label, idf=stage.idf, prior_alpha=1.0,
                      complete=stage.complete)
    release(train.sparkSession)         # and the terms that fitting has broadcast
    return Fitted(TableModel(stage.text, model), model)


def predict_tables(model: TableModel, docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """As ``predict``. The rows are numbered and written, scored by number and joined back."""
    if docs.isStreaming:
        raise ValueError("a model of tables scores a stream batch by batch, as a step of its drain")
    columns = dict.fromkeys([*keep, text])
    # A batch of a stream comes in a session without adaptive execution, the model does not.
    rows = written(docs.select(F.monotonically_increasing_id().alias(ROW), *columns), "to-predict",
                   session=model.bayes.terms.sparkSession)
    scored = score_bayes(model.bayes, rows, ROW, text).select(ROW, "prediction", "probability")
    return rows.select(ROW, *keep).join(scored, ROW).select(*keep, "prediction", "probability")


def predict(model: PipelineModel | TableModel, docs: DataFrame, *keep: str,
            text: str | None = None) -> DataFrame:
    """Label per row as ``prediction`` and, where the model has one, ``probability``.

    A model of tables may read its text from the column ``text`` instead of its own.
    """
    if isinstance(model, TableModel):
        return predict_tables(model, docs, list(keep), text or model.text)
    scored = model.transform(docs)
    columns = [F.col(c) for c in keep] + [F.col("predicted_label").alias("prediction")]
    if "probability" in scored.columns:
        columns.append(vector_to_array("probability").alias("probability"))
    return scored.select(*columns)


def training_history(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """Objective per iteration of the fit."""
    summary = fitted.learner.summary
    summary = summary() if callable(summary) else summary
    rows = [(i, float(v)) for i, v in enumerate(summary.objectiveHistory)]
    return spark.createDataFrame(rows, "iteration long, objective double")


def compare_models(predictions: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Reports of several models under each other; the most accurate one is marked."""
    reports = [classification_report(df, label).withColumn("model", F.lit(name))
               for name, df in predictions.items()]
    union = reduce(DataFrame.unionByName, reports)
    accuracy = F.when(F.col("class") == "accuracy", F.struct("f1", "model"))
    everywhere = Window.partitionBy(F.lit(0))       # models x classes rows
    return (union.withColumn("is_best",
                             F.max_by("model", accuracy).over(everywhere) == F.col("model"))
            .select("model", "class", "precision", "recall", "f1", "support", "is_best"))


TABLE_NUMBERS = ("n_terms", "term_bytes", "widest", "n_docs")


def save_model(spark: SparkSession, model: PipelineModel | TableModel, path: str,
               feature_column: str, embedding: str | None = None) -> None:
    """Store the model and a note of the input it needs."""
    note = {"feature_column": feature_column, "embedding": embedding}
    if isinstance(model, TableModel):
        model.bayes.classes.write.mode("overwrite").parquet(f"{path}/model/classes")
        model.bayes.terms.write.mode("overwrite").parquet(f"{path}/model/terms")
        note["tables"] = {"text": model.text,
                          **{name: getattr(model.bayes, name) for name in TABLE_NUMBERS}}
    else:
        model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/needs")


def load_model(spark: SparkSession, path: str, feature_column: str,
               embedding: str | None = None) -> PipelineModel | TableModel:
    """Load a model after checking that it reads the given column and embedding."""
    needs = json.loads(spark.read.text(f"{path}/needs").first()["value"])
    tables = needs.pop("tables", None)
    given = {"feature_column": feature_column, "embedding": embedding}
    if needs != given:
        raise ValueError(f"model needs {needs}, got {given}")
    if tables is None:
        return PipelineModel.load(f"{path}/model")
    parts = [spark.read.parquet(f"{path}/model/{part}") for part in ("classes", "terms")]
    return TableModel(tables["text"], BayesModel(*parts, *[tables[name] for name in TABLE_NUMBERS]))
