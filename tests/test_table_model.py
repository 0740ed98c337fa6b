"""Naive Bayes held in tables: the same model as the built-in stages, also stored and on streams."""

import pytest
from pyspark.sql import functions as F

from doctriage.operators import learners, terms, vectors
from doctriage.plans import catalog, serving
from doctriage.streaming import scoring

DOCS = [(1, "a", "red apple red"), (2, "a", "green apple pie"), (2, "b", "blue sky apple"),
        (2, "b", "blue sky"), (None, "b", "blue sea sky"), (None, "c", "old iron"), (7, "c", "")]
ASKED = [(1, "apple blue"), (1, "iron"), (None, "sky sky red"), (None, "unknown words"), (5, None), (6, "")]


@pytest.fixture(scope="module")
def fitted(spark):
    train = spark.createDataFrame(DOCS, "doc_id long, lang string, text string")
    return [learners.fit_classifier(train, vectors.tfidf_stages(train, "doc_id", table=table), "lang",
                                    learners.naive_bayes).pipeline for table in (False, True)]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "doc_id long, text string")


def answers(scored, *columns):
    return sorted(((*(str(r[c]) for c in columns), [round(p, 9) for p in r["probability"]])
                   for r in scored.collect()), key=str)


@pytest.mark.parametrize("budget", [1, 256 << 20])
def test_tables_predict_as_the_stages(monkeypatch, fitted, asked, budget):
    """Rows are documents whatever their key; both ways of joining terms."""
    monkeypatch.setattr(terms, "BROADCAST_BYTES", budget)
    ready = asked.withColumn("text", F.coalesce("text", F.lit("")))
    stages, tables = (answers(learners.predict(m, ready, "doc_id"), "doc_id", "prediction")
                      for m in fitted)
    assert stages == tables and len(tables) == len(ASKED)
    missing = learners.predict(fitted[1], asked, "doc_id", "text").filter("text IS NULL").first()
    assert missing["doc_id"] == 5 and missing["prediction"] is not None


def test_queries_hold_no_vocabulary_on_the_driver(spark, folder, monkeypatch):
    def no_terms(*_):
        raise AssertionError("terms on the driver")
    monkeypatch.setattr(vectors, "CountVectorizer", no_terms)
    assert isinstance(catalog._ml_bayes(spark, folder)[0].pipeline, learners.TableModel)
    assert isinstance(serving.stored_model(spark, folder), learners.TableModel)


def test_store_and_load(spark, fitted, asked, tmp_path):
    path = str(tmp_path / "m")
    learners.save_model(spark, fitted[1], path, "text", "words")
    with pytest.raises(ValueError):
        learners.load_model(spark, path, "text")
    loaded = learners.load_model(spark, path, "text", "words")
    before, after = (answers(learners.predict(m, asked, "doc_id"), "doc_id", "prediction")
                     for m in (fitted[1], loaded))
    assert before == after


def test_a_row_without_a_label_is_an_error(spark):
    train = spark.createDataFrame([(1, "a", "red sky"), (2, None, "sea")], "doc_id long, lang string, text string")
    stages = vectors.tfidf_stages(train, "doc_id", table=True)
    with pytest.raises(ValueError):
        learners.fit_classifier(train, stages, "lang", learners.naive_bayes)
    with pytest.raises(ValueError):
        learners.fit_classifier(train, stages, "lang", learners.linear_svm)
    with pytest.raises(ValueError):
        vectors.tfidf_stages(train.limit(0), "doc_id", table=True)


def test_stream_by_batches_equals_batch(spark, fitted, asked, tmp_path):
    drop, out = str(tmp_path / "drop"), str(tmp_path / "out")
    asked.repartition(3).write.parquet(drop)
    columns = ["doc_id", "model_label", "class", "outcome"]

    def step(batch):
        return scoring.score(batch, fitted[1], "utility", "fixed").select(*columns)

    def run():
        stream = scoring.open_drop(spark, drop, asked.schema, files_per_batch=1)
        scoring.drain(stream, out, str(tmp_path / "c"), step)
        return sorted(map(str, spark.read.parquet(out).select(*columns).collect()))

    want = sorted(map(str, step(asked).collect()))
    assert run() == want and run() == want      # nothing new has arrived
    asked.limit(1).write.mode("append").parquet(drop)
    assert len(run()) == len(want) + 1
    with pytest.raises(ValueError):
        scoring.score(scoring.open_drop(spark, drop, asked.schema), fitted[1], "utility")


def test_terms_of_one_document_are_not_broadcast(spark, monkeypatch):
    """Fitting looks up only the terms of two documents or more; a cut vocabulary has no such rest."""
    train = spark.createDataFrame(DOCS, "doc_id long, lang string, text string")
    asked_for, join = [], terms.join_terms

    def noted(rows, table, *rest, **more):
        asked_for.append(sorted(r["term"] for r in table.collect()))
        return join(rows, table, *rest, **more)

    monkeypatch.setattr(terms, "join_terms", noted)
    for settings in ({}, {"min_df": 2}, {"vocabulary_size": 3}):
        stages = vectors.tfidf_stages(train, "doc_id", table=True, **settings)
        learners.fit_classifier(train, stages, "lang", learners.naive_bayes)
    assert asked_for[:2] == [["apple", "blue", "sky"]] * 2 and len(asked_for[2]) == 3
