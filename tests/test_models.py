import pytest
from pyspark.sql import functions as F

from doctriage.operators import learners, metrics, vectors
from doctriage.plans import catalog
from doctriage.sources.tables import read_table
from doctriage.streaming import scoring


@pytest.fixture(scope="module")
def parts(spark):
    return catalog.corpus_parts(spark, "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def bayes(parts):
    train, _ = parts
    return learners.fit_classifier(train, vectors.tfidf_stages(train, "doc_id"), "lang",
                                   learners.naive_bayes)


def accuracy(fitted, test, label="lang"):
    return metrics.accuracy(learners.predict(fitted.pipeline, test, label), label).first()[0]


def test_naive_bayes_floor(parts, bayes):
    assert accuracy(bayes, parts[1]) >= 0.95


@pytest.mark.parametrize("learner", [learners.logistic_regression, learners.linear_svm])
def test_linear_floor(parts, learner):
    train, test = parts
    stages = vectors.tfidf_stages(train, "doc_id", min_df=2)
    assert accuracy(learners.fit_classifier(train, stages, "lang", learner), test) >= 0.95


def test_linear_svm_on_large_tables_fits_class_by_class():
    """Four fits at once held four times the solver's vectors on the driver."""
    assert [learners.linear_svm(n, 4).getParallelism() for n in (0, 700, 36_000, 360_000)] == [4, 4, 4, 1]


def test_network_floor(parts):
    train, test = parts
    stages = vectors.binary_bag_stages(train)
    learner = learners.neural_network(len(stages[-1].vocabulary), hidden=32, max_iter=20)
    assert accuracy(learners.fit_classifier(train, stages, "lang", learner), test) >= 0.95


def test_document_embedding_floor(parts):
    train, test = parts
    stages = vectors.document_embedding(train, size=20, epochs=1)
    fitted = learners.fit_classifier(train, stages, "lang", learners.logistic_regression)
    assert accuracy(fitted, test) >= 0.9


def test_embedding_classifier_on_separable_rows(spark):
    rows = [(i, [float(i % 3), float(i % 3 == 1), 0.001 * i], str(i % 3)) for i in range(90)]
    df = vectors.embedding_features(
        spark.createDataFrame(rows, "k long, e array<float>, label string"), "e")
    fitted = learners.fit_classifier(df, [], "label", learners.logistic_regression)
    assert accuracy(fitted, df, "label") == 1.0
    history = learners.training_history(spark, fitted).orderBy("iteration").collect()
    assert history[0]["objective"] > history[-1]["objective"]


def test_save_and_load(spark, parts, bayes, tmp_path):
    path = str(tmp_path / "m")
    learners.save_model(spark, bayes.pipeline, path, "text", "words")
    with pytest.raises(ValueError):
        learners.load_model(spark, path, "text", "other")
    loaded = learners.load_model(spark, path, "text", "words")
    test = parts[1]
    rows = [sorted(learners.predict(m, test, "doc_id").select("doc_id", "prediction").collect())
            for m in (bayes.pipeline, loaded)]
    assert rows[0] == rows[1]


def test_compare_models(spark):
    good = spark.createDataFrame([("a", "a"), ("b", "b")], "label string, prediction string")
    bad = spark.createDataFrame([("a", "b"), ("b", "b")], "label string, prediction string")
    rows = learners.compare_models({"good": good, "bad": bad}).collect()
    assert {(r["model"], r["is_best"]) for r in rows} == {("good", True), ("bad", False)}


def test_stream_equals_batch(spark, folder, bayes, tmp_path):
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None)], docs.schema))
    drop, out = str(tmp_path / "drop"), str(tmp_path / "out")
    docs.repartition(3).write.parquet(drop)

    def run():
        stream = scoring.open_drop(spark, drop, docs.schema, files_per_batch=2)
        scoring.drain(scoring.score(stream, bayes.pipeline, "utility"), out, str(tmp_path / "c"))

    run()
    batch = scoring.score(docs, bayes.pipeline, "utility")
    got = spark.read.schema(batch.schema).parquet(out)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    assert got.filter("doc_id = -1").first()["outcome"] == "error"
    run()                                   # nothing new has arrived
    assert got.count() == docs.count()
    late = spark.createDataFrame([(10 ** 6, "a refill")], docs.schema)
    late.write.mode("append").parquet(drop)
    run()
    assert spark.read.schema(batch.schema).parquet(out).filter(
        F.col("doc_id") == 10 ** 6).first()["class"] == "gasbill"


def test_registered_queries_train_in_full(monkeypatch):
    """The operators' own sizes, epochs and iterations, not smaller ones."""
    from types import SimpleNamespace
    from doctriage.plans import catalog
    asked = []
    monkeypatch.setattr(catalog.corpus, "concat_parts", lambda *parts: None)
    monkeypatch.setattr(catalog.vectors, "document_embedding",
                        lambda docs, **settings: asked.append(settings) or [])
    monkeypatch.setattr(catalog.vectors, "binary_bag_stages",
                        lambda docs: [SimpleNamespace(vocabulary=["a"])])
    monkeypatch.setattr(catalog.learners, "neural_network",
                        lambda inputs, **settings: asked.append(settings))
    monkeypatch.setattr(catalog.learners, "fit_classifier", lambda *_: None)
    catalog._embedded_fit(None, None)
    catalog._network_fit(None, None)
    assert asked == [{}, {}]
