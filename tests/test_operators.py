import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from doctriage.functions.text import clean_text
from doctriage.operators import bayes, corpus, metrics, splits, terms, vectors
from doctriage.plans import catalog
from doctriage.session import TASKS_A_SPLIT
from doctriage.sources.tables import read_table

DOCS = [(1, "x", "red red apple"), (2, "x", "red pear"), (3, "y", "blue sky blue"),
        (4, "y", "sky apple"), (5, None, "red sky"), (6, "y", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, label string, text string").cache()


def brute_weights(train, rows):
    n = len(train)
    df = Counter(t for _, _, text in train for t in set(text.split()))
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
    out = {}
    for key, _, text in rows:
        raw = {t: c * idf[t] for t, c in Counter(text.split()).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out[key] = {t: v / norm for t, v in raw.items()}
    return out


@pytest.mark.parametrize("budget", [None, 800, 1])
def test_tfidf_weights(spark, docs, budget):
    idf = terms.fit_idf(docs, "id", "text")
    rows = terms.tfidf_weights(terms.term_counts(docs, "id", "text"), "id", idf, budget).collect()
    want = brute_weights(DOCS, DOCS)
    assert {(r["id"], r["term"]): pytest.approx(r["weight"]) for r in rows} == {
        (k, t): w for k, ws in want.items() for t, w in ws.items()}


@pytest.mark.parametrize("budget", [None, 800])
def test_naive_bayes(spark, docs, budget):
    train = [d for d in DOCS if d[1]]
    model = bayes.fit_bayes(docs, "id", "text", "label", budget=budget)
    weights = brute_weights(train, train)
    classes = ["x", "y"]
    vocabulary = {t for w in weights.values() for t in w}
    sums = {c: Counter() for c in classes}
    for key, label, _ in train:
        for t, w in weights[key].items():
            sums[label][t] += w
    scored = brute_weights(train, DOCS)
    got = {r["id"]: r for r in bayes.score_bayes(model, docs, "id", "text", budget=budget).collect()}
    assert set(got) == {d[0] for d in DOCS}
    for key, ws in scored.items():
        want = [math.log(sum(d[1] == c for d in train) / len(train)) + sum(
            w * math.log((sums[c][t] + 1) / (sum(sums[c].values()) + len(vocabulary)))
            for t, w in ws.items()) for c in classes]
        assert got[key]["scores"] == pytest.approx(want)
        assert got[key]["prediction"] == classes[want.index(max(want))]
        assert sum(got[key]["probability"]) == pytest.approx(1)


def test_naive_bayes_of_many_classes(spark):
    """5,000 labels, in either way of joining: each document is told by its label's own words."""
    rows = [(i, f"c{i % 5000}", f"own{i % 5000} common{i % 7} words") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "id long, label string, text string")
    for budget in (None, 200_000):
        model = bayes.fit_bayes(docs, "id", "text", "label", budget=budget)
        asked = docs.filter("id < 40").unionByName(spark.createDataFrame(
            [(-1, None, "never seen"), (-2, None, None)], docs.schema))
        out = {r["id"]: r for r in bayes.score_bayes(model, asked, "id", "text", budget=budget).collect()}
        assert len(out) == 42 and all(out[i]["prediction"] == f"c{i}" for i in range(40))
        assert all(len(r["probability"]) == 5000 and abs(sum(r["probability"]) - 1) < 1e-9
                   for r in out.values())
        assert out[-1]["prediction"] == out[-2]["prediction"] == "c0"
    with pytest.raises(ValueError):
        model.names()


def test_vocabulary_limit(spark, docs):
    third = {r["term"] for r in terms.frequent_terms(docs, "id", "text", 3).collect()}
    everything = sorted(r["term"] for r in terms.frequent_terms(docs, "id", "text").collect())
    # The third place is shared: the first of those terms in order has it.
    assert third == {"red", "sky", next(t for t in everything if t not in ("red", "sky"))}
    assert len(everything) == 5 == terms.frequent_terms(docs, "id", "text", 99).count()


def test_vocabulary_limit_with_ties(spark):
    docs = spark.createDataFrame([(i, f"term{i}") for i in range(1000)], "id long, text string")
    assert terms.frequent_terms(docs, "id", "text", 999).count() == 999


def test_class_limit(spark, docs, monkeypatch):
    monkeypatch.setattr(bayes, "MAX_CLASSES", 1)
    with pytest.raises(ValueError):
        bayes.class_counts(docs, "label")


def test_ml_tfidf_equals_the_long_form(spark, docs):
    stages = vectors.tfidf_stages(docs, "id")
    out = docs
    for stage in stages:
        out = stage.transform(out)
    vocabulary = stages[1].vocabulary
    want = brute_weights(DOCS, DOCS)
    for row in out.collect():
        features = row["features"]
        got = {vocabulary[i]: v for i, v in zip(features.indices.tolist(), features.values)}
        assert got == pytest.approx(want[row["id"]])
        assert features.norm(2) == pytest.approx(1 if want[row["id"]] else 0)


def test_binary_bag_stages_equal_the_long_form(spark, folder):
    cleaned = read_table(spark, folder, "documents", "doc_id", "text").withColumn(
        "text", clean_text("text"))
    top = terms.top_terms(cleaned, "text", 50)
    bag = {r["doc_id"]: r["indices"] for r in terms.binary_bag(
        cleaned, "doc_id", "text", top).collect()}
    out = cleaned
    for stage in vectors.binary_bag_stages(cleaned, max_words=50):
        out = stage.transform(out)
    for row in out.select("doc_id", "features").collect():
        assert [i + 1 for i in row["features"].indices.tolist()] == bag[row["doc_id"]]
        assert set(row["features"].values) <= {1.0}


def test_report_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")],
                               "label string, prediction string")
    rows = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert (rows["a"]["precision"], rows["a"]["recall"]) == (0.5, 0.5)
    assert (rows["b"]["precision"], rows["b"]["recall"]) == (0.5, 1.0)
    assert (rows["c"]["precision"], rows["c"]["f1"], rows["c"]["support"]) == (0.0, 0.0, 1)
    assert rows["accuracy"]["f1"] == 0.5 and rows["accuracy"]["precision"] is None
    assert rows["macro avg"]["recall"] == 0.5
    assert metrics.accuracy(df).first()[0] == 0.5
    assert metrics.classification_report(df.limit(0)).count() == 0
    matrix = {r["label"]: r for r in metrics.confusion_matrix(df, ["a", "b", "c"]).collect()}
    assert matrix["a"].asDict() == {"label": "a", "pred_a": 1, "pred_b": 1, "pred_c": 0}


def test_report_against_the_built_in_evaluator(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("double").alias("label"),
                                 ((F.col("id") * 7 + F.col("id") % 5) % 3).cast("double")
                                 .alias("prediction"))
    rows = {r["class"]: r for r in metrics.classification_report(
        df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])).collect()}
    weighted = rows["weighted avg"]
    for metric, value in [("weightedPrecision", weighted["precision"]),
                          ("weightedRecall", weighted["recall"]), ("f1", weighted["f1"]),
                          ("accuracy", rows["accuracy"]["f1"])]:
        assert MulticlassClassificationEvaluator(metricName=metric).evaluate(df) == pytest.approx(
            value, abs=1e-6)


def test_split_is_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    first = {r["k"] for r in splits.hold_out(df, "k")[1].collect()}
    again = {r["k"] for r in splits.hold_out(df.repartition(13), "k")[1].collect()}
    assert first == again and 500 < len(first) < 700
    assert splits.hold_out(df, "k", leak=True)[0].count() == 2000


@pytest.mark.parametrize("values", [
    [5], [3, 3, 3, 1, 9], [-(2 ** 63), 2 ** 63 - 1, 0, 0, -1], list(range(-5000, 20000, 7)),
    [10 ** 15 + i for i in range(300)] + [1, 2]])
def test_cut_value(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values)
    for rank in {1, len(values) // 2 + 1, len(values)}:
        cut, below = splits.cut_value(df, F.col("v"), rank)
        assert cut == ordered[rank - 1] and below == sum(v < cut for v in values)


def test_exact_sizes_with_ties(spark):
    df = spark.createDataFrame([(i, i // 10) for i in range(100)], "k long, v long")
    marked = splits.first_by_rank(df, F.col("v"), "k", 37, "f").collect()
    assert {r["k"] for r in marked if r["f"]} == set(range(37))
    assert splits.exact_hold_out(df, "k").filter("is_test").count() == 30
    tail = splits.validation_tail(df, "k").filter("is_validation").collect()
    assert {r["k"] for r in tail} == set(range(90, 100))


def test_rows(spark, docs):
    assert corpus.labelled_rows(docs, "label").count() == 5
    assert corpus.rows_at(docs, "id", 3, ["text"]).collect()[0]["text"] == "blue sky blue"
    assert corpus.rows_at(docs, "id", 99).count() == 0
    assert [r["id"] for r in corpus.preview(docs, 2, "id").collect()] == [1, 2]
    counts = [(r["label"], r["n"]) for r in corpus.label_distribution(docs, "label").collect()]
    assert counts == [("y", 3), ("x", 2)]
    tags = corpus.concat_parts(corpus.tag_rows(docs, "Train", "id", "text"),
                               corpus.tag_rows(docs, "Test", "id", "text"))
    assert tags.filter("tag = 'Test_1'").first()["words"] == ["red", "red", "apple"]
    annotated = docs.select(F.array().cast("array<struct<result:string>>").alias("class"))
    assert annotated.select(corpus.first_result("class")).first()[0] is None


def test_label_codes(spark):
    df = spark.createDataFrame([("pan",), ("aadhar",)], "label string")
    out = vectors.label_one_hot().fit(df).transform(df)
    got = {r["label"]: (r["label_index"], r["label_vector"].toArray().tolist())
           for r in out.collect()}
    assert got == {"aadhar": (0.0, [1.0, 0.0]), "pan": (1.0, [0.0, 1.0])}


def test_centroids(spark):
    points = [(i, [float(c), 2.0 * c + 0.01 * (i % 3)], c) for i, c in enumerate([0, 1, 2] * 20)]
    df = spark.createDataFrame(points, "k long, e array<float>, label int")
    near = vectors.predict_centroids(df, "e", vectors.fit_centroids(df, "e", "label"))
    assert near.filter("prediction IS NULL OR prediction <> label").count() == 0


def test_centroids_of_many_classes(spark):
    """20,000 classes in parts of odd size against brute force; ties, nulls, no classes."""
    rng = np.random.default_rng(0)
    means = np.round(rng.normal(size=(20_000, 4)), 1)
    table = spark.createDataFrame(list(enumerate(means.tolist())), "label long, mean array<double>")
    points = np.round(rng.normal(size=(300, 4)), 1)
    rows = [(i, [float(x) for x in p], "x") for i, p in enumerate(points)] + [(300, None, "x")]
    df = spark.createDataFrame(rows, "k int, e array<double>, mean string")
    for part in (7_001, 50_000):
        out = {r["k"]: r for r in vectors.predict_centroids(df, "e", table, part).collect()}
        assert out[300]["prediction"] is None and len(out) == 301
        for i, p in enumerate(points):
            distances = np.sqrt(((means - p) ** 2).sum(axis=1))
            assert abs(out[i]["distance"] - distances.min()) < 1e-12
            assert out[i]["prediction"] == int(distances.argmin())
    none = vectors.predict_centroids(df, "e", table.limit(0))
    assert none.filter("prediction IS NULL").count() == 301


def test_binary_bag_needs_no_exchange(spark, folder):
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    top = terms.top_terms(docs, "text", 100)
    plan = terms.binary_bag(docs, "doc_id", "text", top)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "qqq"), (None, "x")], "doc_id long, text string")
    assert [r["indices"] for r in terms.binary_bag(odd, "doc_id", "text", top).collect()] == [[]] * 4
    assert terms.binary_bag(docs, "doc_id", "text", top.limit(0)).filter("size(indices) > 0").isEmpty()


def test_vector_lookup_keeps_all_tags(spark):
    tags = spark.createDataFrame([(1,), (2,), (None,)], "tag long")
    known = spark.createDataFrame([(2, [1.0])], "id long, v array<double>")
    out = {r["tag"]: (r["found"], r["v"]) for r in vectors.vector_lookup(tags, known, "tag", "id").collect()}
    assert out == {1: (False, None), 2: (True, [1.0]), None: (False, None)}


def test_tokenising_happens_once(spark, folder):
    """No filter below the generator may repeat the cleaning of a text."""
    train = catalog.documents(spark, folder)
    plan = terms.document_frequency(train, clean_text("text"))._jdf.queryExecution(
        ).optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_texts_travel_instead_of_words_and_splits_are_dealt_to_several_tasks(spark):
    n = spark.sparkContext.defaultParallelism + 3
    many = spark.range(0, 100, 1, n).selectExpr("id", "concat('ab cd ab ', id + 10) AS text")
    counts = terms.term_counts(many, "id", "text")
    plan = counts._jdf.queryExecution().executedPlan().toString()       # from the last step down
    assert plan.count("Exchange") == 1
    assert plan.index("regexp_extract_all") < plan.index("Exchange")
    assert terms.words_by_document(many, "id", "text").rdd.getNumPartitions() == n * TASKS_A_SPLIT
    assert Counter(r["tf"] for r in counts.collect()) == {2: 100, 1: 200}


def test_the_idf_is_not_sent_with_the_sums_of_naive_bayes(spark, docs, monkeypatch):
    plans = []
    monkeypatch.setattr(bayes, "written", lambda df, name: plans.append(
        (name, df._jdf.queryExecution().optimizedPlan().toString())) or df)
    model = bayes.fit_bayes(docs, "id", "text", "label")
    sums = next(plan for name, plan in plans if name == "bayes-sums")
    grouped = next(line for line in sums.splitlines() if "Aggregate [" in line)
    assert "df#" in grouped and "idf#" not in grouped.split("], [")[0]
    known = {r["term"]: r["idf"] for r in terms.fit_idf(
        docs.filter("label IS NOT NULL"), "id", "text").table.collect()}
    assert known and known == {r["term"]: r["idf"] for r in model.terms.collect()}
