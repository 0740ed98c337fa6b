"""Multinomial naive Bayes on TF-IDF weights, as aggregates and one join.

Priors are the plain class shares and likelihoods are smoothed, which is the usual
multinomial model; the built-in learner smooths the priors as well, which can be asked for.
Fitting leaves one row per term, with the classes it occurs in, and one row of class numbers; so a model's size
follows the (term, class) pairs that occur, and classes may be many. Scoring needs one join
and partial aggregations per document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from doctriage.operators.terms import (Idf, fit_idf, join_terms, smoothed_idf, term_counts,
                                       tfidf_weights, words_by_document)
from doctriage.session import written

MAX_CLASSES = 1_000
ENTRY_BYTES = 40                    # of a class in a term's row, besides its name
ENTRY = "struct<label: string, gain: double>"


@dataclass(frozen=True)
class BayesModel:
    """``classes``: one row with the arrays ``label``, ``prior`` and ``base``, in class order.
    ``terms``: term, df, idf and ``entries``, the log likelihoods above that of a class
    without the term; the first entry has no label and stands for all classes."""
    classes: DataFrame
    terms: DataFrame
    n_terms: int
    term_bytes: int
    widest: int                     # bytes of the largest term's entries
    n_docs: int

    def names(self) -> list[str]:
        """The classes on the driver, for results with a column each."""
        labels = list(self.classes.first()["label"])
        if len(labels) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        return labels


def class_counts(docs: DataFrame, label: str) -> dict[str, int]:
    """Rows per class, in class order; the number of classes is checked."""
    rows = (docs.filter(F.col(label).isNotNull()).groupBy(label)
            .agg(F.count("*").alias("n")).orderBy(label).limit(MAX_CLASSES + 1).collect())
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    return {row[label]: row["n"] for row in rows}


def fit_bayes(docs: DataFrame, key: str, text: str | Column, label: str,
              alpha: float = 1.0, budget: int | None = None, idf: Idf | None = None,
              prior_alpha: float = 0.0, complete: bool = False) -> BayesModel:
    """Fit on ``docs`` (``text`` is cleaned text), with the given ``idf`` of the same documents
    or their own; ``prior_alpha`` is added to the rows of each class. A ``complete`` one has all
    their terms."""
    docs = docs.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("string"))
    counts = written(docs.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")),
                     "bayes-classes")
    n_docs, n_classes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    idf = fit_idf(docs, key, text, n_docs) if idf is None else idf
    weights = tfidf_weights(term_counts(docs, key, text, label), key, idf, budget, complete)
    # Each fitted term occurs in some document, so its df comes along with the sums; its idf
    # follows from that, and neither is sorted nor sent.
    sums = written(weights.groupBy("term", "df", F.col(label).alias("label"))
                   .agg(F.sum("weight").alias("s"))
                   .withColumn("idf", smoothed_idf(idf.n_docs)), "bayes-sums")
    base = F.log(F.lit(alpha)) - F.log(F.coalesce("t", F.lit(0.0)) + alpha * idf.n_terms)
    prior = F.log((F.col("n") + prior_alpha) / (n_docs + prior_alpha * n_classes))
    numbers = (counts.join(sums.groupBy("label").agg(F.sum("s").alias("t")), "label", "left")
               .select("label", prior.alias("prior"), base.alias("base")))
    row = F.array_sort(F.collect_list(F.struct("label", "prior", "base")))
    classes = written(numbers.agg(row.alias("c")).select("c.label", "c.prior", "c.base"),
                      "bayes-numbers")
    gain = F.log((F.col("s") + alpha) / alpha)
    every = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("gain")))
    terms = written(sums.groupBy("term", "df", "idf").agg(F.collect_list(F.struct(
        "label", gain.alias("gain"))).alias("entries"))
        .withColumn("entries", F.concat(every, "entries")), "bayes-terms")
    size = F.aggregate("entries", F.lit(0).cast("bigint"), lambda total, e: total + ENTRY_BYTES
                       + F.coalesce(F.octet_length(e["label"]), F.lit(0)))
    entry_bytes, widest = terms.agg(F.coalesce(F.sum(size), F.lit(0)),
                                    F.coalesce(F.max(size), F.lit(0))).first()
    return BayesModel(classes, terms, idf.n_terms, idf.term_bytes + entry_bytes, widest, n_docs)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, though ``body`` loops over an array."""
    return F.transform(F.array(value), body)[0]


def score_bayes(model: BayesModel, docs: DataFrame, key: str, text: str | Column,
                *carry: str, budget: int | None = None) -> DataFrame:
    """``(key, *carry, classes, scores, prediction, probability)``; every document is kept.

    Distinct terms are counted per document and joined with the model. A document's sums by class,
    and its length norm, are added up in its partition; classes none of its words
    occurs in are filled in from the row of class numbers.
    """
    words = words_by_document(docs, key, text, *carry)
    by_doc = words.select(key, *carry, F.explode_outer("words").alias("term"))
    counts = by_doc.groupBy(key, *carry, "term").agg(F.count("*").alias("tf"))
    joined = join_terms(counts, model.terms, model.n_terms, model.term_bytes, "left",
                        budget=budget, wide=model.widest)
    each = joined.select(key, *carry, (F.col("tf") * F.col("idf")).alias("__raw"),
                         F.explode_outer("entries").alias("__entry"))
    raw = F.col("__raw")
    sums = each.groupBy(key, *carry, F.col("__entry.label").alias("__label")).agg(
        F.sum(raw).alias("total"), F.sum(raw * raw).alias("squares"),
        F.sum(raw * F.col("__entry.gain")).alias("dot"))
    overall = F.col("__label").isNull()
    found = F.collect_list(F.when(~overall, F.struct("__label", "dot")))
    rows = sums.groupBy(key, *carry).agg(
        F.map_from_entries(found).alias("dots"),
        F.coalesce(F.max(F.when(overall, F.col("total"))), F.lit(0.0)).alias("total"),
        F.sqrt(F.coalesce(F.max(F.when(overall, F.col("squares"))), F.lit(0.0))).alias("norm"))
    scores = F.transform("label", lambda name, i: F.get("prior", i) + F.coalesce(F.try_divide(
        F.get("base", i) * F.col("total") + F.coalesce(F.try_element_at("dots", name), F.lit(0.0)),
        F.col("norm")), F.lit(0.0)))
    odds = bound(F.array_max("scores"), lambda top: F.transform("scores", lambda s: F.exp(s - top)))
    shares = bound(F.aggregate("odds", F.lit(0.0), lambda a, b: a + b),
                   lambda total: F.transform("odds", lambda o: o / total))
    # One row of class numbers for every document: a broadcast of one row.
    numbers = model.classes.select(F.struct("label", "prior", "base").alias("__classes"))
    return (rows.join(F.broadcast(numbers), F.lit(True)).select("*", "__classes.*")
            .select(key, *carry, F.col("label").alias("classes"), scores.alias("scores"))
            .withColumn("odds", odds)
            .select(key, *carry, "classes", "scores",
                    F.get("classes", F.array_position("scores", F.array_max("scores")).cast("int") - 1)
                    .alias("prediction"), shares.alias("probability")))
