"""The registered queries: each operator over the given tables, with its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from doctriage.functions import fixed
from doctriage.functions.text import (clean_text, filterset_tokens, html_to_text, space_tokens,
                                      word_count, word_tokens)
from doctriage.operators import (bayes, corpus, learners, metrics, rules, splits, terms, vectors,
                                 vocabulary)
from doctriage.plans import sql as S
from doctriage.session import scratch_path, spread, written
from doctriage.sources import files, ocr
from doctriage.sources.tables import read_spread, read_table
from doctriage.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's or the given name, with its SQL check."""
    def register(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql:
            SQL[name or fn.__name__] = sql
        return fn
    return register


def long(c: Column) -> Column:
    return c.cast("bigint")


def pick(values: list) -> Column:
    """A value per row, by document number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (F.col("doc_id") % len(values) + 1).cast("int"))


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_spread(spark, folder, "documents", *(columns or ("doc_id", "text")))


def corpus_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned ``(doc_id, lang, text)``: train and test part."""
    return splits.hold_out(cleaned_corpus(spark, folder), "doc_id")


def cleaned_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned documents as a written table.

    Fitting reads the texts several times; cleaning costs many times the CPU of reading
    a cleaned text back, so it is done once.
    """
    cleaned = documents(spark, folder, "doc_id", "lang", "text").withColumn(
        "text", clean_text("text"))
    return written(cleaned, "clean-corpus")


# ---- rows, counts, labels ------------------------------------------------------------

@query(f"""SELECT sum(len(string_split(text, ' ')))::BIGINT AS words_before,
  sum(len(string_split({S.clean_sql('text')}, ' ')))::BIGINT AS words_after FROM documents""")
def word_totals(spark, folder):
    return corpus.word_total(documents(spark, folder), F.col("text"), clean_text("text"),
                             names=["words_before", "words_after"])


@query("SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang")
def label_distribution(spark, folder):
    docs = read_table(spark, folder, "documents", "lang").withColumnRenamed("lang", "category")
    return corpus.label_distribution(docs)


@query("""SELECT quality::VARCHAR AS category, count(*) AS n
  FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY quality""")
def label_distribution_nullable(spark, folder):
    docs = read_table(spark, folder, "documents", "doc_id").join(
        read_table(spark, folder, "labels", "doc_id", "quality"), "doc_id", "left")
    return corpus.label_distribution(docs.select(F.col("quality").cast("string").alias("category")))


@query("""SELECT doc_id, lang, text FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels)""")
def row_lookup(spark, folder):
    docs = read_table(spark, folder, "documents", "doc_id", "lang", "text")
    return corpus.rows_at(docs, "doc_id", read_table(spark, folder, "labels", "doc_id"))


@query("SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 10")
def preview(spark, folder):
    return corpus.preview(read_table(spark, folder, "documents", "doc_id", "lang", "text"),
                          10, "doc_id")


@query("SELECT DISTINCT lang AS category FROM documents")
def label_set(spark, folder):
    return corpus.label_set(read_table(spark, folder, "documents",
                                       "lang").withColumnRenamed("lang", "category"))


@query("SELECT doc_id, lang AS class FROM documents")
def annotation_first(spark, folder):
    docs = read_table(spark, folder, "documents", "doc_id", "lang")
    annotated = docs.withColumn("class", F.array(F.struct(
        F.lit("category").alias("annotatorType"), F.col("lang").alias("result"))))
    return annotated.select("doc_id", corpus.first_result("class").alias("class"))


# ---- text ----------------------------------------------------------------------------

@query(f"SELECT doc_id, {S.clean_sql('text')} AS text FROM documents")
def clean_documents(spark, folder):
    return documents(spark, folder).select("doc_id", clean_text("text").alias("text"))


@query(f"SELECT page_id, {S.html_sql('html')} AS text FROM pages", "html_to_text")
def _html_to_text(spark, folder):
    pages = read_spread(spark, folder, "pages", "page_id", "html")
    return pages.select("page_id", html_to_text("html").alias("text"))


@query(f"SELECT page_id, {S.html_sql('html', keep_scripts=True)} AS text FROM pages",
       "html_with_scripts")
def _html_with_scripts(spark, folder):
    pages = read_spread(spark, folder, "pages", "page_id", "html")
    return pages.select("page_id", html_to_text("html", keep_scripts=True).alias("text"))


@query(f"""SELECT page_id, text, len(string_split(text, ' '))::BIGINT AS n_words
  FROM (SELECT page_id, {S.clean_sql('html')} AS text FROM pages)""")
def clean_pages(spark, folder):
    pages = read_spread(spark, folder, "pages", "page_id", "html")
    return (pages.select("page_id", clean_text("html").alias("text"))
            .withColumn("n_words", long(word_count("text"))))


def _tokens(spark, folder, tokens: Column) -> DataFrame:
    return documents(spark, folder).select("doc_id", tokens.alias("t")).select(
        "doc_id", long(F.size("t")).alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def _tokens_sql(tokens: str) -> str:
    return (f"SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens "
            f"FROM (SELECT doc_id, {tokens} AS t FROM documents)")


@query(_tokens_sql(S.words_sql("text")))
def tokens_word(spark, folder):
    return _tokens(spark, folder, word_tokens("text"))


@query(_tokens_sql("list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"))
def tokens_space(spark, folder):
    return _tokens(spark, folder, space_tokens("text"))


@query(_tokens_sql(S.filterset_sql("text")))
def tokens_filterset(spark, folder):
    return _tokens(spark, folder, filterset_tokens("text"))


# ---- media, OCR, pages ---------------------------------------------------------------

def _named(spark, folder, *columns: str) -> DataFrame:
    ending = pick(S.SUFFIXES)
    name = F.concat(F.lit("scan.v"), F.col("doc_id").cast("string"),
                    F.when(ending == "", "").otherwise(F.concat(F.lit("."), ending)))
    return read_table(spark, folder, "documents", "doc_id", *columns).withColumn("file_name", name)


_NAMED_SQL = f"""named AS (SELECT *, 'scan.v' || doc_id || CASE WHEN ending = '' THEN ''
    ELSE '.' || ending END AS file_name
  FROM (SELECT doc_id, {S.pick_sql(S.SUFFIXES)} AS ending FROM documents)),
routed AS (SELECT doc_id, file_name,
    CASE WHEN split_part(file_name, '.', -1) IN ({S.sql_list(fixed.IMAGE_SUFFIXES)}) THEN 'image'
      WHEN split_part(file_name, '.', -1) IN ({S.sql_list(fixed.PDF_SUFFIXES)}) THEN 'pdf'
      ELSE 'rejected' END AS route FROM named)"""


@query(f"WITH {_NAMED_SQL} SELECT doc_id, file_name, route FROM routed")
def media_route(spark, folder):
    return files.route_media(_named(spark, folder), "file_name")


@query("""SELECT page_id, CASE WHEN list_contains(['png','jpeg','jpg','JPEG','JPG','PNG'], s)
    THEN 'image' WHEN list_contains(['pdf','PDF'], s) THEN 'pdf' ELSE 'rejected' END AS route
  FROM (SELECT page_id, split_part(url, '.', -1) AS s FROM pages)""")
def media_route_pages(spark, folder):
    pages = read_table(spark, folder, "pages", "page_id", "url")
    return files.route_media(pages, "url").select("page_id", "route")


def ocr_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as OCR responses: a PAGE block, then each line and its first word."""
    def block(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("BlockType"), text.alias("Text"))
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.array(
        block("LINE", line), block("WORD", F.split(line, " ", -1)[0])))
    head = F.array(block("PAGE", F.lit(None).cast("string")))
    return documents(spark, folder).select(
        "doc_id", F.lit(1).cast("bigint").alias("page_no"),
        F.concat(head, F.flatten(lines)).alias("Blocks"))


@query("""SELECT doc_id, replace(text, chr(10), ' ') || ' ' AS served_text,
  lower(' ' || replace(text, chr(10), ' ') || ' ') AS training_text FROM documents""")
def ocr_assemble(spark, folder):
    return ocr_responses(spark, folder).select(
        "doc_id", ocr.assemble_lines("Blocks").alias("served_text"),
        ocr.assemble_lines("Blocks", lower=True, lead_space=True).alias("training_text"))


@query("""SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id""")
def first_page(spark, folder):
    turns = read_table(spark, folder, "conversations", "conv_id", "turn", "text")
    return ocr.first_page(turns, "conv_id", "turn", "text")


@query("SELECT conv_id, turn + 1 AS page_no, text FROM conversations WHERE turn + 1 = 1")
def first_page_numbered(spark, folder):
    pages = read_table(spark, folder, "conversations", "conv_id", "turn", "text").select(
        "conv_id", (F.col("turn") + 1).alias("page_no"), "text")
    return ocr.numbered_first_page(pages)


# ---- splits --------------------------------------------------------------------------

@query(f"""SELECT count(*) AS n, count(*) FILTER (NOT t) AS n_train,
  count(*) FILTER (t) AS n_test, count(*) - (count(*) * 3 + 9) // 10 AS n_train_exact,
  (count(*) * 3 + 9) // 10 AS n_test_exact, count(*) * 7 // 10 AS n_seventy
  FROM (SELECT {S.IS_TEST} AS t FROM documents)""")
def split_sizes(spark, folder):
    docs = read_table(spark, folder, "documents", "doc_id")
    marked = splits.exact_hold_out(docs, "doc_id").withColumn("hash_test",
                                                              splits.is_test("doc_id"))
    return marked.agg(
        F.count("*").alias("n"), F.count_if(~F.col("hash_test")).alias("n_train"),
        F.count_if("hash_test").alias("n_test"),
        F.count_if(~F.col("is_test")).alias("n_train_exact"),
        F.count_if("is_test").alias("n_test_exact"),
        F.expr("count(*) * 7 div 10").alias("n_seventy"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY substr(md5('42:' || doc_id), 1, 15), doc_id)
  <= (count(*) OVER () * 3 + 9) // 10 AS is_test FROM documents""")
def exact_split(spark, folder):
    return splits.exact_hold_out(read_table(spark, folder, "documents", "doc_id"), "doc_id")


@query(f"""SELECT doc_id, row_number() OVER (ORDER BY doc_id) > count(*) OVER () * 9 // 10
  AS is_validation FROM documents WHERE NOT ({S.IS_TEST})""")
def validation_tail(spark, folder):
    train, _ = splits.hold_out(read_table(spark, folder, "documents", "doc_id"), "doc_id")
    return splits.validation_tail(train, "doc_id")


@query("SELECT doc_id, md5('1:' || doc_id) AS order_key FROM documents")
def epoch_shuffle(spark, folder):
    return splits.shuffled(read_table(spark, folder, "documents", "doc_id"), "doc_id", epoch=1)


_SPACE_SQL = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


@query(f"""SELECT CASE WHEN substr(md5('0:' || doc_id), 1, 8) < '4ccccccc' THEN 'Test_' ELSE
    'Train_' END || doc_id AS tag, len(w)::BIGINT AS n_words, array_to_string(w, ' ') AS words
  FROM (SELECT doc_id, {_SPACE_SQL.format(S.clean_sql('text'))} AS w FROM documents)""")
def tagged_split(spark, folder):
    prefix = F.when(splits.is_test("doc_id", seed=0), "Test").otherwise("Train")
    tagged = corpus.tag_rows(documents(spark, folder), prefix, "doc_id", clean_text("text"))
    return tagged.select("tag", long(F.size("words")).alias("n_words"),
                         F.array_join("words", " ").alias("words"))


@query(f"""SELECT tag, len(w)::BIGINT AS n_words FROM (
  SELECT 'Train_' || doc_id AS tag, {_SPACE_SQL.format('text')} AS w FROM documents UNION ALL
  SELECT 'Test_' || item_id, {_SPACE_SQL.format('text')} FROM benchmark)""")
def union_tagged(spark, folder):
    train = corpus.tag_rows(documents(spark, folder), "Train", "doc_id", "text")
    test = corpus.tag_rows(read_table(spark, folder, "benchmark", "item_id", "text"),
                           "Test", "item_id", "text")
    return corpus.concat_parts(train, test).select("tag", long(F.size("words")).alias("n_words"))


@query("""SELECT d.doc_id, 'Train_' || d.doc_id AS tag, e.label::BIGINT AS label,
  len(e.embedding)::BIGINT AS n_dims,
  round(sqrt(list_sum(list_transform(e.embedding::DOUBLE[], lambda x: x * x))), 6) AS norm,
  e.vec_id IS NOT NULL AS found FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def vector_lookup(spark, folder):
    tags = read_table(spark, folder, "documents", "doc_id").withColumn(
        "tag", F.concat(F.lit("Train_"), F.col("doc_id").cast("string")))
    found = vectors.vector_lookup(tags, read_table(spark, folder, "embeddings"), "doc_id", "vec_id")
    squares = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0),
                          lambda total, x: total + x * x)
    return found.select("doc_id", "tag", long(F.col("label")).alias("label"),
                        long(F.when(F.col("found"), F.size("embedding"))).alias("n_dims"),
                        F.round(F.sqrt(squares), 6).alias("norm"), "found")


# ---- terms ---------------------------------------------------------------------------

@query(f"WITH {S.WEIGHTS} SELECT term, count(*) AS df FROM counts WHERE NOT is_test GROUP BY term")
def doc_frequency(spark, folder):
    train, _ = splits.hold_out(documents(spark, folder), "doc_id")
    return terms.document_frequency(train, clean_text("text"))


@query(f"WITH {S.WEIGHTS} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM weights")
def tfidf_weights(spark, folder):
    cleaned = cleaned_corpus(spark, folder)
    train, _ = splits.hold_out(cleaned, "doc_id")
    idf = terms.fit_idf(train, "doc_id", "text")
    weights = terms.tfidf_weights(terms.term_counts(cleaned, "doc_id", "text"), "doc_id", idf)
    return weights.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


_TOP_SQL = f"""words AS (SELECT doc_id, unnest({S.filterset_sql('text')}) AS term
  FROM (SELECT doc_id, {S.clean_sql('text')} AS text FROM documents)),
top AS (SELECT term, count(*) AS n,
    row_number() OVER (ORDER BY count(*) DESC, term) AS index FROM words GROUP BY term
  QUALIFY index <= 999)"""


@query(f"WITH {_TOP_SQL} SELECT * FROM top")
def binary_top_terms(spark, folder):
    return terms.top_terms(documents(spark, folder), clean_text("text"))


@query(f"""WITH {_TOP_SQL}, hits AS (SELECT DISTINCT doc_id, index FROM words JOIN top USING (term))
  SELECT d.doc_id, count(index) AS n_hits,
    coalesce(string_agg(index::VARCHAR, ',' ORDER BY index), '') AS indices
  FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id""")
def binary_bag(spark, folder):
    docs = cleaned_corpus(spark, folder)
    top = written(terms.top_terms(docs, "text"), "top-terms")
    return terms.binary_bag(docs, "doc_id", "text", top).select(
        "doc_id", long(F.size("indices")).alias("n_hits"),
        F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"))


@query(f"""WITH {S.WEIGHTS} SELECT (SELECT count(*) FROM clean WHERE NOT is_test) AS n_train,
  (SELECT count(*) FROM clean WHERE is_test) AS n_test, (SELECT count(*) FROM idf) AS n_terms,
  (SELECT count(DISTINCT lang) FROM clean WHERE NOT is_test) AS n_classes""")
def matrix_shapes(spark, folder):
    train, _ = splits.hold_out(documents(spark, folder), "doc_id")
    sizes = read_table(spark, folder, "documents", "doc_id", "lang").agg(
        F.count_if(~splits.is_test("doc_id")).alias("n_train"),
        F.count_if(splits.is_test("doc_id")).alias("n_test"),
        F.count_distinct(F.when(~splits.is_test("doc_id"), F.col("lang"))).alias("n_classes"))
    n_terms = terms.document_frequency(train, clean_text("text")).agg(F.count("*").alias("n_terms"))
    return sizes.unionByName(n_terms, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("n_train", "n_test", "n_terms", "n_classes")])


@query("""SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::DOUBLE AS label_index
  FROM documents""")
def label_index(spark, folder):
    docs = read_table(spark, folder, "documents", "doc_id", "lang")
    return vectors.label_index("lang").fit(docs).transform(docs)


@query("""SELECT doc_id, lang, repeat('0', (i - 1)::INT) || '1' || repeat('0', (k - i)::INT) AS one_hot
  FROM (SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang) AS i,
    (SELECT count(DISTINCT lang) FROM documents) AS k FROM documents)""")
def label_onehot(spark, folder):
    docs = read_table(spark, folder, "documents", "doc_id", "lang")
    coded = vectors.label_one_hot("lang").fit(docs).transform(docs)
    bits = vector_to_array("label_vector").cast("array<int>").cast("array<string>")
    return coded.select("doc_id", "lang", F.array_join(bits, "").alias("one_hot"))


# ---- naive Bayes ---------------------------------------------------------------------

def _bayes(spark: SparkSession, folder: str) -> tuple[bayes.BayesModel, DataFrame]:
    train, test = corpus_parts(spark, folder)
    model = bayes.fit_bayes(train, "doc_id", "text", "lang")
    scored = bayes.score_bayes(model, test, "doc_id", "text", "lang")
    return model, scored.withColumnRenamed("lang", "label")


@query(f"""WITH {S.bayes_sql()} SELECT id AS doc_id, label, prediction, round(score, 6) AS score
  FROM predictions""")
def nb_predict(spark, folder):
    _, scored = _bayes(spark, folder)
    return scored.select("doc_id", "label", "prediction",
                         F.round(F.array_max("scores"), 6).alias("score"))


@query(f"""WITH {S.bayes_sql()} SELECT id AS doc_id, class, round(probability, 6) AS probability
  FROM probabilities""")
def nb_probability(spark, folder):
    _, scored = _bayes(spark, folder)
    pairs = F.arrays_zip(F.col("classes").alias("class"), F.col("probability"))
    return (scored.select("doc_id", F.inline(pairs))
            .select("doc_id", "class", F.round("probability", 6).alias("probability")))


@query(S.report_sql(S.bayes_sql() + """,
pairs AS (SELECT label, prediction FROM predictions)"""))
def nb_report(spark, folder):
    return metrics.classification_report(_bayes(spark, folder)[1])


@query(f"""WITH {S.bayes_sql()} SELECT label, """ + ", ".join(
    f"count(*) FILTER (prediction = '{c}') AS pred_{c}" for c in ("de", "en", "es", "fr"))
    + " FROM predictions GROUP BY label")
def nb_confusion(spark, folder):
    model, scored = _bayes(spark, folder)
    return metrics.confusion_matrix(scored, model.names())


@query(f"""WITH {S.bayes_sql()} SELECT count(*) AS n,
  round(avg((p.label = p.prediction)::INT::DOUBLE), 6) AS accuracy,
  round(avg(-ln(least(greatest(q.probability, 1e-15), 1 - 1e-15))), 6) AS log_loss
  FROM predictions p JOIN probabilities q ON q.id = p.id AND q.class = p.label""")
def nb_evaluate(spark, folder):
    _, scored = _bayes(spark, folder)
    place = F.array_position("classes", F.col("label"))
    own = F.when(place > 0, F.get("probability", place.cast("int") - 1)).otherwise(0.0)
    return metrics.evaluate(scored, own)


@query(f"""WITH {S.bayes_sql("SELECT item_id AS id, NULL AS label, text FROM benchmark")}
  SELECT id AS item_id, prediction, round(score, 6) AS score FROM predictions""")
def nb_raw_texts(spark, folder):
    """Labels for raw, uncleaned and unlabelled texts."""
    train, _ = corpus_parts(spark, folder)
    model = bayes.fit_bayes(train, "doc_id", "text", "lang")
    raw = read_table(spark, folder, "benchmark", "item_id", "text")
    scored = bayes.score_bayes(model, raw, "item_id", "text")
    return scored.select("item_id", "prediction", F.round(F.array_max("scores"), 6).alias("score"))


@query("""WITH means AS (SELECT label, i, avg(v) AS m FROM (
    SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings)
  GROUP BY label, i),
distances AS (SELECT vec_id, m.label, sqrt(sum((v - m) * (v - m))) AS distance FROM (
    SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) e
  JOIN means m USING (i) GROUP BY vec_id, m.label)
SELECT vec_id, e.label::BIGINT AS label, d.label::BIGINT AS prediction,
  round(distance, 6) AS distance FROM distances d JOIN embeddings e USING (vec_id)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, d.label) = 1""")
def centroid_predict(spark, folder):
    points = read_spread(spark, folder, "embeddings", "vec_id", "embedding", "label")
    centroids = vectors.fit_centroids(points, "embedding", "label")
    return vectors.predict_centroids(points, "embedding", centroids).select(
        "vec_id", long(F.col("label")).alias("label"), long(F.col("prediction")).alias("prediction"),
        F.round("distance", 6).alias("distance"))


# ---- gates, labels, flows ------------------------------------------------------------

def stamped(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a phrase, a model label and a probability vector each."""
    p1 = pick(S.LADDER)
    other = (1 - p1) / S.OTHER_CLASSES
    docs = documents(spark, folder).withColumn(
        "text", F.concat("text", F.lit(" "), pick(S.STAMPS)))
    return docs.select(
        "doc_id", F.lower("text").alias("raw_text"), clean_text("text").alias("text"),
        pick(S.LABELS).alias("model_label"), p1.alias("p1"),
        F.array(other, p1, *[other] * (S.OTHER_CLASSES - 1)).alias("probability"))


def _stamped_ids(spark, folder) -> DataFrame:
    """The stamped columns that need no text."""
    p1 = pick(S.LADDER)
    other = (1 - p1) / S.OTHER_CLASSES
    return read_table(spark, folder, "documents", "doc_id").select(
        "doc_id", pick(S.LABELS).alias("model_label"), p1.alias("p1"),
        F.array(other, p1, *[other] * (S.OTHER_CLASSES - 1)).alias("probability"))


@query(f"WITH {S.STAMPED} SELECT doc_id, p1, gate FROM decided")
def confidence_compat(spark, folder):
    return _stamped_ids(spark, folder).select(
        "doc_id", "p1", rules.gate_compat(F.col("probability")).alias("gate"))


@query(f"WITH {S.STAMPED} SELECT doc_id, p1, gate_general, gate_utility FROM decided")
def confidence_fixed(spark, folder):
    return _stamped_ids(spark, folder).select(
        "doc_id", "p1",
        rules.gate_fixed(F.col("probability"), fixed.GENERAL_THRESHOLD).alias("gate_general"),
        rules.gate_fixed(F.col("probability"), fixed.UTILITY_THRESHOLD).alias("gate_utility"))


@query(f"""WITH {S.bayes_sql()} SELECT p.id AS doc_id,
  CASE WHEN printed_score > 0 THEN 'accept' ELSE 'reject' END AS compat,
  CASE WHEN top > 0.45 THEN 'accept' ELSE 'reject' END AS fixed
  FROM (SELECT id, max(probability) AS top, max(CASE WHEN class = 'en' THEN
      CASE WHEN probability >= 1 OR (probability > 0 AND probability < 1e-4) THEN 1 ELSE 0 END END)
      AS printed_score FROM probabilities GROUP BY id) p""")
def nb_gates(spark, folder):
    """Both gates on fitted probabilities; they are expected to differ widely."""
    _, scored = _bayes(spark, folder)
    return scored.select("doc_id", rules.gate_compat(F.col("probability")).alias("compat"),
                         rules.gate_fixed(F.col("probability"),
                                          fixed.UTILITY_THRESHOLD).alias("fixed"))


@query(f"""WITH {S.STAMPED} SELECT doc_id, label,
  (SELECT {S.GENERAL_NAMES} FROM (SELECT label AS c)) AS general,
  (SELECT {S.IDENTITY_NAMES} FROM (SELECT label AS c)) AS identity FROM decided""")
def display_labels(spark, folder):
    label = F.col("model_label")
    return _stamped_ids(spark, folder).select(
        "doc_id", label.alias("label"),
        rules.display_label(label, fixed.GENERAL_DISPLAY).alias("general"),
        rules.display_label(label, fixed.IDENTITY_DISPLAY).alias("identity"))


@query(f"""WITH {S.STAMPED} SELECT doc_id, label, CASE WHEN label IN ({S.DENIED})
  THEN {S.NONE} ELSE label END AS allowed FROM decided""")
def deny_labels(spark, folder):
    label = F.col("model_label")
    return _stamped_ids(spark, folder).select(
        "doc_id", label.alias("label"),
        rules.deny_labels(label, fixed.IDENTITY_DENIED).alias("allowed"))


def _flow(name: str, text: str = "text") -> None:
    modes = rules.FLOWS[name].modes

    def run(spark, folder):
        df = stamped(spark, folder)
        for mode in modes:
            df = rules.apply_flow(df, name, mode, text, result=mode)
        return df.select("doc_id", *[F.col(f"{m}.{part}").alias(f"{m}_{part}")
                                     for m in modes for part in ("class", "outcome")])

    run.__name__ = f"flow_{name}"
    query(S.FLOW_SQL[name])(run)


for _name in ("general", "utility", "identity"):
    _flow(_name)
for _name in ("embedding_general", "embedding_utility"):
    _flow(_name, "raw_text")


@query(f"""WITH {S.STAMPED}, {_NAMED_SQL}, flows AS (
  SELECT doc_id, CASE WHEN route = 'rejected' THEN 'invalid_type' WHEN gate = 'error' THEN 'error'
    WHEN gate = 'accept' OR gas THEN 'ok' ELSE 'unclassified' END AS outcome
  FROM decided JOIN routed USING (doc_id))
SELECT outcome, CASE outcome WHEN 'ok' THEN 200 WHEN 'invalid_type' THEN 415 ELSE 424 END::INT
  AS status_code, count(*) AS n FROM flows GROUP BY outcome""")
def outcome_summary(spark, folder):
    """Outcomes of the general flow behind the media gate."""
    ending = pick(S.SUFFIXES)
    df = stamped(spark, folder).withColumn("file_name", F.when(
        ending == "", F.concat(F.lit("scan.v"), "doc_id")).otherwise(
        F.concat(F.lit("scan.v"), "doc_id", F.lit("."), ending)))
    df = rules.apply_flow(files.route_media(df, "file_name"), "general", "compat")
    final = rules.outcome(F.col("result.class"), F.col("result.outcome") == "error",
                          F.col("route") == "rejected")
    return (df.select(final.alias("final")).groupBy(
        F.col("final.outcome").alias("outcome"), F.col("final.status_code").alias("status_code"))
        .agg(F.count("*").alias("n")))


# ---- files, models, streams ----------------------------------------------------------

@query("SELECT lang AS category, text FROM documents")
def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "labelled-csv")
    files.write_labelled_csv(documents(spark, folder, "doc_id", "lang", "text"), path,
                             "lang", "text")
    return files.read_labelled_csv(spark, path, header=False)


@query("""SELECT lang AS label, octet_length(encode(text || chr(10))) AS length,
  md5(text || chr(10)) AS digest FROM documents""")
def labelled_tree_scan(spark, folder):
    """Documents written as one file each below their label's folder, then scanned."""
    path = scratch_path(spark, "labelled-tree")
    files.write_labelled_tree(documents(spark, folder, "doc_id", "lang", "text"), path, "lang")
    found = files.read_labelled_tree(spark, path, key="lang")
    return found.select("label", "length", F.md5("content").alias("digest"))


def _ml_bayes(spark, folder) -> tuple[learners.Fitted, DataFrame]:
    train, test = corpus_parts(spark, folder)
    stages = vectors.tfidf_stages(train, "doc_id", table=True)
    return learners.fit_classifier(train, stages, "lang", learners.naive_bayes), test


@query(f"SELECT doc_id, true AS same FROM documents WHERE {S.IS_TEST}")
def model_roundtrip(spark, folder):
    """A stored and reloaded model predicts what the fitted one did."""
    fitted, test = _ml_bayes(spark, folder)
    path = scratch_path(spark, "model")
    learners.save_model(spark, fitted.pipeline, path, "text")
    loaded = learners.load_model(spark, path, "text")
    before = learners.predict(fitted.pipeline, test, "doc_id", "text")
    both = learners.predict(loaded, before.select(
        "doc_id", "text", F.col("prediction").alias("before")), "doc_id", "before")
    return both.select("doc_id", (F.col("before") == F.col("prediction")).alias("same"))


_ALL_DOCS = "SELECT doc_id AS id, lang AS label, text FROM clean"
_STREAM_SQL = f"""WITH {S.bayes_sql(_ALL_DOCS, "ln((count(*) + 1)::DOUBLE / (n + 4))")},
gates AS (SELECT id, max(probability) AS top FROM probabilities GROUP BY id),
final AS (SELECT id AS doc_id, prediction AS model_label, CASE WHEN top > 0.7 THEN prediction
    WHEN regexp_matches(text, 'gas|oil|refill') THEN 'Gas Bills' ELSE {S.NONE} END AS class
  FROM predictions JOIN gates USING (id) JOIN scored USING (id))
SELECT doc_id, model_label, class, CASE WHEN class = {S.NONE} THEN 'unclassified' ELSE 'ok' END
  AS outcome FROM final"""


@query(_STREAM_SQL)
def score_batch(spark, folder):
    """Clean, predict and decide in one plan, with the stored model's pipeline."""
    fitted, _ = _ml_bayes(spark, folder)
    scored = scoring.score(documents(spark, folder), fitted.pipeline, "general", "fixed")
    return scored.select("doc_id", "model_label", "class", "outcome")


@query(_STREAM_SQL)
def score_stream(spark, folder):
    """The same over a file-drop stream, read back from its sink."""
    fitted, _ = _ml_bayes(spark, folder)
    table = read_table(spark, folder, "documents", "doc_id", "text")
    # The table may be one file or a folder of part files: its rows are dropped as files here.
    arrived = scratch_path(spark, "documents-drop")
    table.repartition(spark.sparkContext.defaultParallelism).write.parquet(arrived)
    drop = scoring.open_drop(spark, arrived, table.schema)
    output, columns = scratch_path(spark, "scored"), ["doc_id", "model_label", "class", "outcome"]
    scoring.drain(drop, output, scratch_path(spark, "scored-progress"), lambda batch: scoring.score(
        batch, fitted.pipeline, "general", "fixed").select(*columns))
    return spark.read.parquet(output).select(*columns)


@query(f"""SELECT doc_id, {S.clean_sql("(replace(text, chr(10), ' ') || ' ')")} AS text
  FROM documents""")
def ocr_stream(spark, folder):
    """OCR responses dropped as JSON files, assembled and cleaned as a stream."""
    drop, output = scratch_path(spark, "ocr-drop"), scratch_path(spark, "ocr-text")
    ocr_responses(spark, folder).write.json(drop)
    cleaned = scoring.open_ocr_drop(spark, drop).select("doc_id",
                                                        clean_text("text").alias("text"))
    scoring.drain(cleaned, output, scratch_path(spark, "ocr-progress"))
    return spark.read.schema(cleaned.schema).parquet(output)


# ---- learners without an SQL counterpart ---------------------------------------------

def _tfidf_parts(train: DataFrame, test: DataFrame) -> list[DataFrame]:
    """Sparse TF-IDF vectors of both parts; the vocabulary of the train part stays a table."""
    known = vocabulary.fit_vocabulary(train, "doc_id", "text")
    return [vocabulary.tfidf_vectors(known, part, "doc_id", "text", "lang") for part in (train, test)]


def _tfidf_fit(spark, folder, learner) -> tuple[learners.Fitted, DataFrame]:
    train, test = _tfidf_parts(*corpus_parts(spark, folder))
    return learners.fit_classifier(train, [], "lang", learner), test


def _report(fitted: learners.Fitted, test: DataFrame, label: str = "lang") -> DataFrame:
    predicted = learners.predict(fitted.pipeline, test, label)
    return metrics.classification_report(predicted, label)


@query()
def logreg_report(spark, folder):
    return _report(*_tfidf_fit(spark, folder, learners.logistic_regression))


@query()
def svm_report(spark, folder):
    return _report(*_tfidf_fit(spark, folder, learners.linear_svm))


@query()
def w2v_logreg_report(spark, folder):
    fitted, test = _embedded_fit(*corpus_parts(spark, folder))
    return _report(fitted, test)


def _embedded_fit(train: DataFrame, test: DataFrame) -> tuple[learners.Fitted, DataFrame]:
    """Word vectors are learnt on both parts; labels of the test part are not used."""
    stages = vectors.document_embedding(corpus.concat_parts(train, test))
    return learners.fit_classifier(train, stages, "lang", learners.logistic_regression), test


def _network_fit(train: DataFrame, test: DataFrame) -> tuple[learners.Fitted, DataFrame]:
    stages = vectors.binary_bag_stages(train)
    inputs = len(stages[-1].vocabulary)
    learner = learners.neural_network(inputs)
    return learners.fit_classifier(train, stages, "lang", learner), test


@query()
def mlp_report(spark, folder):
    return _report(*_network_fit(*corpus_parts(spark, folder)))


def _embedding_parts(spark, folder) -> tuple[DataFrame, DataFrame]:
    points = read_spread(spark, folder, "embeddings", "vec_id", "embedding", "label").withColumn(
        "label", F.col("label").cast("string"))
    return splits.hold_out(vectors.embedding_features(points, "embedding"), "vec_id")


@query()
def embedding_logreg_report(spark, folder):
    train, test = _embedding_parts(spark, folder)
    fitted = learners.fit_classifier(train, [], "label", learners.logistic_regression)
    return _report(fitted, test, "label")


@query()
def training_history(spark, folder):
    fitted, _ = _tfidf_fit(spark, folder, learners.logistic_regression)
    return learners.training_history(spark, fitted)


@query()
def model_comparison(spark, folder):
    """Five classifiers on the same split, the same report, the best one marked."""
    train, test = corpus_parts(spark, folder)
    train_terms, test_terms = _tfidf_parts(train, test)
    found = {}
    for name, learner in [("naive_bayes", learners.naive_bayes), ("linear_svm", learners.linear_svm),
                          ("logistic_regression", learners.logistic_regression)]:
        fitted = learners.fit_classifier(train_terms, [], "lang", learner)
        found[name] = learners.predict(fitted.pipeline, test_terms, "lang")
    for name, fit in [("document_embedding", _embedded_fit), ("neural_network", _network_fit)]:
        found[name] = learners.predict(fit(train, test)[0].pipeline, test, "lang")
    return learners.compare_models(found, "lang")
