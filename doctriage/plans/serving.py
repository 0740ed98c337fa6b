"""Registered queries of the whole service: files to final labels, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from doctriage.functions import fixed
from doctriage.operators import corpus, learners, vectors
from doctriage.plans import sql as S
from doctriage.plans.catalog import corpus_parts, documents, pick, query
from doctriage.session import scratch_path
from doctriage.streaming import scoring

# The languages stand for the kinds of documents, so that display names and deny lists apply.
KINDS = {"en": "bankStatement", "fr": "aadhar", "de": "pan", "es": "drivingLicense"}


def stored_model(spark, folder) -> learners.TableModel:
    """Naive Bayes on TF-IDF, fitted on the train part, stored and loaded."""
    train, _ = corpus_parts(spark, folder)
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    train = train.withColumn("kind", F.try_element_at(kinds, F.col("lang")))
    stages = vectors.tfidf_stages(train, "doc_id", table=True)
    fitted = learners.fit_classifier(train, stages, "kind", learners.naive_bayes)
    path = scratch_path(spark, "service-model")
    learners.save_model(spark, fitted.pipeline, path, "text")
    return learners.load_model(spark, path, "text")


def files(spark, folder) -> DataFrame:
    """Each document, with a stamped phrase, as a file: a JSON response of two pages."""
    def block(kind: str, text: Column, page: int) -> Column:
        return F.struct(F.lit(kind).alias("BlockType"), text.alias("Text"), F.lit(page).alias("Page"))
    text = F.concat("text", F.lit(" "), pick(S.STAMPS))
    lines = F.transform(F.split(text, "\n", -1), lambda line: block("LINE", line, 1))
    other = F.array(block("PAGE", F.lit(None).cast("string"), 2),
                    block("LINE", F.lit("oil and gas refill on the second page"), 2))
    ending = pick(S.SUFFIXES)
    name = F.concat(F.lit("scan.v"), F.col("doc_id").cast("string"),
                    F.when(ending == "", "").otherwise(F.concat(F.lit("."), ending)))
    response = F.to_json(F.struct(F.concat(lines, other).alias("Blocks")))
    return documents(spark, folder).select("doc_id", name.alias("file_name"),
                                           F.encode(response, "UTF-8").alias("content"))


_NAMES = "CASE prediction " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
_SERVED = f"""SELECT doc_id AS id, lang AS label,
  {S.clean_sql("(replace(" + S.RAW_STAMPED + ", chr(10), ' ') || ' ')")} AS text FROM documents"""
_DECIDED = f"""{S.bayes_sql(_SERVED, "ln((count(*) + 1)::DOUBLE / (n + 4))")},
tops AS (SELECT id, max(probability) AS top FROM probabilities GROUP BY id),
decided AS (SELECT s.id AS doc_id, s.text, {_NAMES} AS label, 'reject' AS gate,
    CASE WHEN top > 0.7 THEN 'accept' ELSE 'reject' END AS gate_general,
    CASE WHEN top > 0.45 THEN 'accept' ELSE 'reject' END AS gate_utility,
    string_split(s.text, ' ') AS tokens, regexp_matches(s.text, 'gas|oil|refill') AS gas
  FROM scored s JOIN predictions p ON p.id = s.id JOIN tops t ON t.id = s.id)"""
_ROUTED = f"""(SELECT *, CASE WHEN ending IN ({S.sql_list(fixed.IMAGE_SUFFIXES)}) THEN 'image'
    WHEN ending IN ({S.sql_list(fixed.PDF_SUFFIXES)}) THEN 'pdf' ELSE 'rejected' END AS route
  FROM (SELECT doc_id, file_name, split_part(file_name, '.', -1) AS ending
    FROM (SELECT doc_id, 'scan.v' || doc_id || CASE WHEN e = '' THEN '' ELSE '.' || e END AS file_name
      FROM (SELECT doc_id, {S.pick_sql(S.SUFFIXES)} AS e FROM documents))))"""


def _service_sql(flow: str) -> str:
    final = S.FLOW_SQL[flow].replace(f"WITH {S.STAMPED}", f"WITH {_DECIDED}")
    invalid = "route = 'rejected'"
    return f"""SELECT f.doc_id, file_name, route,
  CASE WHEN {invalid} THEN '{fixed.INVALID_DOCUMENT}' ELSE fixed_class END AS class,
  CASE WHEN {invalid} THEN 'invalid_type' ELSE fixed_outcome END AS outcome,
  CASE WHEN {invalid} THEN 415 WHEN fixed_outcome = 'ok' THEN 200 ELSE 424 END::INT AS status_code
  FROM ({final}) f JOIN {_ROUTED} r ON r.doc_id = f.doc_id"""


_RESULT = ["doc_id", "file_name", "route", "class", "outcome", "status_code"]


def _service(flow: str) -> None:
    def run(spark, folder):
        return scoring.classify_files(files(spark, folder), stored_model(spark, folder), flow,
                                      "fixed").select(*_RESULT)

    run.__name__ = f"service_{flow}"
    query(_service_sql(flow))(run)


for _flow in ("general", "utility", "identity"):
    _service(_flow)


@query(_service_sql("utility"))
def service_stream(spark, folder):
    """The same over a stream: every file is dropped twice, results are split by outcome."""
    model, table = stored_model(spark, folder), files(spark, folder)
    drop, output = scratch_path(spark, "service-drop"), scratch_path(spark, "service-results")
    corpus.concat_parts(table, table).repartition(
        spark.sparkContext.defaultParallelism).write.parquet(drop)
    stream = scoring.once(scoring.open_drop(spark, drop, table.schema))
    scoring.drain_by_outcome(
        stream, output, scratch_path(spark, "service-progress"),
        lambda batch: scoring.classify_files(batch, model, "utility", "fixed").select(*_RESULT))
    return spark.read.parquet(output).select(*_RESULT)
