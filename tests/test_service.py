"""Files to final labels, in batch and as a stream of real files."""

import json

import pytest

from doctriage.operators import learners, vectors
from doctriage.plans import catalog
from doctriage.streaming import scoring


@pytest.fixture(scope="module")
def model(spark, folder):
    train, _ = catalog.corpus_parts(spark, folder)
    return learners.fit_classifier(train, vectors.tfidf_stages(train, "doc_id"), "lang",
                                   learners.naive_bayes).pipeline


def response(*lines, second="gas refill", kind="LINE"):
    blocks = [{"BlockType": "PAGE", "Page": 1}]
    blocks += [{"BlockType": kind, "Text": t} for t in lines]
    return json.dumps({"Blocks": blocks + [{"BlockType": "LINE", "Text": second, "Page": 2}]}).encode()


FILES = {"a.pdf": response("Refill order", "no. 1"), "b.Png": response("oil"), "c.png": b"no json",
         "d.jpg": response("telephone dues"), "e.pdf": b"", "f.txt": b"\xff\xfe", "g.PDF": response(),
         "h.jpeg": response("oil", kind="WORD"), "i.png": json.dumps({"Blocks": None}).encode()}
WANT = {"a.pdf": "ok", "b.Png": "invalid_type", "c.png": "error", "e.pdf": "error",
        "f.txt": "invalid_type", "i.png": "error"}


def test_classify_files(spark, model):
    table = spark.createDataFrame([(n, bytearray(c), i) for i, (n, c) in enumerate(FILES.items())],
                                  "file_name string, content binary, ticket int")
    out = {r["file_name"]: r for r in scoring.classify_files(table, model, "utility", "fixed").collect()}
    assert len(out) == len(FILES) and out["d.jpg"]["ticket"] == 3
    assert {n: out[n]["outcome"] for n in WANT} == WANT
    assert out["a.pdf"]["class"] == "gasbill" and out["a.pdf"]["status_code"] == 200
    assert out["b.Png"]["class"] == "Invalid Document" and out["b.Png"]["status_code"] == 415
    assert out["c.png"]["class"] is None and out["c.png"]["model_label"] is None
    # The second page and blocks of words are not read.
    assert out["g.PDF"]["class"] != "gasbill" and out["h.jpeg"]["class"] != "gasbill"
    assert scoring.classify_files(table.limit(0), model, "general").count() == 0


def test_stream_of_files(spark, model, tmp_path):
    """Restarts go on, repeated drops are told, results are there once and split by outcome."""
    drop, out, progress = tmp_path / "drop", str(tmp_path / "out"), str(tmp_path / "progress")
    (drop / "first").mkdir(parents=True)
    for name, content in FILES.items():
        (drop / "first" / name).write_bytes(content)

    def run():
        files = scoring.once(scoring.open_file_drop(spark, str(drop), files_per_batch=4))
        scoring.drain_by_outcome(scoring.classify_files(files, model, "general", "fixed"), out, progress)
        return sorted((r["file_name"], r["outcome"]) for r in spark.read.parquet(out).collect())

    first = run()
    # Spark's reader leaves out files of no bytes.
    assert [n for n, _ in first] == sorted(n for n in FILES if FILES[n])
    assert all(WANT.get(n, o) == o for n, o in first)
    assert run() == first
    (drop / "again").mkdir()
    for name, content in FILES.items():
        (drop / "again" / name).write_bytes(content)
    (drop / "again" / "a.pdf").write_bytes(response("another order"))
    (drop / "again" / "new.pdf").write_bytes(response("oil"))
    second = run()
    assert len(second) == len(first) + 2
    assert [n for n, _ in second].count("a.pdf") == 2 and ("new.pdf", "ok") in second
    split = {p.name for p in (tmp_path / "out").glob("batch=*/outcome=*")}
    assert split >= {"outcome=ok", "outcome=error", "outcome=invalid_type"}
