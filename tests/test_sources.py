import os

import pytest
from pyspark.sql import functions as F

from doctriage import session
from doctriage.sources import files, ocr, tables


def test_media_gate(spark):
    df = spark.createDataFrame([("a.PDF",), ("b.Png",), ("pdf",), ("c.tar.jpg",), ("d.",)],
                               "name string")
    assert [r["route"] for r in files.route_media(df, "name").collect()] == [
        "pdf", "rejected", "pdf", "image", "rejected"]


def test_ocr_lines(spark):
    blocks = [("PAGE", None), ("LINE", "Ab"), ("WORD", "Ab"), ("LINE", "cd")]
    df = spark.createDataFrame([(1, 1, blocks), (2, 1, [])], ocr.RESPONSE)
    rows = df.select(ocr.assemble_lines("Blocks").alias("s"),
                     ocr.assemble_lines("Blocks", True, True).alias("t")).collect()
    assert [tuple(r) for r in rows] == [("Ab cd ", " ab cd "), ("", " ")]


def test_first_page(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 3, "c")],
                                  "doc long, page_no long, text string")
    assert {r["doc"]: r["text"] for r in ocr.first_page(pages, "doc", "page_no", "text").collect()
            } == {1: "a", 2: "c"}
    assert [r["text"] for r in ocr.numbered_first_page(pages).collect()] == ["a"]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_tree_is_written_as_spark_writes_it(spark, tmp_path, scheme):
    labels = ["en", "", None, "a b", "a/b:c%=d", "\u00e9{[]}^?#*\"'\\\x01\x7f", "en", "..", "<x>"]
    rows = [(name, text) for name in labels for text in ("one\ntwo", "", None, "\u00e9", "one\ntwo")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    own, sparks = f"{scheme}{tmp_path}/own", f"{scheme}{tmp_path}/spark"
    files.write_labelled_tree(df, own, "lang")
    df.write.option("maxRecordsPerFile", 1).partitionBy("lang").text(sparks)

    def found(root):
        read = files.read_labelled_tree(spark, root, key="lang").select("label", "length", "content")
        return sorted((r["label"], r["length"], bytes(r["content"])) for r in read.collect())
    assert found(own) == found(sparks) and len(found(own)) == len(rows)
    # Hadoop's local file system would have written checksums, with processes for their modes.
    assert not [f for _, _, names in os.walk(tmp_path / "own") for f in names if f.endswith(".crc")]


def test_labelled_tree(spark, tmp_path):
    for label, name in [("pan", "1.txt"), ("pan", "2.txt"), ("aadhar", "3.txt")]:
        os.makedirs(tmp_path / label, exist_ok=True)
        (tmp_path / label / name).write_text(name)
    rows = files.read_labelled_tree(spark, str(tmp_path)).select(
        "label", F.decode("content", "UTF-8").alias("text")).collect()
    assert {(r["label"], r["text"]) for r in rows} == {
        ("pan", "1.txt"), ("pan", "2.txt"), ("aadhar", "3.txt")}


def test_labelled_tree_names(spark, tmp_path):
    for name in ["a=b/1.txt", "a=b/deep/er/2.txt", "kind=pan/3.txt", "top.txt"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    for root in [str(tmp_path), f"file://{tmp_path}/"]:
        rows = files.read_labelled_tree(spark, root).select("label", "length").collect()
        assert sorted(map(tuple, rows), key=str) == [
            ("a=b", 1), ("a=b", 1), ("kind=pan", 1), (None, 1)]
    keyed = files.read_labelled_tree(spark, str(tmp_path), key="kind").select("label").collect()
    assert sorted(str(r[0]) for r in keyed) == ["None", "a=b", "a=b", "pan"]


@pytest.mark.parametrize("header", [True, False])
def test_csv(spark, tmp_path, header):
    rows = [("a", 'say "hi", \\ twice\n\nand more'), ("b", ""), (None, "x"), ("c", "tail ")]
    df = spark.createDataFrame(rows, "label string, text string")
    files.write_labelled_csv(df, str(tmp_path / "out"), header=header)
    got = files.read_labelled_csv(spark, str(tmp_path / "out"), header=header)
    assert {(r[0], r[1] or "") for r in got.collect()} == set(rows)


def test_texts(spark):
    assert tables.texts_to_df(spark, "one").collect()[0]["text"] == "one"
    assert tables.texts_to_df(spark, ["a", "b"]).count() == 2


def test_spread_only_when_needed(spark):
    few, many = spark.range(10).coalesce(1), spark.range(0, 1000, 1, 64)
    assert session.spread(few, "id").rdd.getNumPartitions() >= 2
    assert session.spread(many, "id") is many
