import pytest
from pyspark.sql import functions as F

from doctriage.functions import fixed
from doctriage.operators import rules


def result(spark, flow, mode, text, label, p1=0.5, top=0.1):
    df = spark.createDataFrame([(text, label, [0.0, p1, top])],
                               "text string, model_label string, probability array<double>")
    return rules.apply_flow(df, flow, mode).select("result.*").first()


@pytest.mark.parametrize("p, gate", [
    (1.0, "accept"), (0.99999, "reject"), (0.5, "reject"), (1e-4, "reject"), (9.9e-5, "accept"),
    (1.5e-7, "accept"), (2e-5, "error"), (0.0, "reject"), (1e-5, "error"), (3e-300, "error"),
    (1.1e-5, "accept"), (None, "error")])
def test_compat_gate(spark, p, gate):
    df = spark.createDataFrame([([0.0, p],)], "p array<double>")
    assert df.select(rules.gate_compat(F.col("p"))).first()[0] == gate


def test_compat_gate_is_the_printed_number(spark):
    values = [m * 10.0 ** -e for e in range(0, 20) for m in (1, 1.25, 2, 3, 7.5, 9, 9.99)]
    values = [v for v in values if v <= 1]

    def printed(p):
        head = str(p).split(".")[0]
        return ("error" if not head.isdigit() else "accept" if int(head) > 0 else "reject")

    df = spark.createDataFrame([(v, [0.0, v]) for v in values], "v double, p array<double>")
    got = {r[0]: r[1] for r in df.select("v", rules.gate_compat(F.col("p"))).collect()}
    assert got == {v: printed(v) for v in values}


@pytest.mark.parametrize("flow, mode, text, label, p1, expected", [
    ("general", "compat", "refill order", "passport", 0.5, "Gas Bills"),
    ("general", "compat", "x", "drivingLicense", 1.0, "Driving License"),
    ("general", "compat", "x", "voterID", 1.0, "Voter ID"),
    ("general", "compat", "x", "pan", 0.5, fixed.UNCLASSIFIED),
    ("utility", "compat", "boiling point", "passport", 1.0, "gasbill"),
    ("utility", "compat", "telephone dues", "passport", 0.3, "phonebill"),
    ("utility", "compat", "tata docomo", "passport", 0.3, fixed.UNCLASSIFIED),
    ("utility", "fixed", "tata docomo", "passport", 0.3, "phonebill"),
    ("utility", "compat", "bank pass book", "bankPassbook", 0.3, fixed.UNCLASSIFIED),
    ("utility", "fixed", "bank pass book", "bankPassbook", 0.3, "bankPassbook"),
    ("utility", "fixed", "my bank", "bankPassbook", 0.3, "bankPassbook"),
    ("utility", "fixed", "cheque", "pan", 0.3, "bankPassbook"),
    ("utility", "compat", "uses kwh", "pan", 0.3, "electricitybill"),
    ("utility", "compat", "my bank", "bankStatement", 0.3, fixed.UNCLASSIFIED),
    ("utility", "fixed", "my bank", "bankStatement", 0.3, "bankstatement"),
    ("utility", "compat", "statement period", "pan", 0.3, "bankstatement"),
    ("identity", "compat", "x", "phoneBill", 1.0, fixed.UNCLASSIFIED),
    ("identity", "compat", "uidai", "pan", 0.5, "aadhar card"),
    ("identity", "compat", "permanent account number", "pan", 0.5, fixed.UNCLASSIFIED),
    ("identity", "fixed", "permanent account number", "pan", 0.5, "pan card"),
    ("identity", "compat", fixed.AADHAR_PHRASE, "pan", 0.5, fixed.UNCLASSIFIED),
    ("identity", "fixed", fixed.AADHAR_PHRASE, "pan", 0.5, "aadhar card"),
    ("identity", "compat", "uidai gas", "pan", 0.5, fixed.UNCLASSIFIED),
    ("embedding_general", "compat", "refill", "pan", 2e-5, "pan"),
    ("embedding_general", "fixed", "refill", "pan", 0.5, "Gas Bills"),
    ("embedding_general", "fixed", "x", "aadhar", 0.8, "Aadhar Card"),
    ("embedding_utility", "fixed", "telephone", "pan", 0.3, fixed.UNCLASSIFIED),
    ("embedding_utility", "fixed", "transaction", "pan", 0.3, "bankstatement"),
    ("embedding_utility", "fixed", "statement period", "pan", 0.3, fixed.UNCLASSIFIED),
])
def test_flows(spark, flow, mode, text, label, p1, expected):
    row = result(spark, flow, mode, text, label, p1)
    assert row["class"] == expected
    unclassified = expected == fixed.UNCLASSIFIED
    assert row["outcome"] == ("unclassified" if unclassified else "ok")
    assert row["status_code"] == (424 if unclassified else 200)


def test_errors(spark):
    missing = result(spark, "general", "compat", None, "pan", 1.0)
    assert (missing["class"], missing["outcome"], missing["error"]) == (
        None, "error", fixed.EXTRACTION_FAILED)
    assert result(spark, "utility", "compat", "gas", "pan", 2e-5)["outcome"] == "error"
    with pytest.raises(ValueError):
        result(spark, "embedding_utility", "compat", "x", "pan")


def test_rule_table(spark):
    table = rules.rule_table(spark)
    assert {r["flow"] for r in table.select("flow").distinct().collect()} == set(rules.FLOWS)
    assert table.filter("tested_on = 'gate'").count() == len(rules.FLOWS)
