from pyspark.sql import functions as F

from commsight.functions import (asn_label, last_token, normalize_text, percent_value, status_label,
                                 strip_suffix, strip_text, title_case)


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x")).alias("y")).first()["y"]


def test_strip_text_matches_python_strip(spark):
    samples = ["\t a b  ", " x　", "\x1c y \x1f", "  ", "", "plain"]
    df = spark.createDataFrame([(s,) for s in samples], "x string")
    got = [r["y"] for r in df.select(strip_text("x").alias("y")).collect()]
    assert got == [s.strip() for s in samples]


def test_plain_trim_would_differ(spark):
    # The trap: Spark's trim leaves tabs and no-break spaces.
    v = "\tPeru "
    assert spark.createDataFrame([(v,)], "x string").select(F.trim("x")).first()[0] != "Peru"
    assert _one(spark, strip_text, v) == "Peru"


def test_strip_suffix(spark):
    assert _one(spark, strip_suffix, " Peru - 12 providers - x ") == "Peru"
    assert _one(spark, strip_suffix, "Chile") == "Chile"


def test_last_token(spark):
    for addr, want in [("1 Main St, Austin, USA", "usa"), ("Lima,  Peru ", "peru"),
                       ("no comma here", "no comma here"), ("", ""), ("a, b, ", "")]:
        assert _one(spark, last_token, addr) == want == addr.split(",")[-1].strip().lower()


def test_title_case(spark):
    assert _one(spark, title_case, "web_connectivity") == "Web_Connectivity"
    assert _one(spark, lambda c: title_case(c, replace_sep=" "), "tls_version") == "Tls Version"
    assert _one(spark, F.initcap, "web_connectivity") == "Web_connectivity"  # the trap


def test_labels(spark):
    df = spark.createDataFrame([(True, 13335), (False, None), (None, 7)], "a boolean, asn long")
    got = df.select(status_label("a").alias("s"), asn_label("asn").alias("n")).collect()
    assert [(r.s, r.n) for r in got] == [("Anomaly", "AS 13335"), ("Accessible", "AS "), ("Accessible", "AS 7")]


def test_percent_value(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (None,)], "s double")
    assert [r[0] for r in df.select(percent_value("s")).collect()] == [50.0, 100.0, None]


def test_normalize_text(spark):
    assert _one(spark, normalize_text, "  Côte d'Ivoire -- UNITED_States! ") == "côte d ivoire united states"
