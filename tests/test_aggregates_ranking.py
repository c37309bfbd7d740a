from pyspark.sql import functions as F

from commsight.operators import aggregates as A
from commsight.operators import ranking as R
from commsight.operators import report as K
from tests.conftest import rows


def _meas(spark):
    data = [("PE", "whatsapp", True)] + [("PE", "whatsapp", False)] * 19 \
        + [("PE", "signal", True)] * 2 + [("PE", "signal", False)] * 18 \
        + [("CL", "signal", None)] * 3
    return spark.createDataFrame(data, "cc string, test string, anomaly boolean")


def test_status_counts_and_invariant(spark):
    c = A.status_counts(_meas(spark), ["cc", "test"])
    assert rows(c) == [("CL", "signal", 0, 3), ("PE", "signal", 2, 18), ("PE", "whatsapp", 1, 19)]
    assert sum(r.anomalies + r.accessible for r in c.collect()) == _meas(spark).count()


def test_alerts_exactly_five_percent_is_not_an_alert(spark):
    c = A.status_counts(_meas(spark), ["cc", "test"])
    got = rows(A.anomaly_alerts(c, 0.05), "cc", "test")
    assert got == [("PE", "signal")]  # 1/20 = 5 % exactly is not over; 2/20 is


def test_rate_of_empty_group_is_null_not_error(spark):
    c = spark.createDataFrame([("X", "t", 0, 0)], "cc string, test string, anomalies long, accessible long")
    assert c.select(A.anomaly_rate()).first()[0] is None
    assert A.anomaly_alerts(c).count() == 0


def test_half_counts(spark):
    c = spark.createDataFrame([("a", 3, 4), ("b", 0, 1)], "k string, anomalies long, accessible long")
    got = rows(A.half_counts(c), "k", "shown_rows", "shown_anomalies", "shown_accessible")
    assert got == [("a", 4, 1, 2), ("b", 1, 0, 1)]


def test_coverage_summary_completeness(spark):
    t = A.tag_sources({
        "mcc": spark.createDataFrame([("Peru",), ("Chile",), ("Peru",)], "Country string"),
        "isp": spark.createDataFrame([("Peru",)], "Country string"),
        "ops": spark.createDataFrame([], "Country string"),
    })
    cov = A.cross_source_coverage(t, ["mcc", "isp", "ops"])
    assert rows(cov, "Country", "mcc", "isp", "ops", "n_sources") == [("Chile", 1, 0, 0, 1), ("Peru", 1, 1, 0, 2)]
    tot = rows(A.source_totals(t), "source", "n_rows", "n_countries")
    assert tot == [("isp", 1, 1), ("mcc", 3, 2)]
    exp = spark.createDataFrame([("mcc", 2080), ("isp", 1), ("ops", 1)], "source string, expected_rows long")
    chk = dict(rows(A.completeness_check(t, exp), "source", "status"))
    assert chk == {"mcc": "short", "isp": "ok", "ops": "empty"}
    summ = A.executive_summary(t)
    assert rows(summ.where(F.col("level") == 3), "n_rows") == [(4,)]


def test_metric_pivot_order(spark):
    m = spark.createDataFrame([
        ("os", "ios", "PE", 0.3), ("os", "android", "PE", 0.7), ("os", "android", "CL", 0.6),
        ("os", "other", "CL", 0.1)], "metric string, category string, country string, share double")
    got = [tuple(r) for r in A.metric_pivot(m, ["PE", "CL"]).collect()]
    assert got == [("os", "android", 0.7, 0.6), ("os", "ios", 0.3, None), ("os", "other", None, 0.1)]


def test_providers_by_country(spark):
    mcc = spark.createDataFrame([("Peru", "Claro"), ("Peru", "Claro"), ("Peru", "")], "Country string, op string")
    isp = spark.createDataFrame([("Peru", "Movistar")], "Country string, Providers string")
    p = A.providers_by_country([("operator", mcc, "Country", "op"), ("isp", isp, "Country", "Providers")])
    assert rows(p) == [("Peru", "isp", "Movistar"), ("Peru", "operator", "Claro")]


def test_dedup_keep_first_errors_and_nulls(spark):
    df = spark.createDataFrame([
        ("iran", 0, 1, "A", "l1", None), ("pakistan", 1, 0, "A2", "l1", None),
        ("iran", 0, 0, "B", "l2", None), ("iran", 0, 2, "N1", None, None), ("iran", 0, 3, "N2", None, None),
        ("x", 2, 0, "", "", "timeout"), ("y", 3, 0, "", "", "timeout"),
    ], "keyword string, keyword_pos int, card_pos int, Name string, Link string, error string")
    got = rows(R.dedup_keep_first(df, ["Link"], ["keyword_pos", "card_pos"]), "Name")
    assert got == [("",), ("",), ("A",), ("B",), ("N1",)]
    once = R.dedup_keep_first(df, ["Link"], ["keyword_pos", "card_pos"])
    assert rows(R.dedup_keep_first(once, ["Link"], ["keyword_pos", "card_pos"])) == rows(once)  # idempotent


def test_top_n_uses_group_limit(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    t = R.top_n(df, ["g"], [F.col("v").desc()], 2, rank_col="rank")
    assert rows(t, "g", "v", "rank") == sorted([(0, 4998, 1), (0, 4995, 2), (1, 4999, 1), (1, 4996, 2),
                                                (2, 4997, 1), (2, 4994, 2)], key=repr)
    assert "WindowGroupLimit" in t._jdf.queryExecution().executedPlan().toString()


def test_every_other_row(spark):
    df = spark.createDataFrame([("PE", i) for i in range(7)] + [("CL", 0)], "cc string, t long")
    assert rows(R.every_other_row(df, ["cc"], ["t"], width=2), "cc", "t") == [
        ("CL", 0), ("PE", 0), ("PE", 2), ("PE", 4), ("PE", 6)]


def test_union_sources_missing_columns(spark):
    a = spark.createDataFrame([("n", "l")], "Name string, Link string")
    b = spark.createDataFrame([("", "", "boom")], "Name string, Link string, error string")
    assert rows(R.union_sources([a, b]), "Name", "error") == [("", "boom"), ("n", None)]


def test_markdown_rows_blocks_and_sections(spark):
    df = spark.createDataFrame([(1, i, f"op|{i}") for i in range(5)], "query_id long, i long, name string")
    md = K.markdown_rows(df, ["query_id"], ["i", "name"], ["i"], block_rows=2, width=10)
    got = {r.block: r.text for r in md.collect()}
    assert set(got) == {0, 1, 2}
    assert got[0] == "| i | name |\n|---|---|\n| 0 | op 0 |\n| 1 | op 1 |"
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    bodies = md.select("query_id", F.lit("sql").alias("section"), "block", "text")
    rep = K.markdown_sections(q, bodies)
    r2 = [r.text for r in rep.where("query_id = 2").orderBy("ord", "block").collect()]
    assert r2[0] == "## Telecommunications and ISP Summary" and r2[1] == "No SQL data found."
    assert len(r2) == 8
    full = K.render_report(rep).where("query_id = 1").first()["report"]
    assert full.index("| 4 | op 4 |") < full.index("## Data Centers")


def test_error_rows_default_empty_sort_and_links(spark):
    from commsight.functions.text import linked_name, percent_text
    from commsight.operators.clean import default_typed_empty

    e = R.error_rows(spark, "iran", "timeout", ["Name", "Type", "Address", "Link"])
    assert rows(e) == [("", "", "", "", "iran", "timeout")]
    empty = default_typed_empty(spark, "Name string, Type string, Address string, Link string")
    assert empty.count() == 0 and empty.columns == ["Name", "Type", "Address", "Link"]
    df = spark.createDataFrame([("peru", "b", "l2"), ("chile", "z", "l1"), ("peru", "a", "l3")],
                               "country string, Name string, Link string")
    assert [tuple(r) for r in R.sort_by_country(df).collect()] == [
        ("chile", "z", "l1"), ("peru", "a", "l3"), ("peru", "b", "l2")]
    got = df.select(linked_name("Name", "Link").alias("x")).orderBy("x").first()["x"]
    assert got == "[a](l3)"
    pct = spark.createDataFrame([(0.61234,), (None,)], "s double").select(percent_text("s").alias("p"))
    assert [r.p for r in pct.collect()] == ["61.23%", None]
