"""What questions meet must not grow with the rows behind their countries."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from commsight import session
from commsight.operators import entities as E
from commsight.operators import factored, sequence
from commsight.plans import fixtures
from commsight.sources import html as H
from tests.conftest import rows

NATIONS = [(0, "NATION_0", 0), (1, "NATION_1", 1), (2, "NATION_2", 0)]
CUSTOMERS = [(i, f"C{i}", i % 2, None if i == 4 else float(i), ["BUILDING", "MACHINERY", "FURNITURE"][i % 3])
             for i in range(12)] + [(3, "C3", 1, -9.0, "BUILDING")]  # a key that repeats
SUPPLIERS = [(i, f"S{i}", i % 3, float(-i)) for i in range(9)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    for name, data, schema in (
            ("nation", NATIONS, "n_nationkey int, n_name string, n_regionkey int"),
            ("customer", CUSTOMERS, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
            ("supplier", SUPPLIERS, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")):
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def _counting(monkeypatch):
    """Rows of each table that ``propagate_selection`` is given."""
    seen, plain = {}, E.propagate_selection

    def counted(given, *a, **k):
        seen.update({name: t.count() for name, t in given})
        return plain(given, *a, **k)

    monkeypatch.setattr(E, "propagate_selection", counted)
    return seen


def test_propagate_selection_meets_one_row_per_country(spark, tables, monkeypatch):
    seen = _counting(monkeypatch)
    want = set()
    for c in CUSTOMERS:
        mine = [s[3] for s in SUPPLIERS if s[2] == c[2]]
        own = [x[3] for x in CUSTOMERS if x[2] == c[2]]
        want |= {(c[0], len(mine), min(mine), "supplier"), (c[0], len(own), min(x for x in own if x is not None), "customer")}
    got = rows(fixtures.q_propagate_selection(spark, tables), "query_id", "n_rows", "least", "table")
    assert got == sorted(want, key=repr)
    assert seen == {"supplier": 3, "customer": 2}


def test_requests_by_table_meet_one_row_per_country(spark, tables, monkeypatch):
    seen = _counting(monkeypatch)
    sup, even = Counter(s[2] for s in SUPPLIERS), {n[0]: 1 for n in NATIONS if n[2] % 2 == 0}
    cus = Counter(c[2] for c in CUSTOMERS)
    want = set()
    for k, n in {(c[0], c[2]) for c in CUSTOMERS}:
        lists = {0: [("even", even), ("suppliers", sup)], 1: [("suppliers", sup), ("even", even)], 2: [],
                 3: [("suppliers", sup), ("customers", cus), ("even", even)]}[k % 4]
        if lists and n in lists[0][1]:
            want |= {(k, name, f"NATION_{n}", t[n]) for name, t in lists if n in t}
    assert rows(fixtures.q_requests_by_table(spark, tables)) == sorted(want, key=repr)
    assert seen == {"suppliers": 3, "customers": 2, "even": 2, "nothing": 0}


def test_condensed_answers_are_the_grouped_ones(spark):
    sel = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (None, "a"), (3, None)], "query_id long, Country string")
    listing = spark.createDataFrame([("a", "x", "p"), ("a", "x", "q"), ("a", "y", None), ("b", None, "r")],
                                    "Country string, kind string, provider string")
    f = factored.factorise(sel, listing)
    measures = [F.count(F.lit(1)).alias("n"), F.min("provider").alias("first")]
    brief = factored.condense(f, ["kind"], *measures)
    assert brief.blocks.count() == 3
    assert rows(factored.expand(brief), "query_id", "Country", "kind", "n", "first") == rows(
        factored.expand(f).groupBy("query_id", "Country", "kind").agg(*measures))


def test_ranges_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(sequence, "MAX_RANGES", 3, raising=False)
    df = spark.range(200).withColumn("x", F.col("id") % 50)
    assert sequence.ranged(df, [], ["x", "id"], 1).select(sequence._B).distinct().count() <= 3
    got = rows(sequence.ordered_row_number(df, [], ["x", "id"], width="1 rows"), "rn", "x", "id")
    assert got == sorted(((i + 1, *r) for i, r in enumerate(sorted((i % 50, i) for i in range(200)))), key=repr)


def test_spread_goes_by_what_is_read(spark, tmp_path):
    """A join's size is estimated as a product: small tables looked large and
    one task parsed all their pages."""
    for name in ("a", "b"):
        spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 256).alias(name)).coalesce(1).write.parquet(
            f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{x}") for x in "ab")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        plan = session.spread(a.join(b, "id"))._jdf.queryExecution().analyzed().toString()
        assert plan.startswith("Repartition")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        assert not session.spread(a.join(b, "id"))._jdf.queryExecution().analyzed().toString().startswith("Repartition")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_tables_shuffle_no_elements_around_them(spark):
    """Only cells, tables and bodies go into the windows of a page."""
    page = "<div>" * 30 + ('<table id="t"><thead><tr><th>A</th></tr></thead><tbody><tr><td><div>1</div></td></tr></tbody>'
                           "</table>") + "</div>" * 30
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    el = H.html_elements(pages, **H.TABLES)
    assert rows(H.html_table_by_header(el, {"A": "a"}, table_id="t"), "page_id", "row_idx", "a") == [(1, 0, "1")]
    plan = H._cells(el, "t", None, "thead")._jdf.queryExecution().optimizedPlan().toString()
    assert "tag#" in plan and "IN (table,tbody,td,th)" in plan


def test_a_country_is_one_row_of_a_question(spark):
    """However many blocks a country has; their texts are looked up last."""
    from commsight.plans import report

    sel = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "none"), (4, None)], "query_id long, Country string")
    listing = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 7), (None, 8)], "Country string, x int")
    blocks = report.country_blocks(listing, ["x"], ["x"], 2)
    runs, shelf = report.attach_blocks(sel, blocks, "s", lead="L\n")
    assert rows(runs, "query_id", "at", "n") == [(1, 0, 3), (2, 0, 3), (2, 1, 1)]
    heads = spark.createDataFrame([(2, "s", 0, 0, "head"), (5, "s", 0, 0, "alone")],
                                  "query_id long, section string, part int, at long, text string")
    got = report._told(report._joined([heads, runs]), [shelf])
    top = "| x |\n|---|\n"
    a = [f"### a\n{top}| 0 |\n| 1 |", f"{top}| 2 |\n| 3 |", f"{top}| 4 |"]
    first = ["L\n" + a[0], *a[1:]]
    want = [(1, "s", i, t) for i, t in enumerate(first)] + [
        (2, "s", i, t) for i, t in enumerate(["head", *first, f"### b\n{top}| 7 |"])] + [(5, "s", 0, "alone")]
    assert rows(got, "query_id", "section", "block", "text") == sorted(want, key=repr)


def _unhinted(df):
    """Joins of ``df`` that meet questions and leave the sides' sizes to guesses."""
    found, left = [], [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        below = node.children()
        left += [below.apply(i) for i in range(below.size())]
        if node.nodeName() == "Join" and "strategy=" not in node.hint().toString() and "query_id" in node.output().toString():
            found.append(node.simpleString(200))
    return found


def test_no_join_of_a_report_may_broadcast_its_questions(spark, tmp_path, monkeypatch):
    """Their rows compress to a few MB per million, which Spark broadcast."""
    import datetime as dt

    from commsight.operators import joins
    from commsight.plans import report

    plans, plain = [], session.materialize
    for module in (report, E, sequence, joins):
        monkeypatch.setattr(module, "materialize", lambda df, name="table": (plans.extend(_unhinted(df)), plain(df, name))[1],
                            raising=False)
    # (Tables from files: of literal rows the planner knows too much.)
    made = lambda name, rows, schema: plain(spark.createDataFrame(rows, schema), name)
    tables = [("mcc_mnc_table", made("t", [("Peru", "Claro"), ("Chile", "Entel")], "Country string, `Network Operator` string"))]
    countries = made("c", [("PE", "Peru", None, "Republic of Peru in South America"), ("CL", "Chile", None, None)],
                     "alpha_2 string, name string, common_name string, official_name string")
    requests = made("q", [(1, "Peru", ["signal"], None, None, None), (2, "Chile and Peru", ["signal"], True, 20, ["mcc_mnc_table"])],
                    "query_id long, user_query string, test_names array<string>, only_anomalies boolean, horizon int, sql_tables array<string>")
    cards = made("d", [("peru", 0, 0, "DC", "Hub", "Av 1, Peru", "x", None), ("chile", 0, 0, "", "", "", "", "late")],
                 "keyword string, keyword_pos int, card_pos int, Name string, Type string, Address string, Link string, error string")
    meas = made("m", [("PE", "signal", dt.datetime(2024, 1, 20), True)],
                "probe_cc string, test_name string, measurement_start_time timestamp, anomaly boolean")
    fails = made("f", [("CL", "signal", "http 503")], "alpha_2 string, test_name string, reason string")
    share = made("s", [("PE", "os", "a", 0.5)], "country string, metric string, category string, share double")
    rank = made("r", [("PE", 1, "d.pe", "x")], "country string, rank int, domain string, categories string")
    why = made("w", [("PE", "os", "late")], "country string, metric string, reason string")
    out = report.report_rows(requests, tables, countries, "2024-01-31", cards=cards, measurements=meas, metrics=share,
                             ranking=rank, failures=fails, metric_failures=why)
    assert plans + _unhinted(out) == []
    got = {(r.query_id, r.section, r.block): r.text for r in out.collect()}
    assert got[2, "ooni", 1].endswith("Peru / Signal: 100.00% anomalies") and got[2, "ooni", 2].endswith("Chile / Signal: http 503")
    assert got[1, "dc", 0] == "Total data centers: 1" and "failed" not in got[1, "dc", 1].lower()
    plans.clear()
    assert _unhinted(report.table_report_rows(requests.drop("sql_tables"), tables)) + plans == []


def test_a_hot_country_is_told_by_many_tasks(spark, monkeypatch):
    """A task gives out one stack of texts to some of the runs; runs are not
    shuffled block by block, which made questions times blocks rows."""
    from commsight.plans import report

    monkeypatch.setattr(report, "_STACK_BYTES", 50, raising=False)
    monkeypatch.setattr(report, "_READERS", 10, raising=False)
    sel = spark.createDataFrame([(q, "a") for q in range(60)] + [(7, "b")], "query_id long, Country string")
    listing = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 5)], "Country string, x int")
    blocks = report.country_blocks(listing, ["x"], ["x"], 2)  # five texts of "a", of 23 bytes, but 29 for the first
    runs, shelf = report.attach_blocks(sel, blocks, "s")
    out = report._told(report._joined([runs]), [shelf]).withColumn("p", F.spark_partition_id())
    got = out.collect()
    assert sorted((r.query_id, r.block) for r in got) == sorted(
        [(q, i) for q in range(60) for i in range(5)] + [(7, 5)])
    top = "| x |\n|---|\n"
    assert {r.text for r in got if r.block == 4} == {top + "| 8 |\n| 9 |"}
    at = {}
    for r in got:
        at.setdefault(r.p, set()).add(r.text)
    assert max(map(len, at.values())) <= 2 and len(at) > 6


def test_products_of_one_key_are_made_by_many_tasks(spark):
    """Beyond what may be broadcast, a country's whole answer was one task's."""
    from commsight.operators import joins

    many = spark.createDataFrame([(q, "a" if q < 90 else "b") for q in range(100)] + [(1, "a"), (None, "a"), (5, None)],
                                 "query_id long, Country string")
    few = spark.createDataFrame([("a", f"p{i}") for i in range(20)] + [("a", "p3"), ("b", None), (None, "x"), ("c", "y")],
                                "Country string, provider string")
    want = rows(many.join(few, "Country"), "query_id", "Country", "provider")
    for most in (5, 1000):
        got = joins.join_products(many, few, "Country", most)
        assert rows(got, "query_id", "Country", "provider") == want
    tasks = joins.join_products(many, few, "Country", 5).where("Country = 'a'").groupBy(F.spark_partition_id()).count()
    assert tasks.count() > 4 and tasks.agg(F.max("count")).first()[0] < len(want) / 2
