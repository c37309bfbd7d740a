"""Reports for requests with lists, gaps and failures of their own."""

import datetime as dt

from commsight.operators.aggregates import pivot_by_group
from commsight.operators.factored import expand, factorise, read_factored, write_factored
from commsight.operators.joins import zip_outcomes
from commsight.operators.regions import regions_dim
from commsight.operators.report import render_report
from commsight.plans import report
from commsight.sources import payloads as P
from tests.conftest import rows


def _report(spark, requests, **kw):
    t = lambda col, *v: spark.createDataFrame(list(v), f"Country string, `{col}` string")
    tables = [("mcc_mnc_table", t("Network Operator", ("Peru", "Claro"), ("Chile", "Entel"), ("India", "Jio"))),
              ("traforama_isp_list", t("Providers", ("Peru", "Movistar"), ("Nepal", "WorldLink"))),
              ("mideye_mobile_network_list", t("Operator", ("Peru", "Bitel"), ("Peru", "Movistar")))]
    countries = spark.createDataFrame([("PE", "Peru", None, None), ("CL", "Chile", None, None), ("IN", "India", None, None),
                                       ("NP", "Nepal", None, None)],
                                      "alpha_2 string, name string, common_name string, official_name string")
    req = spark.createDataFrame(requests, "query_id long, user_query string, test_names array<string>, "
                                          "only_anomalies boolean, horizon int, sql_tables array<string>")
    out = report.report_rows(req, tables, countries, dt.date(2024, 1, 31), **kw)
    return {r.query_id: r.report for r in render_report(out).collect()}


def test_table_lists_defaults_regions_and_failures(spark):
    meas = spark.createDataFrame(
        [("PE", "whatsapp", dt.datetime(2024, 1, 5), True), ("PE", "whatsapp", dt.datetime(2023, 12, 1), True),
         ("IN", "whatsapp", dt.datetime(2024, 1, 30), False)],
        "probe_cc string, test_name string, measurement_start_time timestamp, anomaly boolean")
    fails = spark.createDataFrame([("pe", "signal", "http 503"), ("PE", "whatsapp", "beside rows")],
                                  "alpha_2 string, test_name string, reason string")
    cards = spark.createDataFrame(
        [("Peru", 0, i, f"DC {i}", "Colocation", f"Av {i}, Lima, PERU", f"https://dc/{i}") for i in range(7)],
        "keyword string, keyword_pos int, card_pos int, Name string, Type string, Address string, Link string")
    dumps = spark.createDataFrame([("IN", "os", '{"odd":1}')], "country string, metric string, raw string")
    text = _report(spark, [
        (1, "Peru and Chile", ["whatsapp", "signal"], None, None, ["traforama_isp_list"]),
        (2, "Peru", ["whatsapp"], None, 365, None),
        (3, "south asia", ["whatsapp"], True, 30, ["mideye_mobile_network_list", "mcc_mnc_table", "no_such"]),
        (4, "Chile", None, None, None, [])],
        measurements=meas, failures=fails, cards=cards, dumps=dumps, members=regions_dim(spark), block_rows=3)
    # Its own list: no operators, one provider, and Chile is not in that table.
    assert "### Peru: Internet Service Providers\n| provider |\n|---|\n| Movistar |\n" in text[1] + "\n"
    assert "Claro" not in text[1] and "Bitel" not in text[1] and "Chile" not in text[1]
    assert "| Peru | Whatsapp | 1 | 0 |" in text[1]  # 30 days by default
    assert "| Peru | Whatsapp | 2 | 0 |" in text[2]
    assert "**Failed fetches**\n- Peru / Signal: http 503" in text[1] and "| Peru | Signal |" not in text[1]
    assert "Failed" not in text[2]
    # One table over three blocks, whatever the case of keyword and address.
    assert "Total data centers: 7\n\n| Name | Type | Address | Link |\n|---|---|---|---|\n" + "\n".join(
        f"| [DC {i}](https://dc/{i}) | Colocation | Av {i}, Lima, PERU | https://dc/{i} |" for i in range(7)) in text[2]
    assert "Peru" not in text[3] and "No SQL data found." in text[3]  # the first table with rows has no such country
    assert "Total data centers: 0" in text[4] and "No OONI data found." in text[4]


def test_pivot_columns_are_each_groups_own(spark):
    cells = spark.createDataFrame(
        [(1, "t", "a", "Peru", "10", 0.1), (1, "t", "b", "Peru", "90", 0.9), (1, "t", "a", "Chile", "5", 0.1),
         (1, "u", "c", "Chile", "7", None), (2, "t", "a", "India", "1", 0.5), (None, "t", "a", "Fiji", "2", 0.5)],
        "q long, m string, r string, c string, v string, o double")
    got = pivot_by_group(cells, ["q"], "m", "r", "c", "v", "o")
    assert rows(got, "q", "m", "columns", "r", "position", "cells") == [
        (1, "t", ["Chile", "Peru"], "a", 2, ["5", "10"]), (1, "t", ["Chile", "Peru"], "b", 1, ["", "90"]),
        (1, "u", ["Chile", "Peru"], "c", 1, ["7", ""]), (2, "t", ["India"], "a", 1, ["1"]),
        (None, "t", ["Fiji"], "a", 1, ["2"])]


def test_outcomes_tell_failed_from_empty(spark):
    req = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), (None, 1)], "k string, t int")
    res = spark.createDataFrame([("a", 1, 5)], "k string, t int, n int")
    bad = spark.createDataFrame([("a", 1, "late"), ("b", 1, "z"), ("b", 1, "http 500"), (None, 1, None)],
                                "k string, t int, reason string")
    assert rows(zip_outcomes(req, res, bad, ["k", "t"]), "k", "n", "outcome", "reason") == sorted([
        ("a", 5, "rows", None), ("b", None, "failed", "http 500"), ("c", None, "empty", None),
        (None, None, "failed", "unknown")], key=repr)
    assert {r.outcome for r in zip_outcomes(req, res, None, ["k", "t"]).collect()} == {"rows", "empty"}


def test_factors_grow_with_the_sum(spark, tmp_path):
    sel = spark.createDataFrame([(q, c) for q in range(200) for c in ("x", "y")] + [(1, "x"), (2, None), (3, "none")],
                                "query_id long, Country string")
    listing = spark.createDataFrame([(c, f"p{i}") for c in ("x", "y", "z") for i in range(50)], "Country string, p string")
    f = factorise(sel, listing)
    assert write_factored(f, str(tmp_path)) == (400, 100)  # not 20,000
    back = read_factored(spark, str(tmp_path))
    assert {r.n_refs for r in back.blocks.collect()} == {200}
    assert expand(back).count() == 20_000
    assert rows(expand(back, questions=spark.createDataFrame([(7,)], "query_id long"))) == rows(
        listing.where("Country <> 'z'").selectExpr("CAST(7 AS BIGINT) AS query_id", "Country", "p"))


def test_failed_payloads_are_neither_rows_nor_dumps(spark):
    body = '{"success": false, "result": {"top": [{"rank": 1, "domain": "a"}]}}'
    p = spark.createDataFrame([("PE", "domain_popularity", body), ("PE", "os", '{"success": false}'),
                               ("PE", "os", '{"success": true, "result": {"odd": 1}}')],
                              "country string, metric string, body string")
    ok, bad = P.parse_ranking(p)
    assert ok.count() == bad.count() == 0
    assert rows(P.unknown_shape_dump(p), "raw") == [('{"odd":1}',)]
