import datetime as dt
import json

from pyspark.sql import functions as F

from commsight.plans import ingest, report
from commsight.sources import payloads as P
from tests.conftest import rows
from tests.test_html_tables import CARD, ISP_PAGE, MCC_PAGE, MIDEYE_PAGE


def _inputs(spark):
    mcc = spark.createDataFrame([("716", "06", "pe", "Peru", "51", "Claro"), ("716", "10", "pe", "Peru", "51", "Entel"),
                                 ("730", "01", "cl", "Chile", "56", "Entel"), ("310", "410", "us", "United States", "1", "AT&T")],
                                "`Mobile Country Code` string, `Mobile Network Code` string, `ISO Country Code` string, "
                                "Country string, `Country Code` string, `Network Operator` string")
    isp = spark.createDataFrame([("Peru", "Movistar"), ("Atlantis", "Fish Net")], "Country string, Providers string")
    ops = spark.createDataFrame([("Peru", "Bitel", "71615", "BITEL")],
                                "Country string, Operator string, `Network Code` string, `Display Text` string")
    tables = [("mcc_mnc_table", mcc), ("traforama_isp_list", isp), ("mideye_mobile_network_list", ops)]
    reqs = spark.createDataFrame([
        (1, "Tell me everything about Peru", ["whatsapp", "signal"], False, 30),
        (2, "chile and the united states?", ["whatsapp"], True, 30),
        (3, "nothing relevant", ["signal"], False, 30),
    ], "query_id long, user_query string, test_names array<string>, only_anomalies boolean, horizon int")
    countries = spark.createDataFrame([("PE", "Peru", None, None), ("CL", "Chile", None, None),
                                       ("US", "United States", None, "United States of America")],
                                      "alpha_2 string, name string, common_name string, official_name string")
    return tables, reqs, countries


def test_report_end_to_end(spark):
    tables, reqs, countries = _inputs(spark)
    cards = spark.createDataFrame([
        ("peru", 0, 0, "Lima DC", "Colocation", "Av 1, Lima, Peru", "https://dc/1", None),
        ("peru", 0, 1, "Miami DC", "Colocation", "Miami, USA", "https://dc/2", None),
        ("united states", 1, 0, "Miami DC", "Colocation", "Miami, USA", "https://dc/2", None),
        ("united states", 1, 1, "Dup", "Colocation", "x, usa", "https://dc/2", None),
        ("chile", 0, 0, "", "", "", "", "timeout"),
    ], "keyword string, keyword_pos int, card_pos int, Name string, Type string, Address string, Link string, error string")
    meas_body = json.dumps({"results": [
        {"probe_cc": "PE", "test_name": "whatsapp", "measurement_start_time": "2024-01-20T00:00:00Z", "anomaly": True},
        {"probe_cc": "PE", "test_name": "whatsapp", "measurement_start_time": "2024-01-21T00:00:00Z", "anomaly": False},
        {"probe_cc": "PE", "test_name": "whatsapp", "measurement_start_time": "2023-01-21T00:00:00Z", "anomaly": True},
        {"probe_cc": "cl", "test_name": "whatsapp", "measurement_start_time": "2024-01-22T00:00:00Z", "anomaly": True},
        {"probe_cc": "CL", "test_name": "whatsapp", "measurement_start_time": "2024-01-22T00:00:00Z", "anomaly": False},
    ]})
    meas = P.parse_measurements(spark.createDataFrame([(meas_body,)], "body string"))
    metrics = spark.createDataFrame([("PE", "device_type", "mobile", 0.6), ("PE", "device_type", "desktop", 0.4),
                                     ("CL", "device_type", "desktop", 0.7)],
                                    "country string, metric string, category string, share double")
    ranking = spark.createDataFrame([("PE", i, f"d{i}.pe", "x") for i in range(1, 30)],
                                    "country string, rank int, domain string, categories string")
    out = report.report_rows(reqs, tables, countries, dt.date(2024, 1, 31), cards=cards, measurements=meas,
                             metrics=metrics, ranking=ranking)
    text = {r.query_id: r.report for r in report.render_report(out).collect()} \
        if hasattr(report, "render_report") else None
    from commsight.operators.report import render_report

    text = {r.query_id: r.report for r in render_report(out).collect()}
    t1 = text[1]
    assert "### Peru: Mobile Network Operators\n| provider |\n|---|\n| Claro |\n| Entel |" in t1
    assert "### Peru: Internet Service Providers\n| provider |\n|---|\n| Bitel |\n| Movistar |" in t1
    assert "Total data centers: 1" in t1 and "[Lima DC](https://dc/1)" in t1 and "Miami" not in t1
    assert "Total data centers: 1\n\n| Name | Type | Address | Link |\n|---|---|---|---|\n| [Lima DC](https://dc/1) |" in t1
    assert "| Peru | Whatsapp | 1 | 1 |" in t1 and "| Peru | Signal | 0 | 0 |" in t1
    assert "**High-anomaly alerts**\n- Peru / Whatsapp: 50.00% anomalies" in t1
    assert "| Device Type | Peru |\n|---|---|\n| mobile | 60.00% |\n| desktop | 40.00% |" in t1
    assert "Category" not in t1 and "Value" not in t1
    assert t1.count(".pe |") == 20  # top 20 domains
    t2 = text[2]
    assert "| Chile | Whatsapp | 1 | 0 |" in t2 and "| United States | Whatsapp | 0 | 0 |" in t2
    assert "Total data centers: 1" in t2 and "Failed searches: 1" in t2
    assert "**Failed fetches**\n- Chile: timeout" in t2
    assert t2.index("## Telecommunications") < t2.index("## Data Centers") < t2.index("## Communications Tests")
    t3 = text[3]
    assert "No SQL data found." in t3 and "No OONI data found." in t3 and "No Radar data found." in t3


def test_ingest_jobs(spark, tmp_path):
    pages = spark.createDataFrame([(0, "https://x/0", MCC_PAGE)], "page_id long, url string, html string")
    mcc = ingest.mobile_codes(pages)
    assert rows(mcc, "Mobile Country Code", "Country") == [("001", "United States"), ("716", "Peru")]
    ops = ingest.operator_list(spark.createDataFrame([(0, "u", MIDEYE_PAGE)], "page_id long, url string, html string"))
    assert rows(ops, "Country", "Operator") == [("Afghanistan", "AWCC"), ("Afghanistan", "MTN"),
                                                ("Afghanistan", "Salaam"), ("Albania", "Vodafone")]
    isp_html = ISP_PAGE.replace("graf--h3", "graf--h")
    isp = ingest.isp_list(spark.createDataFrame([(0, "u", isp_html)], "page_id long, url string, html string"))
    assert ("Peru", "Claro, Movistar") in rows(isp)
    chk = ingest.store(mcc, str(tmp_path / "mcc"), "mcc_mnc_table", ingest.MCC_EXPECTED_ROWS).first()
    assert (chk.n_rows, chk.status) == (2, "short")
    chk = ingest.store(mcc.limit(0), str(tmp_path / "mcc"), "mcc_mnc_table", 2080).first()
    assert chk.status == "empty" and spark.read.parquet(str(tmp_path / "mcc")).count() == 2


def test_request_plan_and_raw_view(spark):
    tables, reqs, countries = _inputs(spark)
    sel = report.selection_for(reqs, tables)
    assert rows(sel) == [(1, "Peru"), (2, "Chile"), (2, "United States")]
    grid, skipped = report.request_plan(reqs, sel, countries, "2024-01-31")
    assert grid.count() == 4 and skipped.count() == 0
    raw = report.raw_and_filtered(reqs, tables)
    assert rows(raw["traforama_isp_list"], "query_id", "Providers") == [(1, "Movistar")]
    assert F is not None


def test_table_report_and_raw_view(spark, tmp_path):
    from commsight.operators.report import render_report

    tables, reqs, _ = _inputs(spark)
    rows_ = report.table_report_rows(reqs, tables)
    text = {r.query_id: r.report for r in render_report(rows_).collect()}
    t1 = text[1]
    assert t1.startswith("## Executive Summary")
    assert "Total rows: 4 across 1 countries" in t1
    assert "- mcc_mnc_table: 2 rows, 1 countries" in t1
    assert "### mcc_mnc_table: Peru" in t1 and "### traforama_isp_list: Peru" in t1
    assert "| Peru | 1 | 1 | 1 | 3 |" in t1
    assert "No relevant data found." in text[3]
    report.write_raw_tables(reqs, tables, str(tmp_path / "view"))
    raw = spark.read.json(str(tmp_path / "view" / "raw" / "mcc_mnc_table" / "rows"))
    filt = spark.read.json(str(tmp_path / "view" / "filtered" / "mcc_mnc_table" / "rows"))
    assert raw.count() == 4 and filt.count() == 4  # Peru x2 (q1), Chile + United States (q2)
