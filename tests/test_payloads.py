import json

from commsight.sources import payloads as P
from tests.conftest import rows


def test_parse_measurements_defaults_and_empty(spark):
    body1 = json.dumps({"results": [
        {"probe_cc": "CA", "probe_asn": 812, "measurement_start_time": "2024-01-05T10:00:00Z",
         "test_name": "whatsapp", "anomaly": True},
        {"probe_cc": "CA", "test_name": "whatsapp"},
        {},
    ]})
    df = spark.createDataFrame([("CA", "whatsapp", body1), ("PE", "signal", json.dumps({"results": []})),
                                ("CL", "signal", "{}")], "country string, test string, body string")
    m = P.parse_measurements(df, keep=["country", "test"])
    got = rows(m, "country", "pos", "probe_cc", "asn", "test_name", "anomaly", "status")
    assert got == [("CA", 0, "CA", "AS 812", "whatsapp", True, "Anomaly"),
                   ("CA", 1, "CA", "AS ", "whatsapp", False, "Accessible"),
                   ("CA", 2, "", "AS ", "", False, "Accessible")]
    ts = [r.measurement_start_time for r in m.orderBy("pos").collect()]
    assert str(ts[0]).startswith("2024-01-05") and ts[1] is None


def test_split_ok_rejected_invariant(spark):
    df = spark.createDataFrame([
        (1, 200, '{"success": true, "result": {}}'), (2, 200, '{"success": false, "errors": []}'),
        (3, 200, "not json{"), (4, 503, '{"success": true}'), (5, 200, '{"result": {}}'),
    ], "id long, status int, body string")
    ok, bad = P.split_ok_rejected(df, status="status")
    assert rows(ok, "id") == [(1,)]
    assert rows(bad, "id", "reason") == [(2, "not success"), (3, "invalid json"), (4, "http 503"),
                                         (5, "not success")]
    assert ok.count() + bad.count() == df.count()


def _metric(spark):
    env = lambda result: json.dumps({"success": True, "result": result})
    return spark.createDataFrame([
        ("IN", "device_type", env({"summary_0": [{"name": "mobile", "share": 0.61, "requests": 10},
                                                 {"name": "desktop", "share": 1, "requests": 3},
                                                 {"name": "other"}]})),
        ("IN", "ip_version", env({"summary_0": {"IPv4": "72.5", "IPv6": "27.5"}})),
        ("IN", "os", env({"summary_0": "weird"})),
        ("IN", "http_version", env({"other": 1})),
        ("IN", "domain_popularity", env({"top": [{"rank": 1, "domain": "a.com", "categories": [{"name": "x"},
                                                                                          {"name": "y"}]},
                                                 {"domain": "norank.com"},
                                                 {"rank": 3, "domain": "c.com"}]})),
        ("PE", "domain_popularity", env({"top": [], "top_0": [{"rank": 2, "domain": "b.pe", "categories": []}]})),
        ("CL", "domain_popularity", env({"nothing": True})),
    ], "country string, metric string, body string")


def test_parse_summary_shapes(spark):
    s = P.parse_summary(_metric(spark))
    got = rows(s, "metric", "category", "share", "requests", "shape")
    assert got == sorted([("device_type", "mobile", 0.61, 10, "list"), ("device_type", "desktop", 1.0, 3, "list"),
                          ("device_type", "other", None, 0, "list"), ("ip_version", "IPv4", None, None, "dict"),
                          ("ip_version", "IPv6", None, None, "dict")], key=repr)
    assert {r.category: r.value for r in s.where("shape = 'dict'").collect()} == {"IPv4": "72.5", "IPv6": "27.5"}
    failed = _metric(spark).selectExpr("country", "metric", "replace(body, 'true', 'false') AS body")
    assert P.parse_summary(failed).count() == 0


def test_parse_ranking_and_rejects(spark):
    ok, bad = P.parse_ranking(_metric(spark).where("metric = 'domain_popularity'"))
    assert rows(ok, "country", "rank", "domain", "categories") == [
        ("IN", 1, "a.com", "x, y"), ("IN", 3, "c.com", ""), ("PE", 2, "b.pe", "")]
    assert rows(bad, "country", "reason") == [("IN", "missing rank")]


def test_unknown_shapes_kept(spark):
    u = P.unknown_shape_dump(_metric(spark))
    got = rows(u, "country", "metric", "raw")
    assert got == [("CL", "domain_popularity", '{"nothing":true}'), ("IN", "http_version", '{"other":1}'),
                   ("IN", "os", '"weird"')]


def test_request_grid(spark):
    sel = spark.createDataFrame([(1, "Peru"), (1, "Atlantis")], "query_id long, Country string")
    req = spark.createDataFrame([(1, ["signal", "whatsapp"], 30)], "query_id long, test_names array<string>, horizon int") \
        .selectExpr("*", "DATE'2024-01-31' AS as_of")
    dim = spark.createDataFrame([("PE", "Peru", None, "Republic of Peru")],
                                "alpha_2 string, name string, common_name string, official_name string")
    grid, skipped = P.request_grid(sel, req, dim)
    assert rows(grid, "Country", "alpha_2", "test_name", "date_range") == [
        ("Peru", "PE", "signal", "30d"), ("Peru", "PE", "whatsapp", "30d")]
    assert str(grid.first()["since"]) == "2024-01-01"
    assert rows(skipped) == [("Atlantis",)]
