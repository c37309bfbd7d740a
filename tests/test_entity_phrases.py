"""Overlapping names, regions, long phrases; table lists per request."""

import random

from commsight.operators import entities as E
from commsight.operators.regions import regions_dim
from tests.conftest import rows


def _selected(spark, questions, values, **kw):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(questions)], "query_id long, user_query string")
    v = spark.createDataFrame([(x,) for x in values], "Country string")
    out = {}
    for r in E.match_entities(q, v, **kw).collect():
        out.setdefault(r.query_id, set()).add(r.Country)
    return [out.get(i, set()) for i in range(len(questions))]


def test_names_inside_names_are_not_named(spark):
    values = ["Guinea", "Papua New Guinea", "Guinea-Bissau", "Sudan", "South Sudan", "Niger", "Nigeria", "Dominica",
              "Dominican Republic", None, "", "--"]
    assert _selected(spark, ["ISPs in Papua New Guinea", "South Sudan or Sudan?", "Guinea, Guinea-Bissau", "new guinea",
                             None, "", "the South-Sudan/Niger border"], values) == [
        {"Papua New Guinea"}, {"South Sudan", "Sudan"}, {"Guinea", "Guinea-Bissau"}, {"Guinea"}, set(), set(),
        {"South Sudan", "Niger"}]


def test_spans_are_those_of_a_left_to_right_scan(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abc")
    phrases = {" ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 6]))) for _ in range(25)}
    texts = [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(60)] + ["a " * 5000]
    want = set()
    for i, t in enumerate(texts):
        w, at = t.split(), 0
        while at < len(w):
            best = max((len(p.split()) for p in phrases if w[at:at + len(p.split())] == p.split()), default=0)
            if best:
                want.add((i, at, at + best, " ".join(w[at:at + best])))
            at += best or 1
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, user_query string")
    p = spark.createDataFrame([(x, len(x.split())) for x in phrases], "key string, n_words int")
    assert set(rows(E.phrase_spans(q, p))) == want


def test_regions_expand_at_any_depth(spark):
    values = ["India", "Nepal", "Japan", "Qatar", "Peru", "Iran, Islamic Republic of"]
    aliases = spark.createDataFrame([("Iran", "Iran, Islamic Republic of")], "alias string, canonical string")
    questions = ["carriers for the major countries in South Asia", "Southern Asia and Qatar", "all of Asia", "Gulf states",
                 "South America"]
    got = _selected(spark, questions, values, aliases=aliases, members=regions_dim(spark))
    assert got == [{"India", "Nepal"}, {"India", "Nepal", "Qatar"},
                   {"India", "Nepal", "Japan", "Qatar", "Iran, Islamic Republic of"}, {"Qatar"}, {"Peru"}]
    circle = spark.createDataFrame([("Up", "Down"), ("Down", "Up"), ("Down", "Peru"), ("Up", "Up"), ("x", None)],
                                   "region string, member string")
    assert _selected(spark, ["up", "down", "x"], values, members=circle) == [{"Peru"}, {"Peru"}, set()]


def test_each_request_reads_its_own_tables(spark):
    t = lambda *c: spark.createDataFrame([(x, f"op {x}") for x in c], "Country string, op string")
    tables = [("a", t("Peru", "Chile")), ("b", t("Peru", "Guinea", None)), ("none", t())]
    req = spark.createDataFrame(
        [(1, "Peru and Chile and Guinea", ["none", "b", "a"]), (2, "Peru and Chile", ["a"]), (3, "Guinea", None),
         (4, "Peru", ["none", "c"]), (5, "Guinea", ["b", "b"])], "query_id long, user_query string, sql_tables array<string>")
    routes, unknown = E.request_routes(req, tables)
    assert rows(unknown) == [(4, "c")]
    assert rows(routes.where("first"), "query_id", "table") == [(1, "b"), (2, "a"), (3, "a"), (5, "b")]
    sel = E.selection_by_request(req, tables, routes)
    assert rows(sel) == [(1, "Guinea"), (1, "Peru"), (2, "Chile"), (2, "Peru"), (5, "Guinea")]
    parts = E.propagate_by_request(tables, sel, routes)
    assert rows(parts["a"], "query_id", "op") == [(1, "op Peru"), (2, "op Chile"), (2, "op Peru")]
    assert rows(parts["b"], "query_id", "op") == [(1, "op Guinea"), (1, "op Peru"), (5, "op Guinea")]
    assert rows(parts["none"]) == []
