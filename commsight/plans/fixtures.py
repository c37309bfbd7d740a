"""Operators bound to the driver's fixture tables, with their SQL oracles.

Each binding reads whole tables (no id subsets, no row caps) and exercises
one operator (or a short chain) from the inventory.  ``QUERIES`` maps a name
to ``(spark_fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``; the SQL is
what DuckDB runs over the same Parquet files, and both sides alias every
computed column to the same name.

Where an operator needs input the fixtures do not hold (HTML tables, JSON
payloads, model replies), the input text is *derived from table columns* in
the Spark binding, and the oracle computes the expected answer from the same
columns directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commsight.functions.text import normalize_text, percent_text, percent_value, strip_suffix, strip_text, title_case
from commsight.operators import aggregates as A
from commsight.operators import clean as C
from commsight.operators import entities as E
from commsight.operators import joins as J
from commsight.operators import ranking as R
from commsight.operators import report as K
from commsight.operators.models import model_map
from commsight.operators.sequence import forward_fill
from commsight.sources import html as H
from commsight.sources import payloads as P
from commsight.session import spread
from commsight.sources.tables import scan_table

AS_OF = "2024-01-31"
HORIZON = 15
ALERT_THRESHOLD = 0.2
PIVOT_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

# DuckDB spelling of commsight.functions.text.normalize_text.
_NORM = "trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _norm(x: str) -> str:
    return _NORM.format(x=x)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return scan_table(spark, d, name)


# ---------------------------------------------------------------- P3, P4, J1/E3

def q_filter_in(spark, d):
    return C.filter_in(_t(spark, d, "nation"), "n_name", ["NATION_1", "NATION_7", "ATLANTIS"]) \
        .select("n_nationkey", "n_name", "n_regionkey")


SQL_FILTER_IN = """
SELECT n_nationkey, n_name, n_regionkey FROM nation
WHERE n_name IN ('NATION_1', 'NATION_7', 'ATLANTIS')
"""


def q_distinct_values(spark, d):
    return C.distinct_values(_t(spark, d, "customer"), "c_mktsegment", out="value")


SQL_DISTINCT_VALUES = "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL"


def q_semi_first_table(spark, d):
    sel = C.filter_in(_t(spark, d, "nation"), "n_regionkey", [1]).select("n_nationkey")
    return J.semi_join(_t(spark, d, "customer"), sel, "c_nationkey", "n_nationkey") \
        .select("c_custkey", "c_name", "c_nationkey")


SQL_SEMI_FIRST_TABLE = """
SELECT c_custkey, c_name, c_nationkey FROM customer
WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
"""


# ---------------------------------------------------------------- flagship: E1 -> E3 -> A4

def _questions(spark, d) -> DataFrame:
    """One free-text question per customer naming its nation, spelled three ways."""
    c = _t(spark, d, "customer")
    n = _t(spark, d, "nation")
    sep = (F.when(F.col("c_mktsegment") == "BUILDING", F.lit("-"))
           .when(F.col("c_mktsegment") == "MACHINERY", F.lit(" ")).otherwise(F.lit("_")))
    q = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("query_id"),
        F.concat(F.lit("Which providers serve "), F.replace(F.lower("n_name"), F.lit("_"), sep),
                 F.lit(" for the "), F.col("c_mktsegment"), F.lit(" segment?")).alias("user_query"))
    return q


def _with_country(spark, d, name: str, key: str) -> DataFrame:
    t = _t(spark, d, name)
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("__nk"), F.col("n_name").alias("Country"))
    return t.join(n, t[key] == n["__nk"]).drop("__nk")


def q_providers_for_questions(spark, d):
    questions = _questions(spark, d)
    nation = _t(spark, d, "nation").select(F.col("n_name").alias("Country"))
    selection = E.match_entities(questions, nation, "Country", "query_id", "user_query")
    sup = _with_country(spark, d, "supplier", "s_nationkey")
    cus = _with_country(spark, d, "customer", "c_nationkey")
    prov = A.providers_by_country([("supplier", sup, "Country", "s_name"),
                                   ("segment", cus, "Country", "c_mktsegment")])
    # The answer has questions times providers rows: made where the questions
    # lie, by all tasks, not by one task per country.
    return J.join_products(selection, prov, "Country").select("query_id", "Country", "kind", "provider")


SQL_PROVIDERS_FOR_QUESTIONS = f"""
WITH q AS (
  SELECT c.c_custkey AS query_id,
         'Which providers serve ' || replace(lower(n.n_name), '_',
            CASE c.c_mktsegment WHEN 'BUILDING' THEN '-' WHEN 'MACHINERY' THEN ' ' ELSE '_' END)
         || ' for the ' || c.c_mktsegment || ' segment?' AS user_query
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
sel AS (
  SELECT DISTINCT q.query_id, v.n_name AS Country FROM q JOIN nation v
  ON contains(' ' || {_norm('q.user_query')} || ' ', ' ' || {_norm('v.n_name')} || ' ')),
prov AS (
  SELECT DISTINCT n.n_name AS Country, 'supplier' AS kind, s.s_name AS provider
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_name <> ''
  UNION
  SELECT DISTINCT n.n_name, 'segment', c.c_mktsegment
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_mktsegment <> '')
SELECT sel.query_id, sel.Country, prov.kind, prov.provider FROM sel JOIN prov ON sel.Country = prov.Country
"""


# ---------------------------------------------------------------- the same answers, in factors

def _factored(spark, d):
    from commsight.operators.factored import factorise

    nation = _t(spark, d, "nation").select(F.col("n_name").alias("Country"))
    selection = E.match_entities(_questions(spark, d), nation, "Country", "query_id", "user_query")
    prov = A.providers_by_country([("supplier", _with_country(spark, d, "supplier", "s_nationkey"), "Country", "s_name"),
                                   ("segment", _with_country(spark, d, "customer", "c_nationkey"), "Country", "c_mktsegment")])
    return factorise(selection, prov)


def q_provider_blocks(spark, d):
    """A4 in factors: each country's providers once, with how many questions
    refer to them."""
    return _factored(spark, d).blocks.select("Country", "kind", "provider", "n_refs")


SQL_PROVIDER_BLOCKS = """
WITH refs AS (SELECT n_name AS Country, count(*) AS n_refs FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
prov AS (
  SELECT DISTINCT n_name AS Country, 'supplier' AS kind, s_name AS provider FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT DISTINCT n_name, 'segment', c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT Country, kind, provider, n_refs FROM prov JOIN refs USING (Country)
"""


def q_factored_answers(spark, d):
    """A4 in factors, stored and read back: how many providers of each kind a
    reader gets for each question."""
    from commsight.operators.factored import condense, expand, read_factored, write_factored
    from commsight.session import staging_path

    path = staging_path(spark, "factored")
    write_factored(_factored(spark, d), path)
    asked = _t(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    brief = condense(read_factored(spark, path), ["kind"], F.count(F.lit(1)).alias("n"), F.min("provider").alias("first"))
    return expand(brief, questions=asked).select("query_id", "Country", "kind", "n", "first")


SQL_FACTORED_ANSWERS = """
WITH prov AS (
  SELECT DISTINCT n_name AS Country, 'supplier' AS kind, s_name AS provider FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT DISTINCT n_name, 'segment', c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
per AS (SELECT Country, kind, count(*) AS n, min(provider) AS first FROM prov GROUP BY ALL)
SELECT c_custkey AS query_id, Country, kind, n, first FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN per ON Country = n_name
"""


# ---------------------------------------------------------------- E1 on whole documents

def _phrases(spark, d) -> DataFrame:
    """Every benchmark text, and every sentence of one."""
    b = _t(spark, d, "benchmark")
    return b.select(F.col("text").alias("phrase")).unionByName(
        b.select(F.explode(F.split("text", r"[.!?]+")).alias("phrase")))


def q_match_entities(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    phrases = _phrases(spark, d).select(normalize_text("phrase").alias("phrase"))
    return E.match_entities(docs, phrases, "phrase", "doc_id", "text", out="phrase")


def _sql_longest(texts: str, phrases: str) -> str:
    """Leftmost-longest spans (id, s, e, p) of phrases in texts: (id, w) and
    (p, k), words as lists; one span after the other, by recursion."""
    return f"""
hits AS (
  SELECT t.id, t.s, max(len(x.k)) AS n
  FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS s FROM ({texts})) t
  JOIN (SELECT DISTINCT k FROM ({phrases}) WHERE len(k) > 0) x
  ON t.w[t.s] = x.k[1] AND t.w[t.s:t.s + len(x.k) - 1] = x.k GROUP BY t.id, t.s),
walk(id, s, e) AS (
  SELECT id, min(s), arg_min(s + n, s) FROM hits GROUP BY id
  UNION ALL
  SELECT r.id, min(h.s), arg_min(h.s + h.n, h.s) FROM walk r JOIN hits h ON h.id = r.id AND h.s >= r.e GROUP BY r.id, r.e),
spans AS (
  SELECT DISTINCT walk.id, s, e, t.w[s:e - 1] AS k FROM walk JOIN ({texts}) t ON t.id = walk.id)"""


SQL_MATCH_ENTITIES = f"""
WITH RECURSIVE b AS (
  SELECT text AS phrase FROM benchmark
  UNION ALL SELECT unnest(regexp_split_to_array(text, '[.!?]+')) FROM benchmark),
p AS (SELECT DISTINCT string_split({_norm('phrase')}, ' ') AS k FROM b WHERE {_norm('phrase')} <> ''),
d AS (SELECT doc_id AS id, string_split({_norm('text')}, ' ') AS w FROM documents),
{_sql_longest('SELECT id, w FROM d', 'SELECT k FROM p')}
SELECT DISTINCT id AS doc_id, array_to_string(k, ' ') AS phrase FROM spans
"""


# ---------------------------------------------------------------- E1: names inside names, regions

def _nested_names(spark, d) -> DataFrame:
    """Nations, regions, and names made of both in either order."""
    n = _t(spark, d, "nation")
    r = _t(spark, d, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.explode(F.array("n_name", "r_name", F.concat_ws(" ", "n_name", "r_name"), F.concat_ws(
        " ", "r_name", "n_name"))).alias("Country")).distinct()


def _nested_questions(spark, d) -> DataFrame:
    """One question per customer whose names overlap one another."""
    c = _t(spark, d, "customer")
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat_ws(" ", "n_name", "r_name", "n_name")).when(
        F.col("c_custkey") % 3 == 1, F.concat_ws(" ", "r_name", "r_name", "n_name", "r_name")).otherwise(
        F.concat_ws(" and ", "n_name", "r_name"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("query_id"), F.concat(F.lit("Operators in "), text, F.lit("?")).alias("user_query"))


def q_nested_entities(spark, d):
    return E.match_entities(_nested_questions(spark, d), _nested_names(spark, d))


SQL_NESTED_ENTITIES = f"""
WITH RECURSIVE nr AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
v AS (
  SELECT n_name AS v FROM nr UNION SELECT r_name FROM nr UNION SELECT n_name || ' ' || r_name FROM nr
  UNION SELECT r_name || ' ' || n_name FROM nr),
p AS (SELECT v, string_split({_norm('v')}, ' ') AS k FROM v),
q AS (
  SELECT c_custkey AS id, 'Operators in ' || CASE c_custkey % 3 WHEN 0 THEN n_name || ' ' || r_name || ' ' || n_name
    WHEN 1 THEN r_name || ' ' || r_name || ' ' || n_name || ' ' || r_name ELSE n_name || ' and ' || r_name END || '?' AS t
  FROM customer JOIN nr ON c_nationkey = n_nationkey),
d AS (SELECT id, string_split({_norm('t')}, ' ') AS w FROM q),
{_sql_longest('SELECT id, w FROM d', 'SELECT k FROM p')}
SELECT DISTINCT spans.id AS query_id, p.v AS Country FROM spans JOIN p ON p.k = spans.k
"""


def q_region_questions(spark, d):
    """E1 over regions: questions name a region, or one of two halves of the
    world that regions belong to."""
    r = _t(spark, d, "region")
    n = _t(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    half = F.concat(F.lit("Hemisphere "), (F.col("r_regionkey") % 2).cast("string"))
    members = n.select(F.col("r_name").alias("region"), F.col("n_name").alias("member")).unionByName(
        r.select(half.alias("region"), F.col("r_name").alias("member")))
    c = _t(spark, d, "customer")
    asked = F.when(F.col("c_custkey") % 4 == 0, half).when(F.col("c_custkey") % 4 == 1, F.concat_ws(
        " and ", "n_name", "r_name")).otherwise(F.col("r_name"))
    questions = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("query_id"), F.concat(F.lit("Tell me about the "), asked).alias("user_query"))
    return E.match_entities(questions, n.select(F.col("n_name").alias("Country")), members=members)


SQL_REGION_QUESTIONS = """
WITH nr AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT c_custkey, r_regionkey AS k FROM customer JOIN nr ON c_nationkey = n_nationkey)
SELECT c_custkey AS query_id, n_name AS Country FROM q JOIN nr
ON CASE WHEN c_custkey % 4 = 0 THEN q.k % 2 = nr.r_regionkey % 2 ELSE q.k = nr.r_regionkey END
"""


# ---------------------------------------------------------------- S1 + E3: a list of tables per request

def _routed(spark, d):
    """Requests with four kinds of table lists, and the tables: one of them
    empty, one with the nations of even regions only."""
    sup = _with_country(spark, d, "supplier", "s_nationkey").select("Country", F.col("s_name").alias("who"))
    cus = _with_country(spark, d, "customer", "c_nationkey").select("Country", F.col("c_name").alias("who"))
    n = _t(spark, d, "nation")
    even = n.where("n_regionkey % 2 = 0").select(F.col("n_name").alias("Country"), F.lit("even").alias("who"))
    tables = [("suppliers", sup), ("customers", cus), ("even", even), ("nothing", sup.where("false"))]
    kind = F.col("query_id") % 4
    lists = F.when(kind == 0, F.array(F.lit("nothing"), F.lit("even"), F.lit("suppliers"))).when(
        kind == 1, F.array(F.lit("suppliers"), F.lit("even"), F.lit("suppliers"))).when(
        kind == 2, F.array(F.lit("users; --"), F.lit("nothing")))
    return _questions(spark, d).withColumn("sql_tables", lists), tables


def q_requests_by_table(spark, d):
    """Per request, the rows of its own tables for the countries that its
    own first table with rows selects."""
    requests, tables = _routed(spark, d)
    routes, _ = E.request_routes(requests, tables)
    selection = E.selection_by_request(requests, tables, routes)
    # Rows are counted per country first: a request meets one row per country
    # and table, however long the tables are.
    counted = [(name, J.bounded_broadcast(t.groupBy("Country").agg(F.count(F.lit(1)).alias("n")))) for name, t in tables]
    parts = E.propagate_by_request(counted, selection, routes)
    per = [t.groupBy("query_id", "Country").agg(F.sum("n").alias("n_rows")).withColumn("table", F.lit(name))
           for name, t in parts.items()]
    return R.union_sources(per).select("query_id", "table", "Country", "n_rows")


SQL_REQUESTS_BY_TABLE = """
WITH t AS (
  SELECT 'suppliers' AS tab, n_name, count(*) AS n, any_value(n_regionkey) AS rk
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
  UNION ALL SELECT 'customers', n_name, count(*), any_value(n_regionkey)
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
  UNION ALL SELECT 'even', n_name, 1, n_regionkey FROM nation WHERE n_regionkey % 2 = 0),
q AS (SELECT c_custkey AS query_id, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT q.query_id, t.tab AS "table", t.n_name AS Country, t.n AS n_rows FROM q JOIN t USING (n_name)
WHERE CASE query_id % 4
  WHEN 0 THEN t.tab IN ('even', 'suppliers') AND t.rk % 2 = 0
  WHEN 1 THEN t.tab IN ('even', 'suppliers') AND n_name IN (SELECT n_name FROM t WHERE tab = 'suppliers')
  WHEN 3 THEN n_name IN (SELECT n_name FROM t WHERE tab = 'suppliers') ELSE false END
"""


def q_unknown_tables(spark, d):
    """The names in requests that are no table."""
    requests, tables = _routed(spark, d)
    return E.request_routes(requests, tables)[1]


SQL_UNKNOWN_TABLES = """SELECT c_custkey AS query_id, 'users; --' AS "table" FROM customer WHERE c_custkey % 4 = 2"""


# ---------------------------------------------------------------- P15, P17, E3, W4, W5, U1, U2, K3

def q_percent_format(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", percent_value("l_discount", 1).alias("discount_pct"),
                     percent_text(F.col("l_tax"), 2).alias("tax_text"))


SQL_PERCENT_FORMAT = """
SELECT l_orderkey, l_linenumber, round(l_discount * 100.0, 1) AS discount_pct, printf('%.2f%%', l_tax * 100.0) AS tax_text
FROM lineitem
"""


def q_typed_empty(spark, d):
    """A source without results still has its columns, so it can be
    joined and united with the others."""
    from commsight.sources.tables import ISP_LIST_SCHEMA

    sup = _with_country(spark, d, "supplier", "s_nationkey")
    empty = C.default_typed_empty(spark, ISP_LIST_SCHEMA)
    got = sup.select("Country", F.col("s_name").alias("Providers")).unionByName(empty)
    return got.join(empty.select("Country"), "Country", "left_anti").groupBy("Country").agg(
        F.count("Providers").alias("n"))


SQL_TYPED_EMPTY = "SELECT n_name AS Country, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"


def q_propagate_selection(spark, d):
    """The selection of each question applied to two tables."""
    nation = _t(spark, d, "nation").select(F.col("n_name").alias("Country"))
    sel = E.match_entities(_questions(spark, d), nation)
    tables = [("supplier", _with_country(spark, d, "supplier", "s_nationkey").select("Country", "s_acctbal")),
              ("customer", _with_country(spark, d, "customer", "c_nationkey").select("Country", F.col("c_acctbal").alias("s_acctbal")))]
    # Rows are summed up per country first: a question meets one row per country
    # and table, however long the tables are.
    summed = [(name, J.bounded_broadcast(t.groupBy("Country").agg(
        F.count(F.lit(1)).alias("n"), F.min("s_acctbal").alias("least")))) for name, t in tables]
    out = [t.groupBy("query_id").agg(F.sum("n").alias("n_rows"), F.min("least").alias("least")).withColumn(
        "table", F.lit(name)) for name, t in E.propagate_selection(summed, sel).items()]
    return R.union_sources(out)


SQL_PROPAGATE_SELECTION = """
WITH t AS (
  SELECT 'supplier' AS tab, s_nationkey AS k, count(*) AS n, min(s_acctbal) AS least FROM supplier GROUP BY 2
  UNION ALL SELECT 'customer', c_nationkey, count(*), min(c_acctbal) FROM customer GROUP BY 2)
SELECT c_custkey AS query_id, n AS n_rows, least, tab AS "table" FROM customer JOIN t ON c_nationkey = t.k
"""


def q_sort_by_first(spark, d):
    """Each order's place by price, dearest first; orders without status F
    have none and come last."""
    o = _t(spark, d, "orders").select("o_orderkey", F.when(
        F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("price"))
    return R.sort_by_first(o, "price", ["o_orderkey"], position="place", width="1000 rows")


SQL_SORT_BY_FIRST = """
SELECT *, row_number() OVER (ORDER BY price DESC NULLS LAST, o_orderkey) AS place
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price FROM orders)
"""


def q_sort_by_country(spark, d):
    """Customers alphabetically by country, then name."""
    c = _with_country(spark, d, "customer", "c_nationkey").select("Country", "c_name", "c_custkey")
    return R.sort_by_country(c, "Country", ["c_name", "c_custkey"], position="place", width="300 rows")


SQL_SORT_BY_COUNTRY = """
SELECT n_name AS Country, c_name, c_custkey, row_number() OVER (ORDER BY n_name, c_name, c_custkey) AS place
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


def q_union_sources(spark, d):
    """U1 + U2: results of two sources whose columns differ, and a row for
    each nation whose search gave none."""
    sup = _with_country(spark, d, "supplier", "s_nationkey").where("s_acctbal > 5000").select("Country", F.col("s_name").alias("Name"))
    cus = _with_country(spark, d, "customer", "c_nationkey").select("Country", F.col("c_mktsegment").alias("Segment"))
    missing = _t(spark, d, "nation").select(F.col("n_name").alias("Country")).join(sup, "Country", "left_anti")
    failed = R.failed_sources(missing, F.lit("supplier"), F.concat(F.lit("no listing for "), "Country"), ["Name", "Segment"])
    return R.union_sources([sup, cus, failed]).select("Country", "Name", "Segment", "source", "error")


SQL_UNION_SOURCES = """
SELECT n_name AS Country, s_name AS Name, NULL AS Segment, NULL AS source, NULL AS error
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000
UNION ALL SELECT n_name, NULL, c_mktsegment, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_name, '', '', 'supplier', 'no listing for ' || n_name FROM nation
WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
"""


def q_table_payload(spark, d):
    """K3: the raw-table view as files, read back: every row, in the columns
    that the view lists."""
    from commsight.session import staging_path
    from commsight.sources.tables import table_payload

    path = staging_path(spark, "payload")
    table_payload(_t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation", path)
    body = spark.read.text(f"{path}/nation/rows").select(F.from_json("value", "map<string,string>").alias("row"))
    columns = spark.read.json(f"{path}/nation/columns").select(F.posexplode("columns").alias("pos", "column"))
    return body.select(F.posexplode(F.map_entries("row")).alias("at", "cell")).join(
        F.broadcast(columns), F.col("cell.key") == F.col("column")).select(
        F.col("pos").cast("long").alias("pos"), "column", F.col("cell.value").alias("value"))


SQL_TABLE_PAYLOAD = """
SELECT CAST(0 AS BIGINT) AS pos, 'n_nationkey' AS "column", CAST(n_nationkey AS VARCHAR) AS value FROM nation
UNION ALL SELECT 1, 'n_name', n_name FROM nation
UNION ALL SELECT 2, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation
"""


# ---------------------------------------------------------------- E2

def _model_replies(spark, d) -> DataFrame:
    """One model-style reply per region listing its nations, in five shapes."""
    n = _t(spark, d, "nation")
    names = n.groupBy("n_regionkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))),
                    lambda x: x["n_name"]).alias("names"))
    single = F.array_join(F.transform("names", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    double = F.array_join(F.transform("names", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    k = F.col("n_regionkey")
    reply = (F.when(k == 0, F.concat(F.lit("```python\n["), single, F.lit("]\n```")))
             .when(k == 1, F.concat(F.lit("["), double, F.lit("]")))
             .when(k == 2, F.concat(F.lit("```json\n["), double, F.lit("]\n```")))
             .when(k == 3, F.concat(F.lit("("), single, F.lit(")")))
             .otherwise(F.concat(F.lit("The relevant countries are "), F.array_join("names", ", "))))
    return names.select(F.col("n_regionkey").alias("reply_id"), reply.alias("reply"))


def q_parse_model_list(spark, d):
    parsed = E.parse_model_list(_model_replies(spark, d), "reply", out="values")
    return parsed.select("reply_id", F.posexplode_outer("values").alias("pos", "value")) \
        .select("reply_id", F.col("pos").cast("long").alias("pos"), "value")


SQL_PARSE_MODEL_LIST = """
SELECT n_regionkey AS reply_id,
       CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS pos,
       n_name AS value
FROM nation WHERE n_regionkey IN (0, 1, 2)
UNION ALL
SELECT DISTINCT n_regionkey, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM nation WHERE n_regionkey NOT IN (0, 1, 2)
"""


# ---------------------------------------------------------------- P5

def _cells(spark, d, cut: float) -> DataFrame:
    ev = _t(spark, d, "events")
    return ev.select("event_id", "user_id", "ts",
                     F.when(F.col("value") >= cut, F.col("event_type")).otherwise(F.lit("")).alias("cell"))


def q_forward_fill(spark, d):
    ff = forward_fill(_cells(spark, d, 35.0), "cell", ["ts", "event_id"], keys=["user_id"],
                      width="1 day", out="filled")
    return ff.select("event_id", "user_id", "filled")


SQL_FORWARD_FILL = """
SELECT event_id, user_id,
       last_value(NULLIF(cell, '') IGNORE NULLS) OVER (
         PARTITION BY user_id ORDER BY ts, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
FROM (SELECT *, CASE WHEN value >= 35.0 THEN event_type ELSE '' END AS cell FROM events)
"""


def q_forward_fill_global(spark, d):
    ff = forward_fill(_cells(spark, d, 60.0), "cell", ["event_id"], keys=[], width="3000 rows", out="filled")
    return ff.select("event_id", "filled")


SQL_FORWARD_FILL_GLOBAL = """
SELECT event_id,
       last_value(NULLIF(cell, '') IGNORE NULLS) OVER (
         ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
FROM (SELECT *, CASE WHEN value >= 60.0 THEN event_type ELSE '' END AS cell FROM events)
"""


# ---------------------------------------------------------------- S7

def q_pair_heading_body(spark, d):
    conv = _t(spark, d, "conversations")
    return H.pair_heading_body(conv, F.col("role") == "user", F.col("role") == "assistant",
                               keys=["conv_id"], order=["turn"], width="100 rows")


SQL_PAIR_HEADING_BODY = """
WITH q AS (
  SELECT conv_id, turn, role, text,
         lag(role) OVER w AS prole, lag(text) OVER w AS ptext
  FROM conversations WHERE role IN ('user', 'assistant')
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (
  SELECT *, regexp_replace(split_part(regexp_replace(ptext, '^\\s+|\\s+$', '', 'g'), ' - ', 1),
                           '^\\s+|\\s+$', '', 'g') AS heading
  FROM q)
SELECT conv_id, turn, heading AS Country, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS Providers
FROM c WHERE role = 'assistant' AND prole = 'user' AND heading <> ''
"""


# ---------------------------------------------------------------- U3

_HOST = r"^[a-z]+://([^/:?#]+)"


def q_dedup_keep_first(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.regexp_extract("url", _HOST, 1).alias("host"), "url")
    return R.dedup_keep_first(p, ["host"], ["page_id"])


SQL_DEDUP_KEEP_FIRST = f"""
SELECT page_id, host, url FROM (
  SELECT page_id, regexp_extract(url, '{_HOST}', 1) AS host, url,
         row_number() OVER (PARTITION BY regexp_extract(url, '{_HOST}', 1) ORDER BY page_id) AS rn
  FROM pages) WHERE rn = 1
"""


# ---------------------------------------------------------------- P10, A1, A2, A3, W1

def _recent_counts(spark, d) -> DataFrame:
    ev = C.horizon_filter(_t(spark, d, "events"), "ts", HORIZON, AS_OF)
    return A.status_counts(ev, ["user_id"], F.col("event_type") == "error")


_SQL_COUNTS = """
SELECT user_id,
       count(*) FILTER (WHERE event_type = 'error') AS anomalies,
       count(*) FILTER (WHERE event_type <> 'error') AS accessible
FROM events
WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00'
GROUP BY user_id
"""


def q_status_counts(spark, d):
    return _recent_counts(spark, d)


SQL_STATUS_COUNTS = _SQL_COUNTS


def q_anomaly_alerts(spark, d):
    return A.anomaly_alerts(_recent_counts(spark, d), ALERT_THRESHOLD)


SQL_ANOMALY_ALERTS = f"""
SELECT * FROM (
  SELECT *, CAST(anomalies AS DOUBLE) / (anomalies + accessible) AS anomaly_rate FROM ({_SQL_COUNTS}))
WHERE anomaly_rate > {ALERT_THRESHOLD}
"""


def q_half_counts(spark, d):
    return A.half_counts(_recent_counts(spark, d))


SQL_HALF_COUNTS = f"""
SELECT *, CAST(ceil((anomalies + accessible) / 2.0) AS BIGINT) AS shown_rows,
       CAST(floor(anomalies / 2.0) AS BIGINT) AS shown_anomalies,
       CAST(ceil(accessible / 2.0) AS BIGINT) AS shown_accessible
FROM ({_SQL_COUNTS})
"""


def q_every_other_row(spark, d):
    ev = _t(spark, d, "events").select("event_id", "user_id", "ts")
    return R.every_other_row(ev, ["user_id"], ["ts", "event_id"], width="4000 rows", keep_rn="rn") \
        .select("event_id", "user_id", "rn")


SQL_EVERY_OTHER_ROW = """
SELECT event_id, user_id, rn FROM (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
WHERE (rn - 1) % 2 = 0
"""


# ---------------------------------------------------------------- A7 + W4

def _segment_shares(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    n = _t(spark, d, "nation")
    r = _t(spark, d, "region")
    cr = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    per = cr.groupBy("r_regionkey", "r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    tot = cr.groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("total"))
    return per.join(tot, "r_regionkey").select(
        "r_regionkey", F.col("r_name").alias("country"), F.col("c_mktsegment").alias("category"),
        (F.col("n") / F.col("total")).alias("share"), F.col("n").alias("requests"))


_SQL_SHARES = """
WITH cr AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
per AS (SELECT r_regionkey, r_name, c_mktsegment, count(*) AS n FROM cr GROUP BY ALL),
tot AS (SELECT r_regionkey, count(*) AS total FROM cr GROUP BY ALL)
SELECT per.r_regionkey, r_name AS country, c_mktsegment AS category, CAST(n AS DOUBLE) / total AS share, n AS requests
FROM per JOIN tot USING (r_regionkey)
"""


def q_metric_pivot(spark, d):
    m = _segment_shares(spark, d).withColumn("metric", F.lit("segment"))
    return A.metric_pivot(m, PIVOT_REGIONS)


SQL_METRIC_PIVOT = f"""
SELECT 'segment' AS metric, category,
       {', '.join(f"max(share) FILTER (WHERE country = '{c}') AS \"{c}\"" for c in PIVOT_REGIONS)}
FROM ({_SQL_SHARES}) GROUP BY category
"""


# ---------------------------------------------------------------- A4 + K4

def q_providers_by_country(spark, d):
    sup = _with_country(spark, d, "supplier", "s_nationkey")
    return K.markdown_rows(sup, ["Country"], ["s_suppkey", "s_name"], ["s_suppkey"],
                           block_rows=500, width="40 rows")


SQL_PROVIDERS_BY_COUNTRY = """
WITH s AS (
  SELECT n_name AS Country, s_suppkey, s_name,
         row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS rn
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT Country, CAST((rn - 1) // 500 AS BIGINT) AS block, count(*) AS n_rows,
       '| s_suppkey | s_name |' || chr(10) || '|---|---|' || chr(10)
       || string_agg('| ' || s_suppkey || ' | ' || s_name || ' |', chr(10) ORDER BY rn) AS text
FROM s GROUP BY Country, (rn - 1) // 500
"""


# ---------------------------------------------------------------- S8, S12

def _measurement_payloads(spark, d) -> DataFrame:
    """One response per event: the event's measurement, then one with a blank
    or malformed time and an anomaly that is not a boolean."""
    ev = spread(_t(spark, d, "events"))
    result = F.struct(
        F.col("user_id").cast("string").alias("probe_cc"),
        F.when(F.col("event_type") != "signup", F.col("event_id")).alias("probe_asn"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("measurement_start_time"),
        F.col("event_type").alias("test_name"),
        F.when(F.col("event_type") != "view", F.col("event_type") == "error").alias("anomaly"),
    )
    return ev.select("event_id", F.to_json(F.struct(F.array(result).alias("results"))).alias("body"))


def _mixed_payloads(spark, d) -> DataFrame:
    odd = F.concat(
        F.lit(',{"measurement_start_time":"'), F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.lit("soon")),
        F.lit('","anomaly":'), F.element_at(F.array(*map(F.lit, ('"yes"', '""', "1", "0", "[]", "[0]", "null"))),
                                            (F.col("event_id") % 7 + 1).cast("int")), F.lit("}]}"))
    return _measurement_payloads(spark, d).withColumn("body", F.concat(
        F.substring("body", F.lit(1), F.length("body") - 2), odd))


def q_parse_measurements(spark, d):
    m = P.parse_measurements(_mixed_payloads(spark, d), keep=["event_id"])
    return m.select("event_id", "pos", "probe_cc", "asn", "test_name", "anomaly", "status", "start_text",
                    F.date_format("measurement_start_time", "yyyy-MM-dd HH:mm:ss").alias("started"))


SQL_PARSE_MEASUREMENTS = """
SELECT event_id, 0::BIGINT AS pos, CAST(user_id AS VARCHAR) AS probe_cc,
       CASE WHEN event_type = 'signup' THEN 'AS ' ELSE 'AS ' || event_id END AS asn,
       event_type AS test_name, event_type = 'error' AS anomaly,
       CASE WHEN event_type = 'error' THEN 'Anomaly' ELSE 'Accessible' END AS status,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS start_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started
FROM events
UNION ALL
SELECT event_id, 1, '', 'AS ', '', event_id % 7 IN (0, 2, 5),
       CASE WHEN event_id % 7 IN (0, 2, 5) THEN 'Anomaly' ELSE 'Accessible' END,
       CASE WHEN event_id % 2 = 0 THEN '' ELSE 'soon' END, NULL
FROM events
"""


def q_parse_json(spark, d):
    ev = _t(spark, d, "events")
    return ev.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


SQL_PARSE_JSON = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


def q_split_ok_rejected(spark, d):
    ev = spread(_t(spark, d, "events"))
    body = (F.when(F.col("event_type") == "error", F.lit('{"success": tru'))
            .when(F.col("event_type") == "view", F.lit('{"success": false, "errors": ["quota"]}'))
            .otherwise(F.concat(F.lit('{"success": true, "result": {"n": '), F.col("event_id").cast("string"),
                                F.lit("}}"))))
    tagged = P.tag_ok_rejected(ev.select("event_id", body.alias("body")))
    return tagged.select("event_id", F.col("reason").isNull().alias("accepted"), "reason")


SQL_SPLIT_OK_REJECTED = """
SELECT event_id, event_type NOT IN ('error', 'view') AS accepted,
       CASE event_type WHEN 'error' THEN 'invalid json' WHEN 'view' THEN 'not success' END AS reason
FROM events
"""


# ---------------------------------------------------------------- S9, S10, S11

def q_parse_summary(spark, d):
    s = _segment_shares(spark, d)
    as_list = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.array(F.struct(
        F.col("category").alias("name"), F.col("share").alias("share"), F.col("requests").alias("requests")
    )).alias("summary_0")).alias("result")))
    as_map = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(
        F.create_map(F.col("category"), F.concat(F.col("requests").cast("string"), F.lit(" seen"))).alias("summary_0")
        ).alias("result")))
    payloads = s.select("country", F.lit("segment").alias("metric"),
                        F.when(F.col("r_regionkey") <= 2, as_list).otherwise(as_map).alias("body"))
    failed = payloads.withColumn("body", F.replace("body", F.lit('"success":true'), F.lit('"success":false')))
    return P.parse_summary(payloads.unionAll(failed)).select(
        "country", "category", "share", "requests", "value", "shape")


SQL_PARSE_SUMMARY = f"""
SELECT country, category, CASE WHEN r_regionkey <= 2 THEN share END AS share,
       CASE WHEN r_regionkey <= 2 THEN requests END AS requests,
       CASE WHEN r_regionkey > 2 THEN requests || ' seen' END AS value,
       CASE WHEN r_regionkey <= 2 THEN 'list' ELSE 'dict' END AS shape
FROM ({_SQL_SHARES})
"""


def _ranking_payloads(spark, d) -> DataFrame:
    s = _with_country(spark, d, "supplier", "s_nationkey")
    item = F.struct(
        F.col("s_suppkey").cast("int").alias("rank"),
        F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".example")).alias("domain"),
        F.array(F.struct(F.col("Country").alias("name")), F.struct(F.lit("telecom").alias("name"))).alias("categories"),
    )
    top = F.to_json(F.struct(F.lit(True).alias("success"),
                             F.struct(F.array(item).alias("top")).alias("result")))
    top0 = F.to_json(F.struct(F.lit(True).alias("success"),
                              F.struct(F.array().cast("array<int>").alias("top"),
                                       F.array(item).alias("top_0")).alias("result")))
    return s.select(F.col("Country").alias("country"), F.lit("domain_popularity").alias("metric"),
                    F.when(F.col("s_acctbal") >= 0, top).otherwise(top0).alias("body"))


def q_parse_ranking(spark, d):
    ok, _ = P.parse_ranking(_ranking_payloads(spark, d))
    return ok.select("country", "rank", "domain", "categories")


SQL_PARSE_RANKING = """
SELECT n_name AS country, CAST(s_suppkey AS INTEGER) AS rank,
       lower(replace(s_name, '#', '-')) || '.example' AS domain, n_name || ', telecom' AS categories
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


# ---------------------------------------------------------------- S6: pages

def q_html_links(spark, d):
    el = H.html_elements(_t(spark, d, "pages"), keep_tags=["a"])
    a = el.where(F.col("tag") == "a")
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy("pos")
    return a.select("page_id", F.row_number().over(w).cast("long").alias("link_pos"),
                    F.col("attrs")["href"].alias("href"), "text")


def _decode(x: str) -> str:
    out = x
    for ent, ch in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"),
                    ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        q = ch.replace("'", "''")
        out = f"replace({out}, '{ent}', '{q}')"
    return out


SQL_HTML_LINKS = f"""
WITH l AS (SELECT page_id,
             regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
             regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages),
e AS (SELECT page_id, hrefs, texts, unnest(range(1, len(hrefs) + 1)) AS i FROM l)
SELECT page_id, CAST(i AS BIGINT) AS link_pos, {_decode('hrefs[i]')} AS href,
       trim({_decode('texts[i]')}) AS text
FROM e
"""


def q_html_title(spark, d):
    el = H.html_elements(_t(spark, d, "pages"), keep_tags=["title"])
    t = el.where(F.col("tag") == "title")
    return t.groupBy("page_id").agg(F.min_by("text", "pos").alias("title"))


SQL_HTML_TITLE = f"""
SELECT page_id, trim({_decode("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title FROM pages
WHERE html LIKE '%<title>%'
"""


def _table_pages(spark, d) -> DataFrame:
    s = _with_country(spark, d, "supplier", "s_nationkey")
    r = _t(spark, d, "region")
    n = _t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    s = s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    html = F.concat(
        F.lit('<div class="wrap"><p>Codes<table id="mncmccTable"><thead><tr><th>MCC</th><th>Network</th>'
              '<th>Country</th></tr></thead><tbody><tr><td> '),
        F.col("s_suppkey").cast("string"), F.lit(" </td><td>"), F.col("s_name"),
        F.lit("</td><td>"), F.col("Country"), F.lit("</td></tr><tr></tr><tr><td>00"),
        F.col("s_nationkey").cast("string"), F.lit("<td>\t</td><td>"), F.col("r_name"),
        F.lit("</table></div>"))
    return s.select(F.col("s_suppkey").alias("page_id"), html.alias("html"))


def q_html_table_rows(spark, d):
    el = H.html_elements(_table_pages(spark, d), **H.TABLES)
    rows = H.html_table_rows(el, ["MCC", "Network", "Country"], table_id="mncmccTable")
    return rows.select("page_id", "row_idx", "MCC", "Network", "Country")


SQL_HTML_TABLE_ROWS = """
SELECT s_suppkey AS page_id, CAST(0 AS BIGINT) AS row_idx, CAST(s_suppkey AS VARCHAR) AS MCC,
       s_name AS Network, n_name AS Country
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT s_suppkey, CAST(1 AS BIGINT), '00' || s_nationkey, '', r_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def _headed_pages(spark, d) -> DataFrame:
    """One page per supplier, deep in nested blocks: columns in one of three
    orders, one of them with a column that nobody knows, every fifth row with
    a cell too many."""
    s = _with_country(spark, d, "supplier", "s_nationkey")
    cells = {"MCC": F.col("s_suppkey").cast("string"), "Network": F.col("s_name"), "Country": F.col("Country"),
             "Fax": F.lit("none")}
    kind = F.col("s_suppkey") % 3

    def table(*names):
        return F.concat(
            F.lit('<table id="codes"><thead><tr>' + "".join(f"<th>{n}</th>" for n in names) + "</tr></thead><tbody><tr>"),
            *[F.concat(F.lit("<td>"), cells[n], F.lit("</td>")) for n in names],
            F.when(F.col("s_suppkey") % 5 == 0, F.lit("<td>extra</td>")).otherwise(F.lit("")),
            F.lit("</tr></tbody></table>"))

    body = F.when(kind == 0, table("MCC", "Network", "Country")).when(
        kind == 1, table("Country", "Fax", "MCC", "Network")).otherwise(table("Network", "MCC"))
    depth = (F.col("s_suppkey") % 400).cast("int")
    return s.select(F.col("s_suppkey").alias("page_id"), F.concat(F.repeat(F.lit("<div>"), depth), body).alias("html"))


_HEADED = {"MCC": "mcc", "Network": "network", "Country": "country"}


def q_table_by_header(spark, d):
    """S3 + P1: columns by each page's own header, on deeply nested pages."""
    el = H.html_elements(_headed_pages(spark, d), **H.TABLES)
    return H.html_table_by_header(el, _HEADED, table_id="codes").select("page_id", "row_idx", "mcc", "network", "country")


SQL_TABLE_BY_HEADER = """
SELECT s_suppkey AS page_id, CAST(0 AS BIGINT) AS row_idx, CAST(s_suppkey AS VARCHAR) AS mcc, s_name AS network,
       CASE WHEN s_suppkey % 3 < 2 THEN n_name END AS country
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


def q_cell_rejects(spark, d):
    """S3: the cells of those pages that no column takes, with the reason."""
    el = H.html_elements(_headed_pages(spark, d), **H.TABLES)
    return H.html_cell_rejects(el, _HEADED, table_id="codes").select(
        "page_id", F.col("col_idx").cast("long").alias("col_idx"), "name", "text", "reason")


SQL_CELL_REJECTS = """
SELECT s_suppkey AS page_id, CAST(1 AS BIGINT) AS col_idx, 'Fax' AS name, 'none' AS text, 'unknown header' AS reason
FROM supplier WHERE s_suppkey % 3 = 1
UNION ALL
SELECT s_suppkey, CAST(CASE s_suppkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 2 END AS BIGINT), NULL, 'extra',
       'beyond the header'
FROM supplier WHERE s_suppkey % 5 = 0
"""


def q_table_versions(spark, d):
    """K2: a table is replaced, then a writer dies before it publishes; what
    readers see is the last published version."""
    from commsight.session import staging_path
    from commsight.sources.tables import read_table, write_table

    path = staging_path(spark, "versions")
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    write_table(orders, path)
    write_table(orders.where("o_orderstatus <> 'F'"), path, partition_by=["o_orderstatus"])
    write_table(orders.where("false"), path)
    orders.write.parquet(f"{path}/version=3-dead")  # died before the manifest
    return read_table(spark, path).select("o_orderkey", "o_orderstatus", "o_totalprice")


SQL_TABLE_VERSIONS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'"


# ---------------------------------------------------------------- P7, P2, P8

def _addresses(spark, d) -> DataFrame:
    n = _t(spark, d, "nation")
    r = _t(spark, d, "region")
    k = F.col("n_regionkey")
    tail = (F.when(k == 1, F.lit("USA")).when(k == 2, F.lit(" usa ")).when(k == 3, F.lit("Peru"))
            .otherwise(F.col("r_name")))
    return n.join(r, k == r.r_regionkey).select(
        "n_nationkey", "n_name",
        F.concat(F.lit("Calle "), F.col("n_nationkey").cast("string"), F.lit(", "), F.col("n_name"),
                 F.lit(", "), tail).alias("address"))


_SQL_ADDR = """
SELECT n_nationkey, n_name,
       'Calle ' || n_nationkey || ', ' || n_name || ', ' ||
       CASE n_regionkey WHEN 1 THEN 'USA' WHEN 2 THEN ' usa ' WHEN 3 THEN 'Peru' ELSE r_name END AS address
FROM nation JOIN region ON n_regionkey = r_regionkey
"""


def q_last_token(spark, d):
    a = _addresses(spark, d)
    return a.select("n_nationkey", "address", C.country_key("address", C.ADDRESS_ALIASES).alias("country_key"))


SQL_LAST_TOKEN = f"""
SELECT n_nationkey, address,
       CASE WHEN lower(trim(string_split(address, ',')[-1])) = 'usa' THEN 'united states'
            ELSE lower(trim(string_split(address, ',')[-1])) END AS country_key
FROM ({_SQL_ADDR})
"""


def q_filter_by_country_key(spark, d):
    return C.filter_by_country_key(_addresses(spark, d), "address", "United States")


SQL_FILTER_BY_COUNTRY_KEY = f"""
SELECT * FROM ({_SQL_ADDR}) WHERE lower(trim(string_split(address, ',')[-1])) = 'usa'
"""


# ---------------------------------------------------------------- W2

def q_top_k(spark, d):
    c = _t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return R.top_n(c, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 20, rank_col="rank")


SQL_TOP_K = """
SELECT * FROM (
  SELECT c_nationkey, c_custkey, c_acctbal,
         CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rank
  FROM customer) WHERE rank <= 20
"""


# ---------------------------------------------------------------- J2, J4, S13/J5

def _nation_dim(spark, d) -> DataFrame:
    n = _t(spark, d, "nation")
    return n.select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("alpha_2"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("common_name"),
        F.concat(F.lit("Republic of "), F.col("n_name")).alias("official_name"))


def _probe_names(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    n = _t(spark, d, "nation")
    seg = F.col("c_mktsegment")
    name = (F.when(seg == "BUILDING", F.lower("n_name"))
            .when(seg == "MACHINERY", F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")))
            .when(seg == "HOUSEHOLD", F.concat(F.lit("Republic of "), F.col("n_name")))
            .when(seg == "FURNITURE", F.col("n_name"))
            .otherwise(F.concat(F.lit("Atlantis "), F.col("n_regionkey").cast("string"))))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(name.alias("name")).distinct()


_SQL_PROBES = """
SELECT DISTINCT CASE c_mktsegment WHEN 'BUILDING' THEN lower(n_name)
                                  WHEN 'MACHINERY' THEN 'Nation ' || n_nationkey
                                  WHEN 'HOUSEHOLD' THEN 'Republic of ' || n_name
                                  WHEN 'FURNITURE' THEN n_name
                                  ELSE 'Atlantis ' || n_regionkey END AS name
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
_SQL_DIM = """
SELECT 'N' || n_nationkey AS alpha_2, n_name AS name, 'Nation ' || n_nationkey AS common_name,
       'Republic of ' || n_name AS official_name FROM nation
"""
_SQL_RESOLVED = f"""
WITH p AS ({_SQL_PROBES}), d AS ({_SQL_DIM})
SELECT p.name, COALESCE(
  (SELECT min(alpha_2) FROM d WHERE lower(d.name) = lower(p.name)),
  (SELECT min(alpha_2) FROM d WHERE d.common_name = p.name),
  (SELECT min(alpha_2) FROM d WHERE d.official_name = p.name)) AS alpha_2
FROM p
"""


def q_country_lookup(spark, d):
    return J.country_to_alpha2(_probe_names(spark, d), "name", _nation_dim(spark, d))


SQL_COUNTRY_LOOKUP = _SQL_RESOLVED


def q_unresolved_keys(spark, d):
    return J.unresolved_keys(_probe_names(spark, d), "name", _nation_dim(spark, d))


SQL_UNRESOLVED_KEYS = f"SELECT name FROM ({_SQL_RESOLVED}) WHERE alpha_2 IS NULL"


def q_request_grid(spark, d):
    """One request per region: its nations are the selection, its tests the
    event types seen among that region's users."""
    n = _t(spark, d, "nation")
    sel = n.select(F.col("n_regionkey").cast("long").alias("query_id"), F.col("n_name").alias("Country"))
    ev = _t(spark, d, "events").select("user_id", "event_type")
    cus = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    seen = ev.join(cus, ev.user_id == cus.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    req = seen.groupBy(F.col("n_regionkey").cast("long").alias("query_id")).agg(
        F.array_sort(F.collect_set("event_type")).alias("test_names"),
        F.lit(30).alias("horizon"), F.to_date(F.lit(AS_OF)).alias("as_of"))
    grid, _ = P.request_grid(sel, req, _nation_dim(spark, d))
    return grid.select("query_id", "Country", "alpha_2", "test_name",
                       F.col("since").cast("string").alias("since"),
                       F.col("until").cast("string").alias("until"), "date_range")


SQL_REQUEST_GRID = """
WITH t AS (SELECT DISTINCT n_regionkey AS rk, event_type
           FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT CAST(n_regionkey AS BIGINT) AS query_id, n_name AS Country, 'N' || n_nationkey AS alpha_2,
       t.event_type AS test_name, '2024-01-01' AS since, '2024-01-31' AS until, '30d' AS date_range
FROM nation JOIN t ON t.rk = nation.n_regionkey
"""


# ---------------------------------------------------------------- A5, A6, A9

def _tagged(spark, d) -> DataFrame:
    return A.tag_sources({
        "customer": _with_country(spark, d, "customer", "c_nationkey"),
        "supplier": _with_country(spark, d, "supplier", "s_nationkey"),
    })


_SQL_TAGGED = """
SELECT 'customer' AS source, n_name AS Country FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT 'supplier', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


def q_coverage(spark, d):
    return A.cross_source_coverage(_tagged(spark, d), ["customer", "supplier"])


SQL_COVERAGE = f"""
SELECT Country,
       CAST(count(DISTINCT source) FILTER (WHERE source = 'customer') AS BIGINT) AS customer,
       CAST(count(DISTINCT source) FILTER (WHERE source = 'supplier') AS BIGINT) AS supplier,
       CAST(count(DISTINCT source) AS BIGINT) AS n_sources
FROM ({_SQL_TAGGED}) GROUP BY Country
"""


def q_source_totals(spark, d):
    return A.source_totals(_tagged(spark, d))


SQL_SOURCE_TOTALS = f"""
SELECT source, count(*) AS n_rows, count(DISTINCT Country) AS n_countries FROM ({_SQL_TAGGED}) GROUP BY source
"""


def q_executive_summary(spark, d):
    s = A.executive_summary(_tagged(spark, d))
    return s.withColumn("level", F.col("level").cast("long"))


SQL_EXECUTIVE_SUMMARY = f"""
SELECT Country, source, count(*) AS n_rows, CAST(GROUPING(Country, source) AS BIGINT) AS level
FROM ({_SQL_TAGGED}) GROUP BY ROLLUP (Country, source)
"""


# ---------------------------------------------------------------- P14, P9, P12

def q_title_case(spark, d):
    p = _t(spark, d, "part").select(
        F.concat(F.lower("p_type"), F.lit("_"), F.lower("p_brand")).alias("raw")).distinct()
    return p.select("raw", title_case("raw").alias("title"), title_case("raw", replace_sep=" ").alias("spaced"))


_SQL_TITLE_PART = "list_transform(string_split(raw, '_'), lambda s: upper(s[1]) || lower(s[2:]))"
SQL_TITLE_CASE = f"""
SELECT raw, array_to_string({_SQL_TITLE_PART}, '_') AS title, array_to_string({_SQL_TITLE_PART}, ' ') AS spaced
FROM (SELECT DISTINCT lower(p_type) || '_' || lower(p_brand) AS raw FROM part)
"""


def q_strip_suffix(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", strip_suffix(F.concat("p_name", F.lit(" - "), "p_brand")).alias("heading"))


SQL_STRIP_SUFFIX = "SELECT p_partkey, trim(split_part(p_name || ' - ' || p_brand, ' - ', 1)) AS heading FROM part"


def q_strip_text(spark, d):
    c = _t(spark, d, "customer")
    raw = F.concat(F.lit("\t\u00a0 "), F.col("c_name"), F.lit("\n\u2003"))
    return c.select("c_custkey", strip_text(raw).alias("name"))


SQL_STRIP_TEXT = "SELECT c_custkey, trim(chr(9) || chr(160) || ' ' || c_name || chr(10) || chr(8195), chr(9) || chr(160) || ' ' || chr(10) || chr(8195)) AS name FROM customer"


# ---------------------------------------------------------------- K5

def q_sections(spark, d):
    n = _t(spark, d, "nation").withColumnRenamed("n_regionkey", "query_id")
    body = K.markdown_rows(n, ["query_id"], ["n_nationkey", "n_name"], ["n_nationkey"], width=1000)
    bodies = body.select("query_id", F.lit("sql").alias("section"), "block", "text")
    queries = _t(spark, d, "region").select(F.col("r_regionkey").alias("query_id"))
    return K.markdown_sections(queries, bodies)


def _sql_sections() -> str:
    heads = " UNION ALL ".join(
        f"SELECT {o} AS ord, '{s}' AS section, '{h}' AS heading, '{p}' AS placeholder"
        for o, s, h, p in K.SECTIONS)
    return f"""
WITH sec AS ({heads}),
q AS (SELECT r_regionkey AS query_id FROM region),
b AS (
  SELECT n_regionkey AS query_id, 'sql' AS section, CAST(0 AS BIGINT) AS block,
         '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10)
         || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS text
  FROM nation GROUP BY n_regionkey)
SELECT q.query_id, sec.ord, sec.section, CAST(-1 AS BIGINT) AS block, sec.heading AS text FROM q, sec
UNION ALL
SELECT q.query_id, sec.ord, sec.section, coalesce(b.block, 0), coalesce(b.text, sec.placeholder)
FROM q CROSS JOIN sec LEFT JOIN b ON b.query_id = q.query_id AND b.section = sec.section
"""


SQL_SECTIONS = _sql_sections()


# ---------------------------------------------------------------- M1

def _stub_model(prompts):
    return prompts.str.upper()


def q_model_map(spark, d):
    n = _t(spark, d, "nation").select("n_nationkey", F.concat(F.lit("Summarise "), "n_name").alias("prompt"))
    return model_map(n, _stub_model, "prompt").select("n_nationkey", "reply")


SQL_MODEL_MAP = "SELECT n_nationkey, upper('Summarise ' || n_name) AS reply FROM nation"


# ---------------------------------------------------------------- S4 + P5 + P6

def _operator_pages(spark, d) -> DataFrame:
    """One page per supplier: a table whose first body row is the header,
    then a row naming the country and a row with a blank country cell (the
    operator-list layout, where a blank cell repeats the country above)."""
    s = _with_country(spark, d, "supplier", "s_nationkey")
    # Each supplier page: header row, the first line naming the country, then
    # the supplier's line with a blank country cell.
    html = F.concat(
        F.lit('<div class="entry-content"><table><tbody><tr><th>Country</th><th>Operator</th>'
              '<th>Network Code</th><th>Display Text</th></tr><tr><td>'),
        F.col("Country"), F.lit("</td><td>HQ "), F.col("Country"), F.lit("</td><td>"),
        F.col("s_nationkey").cast("string"), F.lit("</td><td>HQ</td></tr><tr><td></td><td>"),
        F.col("s_name"), F.lit("</td><td>0"), F.col("s_suppkey").cast("string"), F.lit("</td><td>"),
        F.upper("s_name"), F.lit("</td></tr></tbody></table></div>"))
    return s.select(F.col("s_suppkey").alias("page_id"), html.alias("html"))


def q_operator_list_ingest(spark, d):
    el = H.html_elements(_operator_pages(spark, d), **H.TABLES)
    t = H.html_table_rows(el, ["Country", "Operator", "Network Code", "Display Text"],
                          container_class="entry-content", header="first_row")
    # Rows of one page are a bounded group (one input row): plain windows.
    filled = forward_fill(t, "Country", ["row_pos"], keys=["page_id"], width=None)
    filled = C.drop_leading(filled, 1, keys=["page_id"], order=["row_pos"], width=None)
    return filled.select("page_id", "Country", "Operator", "Network Code", "Display Text")


SQL_OPERATOR_LIST_INGEST = """
SELECT s_suppkey AS page_id, n_name AS Country, s_name AS Operator, '0' || s_suppkey AS "Network Code",
       upper(s_name) AS "Display Text"
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


# ---------------------------------------------------------------- S5 + P7/P8 + U1 + U3 + K6

def _card_pages(spark, d) -> DataFrame:
    s = _with_country(spark, d, "supplier", "s_nationkey")
    card = ('<a class="flex flex-col gap-2 rounded border border-gray-100 p-2 hover:border-teal-300 '
            'hover:shadow-lg hover:shadow-teal-600/40" href="')
    tail = F.when(F.col("s_acctbal") < 0, F.lit(" usa ")).otherwise(F.col("Country"))
    html = F.concat(
        F.lit("<div>" + card + "/dc/s-"), F.col("s_suppkey").cast("string"),
        F.lit('"><div class="text font-medium hover:text-purple">'), F.col("s_name"),
        F.lit('</div><div class="text-xs text-gray-500">Colocation</div><div class="text-xs text-gray-500">Street '),
        F.col("s_suppkey").cast("string"), F.lit(", "), tail, F.lit("</div></a>" + card + "/dc/hub-"),
        F.col("s_nationkey").cast("string"),
        F.lit('"><div class="text font-medium hover:text-purple">Hub '), F.col("Country"),
        F.lit('</div><div class="text-xs text-gray-500">Hub</div><div class="text-xs text-gray-500">Hub road, '),
        F.col("Country"), F.lit("</div></a></div>"))
    return s.select(F.col("s_suppkey").alias("page_id"),
                    F.concat(F.lit("https://dc.example.com/locations?query="), F.lower("Country")).alias("url"),
                    F.lower("Country").alias("keyword"), F.col("s_suppkey").alias("keyword_pos"),
                    html.alias("html"))


def q_datacenter_listing(spark, d):
    pages = _card_pages(spark, d)
    cards = H.html_cards(H.html_elements(pages, keep_tags=H.CARD_TAGS, url="url"))
    cards = cards.join(pages.select("page_id", "keyword", "keyword_pos"), "page_id")
    kept = C.filter_by_country_key(cards, "Address", F.col("keyword"))
    dedup = R.dedup_keep_first(kept.withColumn("error", F.lit(None).cast("string")),
                               ["Link"], ["keyword_pos", "card_pos"])
    return dedup.select(K.linked_name("Name", "Link").alias("Name"), "Type", "Address", "Link")


SQL_DATACENTER_LISTING = """
SELECT '[' || s_name || '](https://dc.example.com/dc/s-' || s_suppkey || ')' AS Name, 'Colocation' AS Type,
       'Street ' || s_suppkey || ', ' || n_name AS Address, 'https://dc.example.com/dc/s-' || s_suppkey AS Link
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0
UNION ALL
SELECT DISTINCT '[Hub ' || n_name || '](https://dc.example.com/dc/hub-' || n_nationkey || ')', 'Hub',
       'Hub road, ' || n_name, 'https://dc.example.com/dc/hub-' || n_nationkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


# ---------------------------------------------------------------- S10 rejects, S11

def q_ranking_rejects(spark, d):
    s = _with_country(spark, d, "supplier", "s_nationkey")
    item = F.struct(
        F.when(F.col("s_acctbal") <= 9000, F.col("s_suppkey").cast("int")).alias("rank"),
        F.col("s_name").alias("domain"))
    body = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.array(item).alias("top")).alias("result")))
    _, bad = P.parse_ranking(s.select(F.col("Country").alias("country"), F.lit("domain_popularity").alias("metric"),
                                      body.alias("body")))
    return bad.select("country", "domain", "reason")


SQL_RANKING_REJECTS = """
SELECT n_name AS country, s_name AS domain, 'missing rank' AS reason
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000
"""


def q_unknown_shapes(spark, d):
    s = _segment_shares(spark, d)
    good = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.array(F.struct(
        F.col("category").alias("name"), F.col("share").alias("share"))).alias("summary_0")).alias("result")))
    odd = F.to_json(F.struct(F.lit(True).alias("success"),
                             F.struct(F.col("category").alias("summary_0")).alias("result")))
    payloads = s.select("country", F.lit("os").alias("metric"),
                        F.when(F.col("r_regionkey") == 4, odd).otherwise(good).alias("body"))
    return P.unknown_shape_dump(payloads)


SQL_UNKNOWN_SHAPES = f"""
SELECT country, 'os' AS metric, '"' || category || '"' AS raw FROM ({_SQL_SHARES}) WHERE r_regionkey = 4
"""


# ---------------------------------------------------------------- J3, J6 + A1, W3, P11

def q_alpha2_to_country(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("code"))
    return J.alpha2_to_country(c, "code", _nation_dim(spark, d), out="country")


SQL_ALPHA2_TO_COUNTRY = """
SELECT c_custkey, 'n' || c_nationkey AS code, n_name AS country FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
"""


def _user_country_events(spark, d) -> DataFrame:
    ev = _t(spark, d, "events")
    cus = _with_country(spark, d, "customer", "c_nationkey").select("c_custkey", "Country")
    return ev.join(J.never_broadcast(cus), ev.user_id == cus.c_custkey).drop("c_custkey")


def _all_tests(spark, d):
    """Every event type there is, and one that never occurs: a scalar."""
    return _t(spark, d, "events").agg(F.sort_array(F.array_union(F.collect_set("event_type"), F.array(
        F.lit("refund"))))).scalar()


_SQL_TESTS = "(SELECT DISTINCT event_type FROM events UNION SELECT 'refund') t(test)"


def q_zip_results(spark, d):
    grid = _t(spark, d, "nation").select(F.col("n_name").alias("Country"),
                                         F.explode(_all_tests(spark, d)).alias("test"))
    ev = _user_country_events(spark, d).withColumnRenamed("event_type", "test")
    counts = A.status_counts(ev, ["Country", "test"], F.col("value") >= 100.0)
    return J.zip_results(grid, counts, ["Country", "test"])


SQL_ZIP_RESULTS = f"""
WITH g AS (SELECT n_name AS Country, t.test FROM nation, {_SQL_TESTS}),
c AS (SELECT n_name AS Country, event_type AS test, count(*) FILTER (WHERE value >= 100.0) AS anomalies,
             count(*) FILTER (WHERE NOT value >= 100.0) AS accessible
      FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT g.Country, g.test, c.anomalies, c.accessible FROM g LEFT JOIN c USING (Country, test)
"""


def q_limit_results(spark, d):
    ev = _t(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return R.limit_results(ev, ["user_id", "event_type"], ["ts", "event_id"], 3).drop("ts")


SQL_LIMIT_RESULTS = """
SELECT event_id, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
WHERE rn <= 3
"""


def q_measurement_filters(spark, d):
    m = P.parse_measurements(_measurement_payloads(spark, d), keep=["event_id"])
    f = C.measurement_filters(m, test="error", only_anomalies=True)
    f = C.measurement_filters(f, country=None)
    return f.select("event_id", "probe_cc", "test_name")


SQL_MEASUREMENT_FILTERS = """
SELECT event_id, CAST(user_id AS VARCHAR) AS probe_cc, event_type AS test_name FROM events WHERE event_type = 'error'
"""


# ---------------------------------------------------------------- P1, P2, A8, K1/S2

def q_replace_values(spark, d):
    n = C.rename_columns(_t(spark, d, "nation"), {"n_name": "Country", "n_nationkey": "key", "absent": "x"})
    aliases = _t(spark, d, "region").select(F.concat(F.lit("NATION_"), F.col("r_regionkey").cast("string")).alias("alias"),
                                            F.concat(F.lit("Nation of "), F.col("r_name")).alias("canonical"))
    n = C.replace_values(n, "Country", aliases)
    return C.replace_values(n, "Country", {"NATION_24": "Last nation"}).select("key", "Country")


SQL_REPLACE_VALUES = """
SELECT n_nationkey AS key,
       CASE WHEN n_name = 'NATION_24' THEN 'Last nation' ELSE coalesce('Nation of ' || r_name, n_name) END AS Country
FROM nation LEFT JOIN region ON n_name = 'NATION_' || r_regionkey
"""


def q_completeness_check(spark, d):
    tagged = A.tag_sources({
        "customer": _with_country(spark, d, "customer", "c_nationkey"),
        "supplier": _with_country(spark, d, "supplier", "s_nationkey"),
        "refunds": _with_country(spark, d, "customer", "c_nationkey").where(F.col("c_acctbal") > 1e12),
    })
    exp = _t(spark, d, "region").select(
        F.when(F.col("r_regionkey") == 0, "customer").when(F.col("r_regionkey") == 1, "supplier")
        .when(F.col("r_regionkey") == 2, "refunds").alias("source"),
        F.lit(2080).cast("long").alias("expected_rows")).where(F.col("source").isNotNull())
    return A.completeness_check(tagged, exp)


SQL_COMPLETENESS_CHECK = """
WITH c AS (SELECT 'customer' AS source, count(*) AS n FROM customer
           UNION ALL SELECT 'supplier', count(*) FROM supplier
           UNION ALL SELECT 'refunds', count(*) FROM customer WHERE c_acctbal > 1e12)
SELECT source, CAST(2080 AS BIGINT) AS expected_rows, CAST(n AS BIGINT) AS n_rows,
       CASE WHEN n = 0 THEN 'empty' WHEN n < 2080 THEN 'short' ELSE 'ok' END AS status
FROM c
"""


def q_csv_roundtrip(spark, d):
    from commsight.session import staging_path
    from commsight.sources.tables import load_csv_table, write_csv
    from pyspark.sql import types as T

    c = _t(spark, d, "customer").select(
        F.format_string("%06d", "c_custkey").alias("code"), "c_name",
        F.concat(F.col("c_mktsegment"), F.lit(", line\nnext")).alias("note"))
    path = staging_path(spark, "csv")
    write_csv(c, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "c_name", "note")])
    return load_csv_table(spark, path, schema)


SQL_CSV_ROUNDTRIP = """
SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, c_name, c_mktsegment || ', line' || chr(10) || 'next' AS note
FROM customer
"""


# ---------------------------------------------------------------- the whole report (no SQL oracle)

def q_report(spark, d):
    """Every customer's question through all four report sections.

    Stored tables: suppliers as mobile operators, customer segments as ISPs;
    data-centre cards from the card pages; measurements from events (code
    of the user's nation, test = event type, anomaly = value >= 100);
    metrics = customer-segment shares per nation; ranking = suppliers.
    """
    from commsight.plans.report import report_rows

    nat = _t(spark, d, "nation").select(F.col("n_name").alias("Country"))
    sup = _with_country(spark, d, "supplier", "s_nationkey").select("Country", F.col("s_name").alias("op"))
    cus = _with_country(spark, d, "customer", "c_nationkey").select("Country", F.col("c_mktsegment").alias("isp"))
    tables = [("nations", nat), ("operators", sup), ("isps", cus)]
    provider_columns = {"operators": ("Mobile Network Operators", "op"), "isps": ("Internet Service Providers", "isp")}
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    requests = _questions(spark, d).join(J.never_broadcast(c), F.col("query_id") == c.c_custkey).select(
        "query_id", "user_query",
        _all_tests(spark, d).alias("test_names"),
        (F.col("c_mktsegment") == "BUILDING").alias("only_anomalies"), F.lit(HORIZON).alias("horizon"))
    pages = _card_pages(spark, d)
    cards = H.html_cards(H.html_elements(pages, keep_tags=H.CARD_TAGS, url="url")).join(
        J.never_broadcast(pages.select("page_id", "keyword", "keyword_pos")), "page_id")
    ev = _user_country_events(spark, d)
    dim = _nation_dim(spark, d)
    code_of = dim.select(F.col("name").alias("Country"), "alpha_2")
    meas = ev.join(code_of, "Country").select(
        F.col("alpha_2").alias("probe_cc"), F.col("event_type").alias("test_name"),
        F.col("ts").alias("measurement_start_time"), (F.col("value") >= 100.0).alias("anomaly"))
    shares = _with_country(spark, d, "customer", "c_nationkey").groupBy("Country", "c_mktsegment").count()
    tot = _with_country(spark, d, "customer", "c_nationkey").groupBy("Country").agg(F.count(F.lit(1)).alias("t"))
    metrics = shares.join(tot, "Country").join(code_of, "Country").select(
        F.col("alpha_2").alias("country"), F.lit("segment_share").alias("metric"),
        F.col("c_mktsegment").alias("category"), (F.col("count") / F.col("t")).alias("share"))
    ranking = _with_country(spark, d, "supplier", "s_nationkey").join(code_of, "Country").select(
        F.col("alpha_2").alias("country"), F.col("s_suppkey").cast("int").alias("rank"),
        F.lower("s_name").alias("domain"), F.lit("telecom").alias("categories"))
    # Fetches of the test that never occurs fail for every third nation.
    failures = _t(spark, d, "nation").where("n_nationkey % 3 = 0").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("alpha_2"), F.lit("refund").alias("test_name"),
        F.concat(F.lit("http "), (F.col("n_nationkey") + 500).cast("string")).alias("reason"))
    return report_rows(requests, tables, dim, AS_OF, cards=cards, measurements=meas, metrics=metrics,
                       ranking=ranking, threshold=ALERT_THRESHOLD, provider_columns=provider_columns,
                       failures=failures)


def _sql_block(rows: str, head: str, groups: str) -> str:
    """Blocks of 500 lines: ``rows`` has groups, title, rn and line; a title
    heads the first block, the table's head every one."""
    return f"""
SELECT {groups}, CAST(floor((rn - 1) / 500) AS BIGINT) AS b,
  CASE WHEN min(rn) = 1 THEN '### ' || any_value(title) || chr(10) ELSE '' END || {head} || chr(10)
  || string_agg(line, chr(10) ORDER BY rn) AS text FROM ({rows}) GROUP BY ALL"""


def _sql_head(*names: str) -> str:
    return "'| " + " | ".join(names) + " |' || chr(10) || '|" + "---|" * len(names) + "'"


def _sql_sections(sections) -> str:
    return "(VALUES " + ", ".join(f"({o}, '{s}', '{h}', '{e}')" for o, s, h, e in sections) + ") s(ord, section, h, e)"


def _sql_report(ids: str, body: str, sections) -> str:
    """All rows of a report, from the blocks of its sections."""
    return f"""
SELECT i.query_id, s.ord, s.section, CAST(-1 AS BIGINT) AS block, s.h AS text FROM ({ids}) i, {_sql_sections(sections)}
UNION ALL
SELECT i.query_id, s.ord, s.section, coalesce(b.block, 0), coalesce(b.text, s.e)
FROM ({ids}) i CROSS JOIN {_sql_sections(sections)}
LEFT JOIN ({body}) b ON b.query_id = i.query_id AND b.section = s.section
"""


SQL_REPORT = f"""
WITH q AS (
  SELECT c_custkey AS query_id, n_nationkey AS k, n_name AS n, c_mktsegment = 'BUILDING' AS bad_only
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
prov AS (
  SELECT DISTINCT n_name AS n, 'Mobile Network Operators' AS kind, s_name AS p
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT DISTINCT n_name, 'Internet Service Providers', c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
sqlb AS (
  {_sql_block("SELECT n, kind, n || ': ' || kind AS title, row_number() OVER (PARTITION BY n, kind ORDER BY p) AS rn,"
              " '| ' || p || ' |' AS line FROM prov", _sql_head("provider"), "n, kind")}),
card AS (
  SELECT n_name AS n, '[' || s_name || '](https://dc.example.com/dc/s-' || s_suppkey || ')' AS name, 'Colocation' AS kind,
    'Street ' || s_suppkey || ', ' || n_name AS a, 'https://dc.example.com/dc/s-' || s_suppkey AS link
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0
  UNION SELECT n_name, '[Hub ' || n_name || '](https://dc.example.com/dc/hub-' || n_nationkey || ')', 'Hub',
    'Hub road, ' || n_name, 'https://dc.example.com/dc/hub-' || n_nationkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
dcl AS (
  SELECT n, row_number() OVER (PARTITION BY n ORDER BY name, link) AS rn,
    '| ' || name || ' | ' || kind || ' | ' || a || ' | ' || link || ' |' AS line FROM card),
dcb AS (
  SELECT n, CAST(floor((rn - 1) / 500) AS BIGINT) AS b, CASE WHEN min(rn) = 1
    THEN {_sql_head("Name", "Type", "Address", "Link")} || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY rn) AS text
  FROM dcl GROUP BY ALL),
m AS (
  SELECT n_name AS n, event_type AS test, value >= 100.0 AS bad FROM events JOIN customer ON user_id = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  WHERE CAST(ts AS DATE) >= DATE '2024-01-16' AND CAST(ts AS DATE) < DATE '2024-01-31'),
cnt AS (SELECT n, test, count(*) FILTER (WHERE bad) AS bad, count(*) FILTER (WHERE NOT bad) AS good FROM m GROUP BY ALL),
t AS (
  SELECT q.query_id, q.n, q.k, t.test, upper(t.test[1]) || t.test[2:] AS title, coalesce(bad, 0) AS bad,
    CASE WHEN bad_only THEN 0 ELSE coalesce(good, 0) END AS good
  FROM q CROSS JOIN {_SQL_TESTS} LEFT JOIN cnt ON cnt.n = q.n AND cnt.test = t.test),
failed AS (SELECT * FROM t WHERE test = 'refund' AND k % 3 = 0),
ooni AS (
  SELECT query_id, 0 AS part, {_sql_head("Country", "Test", "Anomalies", "Accessible")} || chr(10) || string_agg(
    '| ' || n || ' | ' || title || ' | ' || bad || ' | ' || good || ' |', chr(10) ORDER BY test) AS text
  FROM t WHERE (query_id, test) NOT IN (SELECT (query_id, test) FROM failed) GROUP BY query_id
  UNION ALL
  SELECT query_id, 1, '**High-anomaly alerts**' || chr(10) || string_agg('- ' || n || ' / ' || title || ': ' ||
    printf('%.2f%%', round(100.0 * bad / (bad + good), 2)) || ' anomalies', chr(10) ORDER BY test)
  FROM t WHERE bad + good > 0 AND CAST(bad AS DOUBLE) / (bad + good) > {ALERT_THRESHOLD} GROUP BY query_id
  UNION ALL
  SELECT query_id, 2, '**Failed fetches**' || chr(10) || '- ' || n || ' / ' || title || ': http ' || (500 + k) FROM failed),
seg AS (
  SELECT n_name AS n, c_mktsegment AS c, count(*) / sum(count(*)) OVER (PARTITION BY n_name) AS share
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment),
met AS (
  SELECT n, '| Segment Share | ' || n || ' |' || chr(10) || '|---|---|' || chr(10) || string_agg(
    '| ' || c || ' | ' || printf('%.2f%%', round(share * 100, 2)) || ' |', chr(10) ORDER BY share DESC, c) AS text
  FROM seg GROUP BY n),
rk AS (
  SELECT n_name AS n, s_suppkey AS r, lower(s_name) AS dom,
    row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey, lower(s_name)) AS rn
  FROM supplier JOIN nation ON s_nationkey = n_nationkey QUALIFY rn <= 20),
dom AS (
  SELECT n, '### ' || n || ': top domains' || chr(10) || {_sql_head("Rank", "Domain", "Categories")} || chr(10) ||
    string_agg('| ' || r || ' | ' || dom || ' | telecom |', chr(10) ORDER BY rn) AS text FROM rk GROUP BY n),
parts AS (
  SELECT query_id, 'sql' AS section, kind AS part, b, text FROM q JOIN sqlb USING (n)
  UNION ALL SELECT query_id, 'dc', '0', 0, 'Total data centers: ' || (SELECT count(*) FROM card WHERE card.n = q.n) FROM q
  UNION ALL SELECT query_id, 'dc', '1', b, text FROM q JOIN dcb USING (n)
  UNION ALL SELECT query_id, 'ooni', CAST(part AS VARCHAR), 0, text FROM ooni
  UNION ALL SELECT query_id, 'radar', '0', 0, text FROM q JOIN met USING (n)
  UNION ALL SELECT query_id, 'radar', '1', 0, text FROM q JOIN dom USING (n)),
body AS (
  SELECT query_id, section, row_number() OVER (PARTITION BY query_id, section ORDER BY part, b) - 1 AS block, text
  FROM parts)
{_sql_report("SELECT query_id FROM q", "SELECT * FROM body", K.SECTIONS)}
"""


def q_table_report(spark, d):
    """The table-only question flow over the stored-table stand-ins."""
    from commsight.plans.report import table_report_rows

    nat = _t(spark, d, "nation").select(F.col("n_name").alias("Country"), "n_nationkey")
    sup = _with_country(spark, d, "supplier", "s_nationkey").select("Country", "s_suppkey", "s_name")
    cus = _with_country(spark, d, "customer", "c_nationkey").select("Country", "c_custkey", "c_mktsegment")
    requests = _questions(spark, d)
    return table_report_rows(requests, [("nations", nat), ("suppliers", sup), ("customers", cus)])


def _sql_listing(name: str, source: str, cols: tuple[str, ...], order: int) -> str:
    line = " || ' | ' || ".join(cols)
    return f"SELECT n, {order} AS src, b, text FROM (" + _sql_block(
        f"SELECT n_name AS n, '{name}: ' || n_name AS title, row_number() OVER (PARTITION BY n_name ORDER BY "
        f"{', '.join(cols)}) AS rn, '| ' || {line} || ' |' AS line FROM {source}", _sql_head(*cols), "n") + ")"


_SQL_STORED = {
    "nations": ("nation", ("n_nationkey",)),
    "suppliers": ("supplier JOIN nation ON s_nationkey = n_nationkey", ("s_suppkey", "s_name")),
    "customers": ("customer JOIN nation ON c_nationkey = n_nationkey", ("c_custkey", "c_mktsegment")),
}


def _sql_table_report() -> str:
    from commsight.plans.report import TABLE_SECTIONS

    counts = " UNION ALL ".join(f"SELECT n_name AS n, '{k}' AS src, count(*) AS c FROM {t} GROUP BY 1"
                                for k, (t, _) in _SQL_STORED.items())
    listings = " UNION ALL ".join(_sql_listing(k, t, cols, i) for i, (k, (t, cols)) in enumerate(_SQL_STORED.items()))
    has = {k: f"CAST(coalesce(max(1) FILTER (WHERE src = '{k}'), 0) AS VARCHAR)" for k in _SQL_STORED}
    return f"""
WITH q AS (SELECT c_custkey AS query_id, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey),
cnt AS ({counts}),
lst AS ({listings}),
cov AS (
  SELECT n, {_sql_head("Country", *_SQL_STORED, "n_sources")} || chr(10) || '| ' || n || ' | ' ||
    {" || ' | ' || ".join(has.values())} || ' | ' || count(DISTINCT src) || ' |' AS text FROM cnt GROUP BY n),
parts AS (
  SELECT query_id, 'summary' AS section, 0 AS part, '' AS src, 0 AS b, 'Total rows: ' || sum(c) || ' across 1 countries' AS text
  FROM q JOIN cnt USING (n) GROUP BY query_id
  UNION ALL SELECT query_id, 'summary', 1, src, 0, '- ' || src || ': ' || c || ' rows, 1 countries' FROM q JOIN cnt USING (n)
  UNION ALL SELECT query_id, 'tables', src, '', b, text FROM q JOIN lst USING (n)
  UNION ALL SELECT query_id, 'insights', 0, '', 0, text FROM q JOIN cov USING (n)),
body AS (
  SELECT query_id, section, row_number() OVER (PARTITION BY query_id, section ORDER BY part, src, b) - 1 AS block, text
  FROM parts)
{_sql_report("SELECT query_id FROM q", "SELECT * FROM body", TABLE_SECTIONS)}
"""


SQL_TABLE_REPORT = _sql_table_report()


# ---------------------------------------------------------------- A7 per question, J6 + S12 outcomes

def q_pivot_by_question(spark, d):
    """A7 with each question's own columns: questions name one region or two,
    the columns are its nations, the rows market segments."""
    n = _t(spark, d, "nation")
    c = _t(spark, d, "customer")
    shares = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_regionkey", "n_name", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("bal"))
    asked = c.select("c_custkey", F.explode(F.array_distinct(F.array(
        F.col("c_custkey") % 5, (F.col("c_custkey") * 3) % 5))).alias("__r"))
    cells = asked.join(shares, F.col("__r") == F.col("n_regionkey")).select(
        "c_custkey", F.lit("segments").alias("metric"), "c_mktsegment", "n_name", F.col("n").cast("string").alias("cell"),
        F.col("n").alias("order"))
    out = A.pivot_by_group(cells, ["c_custkey"], "metric", "c_mktsegment", "n_name", "cell", "order")
    return out.select("c_custkey", "c_mktsegment", "position", F.array_join("columns", ",").alias("columns"),
                      F.array_join("cells", ",").alias("cells"))


SQL_PIVOT_BY_QUESTION = """
WITH s AS (
  SELECT n_regionkey AS r, n_name, c_mktsegment AS seg, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL),
a AS (SELECT c_custkey, c_custkey % 5 AS r FROM customer UNION SELECT c_custkey, (c_custkey * 3) % 5 FROM customer),
c AS (SELECT c_custkey, n_name, seg, n FROM a JOIN s USING (r)),
cols AS (SELECT DISTINCT c_custkey, n_name FROM c),
rws AS (SELECT c_custkey, seg, max(n) AS o FROM c GROUP BY ALL)
SELECT rws.c_custkey, seg AS c_mktsegment, any_value(position) AS position, string_agg(n_name, ',' ORDER BY n_name) AS columns,
       string_agg(coalesce(CAST(n AS VARCHAR), ''), ',' ORDER BY n_name) AS cells
FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o DESC, seg) AS position FROM rws) rws
JOIN cols USING (c_custkey) LEFT JOIN c USING (c_custkey, seg, n_name) GROUP BY rws.c_custkey, seg
"""


def q_fetch_outcomes(spark, d):
    """J6 + S12: per nation and test the counts, or that there were none, or
    that the fetch failed and why; a failure beside rows is not told."""
    grid = _t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("Country"),
                                         F.explode(_all_tests(spark, d)).alias("test"))
    ev = _user_country_events(spark, d).withColumnRenamed("event_type", "test")
    counts = A.status_counts(ev, ["Country", "test"], F.col("value") >= 100.0)
    failures = grid.where((F.col("n_nationkey") + F.length("test")) % 4 == 0).select("Country", "test", F.concat_ws(
        " ", F.lit("http"), (F.length("test") + 500).cast("string")).alias("reason"))
    return J.zip_outcomes(grid, counts, failures, ["Country", "test"])


SQL_FETCH_OUTCOMES = f"""
WITH g AS (SELECT n_nationkey, n_name AS Country, t.test FROM nation, {_SQL_TESTS}),
c AS (SELECT n_name AS Country, event_type AS test, count(*) FILTER (WHERE value >= 100.0) AS anomalies,
             count(*) FILTER (WHERE NOT value >= 100.0) AS accessible
      FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
      GROUP BY ALL),
j AS (SELECT g.*, c.anomalies, c.accessible, (n_nationkey + length(g.test)) % 4 = 0 AS bad FROM g LEFT JOIN c USING (Country, test))
SELECT n_nationkey, Country, test, anomalies, accessible,
       CASE WHEN anomalies IS NULL AND bad THEN 'http ' || (500 + length(test)) END AS reason,
       CASE WHEN anomalies IS NOT NULL THEN 'rows' WHEN bad THEN 'failed' ELSE 'empty' END AS outcome
FROM j
"""


# ---------------------------------------------------------------- report piece with an oracle

def q_question_test_counts(spark, d):
    """The report's measurement counts per (question, country, test): E1
    selection, S13/J5 grid, P10 window and P11 anomalies-only per request,
    A1 counts pre-aggregated per (code, test, day), zero rows kept (J6)."""
    from commsight.plans.report import ooni_counts, request_plan, selection_for

    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    requests = _questions(spark, d).join(c, F.col("query_id") == c.c_custkey).select(
        "query_id", "user_query", _all_tests(spark, d).alias("test_names"),
        (F.col("c_mktsegment") == "BUILDING").alias("only_anomalies"), F.lit(HORIZON).alias("horizon"))
    nat = _t(spark, d, "nation").select(F.col("n_name").alias("Country"))
    selection = selection_for(requests, [("nations", nat)])
    dim = _nation_dim(spark, d)
    grid, _ = request_plan(requests, selection, dim, AS_OF)
    code_of = dim.select(F.col("name").alias("Country"), "alpha_2")
    meas = _user_country_events(spark, d).join(code_of, "Country").select(
        F.col("alpha_2").alias("probe_cc"), F.col("event_type").alias("test_name"),
        F.col("ts").alias("measurement_start_time"), (F.col("value") >= 100.0).alias("anomaly"))
    return ooni_counts(grid, requests, meas)


SQL_QUESTION_TEST_COUNTS = f"""
WITH q AS (
  SELECT c.c_custkey AS query_id, c.c_mktsegment = 'BUILDING' AS only_anomalies,
         'Which providers serve ' || replace(lower(n.n_name), '_',
            CASE c.c_mktsegment WHEN 'BUILDING' THEN '-' WHEN 'MACHINERY' THEN ' ' ELSE '_' END)
         || ' for the ' || c.c_mktsegment || ' segment?' AS user_query
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
sel AS (
  SELECT DISTINCT q.query_id, q.only_anomalies, v.n_name AS Country FROM q JOIN nation v
  ON contains(' ' || {_norm('q.user_query')} || ' ', ' ' || {_norm('v.n_name')} || ' ')),
grid AS (SELECT sel.*, t.test FROM sel, {_SQL_TESTS}),
m AS (
  SELECT n.n_name AS Country, e.event_type AS test, CAST(e.ts AS DATE) AS day, e.value >= 100.0 AS anomaly
  FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT g.query_id, g.Country, g.test AS test_name,
       count(m.test) FILTER (WHERE m.anomaly) AS anomalies,
       count(m.test) FILTER (WHERE NOT m.anomaly) AS accessible
FROM grid g LEFT JOIN m
  ON m.Country = g.Country AND m.test = g.test
 AND m.day >= DATE '2024-01-16' AND m.day < DATE '2024-01-31'
 AND (NOT g.only_anomalies OR m.anomaly)
GROUP BY g.query_id, g.Country, g.test
"""


def q_question_dc_totals(spark, d):
    """The report's data-centre totals per question: E1 selection, cards
    parsed from pages (S6/S5), address-country filter (P7/P8), per-link
    keep-first (U3), counted per question (A5)."""
    from commsight.plans.report import dc_listing, dc_totals, selection_for

    nat = _t(spark, d, "nation").select(F.col("n_name").alias("Country"))
    selection = selection_for(_questions(spark, d), [("nations", nat)])
    pages = _card_pages(spark, d)
    cards = H.html_cards(H.html_elements(pages, keep_tags=H.CARD_TAGS, url="url")).join(
        pages.select("page_id", "keyword", "keyword_pos"), "page_id")
    return dc_totals(selection, dc_listing(cards)).select("query_id", F.col("n_ok").alias("n_data_centers"))


SQL_QUESTION_DC_TOTALS = f"""
WITH q AS (
  SELECT c.c_custkey AS query_id,
         'Which providers serve ' || replace(lower(n.n_name), '_',
            CASE c.c_mktsegment WHEN 'BUILDING' THEN '-' WHEN 'MACHINERY' THEN ' ' ELSE '_' END)
         || ' for the ' || c.c_mktsegment || ' segment?' AS user_query
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
sel AS (
  SELECT DISTINCT q.query_id, v.n_name AS Country FROM q JOIN nation v
  ON contains(' ' || {_norm('q.user_query')} || ' ', ' ' || {_norm('v.n_name')} || ' ')),
per_country AS (
  SELECT n.n_name AS Country, count(*) FILTER (WHERE s.s_acctbal >= 0) + 1 AS n
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name)
SELECT sel.query_id, CAST(sum(per_country.n) AS BIGINT) AS n_data_centers
FROM sel JOIN per_country USING (Country) GROUP BY sel.query_id
"""


def q_question_top_domains(spark, d):
    """The report's domain ranking per question: E1 selection, J2 code
    lookup, W2 top 20 per country (computed once per country, then joined
    to the questions)."""
    from commsight.plans.report import selection_for, top_domains

    nat = _t(spark, d, "nation").select(F.col("n_name").alias("Country"))
    selection = selection_for(_questions(spark, d), [("nations", nat)])
    dim = _nation_dim(spark, d)
    coded = J.country_to_alpha2(selection, "Country", dim).where(F.col("alpha_2").isNotNull())
    code_of = dim.select(F.col("name").alias("Country"), "alpha_2")
    ranking = _with_country(spark, d, "supplier", "s_nationkey").join(code_of, "Country").select(
        F.col("alpha_2").alias("country"), F.col("s_suppkey").cast("int").alias("rank"),
        F.lower("s_name").alias("domain"), F.lit("telecom").alias("categories"))
    top = top_domains(ranking, 20)
    return coded.join(top, "alpha_2").select("query_id", "Country", "rank", "domain")


SQL_QUESTION_TOP_DOMAINS = f"""
WITH q AS (
  SELECT c.c_custkey AS query_id,
         'Which providers serve ' || replace(lower(n.n_name), '_',
            CASE c.c_mktsegment WHEN 'BUILDING' THEN '-' WHEN 'MACHINERY' THEN ' ' ELSE '_' END)
         || ' for the ' || c.c_mktsegment || ' segment?' AS user_query
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
sel AS (
  SELECT DISTINCT q.query_id, v.n_name AS Country FROM q JOIN nation v
  ON contains(' ' || {_norm('q.user_query')} || ' ', ' ' || {_norm('v.n_name')} || ' ')),
top AS (
  SELECT * FROM (
    SELECT n.n_name AS Country, CAST(s.s_suppkey AS INTEGER) AS rank, lower(s.s_name) AS domain,
           row_number() OVER (PARTITION BY n.n_name ORDER BY s.s_suppkey, lower(s.s_name)) AS rn
    FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey) WHERE rn <= 20)
SELECT sel.query_id, sel.Country, top.rank, top.domain FROM sel JOIN top USING (Country)
"""


def q_question_metric_shares(spark, d):
    """The report's traffic-metric rows per question: E1 selection, J2 code
    lookup, shares per country (segment shares as the metric), and the first
    country's share that orders them (A7/W4)."""
    from commsight.plans.report import question_metrics, selection_for

    nat = _t(spark, d, "nation").select(F.col("n_name").alias("Country"))
    selection = selection_for(_questions(spark, d), [("nations", nat)])
    dim = _nation_dim(spark, d)
    coded = J.country_to_alpha2(selection, "Country", dim).where(F.col("alpha_2").isNotNull())
    code_of = dim.select(F.col("name").alias("Country"), "alpha_2")
    cus = _with_country(spark, d, "customer", "c_nationkey")
    shares = cus.groupBy("Country", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    tot = cus.groupBy("Country").agg(F.count(F.lit(1)).alias("t"))
    metrics = shares.join(tot, "Country").join(code_of, "Country").select(
        F.col("alpha_2").alias("country"), F.lit("segment_share").alias("metric"),
        F.col("c_mktsegment").alias("category"), (F.col("n") / F.col("t")).alias("share"))
    return question_metrics(coded, metrics).drop("value")


SQL_QUESTION_METRIC_SHARES = f"""
WITH q AS (
  SELECT c.c_custkey AS query_id,
         'Which providers serve ' || replace(lower(n.n_name), '_',
            CASE c.c_mktsegment WHEN 'BUILDING' THEN '-' WHEN 'MACHINERY' THEN ' ' ELSE '_' END)
         || ' for the ' || c.c_mktsegment || ' segment?' AS user_query
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
sel AS (
  SELECT DISTINCT q.query_id, v.n_name AS Country FROM q JOIN nation v
  ON contains(' ' || {_norm('q.user_query')} || ' ', ' ' || {_norm('v.n_name')} || ' ')),
cn AS (SELECT n.n_name AS Country, c.c_mktsegment FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
sh AS (
  SELECT Country, c_mktsegment AS category,
         CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM cn c2 WHERE c2.Country = cn.Country) AS share
  FROM cn GROUP BY Country, c_mktsegment),
rows AS (SELECT sel.query_id, sel.Country, 'segment_share' AS metric, sh.category, sh.share
         FROM sel JOIN sh USING (Country)),
firsts AS (SELECT query_id, min(Country) AS fc FROM sel GROUP BY query_id)
SELECT r.query_id, r.Country, r.metric, r.category, r.share, f.share AS first_share
FROM rows r JOIN firsts USING (query_id)
LEFT JOIN rows f ON f.query_id = r.query_id AND f.Country = firsts.fc AND f.category = r.category
"""


# ---------------------------------------------------------------- registry

QUERIES = {
    "providers_for_questions": (q_providers_for_questions, SQL_PROVIDERS_FOR_QUESTIONS),
    "filter_in": (q_filter_in, SQL_FILTER_IN),
    "distinct_values": (q_distinct_values, SQL_DISTINCT_VALUES),
    "semi_first_table": (q_semi_first_table, SQL_SEMI_FIRST_TABLE),
    "match_entities": (q_match_entities, SQL_MATCH_ENTITIES),
    "parse_model_list": (q_parse_model_list, SQL_PARSE_MODEL_LIST),
    "forward_fill": (q_forward_fill, SQL_FORWARD_FILL),
    "forward_fill_global": (q_forward_fill_global, SQL_FORWARD_FILL_GLOBAL),
    "pair_heading_body": (q_pair_heading_body, SQL_PAIR_HEADING_BODY),
    "dedup_keep_first": (q_dedup_keep_first, SQL_DEDUP_KEEP_FIRST),
    "status_counts": (q_status_counts, SQL_STATUS_COUNTS),
    "anomaly_alerts": (q_anomaly_alerts, SQL_ANOMALY_ALERTS),
    "half_counts": (q_half_counts, SQL_HALF_COUNTS),
    "every_other_row": (q_every_other_row, SQL_EVERY_OTHER_ROW),
    "metric_pivot": (q_metric_pivot, SQL_METRIC_PIVOT),
    "providers_by_country": (q_providers_by_country, SQL_PROVIDERS_BY_COUNTRY),
    "parse_measurements": (q_parse_measurements, SQL_PARSE_MEASUREMENTS),
    "parse_json": (q_parse_json, SQL_PARSE_JSON),
    "split_ok_rejected": (q_split_ok_rejected, SQL_SPLIT_OK_REJECTED),
    "parse_summary": (q_parse_summary, SQL_PARSE_SUMMARY),
    "parse_ranking": (q_parse_ranking, SQL_PARSE_RANKING),
    "html_links": (q_html_links, SQL_HTML_LINKS),
    "html_title": (q_html_title, SQL_HTML_TITLE),
    "html_table_rows": (q_html_table_rows, SQL_HTML_TABLE_ROWS),
    "table_by_header": (q_table_by_header, SQL_TABLE_BY_HEADER),
    "cell_rejects": (q_cell_rejects, SQL_CELL_REJECTS),
    "nested_entities": (q_nested_entities, SQL_NESTED_ENTITIES),
    "region_questions": (q_region_questions, SQL_REGION_QUESTIONS),
    "requests_by_table": (q_requests_by_table, SQL_REQUESTS_BY_TABLE),
    "unknown_tables": (q_unknown_tables, SQL_UNKNOWN_TABLES),
    "percent_format": (q_percent_format, SQL_PERCENT_FORMAT),
    "typed_empty": (q_typed_empty, SQL_TYPED_EMPTY),
    "propagate_selection": (q_propagate_selection, SQL_PROPAGATE_SELECTION),
    "sort_by_first": (q_sort_by_first, SQL_SORT_BY_FIRST),
    "sort_by_country": (q_sort_by_country, SQL_SORT_BY_COUNTRY),
    "union_sources": (q_union_sources, SQL_UNION_SOURCES),
    "table_payload": (q_table_payload, SQL_TABLE_PAYLOAD),
    "pivot_by_question": (q_pivot_by_question, SQL_PIVOT_BY_QUESTION),
    "fetch_outcomes": (q_fetch_outcomes, SQL_FETCH_OUTCOMES),
    "provider_blocks": (q_provider_blocks, SQL_PROVIDER_BLOCKS),
    "factored_answers": (q_factored_answers, SQL_FACTORED_ANSWERS),
    "table_versions": (q_table_versions, SQL_TABLE_VERSIONS),
    "last_token": (q_last_token, SQL_LAST_TOKEN),
    "filter_by_country_key": (q_filter_by_country_key, SQL_FILTER_BY_COUNTRY_KEY),
    "top_k": (q_top_k, SQL_TOP_K),
    "country_lookup": (q_country_lookup, SQL_COUNTRY_LOOKUP),
    "unresolved_keys": (q_unresolved_keys, SQL_UNRESOLVED_KEYS),
    "request_grid": (q_request_grid, SQL_REQUEST_GRID),
    "coverage": (q_coverage, SQL_COVERAGE),
    "source_totals": (q_source_totals, SQL_SOURCE_TOTALS),
    "executive_summary": (q_executive_summary, SQL_EXECUTIVE_SUMMARY),
    "title_case": (q_title_case, SQL_TITLE_CASE),
    "strip_suffix": (q_strip_suffix, SQL_STRIP_SUFFIX),
    "strip_text": (q_strip_text, SQL_STRIP_TEXT),
    "sections": (q_sections, SQL_SECTIONS),
    "model_map": (q_model_map, SQL_MODEL_MAP),
    "operator_list_ingest": (q_operator_list_ingest, SQL_OPERATOR_LIST_INGEST),
    "datacenter_listing": (q_datacenter_listing, SQL_DATACENTER_LISTING),
    "ranking_rejects": (q_ranking_rejects, SQL_RANKING_REJECTS),
    "unknown_shapes": (q_unknown_shapes, SQL_UNKNOWN_SHAPES),
    "alpha2_to_country": (q_alpha2_to_country, SQL_ALPHA2_TO_COUNTRY),
    "zip_results": (q_zip_results, SQL_ZIP_RESULTS),
    "limit_results": (q_limit_results, SQL_LIMIT_RESULTS),
    "measurement_filters": (q_measurement_filters, SQL_MEASUREMENT_FILTERS),
    "replace_values": (q_replace_values, SQL_REPLACE_VALUES),
    "completeness_check": (q_completeness_check, SQL_COMPLETENESS_CHECK),
    "csv_roundtrip": (q_csv_roundtrip, SQL_CSV_ROUNDTRIP),
    "question_test_counts": (q_question_test_counts, SQL_QUESTION_TEST_COUNTS),
    "question_dc_totals": (q_question_dc_totals, SQL_QUESTION_DC_TOTALS),
    "question_top_domains": (q_question_top_domains, SQL_QUESTION_TOP_DOMAINS),
    "question_metric_shares": (q_question_metric_shares, SQL_QUESTION_METRIC_SHARES),
    "report": (q_report, SQL_REPORT),
    "table_report": (q_table_report, SQL_TABLE_REPORT),
}
