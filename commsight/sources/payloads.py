"""JSON payload parsing.

Payload tables hold one API response per row, e.g. ``(country, test, body)``
for measurements or ``(country, metric, body)`` for traffic metrics.  Parsing
is ``from_json`` / VARIANT functions plus ``explode``: JVM side, no UDF.
Shapes the reference distinguishes with ``isinstance`` are told apart with
``try_variant_get`` casts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commsight.functions.text import asn_label, status_label
from commsight.session import spread

MEASUREMENT_SCHEMA = (
    "struct<results: array<struct<probe_cc: string, probe_asn: string, "
    "measurement_start_time: string, test_name: string, anomaly: variant>>>"
)


def truthy(v: Column) -> Column:
    """Whether a JSON value counts as true: not absent, null, false, zero or
    empty."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}"))
        .when(kind != "VOID", F.try_variant_get(v, "$", "double") != 0), F.lit(False))


def parse_measurements(payloads: DataFrame, body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """Results array -> one typed row per measurement.

    Absent keys get the reference's defaults (``''``; an absent anomaly
    means accessible; any truthy one is an anomaly).  A payload with no
    ``results`` gives no rows.  ``pos`` is the measurement's position in the
    response (order matters for W1).  A blank or malformed time gives a null
    ``measurement_start_time``; ``start_text`` keeps what was sent.
    """
    keep = list(keep)
    parsed = spread(payloads).select(*keep, F.from_json(F.col(body), MEASUREMENT_SCHEMA).alias("__p"))
    rows = parsed.select(*keep, F.posexplode(F.coalesce(F.col("__p.results"), F.array())).alias("pos", "__r"))
    r = F.col("__r")
    return rows.select(
        *keep,
        F.col("pos").cast("long").alias("pos"),
        F.coalesce(r["probe_cc"], F.lit("")).alias("probe_cc"),
        asn_label(r["probe_asn"]).alias("asn"),
        F.try_to_timestamp(r["measurement_start_time"]).alias("measurement_start_time"),
        F.coalesce(r["measurement_start_time"], F.lit("")).alias("start_text"),
        F.coalesce(r["test_name"], F.lit("")).alias("test_name"),
        truthy(r["anomaly"]).alias("anomaly"),
        status_label(truthy(r["anomaly"])).alias("status"),
    )


def tag_ok_rejected(payloads: DataFrame, body: str = "body",
                    require_success: bool = True, status: str | None = None) -> DataFrame:
    """S12 in one pass: ``payloads`` plus ``reason`` (null when accepted).

    Reasons: ``http <status>`` (non-200 when a status column is given),
    ``invalid json``, ``not success`` (envelope ``success`` is not true).
    """
    v = F.try_parse_json(F.col(body))
    reason = F.when(F.lit(False), F.lit(None))
    if status:
        reason = reason.when(F.col(status) != 200, F.concat(F.lit("http "), F.col(status).cast("string")))
    reason = reason.when(v.isNull(), F.lit("invalid json"))
    if require_success:
        ok = F.coalesce(F.try_variant_get(v, "$.success", "boolean"), F.lit(False))
        reason = reason.when(~ok, F.lit("not success"))
    return spread(payloads).withColumn("reason", reason)


def split_ok_rejected(payloads: DataFrame, body: str = "body",
                      require_success: bool = True, status: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) - bad responses are kept aside with a
    ``reason``, never failing the batch.  ``accepted + rejected = input``.
    Both are filters of one tagged frame (``tag_ok_rejected``)."""
    tagged = tag_ok_rejected(payloads, body, require_success, status)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def _variant(body: str) -> Column:
    return F.try_parse_json(F.col(body))


def _succeeded(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$.success", "boolean"), F.lit(False))


def parse_summary(payloads: DataFrame, body: str = "body",
                  keys: Sequence[str] = ("country", "metric")) -> DataFrame:
    """``result.summary_0`` in either shape -> long rows.

    List form ``[{name, share, requests}]``: share (int or float, 0..1) as a
    double, null when absent; dict form ``{category: value}``: the value as
    text, shown as it is, and no share.  Payloads whose ``success`` is not
    true give no rows.  Output: keys, pos, category, share, requests, value,
    shape.
    """
    keys = list(keys)
    s = F.try_variant_get(_variant(body), "$.result.summary_0", "variant")
    ok = F.coalesce(F.try_variant_get(_variant(body), "$.success", "boolean"), F.lit(False))
    base = spread(payloads).where(ok).select(*keys, s.alias("__s"))
    as_list = F.try_variant_get(F.col("__s"), "$", "array<variant>")
    as_map = F.try_variant_get(F.col("__s"), "$", "map<string,string>")
    lists = base.where(as_list.isNotNull()).select(*keys, F.posexplode(as_list).alias("pos", "__i"))
    lists = lists.select(
        *keys, F.col("pos").cast("long").alias("pos"),
        F.coalesce(F.try_variant_get("__i", "$.name", "string"), F.lit("")).alias("category"),
        F.try_variant_get("__i", "$.share", "double").alias("share"),
        F.coalesce(F.try_variant_get("__i", "$.requests", "bigint"), F.lit(0).cast("bigint")).alias("requests"),
        F.lit(None).cast("string").alias("value"),
        F.lit("list").alias("shape"),
    )
    maps = base.where(as_list.isNull() & as_map.isNotNull()).select(
        *keys, F.posexplode(F.map_entries(as_map)).alias("pos", "__e"))
    maps = maps.select(
        *keys, F.col("pos").cast("long").alias("pos"),
        F.col("__e.key").alias("category"),
        F.lit(None).cast("double").alias("share"),
        F.lit(None).cast("bigint").alias("requests"),
        F.col("__e.value").alias("value"),
        F.lit("dict").alias("shape"),
    )
    return lists.unionByName(maps)


def parse_ranking(payloads: DataFrame, body: str = "body",
                  keys: Sequence[str] = ("country", "metric")) -> tuple[DataFrame, DataFrame]:
    """Domain ranking -> (accepted, rejected).

    The list is ``result.top`` unless that is null or empty, else
    ``result.top_0``.  Category names are joined with ``', '``.  An entry
    without a rank goes to ``rejected`` (the reference crashed mid-section).
    Payloads whose ``success`` is not true give no rows.
    """
    keys = list(keys)
    v = _variant(body)
    top = F.try_variant_get(v, "$.result.top", "array<variant>")
    top0 = F.try_variant_get(v, "$.result.top_0", "array<variant>")
    lst = F.when(F.size(top) > 0, top).otherwise(top0)
    items = spread(payloads).where(_succeeded(v)).select(*keys, F.posexplode(lst).alias("pos", "__i"))
    cats = F.coalesce(F.try_variant_get("__i", "$.categories", "array<variant>"), F.array())
    names = F.transform(cats, lambda c: F.coalesce(F.try_variant_get(c, "$.name", "string"), F.lit("")))
    rows = items.select(
        *keys, F.col("pos").cast("long").alias("pos"),
        F.try_variant_get("__i", "$.rank", "int").alias("rank"),
        F.coalesce(F.try_variant_get("__i", "$.domain", "string"), F.lit("")).alias("domain"),
        F.array_join(names, ", ").alias("categories"),
        F.to_json("__i").alias("raw"),
    )
    ok = rows.where(F.col("rank").isNotNull()).drop("raw")
    bad = rows.where(F.col("rank").isNull()).withColumn("reason", F.lit("missing rank"))
    return ok, bad


def unknown_shape_dump(payloads: DataFrame, body: str = "body", metric: str = "metric",
                       ranking_metric: str = "domain_popularity",
                       keys: Sequence[str] = ("country", "metric")) -> DataFrame:
    """Payloads that match no known shape, kept verbatim as JSON text.

    * ``summary_0`` present but neither a list nor an object;
    * the ranking metric without a usable ``top``/``top_0`` list;
    * any other metric without ``summary_0``: its ``top`` if it has one, else
      the whole result.

    Payloads whose ``success`` is not true are failures, not shapes: they are
    left to ``split_ok_rejected``.
    """
    keys = list(keys)
    v = _variant(body)
    res = F.try_variant_get(v, "$.result", "variant")
    s = F.try_variant_get(v, "$.result.summary_0", "variant")
    has_s = s.isNotNull()
    s_list = F.try_variant_get(s, "$", "array<variant>").isNotNull()
    s_map = F.try_variant_get(s, "$", "map<string,variant>").isNotNull()
    top = F.try_variant_get(v, "$.result.top", "array<variant>")
    top0 = F.try_variant_get(v, "$.result.top_0", "array<variant>")
    has_list = (F.coalesce(F.size(top), F.lit(0)) > 0) | top0.isNotNull()
    is_rank = F.col(metric) == F.lit(ranking_metric)
    unknown = (has_s & ~s_list & ~s_map) | (~has_s & is_rank & ~has_list) | (~has_s & ~is_rank)
    other_top = F.try_variant_get(v, "$.result.top", "variant")
    dumped = (F.when(has_s, F.to_json(s)).when(~is_rank & other_top.isNotNull(), F.to_json(other_top))
              .otherwise(F.to_json(res)))
    return spread(payloads).where(v.isNotNull() & _succeeded(v) & unknown).select(*keys, dumped.alias("raw"))


def request_grid(selection: DataFrame, requests: DataFrame, countries: DataFrame,
                 query_id: str = "query_id", country: str = "Country") -> tuple[DataFrame, DataFrame]:
    """The fetch plan for every (query, country, test), plus skipped names.

    ``requests`` = (query_id, test_names array, horizon int, as_of date).
    Returns (grid, skipped): grid rows carry the alpha-2 code, the test and
    the date window; names without a code are listed in ``skipped``.
    """
    from commsight.operators.joins import country_to_alpha2, expand_tests, never_broadcast, unresolved_keys

    coded = country_to_alpha2(selection, country, countries, out="alpha_2")
    ok = coded.where(F.col("alpha_2").isNotNull())
    grid = expand_tests(ok, requests.select(query_id, "test_names"), query_id)
    win = requests.select(
        query_id,
        F.date_sub(F.col("as_of"), F.col("horizon")).alias("since"),
        F.col("as_of").alias("until"),
        F.concat(F.col("horizon").cast("string"), F.lit("d")).alias("date_range"),
    )
    grid = grid.join(never_broadcast(win), query_id, "inner")
    skipped = unresolved_keys(selection, country, countries)
    return grid, skipped
