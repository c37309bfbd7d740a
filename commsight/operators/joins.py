"""Joins and the country reference dimension.

Broadcasts are only requested for sides whose size has been *checked* (a
``limit(n + 1).count()`` job); anything larger stays a shuffle join, and AQE
may still turn it into a broadcast join from measured runtime sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commsight.session import materialize, spread

# A dimension of this many rows or fewer may be broadcast.
DEFAULT_BROADCAST_ROWS = 100_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast-hint ``df`` only if a count proves it has <= ``max_rows`` rows."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the questions: both sides are
    shuffled.  Rows of questions have few distinct values, so their files and
    shuffles are a few MB per million; Spark, which goes by these sizes, would
    broadcast the millions through the driver."""
    return df.hint("merge")


def settled(df: DataFrame, name: str, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``df`` as the side that many rows meet: written once, then broadcast if
    it has <= ``max_rows`` rows, else shuffled (and the many rows with it)."""
    kept = materialize(df, name)
    return F.broadcast(kept) if kept.count() <= max_rows else never_broadcast(kept)


def join_products(many: DataFrame, few: DataFrame, key: str, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``many`` joined to ``few`` on ``key``, whose values have many rows on
    both sides, so that the answer is their products.

    ``few`` is broadcast if it has <= ``max_rows`` rows.  If not, a shuffle by
    the key would make one task give out a value's whole product, however
    small what it reads; so the rows of ``many`` are dealt into parts, and each
    part meets a copy of ``few``.
    """
    many, few = spread(many), materialize(few, "few")
    if few.count() <= max_rows:
        return many.join(F.broadcast(few), key)
    try:
        parts = 2 * many.sparkSession.sparkContext.defaultParallelism
    except AttributeError:  # Spark Connect
        parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = many.withColumn("__part", F.pmod(F.xxhash64(*many.columns), F.lit(parts).cast("long")))
    few = few.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    # (A given number of partitions: small ones are not merged again.)
    many, few = (df.repartition(4 * parts, key, "__part") for df in (many, few))
    return many.join(never_broadcast(few), [key, "__part"]).drop("__part")


def semi_join(df: DataFrame, selection: DataFrame, column: str, sel_col: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``column`` is one of the selected values."""
    sc = sel_col or column
    s = selection.select(F.col(sc).alias("__sel")).where(F.col("__sel").isNotNull()).distinct()
    return df.join(s, df[column] == s["__sel"], "left_semi")


# ---------------------------------------------------------------------------
# Country reference.  Codes and English names come from the JVM's
# ISO-3166 list (a rule, not a typed table); the few official names the
# lookup falls back to are fixed values below.
# ---------------------------------------------------------------------------

# Official names used as the third lookup key.
OFFICIAL_NAMES = {
    "US": "United States of America",
    "GB": "United Kingdom of Great Britain and Northern Ireland",
    "RU": "Russian Federation",
    "IR": "Islamic Republic of Iran",
    "KR": "Republic of Korea",
    "KP": "Democratic People's Republic of Korea",
    "VN": "Socialist Republic of Viet Nam",
    "SY": "Syrian Arab Republic",
    "BO": "Plurinational State of Bolivia",
    "VE": "Bolivarian Republic of Venezuela",
    "TZ": "United Republic of Tanzania",
    "LA": "Lao People's Democratic Republic",
    "MD": "Republic of Moldova",
    "CN": "People's Republic of China",
    "TW": "Taiwan, Province of China",
    "PK": "Islamic Republic of Pakistan",
    "IN": "Republic of India",
    "PE": "Republic of Peru",
}

# Short common names where the JVM name is a longer form.
COMMON_NAMES = {
    "CD": "DR Congo",
    "CG": "Congo",
    "MM": "Myanmar",
    "HK": "Hong Kong",
    "MO": "Macao",
    "CI": "Ivory Coast",
    "CZ": "Czech Republic",
    "TR": "Turkey",
}

# Further standard and official names in use, by alpha-2 code.
OTHER_NAMES = {
    "AR": ["Argentine Republic"], "AT": ["Republic of Austria"], "BO": ["Bolivia, Plurinational State of"],
    "BN": ["Brunei Darussalam"], "CD": ["Congo, The Democratic Republic of the", "Democratic Republic of the Congo"],
    "CG": ["Republic of the Congo"], "CH": ["Swiss Confederation"], "CI": ["Republic of Côte d'Ivoire"],
    "CN": ["China"], "CV": ["Cabo Verde"], "CZ": ["Czechia"], "DE": ["Federal Republic of Germany"],
    "DO": ["Dominican Republic"], "DZ": ["People's Democratic Republic of Algeria"], "EG": ["Arab Republic of Egypt"],
    "ET": ["Federal Democratic Republic of Ethiopia"], "FK": ["Falkland Islands (Malvinas)"],
    "FM": ["Micronesia, Federated States of"], "FR": ["French Republic"], "GR": ["Hellenic Republic"],
    "HK": ["Hong Kong Special Administrative Region of China"], "IE": ["Ireland"],
    "IR": ["Iran, Islamic Republic of"], "IT": ["Italian Republic"], "KP": ["Korea, Democratic People's Republic of"],
    "KR": ["Korea, Republic of"], "KG": ["Kyrgyz Republic"], "LA": ["Lao PDR"], "LB": ["Lebanese Republic"],
    "LY": ["Libyan Arab Jamahiriya"], "MD": ["Moldova, Republic of"], "MX": ["United Mexican States"],
    "MK": ["North Macedonia", "Macedonia"], "NG": ["Federal Republic of Nigeria"],
    "NP": ["Federal Democratic Republic of Nepal"], "PS": ["Palestine, State of", "the State of Palestine"],
    "PT": ["Portuguese Republic"], "SA": ["Kingdom of Saudi Arabia"], "SK": ["Slovak Republic"],
    "SZ": ["Swaziland"], "TL": ["East Timor"], "TG": ["Togolese Republic"], "TN": ["Republic of Tunisia"],
    "TR": ["Türkiye", "Republic of Türkiye"], "TZ": ["Tanzania, United Republic of"],
    "UY": ["Eastern Republic of Uruguay"], "VA": ["Holy See (Vatican City State)"],
    "VE": ["Venezuela, Bolivarian Republic of"], "VG": ["Virgin Islands, British"], "VI": ["Virgin Islands, U.S."],
    "VN": ["Viet Nam"], "AE": ["United Arab Emirates"], "LK": ["Democratic Socialist Republic of Sri Lanka"],
    "BD": ["People's Republic of Bangladesh"], "BR": ["Federative Republic of Brazil"], "AU": ["Commonwealth of Australia"],
}
# Long forms that put a title before the name.
TITLES = ("Republic of", "Republic of the", "Kingdom of", "State of", "Islamic Republic of", "Commonwealth of the")

# Short forms people type for a country, by alpha-2 code.
SHORT_ALIASES = [
    ("usa", "US"), ("u s a", "US"), ("uk", "GB"), ("great britain", "GB"), ("britain", "GB"),
    ("uae", "AE"), ("drc", "CD"),
]

_COUNTRY_ROWS: list[tuple] | None = None


def _jvm_country_rows(spark: SparkSession) -> list[tuple]:
    global _COUNTRY_ROWS
    if _COUNTRY_ROWS is None:
        jvm = spark.sparkContext._jvm
        locale = jvm.java.util.Locale
        english = locale.ENGLISH
        rows = []
        for code in locale.getISOCountries():
            name = jvm.java.util.Locale("", code).getDisplayCountry(english)
            if not name or name == code:
                continue
            # The JVM abbreviates and typesets: "Bosnia & Herzegovina", "Côte d’Ivoire".
            name = name.replace(" & ", " and ").replace("St. ", "Saint ").replace("\u2019", "'")
            rows.append((code, name, COMMON_NAMES.get(code), OFFICIAL_NAMES.get(code), OTHER_NAMES.get(code, [])))
        _COUNTRY_ROWS = rows
    return _COUNTRY_ROWS


def countries_dim(spark: SparkSession) -> DataFrame:
    """``(alpha_2, name, common_name, official_name, other_names)``, one
    row per code."""
    return spark.createDataFrame(
        _jvm_country_rows(spark),
        "alpha_2 string, name string, common_name string, official_name string, other_names array<string>",
    )


def country_aliases(countries: DataFrame) -> DataFrame:
    """(alias, canonical) for E1: common and official names, and the short
    forms above, each pointing at the dimension's ``name``."""
    spark = countries.sparkSession
    common = countries.select(F.col("common_name").alias("alias"), F.col("name").alias("canonical"))
    official = countries.select(F.col("official_name").alias("alias"), F.col("name").alias("canonical"))
    short = spark.createDataFrame(SHORT_ALIASES, "alias string, alpha_2 string") \
        .join(bounded_broadcast(countries.select("alpha_2", "name")), "alpha_2") \
        .select("alias", F.col("name").alias("canonical"))
    return common.unionByName(official).unionByName(short).where(F.col("alias").isNotNull())


def _lookup_keys(countries: DataFrame, name_case_insensitive: bool) -> DataFrame:
    """Unpivot the dimension to (key, ci, priority, alpha_2)."""
    ci = F.lit(name_case_insensitive)
    by_name = countries.select(
        F.when(ci, F.lower("name")).otherwise(F.col("name")).alias("__k"),
        ci.alias("__ci"), F.lit(1).alias("__prio"), "alpha_2")
    by_common = countries.select(F.col("common_name").alias("__k"), F.lit(False).alias("__ci"),
                                 F.lit(2).alias("__prio"), "alpha_2")
    by_official = countries.select(F.col("official_name").alias("__k"), F.lit(False).alias("__ci"),
                                   F.lit(3).alias("__prio"), "alpha_2")
    keys = by_name.unionByName(by_common).unionByName(by_official)
    if "other_names" in countries.columns:
        other = countries.select(F.explode("other_names").alias("__k"), F.lit(False).alias("__ci"),
                                 F.lit(4).alias("__prio"), "alpha_2")
        titled = countries.select(F.explode(F.array(*[F.concat(F.lit(t + " "), "name") for t in TITLES])).alias("__k"),
                                  F.lit(False).alias("__ci"), F.lit(5).alias("__prio"), "alpha_2")
        keys = keys.unionByName(other).unionByName(titled)
    return keys.where(F.col("__k").isNotNull())


def resolve_alpha2(names: DataFrame, name_col: str, countries: DataFrame,
                   name_case_insensitive: bool = True) -> DataFrame:
    """J2 core: distinct ``name_col`` values -> (name, alpha_2 or null).

    Priority: name (case-insensitive by default, like the library the
    reference calls), then common name, official name, other names and titled
    long forms (all exact).
    Every probe is an equi-join on (key, mode); no cross product.
    """
    probe = names.select(F.col(name_col).alias("__name")).where(F.col("__name").isNotNull()).distinct()
    probe = probe.select(
        "__name",
        F.explode(F.array(
            F.struct(F.lower("__name").alias("__k"), F.lit(True).alias("__ci")),
            F.struct(F.col("__name").alias("__k"), F.lit(False).alias("__ci")),
        )).alias("__p"),
    ).select("__name", "__p.__k", "__p.__ci")
    keys = bounded_broadcast(_lookup_keys(countries, name_case_insensitive), 10_000)
    hits = probe.join(keys, ["__k", "__ci"], "inner")
    # Lowest priority wins; the code breaks ties so the answer is deterministic.
    best = hits.groupBy("__name").agg(F.min_by("alpha_2", F.struct("__prio", "alpha_2")).alias("alpha_2"))
    return best.withColumnRenamed("__name", name_col)


def country_to_alpha2(df: DataFrame, name_col: str, countries: DataFrame,
                      out: str = "alpha_2", name_case_insensitive: bool = True) -> DataFrame:
    """Add ``out`` = ISO alpha-2 code of ``name_col`` (null when unknown)."""
    resolved = settled(resolve_alpha2(df, name_col, countries, name_case_insensitive), "codes")
    resolved = resolved.withColumnRenamed("alpha_2", out).withColumnRenamed(name_col, "__rn")
    j = df.join(resolved, df[name_col] == resolved["__rn"], "left")
    return j.drop("__rn")


def alpha2_to_country(df: DataFrame, code_col: str, countries: DataFrame, out: str = "country") -> DataFrame:
    """Add ``out`` = standard name of the (upper-cased) code; null if absent."""
    dim = bounded_broadcast(countries.select(F.col("alpha_2").alias("__a2"), F.col("name").alias(out)), 10_000)
    return df.join(dim, F.upper(df[code_col]) == dim["__a2"], "left").drop("__a2")


def unresolved_keys(df: DataFrame, name_col: str, countries: DataFrame,
                    name_case_insensitive: bool = True) -> DataFrame:
    """Distinct names that have no code (the ones the pipeline skips)."""
    names = df.select(name_col).where(F.col(name_col).isNotNull()).distinct()
    resolved = resolve_alpha2(df, name_col, countries, name_case_insensitive)
    return names.join(resolved, name_col, "left_anti")


def expand_tests(selection: DataFrame, requests: DataFrame, key: str = "query_id",
                 tests_col: str = "test_names", out: str = "test_name") -> DataFrame:
    """The request grid (every test x every selected country) per query.

    The reference nests two loops; here each query's test list is an array
    column, so the grid is an equi-join on the query key plus ``explode`` -
    no Cartesian product between tables.
    """
    r = requests.select(key, F.explode(F.array_distinct(tests_col)).alias(out))
    return selection.join(never_broadcast(r), key, "inner")


def zip_results(requests: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pair each request with its result by key, never by position.

    A request with no result keeps null result columns (a failed fetch).
    """
    return requests.join(results, list(keys), "left")


def zip_outcomes(requests: DataFrame, results: DataFrame, failures: DataFrame | None, keys: Sequence[str],
                 reason: str = "reason") -> DataFrame:
    """J6 + S12: each request with its result, and how its fetch ended.

    ``outcome`` is ``rows`` (there is a result), ``failed`` (no result, and
    ``failures`` has the keys: ``reason`` says why) or ``empty`` (the fetch
    went well and found nothing), so that a failure is never read as a zero.
    Keys are compared with nulls equal; of several reasons the first in text
    order is told.  A request with a result has no reason.
    """
    keys = list(keys)
    other = [c for c in results.columns if c not in keys]
    found = results.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *other, F.lit(True).alias("__hit"))
    on = lambda right, p: reduce(lambda x, y: x & y, [
        F.col(k).eqNullSafe(right[f"{p}{i}"]) for i, k in enumerate(keys)])
    out = requests.join(never_broadcast(found), on(found, "__k"), "left").drop(*[f"__k{i}" for i in range(len(keys))])
    if failures is None:
        out = out.withColumn(reason, F.lit(None).cast("string"))
    else:
        why = failures.groupBy(*[F.col(k).alias(f"__f{i}") for i, k in enumerate(keys)]).agg(
            F.min(F.coalesce(reason, F.lit("unknown"))).alias("__why"))
        why = settled(why, "reasons")
        out = out.join(why, on(why, "__f"), "left").drop(*[f"__f{i}" for i in range(len(keys))])
        out = out.withColumn(reason, F.when(F.col("__hit").isNull(), F.col("__why"))).drop("__why")
    return out.withColumn("outcome", F.when(F.col("__hit"), "rows").when(
        F.col(reason).isNotNull(), "failed").otherwise("empty")).drop("__hit")
