"""Aggregations.

All of them are hash aggregates with a partial (map-side) phase, so a hot
group is reduced inside every task before the shuffle.  Lists per group are
returned long-form (one row per member); a group is never gathered into a
single value here (see ``report.markdown_rows`` for bounded rendering).
"""

from __future__ import annotations

from functools import reduce
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commsight.operators.joins import bounded_broadcast, never_broadcast


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_counts(df: DataFrame, keys: Sequence[str], flag: str | Column = "anomaly",
                  anomalies: str = "anomalies", accessible: str = "accessible") -> DataFrame:
    """A1: anomaly and accessible counts per group; a null flag is accessible."""
    f = F.coalesce(_c(flag), F.lit(False))
    return df.groupBy(*keys).agg(
        F.count_if(f).alias(anomalies),
        F.count_if(~f).alias(accessible),
    )


def half_counts(counts: DataFrame, anomalies: str = "anomalies", accessible: str = "accessible") -> DataFrame:
    """A2: the halved figures the reference displays next to every-other-row
    tables: ceil(rows/2), floor(anomalies/2), ceil(accessible/2)."""
    total = F.col(anomalies) + F.col(accessible)
    return counts.select(
        "*",
        F.ceil(total / 2).cast("long").alias("shown_rows"),
        F.floor(F.col(anomalies) / 2).cast("long").alias("shown_anomalies"),
        F.ceil(F.col(accessible) / 2).cast("long").alias("shown_accessible"),
    )


def anomaly_rate(anomalies: str = "anomalies", accessible: str = "accessible") -> Column:
    """Share of anomalies; null (not an error) when a group has no rows."""
    a = F.col(anomalies).cast("double")
    return F.try_divide(a, a + F.col(accessible).cast("double"))


def anomaly_alerts(counts: DataFrame, threshold: float = 0.05, anomalies: str = "anomalies",
                   accessible: str = "accessible", rate: str = "anomaly_rate") -> DataFrame:
    """A3: groups whose anomaly rate is strictly over ``threshold`` (5 % default)."""
    return counts.withColumn(rate, anomaly_rate(anomalies, accessible)).where(F.col(rate) > F.lit(threshold))


def providers_by_country(sources: Sequence[tuple[str, DataFrame, str, str]],
                         country: str = "Country", provider: str = "provider",
                         kind: str = "kind") -> DataFrame:
    """A4: distinct (country, kind, provider) over several sources.

    ``sources`` = [(kind, df, country_col, name_col)], e.g. operators from the
    mobile-code table and ISPs from the two provider lists.  Blank names are
    dropped.
    """
    parts = [
        d.select(F.col(cc).alias(country), F.lit(k).alias(kind), F.col(nc).alias(provider))
        for k, d, cc, nc in sources
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.where(F.col(provider).isNotNull() & (F.col(provider) != "")).distinct()


def provider_counts(providers: DataFrame, country: str = "Country", kind: str = "kind",
                    provider: str = "provider") -> DataFrame:
    """Companion to A4: number of distinct providers per (country, kind)."""
    return providers.groupBy(country, kind).agg(F.count_distinct(provider).alias("n_providers"))


def source_totals(tagged: DataFrame, source: str = "source", country: str = "Country",
                  item: str | None = None) -> DataFrame:
    """A5: per source, rows, distinct countries and (optionally) distinct items."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(country).alias("n_countries")]
    if item:
        aggs.append(F.count_distinct(item).alias("n_items"))
    return tagged.groupBy(source).agg(*aggs)


def cross_source_coverage(tagged: DataFrame, sources: Sequence[str], source: str = "source",
                          country: str = "Country") -> DataFrame:
    """One row per country, one 0/1 column per source, plus how many
    sources cover it.  ``sources`` is the explicit pivot list (no collect)."""
    d = tagged.select(country, source).where(F.col(country).isNotNull()).distinct()
    p = d.groupBy(country).pivot(source, list(sources)).agg(F.count(F.lit(1)))
    for s in sources:
        p = p.withColumn(s, F.coalesce(F.col(s), F.lit(0)).cast("long"))
    return p.withColumn("n_sources", sum((F.col(s) for s in sources), F.lit(0)).cast("long"))


def metric_pivot(metrics: DataFrame, countries: Sequence[str], metric: str = "metric",
                 category: str = "category", country: str = "country", value: str = "share") -> DataFrame:
    """A7 + W4: per metric, one row per category and one column per country.

    ``countries`` is the explicit, ordered pivot list (the first one drives
    the order).  Rows are ordered by the first country's value, descending,
    nulls last, then by category.
    """
    p = metrics.groupBy(metric, category).pivot(country, list(countries)).agg(F.max(value))
    first = list(countries)[0]
    return p.orderBy(F.col(metric), F.col(first).desc_nulls_last(), F.col(category))


def pivot_by_group(cells: DataFrame, group: Sequence[str], table: str, row: str, column: str, value: str,
                   order: str) -> DataFrame:
    """A7 with columns of each group's own: (group..., table, columns array,
    row, position, cells array).

    ``cells`` are long rows of a text ``value`` per (group, table, row,
    column).  A group's columns are the distinct ``column`` values it has in
    any table, sorted; a row's cells follow them, blank where it has none.
    Rows are numbered per table by ``order`` descending (nulls last), then by
    name.  No list of columns ever reaches the driver: names are gathered per
    group and cells per row, and both meet on the group.
    """
    group = list(group)
    one = cells.groupBy(*group, table, row, column).agg(F.max(value).alias("__v"), F.max(order).alias("__o"))
    names = one.groupBy(*group).agg(F.sort_array(F.collect_set(column)).alias("columns"))
    rows = one.groupBy(*group, table, row).agg(F.map_from_entries(F.collect_list(F.struct(column, "__v"))).alias("__m"),
                                               F.max("__o").alias("__o"))
    w = Window.partitionBy(*group, table).orderBy(F.col("__o").desc_nulls_last(), row)
    rows = rows.withColumn("position", F.row_number().over(w).cast("long"))
    for g in group:
        names = names.withColumnRenamed(g, f"__g_{g}")
    on = reduce(lambda x, y: x & y, [rows[g].eqNullSafe(names[f"__g_{g}"]) for g in group])
    return rows.join(never_broadcast(names), on).select(*group, table, "columns", row, "position", F.transform(
        "columns", lambda c: F.coalesce(F.col("__m")[c], F.lit(""))).alias("cells"))


def completeness_check(tagged: DataFrame, expected: DataFrame, source: str = "source",
                       expected_col: str = "expected_rows") -> DataFrame:
    """Rows per source against expectations -> status ``empty``/``short``/``ok``.

    ``expected`` holds (source, expected_rows); sources with no rows at all
    appear with ``n_rows = 0``.  A writer refuses to replace a table whose
    status is ``empty`` (see ``sources.tables.write_table``).
    """
    counts = tagged.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"))
    exp = bounded_broadcast(expected.select(source, expected_col))
    j = exp.join(counts, source, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))
    status = (F.when(F.col("n_rows") == 0, "empty")
              .when(F.col("n_rows") < F.col(expected_col), "short").otherwise("ok"))
    return j.withColumn("status", status)


def executive_summary(tagged: DataFrame, source: str = "source", country: str = "Country") -> DataFrame:
    """Headline figures for every (country, source), every country and the
    grand total, via ROLLUP.  ``level`` tells the rows apart."""
    r = tagged.rollup(country, source).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.grouping_id().alias("level"),
    )
    return r


def tag_sources(tables: Mapping[str, DataFrame], country: str = "Country",
                source: str = "source", item: str | None = None,
                items: Mapping[str, str] | None = None) -> DataFrame:
    """Union several tables as (source, Country[, item]) for A5/A6/A8/A9."""
    parts = []
    for name, t in tables.items():
        cols = [F.lit(name).alias(source), F.col(country).alias(country)]
        if item:
            cols.append(F.col((items or {}).get(name, item)).cast("string").alias(item))
        parts.append(t.select(*cols))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u
