"""Projections, filters and cleaning steps."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commsight.functions.text import last_token
from commsight.operators.joins import bounded_broadcast
from commsight.operators.sequence import ordered_row_number


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Source header -> stored name; names not in ``df`` are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def replace_values(df: DataFrame, column: str, aliases: Mapping[str, str] | DataFrame,
                   from_col: str = "alias", to_col: str = "canonical") -> DataFrame:
    """Exact whole-value replacement in one column.

    A dict of a few pairs becomes a ``CASE`` expression; a large alias table
    (``from_col``, ``to_col``) is joined (broadcast only under a row bound).
    """
    if isinstance(aliases, Mapping):
        if not aliases:
            return df
        expr = F.col(column)
        chain = None
        for k, v in aliases.items():
            cond = F.col(column) == F.lit(k)
            chain = F.when(cond, F.lit(v)) if chain is None else chain.when(cond, F.lit(v))
        return df.withColumn(column, chain.otherwise(expr))
    a = aliases.select(F.col(from_col).alias("__from"), F.col(to_col).alias("__to")).dropDuplicates(["__from"])
    a = bounded_broadcast(a, 100_000)
    out = df.join(a, df[column] == a["__from"], "left")
    return out.withColumn(column, F.coalesce(F.col("__to"), F.col(column))).drop("__from", "__to")


def filter_in(df: DataFrame, column: str, values: Sequence | DataFrame,
              value_col: str | None = None) -> DataFrame:
    """Keep rows whose ``column`` is in ``values``; exact, nulls dropped.

    A Python list becomes ``IN (...)`` (pushed to the Parquet scan); an empty
    list keeps no rows.  A DataFrame of values becomes a left-semi join.
    """
    if isinstance(values, DataFrame):
        vc = value_col or values.columns[0]
        v = values.select(F.col(vc).alias("__val")).where(F.col("__val").isNotNull())
        return df.join(v, df[column] == v["__val"], "left_semi")
    return df.where(F.col(column).isin(list(values)))


def distinct_values(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Distinct non-null values of one column (partial aggregation per task)."""
    return df.select(F.col(column).alias(out or column)).where(F.col(out or column).isNotNull()).distinct()


def drop_leading(df: DataFrame, n: int, keys: Sequence[str] = (), order: Sequence[str] = ("pos",),
                 width="auto") -> DataFrame:
    """Drop the first ``n`` rows of each source (``rows[n:]``).

    If ``order`` is a 0-based position column with no gaps, this is a plain
    filter; otherwise the skew-safe row number is computed first.
    """
    if len(order) == 1 and order[0] == "pos":
        return df.where(F.col("pos") >= n)
    numbered = ordered_row_number(df, keys, order, width=width, out="__rn")
    return numbered.where(F.col("__rn") > n).drop("__rn")


def country_key(address: str | Column, aliases: Mapping[str, str] | None = None) -> Column:
    """P7 + P2: country key of an address (text after the last comma, lower)."""
    k = last_token(address)
    for src, dst in (aliases or {}).items():
        k = F.when(k == F.lit(src), F.lit(dst)).otherwise(k)
    return k


# Fixed value: the one spelling the data-centre source needs rewritten.
ADDRESS_ALIASES = {"usa": "united states"}


def filter_by_country_key(df: DataFrame, address_col: str, keyword: str | Column,
                          aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Keep cards whose address country equals the searched keyword.

    ``keyword`` is a literal or a column of ``df`` (many keywords at once);
    the comparison is on lower-cased text and the helper key is dropped.
    """
    kw = F.lower(F.lit(keyword)) if isinstance(keyword, str) else F.lower(keyword)
    key = country_key(address_col, ADDRESS_ALIASES if aliases is None else aliases)
    return df.where(key == kw)


def _ts_literal(df: DataFrame, ts_col: str, value) -> Column:
    dt = df.schema[ts_col].dataType
    target = "timestamp_ntz" if isinstance(dt, T.TimestampNTZType) else (
        "date" if isinstance(dt, T.DateType) else "timestamp")
    if isinstance(value, Column):
        return value.cast(target)
    if isinstance(value, (_dt.date, _dt.datetime)):
        value = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast(target)


def horizon_filter(df: DataFrame, ts_col: str, days: int, as_of) -> DataFrame:
    """P10: keep records with ``as_of - days <= ts < as_of``.

    ``as_of`` is a parameter (date, datetime or ISO text), never the wall
    clock, so a rerun gives the same rows.  Bounds are constants and reach
    the Parquet scan as pushed filters.
    """
    if isinstance(as_of, _dt.datetime):
        base = as_of
    elif isinstance(as_of, _dt.date):
        base = _dt.datetime.combine(as_of, _dt.time())
    else:
        base = _dt.datetime.fromisoformat(str(as_of))
    until = _ts_literal(df, ts_col, base)
    since = _ts_literal(df, ts_col, base - _dt.timedelta(days=int(days)))
    return df.where((F.col(ts_col) >= since) & (F.col(ts_col) < until))


def measurement_filters(df: DataFrame, country: str | None = None, test: str | None = None,
                        only_anomalies: bool = False, country_col: str = "probe_cc",
                        test_col: str = "test_name", flag_col: str = "anomaly") -> DataFrame:
    """Optional filters; an unset option filters nothing.

    (The reference always sends ``anomaly=false`` for "all data"; here no
    filter is applied unless anomalies-only is asked for.)
    """
    out = df
    if country:
        out = out.where(F.upper(F.col(country_col)) == F.lit(country.upper()))
    if test:
        out = out.where(F.col(test_col) == F.lit(test))
    if only_anomalies:
        out = out.where(F.coalesce(F.col(flag_col), F.lit(False)))
    return out


def default_typed_empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """An empty table that still has the full output schema."""
    return spark.createDataFrame([], schema)
