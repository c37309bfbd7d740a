"""Ranking, limits and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commsight.operators.sequence import ordered_row_number


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def every_other_row(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                    width="auto", keep_rn: str | None = None) -> DataFrame:
    """Rows 0, 2, 4 ... of each group, in ``order``.

    Positions come from the bucketed row number, so a hot group is numbered
    by many tasks.
    """
    rn = keep_rn or "__rn"
    d = ordered_row_number(df, keys, order, width=width, out=rn)
    d = d.where((F.col(rn) - 1) % 2 == 0)
    return d if keep_rn else d.drop(rn)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 20,
          rank_col: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    ``row_number() <= n`` lets Spark plan a WindowGroupLimit: every task keeps
    at most ``n`` rows per group *before* the shuffle, so a hot group sends
    only n rows per task.  ``order`` needs a unique tie-breaker.
    """
    rc = rank_col or "__rk"
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    d = df.withColumn(rc, F.row_number().over(w)).where(F.col(rc) <= n)
    return d.withColumn(rc, F.col(rc).cast("long")) if rank_col else d.drop(rc)


def limit_results(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """Cap results per (country, test) request at an integer ``n``."""
    return top_n(df, keys, order, n)


def sort_by_first(df: DataFrame, first: str, tie: Sequence[str], position: str | None = None,
                  width="auto") -> DataFrame:
    """Order by one column descending (nulls last), then ``tie``.

    With ``position`` the rows are not moved into that order but get their
    1-based place in it, which survives being stored (an ordered scan over
    ranges: no task sorts everything).
    """
    order = [F.col(first).desc_nulls_last(), *[F.col(t) for t in tie]]
    return ordered_row_number(df, [], order, width=width, out=position) if position else df.orderBy(*order)


def sort_by_country(df: DataFrame, country: str = "country", tie: Sequence[str] = ("Name", "Link"),
                    position: str | None = None, width="auto") -> DataFrame:
    """Listings alphabetically by country, then a stable tie-break;
    ``position`` as in ``sort_by_first``."""
    order = [country, *tie]
    return ordered_row_number(df, [], order, width=width, out=position) if position else df.orderBy(*order)


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate results whose columns may differ (missing -> null)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dedup_keep_first(df: DataFrame, subset: Sequence[str], order: Sequence[str],
                     error_col: str | None = "error") -> DataFrame:
    """One row per ``subset`` value - the first in ``order``.

    Planned as ``groupBy(subset).min_by(row, order)``, an aggregate with a
    map-side partial phase: a key holding a third of all rows is reduced to
    one row per task before it is shuffled.  Nulls in ``subset`` form one
    group (as pandas does).  Rows carrying an ``error`` are never merged
    (the reference merged every failure into one row because their links
    were all blank).
    """
    cols = df.columns
    row = F.struct(*[F.col(c) for c in cols])
    ordering = F.struct(*[F.col(o) for o in order])
    has_err = error_col is not None and error_col in cols
    good = df.where(F.col(error_col).isNull()) if has_err else df
    firsts = good.groupBy(*subset).agg(F.min_by(row, ordering).alias("__r")).select("__r.*")
    if has_err:
        return firsts.unionByName(df.where(F.col(error_col).isNotNull()))
    return firsts


def error_rows(spark, source: str, message: str, columns: Sequence[str]) -> DataFrame:
    """A failed source becomes one row with ``error`` set and blank fields."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", source string, error string"
    return spark.createDataFrame([tuple([""] * len(columns)) + (source, message)], schema)


def failed_sources(failures: DataFrame, source: Column, message: Column, blank: Sequence[str]) -> DataFrame:
    """U2 for any number of failures at once: each row keeps its columns, has
    ``blank`` fields empty, and tells ``source`` and ``error``."""
    return failures.select("*", *[F.lit("").alias(c) for c in blank], source.alias("source"), message.alias("error"))
