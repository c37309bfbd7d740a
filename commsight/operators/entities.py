"""Entity selection: free text -> keys, and applying a selection.

The reference asks a language model which ``Country`` values a question is
about.  Here the choice is exact and deterministic: a value is selected when
its normalised words (or an alias's, or those of a region it belongs to) occur
as a contiguous phrase in the normalised question.  Of phrases that overlap
the leftmost counts, and of those that start together the longest: "Papua New
Guinea" does not name Guinea.

Questions are taken apart into word n-grams of the lengths that phrases start
with, up to HEAD_WORDS, and joined to the phrases on equality, so the cost is
linear in question text, not questions x values; longer phrases are then held
against the words that follow.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commsight.functions.text import normalize_text, words
from commsight.operators.joins import DEFAULT_BROADCAST_ROWS, bounded_broadcast, never_broadcast
from commsight.session import materialize, spread


def entity_keys(values: DataFrame, value_col: str, aliases: DataFrame | None = None,
                alias_col: str = "alias", canonical_col: str = "canonical") -> DataFrame:
    """(key, n_words, value) for every value and every alias of a present value."""
    vals = values.select(F.col(value_col).alias("value")).where(F.col("value").isNotNull()).distinct()
    keys = vals.select(normalize_text("value").alias("key"), "value")
    if aliases is not None:
        al = aliases.select(normalize_text(alias_col).alias("key"), F.col(canonical_col).alias("value"))
        keys = keys.unionByName(al.join(vals, "value", "left_semi"))
    keys = keys.where(F.col("key") != "").distinct()
    return keys.withColumn("n_words", F.size(F.split("key", " ")))


def region_closure(members: DataFrame, region_col: str = "region", member_col: str = "member") -> DataFrame:
    """(region, member), normalised: everything below each region, at any
    depth.  Each round extends what the last one found by one level, so a
    hierarchy of depth d takes d rounds; circles end."""
    edges = members.select(normalize_text(region_col).alias("region"), normalize_text(member_col).alias("member")).where(
        (F.col("region") != "") & (F.col("member") != "") & (F.col("region") != F.col("member"))).distinct()
    edges = materialize(edges, "members")
    found = last = edges
    while True:
        step = last.select("region", F.col("member").alias("__via")).join(
            edges.select(F.col("region").alias("__via"), "member"), "__via").select("region", "member").distinct()
        last = materialize(step.join(found, ["region", "member"], "left_anti"), "members")
        if last.isEmpty():
            return found
        found = found.unionByName(last)


def with_regions(keys: DataFrame, members: DataFrame) -> DataFrame:
    """``entity_keys`` and the regions as further phrases, each standing for
    the values below it (by value name or alias)."""
    known = keys.select(F.col("key").alias("member"), "value")
    regions = region_closure(members).join(known, "member").select(F.col("region").alias("key"), "value").distinct()
    return keys.unionByName(regions.withColumn("n_words", F.size(F.split("key", " ")))).distinct()


#: Words of a phrase that are looked up; longer ones are held against the text.
HEAD_WORDS = 3


def phrase_spans(questions: DataFrame, phrases: DataFrame, query_id: str = "query_id",
                 text_col: str = "user_query") -> DataFrame:
    """(query_id, start, end, key): where the texts hold the ``phrases`` (key,
    n_words), in words, end exclusive; leftmost first, longest of those that
    start together, none inside or across another.

    Spans are resolved in clusters of overlapping ones, not by text, so a long
    text is not one task's work.  Repeated rows give their spans once.
    """
    heads = phrases.select("key", "n_words", F.array_join(F.slice(F.split("key", " "), 1, HEAD_WORDS), " ").alias(
        "__head")).distinct()
    # One small job gives the head lengths (up to HEAD_WORDS numbers), the
    # longest phrase and the count that bounds the broadcast.
    stats = heads.groupBy(F.least(F.lit(HEAD_WORDS), "n_words").alias("n")).agg(
        F.count(F.lit(1)).alias("keys"), F.max("n_words").alias("longest")).collect()
    if not stats:
        return _empty(questions, query_id, "start int, end int, key string")
    firsts = heads.select(F.substring_index("__head", " ", 1).alias("__first")).distinct()
    if sum(r["keys"] for r in stats) <= DEFAULT_BROADCAST_ROWS:
        heads, firsts = F.broadcast(heads), F.broadcast(firsts)
    # Tokenise once; a word that no phrase starts with goes no further.
    q = spread(questions.select(query_id, text_col)).select(
        query_id, F.xxhash64(query_id, text_col).alias("__t"), words(text_col).alias("__w"))
    n = F.greatest(F.size("__w"), F.lit(1))
    ahead = F.arrays_zip(*[F.slice("__w", k + 1, n).alias(f"__{k}") for k in range(HEAD_WORDS)])
    at = q.select(query_id, "__t", F.posexplode(ahead).alias("start", "__a")).select(query_id, "__t", "start", "__a.*")
    at = at.join(firsts, F.col("__0") == F.col("__first"), "left_semi")
    # (A head that the text's end cuts off is null and joins nothing.)
    grams = [F.concat(*[x for k in range(r["n"]) for x in ([F.lit(" ")] if k else []) + [F.col(f"__{k}")]])
             for r in sorted(stats, key=lambda r: r["n"])]
    hits = at.select(query_id, "__t", "start", F.explode(F.array(*grams)).alias("__head")).join(heads, "__head").drop("__head")
    if max(r["longest"] for r in stats) > HEAD_WORDS:
        short, long = hits.where(F.col("n_words") <= HEAD_WORDS), hits.where(F.col("n_words") > HEAD_WORDS)
        texts = q.select(F.col("__t").alias("__q"), "__w").dropDuplicates(["__q"])
        long = long.join(never_broadcast(texts), F.col("__t") == F.col("__q")).where(F.array_join(F.slice(
            "__w", F.col("start") + 1, F.col("n_words")), " ") == F.col("key"))
        hits = short.unionByName(long.select(hits.columns))
    best = hits.groupBy(query_id, "__t", "start").agg(F.max(F.struct("n_words", "key")).alias("b")).select(
        query_id, "__t", "start", (F.col("start") + F.col("b.n_words")).alias("end"), F.col("b.key").alias("key"))
    # A span that starts beyond all earlier ones begins a cluster.
    text = Window.partitionBy("__t").orderBy("start")
    reach = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("__new", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int"))
    best = best.withColumn("__c", F.sum("__new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    clusters = best.groupBy(query_id, "__t", "__c").agg(F.sort_array(F.collect_list(F.struct(
        "start", "end", "key"))).alias("c"))
    span = "struct<start: int, end: int, key: string>"
    kept = F.aggregate("c", F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{span}>").alias("kept")),
                       lambda acc, x: F.when(x["start"] >= acc["end"], F.struct(
                           x["end"].alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc),
                       lambda acc: acc["kept"])
    return clusters.select(query_id, F.inline(F.when(F.size("c") == 1, F.col("c")).otherwise(kept)))


def match_entities(questions: DataFrame, values: DataFrame, value_col: str = "Country",
                   query_id: str = "query_id", text_col: str = "user_query",
                   aliases: DataFrame | None = None, out: str | None = None,
                   members: DataFrame | None = None) -> DataFrame:
    """(query_id, value) for every value the question names.

    ``values`` may hold repeats and nulls (any table's column); ``aliases``
    maps extra spellings to values (``alias``, ``canonical``); ``members``
    names regions (``region``, ``member``), whose members are values, aliases
    or regions.  Only phrases that ``phrase_spans`` keeps count.
    """
    out = out or value_col
    keys = entity_keys(values, value_col, aliases)
    if members is not None:
        keys = with_regions(keys, members)
    keys = materialize(keys, "keys")
    found = phrase_spans(questions, keys.select("key", "n_words"), query_id, text_col).select(query_id, "key").distinct()
    return found.join(bounded_broadcast(keys.select("key", "value")), "key").select(
        query_id, F.col("value").alias(out)).distinct()


def _empty(questions: DataFrame, query_id: str, fields: str) -> DataFrame:
    own = questions.select(query_id).schema.fields
    return questions.sparkSession.createDataFrame([], T.StructType(own + T.StructType.fromDDL(fields).fields))


def _empty_selection(questions: DataFrame, query_id: str, out: str) -> DataFrame:
    return _empty(questions, query_id, f"`{out}` string")


# The code fences a model may wrap its list in (stripped
# before parsing): a leading fence with an optional python/json/txt tag, and
# a trailing fence.
_FENCE = r"^```(?:python|json|txt)?\n|```$"


def parse_model_list(df: DataFrame, text_col: str, out: str = "values") -> DataFrame:
    """Model reply -> array<string>; anything but a list -> empty array.

    Strips one leading fence (with optional language tag) and one trailing
    fence, then parses a JSON-style list; single quotes are accepted and
    numbers become their text.  Python-only literals (``True``, ``None``,
    trailing commas) do not parse and give an empty list.
    """
    s = F.regexp_replace(F.trim(F.col(text_col)), _FENCE, "")
    parsed = F.from_json(s, "array<string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    ok = F.regexp_like(s, F.lit(r"^\s*\[")) & F.regexp_like(s, F.lit(r"\]\s*$"))
    arr = F.when(ok, parsed)
    return df.withColumn(out, F.coalesce(arr, F.array().cast("array<string>")))


def selection_from_first_table(questions: DataFrame, tables: Sequence[tuple[str, DataFrame]],
                               column: str = "Country", query_id: str = "query_id",
                               text_col: str = "user_query",
                               aliases: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """E1 over the first *non-empty* table's values (fixes Q9)."""
    for _, t in tables:
        if not t.isEmpty():
            return match_entities(questions, t, column, query_id, text_col, aliases, out=column, members=members)
    return _empty_selection(questions, query_id, column)


def request_routes(requests: DataFrame, tables: Sequence[tuple[str, DataFrame]], list_col: str = "sql_tables",
                   query_id: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """Which tables each request reads: ((query_id, table, position, first),
    (query_id, table)).

    A request lists its tables by name, in its own order; ``first`` marks the
    first one that has rows, which its selection is made from.  Names that are
    not among ``tables`` read nothing (S1) and are returned as the second
    frame.  A null or empty list stands for all tables in the order given; a
    name that repeats counts where it comes first.
    """
    names = [n for n, _ in tables]
    asked = F.when(F.size(list_col) > 0, F.array_distinct(list_col)).otherwise(F.array(*map(F.lit, names)))
    listed = requests.select(query_id, F.posexplode(asked).alias("position", "table")).distinct()
    known = listed.where(F.col("table").isin(names))
    # One row per table that has any.
    filled = reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("__table")).limit(1) for n, t in tables])
    filled = materialize(filled, "filled")
    best = known.join(F.broadcast(filled), F.col("table") == F.col("__table")).groupBy(query_id).agg(
        F.min("position").alias("__first"))
    routes = known.join(never_broadcast(best.withColumnRenamed(query_id, "__q")), F.col(query_id).eqNullSafe(F.col("__q")), "left")
    routes = routes.select(query_id, "table", "position", F.coalesce(F.col("position") == F.col("__first"), F.lit(
        False)).alias("first"))
    return routes, listed.where(~F.col("table").isin(names) | F.col("table").isNull()).select(query_id, "table")


def selection_by_request(requests: DataFrame, tables: Sequence[tuple[str, DataFrame]], routes: DataFrame,
                         column: str = "Country", query_id: str = "query_id", text_col: str = "user_query",
                         aliases: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """E1 for requests with table lists of their own: (query_id, value) of the
    values of each request's first table that has rows.

    All questions are matched once, against the values of all tables; a value
    then counts where the request's first table holds it.
    """
    held = reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("__table"), F.col(column).alias("__value"))
                                          for n, t in tables]).where("__value IS NOT NULL").distinct()
    held = materialize(held, "values")
    found = match_entities(requests, held, "__value", query_id, text_col, aliases, members=members)
    mine = routes.where("first").select(F.col(query_id).alias("__q"), F.col("table").alias("__table"))
    found = found.join(never_broadcast(mine), F.col(query_id).eqNullSafe(F.col("__q")))
    return found.join(bounded_broadcast(held), ["__table", "__value"]).select(
        query_id, F.col("__value").alias(column)).distinct()


def propagate_by_request(tables: Sequence[tuple[str, DataFrame]], selection: DataFrame, routes: DataFrame,
                         column: str = "Country", query_id: str = "query_id") -> dict[str, DataFrame]:
    """E3 for such requests: each table's rows tagged with the requests that
    list the table and selected the row's value."""
    out = {}
    for name, t in tables:
        lists = routes.where(F.col("table") == name).select(F.col(query_id).alias("__q")).distinct()
        mine = selection.join(lists, F.col(query_id).eqNullSafe(F.col("__q")), "left_semi")
        out[name] = propagate_selection([(name, t)], mine, column, query_id)[name]
    return out


def propagate_selection(tables: Sequence[tuple[str, DataFrame]], selection: DataFrame,
                        column: str = "Country", query_id: str | None = "query_id") -> dict[str, DataFrame]:
    """The one selection filters every table.

    With a ``query_id`` in the selection, rows are tagged with the queries
    that selected them (inner join); without, a left-semi join.
    """
    out = {}
    for name, t in tables:
        if query_id and query_id in selection.columns:
            s = selection.select(query_id, F.col(column).alias("__sel")).distinct()
            out[name] = t.join(s, t[column] == s["__sel"], "inner").drop("__sel")
        else:
            s = selection.select(F.col(column).alias("__sel")).distinct()
            out[name] = t.join(s, t[column] == s["__sel"], "left_semi")
    return out
