"""Personal data: fixed kinds by pattern, further terms by what they reveal.

The kinds (email, ip, card, phone) are protected entities.  How strongly a term
reveals one is estimated from the whole corpus: with n(e) documents that hold
an entity, n(t) that hold a term and n(e, t) that hold both among N documents,
copies included, the term tells
log(N n(e,t) / (n(e) n(t))) of the log(N / n(e)) that knowing the entity takes.
Where that share exceeds a threshold the term is generalised, beyond a second
one removed, in the documents that hold the entity.  Everything is DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, read

#: Share of an entity's information from which a term is generalised, removed.
GENERALISE, REMOVE = 0.6, 0.85
#: Documents that must hold both entity and term.
SUPPORT = 3
#: Rows of terms up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: Entries of an array whose running totals are taken at once.
BLOCK = 256

KINDS = ("email", "ip", "card", "phone", "term")

# The patterns of the kinds.  Quantifiers are possessive and
# starts are tied to where a match can start, which changes no match but keeps
# the search linear and its stack flat on very long texts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"(?<!\p{L})\p{L}{3,}(?!\p{L})"


def _running(df: DataFrame, values: str, out: str, step, last: bool) -> DataFrame:
    """Adds ``out``: array of the folds of the array ``values`` (from 0) before
    each entry, and after the last one if ``last``.  Block totals come first,
    so it stays near linear."""
    v, heads = F.col(values), F.col(f"{out}_b")
    n = F.size(values)
    block = lambda i: F.floor(i / BLOCK).cast("int")
    df = df.withColumn(f"{out}_b", F.when(n > 0, F.aggregate(
        F.sequence(F.lit(0), block(n)), F.array(F.lit(0)), lambda acc, k: F.concat(acc, F.array(
            F.aggregate(F.slice(v, k * BLOCK + 1, F.lit(BLOCK)), F.element_at(acc, -1), step))))))
    return df.withColumn(out, F.when(n > 0, F.transform(
        F.sequence(F.lit(0), n if last else n - 1), lambda i: F.aggregate(
            F.slice(v, block(i) * BLOCK + 1, i % BLOCK), F.get(heads, block(i)), step)))).drop(f"{out}_b")


def _located(df: DataFrame, kind: str, pattern: Column, valid, guard: Column) -> DataFrame:
    """Adds ``kind``: array of (start, end, kind, value) of the valid matches
    of ``pattern`` in ``text``, code points, end exclusive."""
    none = F.array().cast("array<string>")
    hits, gaps, starts = f"__{kind}_h", f"__{kind}_g", f"__{kind}_s"
    df = df.withColumn(hits, F.when(guard, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split("text", pattern, -1)).otherwise(none))
    # Code points up to each gap: matches and gaps before it.
    df = df.withColumn(f"{starts}_l", F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(F.col(gaps), i))))
    df = _running(df, f"{starts}_l", starts, lambda acc, x: acc + x, False).drop(f"{starts}_l")
    found = F.transform(hits, lambda h, i: F.struct(
        (F.get(F.col(starts), i) + F.length(F.get(F.col(gaps), i))).alias("start"),
        (F.get(F.col(starts), i) + F.length(F.get(F.col(gaps), i)) + F.length(h)).alias("end"),
        F.lit(KINDS.index(kind)).alias("rank"), h.alias("value")))
    return df.withColumn(kind, F.filter(found, lambda s: valid(s["value"]))).drop(hits, gaps, starts)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _ip(v: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) < 3) | (
        (F.length(part(p)) == 3) & (part(p) <= "255")))


def _card(v: Column) -> Column:
    """14 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = F.reverse(F.split(F.substring(_digits(v), 1, 20), ""))
    number = lambda d: F.coalesce(F.try_to_number(d, F.lit("9")), F.lit(0)).cast("int")
    total = F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(
        i % 2 == 0, number(d)).otherwise(number(d) * 2 - F.when(number(d) > 4, 9).otherwise(0))),
        F.lit(0), lambda acc, x: acc + x)
    return F.length(_digits(v)).between(14, 19) & (total % 10 == 0)


def detect(docs: DataFrame) -> DataFrame:
    """Adds to ``docs`` (with a non-null column ``text``) the arrays email, ip,
    card and phone of (start, end, rank, value)."""
    text = F.col("text")
    docs = _located(docs, "email", F.lit(PATTERNS["email"]), lambda v: F.lit(True), text.contains("@"))
    docs = _located(docs, "ip", F.lit(PATTERNS["ip"]), _ip, text.rlike(r"[0-9]\.[0-9]"))
    docs = _located(docs, "card", F.lit(PATTERNS["card"]), _card, text.rlike(r"[0-9][\x20-]?[0-9]"))
    return _located(docs, "phone", F.lit(PATTERNS["phone"]), lambda v: F.length(_digits(v)).between(10, 15),
                    text.contains("+"))


def _base() -> Column:
    return F.concat("email", "ip", "card", "phone")


def _entity(span: Column) -> Column:
    """What makes two spans the same entity: kind and value without marks."""
    return F.concat(span["rank"].cast("string"), F.lit(":"), F.when(
        span["rank"] >= 2, _digits(span["value"])).otherwise(F.lower(span["value"])))


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, share): how much of an entity's information the terms
    in its documents reveal, for all that exceed GENERALISE.

    ``found`` are the documents with spans (text and ``detect``'s columns);
    counts of terms cover all of ``docs``.  Equal texts are looked at once and
    count as often as they occur.
    """
    digest = F.sha2("text", 256).alias("digest")
    seen = materialize(found.select(digest, F.explode(F.array_distinct(F.transform(_base(), _entity))).alias(
        "entity")).groupBy("digest", "entity").agg(F.count("*").alias("copies")), "seen")
    each = materialize(seen.groupBy("entity").agg(F.sum("copies").alias("sightings")).where(
        F.col("sightings") >= SUPPORT), "entities")
    # Only the texts that hold such an entity are taken apart.
    seen = seen.join(bounded(each.select("entity"), BROADCAST_ROWS), "entity", "left_semi")
    wanted = bounded(materialize(seen.select("digest").distinct(), "digests"), BROADCAST_ROWS)
    words = found.select(digest, "text").join(wanted, "digest", "left_semi").select("digest", F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("words")).dropDuplicates(["digest"])
    both = seen.join(words, "digest").select("entity", "copies", F.explode("words").alias("term")).groupBy(
        "entity", "term").agg(F.sum("copies").alias("both")).where(F.col("both") >= SUPPORT)
    both = materialize(both, "pairs")
    terms = both.select("term").distinct()
    # Documents that hold each term, counted within a task before anything
    # moves; then only terms seen with entities are kept.
    held = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("text"), F.lit(_WORD), F.lit(0)))).alias("term")) if both.limit(1).count() else docs.select(
        F.lit("").alias("term")).limit(0)
    # (An inner join: a semi-join would be pushed below the count.)
    held = held.groupBy("term").agg(F.count("*").alias("holders")).join(bounded(terms, BROADCAST_ROWS), "term")
    n = F.lit(float(max(2, docs.count())))
    return both.join(each, "entity").join(held, "term").select(
        "entity", "term", (F.log(n * F.col("both") / (F.col("sightings") * F.col("holders")))
                           / F.greatest(F.log(n / F.col("sightings")), F.lit(1e-9))).alias("share")).where(
        F.col("share") >= GENERALISE)


def _staged(docs: DataFrame) -> DataFrame:
    """``docs`` with ``detect``'s columns as a table in the shared folder; the
    text only of documents with spans."""
    return materialize(detect(docs).withColumn("text", F.when(F.size(_base()) > 0, F.col("text"))), "found")


def _with_terms(detected: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds to ``detected`` the column ``term``: array of (start, end, rank,
    value) of the disclosing terms in documents that hold the entity; the
    value of a term to be removed is empty."""
    held = found.where(F.col("text").isNotNull())
    reveal = materialize(disclosing_terms(docs, held), "reveal")
    if not reveal.limit(1).count():
        return detected.withColumn("term", F.filter("email", lambda s: F.lit(False)))
    # Terms by text: equal texts hold the same entities.
    by_text = held.select(F.sha2("text", 256).alias("digest"), F.explode(F.transform(
        _base(), _entity)).alias("entity")).distinct().join(bounded(reveal, BROADCAST_ROWS), "entity").groupBy(
        "digest").agg(F.sort_array(F.collect_set("term")).alias("terms"), F.sort_array(F.collect_set(
            F.when(F.col("share") >= REMOVE, F.col("term")))).alias("gone"))
    detected = detected.withColumn("digest", F.when(F.size(_base()) > 0, F.sha2("text", 256))).join(
        bounded(materialize(by_text, "terms"), BROADCAST_ROWS), "digest", "left").drop("digest")
    some = F.coalesce(F.size("terms"), F.lit(0)) > 0
    detected = _located(detected, "term", F.lit(_WORD), lambda v: F.array_contains("terms", F.lower(v)), some)
    # A term inside one of the kinds is covered already.
    detected = detected.withColumn("base", _base())
    term = F.filter("term", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    term = F.transform(term, lambda t: F.struct(t["start"], t["end"], t["rank"], F.when(
        F.array_contains("gone", F.lower(t["value"])), F.lit("")).otherwise(t["value"]).alias("value")))
    return detected.withColumn("term", term).drop("terms", "gone", "base")


def listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"])))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text_col``: the kinds by their
    names in brackets, generalised terms by [TERM], removed ones by nothing.
    Spans that overlap an earlier one go with it.  Null texts stay null; other
    columns stay, whatever their names."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"))
    rows = _with_terms(detect(docs.select(own, F.coalesce(text_col, F.lit("")).alias("text"))), _staged(texts), texts)
    rows = rows.withColumn("spans", F.sort_array(F.transform(F.concat(_base(), "term"), lambda s: F.struct(
        s["start"], s["rank"], s["end"], s["value"])))).select("row", "text", "spans")
    rows = rows.withColumn("ends", F.transform("spans", lambda s: s["end"]))
    rows = _running(rows, "ends", "upto", lambda acc, x: F.greatest(acc, x), True)
    mark = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    pieces = F.transform("spans", lambda s, i: F.when(
        s["start"] >= F.get(F.col("upto"), i), F.concat(
            F.substring(F.col("text"), F.get(F.col("upto"), i) + 1, s["start"] - F.get(F.col("upto"), i)),
            F.when((s["rank"] == KINDS.index("term")) & (s["value"] == ""), F.lit("")).otherwise(
                F.get(mark, s["rank"])))).otherwise(F.lit("")))
    tail = F.substring(F.col("text"), F.element_at("upto", -1) + 1, F.length("text"))
    clean = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    clean = F.when(F.col(f"row.`{text_col}`").isNotNull(), clean)
    return rows.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, email, ip, card, phone, term): the spans of each whole text.  A
    null text has none; repeated rows each give a row."""
    docs = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    found = _staged(docs)
    return _with_terms(found, found, docs).drop("text")


def op4_pii(spark, sf_dir):
    """Personal data in every document: counts, digest and list of spans."""
    out = spans(read(spark, sf_dir, "documents"))
    base = _base()
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.concat(base, "term")).alias("spans"),
        F.size("term").cast("long").alias("n_term"))
