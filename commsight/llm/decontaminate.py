"""Benchmark decontamination with a positional inverted index.

Documents are taken apart into words once; the index stores, per text and
term, the list of the term's places.  A test item is searched by windows of
consecutive words: of each window the terms that are rarest in the corpus are
looked up, their lists are shifted by where the term stands in the item and
intersected, rarest first, so that what is left are places where the item can
start.  With slack the lists are widened before they are intersected, which
gives proximity matches; exact phrases are held against the stored words.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, read

#: Consecutive words of a window.
WINDOW = 10
#: Terms of a window whose lists are intersected, for phrases and proximity.
LISTS, NEAR_LISTS = 2, 4
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), _UPPER, _LOWER),
                                F.lit(_WORD), F.lit(0))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_words, words) of every row, as a table.  The digest
    stands for the text: equal texts are indexed and searched once."""
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(F.coalesce(
        F.col(f"`{text_col}`"), F.lit("")), 256)).alias("digest"), words_of(text_col).alias("words"))
    return materialize(words.select("id", "digest", F.size("words").cast("long").alias("n_words"), "words"), "tokens")


def classes_of(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Test items by their words: (class, words) and (class, item).  Items of
    equal words are searched once; those without words match nothing."""
    each = items.select(F.col(f"`{item_col}`").cast("string").alias("item"), words_of(text_col).alias("words")).where(
        F.size("words") > 0).withColumn("class", F.unhex(F.sha2(F.array_join("words", " "), 256)))
    each = materialize(each, "items")
    return (each.groupBy("class").agg(F.first("words").alias("words")),
            each.where("item IS NOT NULL").select("class", "item").distinct())


def frequencies(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(term, n): how often the whole corpus holds each term of the items."""
    terms = materialize(classes.select(F.explode("words").alias("term")).distinct(), "terms")
    held = rows.select(F.explode("words").alias("term"))
    if terms.count() <= BROADCAST_ROWS:
        held = held.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    else:  # counted before terms meet, as a frequent one may hold most rows
        held = held.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term")
    return materialize(held, "frequencies")


def segments(classes: DataFrame, counts: DataFrame, window: int, lists: int) -> DataFrame:
    """(seg, class, anchors, windows), as a table: the windows of an item that
    have the same rarest terms.  ``anchors`` are up to ``lists`` (n, pos, term),
    rarest first; ``windows`` are (at, words).  A window with a term that the
    corpus lacks is no phrase of it and left out."""
    each = classes.select("class", F.posexplode("words").alias("pos", "term")).join(
        bounded(counts, BROADCAST_ROWS), "term", "left")
    ranked = each.groupBy("class").agg(F.sort_array(F.collect_list(F.struct(
        "pos", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("ranks"))
    k = F.least(F.lit(window), F.size("ranks"))
    ranked = ranked.select("class", "ranks", F.explode(F.sequence(F.lit(0), F.size("ranks") - k)).alias("at"),
                           k.alias("k"))
    part = F.slice("ranks", F.col("at") + 1, F.col("k"))
    order = F.array_sort(F.transform(part, lambda r: F.struct(r["n"], r["pos"], r["term"])))
    each = ranked.select("class", F.slice(order, 1, lists).alias("anchors"), F.struct(
        "at", F.transform(part, lambda r: r["term"]).alias("words")).alias("window")).where(
        F.get("anchors", F.lit(0))["n"] > 0)
    each = each.groupBy("class", "anchors").agg(F.collect_list("window").alias("windows"))
    return materialize(each.withColumn("seg", F.monotonically_increasing_id()), "segments")


def postings(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The index, as a table: (digest, tid, places) of the ``terms`` (term,
    tid) in each text, places ascending.  Copies of a text give its entry
    once."""
    posted = rows.select("digest", F.posexplode("words").alias("pos", "term")).join(
        bounded(terms, BROADCAST_ROWS), "term")
    return materialize(posted.groupBy("digest", "tid").agg(F.sort_array(F.collect_set("pos")).alias("places")),
                       "postings")


def starts(rows: DataFrame, segs: DataFrame, lists: int, slack: int = 0) -> DataFrame:
    """(digest, seg, starts), as a table: where the item of each segment can
    start in each text, so that the segment's rarest terms stand where they
    should, or up to ``slack`` words off the rarest one's place."""
    terms = materialize(segs.select(F.explode("anchors").alias("a")).select("a.term").distinct().withColumn(
        "tid", F.monotonically_increasing_id()), "terms")
    index = postings(rows, terms)

    def nth(i: int) -> DataFrame:
        # The i-th rarest term of each segment that has so many.
        a = F.get("anchors", F.lit(i))
        each = segs.where(F.size("anchors") > i).select("seg", a["term"].alias("term"), a["pos"].alias("off"))
        return materialize(each.join(bounded(terms, BROADCAST_ROWS), "term").select("seg", "tid", "off"), "anchors")

    def shifted(widen: int) -> Column:
        at = F.transform("places", lambda p: p - F.col("off"))
        return at if not widen else F.array_distinct(F.flatten(F.transform(
            at, lambda p: F.sequence(p - widen, p + widen))))

    found = index.join(bounded(nth(0), BROADCAST_ROWS), "tid").select("digest", "seg", shifted(0).alias("starts"))
    for i in range(1, lists):
        more = found.join(bounded(nth(i), BROADCAST_ROWS), "seg", "left")
        alone = more.where("tid IS NULL").select("digest", "seg", "starts")
        both = more.where("tid IS NOT NULL").join(index, ["digest", "tid"]).select(
            "digest", "seg", F.array_intersect("starts", shifted(slack)).alias("starts"))
        found = alone.unionByName(both.where(F.size("starts") > 0))
    return materialize(found, "starts")


def phrases(rows: DataFrame, classes: DataFrame, window: int = WINDOW) -> DataFrame:
    """(digest, class, places), as a table: the words of each text that lie in
    a window of the items of ``class``, once per group of windows."""
    segs = segments(classes, frequencies(rows, classes), window, LISTS)
    found = starts(rows, segs, LISTS)
    known = bounded(materialize(found.select("digest").distinct(), "digests"), BROADCAST_ROWS)
    texts = rows.select("digest", "words").join(known, "digest", "left_semi").dropDuplicates(["digest"])
    both = found.join(bounded(segs.select("seg", "class", "windows"), BROADCAST_ROWS), "seg").join(texts, "digest")

    def same(start: Column, w: Column) -> Column:
        at = start + w["at"]
        return (at >= 0) & (F.slice(F.col("words"), F.greatest(at, F.lit(0)) + 1, F.size(w["words"])) == w["words"])

    # At each start the windows that are there word for word.
    hits = F.flatten(F.transform("starts", lambda s: F.transform(
        F.filter("windows", lambda w: same(s, w)),
        lambda w: F.sequence(s + w["at"], s + w["at"] + F.size(w["words"]) - 1))))
    both = both.select("digest", "class", F.array_distinct(F.flatten(hits)).alias("places"))
    return materialize(both.where(F.size("places") > 0), "phrases")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """How far each whole text repeats test items.

    An item's windows are its runs of ``window`` words, or all its words if it
    has fewer; a word of a text inside any occurrence of a window is hit.
    Returns (id, n_words, n_hit, n_items long: items with occurring windows,
    items_sha256 string: of their ids, sorted as strings, joined by commas,
    contaminated boolean).  A null or wordless text or item has no words and
    matches nothing.  Items of one id are one item; an item without id hits
    words but is not listed.  Repeated rows each give a row, rows without id
    too; other columns are ignored; without items nothing is hit, without
    documents there are no rows.
    """
    rows = tokens(docs, id_col, text_col)
    classes, owners = classes_of(items, item_col, item_text_col)
    found = phrases(rows, classes, window)
    hit = found.select("digest", F.explode("places").alias("place")).distinct().groupBy("digest").agg(
        F.count("*").alias("n_hit"))
    # Texts with the same items share one list of ids.
    sets = found.groupBy("digest").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    listed = sets.select("classes").distinct().select("classes", F.explode("classes").alias("class")).join(
        bounded(owners, BROADCAST_ROWS), "class").groupBy("classes").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    listed = listed.select("classes", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(
        "items", ","), 256).alias("items_sha256"))
    result = materialize(hit.join(sets.join(bounded(listed, BROADCAST_ROWS), "classes", "left").drop("classes"),
                                  "digest"), "result")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return rows.select("id", "digest", "n_words").join(bounded(result, BROADCAST_ROWS), "digest", "left").select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def proximity(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
              slack: int = 3) -> DataFrame:
    """Where texts hold the rarest terms of a window near one another.

    A window's NEAR_LISTS rarest terms (all, if fewer) match around a place of
    the rarest one if every other one stands at most ``slack`` words from where
    the phrase would put it.  Returns distinct (id, item, place of the rarest
    term).  Nulls, wordless and repeated texts as in ``contamination``; rows
    without id count as one document per text.
    """
    rows = tokens(docs, id_col, text_col)
    classes, owners = classes_of(items, item_col, item_text_col)
    segs = segments(classes, frequencies(rows, classes), window, NEAR_LISTS)
    found = starts(rows, segs, NEAR_LISTS, slack)
    rarest = segs.select("seg", "class", F.get("anchors", F.lit(0))["pos"].alias("off"))
    found = found.join(bounded(rarest, BROADCAST_ROWS), "seg").join(
        bounded(owners, BROADCAST_ROWS), "class").select("digest", "item", F.explode(
            F.transform("starts", lambda s: s + F.col("off"))).alias("place")).distinct()
    return rows.select("id", "digest").join(found, "digest").select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "place").distinct()


def op12_decontamination(spark, sf_dir):
    """Words of every document that lie in ten-word windows of test items."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
k AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
dw AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT r, i, k, item_id FROM dw JOIN bw USING (k, g)),
p AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM h) GROUP BY r),
q AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""
