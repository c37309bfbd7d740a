"""Exact set-similarity join of documents by a token-group matrix.

Documents are sets of word shingles.  Similar documents are partitioned into
groups; per group the union of its members' index tokens is kept (the
token-group matrix).  A document can have a partner in another group only if
enough of its index tokens lie in that group's union; only such groups are
opened, and the pairs inside that can still reach the threshold are verified
on the whole sets.

Index tokens: two sets with Jaccard similarity of at least t share a token
among the first n - ceil(t n) + 1 of each in any common order of all tokens.
The order is: tokens that few groups hold, by hash; then frequent ones.  It
decides the cost, never the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ByteHash, among, bounded, give_back, materialize, mix64, read, ready, runs_of, texts_of
from .components import components

#: A token that more groups hold is frequent: it goes to the end of the order.
FREQUENT = 16
#: Times that the order is refined (frequent tokens found, prefixes taken anew).
REFINE = 3
#: Seeds of the hash orders whose least hashes put similar documents together.
SEEDS = 4
#: Bytes of text that are hashed at once (a longer text at once by itself).
CHUNK = 1 << 18
#: Rows of ids or tokens up to which a side is broadcast.
BROADCAST_ROWS = 1_000_000
#: Frequent tokens (the most frequent first) that the order may move back;
#: those beyond stay where their hash puts them.
MOVED = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    out, run, size = [], [], 0
    for t in texts:
        r = t.encode()
        if run and size + len(r) > CHUNK:
            out += _sets_of(run, words)
            run, size = [], 0
        run.append(r)
        size += len(r)
    return out + (_sets_of(run, words) if run else [])


def _sets_of(raw: list[bytes], words: int) -> list[np.ndarray]:
    # A space ends each text; every word is then followed by one space.
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    space = _SPACE[data]
    word_start = ~space
    word_start[1:] &= space[:-1]
    keep = ~space
    keep[1:] |= ~space[:-1]
    ends_of_text = np.cumsum([len(r) + 1 for r in raw])
    starts = np.flatnonzero(word_start)
    first = np.searchsorted(starts, np.concatenate(([0], ends_of_text[:-1])))
    last = np.searchsorted(starts, ends_of_text)
    # Positions in the text without the extra white space.
    place = np.cumsum(keep) - 1
    clean = np.where(space, 32, data)[keep].astype(np.uint8)
    begin = place[starts]
    stop = np.append(begin[1:], len(clean)) if len(begin) else begin
    hashes = ByteHash(clean)
    out = []
    runs = hashes.slices(begin[: len(begin) - words + 1], stop[words - 1:]) if len(begin) >= words else None
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a:b - words + 1].view(np.int64)))
        elif b > a:
            out.append(hashes.slices(begin[a:a + 1], stop[b - 1:b]).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def near_keys(s: np.ndarray) -> list[int]:
    """A key per seed that similar sets are likely to share: the two least
    hashes under the seed, and a class of sizes whose bounds shift by seed."""
    keys = []
    for k in range(SEEDS):
        h = mix64(s.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
        least = np.sort(np.partition(h, 1)[:2]) if len(h) > 2 else np.sort(h)
        size = np.uint64(np.floor(np.log(len(s)) / np.log(1.6) + k / SEEDS))
        keys.append(int(mix64(np.array([least[0] ^ mix64(least[-1:] + size)[0]]))[0].astype(np.int64)))
    return keys


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, tokens binary): each document's set as packed sorted hashes."""

    def run(batches):
        for b in batches:
            for part in runs_of(b, 1):
                sets = shingle_sets(texts_of(part.column(1)), words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "tokens"])
        give_back()

    return docs.select("id", "text").mapInArrow(run, "id long, tokens binary")


def prefix_size(n, num: int, den: int):
    """Index tokens of a set of ``n``: n - ceil(n num/den) + 1."""
    return n - (n * num + den - 1) // den + 1


def _summaries(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(id, n, key, minima, prefix) of each document: set size, digest of the
    set, its keys of likeness, its index tokens by hash."""

    def run(batches):
        for b in batches:
            for part in runs_of(b, 1):
                sets = shingle_sets(texts_of(part.column(1)), words)
                minima = [near_keys(s) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                               for s in sets], pa.binary()),
                     pa.array(minima, pa.list_(pa.int64())),
                     pa.array([s[:prefix_size(len(s), num, den)] if len(s) else s for s in sets],
                              pa.list_(pa.int64()))],
                    names=["id", "n", "key", "minima", "prefix"])
        give_back()

    return docs.select("id", "text").mapInArrow(
        run, "id long, n long, key binary, minima array<long>, prefix array<long>")


def _verify(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose whole sets reach the threshold."""
    spark = pairs.sparkSession
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    sets = materialize(_sets(among(docs, "id", wanted, BROADCAST_ROWS).dropDuplicates(["id"]), words), "sets")

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    ready(spark)
    return both.mapInArrow(run, "a long, b long")


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of their shingle sets
    of at least ``threshold`` (a fraction).

    Returns one row per row of ``docs``: (id, n_shingles long, component_id
    long: the smallest id reachable by links).  Words are what ASCII white
    space separates, A-Z lower-cased; a text of fewer words than a shingle is
    one shingle; a null or blank text has no shingle and no link, its component
    is its own id.  A row without id takes the component of an equal text that
    has one, else null.  Repeated rows each give a row, and so does every text
    of an id that several texts share: each has its own set, links and
    component.  An empty table gives none; other columns are ignored.  Sets are
    compared as 64-bit hashes.
    """
    ready(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not ids_clash(named, "id", "text"):
        out = _joined(named, words, threshold)
    else:
        # Every row goes by a number of its own; ids are its label.
        rows = numbered(named)
        plain = rows.select(F.when(F.col("row.id").isNotNull(), F.col("number")).alias("id"), "row.text")
        found = materialize(_joined(plain, words, threshold), "rows")
        own = rows.select("number", F.col("row.id").alias("label"))
        found = found.join(own, F.col("id") == F.col("number"), "left")
        least = found.where("label IS NOT NULL").groupBy(F.col("component").alias("c")).agg(F.min("label").alias("least"))
        out = found.join(least, F.col("component") == F.col("c"), "left").select(
            F.col("label").alias("id"), "n", F.col("least").alias("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.col("component").alias("component_id"))


def ids_clash(docs: DataFrame, id_col: str, text_col: str) -> bool:
    """Whether an id of ``docs`` stands for different texts (null and empty
    are the same)."""
    h = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    found = docs.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("i")).agg(
        F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi")
    return found.limit(1).count() > 0


def numbered(docs: DataFrame) -> DataFrame:
    """(row: all columns of ``docs``, number long), written once, so that a
    row keeps its number."""
    return materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                   F.monotonically_increasing_id().alias("number")), "numbered")


def _joined(docs: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """(id, n, component) of ``docs`` (id, text), whose ids each stand for one
    text."""
    num, den = threshold
    rows = materialize(_summaries(docs, words, num, den), "summaries")
    # Equal sets are one class; its smallest id stands for it from here on.
    classes = materialize(rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("rep")).where("rep IS NOT NULL"), "classes")
    reps = among(rows, "id", classes.select("rep"), BROADCAST_ROWS)

    # Groups: documents that share a key of likeness are compared with the
    # first of them; links make the groups.
    minima = reps.select("id", "n", F.posexplode("minima").alias("seed", "least"))
    pivots = minima.groupBy("seed", "least").agg(
        F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("c")).where("c > 1").select(
        "seed", "least", F.col("p.id").alias("b"), F.col("p.n").alias("m"))
    near = minima.join(pivots, ["seed", "least"]).where(
        (F.col("id") != F.col("b")) & _sizes_fit("n", "m", num, den)).select(F.col("id").alias("a"), "b")
    links = materialize(_verify(near, docs, words, num, den), "links")
    groups = materialize(components(links), "groups")

    index = _matrix(reps, groups, docs, words, num, den)
    found = _verify(_candidates(index, num, den), docs, words, num, den)
    roots = components(links.unionAll(found))
    named = classes.join(bounded(roots, BROADCAST_ROWS), F.col("rep") == F.col("node"), "left").select(
        F.col("key").alias("k"), F.coalesce("root", "rep").alias("c"))
    return rows.select("id", "n", "key").join(named, F.col("key") == F.col("k"), "left").select(
        "id", "n", F.coalesce("c", "id").alias("component"))


def _sizes_fit(n: str, m: str, num: int, den: int):
    return (F.least(n, m) * den >= F.greatest(n, m) * num)


def _shared(rows: DataFrame) -> DataFrame:
    """Tokens of ``rows`` (token, grp, ...) that more than one group holds."""
    return rows.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where(
        "lo <> hi").select("token")


def _matrix(reps, groups, docs, words, num, den) -> DataFrame:
    """(token, id, grp, n, hot, pos) of the index tokens that several groups
    hold: ``hot`` counts those of the document that were moved back, ``pos`` is
    such a token's place among all the document's index tokens."""
    owner = bounded(groups.select(F.col("node").alias("id"), "root"), BROADCAST_ROWS)
    index = reps.join(owner, "id", "left").select(
        "id", F.coalesce("root", "id").alias("grp"), "n", F.explode("prefix").alias("token"))
    known = materialize(_shared(index), "shared")
    cells = materialize(among(index, "token", known, BROADCAST_ROWS), "cells")
    moved = np.empty(0, np.int64)
    for _ in range(REFINE):
        held = cells.select("token", "grp").distinct().groupBy("token").agg(F.count("*").alias("held")).where(
            F.col("held") > FREQUENT)
        if len(moved):
            held = among(held, "token", moved, how="left_anti")
        # At most MOVED numbers of eight bytes each.
        new = held.orderBy(F.desc("held"), "token").limit(MOVED - len(moved)).select("token").toPandas()["token"]
        new = np.sort(new.to_numpy(np.int64))
        if not len(new):
            break
        # Where one token of a passage is frequent its others mostly are, too:
        # each document touched shows as many tokens past its prefix as it may
        # need instead, so that a passage moves back in a round or two.
        touched = materialize(among(cells, "token", new).groupBy(
            "id", "grp").agg(F.count("*").alias("f")), "touched")
        ahead = among(_often(docs.join(bounded(touched, BROADCAST_ROWS), "id"), moved, words, num, den), "token",
                      np.concatenate((moved, new)), how="left_anti")
        ahead = ahead.orderBy(F.desc("held"), "token").limit(MOVED - len(moved) - len(new)).select("token").toPandas()
        new = np.sort(np.concatenate((new, ahead["token"].to_numpy(np.int64))))
        # Some documents have the tokens ahead in front.
        touched = materialize(among(cells, "token", new).select("id", "grp", "n").distinct(), "touched")
        now = np.sort(np.concatenate((moved, new)))
        fresh = materialize(_reordered(touched, moved, now, docs, words, num, den), "fresh")
        # What other documents hold of tokens that are new to the matrix.
        unseen = materialize(fresh.select("token").distinct().join(known, "token", "left_anti"), "unseen")
        others = among(index, "token", unseen, 2 * BROADCAST_ROWS)
        cells = materialize(among(cells, "token", new, how="left_anti").unionByName(fresh).unionByName(others), "cells")
        known = known.unionAll(unseen)
        moved = now
    shared = materialize(_shared(cells), "shared")
    if not len(moved):
        return materialize(among(cells, "token", shared, BROADCAST_ROWS).withColumns(
            {"hot": F.lit(0).cast("long"), "pos": F.lit(None).cast("long")}), "matrix")
    # Tokens moved back come after a document's other index tokens, by hash:
    # their places follow from all that it has of them, also those that only
    # its own group holds.
    own = Window.partitionBy("id")
    size = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    late = among(cells, "token", moved).select("id", "token", "n").distinct()
    late = late.select("id", "token", (size - F.count("*").over(own) + F.row_number().over(
        own.orderBy("token"))).alias("pos"))
    late = materialize(among(late, "token", shared, BROADCAST_ROWS), "late")
    hot = materialize(late.groupBy("id").agg(F.count("*").alias("hot")), "hot")
    return materialize(among(cells, "token", shared, BROADCAST_ROWS).join(late, ["id", "token"], "left").join(
        bounded(hot, BROADCAST_ROWS), "id", "left").select(
        "token", "id", "grp", "n", F.coalesce("hot", F.lit(0)).alias("hot"), "pos"), "matrix")


def _in_order(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """A sorted set with the tokens of ``late`` (sorted) last."""
    if not len(late):
        return s
    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
    back = late[at] == s
    return np.concatenate((s[~back], s[back]))


def _member(s: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``s`` stand in ``of`` (sorted)."""
    if not len(of):
        return np.zeros(len(s), bool)
    return of[np.minimum(np.searchsorted(of, s), len(of) - 1)] == s


def _ahead(s: np.ndarray, f: int, late: np.ndarray, num: int, den: int) -> np.ndarray:
    """Tokens of a sorted set past its index tokens, of which ``f`` will move
    back: half as many again as take their places if tokens go on to be
    frequent at that rate."""
    s, size = _in_order(s, late), prefix_size(len(s), num, den)
    return s[size:] if f >= size else s[size:size + 2 + f * size * 3 // (2 * (size - f))]


def _often(touched: DataFrame, moved: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """(token, held) of the tokens ahead of ``touched`` (id, text, grp, f) that
    more than FREQUENT of its rows and more than one group show.  Tasks count
    what a batch shows before the shuffle."""
    shared = touched.sparkSession.sparkContext.broadcast(moved)

    def run(batches):
        for b in batches:
            for part in runs_of(b, 2):
                sets = [_ahead(s, f, shared.value, num, den) for s, f in zip(
                    shingle_sets(texts_of(part.column(2)), words), part.column(1).to_pylist(), strict=True)]
                grp, tokens = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets]), np.concatenate(sets)
                if not len(tokens):
                    continue
                order = np.argsort(tokens, kind="stable")
                tokens, grp = tokens[order], grp[order]
                first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens[first]), pa.array(np.diff(first, append=len(tokens))),
                     pa.array(np.minimum.reduceat(grp, first)), pa.array(np.maximum.reduceat(grp, first))],
                    names=["token", "c", "lo", "hi"])
        give_back()

    return touched.select("grp", "f", "text").mapInArrow(run, "token long, c long, lo long, hi long").groupBy(
        "token").agg(F.sum("c").alias("held"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(
        (F.col("held") > FREQUENT) & (F.col("lo") != F.col("hi"))).select("token", "held")


def _reordered(touched: DataFrame, before: np.ndarray, now: np.ndarray, docs: DataFrame, words,
               num, den) -> DataFrame:
    """What the index tokens of the ``touched`` documents gain, and which of
    the tokens moved back they keep, as the tokens in ``now`` instead of those
    in ``before`` come last."""
    shared = docs.sparkSession.sparkContext.broadcast((before, now))

    def run(batches):
        before, now = shared.value
        for b in batches:
            for part in runs_of(b, 3):
                out = []
                for s in shingle_sets(texts_of(part.column(3)), words):
                    size = prefix_size(len(s), num, den)
                    old, new = _in_order(s, before)[:size], _in_order(s, now)[:size]
                    out.append(new[~_member(new, np.sort(old)) | _member(new, now) & ~_member(new, before)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(out, pa.list_(pa.int64()))],
                    names=["id", "grp", "n", "prefix"])
        give_back()

    rows = docs.join(bounded(touched, BROADCAST_ROWS), "id").select("id", "grp", "n", "text")
    # Repeated rows of a document give their tokens once.
    return rows.mapInArrow(run, "id long, grp long, n long, prefix array<long>").select(
        "id", "grp", "n", F.explode("prefix").alias("token")).distinct()


def _candidates(cells: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of documents of different groups that can be similar.

    A pair of sizes n, m needs an overlap of num (n + m) / (num + den).  Past
    the index tokens of the one whose prefix ends first, all its other tokens
    may be shared; the index tokens must make up the rest.
    """
    def others(n: str):
        # Tokens of a set of n that are no index tokens.
        return F.ceil(F.col(n) * num / den) - 1

    def need(n, m):
        return F.ceil((n + m) * num / (num + den))

    unions = cells.groupBy("token", "grp").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("first")).withColumnRenamed("grp", "other")
    n, hi = F.col("n"), F.col("hi")
    # The least size that a partner can have: the group's least, or the least
    # that the threshold allows; and the largest one.
    least = F.greatest(F.col("lo"), F.ceil(n * num / den))
    most = F.least(hi, F.floor(n * den / num))
    # Two linked sets share a token within the first n - need + 1 of each: a
    # token moved back only counts if it stands there in both.
    early = F.col("pos").isNull() | ((F.col("pos") <= n - need(n, least) + 1)
                                     & (F.col("first") <= most - need(n, most) + 1))
    # Of two groups the one of the larger id asks.
    hits = cells.join(unions, "token").where((F.col("grp") > F.col("other")) & (hi * den >= n * num)
                                             & (n * den >= F.col("lo") * num) & early)
    bound = hits.groupBy("id", "n", "hot", "other").agg(
        F.count(F.when(F.col("pos").isNull(), 1)).alias("hit"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    qualified = bound.where(F.col("hit") + F.col("hot") + F.greatest(others("n"), others("hi")) >= need(
        n, least)).select(F.col("id").alias("a"), "other")
    x = cells.select("token", F.col("id").alias("a"), "n")
    y = cells.select("token", F.col("id").alias("b"), F.col("n").alias("m"), F.col("grp").alias("other"))
    opened = x.join(qualified, "a").join(y, ["token", "other"]).where(_sizes_fit("n", "m", num, den))
    pairs = opened.groupBy("a", "b", "n", "m").agg(F.count("*").alias("hit")).where(
        F.col("hit") + F.greatest(others("n"), others("m")) >= need(F.col("n"), F.col("m")))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def op10_jaccard_join(spark, sf_dir):
    """Components of documents linked at a similarity of 0.8 of five-word shingles."""
    return similarity_join(read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT n.doc_id, n.n AS n_shingles, c.component_id
FROM n JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1) c ON c.doc_id = n.doc_id
"""
