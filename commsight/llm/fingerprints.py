"""Order MinHash fingerprints, in DataFrame functions alone.

A text is a sequence of symbols (runs of at most four characters without white
space).  Its k-mers get an occurrence number, so repeats count; each of the
fingerprint's entries selects the few (k-mer, occurrence) pairs with the
smallest hashes, puts them back in text order and hashes that tuple.  Two texts
agree on an entry if they share the selected k-mers and their order, so the
share of equal entries falls with edit distance, not only with content.

One hash order serves all entries: entry b starts at the b-th fraction of the
hash range and goes round, which is a hash order of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, read

#: Entries of a fingerprint, k-mers per entry, symbols per k-mer.
ENTRIES, PICKED, K = 32, 2, 3
#: Low bits of a packed k-mer hold its position (a row holds fewer symbols).
POSITION_BITS = 30
_HIGH, _LOW = -(1 << POSITION_BITS), (1 << POSITION_BITS) - 1
#: Ids per bucket in which the next document is looked up, buckets per group.
BUCKET, GROUP = 256, 4096
#: Rows of ids up to which the buckets' edges are broadcast.
BROADCAST_ROWS = 1_000_000


def _upper(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_HIGH))


def _packed(h: Column, position: Column) -> Column:
    return _upper(h).bitwiseOR(position.cast("long"))


def with_signature(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds ``out``: array of ENTRIES ints, empty for a text without symbols.
    Every step is a column of its own, as each step looks its array up many
    times."""
    t = "__" + out
    s = F.col(f"{t}_s")
    n = F.size(s)
    short = F.array(_packed(F.xxhash64(F.concat_ws(" ", s)), F.lit(0)))
    grams = F.transform(F.sequence(F.lit(0), n - K), lambda i: _packed(
        F.xxhash64(*[F.get(s, i + j) for j in range(K)]), i))
    df = df.withColumn(f"{t}_s", F.regexp_extract_all(text_col, F.lit(r"(\S{1,4})"), F.lit(1)))
    df = df.withColumn(f"{t}_g", F.sort_array(
        F.when(n >= K, grams).when(n > 0, short).otherwise(F.array().cast("array<bigint>")))).drop(f"{t}_s")
    # Steps of a binary search over the array, the largest first.
    g = F.col(f"{t}_g")
    df = df.withColumn(f"{t}_p", F.transform(
        F.sequence(F.floor(F.log2(F.greatest(F.size(g), F.lit(1)).cast("double"))).cast("int"), F.lit(0), F.lit(-1)),
        lambda j: F.call_function("shiftleft", F.lit(1), j)))
    p = F.col(f"{t}_p")

    def same(i: Column, x: Column) -> Column:
        return _upper(F.get(g, i)) == _upper(x)

    def numbered(x: Column, i: Column) -> Column:
        # Equal k-mers stand together in text order: the number of equal ones
        # before this one is its occurrence number.
        many = F.aggregate(p, F.lit(0), lambda acc, step: F.when(
            (i - acc - step >= 0) & same(i - acc - step, x), acc + step).otherwise(acc))
        occurrence = (F.when((i < 1) | ~same(i - 1, x), F.lit(0))
                      .when((i < 2) | ~same(i - 2, x), F.lit(1)).otherwise(many))
        return _upper(F.xxhash64(_upper(x), occurrence)).bitwiseOR(x.bitwiseAND(F.lit(_LOW)))

    df = df.withColumn(f"{t}_o", F.sort_array(F.transform(g, numbered)))
    o = F.col(f"{t}_o")
    m = F.size(o)

    def entry(b: Column) -> Column:
        # Number of k-mers below the entry's start, by binary search.
        first = F.aggregate(p, F.lit(0), lambda acc, step: F.when(
            (acc + step <= m) & (F.get(o, acc + step - 1) < b), acc + step).otherwise(acc))
        chosen = F.transform(F.sequence(F.lit(0), F.least(F.lit(PICKED), m) - 1),
                             lambda j: F.get(o, (first + j) % m))
        in_order = F.sort_array(F.transform(chosen, lambda x: F.struct(
            x.bitwiseAND(F.lit(_LOW)).alias("at"), _upper(x).alias("h"))))
        return F.shiftright(F.xxhash64(F.transform(in_order, lambda x: x["h"])), 32).cast("int")

    starts = F.array(*[F.lit(-(1 << 63) + b * (1 << 64) // ENTRIES) for b in range(ENTRIES)])
    return df.withColumn(out, F.when(m > 0, F.transform(starts, entry)).otherwise(
        F.array().cast("array<int>"))).drop(f"{t}_g", f"{t}_p", f"{t}_o")


def as_text(signature: Column) -> Column:
    """A signature as hex, eight digits per entry."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(
        x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries; two empty signatures are alike, an empty one
    and another are not."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(
        (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(same / F.lit(float(ENTRIES)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint string) of each whole text.  A null text counts as
    empty; a text without symbols has the empty fingerprint; equal texts have
    equal fingerprints; repeated rows each give a row; other columns are
    ignored."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return with_signature(df, "text", "sig").select(F.col("id").alias(id_col), as_text(F.col("sig")).alias("fingerprint"))


def _edges(docs: DataFrame) -> DataFrame:
    """(bucket, id): for every bucket the id that follows its smallest one in
    descending order; after the smallest of all comes the largest."""
    heads = docs.where("id IS NOT NULL").groupBy(F.expr(f"id div {BUCKET} - cast(id % {BUCKET} < 0 as int)").alias("bucket")).agg(
        F.max("id").alias("first"))
    heads = heads.withColumn("grp", F.floor(F.col("bucket") / GROUP))
    tops = heads.groupBy("grp").agg(F.max("first").alias("first"))
    # One row per BUCKET * GROUP ids.
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("grp"))
    tops = tops.select("grp", F.coalesce(
        F.lead("first").over(down), F.max("first").over(Window.partitionBy(F.lit(0)))).alias("below"))
    inside = Window.partitionBy("grp").orderBy(F.desc("bucket"))
    return heads.withColumn("next", F.lead("first").over(inside)).join(tops, "grp").select(
        "bucket", F.coalesce("next", "below").alias("next"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, in which the last
    floor(n/3) of its n code points give way to as many first ones (or all) of
    the next document by descending id (after the last one comes the first).

    Returns (id, n_chars, text, edited, sig, edited_sig, next_sig).  A null
    text counts as empty.  Repeated ids follow one another by text.  A row
    without id has no next document: its end is cut off.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    edges = bounded(_edges(docs), BROADCAST_ROWS)
    # The text that follows a bucket's last row stands in the bucket as one
    # more row, so that one deal by bucket serves all.
    bucket = F.expr(f"id div {BUCKET} - cast(id % {BUCKET} < 0 as int)")
    heads = docs.join(edges, F.col("id") == F.col("next")).groupBy("bucket").agg(F.min("text").alias("text"))
    rows = docs.select("id", "text", bucket.alias("bucket"), F.when(F.col("id").isNull(), F.xxhash64(
        "text")).otherwise(0).cast("long").alias("salt"), F.lit(False).alias("extra")).unionByName(heads.select(
            F.lit(None).cast("long").alias("id"), "text", "bucket", F.lit(0).cast("long").alias("salt"),
            F.lit(True).alias("extra")))
    rows = with_signature(rows, "text", "sig")
    order = Window.partitionBy("bucket", "salt").orderBy("extra", F.desc("id"), "text")
    rows = rows.select("*", F.lead("text").over(order).alias("next"), F.lead("sig").over(order).alias("next_sig"))
    rows = rows.where(~F.col("extra"))
    known = F.col("id").isNotNull()
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.select(
        "id", n.cast("long").alias("n_chars"), "text", "sig",
        F.coalesce(F.when(known, F.col("next_sig")), F.array().cast("array<int>")).alias("next_sig"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring(
            F.coalesce(F.when(known, F.col("next")), F.lit("")), F.lit(1), cut)).alias("edited"))
    return with_signature(rows, "edited", "edited_sig").withColumnRenamed("id", id_col)


def op2_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and how alike
    they are to each other and to the next document's."""
    out = edited(read(spark, sf_dir, "documents"))
    sig, other, following = F.col("sig"), F.col("edited_sig"), F.col("next_sig")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(sig).alias("fingerprint"),
        as_text(other).alias("edited_fingerprint"), likeness(sig, other).alias("near_edited"),
        likeness(sig, following).alias("near_next"))
