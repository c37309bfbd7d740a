"""Fill-in-middle: texts cut into prefix, middle and suffix, which change places.

A text lies in one bytearray.  The cuts are scanned, a sentinel goes in before
each of the three segments, and the segments change places by rotating two
neighbouring blocks: each is reversed, then both together.  The same rotation
of the moved blocks undoes it, so the text comes back exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, ready

PREFIX, MIDDLE, SUFFIX = b"<P>", b"<M>", b"<S>"
#: Bytes that change places at once while a block is reversed.
BLOCK = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def reverse(buf: bytearray, lo: int, hi: int) -> None:
    """Reverses ``buf[lo:hi]`` in place; besides the buffer two blocks at most
    are in memory."""
    while hi - lo > 1:
        k = min(BLOCK, (hi - lo) // 2)
        head = buf[lo:lo + k]
        head.reverse()
        tail = buf[hi - k:hi]
        tail.reverse()
        buf[lo:lo + k], buf[hi - k:hi] = tail, head
        lo, hi = lo + k, hi - k


def rotate(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchanges the neighbouring blocks ``buf[lo:mid]`` and ``buf[mid:hi]``."""
    reverse(buf, lo, mid)
    reverse(buf, mid, hi)
    reverse(buf, lo, hi)


def token_ends(raw: bytes) -> np.ndarray:
    """Where each token ends: a word with the ASCII white space before it, or
    the white space that ends the text."""
    if not raw:
        return np.empty(0, np.int64)
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    return np.append(np.flatnonzero(space[1:] & ~space[:-1]) + 1, len(raw))


def code_points(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def arrange(raw: bytes, a: int, b: int, form: str) -> bytes:
    """``raw`` cut at bytes a <= b, as ``form`` (psm or spm) orders it."""
    buf = bytearray(raw)
    buf[b:b] = SUFFIX
    buf[a:a] = MIDDLE
    buf[0:0] = PREFIX
    middle = len(PREFIX) + a
    suffix = middle + len(MIDDLE) + b - a
    rotate(buf, middle if form == "psm" else 0, suffix, len(buf))
    return bytes(buf)


def rearrange(raw: bytes, form: str) -> bytes:
    """The text that ``arrange`` got.  A text with a sentinel of its own is
    never cut, and no sentinel can arise where segments meet."""
    buf, end = bytearray(raw), len(raw)
    if form == "psm":
        at = buf.index(SUFFIX)
        moved = buf.index(MIDDLE, at)
        rotate(buf, at, moved, end)
        suffix = at + end - moved
    else:
        moved = buf.index(PREFIX)
        rotate(buf, 0, moved, end)
        suffix = end - moved
    middle = buf.index(MIDDLE)
    for at, mark in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del buf[at:at + len(mark)]
    return bytes(buf)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "42",
                   percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Cuts every whole text and orders its segments for infilling.

    Four numbers drawn from the digest of seed and id choose two places among
    the n + 1 between tokens, whether the text is cut (``percent``) and whether
    the suffix comes first (``spm_percent``), so a row's result depends on
    nothing else.  Returns (id, n long: tokens, form string: plain, psm or spm,
    prefix_chars, middle_chars long, output string).  A null text counts as
    empty; empty texts and texts that contain a sentinel stay plain.  A null id
    counts as the empty string.  Equal ids draw equal numbers; repeated rows
    each give a row; other columns are ignored; an empty table gives none.
    """
    ready(docs.sparkSession)

    def one(key: str | None, raw: bytes):
        ends = token_ends(raw)
        n = len(ends)
        digest = hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
        if not raw or h3 % 100 >= percent or any(s in raw for s in (PREFIX, MIDDLE, SUFFIX)):
            return n, "plain", None, None, raw
        form = "spm" if h4 % 100 < spm_percent else "psm"
        a, b = (int(ends[c - 1]) if c else 0 for c in sorted((h1 % (n + 1), h2 % (n + 1))))
        return n, form, code_points(raw[:a]), code_points(raw[a:b]), arrange(raw, a, b, form)

    def run(batches):
        for batch in batches:
            rows = [one(k, r or b"") for k, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                                     strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"),
                       F.col(text_col).cast("binary").alias("raw")).mapInArrow(
        run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary").select(
        F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars",
        F.col("output").cast("string").alias("output"))


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` of ``fill_in_middle`` (any with columns form and output) with
    the column ``restored``: the text before it was cut.  A plain output, also
    a null one, is its own text; other columns stay, whatever their names."""
    ready(rows.sparkSession)
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), "form",
                       F.col("output").cast("binary").alias("raw"))

    def run(batches):
        for b in batches:
            texts = [r if r is None or f == "plain" else rearrange(r, f)
                     for f, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], names=["row", "restored"])

    return held.mapInArrow(run, f"row {rows.schema.simpleString()}, restored binary").select(
        "row.*", F.col("restored").cast("string").alias("restored"))


def op11_fill_in_middle(spark, sf_dir):
    """Every document cut for infilling, and digests of the output and of the
    text rebuilt from it."""
    return restore(fill_in_middle(read(spark, sf_dir, "documents"))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''),
    '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
  SELECT doc_id, text, w, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, w,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
s AS (
  SELECT doc_id, text, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m,
    array_to_string(w[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""
