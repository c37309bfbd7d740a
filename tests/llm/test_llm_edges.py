"""Nulls, empty and long texts, repeated rows, empty tables and clashing
column names, for every operator."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from commsight.llm import bpe, fingerprints, jaccard, langid, neighbours, packing, pii, quality, toxicity, wordpiece
from commsight.llm.common import runs_of

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
ROWS = [(1, "The quick brown fox jumps over the lazy dog", "en", "a"), (2, None, None, None), (3, "", "en", "a"),
        (4, "  \n\t ", None, "b"), (5, LONG, "la", "a"), (6, "x", "en", None),
        (7, "The quick brown fox jumps over the lazy dog", "en", "a"),
        (7, "The quick brown fox jumps over the lazy dog", "en", "a"),
        (None, "The quick brown fox jumps over the lazy dog", None, "a"), (8, "1234 5678", None, "a"),
        (9, "é😀 漢字 ß", "de", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names operators use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for c in ("id", "row", "token", "tokens", "grp", "score", "n", "key", "ids", "spans", "lang_pred", "queue", "part"):
        df = df.withColumn(c, F.lit(7))
    return df.cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_bpe(odd, none):
    got = bpe.round_trip(odd).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t for i, t, *_ in ROWS if i == r.doc_id) or ""
        assert bytes(r.decoded).decode() == text
        assert r.n_tokens == len(r.ids_text.split())
    assert bpe.round_trip(none).collect() == []
    again = bpe.decode(bpe.encode(odd))
    assert sorted(bytes(r.decoded) for r in again.collect()) == sorted((t or "").encode() for _, t, *_ in ROWS)


def test_word_pieces(odd, none):
    got = wordpiece.token_counts(odd)
    assert got.columns == ["doc_id", "n_words", "n_tokens", "n_unknown"]
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ROWS)
    assert rows[2][1:] == rows[3][1:] == rows[4][1:] == (0, 0, 0)
    assert rows[5].n_words == 24000 and rows[5].n_tokens >= 24000
    assert wordpiece.token_counts(none).collect() == []


def test_packing(odd, none):
    pieces = packing.pack(odd, window=64).collect()
    assert sum(r.length for r in pieces if r.doc_id == 2) == 1  # the end id alone
    assert sum(r.length for r in pieces if r.doc_id == 7) == 2 * sum(r.length for r in pieces if r.doc_id == 1)
    whole = {}
    for r in pieces:
        assert len(r.ids) == 4 * r.length
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, parts in whole.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == max(whole)
    assert packing.pack(none).collect() == []


def test_language(odd, none):
    model = langid.fit(odd.where("doc_id <> 9"))
    assert model.languages == ["en", "la"]
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {2, 3, 4, 8}
    assert got[5].lang_pred == "la" and got[1].lang_pred == got[7].lang_pred == got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    unknown = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(odd, unknown).collect()} == {"und"}
    assert langid.predict(none, model).collect() == []
    kept = langid.annotated(odd, model).select("row.*")
    assert kept.columns == odd.columns and kept.count() == len(ROWS)


def test_one_language(spark, odd):
    model = langid.fit(odd.where("lang = 'en'"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}
    assert got[1] == "en" and got[2] == "und"


def labels(spark, column):
    return spark.createDataFrame([(1, 1), (2, 1), (3, 0), (5, 0), (None, 1), (6, None), (7, 0), (7, 1), (99, 1)],
                                 f"doc_id long, {column} int")


def test_quality(spark, odd, none):
    model = quality.fit(odd, labels(spark, "quality"), F.lit(True))
    got = quality.score(odd, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 7, None)}) == 1
    assert quality.score(none, model).collect() == []
    alone = quality.fit(none, labels(spark, "quality").where("false"), F.lit(True))
    assert all(r.score == pytest.approx(0.5) for r in quality.score(odd, alone).collect())


def test_toxicity(spark, odd, none):
    model = toxicity.fit(odd, labels(spark, "toxic"), F.lit(True))
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 7, None)}) == 1
    assert toxicity.score(none, model).collect() == []
    alone = toxicity.fit(none, labels(spark, "toxic").where("false"), F.lit(True))
    assert all(r.score < 0.01 for r in toxicity.score(odd, alone).collect())


def test_join(odd, none):
    got = by_id(jaccard.similarity_join(odd), "n_shingles", "component_id")
    assert got == [(1, 5, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 6, 5), (6, 1, 6), (7, 5, 1), (7, 5, 1), (8, 1, 8),
                   (9, 1, 9), (None, 5, 1)]
    assert jaccard.similarity_join(none).collect() == []


def test_personal_data(odd, none):
    got = by_id(pii.spans(odd), "email", "ip", "card", "phone", "term")
    assert len(got) == len(ROWS) and all(not any(r[1:]) for r in got)
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns
    assert sorted(map(tuple, clean.collect()), key=repr) == sorted(map(tuple, odd.collect()), key=repr)
    assert pii.spans(none).collect() == [] and pii.sanitise(none).collect() == []


def test_fingerprints(odd, none):
    rows = {r.doc_id: r for r in fingerprints.edited(odd).collect()}
    assert rows[2].n_chars == 0 and rows[2].sig == [] and rows[2].edited == ""
    assert rows[None].edited == rows[None].text[:29]  # no next document
    assert rows[1].edited == rows[1].text[:29] + "é😀 漢字 ß"  # after the last comes the first
    assert rows[9].edited == rows[9].text[:5] + "12"
    assert rows[1].sig == rows[7].sig == rows[None].sig and len(rows[1].sig) == fingerprints.ENTRIES
    assert fingerprints.edited(odd).count() == len(ROWS)
    assert fingerprints.edited(none).collect() == []
    marks = fingerprints.fingerprints(odd)
    assert {len(r.fingerprint) for r in marks.collect()} == {0, 8 * fingerprints.ENTRIES}


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None),
            (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 1.0, 1.0]), (9, []), (None, [1.0, 0.0]),
            (2, [1.0, 0.0]), (10, [1e200, 1e200]), (100, [1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit(1) for c in ("id", "dim", "score", "grp", "query_id")})
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"))
    ranks = {}
    for r in got.orderBy("query_id", "rank").collect():
        ranks.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 12)))
    half = round(0.5 ** 0.5, 12)
    assert ranks[0] == [(1, 1, 1.0), (2, 2, 1.0), (3, 10, half), (4, 50, 0.0)]
    assert ranks[50] == [(1, 10, half), (2, 0, 0.0), (3, 1, 0.0), (4, 2, 0.0)]
    assert ranks[100] == [(1, 8, round((2 / 3) ** 0.5, 12))]
    assert neighbours.nearest(df, df.where("false")).collect() == []
    assert neighbours.nearest(df.where("false"), df.where("vec_id = 0")).collect() == []


def test_slices_of_a_batch_hold_all_rows_in_order():
    texts = ["a" * 10, None, "b" * 500, "", "c" * 40, "d" * 60, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [p.column(0).to_pylist() for p in runs_of(batch, 0, rows=3, size=100)]
    assert sum(parts, []) == texts
    assert all(len(p) <= 3 and (len(p) == 1 or sum(len(t or "") for t in p) <= 100) for p in parts)
    assert not list(runs_of(batch.slice(0, 0), 0))
