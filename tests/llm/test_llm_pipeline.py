"""The pipeline's stages on planted documents, and as a whole."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp

WORDS = {"en": "the river runs past old stones and green fields where people walk every morning".split(),
         "fr": "la rivière coule devant les vieilles pierres et des champs verts où les gens marchent".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, lang, n=60):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", f"{lang}{rng.randrange(300)}"]) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng, rows, labels = random.Random(11), [], []
    for i in range(300):
        lang = "en" if i % 3 else "fr"
        text = prose(rng, lang)
        bad = i % 5 == 0
        if bad:
            text = text.replace(" ", " scumling ", 1) + " scumling " + prose(rng, lang, 5)
        rows.append((i, text, lang, f"src{i % 4}"))
        labels.append((i, 1, int(bad)))
    clean = prose(rng, "en", 80)
    rows += [(1000, clean, "en", "src0"), (1001, clean, "en", "src1"), (1002, clean + " tail", None, None),
             (1003, "12345 --- 678", "en", "src0"), (1004, "", "en", "src0"), (1005, None, None, None),
             (1006, prose(rng, "en") + " s c u m l i n g " + prose(rng, "en"), "en", "src2"),
             (1007, prose(rng, "fr") + " mail jean.dupont@example.org, 10.0.0.7 or +1 (504) 555-2652", "fr", "src3")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    full = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    told = cp.materialize(cp.language(spark, docs, planted), "t")
    assert told.columns == docs.columns and ids(docs) - ids(told) == {1003, 1004, 1005}
    assert {r.doc_id: r.lang for r in told.collect()}[1002] == "en"
    mild = cp.materialize(cp.toxic(spark, told, planted), "t")
    assert mild.columns == docs.columns
    assert ids(told) - ids(mild) == {1006, *range(0, 300, 5)}
    single = cp.materialize(cp.near_duplicates(spark, mild, planted), "t")
    assert single.columns == docs.columns and ids(mild) - ids(single) == {1001, 1002}
    private = cp.materialize(cp.personal_data(spark, single, planted), "t")
    text = {r.doc_id: (r.text, r.n_chars) for r in private.collect()}
    assert private.columns == docs.columns and ids(private) == ids(single)
    assert text[1007][0].endswith("mail [EMAIL], [IP] or [PHONE]") and text[1007][1] == len(text[1007][0])
    pieces = cp.packed(spark, private, planted)
    assert ids(pieces) == ids(private)
    assert [n for n, _ in cp.STAGES] == ["language", "toxicity", "near_duplicates", "personal_data", "packing"]


def test_run(spark, planted):
    out = entry.queries()["pipeline"](spark, planted)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    got = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert got == {i for i in range(300) if i % 5} | {1000, 1007}


def test_rows_without_id(spark, planted):
    docs = spark.createDataFrame([(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27),
                                  (None, "one two three four five six", "en", "a", 27), (None, "else", "en", "a", 4),
                                  (None, "else", "en", "a", 4)], SCHEMA)
    got = sorted((r.doc_id is None, r.text) for r in cp.near_duplicates(spark, docs, planted).collect())
    assert got == [(False, "one two three four five six"), (True, "else")]


def test_texts_under_one_id(spark, planted):
    """Different texts under one id are different documents."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(7, a), (7, b), (7, a), (3, a + " end"), (2, c), (7, ""), (7, ""), (8, None), (None, b), (None, "else")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, planted).collect()), key=str)
    assert got == sorted([(7, b), (3, a + " end"), (2, c), (7, ""), (8, None), (None, "else")], key=str)


def test_near_duplicates_of_nothing(spark, planted):
    none = spark.createDataFrame([], SCHEMA)
    assert cp.near_duplicates(spark, none, planted).collect() == []


def test_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and {"op5_neighbours", "op10_jaccard_join"} <= set(entry.oracle_sql())
