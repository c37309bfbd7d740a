"""Positional index: phrases and proximity against plain search."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from commsight.llm import decontaminate

ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def by_hand(docs, items, window):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            x = words(t)
            k = min(window, len(x))
            for a in range(len(x) - k + 1 if x else 0):
                for at in range(len(w) - k + 1):
                    if w[at:at + k] == x[a:a + k]:
                        hit |= set(range(at, at + k))
                        found |= {str(item)} - {"None"}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit)))
    return sorted(out, key=repr)


def made(seed=1):
    """Texts of few frequent and some rare words, with passages of the items."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "the", "Of", "é", "ÉA", f"w{rng.randrange(60)}"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 7, 12, 25])))) for i in range(25)]
    items += [(3, "a second text of one id, of seven words"), (40, items[5][1]), (41, None), (42, " -- "),
              (None, "an item of no id at all that occurs"), (43, "a a a a a a a a a")]
    docs = []
    for i in range(120):
        parts = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            t = words(rng.choice(items)[1])
            lo = rng.randrange(len(t) + 1)
            parts += t[lo:lo + rng.choice([2, 5, 8, 30])] + [word()]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(200, None), (201, ""), (202, "!!"), (7, docs[7][1]), (None, docs[8][1]), (9, "two texts of one id"),
             (203, "A " * 3000), (204, "filler " * 20_000 + "An item -- of NO id at all, that occurs")]
    return docs, items


def test_phrases_are_those_of_plain_search(spark):
    docs, items = made()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for c in ("id", "digest", "words", "term", "n", "seg", "class", "item"):
        d, b = d.withColumn(c, F.lit(7)), b.withColumn(c, F.lit(7))
    for window in (4, 10):
        got = decontaminate.contamination(d, b, window=window)
        assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(docs, items, window)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    b = spark.createDataFrame([("x", "one two")], "item_id string, text string")
    assert decontaminate.contamination(d.where("false"), b).collect() == []
    row, = decontaminate.contamination(d, b.where("false")).collect()
    assert tuple(row) == (1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    row, = decontaminate.contamination(d, b).collect()
    assert tuple(row) == (1, 2, 2, 1, hashlib.sha256(b"x").hexdigest(), True)


def test_proximity_is_that_of_plain_search(spark):
    docs, items = made(2)
    docs, items = [(i, t) for i, t in docs[:60] if i is not None], [(i, t) for i, t in items[:12]]
    count = {}
    for _, t in docs:
        for w in words(t):
            count[w] = count.get(w, 0) + 1
    want, window, slack = set(), 6, 2
    for item, t in items:
        x = words(t)
        k = min(window, len(x))
        for a in range(len(x) - k + 1):
            rare = sorted((count.get(x[p], 0), p) for p in range(a, a + k))[:decontaminate.NEAR_LISTS]
            if rare[0][0] == 0:
                continue
            for i, text in docs:
                w = words(text)
                for at, v in enumerate(w):
                    if v == x[rare[0][1]] and all(any(
                            w[q] == x[p] for q in range(max(0, at + p - rare[0][1] - slack),
                                                        min(len(w), at + p - rare[0][1] + slack + 1)))
                            for _, p in rare[1:]):
                        want.add((i, str(item), at))
    got = decontaminate.proximity(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame(items, "item_id long, text string"), window=window, slack=slack)
    assert {tuple(r) for r in got.collect()} == want and want
