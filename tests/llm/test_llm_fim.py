"""Fill-in-middle: rotations, cuts and exact round trips."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from commsight.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(key, text):
    units = UNIT.findall(text)
    n = len(units)
    h = [int(x, 16) for x in re.findall("." * 8, hashlib.sha256(f"42:{key}".encode()).hexdigest())[:4]]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rotations_exchange_blocks(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 3)
    rng = random.Random(1)
    for _ in range(300):
        raw = bytes(rng.randrange(256) for _ in range(rng.randrange(30)))
        lo, mid, hi = sorted(rng.randrange(len(raw) + 1) for _ in range(3))
        buf = bytearray(raw)
        fim.rotate(buf, lo, mid, hi)
        assert bytes(buf) == raw[:lo] + raw[mid:hi] + raw[lo:mid] + raw[hi:]


def test_segments_that_look_like_sentinels_come_back():
    rng = random.Random(2)
    for _ in range(2000):
        raw = "".join(rng.choice("<PSM> é") for _ in range(rng.randrange(1, 12))).encode()
        if any(s in raw for s in (fim.PREFIX, fim.MIDDLE, fim.SUFFIX)):
            continue
        ends = [0, *fim.token_ends(raw).tolist()]
        a, b = sorted((rng.choice(ends), rng.choice(ends)))
        for form in ("psm", "spm"):
            assert fim.rearrange(fim.arrange(raw, a, b, form), form) == raw


def test_equals_plain_strings(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "é", "漢", "😀", " ", "\t\n", "\x0b", "\xa0", "\x1c", "<", "P>", "<M>"])
                     for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["", None, " ", "a", " a ", "long text " * 50_000, "x" * 200_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "of no id"), (-7, "below zero and back")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "row", "raw", "n", "key", "form", "output", "restored"):
        df = df.withColumn(c, F.lit(7))
    got = fim.restore(fim.fill_in_middle(df)).collect()
    want = sorted(((i, *by_hand("" if i is None else i, t or ""), t or "") for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(df.where("false"))).collect() == []
