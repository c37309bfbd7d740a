"""Each operator against a brute-force version, a round trip or held-out rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from commsight.llm import (bpe, common, components, fingerprints, jaccard, langid, neighbours, packing, pii, quality,
                           queries, toxicity, wordpiece)
from commsight.llm.common import materialize

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()


def test_bpe_is_the_library(spark, docs):
    import base64

    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.QUERIES["op8_byte_bpe"](spark, SMALL).collect()}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = own.encode_ordinary(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    codec, rng = bpe.codec(*bpe.defaults()), random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aab \n1'éß😀漢́") for _ in range(rng.randrange(60)))
        assert codec.encode_batch([text]) == [" ".join(map(str, own.encode_ordinary(text)))]
    assert codec.merge(b"ab" * 20000)  # near linear


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert table.candidates(keys).tolist() == list(range(3000))
    assert sorted(table.slot_key.tolist()) == list(range(3000))
    assert bpe.PerfectHash([]).candidates([b"x"]).tolist() == [-1]


def greedy(vocabulary, word):
    rest, n = wordpiece.START + word, 0
    while rest:
        size = max((k for k in range(1, len(rest) + 1) if rest[:k] in vocabulary), default=0)
        if not size:
            return 0
        rest, n = rest[size:], n + 1
    return n


def test_automaton_is_greedy():
    rng = random.Random(2)
    for _ in range(60):
        vocabulary = {"".join(rng.choice("▁ab") if k == 0 else rng.choice("abc") for k in range(rng.randrange(1, 6)))
                      for _ in range(rng.randrange(1, 30))}
        machine = wordpiece.Automaton(vocabulary)
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
            assert machine.count(word) == greedy(vocabulary, word), (vocabulary, word)


def test_token_counts_on_documents(spark, docs):
    import public_tokenizers as p
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    vocabulary = {sp.id_to_piece(i) for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    memo = {}
    got = {r.doc_id: r for r in queries.QUERIES["op3_token_counts"](spark, SMALL).collect()}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        words = text.split()
        for w in words:
            memo.setdefault(w, greedy(vocabulary, w))
        assert got[i].n_words == len(words)
        assert got[i].n_tokens == sum(max(1, memo[w]) for w in words)
        assert got[i].n_unknown == sum(not memo[w] for w in words)


def test_packing_keeps_every_id(spark, docs):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = {i: e.ids + [2] for i, e in zip(docs.doc_id, t.encode_batch(list(docs.text), add_special_tokens=False),
                                           strict=True)}
    rows = queries.QUERIES["op6_packing"](spark, SMALL).collect()
    places, seen = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert r.start == seen.get(r.doc_id, 0) and len(ids) == r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        seen[r.doc_id] = r.start + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(v) for i, v in want.items()}
    total = sum(map(len, want.values()))
    assert sorted(places) == list(range(-(-total // 4096)))
    for s, parts in places.items():
        assert sum(n for _, n in parts) == min(4096, total - 4096 * s)
        ends = [0]
        for offset, n in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + n)


def test_chunks_are_the_tokenizer():
    import public_tokenizers as p

    c = packing.Chunks(p.path("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = ["".join(rng.choice(["don't ", "Ab", "é", "ΣΑΣ", " ", "\n", " ", "\x1c", "12", "!!", "ſ", "漢", "é",
                                 "<|endoftext|>", "İ", "ﬁ"]) for _ in range(rng.randrange(25))) for _ in range(200)]
    want = c.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(i, c.kind).tolist() for i in c.ids(texts)] == [e.ids for e in want]


def test_chunks_split_many_texts_at_once(monkeypatch):
    """Words of plain Latin letters and marks, in any case and between any
    others, in slices of few bytes; no word costs calls of its own."""
    import sys

    import public_tokenizers as p

    monkeypatch.setattr(packing, "SPLIT_BYTES", 40, raising=False)
    c = packing.Chunks(p.path("word_bpe_49k.json"))
    rng = random.Random(8)
    some = [*map(chr, range(0x180)), "'s", "''s", "'LL", "I'VE", "x²y", "½", "\r\n", "\u212a", "H\u0331", "e\u0301", "Ÿ",
            "漢字", "😀", " ", " ", " ", "\n", "Abc", "dÉf", "9", "10", "?!", "\u2019"]
    texts = ["", "\n", " '", *some, *("".join(rng.choices(some, k=rng.randrange(40))) for _ in range(600))]
    texts += [f"a{x}B {x}'s {x}" for x in some]
    want = c.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(i, c.kind).tolist() for i in c.ids(texts)] == [e.ids for e in want]
    assert [np.frombuffer(i, c.kind).tolist() for i in c.ids(texts[::-1])] == [e.ids for e in want[::-1]]
    assert c.ids([]) == [] and c.ids([None, ""]) == [b"", b""]

    monkeypatch.undo()
    texts = [" ".join("".join(rng.choices("abcdéfghij", k=9)) + "," for _ in range(100)) for _ in range(100)]
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        c.ids(texts)
    finally:
        sys.setprofile(None)
    assert calls[0] < 5_000  # 10,000 distinct chunks


def test_what_chunks_remember_is_small():
    import gc
    import tracemalloc

    import public_tokenizers as p

    c = packing.Chunks(p.path("word_bpe_49k.json"))
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(100)) for _ in range(200)]
    gc.collect()
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        c.ids(texts)
        gc.collect()
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    # 20,000 distinct chunks, each a word too; two dicts of Python objects hold more.
    assert held < 120 * 20_000


def test_memo_forgets_the_oldest(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 4)
    made = []

    def make(texts):
        made.extend(texts.to_pylist())
        return pa.array([t.encode() * 2 for t in texts.to_pylist()], pa.large_binary())

    memo = packing.Memo(make, 10)
    rng = random.Random(7)
    for _ in range(300):
        texts = rng.sample([str(i) for i in range(30)] + ["", "x" * 65], rng.randrange(9))
        assert memo(pa.array(texts, pa.large_string())).to_pylist() == [t.encode() * 2 for t in texts]
        assert len(memo) <= 10 and len(memo.parts) <= 4
    n = len(made)
    memo(pa.array(["a", "b", "c"], pa.large_string()))
    memo(pa.array(["c", "b", "d", "a"], pa.large_string()))
    assert made[n:] == ["a", "b", "c", "d"]
    memo(pa.array(["x" * 65], pa.large_string()))
    assert made[-1] == "x" * 65


def test_mixture_is_deficit_round_robin():
    rng = random.Random(4)
    for _ in range(40):
        totals = [rng.choice([1, 5, 60, 700]) for _ in range(rng.randrange(1, 7))]
        weights = totals if rng.random() < 0.5 else [rng.randrange(1, 50) for _ in totals]
        mix, size = packing.Mixture(totals, weights, 16), sum(totals)
        # By hand: always the queue whose next token is due first.
        served, before = [0] * len(totals), [[0] * len(totals)]
        for n in range(1, size + 1):
            _, j = min(((2 * served[j] + 1) / (2 * weights[j]), j) for j in range(len(totals)) if served[j] < totals[j])
            served[j] += 1
            if n % 16 == 0 or n == size:
                before.append(list(served))
        assert [mix.before(w) for w in range(len(before))] == before
        if weights is totals:
            for w, b in enumerate(before):  # carried deficits stay below one token per queue
                n = min(16 * w, size)
                assert all(abs(x - t * n / size) <= 1 + len(totals) / 2 for x, t in zip(b, totals, strict=True))
        for j, t in enumerate(totals):
            cuts = [x for x in mix.pieces(j, 0, t)]
            assert [c[0] for c in cuts] == list(np.cumsum([0, *[c[1] for c in cuts]])[:-1]) and sum(c[1] for c in cuts) == t


def test_targets_hold_until_a_source_ends(spark):
    rows = [(i, "word " * 99, "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(df, window=100, targets={"a": 3, "b": 1}).join(df.drop("text"), "doc_id")
    first = {r.source: r.n for r in pieces.where("sequence_id < 20").groupBy("source").agg(
        F.sum("length").alias("n")).collect()}
    assert first == {"a": 1500, "b": 500}


def test_targets_hold_beside_any_number_of_sources(spark):
    rows = [(i, "word " * 9, f"src{i}") for i in range(1100)]
    rows += [(5000 + i, "word " * 199, ("big", "src0")[i % 2]) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(df, window=256, targets={"big": 1, "src0": 3}).join(df.drop("text"), "doc_id")
    got = pieces.where("source = 'big' AND sequence_id < 300").agg(F.sum("length")).first()[0]
    named, total = 160_010, 171_000
    # A deficit is below a token per queue; without its target big would have 36,000.
    assert abs(got - 300 * 256 * named / total / 4) < packing.MAX_QUEUES + 2


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_join_is_brute_force(spark, monkeypatch):
    """Chains, copies, near copies at the threshold, passages that most share."""
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rng, texts = random.Random(5), {}
    passage = " ".join(f"p{i}" for i in range(30))
    for k in range(30):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 20, 60, 120]))]
        texts[len(texts)] = " ".join(words)
        for _ in range(rng.randrange(5)):
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
            texts[len(texts)] = " ".join(words)
        texts[len(texts)] = passage + " " + " ".join(words[:rng.randrange(1, len(words))])
    for k in range(12):
        texts[len(texts)] = passage + f" q{k} r{k}"
    texts |= {len(texts) + i: t for i, t in enumerate(["", " ", "One  two", "one two", "ONE\ttwo three"])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_join(df).collect()}
    want = classes(texts)
    assert len({c for _, c in want.values()}) < len(texts) - 20
    assert got == want


def test_rows_of_one_id_keep_their_links(spark):
    """Ids that stand for several texts: every row has its own component,
    named by the smallest id in it."""
    rng = random.Random(9)
    a, b, c = ([f"{k}{rng.randrange(300)}" for _ in range(40)] for k in "abc")
    near = lambda w: " ".join([*w[:-1], "end"])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (3, near(a)), (2, near(b)), (9, " ".join(c)), (9, ""), (9, None),
            (7, " ".join(b)), (None, near(c)), (None, "else")]
    got = jaccard.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(7, 36, 3), (7, 36, 2), (3, 36, 3), (2, 36, 2), (9, 36, 9), (9, 0, 9), (9, 0, 9), (7, 36, 2)]
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(want)
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]


def test_one_id_for_all(spark):
    """All rows under one id: no pair of rows is made for it."""
    rows = [(1, " ".join(f"t{k}w{i}" for i in range(12))) for k in range(300)]
    got = jaccard.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 8, 1)] * 300


def test_passages_move_back_at_once(spark, monkeypatch):
    """A long passage that most share: unlinked documents of many groups make
    few candidates, whatever its shingles' hashes."""
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    passage = " ".join(f"p{i}" for i in range(300))
    texts = {k: f"{passage} " + " ".join(f"o{k}x{i}" for i in range(100)) for k in range(60)}
    texts |= {100 + k: texts[k] + " tail" for k in range(0, 60, 6)}
    df = materialize(spark.createDataFrame(list(texts.items()), "id long, text string"), "lines")
    reps = jaccard._summaries(df, 5, 8, 10)
    cells = jaccard._matrix(reps, spark.createDataFrame([], "node long, root long"), df, 5, 8, 10)
    got = {(r.a, r.b) for r in jaccard._candidates(cells, 8, 10).collect()}
    assert got == {(100 + k, k) for k in range(0, 60, 6)}


def test_candidates_hold_every_link(spark, monkeypatch):
    """Short frequent lines, every document its own group (near_keys off)."""
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    texts = {}
    # Lines whose shingles all have low hashes, so that many index them.
    lines = (" ".join(f"l{k}x{i}" for i in range(12)) for k in range(10000))
    for k, line in enumerate(x for x, _ in zip((x for x in lines if jaccard.shingle_sets([x])[0].max() < 0), range(3))):
        words = line.split()
        texts[len(texts)] = line
        texts |= {len(texts) + j: f"{line} a{k}x{j} b{k}x{j}" for j in range(6)}
        texts |= {len(texts) + j: " ".join(words[j % 8:j % 8 + 5]) + f" c{k}x{j}" for j in range(96)}
    df = materialize(spark.createDataFrame(list(texts.items()), "id long, text string"), "lines")
    reps = jaccard._summaries(df, 5, 8, 10)
    cells = jaccard._matrix(reps, spark.createDataFrame([], "node long, root long"), df, 5, 8, 10)
    got = {(r.a, r.b) for r in jaccard._candidates(cells, 8, 10).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    want = {(a, b) for a in sets for b in sets if a > b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert len(want) == 18 and want <= got


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200))
                                                     for _ in range(120)] + [(5, 5)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        digits = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end())] * (14 <= len(digits) <= 19 and luhn(digits))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x)
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_personal_data_is_brute_force(spark, docs):
    rng = random.Random(7)
    texts = dict(zip(docs.doc_id.tolist(), docs.text, strict=True))
    for i in range(400):
        texts[10 ** 6 + i] = "".join(rng.choice("1234567890" * 2 + "@@..--++ ()ab%é😀\n") for _ in range(rng.choice([5, 60, 300])))
    texts[1] = ("a@b.c_d@e.f x@y.z@q.r +1 (504) 555-2652. 4111 1111 1111 1111 255.255.255.255 1.2.3.4.5.6.7.8 "
                "256.1.1.1 00255.1.1.1 +1 (504) 555-26")
    texts[2], texts[3], texts[4], texts[5] = "1" * 50000, "a" * 50000 + "@b.c", "1 " * 50000, "é a@b.co " * 700
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = pii.spans(df).select("doc_id", pii.listed(F.concat("email", "ip", "card", "phone")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: base_spans(t) for i, t in texts.items()}
    clean = pii.sanitise(df.where("doc_id < 1000000")).collect()
    assert not any(base_spans(r.text) for r in clean if r.doc_id != 1)


def test_terms_that_reveal_are_removed(spark):
    rows = [(i, f"w{i}x Zorbax john@example.org also the {i} zorbax zorbaxian .") for i in range(6)]
    rows += [(100 + i, "also the plain text of the others") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s.value for s in r.term] for r in pii.spans(df).collect()}
    assert found[0] == ["", "", ""] and found[100] == []  # zorbax twice, zorbaxian; not "also the"
    assert {r.doc_id: r.text for r in pii.sanitise(df).collect()}[3] == "w3x  [EMAIL] also the 3   ."


def test_terms_count_in_documents(spark):
    """Copies count like other documents, and terms far from the entity too."""
    far = " also the plain text of the others" * 10
    rows = [(i, "quuxar x@copy.org" + far) for i in range(40)]
    rows += [(50 + i, f"d{i} y@far.org" + far + " blorptar") for i in range(4)]
    rows += [(100 + i, "also the plain text of the others") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    reveal = pii.disclosing_terms(df, pii.detect(df).where("size(email) > 0"))
    got = {(r.entity, r.term): r.share for r in reveal.collect()}
    assert got == {("0:x@copy.org", "quuxar"): pytest.approx(1), ("0:y@far.org", "blorptar"): pytest.approx(1)} | {
        k: v for k, v in got.items() if k[1] in ("copy", "far", "org")}


def test_fingerprints_follow_edits(spark, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op2_fingerprints"](spark, SMALL).collect()}
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    ids = sorted(text, reverse=True)
    marks = {}
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        n = len(text[a])
        edited = text[a][:n - n // 3] + text[b][:n // 3]
        assert got[a].n_chars == n and got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert marks.setdefault(text[a], got[a].fingerprint) == got[a].fingerprint
    long = [r for i, r in got.items() if len(text[i]) > 300]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.99


def test_fingerprint_of_selection_is_brute_force(spark):
    """Repeats count, order counts, and the hash order goes round."""
    rows = [(0, "a b c d e f g h"), (1, "a b c d e f g h a b c d e f g h"), (2, "e f g h a b c d"), (3, "a b"), (4, "a  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.with_signature(df, "text", "sig").collect()
    sig = {r.doc_id: r.sig for r in got}
    assert sig[3] == sig[4] and len(set(sig[3])) == 1
    share = lambda a, b: np.mean(np.array(sig[a]) == np.array(sig[b]))
    assert share(0, 1) < 1 and share(0, 2) < 1


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op7_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    held = got.where("held_out AND lang IS NOT NULL")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    assert held.where("ambiguous").count() <= 0.02 * held.count()


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.code_matrix(n)
        far = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert far >= (1 if n == 2 else 2 if n == 3 else code.shape[1] // 4)
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op1_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    held = got.where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() >= 0.95
    assert held.score.between(0, 1).all()


def test_boosting_finds_an_interaction():
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.boost(x, y)
    fresh = rng.uniform(-1, 1, (2000, 3))
    assert ((model.predict(fresh) > 0.5) == (fresh[:, 0] * fresh[:, 1] > 0)).mean() > 0.85
    assert model.pairs[0][:2] == (0, 1)


def test_additive_scores_are_brute_force():
    """Each score is the start and one table entry a feature and pair."""
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(-1, 1, (600, 4)), 1)  # many ties with the cuts
    model = quality.boost(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    place = lambda cuts, v: sum(v >= c for c in cuts)
    for row, got in zip(x, model.predict(x), strict=True):
        z = model.start + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        z += sum(t[place(model.pair_edges[i], row[i]), place(model.pair_edges[j], row[j])] for i, j, t in model.pairs)
        assert got == pytest.approx(1 / (1 + np.exp(-z)))
    assert model.pairs


def test_decoding_is_brute_force():
    """Bits of a text are means over its trigrams with a letter, whatever
    texts stand beside it; the codeword of the least loss wins."""
    rng = np.random.default_rng(4)
    code = langid.code_matrix(4)
    model = langid.Model(list("wxyz"), code, rng.normal(size=(code.shape[1], langid.BUCKETS)),
                         rng.uniform(0.1, 2, code.shape[1]))
    texts = ["One two, three", "", "été 12 漢字", "a", "12 -", "x" * 50, "One two, three"]
    for t, bits, (lang, _, _) in zip(texts, model.bits(texts), model.predict(texts), strict=True):
        raw = [k if 97 <= k <= 122 or k > 127 else 32 for k in (" " + t.lower() + " ").encode()]
        sums, n = np.zeros(code.shape[1]), 0
        for a, b, c in zip(raw, raw[1:], [*raw[2:], 32], strict=False):
            if a != 32 or b != 32:
                h = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) % (1 << 32) >> 16
                sums, n = sums + model.tables[:, h], n + 1
        assert bits == pytest.approx(sums / max(n, 1)), t
        losses = [sum(w * np.log1p(np.exp(-8 * m * k)) for w, m, k in zip(model.trust, bits, row, strict=True))
                  for row in code]
        assert lang == ("wxyz"[int(np.argmin(losses))] if any(map(str.isalpha, t)) else "und")


def test_classes_are_the_decoders(spark):
    """The character model counts characters as the decoder reads them."""
    texts = ["éé", "Straße – naïve “quoted” 漢字 x1", "", None, "a" * 300_000]
    want = np.zeros((toxicity.CLASSES,) * 3)
    whole = [0, 0]
    for t in texts:
        whole += [*map(toxicity._class, (t or "").lower()), 0, 0]
    for a, b, c in zip(whole[2:], whole[3:], whole[4:], strict=False):
        want[a, b, c] += 1
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = toxicity.char_counts(df)
    assert got[1, 1, 1] == 299_998 and got[27, 27, 27] == 0 and got[27, 27, 0] >= 2
    assert np.array_equal(got, want)
    assert not toxicity.char_counts(df.where("false")).any()


def every_spelling(restorer, token):
    """Likeliest spellings by going through all paths of the lattice."""
    paths = [("", 0.0)]
    for c, run in groupby(token):
        n = len(list(run))
        if c.isalpha():
            ways = [(c * min(n, 2), 0.0 if n <= 2 else toxicity.SHORTENED)]
            ways += [(c, toxicity.UNDOUBLED if n == 2 else toxicity.SHORTENED)] if n > 1 else []
        else:
            ways = [("", toxicity.DROPPED_DIGIT if c.isdigit() or c in "@$" else toxicity.DROPPED), (" ", toxicity.SPLIT)]
            for x in toxicity.LOOKS_LIKE.get(c, ""):
                ways += [(x, toxicity.SUBSTITUTED + (toxicity.SHORTENED if n > 1 else 0))]
                ways += [(x * 2, toxicity.SUBSTITUTED)] if n > 1 else []
        paths = [(text + out, cost + more) for text, cost in paths for out, more in ways]

    def score(text, cost):
        k = [0, 0, *map(toxicity._class, text), 0]
        return cost + toxicity.LANGUAGE * sum(restorer.log[a][b][c] for a, b, c in zip(k, k[1:], k[2:], strict=False))

    best = {}
    for text, cost in paths:
        best[text] = max(best.get(text, -1e9), score(text, cost))
    return sorted(best, key=best.get, reverse=True)


def test_viterbi_is_brute_force():
    """The likeliest spelling of all paths is among those decoded."""
    rng = np.random.default_rng(5)
    restorer = toxicity.Restorer(rng.integers(0, 200, (28, 28, 28)).astype(float))
    for _ in range(200):
        token = "".join(rng.choice(list("abeo01!@3$.")) for _ in range(rng.integers(1, 8)))
        assert set(every_spelling(restorer, token)[0].split()) <= restorer.decode(token), token


def test_disguised_words_are_restored():
    counts = np.ones((28, 28, 28))
    words = toxicity.Restorer(counts).words
    for odd, word in (("m0r0n", "moron"), ("stuuupid", "stupid"), ("$tupid", "stupid"), ("i.d.i.o.t", "idiot"),
                      ("tr@sh", "trash"), ("cl0wn!!", "clown"), ("idiot,", "idiot")):
        assert word in words(odd), odd
    assert "idiot" in toxicity.tokens("you i d i o t now") and words("2024") == set()


def test_spaced_words_are_restored():
    table = toxicity._class_table()
    c = table[np.frombuffer(b" you are an idiot and a fool but it is not so bad to ask " * 20, np.uint8)]
    counts = np.zeros((28, 28, 28))
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    model = toxicity.Model(toxicity.Restorer(counts), {"idiot": 3.0, "ass": 3.0, "^idio": 2.0})
    for text in ("y o u i d i o t", "you a s s", "you id iot", "you 1d i0t", "an i d i0 t, so it is", "y o u " * 200 + "i d i o t"):
        assert model.sums(text)[1] == 3.0, text
    assert model.sums("it is as so bad")[1] == 0.0
    windows = toxicity._windows("".join(chr(0x4E00 + i) for i in range(1000)))
    assert all(any(chr(0x4E00 + i) in w and chr(0x4E00 + i + 127) in w for w in windows) for i in range(873))


def plain_sums(model, text):
    """As ``Model.sums``, token by token and of every pair of pieces."""
    out = text.lower().split()
    own = [w for w in toxicity.tokens(text) if " " not in w]
    runs = [list(g) for short, g in groupby(out, key=lambda w: len(w) <= toxicity.PIECE) if short]
    assert [w for w in toxicity.tokens(text) if " " in w] == [" ".join(r) for r in runs if len(r) > 1]
    got = [model.of_token(w) for w in own]
    for pieces in (r for r in runs if len(r) > 1):
        joined = [p.strip(".,;:?\"'") for p in pieces]
        if not all(map(str.isalpha, joined)):
            got.append(model.of_token(" ".join(pieces)))
            continue
        got.append(0.0)
        for i in range(len(joined) - 1):
            for j in range(i + 1, len(joined)):
                word = toxicity._single("".join(joined[i:j + 1]))
                if word in model.whole or any(word[:k] in model.stems for k in range(1, 7)):
                    got[-1] = max(got[-1], model.of_token(" ".join(joined[i:j + 1])))
                if len(word) > max(model.longest, 2 * max(toxicity.STEMS)):
                    break
    n, got = len(got), [e for e in got if e]
    return [1.0, max(got, default=0.0), math.log1p(len(got)), len(got) / max(1, n)]


def test_toxicity_sums_are_those_of_all_tokens():
    """Also those of plain words and stretches that cannot be evidence, which
    cost no more than a few calls."""
    import sys

    rng = random.Random(12)
    counts = np.random.default_rng(12).integers(0, 200, (28, 28, 28)).astype(float)
    some = ["id", "iot", "i", "d", "io", "t", "a", "s", "ss", "as", "fo", "ool", "ol", "o", "lo", "l", "l.", "\"as", "f00l",
            "foool", "$fool", "(fool)", "fool!", "idiots", "Idiotic,", "asses", "assay", "1d", "i0t", "...", "été", "漢",
            "İd", "ein", "of", "to", "th,", "plainly", "zzzebra", "^idio", "don't", "\x1c", "\n", "lolly", "folly"]
    for evidence in ({"idiot": 3.0, "ass": 4.0, "^idio": 2.75, "fool": 2.5, "^fooli": 5.0, "lo": 2.6}, {"^asse": 3.0}, {}):
        model = toxicity.Model(toxicity.Restorer(counts), evidence)
        for _ in range(150):
            text = " ".join(rng.choices(some, k=rng.randrange(30)))
            assert model.sums(text) == plain_sums(model, text), text
    model = toxicity.Model(toxicity.Restorer(counts), {"idiot": 3.0, "^foolis": 2.5})
    text = " ".join("".join(rng.sample("abceghkmno", 9)) + rng.choice([" of to an,", ""]) for _ in range(3000))
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        model.sums(text)
    finally:
        sys.setprofile(None)
    assert calls[0] < 10 * 3000, calls


def test_toxicity_of_planted_words(spark):
    rng = random.Random(9)
    plain = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rivers", "stones"]) for _ in range(30))
    rows, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = plain() + (" " + rng.choice(["scumling", "worthless"]) + " " + plain() if toxic else "")
        rows.append((i, text))
        marks.append((i, int(toxic)))
    rows += [(1000, plain() + " w0rthle$$ " + plain()), (1001, plain() + " s c u m l i n g " + plain()), (1002, plain())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[1000] > 0.5 and got[1001] > 0.5 and got[1002] < 0.5
    assert all((got[i] > 0.5) == bool(t) for i, t in marks)


def test_rare_toxic_words_are_learned(spark):
    """A long tail of words, each in few of many toxic documents."""
    rng = random.Random(10)
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    tail, plain = [letters() for _ in range(75)], ["alpha", "beta", "gamma", "delta", "rivers", "stones"]
    rows = [(i, " ".join(rng.choices(plain, k=6) + [tail[i % 75]] * (i < 600)), int(i < 600)) for i in range(3600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df, F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert sum(got[i] > 0.5 for i in range(600)) > 400 and not any(got[i] > 0.5 for i in range(600, 3600))


def test_int8_tiles_lose_nothing(spark):
    rng = np.random.default_rng(10)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 24)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect()
    m = np.array([v for _, v in rows])
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    for q in range(0, 700, 50):
        near = unit @ unit[q]
        near[q] = -9
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == \
            np.argsort(-near, kind="stable")[:5].tolist()


def test_among_is_the_join(spark):
    """Packed keys find the rows that a join on single keys finds."""
    rng = random.Random(5)
    rows = [(rng.choice([None, rng.randrange(-500, 500)]), i) for i in range(400)] + [(2**62, 1), (2**62, 1), (-2**63, 2)]
    df = spark.createDataFrame(rows, "x long, y long")
    own = sorted({rng.randrange(-500, 500) for _ in range(200)} | {2**62, -2**63})
    keys = spark.createDataFrame([(k,) for k in [*own, *own[:20]]], "k long")
    narrow = df.select(F.when(F.col("x").between(-500, 500), F.col("x")).cast("int").alias("x"), "y")
    for how, hit in (("left_semi", True), ("left_anti", False)):
        want = sorted(str(r) for r in rows if (r[0] in own) == hit)
        for given, limit in ((keys, 1000), (keys, 10), (np.array(own, np.int64), None)):
            got = common.among(df, "x", given, limit, how)
            assert got.columns == ["x", "y"] and sorted(str(tuple(r)) for r in got.collect()) == want
        got = common.among(narrow, "x", keys, 1000, how)
        assert got.count() == sum((r[0] in own and abs(r[0]) <= 500) == hit for r in rows)
    none = df.select("x").where("false")
    assert common.among(df, "x", none, 10).count() == 0
    assert common.among(df, "x", none, 10, "left_anti").count() == len(rows)
    assert common.among(df, "x", np.empty(0, np.int64), how="left_anti").count() == len(rows)


def test_join_broadcasts_no_row_per_token(spark, monkeypatch):
    """Tokens that many texts share two by two go to the driver and the
    executors packed: a row each took more memory than the driver had."""
    rows = []
    for k in range(40):
        same = [f"s{k}w{i}" for i in range(200)]
        rows += [(2 * k + j, " ".join(same + [f"o{k}j{j}w{i}" for i in range(100)])) for j in range(2)]
    sent, whole, send = [], [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or send(df))
    shared = jaccard._shared
    monkeypatch.setattr(jaccard, "_shared", lambda cells: whole.append((out := shared(cells)).count()) or out)
    got = jaccard.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i, _ in rows]
    assert max(whole) > 800 and max(sent) < 100
