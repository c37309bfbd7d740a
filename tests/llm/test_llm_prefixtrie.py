"""Prefix tree against plain dictionaries, whatever the shards."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from commsight.llm import prefixtrie


def by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    seqs = {}
    for c, w in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seqs[c] = tuple(own.get(base, [])[:h] + w[h:])
    members = {}
    for c, w in seqs.items():
        for d in range(len(w) + 1):
            members.setdefault(w[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        stack, leaves, saved = [p], 0, 0
        while stack:
            q = stack.pop()
            leaves += q not in children
            saved += (len(members[q]) - 1) * len(q[-1][1]) if q else 0
            stack += children.get(q, [])
        return leaves, saved

    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *below(p),
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if seqs[c] == p))).encode()).hexdigest())
                   for p, m in members.items()), key=repr)


def made():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 160), *range(1000, 1040), -7, -100, -105]:
        for i in range(rng.choice([1, 2, 3, 5, 9])):
            # A hot first turn, hot starts, and some that are their own.
            text = "é hello" if i == 0 and c % 3 else rng.choice(["yes", "no 😀", "", None, f"own {c}"])
            rows.append((c, rng.choice([i]) if i else None, rng.choice(["user", None]) if c % 2 else "user", text))
    for c in range(300, 340):  # copies, longer than what may be handed on
        rows += [(c, i, "user", f"the same turn {i}") for i in range(12)]
    for c in range(400, 420):  # a long shared path that branches at its end
        rows += [(c, i, "a", "deep") for i in range(20)] + [(c, 20 + c % 3, "b", f"{c % 3}"), (c, 30, "b", f"{c % 5}")]
    return rows + [(None, 0, "user", "of no conversation"), (500, None, None, None), (777, 1, "user", "x" * 100_000)]


@pytest.mark.parametrize("turns", [16_384, 40, 3])
def test_nodes_are_those_of_plain_dictionaries(spark, monkeypatch, turns):
    monkeypatch.setattr(prefixtrie, "SHARD_TURNS", turns)
    monkeypatch.setattr(prefixtrie, "PIECE", 10)
    rows = made()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("conv", "keys", "chars", "n", "cut", "shard", "key", "base", "head"):
        df = df.withColumn(c, F.lit(7))
    got = prefixtrie.prefix_tree(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(5, 0, "user", "twice"), (5, 0, "user", "twice"), (100, 1, "a", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in prefixtrie.prefix_tree(df).collect()), key=repr) == by_hand(rows)
    assert prefixtrie.prefix_tree(df.where("false")).collect() == []


def test_double_array_holds_its_sequences_only():
    rng = random.Random(6)
    for _ in range(60):
        seqs = {tuple(rng.randrange(1, rng.choice([3, 40])) for _ in range(rng.randrange(7))) for _ in range(40)}
        seqs = sorted(seqs)
        size = np.array([len(s) for s in seqs])
        trie = prefixtrie.packed(np.array([x for s in seqs for x in s], np.int64), np.cumsum(size) - size, size)
        nodes = {s[:d] for s in seqs for d in range(len(s) + 1)}
        slot = {}
        for p in sorted(nodes, key=len):
            slot[p] = int(trie.children(np.array([slot[p[:-1]]]), np.array([p[-1]]))[0]) if p else 0
        assert len(set(slot.values())) == len(nodes) == (trie.check >= 0).sum()
        for p in nodes:
            for c in range(1, 40):
                t = trie.base[slot[p]] + c
                has = 0 < t < len(trie.check) and trie.check[t] == slot[p]
                assert has == ((*p, c) in nodes)
