"""Prefix tree of rebuilt conversations, in double-array tries.

Conversations become sequences of turn digests; equal sequences are one, with
their number and smallest id.  Sequences are dealt to shards by a prefix that
is long enough that no shard is large.  In each shard turns get dense ids and a
double-array trie (BASE and CHECK) is packed over them and traversed.  Nodes
from the shard's prefix down are the shard's alone; those above it are shared
by shards, so their parts are added up over all shards afterwards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, read, ready

#: Turns of a shard; a prefix that holds more is cut deeper.
SHARD_TURNS = 16_384
#: Places that a node's children are tried at before they go to the end.
TRIES = 64
#: Conversations that hand turns on: those of the ids that this divides.
FAMILY = 100
#: Most turns that are handed on, plus one.
HANDED = 6
#: Characters of joined ids that a row holds.
PIECE = 1 << 18
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 200_000

_NODE = ("upper boolean, key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string")


class DoubleArray:
    """BASE and CHECK: the child of node s by id c is t = base[s] + c if
    check[t] is s.  Slot 0 is the root; a base may be negative."""

    def __init__(self, ids: int):
        self.base = np.zeros(2 * ids + 64, np.int64)
        self.check = np.full(2 * ids + 64, -1, np.int64)
        self.check[0] = 0
        self.low = self.end = 1

    def _grow(self, slot: int) -> None:
        while slot >= len(self.check):
            self.base = np.concatenate((self.base, np.zeros_like(self.base)))
            self.check = np.concatenate((self.check, np.full_like(self.check, -1)))

    def add(self, node: int, ids: np.ndarray) -> None:
        """Gives ``node`` children by the ascending ``ids``."""
        while self.check[self.low] >= 0:
            self.low += 1
            self._grow(self.low)
        at = self.low
        if len(ids) > 1:
            span, free = ids - ids[0], np.flatnonzero(self.check[self.low:self.end] < 0)[:TRIES] + self.low
            at = self.end
            for f in free.tolist():
                self._grow(f + int(span[-1]))
                if (self.check[f + span] < 0).all():
                    at = f
                    break
        self._grow(at + int(ids[-1] - ids[0]) + 1)
        self.base[node] = at - ids[0]
        self.check[self.base[node] + ids] = node
        self.end = max(self.end, int(self.base[node] + ids[-1]) + 1)

    def children(self, nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Slots of the children of ``nodes`` by ``ids``; all must be there."""
        slots = self.base[nodes] + ids
        if (self.check[slots] != nodes).any():
            raise KeyError("no such child")
        return slots


def packed(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> DoubleArray:
    """The trie of the sequences ids[first:first + size], packed level by level."""
    trie, high = DoubleArray(int(ids.max()) + 1 if len(ids) else 1), int(ids.max()) + 2 if len(ids) else 2
    live, nodes = np.flatnonzero(size > 0), np.zeros(int((size > 0).sum()), np.int64)
    depth = 0
    while len(live):
        turn = ids[first[live] + depth]
        pairs = np.unique(nodes * high + turn)
        parents, starts = np.unique(pairs // high, return_index=True)
        for node, group in zip(parents.tolist(), np.split(pairs % high, starts[1:]), strict=True):
            trie.add(node, group)
        depth += 1
        nodes = trie.children(nodes, turn)
        stay = size[live] > depth
        live, nodes = live[stay], nodes[stay]
    return trie


def shard_nodes(table: pa.Table) -> pa.Table:
    """All nodes of a shard's trie, from its sequences (keys, chars, n, conv,
    ends, cut)."""
    keys = table["keys"].combine_chunks()
    flat = keys.flatten()
    size = keys.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    length = table["chars"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n, conv, cut = (table[c].to_numpy().astype(np.int64) for c in ("n", "conv", "cut"))
    ends = table["ends"].to_pylist()
    trie = packed(ids, first, size)

    slots = len(trie.check)
    convs, smallest = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    chars, parent = np.zeros(slots, np.int64), np.full(slots, -1, np.int64)
    upper, some = np.zeros(slots, bool), np.zeros(slots, np.int64)
    ended: dict[int, str] = {}
    levels = []
    live, at, depth = np.arange(len(size)), np.zeros(len(size), np.int64), 0
    while len(live):
        # The nodes at this depth, and what their sequences give them.
        level, one = np.unique(at, return_index=True)
        levels.append(level)
        some[level], upper[level] = live[one], depth < cut[live[one]]
        np.add.at(convs, at, n[live])
        np.minimum.at(smallest, at, conv[live])
        if depth:
            chars[at] = length[first[live] + depth - 1]
            parent[level] = trie.check[level]
        done = size[live] == depth
        ended.update(zip(at[done].tolist(), (ends[i] for i in live[done].tolist()), strict=True))
        live, at = live[~done], at[~done]
        at = trie.children(at, ids[first[live] + depth])
        depth += 1

    # Subtree sums from the deepest level up; a shared node counts only what
    # hangs on it here, the rest is for the merge.
    children, leaves, saved = (np.zeros(slots, np.int64) for _ in range(3))
    for level in reversed(levels):
        own = level[~upper[level]]
        leaves[own] += children[own] == 0
        saved[own] += (convs[own] - 1) * chars[own]
        up = own[parent[own] >= 0]
        np.add.at(children, parent[up], 1)
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])

    # Shared nodes are known by the digest of their path.
    path = {-1: hashlib.sha256()}
    names: dict[int, str] = {}
    for depth, level in enumerate(levels):
        for s in level[upper[level]].tolist():
            path[s] = path[int(parent[s])].copy()
            if depth:
                path[s].update(flat[int(first[some[s]]) + depth - 1].as_py().encode())
            names[s] = f"{depth}:{path[s].hexdigest()}"
    every = np.concatenate(levels) if levels else np.zeros(0, np.int64)
    depths = np.repeat(np.arange(len(levels)), [len(x) for x in levels])
    above = parent[every]
    inner = (above >= 0) & ~upper[above]
    empty = hashlib.sha256().hexdigest()
    shared = upper[every]
    return pa.table({
        "upper": shared, "key": pa.array([names.get(s) for s in every.tolist()], pa.string()),
        "parent_key": pa.array([names.get(s) for s in above.tolist()], pa.string()), "conv_id": smallest[every],
        "depth": depths, "parent_conv_id": pa.array(smallest[above], pa.int64(), mask=~inner),
        "n_convs": convs[every], "n_children": children[every], "n_leaves": leaves[every],
        "saved_tokens": saved[every], "chars": chars[every],
        "ends_sha256": pa.array([ended.get(s, None if u else empty) for s, u in zip(
            every.tolist(), shared.tolist(), strict=True)], pa.string())})


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv, keys array<string>, chars array<int>) of each conversation as it
    is rebuilt, as a table: digests of its turns and their texts' code points."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    # A conversation's texts stay where they are; only digests are gathered.
    each = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.struct(
            F.col(f"`{turn_col}`").alias("turn"), role.alias("role"),
            F.substring(F.sha2(F.concat_ws(":", F.length(role), role, text), 256), 1, 32).alias("key"),
            F.length(text).alias("chars")).alias("t"))
    own = materialize(each.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv", F.transform("turns", lambda t: t["key"]).alias("keys"),
        F.transform("turns", lambda t: t["chars"]).alias("chars")), "conversations")
    conv = F.col("conv")
    heads = own.where(conv % FAMILY == 0).select(
        conv.alias("base"), F.slice("keys", 1, HANDED - 1).alias("head"), F.slice("chars", 1, HANDED - 1).alias("hc"))
    h = (F.crc32(conv.cast("string").cast("binary")) % HANDED).cast("int")
    own = own.withColumn("base", conv - conv % FAMILY).join(bounded(heads, BROADCAST_ROWS), "base", "left")

    def joined(head: str, tail: str, kind: str) -> Column:
        return F.concat(F.slice(F.coalesce(head, F.array().cast(kind)), F.lit(1), h),
                        F.slice(tail, h + 1, F.greatest(F.size(tail), F.lit(1))))

    return materialize(own.select("conv", joined("head", "keys", "array<string>").alias("keys"),
                                  joined("hc", "chars", "array<int>").alias("chars")), "rebuilt")


def _hashed(members: DataFrame) -> DataFrame:
    """(digest, ends): SHA-256 of the ids of each digest's members, ascending.

    The ids of a digest are joined piece by piece in as many tasks as a range
    of them needs; one task then hashes its pieces one after the other, holding
    one at a time.
    """
    def joined(batches):
        held: list = [None, None, [], 0]

        def piece():
            return pa.RecordBatch.from_pydict({"digest": [held[0]], "first": [held[1]], "ids": [",".join(held[2])]})

        for b in batches:
            for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held[2] and (d != held[0] or held[3] >= PIECE):
                    yield piece()
                    held[2], held[3] = [], 0
                if not held[2]:
                    held[0], held[1] = d, c
                held[2].append(str(c))
                held[3] += len(held[2][-1]) + 1
        if held[2]:
            yield piece()

    def hashed(batches):
        now, sha = None, None
        for b in batches:
            out = []
            for d, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if d == now:
                    sha.update(b",")
                else:
                    out += [(now, sha.hexdigest())] if sha else []
                    now, sha = d, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_pydict({"digest": [x for x, _ in out], "ends": [x for _, x in out]},
                                             pa.schema({"digest": pa.string(), "ends": pa.string()}))
        if sha:
            yield pa.RecordBatch.from_pydict({"digest": [now], "ends": [sha.hexdigest()]})

    pieces = members.select("digest", "conv").repartitionByRange("digest", "conv").sortWithinPartitions(
        "digest", "conv").mapInArrow(joined, "digest string, first long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(
        hashed, "digest string, ends string")


def sequences(convs: DataFrame) -> DataFrame:
    """(keys, chars, n, conv, ends) of each distinct sequence, as a table: how
    many conversations it is, the smallest of their ids and their digest."""
    digest = F.sha2(F.array_join("keys", ""), 256).alias("digest")
    members = materialize(convs.select(digest, "conv"), "members")
    groups = materialize(members.groupBy("digest").agg(F.count("*").alias("n"), F.min("conv").alias("conv")), "groups")
    several = groups.where("n > 1").select("digest")
    hashed = materialize(_hashed(members.join(bounded(several, BROADCAST_ROWS), "digest", "left_semi")), "ends")
    groups = groups.join(bounded(hashed, BROADCAST_ROWS), "digest", "left").select(
        "conv", "n", F.coalesce("ends", F.sha2(F.col("conv").cast("string"), 256)).alias("ends"))
    return materialize(convs.join(groups, "conv").select("keys", "chars", "n", "conv", "ends"), "sequences")


def sharded(seqs: DataFrame) -> DataFrame:
    """``seqs`` with ``cut``, the depth from which its nodes are its shard's
    alone, and ``shard``.  The cut is doubled where a prefix holds more turns
    than a shard may; a sequence that ends above its cut shares all nodes."""
    ready(seqs.sparkSession)
    turns = F.greatest(F.size("keys"), F.lit(1))
    total = seqs.agg(F.sum(turns)).first()[0] or 0
    shards = max(1, -(-total // SHARD_TURNS))
    left, cut, done = seqs, 1, []
    while True:
        at = F.sha2(F.concat_ws(":", F.lit(cut), F.array_join(F.slice("keys", 1, cut), "")), 256)
        left = left.withColumn("prefix", at)
        heavy = materialize(left.groupBy("prefix").agg(F.sum(turns).alias("turns"), F.count("*").alias("seqs")).where(
            (F.col("turns") > SHARD_TURNS) & (F.col("seqs") > 1)).select("prefix"), "heavy")
        none = heavy.limit(1).count() == 0
        light = left if none else left.join(bounded(heavy, BROADCAST_ROWS), "prefix", "left_anti")
        done.append(light.withColumn("cut", F.least(F.lit(cut), F.size("keys") + 1)).withColumn(
            "shard", F.pmod(F.xxhash64("prefix"), F.lit(shards))))
        if none:
            break
        left = materialize(left.join(bounded(heavy, BROADCAST_ROWS), "prefix", "left_semi"), "left")
        cut *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("keys", "chars", "n", "conv", "ends", "cut", "shard")


def _merged(parts: DataFrame) -> DataFrame:
    """The shared nodes, their parts from all shards added up; what hangs on
    lower ones reaches those above in steps that double."""
    rows = parts.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("chars").alias("chars"), F.max("ends_sha256").alias("ends"))
    rows = materialize(rows, "shared")
    below = rows.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(
        F.count("*").alias("more"))
    rows = rows.join(below, "key", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).withColumns({
            "leaves": F.col("leaves") + (F.col("n_children") == 0).cast("long"),
            "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("chars"), "jump": F.col("parent_key")})
    rows = materialize(rows.drop("more"), "shared")
    while rows.where("jump IS NOT NULL").limit(1).count():
        given = rows.where("jump IS NOT NULL").groupBy(F.col("jump").alias("key")).agg(
            F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        ahead = rows.select(F.col("key").alias("jump"), F.col("jump").alias("next"))
        rows = materialize(rows.join(given, "key", "left").join(ahead, "jump", "left").withColumns({
            "leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0)),
            "jump": F.col("next")}).drop("l", "s", "next"), "shared")
    return rows


def prefix_tree(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """All nodes of the prefix tree of the rebuilt conversations.

    A conversation c starts with the first h turns of conversation c - c % 100
    (all if fewer, none if absent; h is crc32 of c's decimals modulo 6) and
    goes on with its own turns after its first h.  Turns are ordered by number,
    null first, then by role and a digest of role and text; null roles and
    texts are empty.  Returns (conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens long, ends_sha256 string): a node's
    smallest member, its place, members, children, leaves below, code points
    that sharing saves below, and the digest of the members that end there.
    Conversations without turns are members of the root.  Repeated rows are
    turns of their own; rows without conversation are left out, other columns
    ignored; an empty table has no nodes.  A conversation's digests must fit a
    task, its texts need not.
    """
    seqs = sequences(rebuilt(turns, conv_col, turn_col, role_col, text_col))
    nodes = materialize(sharded(seqs).groupBy("shard").applyInArrow(shard_nodes, _NODE), "nodes")
    shared = _merged(nodes.where("upper"))
    names = bounded(shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")), BROADCAST_ROWS)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    private = nodes.where(~F.col("upper")).join(names, "parent_key", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above"))
    shared = shared.join(names, "parent_key", "left").select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    return private.select(columns).unionByName(shared.select(columns))


def op13_prefix_trie(spark, sf_dir):
    """Nodes of the prefix tree of all rebuilt conversations."""
    return prefix_tree(read(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (
  SELECT c, w, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda s, b: list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(s, b)),
    CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h FROM t),
s AS (
  SELECT h.c, list_concat(coalesce(b.w, [])[1:h.h], h.w[h.h + 1:]) AS w FROM h LEFT JOIN t b ON b.c = h.c - h.c % 100),
x AS (SELECT c, w, d, w[1:d] AS p FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM s)),
n AS (
  SELECT p, d, min(c) AS c, count(*) AS n,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(w) = d), '')) AS e
  FROM x GROUP BY p, d),
k AS (
  SELECT n.p, n.d, count(m.c) AS k FROM n LEFT JOIN n m ON m.d = n.d + 1 AND m.p[1:n.d] = n.p GROUP BY n.p, n.d),
b AS (
  SELECT n.p, n.d, sum(CASE WHEN k.k = 0 THEN 1 ELSE 0 END) AS leaves,
    sum((m.n - 1) * CASE WHEN m.d = 0 THEN 0 ELSE length(m.p[m.d].t) END) AS saved
  FROM n JOIN n m ON m.d >= n.d AND m.p[1:n.d] = n.p JOIN k ON k.p = m.p AND k.d = m.d GROUP BY n.p, n.d)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, u.c AS parent_conv_id, n.n AS n_convs, k.k AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.e AS ends_sha256
FROM n JOIN k ON k.p = n.p AND k.d = n.d JOIN b ON b.p = n.p AND b.d = n.d
LEFT JOIN n u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]
"""
