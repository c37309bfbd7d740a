"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that
are vocabulary entries as a whole, a batch of distinct pre-tokens at a time.
Tier two: the rest are merged byte by byte, lowest rank first and leftmost
among equal ranks, with a heap of pairs over a doubly linked list, so a long
pre-token costs O(n log n).
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteHash, mix64, read, ready, texts_of

#: Distinct pre-tokens whose ids a worker remembers; then it starts anew.
MEMO = 300_000
#: Longer pre-tokens are not remembered.
MEMO_CHARS = 64


class PerfectHash:
    """Minimal perfect hash by displacement: keys fall into buckets of about
    four; each bucket stores the displacement that sends its keys to free
    slots, single keys store their slot itself (as -1 - slot)."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = self.n // 4 + 1
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key = np.full(max(1, self.n), -1, np.int64)
        if not keys:
            return
        h = _hashes(keys)
        if len(np.unique(h)) != self.n:
            raise ValueError("keys must be distinct")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        free = np.ones(self.n, bool)
        tries = np.arange(1, 129, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = order[ends[b] - sizes[b]:ends[b]]
            base = 0
            while True:
                slots = self._slots(h[own][:, None], tries + np.uint64(base))
                ok = free[slots].all(axis=0)
                for t in np.flatnonzero(ok):
                    if len(set(slots[:, t].tolist())) == len(own):
                        break
                else:
                    base += len(tries)
                    continue
                self.shift[b] = base + int(tries[t])
                free[slots[:, t]] = False
                self.slot_key[slots[:, t]] = own
                break
        left = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(sizes == 1):
            slot = next(left)
            self.shift[b] = -1 - slot
            self.slot_key[slot] = order[ends[b] - 1]

    def _slots(self, h, shift) -> np.ndarray:
        return (mix64(h + shift * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def candidates(self, tokens: list[bytes]) -> np.ndarray:
        """For each token the only key that it can be (to be compared)."""
        if not self.n or not tokens:
            return np.full(len(tokens), -1, np.int64)
        h = _hashes(tokens)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self._slots(h, np.maximum(shift, 0).astype(np.uint64)))
        return self.slot_key[slots]


def _hashes(tokens: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(t) for t in tokens])
    starts = np.concatenate(([0], ends[:-1]))
    return ByteHash(np.frombuffer(b"".join(tokens), np.uint8)).slices(starts, ends)


class Codec:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.keys = list(ranks)
        self.key_ids = list(ranks.values())
        self.perfect = PerfectHash(self.keys)
        self.piece = {str(i): k for k, i in ranks.items()}
        self.memo: dict[str, str] = {}

    def merge(self, token: bytes) -> list[int]:
        """Tier two: byte-pair merges of one pre-token."""
        ranks, n = self.ranks, len(token)
        if n < 2:
            return [ranks[token]] if n else []
        start = list(range(n))
        end = [i + 1 for i in range(n)]
        before = list(range(-1, n - 1))
        after = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i:i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            # A pair is stale once either part has been merged or grown.
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            nxt = after[i] = after[j]
            if nxt < n:
                before[nxt] = i
                if (r := ranks.get(token[start[i]:end[nxt]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt]))
            prev = before[i]
            if prev >= 0 and (r := ranks.get(token[start[prev]:stop])) is not None:
                heapq.heappush(heap, (r, prev, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[start[i]:end[i]]])
            i = after[i]
        return out

    def learn(self, tokens: set[str]) -> dict[str, str]:
        """Ids (as text) of pre-tokens: tier one for all of them at once,
        tier two for those that are no vocabulary entry."""
        raw = [t.encode() for t in tokens]
        out = {}
        for t, b, k in zip(tokens, raw, self.perfect.candidates(raw).tolist(), strict=True):
            whole = k >= 0 and self.keys[k] == b
            out[t] = str(self.key_ids[k]) if whole else " ".join(map(str, self.merge(b)))
        return out

    def encode_batch(self, texts: list[str]) -> list[str]:
        """Ids of each text as decimals joined by one space."""
        split = [self.split(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo = {}
        new = {t for t in set().union(*split) if t not in self.memo}
        if new:
            self.memo.update(self.learn(new))
        out = [" ".join(map(self.memo.__getitem__, s)) for s in split]
        for t in new:
            if len(t) > MEMO_CHARS:
                del self.memo[t]
        return out

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids.split(" "))) if ids else b""


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a file of ranks (one per Python worker)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Codec(ranks, pattern)


def defaults() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns (id, n_tokens long, ids_text string: decimals joined by a space,
    decoded binary).  A null text counts as empty: no ids, no bytes.  Repeated
    rows each give a row; other columns are ignored; an empty table gives an
    empty result.  ``path`` names the ranks on the workers.
    """
    ready(docs.sparkSession)
    std = defaults()
    path, pattern = path or std[0], pattern or std[1]

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            ids = c.encode_batch(texts_of(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s.count(" ") + 1 if s else 0 for s in ids], pa.int64()),
                 pa.array(ids, pa.string()), pa.array([c.decode(s) for s in ids], pa.binary())],
                names=["id", "n_tokens", "ids_text", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, n_tokens long, ids_text string, decoded binary")
            .withColumnRenamed("id", id_col))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **where) -> DataFrame:
    """(id, n_tokens, ids array<int>); nulls and repeats as in ``round_trip``."""
    out = round_trip(docs, id_col, text_col, **where)
    ids = F.when(F.col("n_tokens") == 0, F.array().cast("array<int>")).otherwise(
        F.split("ids_text", " ").cast("array<int>"))
    return out.select(id_col, "n_tokens", ids.alias("ids"))


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
           path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, decoded binary) of arrays of ids; a null array gives no bytes."""
    ready(encoded.sparkSession)
    std = defaults()
    path, pattern = path or std[0], pattern or std[1]

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            raw = [c.decode(" ".join(map(str, ids or []))) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())],
                                             names=["id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return (encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
            .mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col))


def op8_byte_bpe(spark, sf_dir):
    """Digests of every document's ids and of the bytes decoded from them."""
    out = round_trip(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
