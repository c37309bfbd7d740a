"""Packing of tokenised documents into sequences with a controlled mixture.

Each source is a queue of tokens.  Every window (sequence) gives each queue its
target share; what a queue could not take as a whole token is its deficit,
which is carried into the next window (deficit round-robin with a quantum of
share x window).  Served in that discipline, token x of queue j has its turn at
virtual time (x + 1/2) / weight_j, so the tokens that each queue has served
before window w, and with them its deficit, follow from w alone: a partition
starts in the middle of the corpus with exactly the deficits that all windows
before it would have left.  A queue that runs dry leaves its share to the rest.
No window is padded but the last.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, give_back, materialize, read, ready, runs_of

#: Distinct words whose ids a task remembers; then it forgets the oldest.
WORDS = 400_000
MEMO_CHARS = 64
#: Words that are Python objects at a time, and least size of a memo's parts.
SLICE = 8_192
#: Texts that are tokenised at a time, and their bytes that are split at a time.
ROWS, SPLIT_BYTES = 512, 1 << 19
#: The words of ``word_bpe_49k.json``, which are split here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a byte belongs to; an odd one's chunk is not split here.
GAP, LETTER, NUMBER, MARK, ODD = range(5)
#: With more sources than this, sources without a target share this many queues
#: (by hash), so that a plan of the mixture stays small.
MAX_QUEUES = 1024
#: Rows of partial sums (partition x queue) up to which they are broadcast.
BROADCAST_ROWS = 200_000


class Chunks:
    """Token ids of texts by a ``tokenizers`` file that drops white space.

    No token spans white space, so a text's ids are its chunks' ids in a row.
    Where the file lower-cases, splits by ``PATTERN`` and maps bytes (as
    ``word_bpe_49k.json`` does), chunks of plain Latin letters and marks are
    lower-cased and split here, by the bytes of many texts at once; only their
    distinct words go to the tokenizer's model.  Other chunks go through the
    whole tokenizer, each distinct one once."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.forget()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.plain = (before == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in split] == ["Split", "ByteLevel"]
                      and split[0]["pattern"] == {"Regex": PATTERN}
                      and not split[1]["add_prefix_space"] and not split[1].get("use_regex", True))
        # The model alone, of words with a space between.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.split = regex.compile(PATTERN).findall
        self.latin = regex.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]*").fullmatch
        # Of characters up to U+017F, which have at most two bytes: what they
        # belong to and their lower case, which has as many bytes.
        letter, number = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match
        text = list(map(chr, range(0x180)))
        self.kinds = np.array([GAP if c in " \n" else ODD if not self.plain or c == "'" or not self.latin(c) else
                               LETTER if letter(c) else NUMBER if number(c) else MARK for c in text], np.uint8)
        self.lower = np.array([ord(c.lower()) if self.latin(c) else ord(c) for c in text], np.uint16)
        # The same of bytes; those after a character's first are as the first.
        self.byte_kinds = np.concatenate([self.kinds[:128], np.full(64, MARK, np.uint8), np.full(64, ODD, np.uint8)])
        self.byte_lower = np.concatenate([self.lower[:128], np.arange(128, 256)]).astype(np.uint8)

    def words_of(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts in a row (an odd chunk is one, with a space
        before it), and how many of them lie before each text's end (the first:
        its start)."""
        gap, end = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        ends, whole = _spans(pc.binary_join_element_wise(gap, texts, end))
        raw, ends = np.frombuffer(whole, np.uint8)[ends[0]:ends[-1]], ends - ends[0]
        kinds, lower = self.byte_kinds[raw], self.byte_lower[raw]
        two = np.flatnonzero((raw >= 0xC2) & (raw <= 0xC5))
        if len(two):
            code = (raw[two] & 0x1F).astype(np.uint16) << 6 | raw[two + 1] & 0x3F
            kinds[two] = kinds[two + 1] = self.kinds[code]
            lower[two], lower[two + 1] = 0xC0 | self.lower[code] >> 6, 0x80 | self.lower[code] & 0x3F
        odd, firsts = np.flatnonzero(kinds == ODD), np.empty(0, np.int64)
        if len(odd):
            gaps = np.append(np.flatnonzero(kinds == GAP), len(raw))
            after = np.unique(np.searchsorted(gaps, odd))
            firsts = gaps[after - 1]
            inside = np.zeros(len(raw) + 1, np.int8)
            inside[firsts] += 1
            inside[gaps[after]] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
            kinds[inside], lower[inside] = ODD, raw[inside]
            lower[firsts] = ord(" ")
        starts = kinds == NUMBER
        starts[0] |= kinds[0] != GAP
        starts[1:] |= kinds[1:] != kinds[:-1]
        starts[two + 1] = False
        kept = kinds != GAP
        starts &= kept
        starts[firsts] = True
        at = np.flatnonzero(starts)
        bounds = np.append(np.cumsum(kept, dtype=np.int64)[at] - 1, np.count_nonzero(kept))
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(lower[kept])), \
            np.searchsorted(at, ends)

    def of_words(self, words: pa.Array) -> pa.Array:
        """Packed ids of words."""
        whole, sizes = [], []
        for part in _listed(words):
            odd = np.array([w[0] == " " for w in part])
            got = self.model.encode(" ".join(itertools.compress(part, ~odd)), add_special_tokens=False)
            chunks = [self.of_chunk(w[1:]) for w in itertools.compress(part, odd)]
            n = np.empty(len(part), np.int64)
            n[odd] = list(map(len, chunks))
            n[~odd] = np.bincount(np.array(got.word_ids, np.int64), minlength=np.count_nonzero(~odd))
            ids, own = np.empty(n.sum(), self.kind), np.repeat(odd, n)
            ids[own], ids[~own] = list(itertools.chain.from_iterable(chunks)), got.ids
            whole.append(ids)
            sizes.append(n)
        ends = np.append(0, np.cumsum(np.concatenate(sizes))) * self.kind.itemsize
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(whole))])

    def of_chunk(self, chunk: str) -> list[int]:
        if self.plain and self.latin(chunk):
            return self.model.encode(" ".join(self.split(chunk.lower())), add_special_tokens=False).ids
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def forget(self) -> None:
        """Give the memory back: workers outlive tasks and stages."""
        self.words = Memo(self.of_words, WORDS)

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Packed ids of each text (null: empty).

        Arrow numbers the distinct words of all texts and lines up their ids;
        only the distinct ones are looked up here.  A text's ids are then one
        slice of all."""
        column = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(
            pa.large_string()), "")
        split = [self.words_of(b.column(0)) for b in runs_of(
            pa.RecordBatch.from_arrays([column], names=["text"]), 0, ROWS, SPLIT_BYTES)]
        if not split:
            return []
        numbered = pa.concat_arrays([words for words, _ in split]).dictionary_encode()
        if not len(numbered):
            return [b""] * len(column)
        ends, whole = _spans(self.words(numbered.dictionary).take(numbered.indices))
        whole, out, before = memoryview(whole), [], 0
        for words, at in split:
            out += [bytes(whole[a:b]) for a, b in itertools.pairwise(ends[before + at].tolist())]
            before += len(words)
        return out


class Memo:
    """Remembers what ``make`` gives for texts, but for very long ones; of more
    than ``size`` the oldest go.  Arrow arrays hold them in less memory than a
    dict of Python objects."""

    def __init__(self, make, size: int):
        self.make, self.size = make, size
        self.parts: list[tuple[pa.Array, pa.Array]] = []

    def __len__(self) -> int:
        return sum(len(keys) for keys, _ in self.parts)

    def __call__(self, texts: pa.Array) -> pa.Array:
        """Values of distinct ``texts``."""
        place, left, before = np.empty(len(texts), np.int64), np.arange(len(texts)), 0
        new, values = texts, [v for _, v in self.parts]
        for keys, _ in self.parts:
            at = pc.fill_null(pc.index_in(new, value_set=keys), -1).to_numpy()
            place[left[at >= 0]] = before + at[at >= 0]
            left, new, before = left[at < 0], new.filter(pa.array(at < 0)), before + len(keys)
        if len(new):
            place[left] = before + np.arange(len(new))
            values.append(self.make(new))
            self.add(new, values[-1])
        return pa.concat_arrays(values).take(pa.array(place)) if values else pa.array([], pa.large_binary())

    def add(self, keys: pa.Array, values: pa.Array) -> None:
        short = pc.less_equal(pc.utf8_length(keys), MEMO_CHARS)
        part = (keys.filter(short), values.filter(short))
        if self.parts and len(self.parts[-1][0]) < SLICE:
            part = tuple(map(pa.concat_arrays, zip(self.parts.pop(), part, strict=True)))
        self.parts.append(part)
        while len(self) > self.size:
            self.parts.pop(0)


def _listed(texts: pa.Array):
    """Lists of the texts, SLICE at a time."""
    return (texts.slice(i, SLICE).to_pylist() for i in range(0, len(texts), SLICE))


def _spans(values: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Where binary values end (the first: where all begin) in which buffer."""
    _, ends, whole = values.buffers()
    return (np.frombuffer(ends, np.int64)[values.offset:values.offset + len(values) + 1],
            whole if whole is not None else pa.py_buffer(b""))


@lru_cache(2)
def chunks(path: str) -> Chunks:
    c = Chunks(path)
    give_back()  # what reading the file took
    return c


class Mixture:
    """Which tokens of which queue fall into which window.

    ``totals`` are the queues' lengths, ``weights`` their target shares in any
    unit (positive whole numbers)."""

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.totals, self.weights, self.window = totals, weights, window
        self.size = sum(totals)
        # Queues by the virtual time at which they run dry (totals / weights);
        # at each such moment: tokens served, tokens of dry queues, weights left.
        order = sorted(range(len(totals)), key=lambda j: (totals[j] / weights[j], j))
        self.served, self.dry, self.left = [0], [0], [sum(weights)]
        for j in order:
            dry, left = self.dry[-1], self.left[-1]
            self.served.append(max(self.served[-1], dry + left * totals[j] // weights[j]))
            self.dry.append(dry + totals[j])
            self.left.append(left - weights[j])
        self.before = lru_cache(4096)(self._before)

    def _before(self, w: int) -> list[int]:
        """Tokens that each queue has served before window ``w``."""
        n = min(w * self.window, self.size)
        if n == self.size:
            return list(self.totals)
        totals, weights = self.totals, self.weights
        at = min(bisect.bisect_right(self.served, n), len(self.served) - 1) - 1
        dry, left = self.dry[at], self.left[at]
        out = [min(t, (2 * g * (n - dry) + left) // (2 * left)) for t, g in zip(totals, weights, strict=True)]
        # ``out`` is each queue's share in whole tokens; the few tokens over or
        # under go off or on in the order of their virtual times.
        over = sum(out) - n
        while over > 0:
            j = -1
            for k, x in enumerate(out):
                if x and (j < 0 or (2 * x - 1) * weights[j] >= (2 * out[j] - 1) * weights[k]):
                    j = k
            out[j] -= 1
            over -= 1
        while over < 0:
            j = -1
            for k, x in enumerate(out):
                if x < totals[k] and (j < 0 or (2 * x + 1) * weights[j] < (2 * out[j] + 1) * weights[k]):
                    j = k
            out[j] += 1
            over += 1
        return out

    def window_of(self, j: int, x: int) -> int:
        """The window that token ``x`` of queue ``j`` falls into."""
        # Its virtual time is (2x+1) / (2 weight); all queues' tokens up to then.
        num, den = 2 * x + 1, 2 * self.weights[j]
        w = sum(min(t, g * num // den) for t, g in zip(self.totals, self.weights, strict=True)) // self.window
        while self.before(w)[j] > x:
            w -= 1
        while self.before(w + 1)[j] <= x:
            w += 1
        return w

    def pieces(self, j: int, start: int, length: int):
        """(offset in the range, length, window, offset there) of each piece
        of the tokens [start, start + length) of queue ``j``."""
        if not length:
            return
        x, stop, w = start, start + length, self.window_of(j, start)
        while x < stop:
            first, last = self.before(w), self.before(w + 1)
            if last[j] > x:
                end = min(stop, last[j])
                ahead = sum(last[k] - first[k] for k in range(j))
                yield x - start, end - x, w, ahead + x - first[j]
                x = end
            w += 1


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", end_id: int | None = 2) -> DataFrame:
    """(id, source, part, start, n, ids): each document's ids as packed
    little-endian bytes, and where they start among those of the same source
    in the same task ``part``."""

    def run(batches):
        c, part, used = chunks(path), TaskContext.get().partitionId(), {}
        end = b"" if end_id is None else np.array([end_id], c.kind).tobytes()
        for b in itertools.chain.from_iterable(runs_of(b, 1, ROWS) for b in batches):
            ids = [i + end for i in c.ids(b.column(1))]
            sources = b.column(2).to_pylist()
            starts = []
            for s, i in zip(sources, ids, strict=True):
                starts.append(used.get(s, 0))
                used[s] = starts[-1] + len(i) // c.kind.itemsize
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sources, pa.string()), pa.array([part] * len(ids), pa.int32()),
                 pa.array(starts, pa.int64()), pa.array([len(i) // c.kind.itemsize for i in ids], pa.int64()),
                 pa.array(ids, pa.binary())], names=["id", "source", "part", "start", "n", "ids"])
            pa.default_memory_pool().release_unused()
        chunks(path).forget()
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(source_col).cast("string").alias("source")).mapInArrow(
        run, f"id {kind}, source string, part int, start long, n long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         path: str | None = None, window: int = 4096, targets: dict | None = None,
         end_id: int | None = 2) -> DataFrame:
    """Pack all documents into sequences of ``window`` tokens.

    ``targets`` gives sources their shares of a window (any unit; sources it
    does not name share by their tokens what their tokens would take); without
    it the shares are those of the whole corpus, so that all queues run dry
    together.  Returns one row per piece: (id, start, length, ids binary:
    little-endian 32-bit, doc_tokens, sequence_id, offset).  A null text is
    empty (its end id alone is packed); a null source is a queue of its own;
    repeated rows are packed each; a document of no ids (end_id None) has no
    piece; an empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ready(spark)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    staged = materialize(tokenise(docs, path, id_col, text_col, source_col, end_id), "tokens")

    sources = staged.select("source").distinct()
    many = sources.limit(MAX_QUEUES + 1).count() > MAX_QUEUES
    wanted = {"s" + k if k is not None else "": v for k, v in (targets or {}).items()}
    queue = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    if many:  # a source with a target keeps a queue of its own
        queue = F.when(queue.isin(list(wanted)), queue).otherwise(
            F.concat(F.lit("h"), F.pmod(F.xxhash64("source"), F.lit(MAX_QUEUES)).cast("string")))
    sums = staged.groupBy("source", "part").agg(F.sum("n").alias("tokens"), F.first(queue).alias("queue"))
    ahead = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(sums.select("source", "part", "queue", "tokens", F.coalesce(
        F.sum("tokens").over(ahead), F.lit(0)).alias("base")), "bases")
    # One row per queue: at most MAX_QUEUES and one per target.
    totals = sorted((r["queue"], r["t"]) for r in bases.groupBy("queue").agg(
        F.sum("tokens").alias("t")).collect() if r["t"])
    names = [q for q, _ in totals]
    unit = 1 << 20
    named = sum(t for q, t in totals if q in wanted)
    share = sum(v for k, v in wanted.items() if k in names) or 1
    weights = [max(1, round(wanted[q] / share * named * unit)) if q in wanted else t * unit
               for q, t in totals]
    if not targets:
        weights = [t for _, t in totals]
    index = {q: j for j, q in enumerate(names)}
    lengths = [t for _, t in totals]
    wide = (chunks(path).kind.itemsize == 4)

    def cut(batches):
        mix = Mixture(lengths, weights, window)
        for b in batches:
            out = {k: [] for k in ("id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for i, q, at, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4").tobytes()
                for a, length, w, offset in mix.pieces(index.get(q, 0), at, n):
                    for k, v in zip(out, (i, a, length, raw[4 * a:4 * (a + length)], n, w, offset), strict=True):
                        out[k].append(v)
            kinds = [b.column(0).type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    near = bounded(bases.select(F.col("source").alias("s"), F.col("part").alias("p"), "queue", "base"),
                   BROADCAST_ROWS)
    return (staged.join(near, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
            .select("id", "queue", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
            .mapInArrow(cut, f"id {kind}, start long, length long, ids binary, doc_tokens long, "
                             "sequence_id long, offset long")
            .withColumnRenamed("id", id_col))


def digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``pack``'s pieces with the CRC of their ids instead of the ids."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op6_packing(spark, sf_dir):
    """Pieces of all documents packed at 4096 tokens, each with the CRC of its ids."""
    return digests(pack(read(spark, sf_dir, "documents")))
