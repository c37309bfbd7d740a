"""Toxicity scores through a noisy channel.

Writers hide words behind look-alike digits and symbols, spacing and repeated
letters.  Each odd token becomes a lattice of the letters that its characters
may stand for, and so does each stretch of short tokens, whose gaps may be
kept or dropped; Viterbi decoding under a character trigram model of the whole
corpus restores the likeliest spelling, and the restored words are scored with
evidence learned from labelled documents.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, fold, give_back, lowest, read, ready, texts_of

#: Labelled documents that evidence and calibration learn from, at most.
SAMPLE = {1: 4000, 0: 16000}
#: Toxic documents that a feature must occur in to count.
LEAST_DOCS = 4
#: Log-odds from which a feature is evidence.
LEAST_EVIDENCE = 2.5
#: Prefix lengths that stand for word stems.
STEMS = (4, 5, 6)
#: Tokens that a worker remembers; then it starts anew.
MEMO = 150_000
#: Characters of a token that are decoded in one lattice; a longer one is
#: decoded in windows that overlap by half.
LATTICE = 256
#: Characters up to which a token may be a piece of a spaced-out word.
PIECE = 3
#: Spellings kept per state, and of a token in the end.
SPELLINGS = 3
#: Weight of the character model against the channel.
LANGUAGE = 0.5

#: Letters that a character may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou",
}
#: Letters of the character model: boundary, a to z, any other letter.
CLASSES = 28
#: Log-probabilities of the channel.
SUBSTITUTED, DROPPED, DROPPED_DIGIT, SPLIT, SHORTENED, UNDOUBLED, JOINED = -1.5, -1.5, -6.0, -3.0, -1.0, -4.0, -1.0


@lru_cache(1)
def _class_table() -> np.ndarray:
    """Class of every code point, as the decoder reads it."""
    t = np.fromiter((27 * chr(k).isalpha() for k in range(0x110000)), np.int8, 0x110000)
    for i, c in enumerate(string.ascii_lowercase):
        t[ord(c)] = t[ord(c.upper())] = i + 1
    return t


def char_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of characters' classes over every whole text; no texts
    give zeros."""
    ready(docs.sparkSession)

    def run(batches):
        table, total = _class_table(), np.zeros(CLASSES ** 3, np.int64)
        for b in batches:
            whole = "\n\n".join(texts_of(b.column(0))) + "\n\n"
            for lo in range(0, len(whole), 1 << 18):
                c = table[np.frombuffer(whole[max(0, lo - 2):lo + (1 << 18)].encode("utf-32-le"), np.uint32)].astype(
                    np.int32)
                if len(c) > 2:
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    counts = np.zeros(CLASSES ** 3)
    # At most CLASSES ** 3 rows.
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(run, "at int, n long").groupBy("at").agg(
            F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    return counts.reshape((CLASSES,) * 3)


def _log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | two before), trigrams backed by bigrams and single classes."""
    one = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + CLASSES)
    two = counts.sum(axis=0)
    two = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
    return np.log((counts + 20 * two[None]) / (counts.sum(axis=2, keepdims=True) + 20))


def _class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


class Restorer:
    """Restores the words that a token stands for."""

    def __init__(self, counts: np.ndarray):
        self.log = _log_model(counts).tolist()

    def decode(self, token: str) -> set[str]:
        """The words of the likeliest spellings of at most LATTICE characters."""
        log = self.log
        # State: classes of the two letters before; value: its likeliest
        # spellings as (log-probability, text).
        states = {(0, 0): [(0.0, "")]}
        for c, run in groupby(token):
            n = len(list(run))
            if c == " ":
                ways = [(" ", 0.0), ("", JOINED)]
            elif c.isalpha():
                ways = [(c * min(n, 2), 0.0 if n <= 2 else SHORTENED)]
                if n > 1:
                    ways.append((c, UNDOUBLED if n == 2 else SHORTENED))
            else:
                ways = [("", DROPPED_DIGIT if c.isdigit() or c in "@$" else DROPPED), (" ", SPLIT)]
                for x in LOOKS_LIKE.get(c, ""):
                    ways.append((x, SUBSTITUTED if n == 1 else SUBSTITUTED + SHORTENED))
                    if n > 1:
                        ways.append((x * 2, SUBSTITUTED))
            new: dict[tuple[int, int], list[tuple[float, str]]] = {}
            for (a, b), known in states.items():
                for out, cost in ways:
                    x, y = a, b
                    for o in out:
                        k = _class(o)
                        cost += LANGUAGE * log[x][y][k]
                        x, y = y, k
                    new.setdefault((x, y), []).extend((p + cost, text + out) for p, text in known)
            states = {k: sorted(set(v), reverse=True)[:SPELLINGS] for k, v in new.items()}
        last = sorted(((p + LANGUAGE * log[a][b][0], text) for (a, b), v in states.items() for p, text in v),
                      reverse=True)[:SPELLINGS]
        return {w for _, text in last for w in text.split()}

    def words(self, token: str) -> set[str]:
        """Words of one token: itself without marks around it, the letter runs
        in it, and its restored spelling if it looks disguised.  Of a stretch of
        short tokens: the words that are none of them."""
        if " " in token:
            if not any(map(str.isalpha, token)):
                return set()
            return {w for part in _windows(token) for w in self.decode(part)}.difference(token.split())
        core = token.strip(string.punctuation)
        if core.isalpha():
            out = {core}
            edge = core != token and (token[0] in "$@(" or token[-1] in "$@")
            if not (_long_run(core) or edge and not _long_run(token)):
                return out
        elif not any(map(str.isalpha, core)):
            return set()
        else:
            out = {w for w in _letters(core) if len(w) > 2}
        for part in _windows(core):
            out |= self.decode(part)
        if core != token and not _long_run(token):
            for part in _windows(token):
                out |= self.decode(part)
        return out


_long_run = re.compile(r"(.)\1\1", re.DOTALL).search


def _windows(token: str) -> list[str]:
    half = LATTICE // 2
    return [token[lo:lo + LATTICE] for lo in range(0, max(1, len(token) - half), half)]


#: Marks around a piece that do not make it odd.
_EDGES = ".,;:?\"'"


def _single(word: str) -> str:
    """``word`` with runs of a letter as one."""
    return "".join(c for c, _ in groupby(word))


def _letters(token: str) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in token).split()


#: Stretches of at least two tokens of at most PIECE characters.
_stretches = re.compile(f"(?<![^ ])[^ ]{{1,{PIECE}}}(?: [^ ]{{1,{PIECE}}}(?![^ ]))+").findall


def _tokens(text: str) -> tuple[list[str], list[str]]:
    """Tokens without spaces, and stretches."""
    out = text.lower().split()
    stretches = _stretches(" ".join(out))
    lengths = list(map(len, out))
    if lengths.count(1) >= 4:
        at, more = 0, []
        for one, run in groupby(lengths, key=lambda n: n == 1):
            n = len(list(run))
            if one and n >= 4:
                whole = "".join(out[at:at + n])
                more += [whole, whole[1:], whole[:-1], whole[1:-1]] if n <= LATTICE else _windows(whole)
            at += n
        out += more
    return out, stretches


def tokens(text: str) -> list[str]:
    """Lower-cased tokens between white space; a run of single characters
    (spaced-out letters) is one more token, also without its first or last
    (a one-letter word may stand next to it), and so is each stretch of tokens
    of at most PIECE characters, with spaces between."""
    own, stretches = _tokens(text)
    return own + stretches


@lru_cache(1 << 14)
def _joint(piece: str) -> str:
    """A piece of a stretch as it is joined; empty if it is not of plain letters."""
    plain = piece.strip(_EDGES)
    return _single(plain) if plain.isalpha() else ""


def features(words: set[str]) -> set[str]:
    """A word itself and its stems (marked by ^)."""
    return words.union(["^" + w[:k] for w in words for k in STEMS if len(w) > k])


class Model:
    """Evidence of features and the logistic weights of a document's sums."""

    def __init__(self, restorer: Restorer, evidence: dict[str, float], weights=None):
        self.restorer, self.evidence, self.weights = restorer, evidence, weights
        self.memo: dict[str, float] = {}
        # What a joined word must be, or begin with, to be evidence.
        self.whole = {_single(f) for f in evidence if f[0] != "^"}
        self.stems = {_single(f[1:]) for f in evidence if f[0] == "^"}
        self.longest = max(map(len, self.whole), default=0)
        # What a joined word must begin with to become one, and the least of it.
        self.starts = {w[:k] for w in self.whole | self.stems for k in range(len(w) + 1)}
        self.least = min(map(len, self.whole | self.stems), default=0)
        self.depths = sorted(set(map(len, self.stems)))
        # How any feature begins, of a word or its stems.
        self.heads = {f.removeprefix("^")[:min(STEMS)] for f in evidence} | {f[:min(STEMS)] for f in evidence}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def of_token(self, token: str) -> float:
        got = [self.evidence[f] for f in features(self.restorer.words(token)) if f in self.evidence]
        return max(got, default=0.0)

    def of_stretch(self, stretch: str) -> float:
        """As ``of_token``; of plain letters only those pieces are decoded that
        can give evidence when joined."""
        pieces = stretch.split()
        joints = list(map(_joint, pieces))
        if not all(joints):
            if stretch not in self.memo:
                self.memo[stretch] = self.of_token(stretch)
            return self.memo[stretch]
        best, limit = 0.0, max(self.longest, 2 * max(STEMS))
        starts, least = self.starts, self.least
        for i, word in enumerate(joints[:-1]):
            if word[:least] not in starts:
                continue
            for j in range(i + 1, len(joints)):
                word += joints[j][joints[j][0] == word[-1]:]
                if word in self.whole or any(word[:k] in self.stems for k in self.depths):
                    best = max(best, self.of_token(" ".join(p.strip(_EDGES) for p in pieces[i:j + 1])))
                elif word not in starts:
                    break
                if len(word) > limit:
                    break
        return best

    def learn(self, own: set[str]) -> None:
        """Remember the evidence of tokens without spaces."""
        memo, heads, least = self.memo, self.heads, min(STEMS)
        for t in own:
            core = t.strip(string.punctuation)
            if core[:least] not in heads and core.isalpha() and not _long_run(core) and (
                    core == t or t[0] not in "$@(" and t[-1] not in "$@"):
                memo[t] = 0.0  # a plain word, and how no feature begins
            else:
                memo[t] = self.of_token(t)

    def sums(self, text: str) -> list[float]:
        """Of a text: constant, strongest evidence, log of the number of
        tokens with evidence, their share."""
        own, stretches = _tokens(text)
        if len(self.memo) > MEMO:
            self.memo = {}
        self.learn(set(own).difference(self.memo))
        got = [e for e in map(self.memo.__getitem__, own) if e]
        got += [e for e in map(self.of_stretch, stretches) if e]
        return [1.0, max(got, default=0.0), math.log1p(len(got)), len(got) / max(1, len(own) + len(stretches))]

    def score(self, text: str) -> float:
        z = float(np.dot(self.weights, self.sums(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic weights by Newton's method; a class without rows gives weights
    that always say the other."""
    if not len(y) or y.min() == y.max():
        return np.array([(20.0 if len(y) and y[0] else -20.0), 0, 0, 0])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: dict[int, int] = SAMPLE) -> Model:
    """Learn from rows of ``labels`` for which the condition ``learn`` on the
    id holds, at most ``sample`` of each label, those whose ids hash lowest.
    The character model counts all of ``docs``.  Null ids, labels other than
    0 and 1 and null texts teach nothing; an id labelled twice counts as its
    larger label; without toxic or clean rows every score is near 0 or 1."""
    spark = docs.sparkSession
    ready(spark)
    restorer = Restorer(char_counts(docs, text_col))
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        "id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y")).withColumnRenamed("id", id_col)
    picked = lowest(labels.where(learn).select(F.col(id_col).alias("id"), "y"), "y", "id", sample)
    # At most the sample's rows: a third calibrates, the rest gives evidence.
    picked = F.broadcast(picked.select("id", "y", (F.pmod(F.hash("id"), F.lit(3)) == 0).alias("late")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        "text IS NOT NULL").join(picked, "id").select("y", "late", "text")
    # A copied text teaches once.
    rows = rows.dropDuplicates(["y", "text"]).repartition(16).cache()
    try:
        early = rows.where("NOT late").select("y", "text")
        n = {r["y"]: r["n"] for r in early.groupBy("y").agg(F.count("*").alias("n")).collect()}
        toxic, clean = n.get(1, 0), n.get(0, 0)

        def counted(wanted):
            def run(batches):
                seen: Counter[str] = Counter()
                memo: dict[str, set[str]] = {}
                for b in batches:
                    if len(memo) > MEMO:
                        memo = {}
                    for t in texts_of(b.column(0)):
                        own = set(tokens(t))
                        for k in own:
                            if k in memo:
                                continue
                            got = features(restorer.words(k))
                            memo[k] = got if wanted is None else got & wanted.value.keys()
                        seen.update(set().union(*map(memo.__getitem__, own)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["f", "n"])
                seen, memo = Counter(), {}
                give_back()
            return run

        # Features of at least LEAST_DOCS of the sampled toxic documents.
        held = {r["f"]: r["n"] for r in early.where("y = 1").select("text").mapInArrow(
            counted(None), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where(
            F.col("n") >= LEAST_DOCS).collect()}
        wanted = spark.sparkContext.broadcast(held)
        other = {r["f"]: r["n"] for r in early.where("y = 0").select("text").mapInArrow(
            counted(wanted), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()}
        evidence = {}
        for f, a in held.items():
            c = other.get(f, 0)
            # Cautious on both sides: one standard deviation less, one more.
            e = math.log((a - math.sqrt(a) + 0.25) / (toxic + 1)) - math.log((c + math.sqrt(c) + 0.5) / (clean + 1))
            if e >= LEAST_EVIDENCE:
                evidence[f] = e
        model = Model(restorer, evidence)
        shipped = spark.sparkContext.broadcast(model)

        def sums(batches):
            for b in batches:
                got = [shipped.value.sums(t) for t in texts_of(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.float64()))], names=["y", "x"])
            shipped.value.memo.clear()

        got = rows.where("late").select("y", "text").mapInArrow(sums, "y int, x array<double>").collect()
        model.weights = _logistic(np.array([r["x"] for r in got]).reshape(-1, 4), np.array([r["y"] for r in got]))
    finally:
        rows.unpersist()
    return model


def annotated(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row: all columns of ``docs``, score double) of each whole text, 0 to 1;
    an empty or null text is scored as a text without evidence.  Repeated rows
    each give a row, equal texts equal scores."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, text_col, "score double", lambda texts: [
        pa.array(list(map(shipped.value.score, texts)), pa.float64())], lambda: shipped.value.memo.clear())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), as ``annotated``; other columns are ignored."""
    return annotated(docs.select(id_col, text_col), model, text_col).select(f"row.{id_col}", "score")


def op9_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from the folds other than 0 of 5."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return score(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
