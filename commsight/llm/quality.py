"""Quality scores by a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, and so do a few pairs
of features.  Shallow trees, boosted cyclically feature by feature on the
residuals of labelled rows, are summed into those tables; a text is scored by
adding the entries of its bins.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, lowest, read, ready, texts_of

#: Labelled documents that the model learns from, at most, of each label.
SAMPLE = 8000
#: Bins of a feature, and of each side of a pair.
BINS, PAIR_BINS = 32, 8
#: Cyclic rounds over the features, and over the pairs.
ROUNDS, PAIR_ROUNDS = 150, 60
#: Pairs kept, step length, least rows of a leaf.
PAIRS, RATE, LEAST_LEAF = 8, 0.15, 8

FEATURES = ("log_chars", "log_words", "word_length", "upper", "digit", "mark", "non_ascii", "bar", "exclaim",
            "distinct_words", "top_word", "repeated_lines", "line_words", "sentence_words", "bare_marks",
            "short_words", "marked_words", "blank")

_KIND = np.zeros(256, np.int64)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[128:] = 5
_MARKED = re.compile(r"[^\w\s]{2}(?!\S)").findall


def features(text: str) -> list[float]:
    """Features of one whole text, in the order of FEATURES; an empty text has
    zeros."""
    words = text.split()
    if not words:
        return [float(np.log1p(len(text)))] + [0.0] * (len(FEATURES) - 1)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    blank, digit, upper, lower, other = (int(raw[_KIND == k].sum()) for k in range(1, 6))
    n, size = len(words), int(raw.sum())
    marks = size - blank - digit - upper - lower - other
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    lengths = list(map(len, words))
    stops = text.count(". ") + text.count(".\n") + text.count("! ") + text.count("? ") + 1
    return [float(np.log1p(len(text))), float(np.log1p(n)), sum(lengths) / n, upper / max(1, upper + lower),
            digit / size, marks / size, other / size, int(raw[124]) / n, int(raw[33]) / n, len(seen) / n,
            max(seen.values()) / n, 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), n / stops,
            sum(c for w, c in seen.items() if len(w) == 1 and not w.isalnum()) / n,
            sum(1 for x in lengths if x <= 3) / n, len(_MARKED(text)) / n, blank / size]


class Additive:
    """Lookup tables over bins; ``pairs`` are (i, j, table)."""

    def __init__(self, edges, start, tables, pairs, pair_edges):
        self.edges, self.start, self.tables = edges, start, tables
        self.pairs, self.pair_edges = pairs, pair_edges

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, k], side="right")]
        for i, j, t in self.pairs:
            z += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right"),
                   np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins at quantiles of the distinct values' ranks."""
    return np.unique(np.quantile(column, np.arange(1, bins) / bins)) if len(column) else np.zeros(0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of up to three leaves (two cuts of one axis)."""
    G, H, N = (np.concatenate(([0], np.cumsum(v))) for v in (g, h, n))
    best, cuts = 1e-6, ()
    base = _gain(G[-1], H[-1])
    k = np.arange(1, len(g))
    ok = (N[k] >= LEAST_LEAF) & (N[-1] - N[k] >= LEAST_LEAF)
    if ok.any():
        one = np.where(ok, _gain(G[k], H[k]) + _gain(G[-1] - G[k], H[-1] - H[k]) - base, -1)
        if one.max() > best:
            best, cuts = one.max(), (int(k[one.argmax()]),)
    if len(g) > 2:
        a, b = np.triu_indices(len(g) - 1, 1)
        a, b = a + 1, b + 1
        ok = (N[a] >= LEAST_LEAF) & (N[b] - N[a] >= LEAST_LEAF) & (N[-1] - N[b] >= LEAST_LEAF)
        if ok.any():
            two = np.where(ok, _gain(G[a], H[a]) + _gain(G[b] - G[a], H[b] - H[a])
                           + _gain(G[-1] - G[b], H[-1] - H[b]) - base, -1)
            if two.max() > best:
                cuts = (int(a[two.argmax()]), int(b[two.argmax()]))
    out = np.zeros(len(g))
    for lo, hi in zip((0, *cuts), (*cuts, len(g)), strict=True):
        out[lo:hi] = -(G[hi] - G[lo]) / (H[hi] - H[lo] + 1.0)
    return out if cuts else np.zeros(len(g))


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Best split of a grid into four quadrants: gain and values per cell."""
    G, H, N = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h, n))
    base, best, out = _gain(G[-1, -1], H[-1, -1]), 1e-6, np.zeros(g.shape)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            q = [[V[i, j], V[i, -1] - V[i, j], V[-1, j] - V[i, j], V[-1, -1] - V[i, -1] - V[-1, j] + V[i, j]]
                 for V in (G, H, N)]
            gain = sum(_gain(a, b) for a, b in zip(q[0], q[1], strict=True)) - base
            if gain > best and min(x for x in q[2] if x) >= LEAST_LEAF:
                best = gain
                value = [-a / (b + 1.0) for a, b in zip(q[0], q[1], strict=True)]
                out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = value
    return best, out


def boost(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit the tables; without rows of both labels only the start counts."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    width = x.shape[1]
    edges = [_edges(x[:, k], BINS) for k in range(width)]
    pair_edges = [_edges(x[:, k], PAIR_BINS) for k in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return Additive(edges, start, tables, [], pair_edges)
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    z = np.full(len(y), start)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slopes()
            m = len(tables[k])
            step = RATE * _tree(np.bincount(b, g, m), np.bincount(b, h, m), np.bincount(b, minlength=m))
            tables[k] += step
            z += step[b]
    grid = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(pair_edges)]

    def sums(i, j, g, h):
        shape = (len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)
        at = grid[i] * shape[1] + grid[j]
        return [np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h, np.ones(len(y)))]

    g, h = slopes()
    ranked = sorted(combinations(range(width), 2), key=lambda p: -_pair_tree(*sums(*p, g, h))[0])[:PAIRS]
    pairs = [(i, j, np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1))) for i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            step = RATE * _pair_tree(*sums(i, j, *slopes()))[1]
            table += step
            z += step[grid[i], grid[j]]
    return Additive(edges, start, tables, pairs, pair_edges)


def _featured(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the features of the column ``text``."""

    def run(batches):
        for b in batches:
            x = [features(t) for t in texts_of(b.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(x, pa.list_(pa.float64()))],
                                             names=[*keep, "x"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, "text").mapInArrow(run, f"{kinds}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> Additive:
    """Learn from rows of ``labels`` for which the condition ``learn`` on the
    id holds, at most ``sample`` of each label, those whose ids hash lowest.
    Null ids, labels other than 0 and 1 and null texts teach nothing; an id
    labelled twice counts as its larger label."""
    ready(docs.sparkSession)
    labels = labels.where(learn).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        "id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    # At most the sample's rows are sent around and gathered.
    picked = F.broadcast(lowest(labels, "y", "id", sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        "text IS NOT NULL").join(picked, "id")
    got = _featured(rows, ["y"]).collect()
    return boost(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], float))


def score(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double) of each whole text, 0 to 1; a null text is scored as
    an empty one.  Repeated rows each give a row, equal texts equal scores;
    other columns are ignored."""
    spark = docs.sparkSession
    ready(spark)
    shipped = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in texts_of(b.column(1))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shipped.value.predict(x))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col))


def op1_quality(spark, sf_dir):
    """Quality of every document, learned from the folds other than 0 of 5."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return score(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))
