"""Language identification with error-correcting output codes.

Every language has a codeword of bits; each bit is a binary classifier over
hashed byte trigrams that says on which side of the bit a text's language is.
Decoding takes the language whose codeword has the least loss, each bit
weighted by its accuracy on the training rows; a text whose two nearest
codewords are about equally near is flagged as ambiguous.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, bounded, fold, lowest, read, ready, texts_of

#: Labelled documents of a language that the classifiers learn from.
SAMPLE_PER_LANGUAGE = 2000
#: Hashed trigrams.
BUCKETS = 1 << 16
#: Bytes of text whose trigrams are looked up at once.
CHUNK = 1 << 20
#: What a text in no language is called.
UNDETERMINED = "und"
#: Tasks that count the trigrams of the sample.
COUNT_TASKS = 8
#: Weighted loss by which the nearest codeword must beat the next.
MARGIN = 0.05

_FOLD_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, letters only, each text between two
    spaces on either side; start and end of each text's trigrams."""
    raw = [b" " + t.lower().encode() + b"  " for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    return (np.frombuffer(b"".join(raw).translate(_FOLD_ASCII), np.uint8),
            np.concatenate(([0], ends[:-1])), ends - 2)


def _trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each place, and whether it holds a letter
    first, in the middle or both."""
    a = data.astype(np.uint32)
    code = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35))
    return (code >> np.uint32(16)).astype(np.int32), (data[:-2] != 32) | (data[1:-1] != 32)


def _groups(texts: list[str]):
    """Runs of texts of about CHUNK bytes; a longer text is split."""
    run, size = [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t)), CHUNK):
            piece = t[max(0, lo - 2):lo + CHUNK] if lo else t[:CHUNK]
            if size and size + len(piece) > CHUNK:
                yield run
                run, size = [], 0
            run.append((i, piece))
            size += len(piece) + 3
    if run:
        yield run


def code_matrix(languages: int, seed: int = 7) -> np.ndarray:
    """Codewords (languages x bits) of +1 and -1: all splits of up to five
    languages, else the random code with the largest least distance."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 5:
        bits = [[1 if i == 0 or i in plus else -1 for i in range(languages)]
                for k in range(languages - 1) for plus in combinations(range(1, languages), k)]
        return np.array(bits, float).T
    rng, bits = np.random.default_rng(seed), max(15, int(10 * np.log2(languages)))
    best, far = None, -1
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        same = code @ code.T - np.eye(languages) * 1e9
        distance = (code.shape[1] - same.max()) / 2
        if distance > far:
            best, far = code, distance
    return best


class Model:
    """Languages, codewords and a table of log-odds per bit."""

    def __init__(self, languages: list[str], code: np.ndarray, tables: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.tables, self.trust = languages, code, tables, trust

    def bits(self, texts: list[str]) -> np.ndarray:
        """Mean log-odds of each bit (texts x bits)."""
        total = np.zeros((len(texts), len(self.tables)))
        letters = np.zeros(len(texts))
        for run in _groups(texts):
            data, start, end = _bytes([t for _, t in run])
            code, letter = _trigrams(data)
            where = np.array([i for i, _ in run])
            # Spaces between two texts belong to neither.
            cuts = np.stack([start, end], axis=1).ravel()[:-1]
            cuts = np.minimum(cuts, len(code) - 1)
            some = end > start
            np.add.at(letters, where, np.where(some, np.add.reduceat(letter.astype(np.int64), cuts)[::2], 0))
            for b, table in enumerate(self.tables):
                sums = np.add.reduceat(table[code] * letter, cuts)[::2]
                np.add.at(total[:, b], where, np.where(some, sums, 0))
        return total / np.maximum(letters, 1)[:, None]

    def losses(self, bits: np.ndarray) -> np.ndarray:
        """Weighted loss of every codeword (texts x languages)."""
        margins = 8 * bits[:, None, :] * self.code[None]
        return (np.logaddexp(0, -margins) * self.trust).sum(axis=2) / max(self.trust.sum(), 1e-9)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        if not self.languages:
            return [(UNDETERMINED, 0.0, True)] * len(texts)
        loss = self.losses(self.bits(texts))
        order = np.argsort(loss, axis=1, kind="stable")
        odds = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * max(self.trust.sum(), 1))
        share = odds.max(axis=1) / odds.sum(axis=1)
        out = []
        for i, t in enumerate(texts):
            if not has_letter(t):
                out.append((UNDETERMINED, 0.0, True))
                continue
            first = order[i, 0]
            tie = len(self.languages) > 1 and loss[i, order[i, 1]] - loss[i, first] < MARGIN
            out.append((self.languages[first], float(share[i]), bool(tie)))
        return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from at most ``per_language`` rows of each language, those whose
    ids hash lowest.  Rows without text, letter or language teach nothing; no
    labelled rows at all give a model that knows no language."""
    ready(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                           F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    picked = lowest(rows.select("id", "lang"), "lang", "id", per_language)
    sample = rows.join(bounded(picked, 1_000_000), ["id", "lang"], "left_semi").repartition(COUNT_TASKS)

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for run in _groups(texts):
                data, start, end = _bytes([t for _, t in run])
                code, letter = _trigrams(data)
                for (i, _), a, z in zip(run, start.tolist(), end.tolist(), strict=True):
                    own = code[a:z][letter[a:z]]
                    if len(own):
                        # A long text counts as much as one of 2,000 trigrams.
                        counts = np.bincount(own, minlength=BUCKETS) * min(1.0, 2000 / len(own))
                        seen[langs[i]] = seen.get(langs[i], 0) + counts
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([c.astype(np.float32).tobytes() for c in seen.values()],
                                                         pa.binary())], names=["lang", "counts"])

    # COUNT_TASKS rows per language, each BUCKETS numbers.
    counts: dict[str, np.ndarray] = {}
    for r in sample.select("lang", "text").mapInArrow(count, "lang string, counts binary").collect():
        counts[r["lang"]] = counts.get(r["lang"], 0) + np.frombuffer(r["counts"], np.float32).astype(float)
    languages = sorted(counts)
    code = code_matrix(len(languages))
    share = np.array([counts[k] / counts[k].sum() for k in languages]) if languages else np.zeros((0, BUCKETS))
    floor = 0.1 / BUCKETS
    tables = []
    for b in range(code.shape[1]):
        plus, minus = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        tables.append(np.log((plus + floor) / (minus + floor)))
    tables = np.array(tables).reshape(code.shape[1], BUCKETS)
    model = Model(languages, code, tables, np.ones(code.shape[1]))
    if len(languages) > 1:
        shipped = sample.sparkSession.sparkContext.broadcast(model)

        def judge(batches):
            right = np.zeros(len(languages) and code.shape[1])
            n = 0
            for b in batches:
                truth = code[[languages.index(k) if k in languages else 0 for k in b.column(0).to_pylist()]]
                right += (np.sign(shipped.value.bits(texts_of(b.column(1)))) == truth).sum(axis=0)
                n += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([right.tolist()], pa.list_(pa.float64())),
                                              pa.array([n], pa.int64())], names=["right", "n"])

        # COUNT_TASKS rows of one number per bit.
        got = sample.select("lang", "text").mapInArrow(judge, "right array<double>, n long").collect()
        accuracy = sum(np.array(r["right"]) for r in got) / max(1, sum(r["n"] for r in got))
        # Loss weight: log-odds of a right bit; a bit at chance has none.
        accuracy = np.clip(accuracy, 0.5, 0.999)
        model.trust = np.log(accuracy / (1 - accuracy)) + 1e-6
    return model


def annotated(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row: all columns of ``docs``, lang_pred string, score double,
    ambiguous boolean) of each whole text.  A text that is null or has no
    letter is ``und`` with score 0 and flagged; so is every text if the model
    knows no language.  Repeated rows each give a row; equal texts get equal
    results."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        got = shipped.value.predict(texts)
        return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                pa.array([g[2] for g in got], pa.bool_())]

    return annotate(docs, text_col, "lang_pred string, score double, ambiguous boolean", run)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous), as ``annotated``; other columns are
    ignored."""
    return annotated(docs.select(id_col, text_col), model, text_col).select(
        f"row.{id_col}", "lang_pred", "score", "ambiguous")


def op7_language_id(spark, sf_dir):
    """Language of every document, learned from the folds other than 2 of 4."""
    docs = read(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.where(fold("doc_id", 4) != 2)))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
