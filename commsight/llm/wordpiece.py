"""Greedy longest-match word-piece counts with a linear automaton.

A trie of the vocabulary gets a failure link per node, as in string matching:
where the next character has no edge, the longest pieces that greedy matching
would take off the front are popped and matching goes on from the link.  How
many pieces that pops is computed once per node, so a word's piece count is a
sum of integers and no piece is built.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, ready, texts_of

#: Distinct words whose counts a worker remembers; then it starts anew.
MEMO = 500_000
#: Mark that vocabulary entries starting a word begin with.
START = "▁"


class Automaton:
    """Trie with failure links and popped-piece counts.

    A word is matched as ``START + word``; entries without the mark continue a
    word.  A word that greedy matching cannot finish counts as one unknown.
    """

    def __init__(self, vocabulary):
        self.edge: list[dict[str, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            if not piece:
                continue
            at = 0
            for c in piece:
                nxt = self.edge[at].get(c)
                if nxt is None:
                    nxt = self.edge[at][c] = len(self.edge)
                    self.edge.append({})
                    final.append(False)
                at = nxt
            final[at] = True
        n = len(self.edge)
        # link -1: greedy matching fails here.
        self.link, self.popped = [-1] * n, [0] * n
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.edge[u].items():
                    below.append(v)
                    if final[v]:
                        self.link[v], self.popped[v] = 0, 1
                        continue
                    z, pops = self.link[u], self.popped[u]
                    while z >= 0 and c not in self.edge[z]:
                        pops += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.edge[z][c], pops
            level = below

    def count(self, word: str) -> int:
        """Number of pieces; 0 if the word is unknown."""
        edge, link, popped = self.edge, self.link, self.popped
        at = pieces = 0
        for c in START + word:
            while (nxt := edge[at].get(c)) is None:
                if link[at] < 0:
                    return 0
                pieces += popped[at]
                at = link[at]
            at = nxt
        while at:
            if link[at] < 0:
                return 0
            pieces += popped[at]
            at = link[at]
        return pieces


@lru_cache(2)
def automaton(path: str) -> Automaton:
    """Automaton of a sentencepiece model's pieces, without its control,
    unknown and byte entries (one per Python worker)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return Automaton(sp.id_to_piece(i) for i in range(sp.get_piece_size())
                     if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None) -> DataFrame:
    """Word-piece counts of every whole text.

    Words are what white space separates.  Returns (id, n_words, n_tokens,
    n_unknown long); n_tokens counts an unknown word once.  A null or blank
    text has zeros; repeated rows each give a row; other columns are ignored.
    """
    ready(docs.sparkSession)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        count, memo = automaton(path).count, {}
        for b in batches:
            split = [t.split() for t in texts_of(b.column(1))]
            if len(memo) > MEMO:
                memo = {}
            for w in set().union(*split):
                if w not in memo:
                    memo[w] = count(w)
            each = [list(map(memo.__getitem__, s)) for s in split]
            unknown = [e.count(0) for e in each]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, split), pa.int64()),
                 pa.array([sum(e) + u for e, u in zip(each, unknown, strict=True)], pa.int64()),
                 pa.array(unknown, pa.int64())],
                names=["id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, n_words long, n_tokens long, n_unknown long")
            .withColumnRenamed("id", id_col))


def op3_token_counts(spark, sf_dir):
    """Word-piece counts of every document."""
    return token_counts(read(spark, sf_dir, "documents"))
