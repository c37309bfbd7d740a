"""Nearest vectors of a stated query set by a block matrix join.

Vectors are packed into blocks; every tile is a block of queries against a
block of candidates.  Within a tile the product of the int8 matrices gives all
cosines at once, each within a proven error; only pairs whose upper bound
reaches a query's k-th best lower bound are computed again from the original
vectors, and heaps merge the tiles' results.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read, ready

#: Vectors of a block of queries and of candidates.
QUERY_BLOCK, BLOCK = 512, 2048
#: Candidate blocks that one group of tiles goes through, at most.
GROUP_BLOCKS = 64
#: Components whose int8 products a float32 sum holds exactly.
EXACT = 1024
#: Queries whose heaps a task holds before it passes them on.
HEAPS = 20_000
#: Rounding of the bounds' own arithmetic.
SLACK = 1e-9


def pack(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """(dim, block long, ids, raw, codes, scales, errors): blocks of up to
    ``size`` vectors of one length.  ``codes`` are the unit vectors in int8,
    ``scales`` their steps and ``errors`` the lengths of what rounding lost."""
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def block(dim: int, ids: list, rows: list) -> list:
        raw = np.array(rows, np.float64)
        with np.errstate(over="ignore", under="ignore"):
            big = np.abs(raw).max(axis=1)
            unit = raw / big[:, None]
            unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / scale[:, None]).astype(np.int8)
        error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1)) + SLACK
        return [dim, np.array(ids, np.int64).tobytes(), raw.tobytes(), codes.tobytes(), scale.tobytes(), error.tobytes()]

    def run(batches):
        waiting: dict[int, tuple[list, list]] = {}

        def emit(done):
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                names=["dim", "ids", "raw", "codes", "scales", "errors"])

        for b in batches:
            done = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not any(v):
                    continue
                ids, rows = waiting.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    done.append(block(len(v), *waiting.pop(len(v))))
            if done:
                yield emit(done)
        if waiting:
            yield emit([block(dim, *w) for dim, w in waiting.items()])

    return good.mapInArrow(run, "dim int, ids binary, raw binary, codes binary, scales binary, errors binary")


def _unpack(dim: int, ids, raw, codes, scales, errors):
    return (np.frombuffer(ids, np.int64), np.frombuffer(raw).reshape(-1, dim),
            np.frombuffer(codes, np.int8).reshape(-1, dim).astype(np.float32), np.frombuffer(scales),
            np.frombuffer(errors))


def _in_turn(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added from left to right."""
    return np.cumsum(x, axis=1)[:, -1]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices in double precision."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        norms = _in_turn(a * a) * _in_turn(b * b)
        out = _in_turn(a * b) / np.sqrt(norms)
        odd = ~np.isfinite(norms) | (norms < 1e-290)
        if odd.any():
            # Squares that leave the range of doubles: scale first.
            x, y = (m[odd] / np.abs(m[odd]).max(axis=1)[:, None] for m in (a, b))
            out[odd] = _in_turn(x * y) / np.sqrt(_in_turn(x * x) * _in_turn(y * y))
    return np.clip(out, -1, 1)


def tile(queries, candidates, heaps: dict[int, list], k: int) -> None:
    """Add a tile's best to the ``heaps`` (query -> least of its best first)."""
    qid, qraw, qcode, qscale, qerror = queries
    cid, craw, ccode, cscale, cerror = candidates
    product = np.zeros((len(qid), len(cid)))
    for lo in range(0, qcode.shape[1], EXACT):
        product += qcode[:, lo:lo + EXACT] @ ccode[:, lo:lo + EXACT].T
    near = product * qscale[:, None] * cscale[None]
    # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'| for unit x, y.
    error = qerror[:, None] + (1 + qerror)[:, None] * cerror[None] + SLACK
    own = qid[:, None] == cid[None]
    low = np.where(own, -np.inf, near - error)
    floor = np.full(len(qid), -np.inf)
    if len(cid) >= k:
        floor = np.partition(low, len(cid) - k, axis=1)[:, len(cid) - k]
    for i, q in enumerate(qid.tolist()):
        if len(heaps.get(q, ())) == k:
            floor[i] = max(floor[i], heaps[q][0][0] - SLACK)
    at, other = np.nonzero((near + error >= floor[:, None]) & ~own)
    for lo in range(0, len(at), 65536):
        i, j = at[lo:lo + 65536], other[lo:lo + 65536]
        for q, c, s in zip(qid[i].tolist(), cid[j].tolist(), cosine(qraw[i], craw[j]).tolist(), strict=True):
            heap = heaps.setdefault(q, [])
            if any(-v == c for _, v in heap):
                continue
            if len(heap) < k:
                heapq.heappush(heap, (s, -c))
            elif (s, -c) > heap[0]:
                heapq.heapreplace(heap, (s, -c))


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
            k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector of ``queries`` its
    ``k`` nearest by cosine among ``vectors`` but those of its own id, ties to
    the smaller id; all of them if there are fewer.

    Vectors that are null or zero, or that hold null or non-finite components,
    and rows without id take no part; vectors of different lengths are not
    compared; rows that repeat an id and vector count once; other columns are
    ignored.  Every pair is looked at: recall is 1.
    """
    spark = vectors.sparkSession
    ready(spark)
    table = materialize(pack(vectors, id_col, vector_col, BLOCK), "blocks")
    asked = materialize(pack(queries, id_col, vector_col, QUERY_BLOCK), "queries")
    blocks = table.count()
    # Groups of candidate blocks; each query block visits every group once.
    groups = max(1, min(blocks, max(2 * spark.sparkContext.defaultParallelism, -(-blocks // GROUP_BLOCKS))))
    table = table.withColumn("grp", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    asked = asked.select("dim", *[F.col(c).alias(f"q_{c}") for c in asked.columns[1:]],
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"))
    pairs = table.join(asked, ["dim", "grp"]).select("dim", *asked.columns[1:-1], *table.columns[1:-1])

    def run(batches):
        heaps: dict[int, list] = {}

        def emit():
            rows = [(q, -v, s) for q, h in heaps.items() for s, v in h]
            heaps.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.float64())], names=["query_id", "vec_id", "score"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tile(_unpack(row[0], *row[1:6]), _unpack(row[0], *row[6:]), heaps, k)
                if len(heaps) > HEAPS:
                    yield emit()
        yield emit()

    best = pairs.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(
        F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op5_neighbours(spark, sf_dir):
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(list_cosine_similarity(q.e, c.e)) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  GROUP BY 1, 2),
r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
         vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
