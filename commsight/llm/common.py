"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commsight.session import materialize, ship_package

__all__ = ["ready", "read", "give_back", "fold", "materialize", "bounded", "among", "ByteHash", "mix64", "texts_of", "runs_of", "annotate", "lowest"]

# Arrow batches to Python hold at most so many rows and bytes, whichever comes
# first; one longer text is a batch of its own.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20
#: Keys per row of a broadcast that holds keys alone.
PACKED = 32


def ready(spark: SparkSession) -> None:
    """Package on the executors, and small Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str, folds: int) -> Column:
    """Fold of a row: crc32 of its id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else the
    join is left to the planner (a shuffle join)."""
    return F.broadcast(df) if df.count() <= rows else df


def among(rows: DataFrame, column: str, keys: DataFrame | np.ndarray, limit: int | None = None,
          how: str = "left_semi") -> DataFrame:
    """The rows whose ``column`` is one of ``keys`` (a column of longs without
    nulls, or an array of hashes); with ``how`` "left_anti", the others.

    At most ``limit`` keys (any number of an array's) are broadcast, PACKED to
    a row: about ten bytes a key in the driver and the executors, where a row
    for each key takes some seventy.  More are left to the planner (a shuffle
    join).
    """
    value = F.col(f"`{column}`").cast("long")
    if isinstance(keys, np.ndarray):
        # Hashes are spread evenly as they are.
        n = max(1, len(keys) // PACKED)
        at = keys % n
        order = np.argsort(at, kind="stable")
        places, first = np.unique(at[order], return_index=True)
        packed = rows.sparkSession.createDataFrame(pa.table({"__b": places, "__k": pa.ListArray.from_arrays(
            pa.array(np.append(first, len(keys)), pa.int32()), pa.array(keys[order]))}))
        place = F.pmod(value, F.lit(n).cast("long"))
    else:
        key = keys.select(F.col(keys.columns[0]).cast("long").alias("__k"))
        count = key.count()
        if count > limit:
            return rows.join(key, value == F.col("__k"), how)
        n = F.lit(max(1, count // PACKED)).cast("long")
        packed = key.groupBy(F.pmod(F.xxhash64("__k"), n).alias("__b")).agg(F.collect_list("__k").alias("__k"))
        place = F.pmod(F.xxhash64(value), n)
    return rows.join(F.broadcast(packed), (place == F.col("__b")) & F.array_contains("__k", value), how)


def lowest(rows: DataFrame, key: str, id_col: str, k: int | dict) -> DataFrame:
    """The ``k`` rows of each ``key`` whose ids hash lowest (``k`` per key if a
    dict; a key that it does not name has none).

    A threshold on the hash, from each key's count, first leaves about 1.5 k
    rows per key where they lie, so no task ranks a whole key.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("__n")).withColumnRenamed(key, "__k")
    most = F.lit(k) if isinstance(k, int) else F.coalesce(
        F.create_map(*[F.lit(x) for pair in k.items() for x in pair])[F.col(key)], F.lit(0))
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) / float(1 << 40)
    near = rows.join(bounded(counts, 100_000), F.col(key) == F.col("__k")).where(
        place * F.col("__n") <= 1.5 * most + 200).drop("__n", "__k")
    rank = Window.partitionBy(key).orderBy("__h", id_col)
    return near.withColumn("__h", F.pmod(F.xxhash64(id_col), F.lit(1 << 40))).withColumn(
        "__r", F.row_number().over(rank)).where(F.col("__r") <= most).drop("__h", "__r")


def runs_of(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 1 << 20):
    """Slices of a batch, in order, of at most ``rows`` rows and ``size`` bytes
    of text in ``column``; one longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo, before = 0, 0
    while lo < batch.num_rows:
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(lo, hi - lo)
        lo, before = hi, int(ends[hi - 1])


def texts_of(column) -> list[str]:
    """Texts of an Arrow column, null read as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Final mix of 64-bit hashes (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class ByteHash:
    """64-bit hashes of any slices of a byte buffer, all in numpy.

    A slice's hash is its polynomial in an odd base modulo 2**64 over a random
    value per byte; prefix sums give each slice in constant time, and the
    base's inverse makes it independent of where the slice stands.
    """

    _BASE = 0x9E3779B97F4A7C15

    def __init__(self, buffer: np.ndarray):
        power, _ = _powers(1 << max(16, (len(buffer) + 1).bit_length()))
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(_byte_values()[buffer] * power[: len(buffer)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inverse = _powers(1 << max(16, len(self.sums).bit_length()))
        h = (self.sums[end] - self.sums[start]) * inverse[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, ByteHash._BASE, np.uint64)
    inv = np.full(n, pow(ByteHash._BASE, -1, 1 << 64), np.uint64)
    base[0] = inv[0] = 1
    return np.cumprod(base), np.cumprod(inv)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive tasks and
    stages, and the next stage's executor counts what they still hold.  Arrow
    keeps what it frees in a pool of its own."""
    _powers.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def annotate(docs: DataFrame, text_col: str, fields: str, fn, done=None) -> DataFrame:
    """(row struct of all columns of ``docs``, then ``fields``): ``fn`` maps a
    list of texts (null read as empty) to one Arrow array per field; ``done``
    is called at the end of a task, to forget what it has remembered.  Rows
    keep their columns whatever their names, and repeats stay repeats."""
    ready(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{text_col}`").alias("text"))
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        try:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), *fn(texts_of(b.column(1)))], names=["row", *names])
        finally:
            if done:
                done()
                give_back()

    return rows.mapInArrow(run, f"row {docs.schema.simpleString()}, {fields}")
