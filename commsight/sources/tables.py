"""Table scans and sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The stored telecom tables and their all-text schemas.
MCC_MNC_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in (
    "Mobile Country Code", "Mobile Network Code", "ISO Country Code", "Country",
    "Country Code", "Network Operator")])
ISP_LIST_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("Country", "Providers")])
OPERATOR_LIST_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in (
    "Country", "Operator", "Network Code", "Display Text")])

STORED_TABLES = {
    "mcc_mnc_table": MCC_MNC_SCHEMA,
    "traforama_isp_list": ISP_LIST_SCHEMA,
    "mideye_mobile_network_list": OPERATOR_LIST_SCHEMA,
}

# Header renames applied to the mobile-code source.
MCC_RENAMES = {
    "MCC": "Mobile Country Code",
    "MNC": "Mobile Network Code",
    "ISO": "ISO Country Code",
    "Country": "Country",
    "Country Code": "Country Code",
    "Network": "Network Operator",
}

# The driver-provided fixture tables.
FIXTURE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                  "events", "documents", "embeddings", "pages", "benchmark", "labels",
                  "conversations")


def scan_table(spark: SparkSession, base_dir: str, name: str,
               allowed: Iterable[str] = tuple(STORED_TABLES) + FIXTURE_TABLES) -> DataFrame:
    """Read a named table.  Only names in ``allowed`` are accepted (the
    reference pasted the request's table name into SQL text)."""
    if name not in set(allowed):
        raise ValueError(f"unknown table {name!r}")
    return read_table(spark, os.path.join(base_dir, f"{name}.parquet"))


def load_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A headed CSV read with an explicit all-text schema.

    Never inferred (``001`` must stay ``001``); quoted fields may hold commas
    and newlines, hence ``multiLine``.
    """
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    """K1: headed CSV (one directory of part files).  Cells keep their blanks;
    an empty cell reads back as null."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


#: Folder of a table that names its versions, and the prefix of their folders.
_MANIFEST, _VERSION = "_manifest", "version="


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, make = _files(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(make(folder))] if fs.exists(make(folder)) else []


def table_versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Published versions of the table at ``path`` that still have their rows,
    oldest first, and the folder of each."""
    fs, make = _files(spark, path)
    there, out = set(_names(spark, path)), {}
    for n in sorted(int(x) for x in _names(spark, f"{path}/{_MANIFEST}") if x.isdigit()):
        file = fs.open(make(f"{path}/{_MANIFEST}/{n}"))
        folder = spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        file.close()
        if folder in there:
            out[n] = folder
    return out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` as its last published version left it (a plain
    Parquet folder if ``write_table`` did not write it)."""
    versions = table_versions(spark, path)
    return spark.read.parquet(f"{path}/{versions[max(versions)]}" if versions else path)


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = (),
                min_rows: int = 1, keep: int = 2) -> int:
    """K2 + A8 gate: replace the table at ``path`` only if the new data has at
    least ``min_rows`` rows.  Returns the number of rows written (0 if the old
    table was kept).

    Rows are written once, into a folder of their own that no reader looks at.
    A one-line manifest that names the folder, moved into place last,
    publishes it: a writer that dies before leaves the old table as it was,
    and of two writers at once the later one fails.  The last ``keep`` versions
    stay for readers that have started on them; older published ones go.
    ``drop_unpublished`` clears what dead writers left.
    """
    spark = df.sparkSession
    fs, make = _files(spark, path)
    manifest, versions = f"{path}/{_MANIFEST}", table_versions(spark, path)
    n = max([0, *(int(x) for x in _names(spark, manifest) if x.isdigit())]) + 1
    folder = f"{_VERSION}{n}-{uuid.uuid4().hex[:12]}"
    w = df.write.mode("error")
    parts = list(partition_by)
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(f"{path}/{folder}")
    rows = spark.read.parquet(f"{path}/{folder}").count()  # from the files' footers
    if rows < min_rows:
        fs.delete(make(f"{path}/{folder}"), True)
        return 0
    draft = make(f"{manifest}/.draft-{folder}")
    out = fs.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    target = make(f"{manifest}/{n}")
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {n} of {path} was published by another writer")
    for old in list(versions.values())[:len(versions) + 1 - keep]:
        fs.delete(make(f"{path}/{old}"), True)
    return rows


def drop_unpublished(spark: SparkSession, path: str) -> int:
    """Deletes the folders of writers that died before they published; to be
    called while nobody writes.  Returns how many there were."""
    fs, make = _files(spark, path)
    live = set(table_versions(spark, path).values())
    dead = [x for x in _names(spark, path) if x.startswith(_VERSION) and x not in live]
    for x in dead:
        fs.delete(make(f"{path}/{x}"), True)
    return len(dead)


def table_payload(df: DataFrame, name: str, path: str) -> None:
    """K3: the raw/filtered table view as files: ``columns`` (one JSON line)
    and ``rows`` (JSON lines) under ``path/name``.  Nothing is collected."""
    spark = df.sparkSession
    base = os.path.join(path, name)
    spark.createDataFrame([(name, df.columns)], "name string, columns array<string>") \
        .coalesce(1).write.mode("overwrite").json(os.path.join(base, "columns"))
    df.write.mode("overwrite").json(os.path.join(base, "rows"))
