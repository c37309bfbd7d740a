"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours wants.  AQE re-plans joins from runtime
# sizes (a shuffle join becomes a broadcast join only when the measured side
# is small), coalesces small shuffle partitions and splits skewed ones.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages can be large (MBs); keep Arrow batches to a few hundred records
    # so a batch of pages stays well inside a Python worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "commsight", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with our defaults.

    On a cluster call it without ``master``; the launcher decides.  Tests and
    the bench pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged writes.

    The cluster names it in ``spark.checkpoint.dir``; we only invent one when
    it is unset (local runs and tests), never overriding the cluster's.  On a
    cluster it must be set: a folder of the driver alone would lose what
    executors write.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="commsight-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 - no SparkContext (Spark Connect): files only
        pass
    return d


def staging_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder."""
    import uuid

    return os.path.join(checkpoint_dir(spark), f"stage-{name}-{uuid.uuid4().hex}")


def spread(df, min_partitions: int | None = None):
    """Give CPU-heavy per-row work (tokenising, HTML parsing) enough tasks.

    A small input stored as one file is one partition, i.e. one core.  If the
    sizes of the tables it reads give ``df`` fewer scan partitions than the
    cluster's default parallelism it is round-robin repartitioned; a large
    input is returned untouched, so at scale this adds no shuffle.  (The whole
    plan's size would not do: a join's is estimated as its sides' product.)
    Reads the plan only: nothing runs while a query is being built.
    """
    if df.isStreaming:
        return df  # partitioning of a stream is set by its source
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        read = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(int(str(read.apply(i).stats().sizeInBytes())) for i in range(read.size()))
        split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    except AttributeError:  # Spark Connect: leave it to the planner
        return df
    return df.repartition(target) if size < target * split else df


def materialize(df, name: str = "table"):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return the read-back frame.

    Cuts lineage like ``checkpoint()`` (a lost executor re-reads files, not
    the raw inputs) but computes the plan once; RDD checkpointing computes
    it a second time to write the files unless it was cached first.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``commsight`` importable on every executor's Python workers.

    Functions given to ``mapInPandas`` / pandas UDFs refer to this package's
    module-level code by name, so workers must be able to import it.  The
    package is zipped once per application and added with ``addPyFile``
    (Spark ships it to every executor, including ones added later).  A
    deployment that installs the package on the executors needs none of it.
    """
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect: the server side provides code
        return
    if app in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="commsight-pkg-"), "commsight.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)
