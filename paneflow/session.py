"""Spark session settings used by tests, the benchmark and the query entry points.

Everything here is plain SparkSession configuration.  The values are chosen so that
the same code runs on ``local[8]`` and on a large cluster:

* AQE re-plans joins and coalesces partitions at runtime, and splits skewed shuffle
  partitions of sort-merge joins (a hot key holding a third of the rows is split
  instead of landing in one task).
* ``spark.sql.shuffle.partitions`` is a parameter: ~cores locally, thousands on a
  cluster; AQE coalesces what is too small.
* The session time zone is UTC so window bounds agree with the SQL oracle.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Never broadcast blindly: 10 MB is Spark's default static threshold; AQE may
    # convert a join to broadcast only when the *measured* side is below this.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "paneflow", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("PANEFLOW_DRIVER_MEMORY", "16g"))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_runtime_conf(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make :mod:`paneflow` importable in Python workers (``addPyFile``), once per context.

    The zip is built on the driver and handed to Spark's file distribution, which serves
    it to every executor, so it works whatever file system the checkpoint folder is on.
    User code pickled by reference (pandas UDFs, ``mapInPandas`` functions) then resolves
    on every executor.
    """
    sc = spark.sparkContext
    if getattr(sc, "_paneflow_shipped", False):
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="paneflow-"), "paneflow-lib.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    sc._paneflow_shipped = True


def apply_runtime_conf(spark: SparkSession) -> None:
    """Set the SQL options that can change on a running session (idempotent) and
    ship the package to the Python workers."""
    ship_package(spark)
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql.") and "stateStore.providerClass" not in k:
            try:
                spark.conf.set(k, v)
            except Exception:  # noqa: BLE001 - static conf on a shared session
                pass


def cut_lineage(df):
    """Reliable checkpoint in the shared folder: the rows and their order in each partition
    are fixed, whatever executor is lost later."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object store)
    folder and is always used.  Only when it is unset in a local session (tests) one
    scratch folder per context is created; on a cluster an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = getattr(sc, "_paneflow_scratch", None) or tempfile.mkdtemp(prefix="paneflow-ckpt-")
        sc._paneflow_scratch = d
    if getattr(sc, "_paneflow_checkpoint", None) != d:
        sc.setCheckpointDir(d)
        sc._paneflow_checkpoint = d
    return d
