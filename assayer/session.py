"""Session defaults and the shared folder that survives executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that hold for a laptop and a cluster alike. Sizes are left to adaptive execution.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when that costs one more exchange above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cpus: int | str = 8, name: str = "assayer", **conf: str) -> SparkSession:
    """A session for tests and benchmarks. Clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        **DEFAULTS,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        # Recording the Python call site of every Column operation dominates plan building.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime-changeable defaults to an existing session."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (a local
    test session) is a folder of our own made, once per application.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return context._jsc.sc().getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``run_dir`` named, on whatever file system it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, the cluster's own one where it names none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under a folder that a writer has completed; none where there is no folder yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = sorted(entry.getPath().getName() for entry in files.listStatus(place) if entry.isDirectory())
    return [n for n in names if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder for the output of one run."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
