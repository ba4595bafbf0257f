"""Session construction and the shared scratch folder.

On a cluster the scratch folder is whatever ``spark.checkpoint.dir`` names
(a shared file system every executor can reach). Only a local session with no
such setting (tests, benchmarks) gets a fresh folder under /tmp.
"""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None,
    app_name: str = "nimbus",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session configured for the engine.

    AQE stays on so shuffle partitions are coalesced and skewed partitions
    split at run time; the session time zone is pinned to UTC so dates and
    timestamps mean the same thing on every executor.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints of frames that are no longer referenced are deleted
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    scratch_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session, once.

    Workers import the functions that they are sent by name, and they do not
    share the driver's module path. Spark serves the zipped package to every
    executor; ``spark-submit --py-files`` does the same from outside.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    if any(os.path.basename(f) == f"{name}.zip" for f in spark.sparkContext.listFiles):
        return
    folder = tempfile.mkdtemp(prefix="ship-")  # the driver's own copy, read by Spark's file server
    zipped = shutil.make_archive(os.path.join(folder, name), "zip", os.path.dirname(package), name)
    spark.sparkContext.addPyFile(zipped)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_dir(spark: SparkSession, *parts: str) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session. When it is unset and the
    session is local, a new folder under /tmp is created and registered; on a
    cluster an unset value is an error (a machine-local folder would lose data
    with the executor that wrote it).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder"
            )
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    # spark.checkpoint.dir is a static setting and cannot be changed on a
    # running session: the chosen folder is kept (and found again) on the
    # SparkContext alone
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    if parts:
        return os.path.join(root, *parts)
    return root


def unique_scratch(spark: SparkSession, label: str) -> str:
    """A new, never reused sub-folder of the scratch folder."""
    return scratch_dir(spark, f"{label}-{uuid.uuid4().hex[:12]}")


def release_driver(spark: SparkSession) -> None:
    """Lets go of what earlier jobs left on the driver.

    Python's garbage and Arrow's pool go back to the system; a full collection
    shrinks the JVM's heap and lets Spark's cleaner drop the broadcasts and
    shuffle files of frames that nothing refers to any more. What the JVM's
    compiler, its loaded classes' tables and its many short-lived threads have
    freed outside the heap stays with the C library until that is told to trim.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.java.lang.System.gc()
    _trim_native_heap(spark)


def _trim_native_heap(spark: SparkSession) -> bool:
    """Has the driver's JVM give free native memory back; a JVM without that command (it is HotSpot's, on Linux) is left as it is."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    given = new_array(jvm.java.lang.Object, 4)
    given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    given[1], given[2], given[3] = "systemTrimNativeHeap", new_array(jvm.java.lang.Object, 0), new_array(jvm.java.lang.String, 0)
    # by the interface: the server's own class is closed to callers
    methods = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
    try:
        next(m for m in methods if m.getName() == "invoke").invoke(server, given)
    except Py4JError:
        return False
    return True


def cut_lineage(df: DataFrame, label: str = "stored") -> DataFrame:
    """Write a frame once as Parquet in the shared scratch folder and read it back.

    For frames that several branches of one plan read (positions and blocks
    of a moving average, an anchor and the rows it filters): without it each
    branch would recompute the frame from the source, because column pruning
    makes the branches' shuffles differ and Spark cannot reuse them. The
    table is columnar, so each branch reads only its columns, and it is on
    shared storage, so a lost executor costs a re-read.
    """
    path = unique_scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """`cut_lineage` for operators of many steps: the driver first lets go of the steps before."""
    release_driver(df.sparkSession)
    return cut_lineage(df, label)
