"""Session helpers: defaults every job relies on, and the shared storage folder.

Results are reproducible only with the session clock pinned to UTC (dates are
compared as ISO strings, seen-times are UTC). Persistent tables written by the
library (snapshots, stores, stream checkpoints) live under the shared folder the
cluster names in ``spark.checkpoint.dir``; a folder of our own is set only when
that setting is absent (local runs and tests).
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # of a key that a JSON object holds twice the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: Settings that results depend on.
_REQUIRED = ("spark.sql.session.timeZone", "spark.sql.variant.allowDuplicateKeys")


def builder(master: str = "local[*]", shuffle_partitions: int = 8,
            driver_memory: str = "16g") -> SparkSession.Builder:
    b = (
        SparkSession.builder.master(master)
        .config("spark.driver.memory", driver_memory)
        .appName("postwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in _RUNTIME_DEFAULTS.items():
        b = b.config(k, v)
    return b


def get_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    spark = builder(master, shuffle_partitions).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume (idempotent)."""
    for k, v in _RUNTIME_DEFAULTS.items():
        if k in _REQUIRED or spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    storage_root(spark)
    return spark


def storage_root(spark: SparkSession) -> str:
    """The shared folder for written tables and checkpoints.

    Read from ``spark.checkpoint.dir``; only when unset on a local master
    (local runs, tests) a folder is created and registered, so
    ``DataFrame.checkpoint()`` works too. On a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = ""
        try:
            master = spark.sparkContext.master or ""
        except Exception:
            pass
        if master and not master.startswith("local"):
            # a machine-local folder is not shared by the executors of a cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (HDFS/S3/ABFS/...)")
        root = tempfile.mkdtemp(prefix="postwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    except Exception:  # Spark Connect has no SparkContext
        pass
    return root.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict):
    """Session settings for what is run or started inside, put back afterwards (a stream
    keeps those of its start)."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Locations handed out by ``scratch_path`` in this process (see ``remove_scratch``).
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused location under the shared folder."""
    _SCRATCH.append(f"{storage_root(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _SCRATCH[-1]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh location of the shared folder and read back: for an
    intermediate that is read more than once. It outlives any executor, holds no
    memory, and is dropped with ``remove_scratch``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The text of a plan, which adaptive execution writes anew after each stage for the event log, has
#: hundreds of KB where bodies are taken apart (tables of character references stand in it).
PLAN_TEXT = {"spark.sql.maxPlanStringLength": "20000"}


def append_parts(parts: Iterable[DataFrame], path: str) -> None:
    """Frames of the same columns written to one location, a job each. Frames made one after
    another, by a generator, have their plans built, run and forgotten one after another:
    what the driver holds does not grow with their number, as it would with a union's."""
    for df in parts:
        with settings(df.sparkSession, PLAN_TEXT):
            df.write.mode("append").parquet(path)


def staged_parts(spark: SparkSession, parts: Iterable[DataFrame], name: str) -> DataFrame:
    """``staged`` of the frames ``parts`` stacked (see ``append_parts``); one at least."""
    path = scratch_path(spark, name)
    append_parts(parts, path)
    return spark.read.parquet(path)


def remove_scratch(spark: SparkSession) -> int:
    """Delete what this process has written under ``scratch_path`` locations; for the
    end of a job, when no DataFrame reads them any more. Returns their number."""
    n = 0
    for path in _SCRATCH:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    _SCRATCH.clear()
    return n


def is_local_path(path: str) -> bool:
    return path.startswith("/") or path.startswith("file:")


def ensure_dir(path: str) -> str:
    if is_local_path(path):
        os.makedirs(path.replace("file:", ""), exist_ok=True)
    return path
