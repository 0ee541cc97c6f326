"""T4: snapshot merge per micro-batch (stamp, carry forward, expire).

The snapshot is kept in buckets of its key. Every micro-batch is one new load and
writes version N: of the buckets only those whose rows can change are merged (J5) and
rewritten; the index of the version names, for every bucket, the version that holds its
rows. A bucket changes when

* the load has a key of it (new stamps; older rows of the key give way),
* it holds rows of the load before (they become stale, and one row per key stays), or
* its oldest last_seen has left the retention window (rows expire).

All others stand as they are: stale rows, one per key, none expired. The index has one
row per bucket and is written last, so a replayed batch overwrites its own version only.

``snap_ord`` keeps the snapshot's row order for the next "last row per key":
new rows first (arrival order), carried rows after.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import config as C
from ..functions.values import first_truthy
from ..operators import merge as J

CARRY_OFFSET = 1_000_000_000_000
BUCKETS = 64
_INDEX = "bucket int, rows_version bigint, fresh boolean, oldest string"


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with the bucket of their key; rows without a key, which no later batch
    looks up, are dealt over all buckets."""
    keyed = J.with_key(rows)
    spread = F.when(F.col(J.KEY) == "", F.col("snap_ord").cast("string")).otherwise(F.col(J.KEY))
    return keyed.withColumn("bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int")).drop(J.KEY)


def _index(spark: SparkSession, root: str, version: int) -> list:
    return spark.read.schema(_INDEX).parquet(f"{root}/index/version={int(version)}").collect()  # one row per bucket


def _write(rows: DataFrame, root: str, version: int, kept: list) -> None:
    """Write the buckets of ``rows`` as ``version``, and its index with the ``kept`` entries."""
    spark, path = rows.sparkSession, f"{root}/rows/version={int(version)}"
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    # without a stamp of its own a carried row depends on the seen store: looked at every time
    oldest = F.min(first_truthy("last_seen", "first_seen", default=""))
    entries = spark.read.schema(rows.schema).parquet(path).groupBy("bucket").agg(
        F.lit(int(version)).cast("bigint").alias("rows_version"),
        F.bool_or(F.col("stale").isNull()).alias("fresh"), oldest.alias("oldest")).collect()  # one row per bucket
    spark.createDataFrame([tuple(r) for r in [*kept, *entries]], _INDEX).coalesce(1).write.mode("overwrite").parquet(
        f"{root}/index/version={int(version)}")


def _rows(spark: SparkSession, root: str, entries: list, schema: StructType) -> DataFrame:
    paths = [f"{root}/rows/version={r.rows_version}/bucket={r.bucket}" for r in entries]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/rows").parquet(*paths).select(*schema.names)


def read_schema(spark: SparkSession, root: str, entries: list) -> StructType:
    """The columns of a snapshot, without those of the layout."""
    some = spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows/version={entries[-1].rows_version}").schema
    return StructType([f for f in some.fields if f.name not in ("version", "bucket")])


def read_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The whole snapshot as of a version."""
    entries = _index(spark, root, version)
    return _rows(spark, root, entries, read_schema(spark, root, entries))


def merge_batch(root: str, seen: DataFrame, as_of: Callable[[int], str], retain_days: int = C.RETAIN_DAYS,
                buckets: int = BUCKETS):
    """The ``foreachBatch`` function; ``buckets`` as given to ``write_initial_snapshot``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = _bucketed(batch.withColumn("snap_ord", F.col("seq")), buckets)
        cutoff = batch.sparkSession.range(1).select(F.date_format(F.date_sub(
            F.lit(as_of(batch_id)).cast("date"), retain_days), "yyyy-MM-dd")).first()[0]
        entries = _index(spark, root, batch_id - 1)
        loaded = {r[0] for r in new.select("bucket").distinct().collect()}  # at most one row per bucket
        changed = [r for r in entries if r.bucket in loaded or r.fresh or r.oldest < cutoff]
        before = read_schema(spark, root, entries)
        prev = _rows(spark, root, changed, before)
        merged = J.stamp_and_retain(new.drop("bucket"), prev, seen, as_of(batch_id), retain=True, retain_days=retain_days,
                                    prev_order="snap_ord")
        merged = merged.withColumn(
            "snap_ord", F.when(F.col("stale"), F.lit(CARRY_OFFSET) * (batch_id + 2) + F.col("snap_ord"))
            .otherwise(F.col("snap_ord")))
        names = [c for c in before.names if c in merged.columns]
        gone = {(r.bucket, r.rows_version) for r in changed}
        _write(_bucketed(merged.select(*names), buckets), root, batch_id,
               [r for r in entries if (r.bucket, r.rows_version) not in gone])

    return run


def write_initial_snapshot(prev: DataFrame, root: str, order: str = "seq", buckets: int = BUCKETS) -> None:
    rows = prev.withColumn("snap_ord", F.col(order))
    if "stale" not in rows.columns:
        rows = rows.withColumn("stale", F.lit(None).cast("boolean"))
    _write(_bucketed(rows, buckets), root, -1, [])
