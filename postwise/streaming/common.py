"""Shared pieces for the incremental jobs: landing rounds of input and running a
query to completion with ``availableNow`` (restartable from its checkpoint)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..session import settings  # noqa: F401

#: State that commits cheaply: what changed is uploaded, not a snapshot a batch.
CHANGES_ONLY = {"spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}

#: State of a stream-stream join: one store a partition, with column families for what were four
#: stores (each opened and committed a batch), and no read before each write to count the rows.
JOIN_STATE = CHANGES_ONLY | {"spark.sql.streaming.join.stateFormatVersion": "3",
                             "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def land(df: DataFrame, source_dir: str) -> None:
    """Append one round of input files to a streaming source folder."""
    df.write.mode("append").parquet(source_dir)


def run_available(writer: DataStreamWriter, checkpoint: str, timeout_s: int | None = None) -> StreamingQuery:
    """Process everything available now, then stop (exactly-once via the checkpoint). A run
    takes as long as its input needs, unless the caller sets ``timeout_s``. Returns the stopped query."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if timeout_s is None:
        q.awaitTermination()
    else:
        q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception() is not None:
        raise q.exception()
    return q


def stream_files(spark: SparkSession, source_dir: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(source_dir)
