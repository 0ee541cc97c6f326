"""Task counts for small inputs.

Whether a join side is broadcast is left to Spark: it knows the real sizes at
run time, and counting rows beforehand would run jobs while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy row work enough tasks: when an input has fewer partitions
    than the cluster has cores (one small file, one row group), hash-partition
    it on its first column (deterministic under retries). A no-op for large
    inputs, whose scans already have many splits. For tables as read from files
    only: the number of their partitions is known without a job."""
    try:
        spark = df.sparkSession
        target = min_partitions or spark.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # no RDD access (e.g. Spark Connect): leave it to the planner
        return df
    return df.repartition(target, df.columns[0]) if n < target else df
