"""The seen store of the hourly run, ordered by key, with the key range of every file.

* ``root-base/version=V``  files sorted on ``job_url``, each a range of its own;
* ``root-files/version=V`` one row per base file in use: its path, first and last key, and
  the batch up to which the base holds the marks;
* ``root/batch_id=N``      the marks of batch N; a maintenance run merges them.

A batch asks for its own keys: their places among the files' key ranges name the files
that can hold them, and only these are read, beside the few batches since the last
maintenance. Maintenance (``compact``) rewrites the files whose ranges got new keys and
keeps all others. Versions are batch numbers and are written files first, ranges last,
so a replayed batch reads the same store and writes the same result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import range_of

SCHEMA = "job_url string, seen_at timestamp"
_FILES = "file string, lo string, hi string, n bigint, upto bigint"
INITIAL_BATCH = -1


class SeenStore:
    def __init__(self, root: str, rows_per_file: int = 5_000_000):
        self.root, self.rows_per_file = root.rstrip("/"), int(rows_per_file)

    def _ranges(self, spark: SparkSession, before: int) -> list:
        """The files of the newest version below batch ``before``, in key order: one row
        per file comes to the driver."""
        try:
            table = spark.read.schema(f"{_FILES}, version bigint").parquet(f"{self.root}-files")
            table = table.filter(F.col("version") < before)
            newest = table.agg(F.max("version")).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return []
            raise
        return [] if newest is None else table.filter(F.col("version") == newest).orderBy("hi").collect()

    def _write(self, rows: DataFrame, version: int, kept: list, upto: int) -> None:
        spark, path = rows.sparkSession, f"{self.root}-base/version={int(version)}"
        n = rows.count()
        if n:
            cut = rows.repartitionByRange(max(1, -(-n // self.rows_per_file)), "job_url")
            cut.sortWithinPartitions("job_url").write.mode("overwrite").parquet(path)
            spans = spark.read.schema(SCHEMA).parquet(path).groupBy(F.input_file_name().alias("file")).agg(
                F.min("job_url").alias("lo"), F.max("job_url").alias("hi"), F.count("*").alias("n"))
            new = [tuple(r) for r in spans.collect()]  # one row per file
        else:
            new = []
        listed = [(r[0], r[1], r[2], r[3], int(upto)) for r in [*kept, *new]]
        spark.createDataFrame(listed, _FILES).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}-files/version={int(version)}")

    def create(self, seen: DataFrame) -> None:
        """The store as it is before the first batch; keyless rows can't be asked for."""
        rows = seen.select("job_url", F.col("seen_at").cast("timestamp").alias("seen_at"))
        self._write(rows.filter(F.coalesce("job_url", F.lit("")) != ""), INITIAL_BATCH, [], INITIAL_BATCH)

    def mark(self, marks: DataFrame, batch_id: int) -> None:
        marks.select("job_url", "seen_at").write.mode("overwrite").parquet(f"{self.root}/batch_id={int(batch_id)}")

    def _batches(self, spark: SparkSession, after: int, before: int) -> DataFrame:
        """The marks of the batches between two batch numbers, from their own folders."""
        place = spark._jvm.org.apache.hadoop.fs.Path
        paths = [f"{self.root}/batch_id={b}" for b in range(after + 1, before)]
        conf = spark._jsc.hadoopConfiguration()
        paths = [p for p in paths if place(p).getFileSystem(conf).exists(place(p))]
        return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)

    def files_for(self, keys: DataFrame, ranges: list, column: str = "job_url") -> list:
        """The files whose range can hold one of the keys."""
        if not ranges:
            return []
        ends = keys.select(F.col(column).alias("hi"))
        at = ends.select("hi", range_of(ranges, ends, [("hi", False)]).alias("i"))
        # of the keys that fall to a file the largest decides whether it reaches the file's first one
        hit = at.groupBy("i").agg(F.max("hi").alias("key")).collect()  # one row per file
        return [ranges[r.i] for r in hit if r.i < len(ranges) and r.key >= ranges[r.i].lo]

    def known(self, keys: DataFrame, before: int, column: str = "job_url") -> DataFrame:
        """Those of the (distinct) keys that the store held before batch ``before``."""
        spark = keys.sparkSession
        ranges = self._ranges(spark, before)
        files = self.files_for(keys, ranges, column)
        upto = ranges[0].upto if ranges else INITIAL_BATCH
        marks = self._batches(spark, upto, before)
        if files:
            marks = marks.unionByName(spark.read.schema(SCHEMA).parquet(*[r.file for r in files]))
        held = marks.select(F.col("job_url").alias(column))
        return held.join(keys.select(column), column, "left_semi").distinct()

    def compact(self, before: int) -> int:
        """Merge the marks of the batches before ``before`` into the base, as version
        ``before``; returns the number of files rewritten."""
        spark = SparkSession.active()
        ranges = self._ranges(spark, before)
        upto = ranges[0].upto if ranges else INITIAL_BATCH
        marks = self._batches(spark, upto, before)
        touched = set()
        if ranges:
            ends = marks.select(F.col("job_url").alias("hi"))
            at = F.least(range_of(ranges, ends, [("hi", False)]), F.lit(len(ranges) - 1))
            touched = {r[0] for r in ends.select(at).distinct().collect()}  # at most one row per file
        old = [ranges[i].file for i in sorted(touched)]
        rows = marks.unionByName(spark.read.schema(SCHEMA).parquet(*old)) if old else marks
        self._write(rows, before, [r for i, r in enumerate(ranges) if i not in touched], before - 1)
        return len(old)
