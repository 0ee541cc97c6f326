"""The result cache of ingest runs (S4, J7, K2): postings per employer, kept 24 hours.

A versioned store under one root:

* ``rows/version=V/bucket=K``  the postings of a bucket of employers, as of the
  version that last changed the bucket;
* ``manifest/version=V``       bucket → version that holds its rows;
* ``stamps/version=V``         employer → ``cached_at`` (one narrow row each).

A run reads through the stamps: employers with a stamp younger than the TTL are
answered from the buckets they are in, and only those folders are read. After the
run the new results are written back: the buckets of the employers that were
fetched are rewritten, all others stay where they are and are only named by the new
manifest, which is written last, so a run that dies leaves the previous version
whole. Buckets are as many as ``buckets`` says; an employer with very many postings
spreads over several files of its bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import config as C
from ..operators.merge import as_of_ts, fresh_cache

NAME = "company"
_STAMPS = "company string, cached_at timestamp"
_MANIFEST = "bucket int, rows_version int"


@dataclass
class Lookup:
    """What a run takes from the cache and what it has to fetch."""
    fresh: DataFrame    # (company) answered from the cache
    missing: DataFrame  # (company) to be fetched
    rows: DataFrame     # the cached postings of the fresh employers


class ResultCache:
    def __init__(self, root: str, schema: StructType, buckets: int = 64):
        self.root, self.schema, self.buckets = root.rstrip("/"), schema, int(buckets)

    def _path(self, what: str, version: int) -> str:
        return f"{self.root}/{what}/version={int(version)}"

    def _bucket(self, name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def _table(self, spark: SparkSession, what: str, version: int | None, schema: str) -> DataFrame:
        if version is None:
            return spark.createDataFrame([], schema)
        try:
            df = spark.read.schema(schema).parquet(self._path(what, version))
            df.schema
            return df
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return spark.createDataFrame([], schema)
            raise

    def stamps(self, spark: SparkSession, version: int | None) -> DataFrame:
        return self._table(spark, "stamps", version, _STAMPS)

    def manifest(self, spark: SparkSession, version: int | None) -> dict[int, int]:
        """bucket → version of its rows; at most ``buckets`` entries."""
        return {r.bucket: r.rows_version for r in self._table(spark, "manifest", version, _MANIFEST).collect()}

    def read(self, spark: SparkSession, version: int | None, buckets=None) -> DataFrame:
        """The cached postings of ``version`` (of some buckets), with their bucket."""
        held = self.manifest(spark, version)
        paths = [f"{self._path('rows', v)}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
        full = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        if not paths:
            return spark.createDataFrame([], full)
        return spark.read.schema(full).option("basePath", f"{self.root}/rows").parquet(*paths).select(
            *[f.name for f in full.fields])

    def _buckets_of(self, names: DataFrame) -> list[int]:
        # distinct bucket numbers: bounded by the number of buckets
        return [r[0] for r in names.select(self._bucket(F.col(NAME)).alias("b")).distinct().collect()]

    def look_up(self, companies: DataFrame, version: int | None, as_of, force: bool | DataFrame = False,
                name: str = "ind_name", ttl_hours: int = C.CACHE_TTL_HOURS) -> Lookup:
        """Employers split by the cache. ``force`` bypasses it: True for all
        employers, a DataFrame (column ``name``) for the named ones."""
        spark = companies.sparkSession
        names = companies.select(F.col(name).alias(NAME)).distinct()
        young = fresh_cache(self.stamps(spark, version), as_of, ttl_hours).select(NAME)
        if isinstance(force, DataFrame):
            young = young.join(force.select(F.col(name).alias(NAME)).distinct(), NAME, "left_anti")
        elif force:
            young = young.filter(F.lit(False))
        fresh = names.join(young, NAME, "left_semi")
        rows = self.read(spark, version, set(self._buckets_of(fresh))).drop("bucket").join(fresh, NAME, "left_semi")
        return Lookup(fresh, names.join(young, NAME, "left_anti"), rows)

    def write_back(self, results: DataFrame, version: int, previous: int | None, as_of,
                   answered: DataFrame | None = None) -> list[int]:
        """Store the fetched ``results`` (postings with ``company``) as ``version``;
        returns the buckets rewritten. An employer without results keeps its old
        entry, as does every employer that was not fetched. ``answered`` employers
        (those the cache answered) get a new stamp, as a run of the original did."""
        spark = results.sparkSession
        now = as_of_ts(as_of)
        names = results.select(NAME).filter(F.col(NAME).isNotNull()).distinct()
        touched = sorted(self._buckets_of(names))
        kept = self.read(spark, previous, set(touched)).join(names, NAME, "left_anti")
        cols = [f.name for f in self.schema.fields]
        new = results.filter(F.col(NAME).isNotNull()).select(*cols, self._bucket(F.col(NAME)).alias("bucket"))
        if touched:
            (kept.select(*cols, "bucket").unionByName(new).hint("rebalance", "bucket").write.mode("overwrite")
             .partitionBy("bucket").parquet(self._path("rows", version)))
        stamped = names if answered is None else names.union(answered.select(NAME)).distinct()
        old = self.stamps(spark, previous).join(stamped, NAME, "left_anti")
        old.unionByName(stamped.withColumn("cached_at", now)).write.mode("overwrite").parquet(
            self._path("stamps", version))
        held = self.manifest(spark, previous) | {b: int(version) for b in touched}
        spark.createDataFrame(sorted(held.items()), _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            self._path("manifest", version))
        return touched
