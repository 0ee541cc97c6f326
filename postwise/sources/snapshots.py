"""Snapshot and key-value store I/O.

Snapshots are parquet tables written to a fresh version folder each run (a
table is never overwritten while it is being read); readers take an explicit
schema and treat a missing table as empty. JSON appears only at the edges: the
tolerant JSON reader (S2) and the key→value map texts (S3, S4).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..session import scratch_path, settings


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str | None, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """A table with an explicit schema; a missing path reads as an empty table."""
    if not path:
        return empty(spark, schema)
    try:
        df = spark.read.schema(schema).format(fmt).load(path)
        df.schema  # resolves the path
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return empty(spark, schema)
        raise


def load_all_postings(spark: SparkSession, portal_path: str | None, aggregator_path: str | None,
                      schema: StructType = schemas.POSTING_SEQ) -> DataFrame:
    """Both snapshots, bag union; a missing snapshot contributes nothing."""
    a = read_table(spark, portal_path, schema)
    b = read_table(spark, aggregator_path, schema)
    return a.unionByName(b, allowMissingColumns=True)


def read_json_tolerant(spark: SparkSession, path: str, schema: StructType, rejected: bool = False) -> DataFrame:
    """JSON-lines with an explicit schema; malformed records dropped
    (or, with ``rejected``, only the malformed records returned as text)."""
    corrupt = "_corrupt_record"
    full = StructType(schema.fields + [schemas.StructField(corrupt, schemas.StringType())])
    try:
        df = (spark.read.schema(full).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", corrupt).json(path))
        df.schema
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return empty(spark, schema)
        raise
    if rejected:
        # the JSON reader refuses queries on the corrupt column alone, so the
        # rejected side parses the lines itself
        lines = spark.read.text(path)
        parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
        return lines.select(parsed[corrupt].alias(corrupt)).filter(F.col(corrupt).isNotNull())
    return df.filter(F.col(corrupt).isNull()).drop(corrupt)


def land_json_lines(spark: SparkSession, path: str, schema: StructType, root: str) -> dict:
    """S2 / P22 as one job: JSON lines parsed once, the good records (``root/readable=true``,
    as ``record``) and the rejected ones (``root/readable=false``, their ``line``) written by
    one write, counted while they pass. Returns both counts."""
    full = StructType([*schema.fields, schemas.StructField("_corrupt", schemas.StringType())])
    parsed = spark.read.text(path).select(
        F.col("value").alias("line"),
        # a one-row generator, so the write reads the parsed value and nothing parses again
        F.explode(F.array(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))).alias("r"))
    good = F.col("r._corrupt").isNull()
    rows = parsed.select(good.alias("readable"), F.when(good, F.struct(*[F.col(f"r.{f.name}") for f in schema.fields]))
                         .alias("record"), F.when(~good, F.col("line")).alias("line"))
    seen = Observation("json-lines")
    rows = rows.observe(seen, F.count_if("readable").alias("good"), F.count_if(~F.col("readable")).alias("rejected"))
    rows.write.mode("errorifexists").partitionBy("readable").parquet(root)
    return dict(seen.get)


def write_snapshot(df: DataFrame, path: str, mode: str = "errorifexists", partition_by=()) -> str:
    """K1: write a snapshot version (a new folder; never the one being read). A task keeps a
    file open for each of a few partition values, so its rows need no sort by them."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    with settings(df.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": "8"}):
        w.parquet(path)
    return path


def new_version_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """K1: write snapshot ``version`` under ``root/version=N`` (a new folder each
    time; the version being read is never the one being written)."""
    path = f"{root.rstrip('/')}/version={int(version)}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_latest(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame:
    """The newest complete version under ``root`` (the largest ``version=N``).
    The maximum comes from the partition values alone (no data columns read)."""
    try:
        all_versions = spark.read.parquet(root)
        all_versions.schema
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return empty(spark, schema) if schema is not None else spark.createDataFrame([], "version int")
        raise
    newest = all_versions.agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root.rstrip('/')}/version={newest}")


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "job_url", buckets: int = 64) -> str:
    """A store or snapshot written as a table bucketed (and sorted) on the posting
    key at ``path`` (shared storage): later joins and per-key aggregates on that
    key read it already partitioned instead of shuffling it on every run."""
    (df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    return path


def read_bucketed(spark: SparkSession, table: str, path: str, schema: StructType, key: str = "job_url",
                  buckets: int = 64) -> DataFrame:
    """The bucketed table at ``path``; registered in the session catalog when a
    new session reads it (the bucket spec is not stored in the files)."""
    if not spark.catalog.tableExists(table):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {table} ({cols}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
                  f"INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)


class KeyedStore:
    """A snapshot or store kept as versioned tables bucketed on the posting key
    under ``root/name/version=N`` (shared storage). Recurring runs read the last
    version already partitioned on the key (the merge and lookups need no shuffle
    of it) and write the next version the same way."""

    def __init__(self, root: str, name: str, key: str = "job_url", buckets: int = 64):
        import re

        self.root, self.key, self.buckets = root.rstrip("/"), key, int(buckets)
        self.name = re.sub(r"[^A-Za-z0-9_]", "_", name)

    def path(self, version: int) -> str:
        return f"{self.root}/{self.name}/version={int(version)}"

    def table(self, version: int) -> str:
        return f"{self.name}_v{int(version)}"

    def write(self, df: DataFrame, version: int) -> str:
        return write_bucketed(df, self.table(version), self.path(version), self.key, self.buckets)

    def read(self, spark: SparkSession, version: int, schema: StructType) -> DataFrame:
        return read_bucketed(spark, self.table(version), self.path(version), schema, self.key, self.buckets)


def write_page_files(pages: DataFrame, path: str, columns=("url", "html")) -> str:
    """Pages packed into files of many records, one JSON line each (line breaks of a
    page are escaped): at most one file per task, and every file can be split."""
    pages.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("errorifexists").text(path)
    return path


def read_page_files(spark: SparkSession, path: str, schema: str = "url string, html string") -> DataFrame:
    """The pages of packed files, with the file they came from."""
    return spark.read.schema(schema).json(path).withColumn("file", F.input_file_name())


def kv_upsert(old: DataFrame, new: DataFrame, key: str = "job_url") -> DataFrame:
    """K2: store ← old entries whose key is not in ``new``, plus ``new``. The keys of ``new``
    are not made distinct: an anti join asks for the first match only."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def kv_map_explode(texts: DataFrame, body: str = "body", key: str = "key", value: str = "value") -> DataFrame:
    """S3: JSON object texts {key: value} → one row per entry (values as text)."""
    m = F.from_json(F.col(body), schemas.KV_MAP)
    return texts.select(F.explode(m).alias(key, value))


CRAWL_ENTRY = "struct<cached_at: string, jobs: array<string>>"


def crawl_cache_flatten(texts: DataFrame, body: str = "body", job_schema=None) -> DataFrame:
    """Cache texts {name: {cached_at, jobs: [posting]}} → one row per cached posting."""
    job_schema = job_schema or schemas.POSTING_SEQ
    entries = texts.select(F.explode(F.from_json(F.col(body), f"map<string, {CRAWL_ENTRY}>")).alias("name", "entry"))
    jobs = entries.select("name", F.col("entry.cached_at").alias("cached_at"),
                          F.posexplode("entry.jobs").alias("pos", "job"))
    return jobs.select("name", "cached_at", "pos", F.from_json("job", job_schema).alias("j")).select(
        "name", "cached_at", "pos", "j.*")
