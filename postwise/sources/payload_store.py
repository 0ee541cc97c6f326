"""Landed payloads as a store: parsed once, partitioned by format, rejects beside them.

Landing is one job. Each body of a JSON format is parsed once, into a variant; the
parse tells good payloads from rejected ones (P22), and the typed readings of the
normalisers take their fields from it. Good and rejected payloads are written by the
same write, in folders ``readable=.../format=...``, and counted while they pass
(an observation, no second job). A run over some formats, or over the rejects, then
lists and reads their folders only.

The format of a payload is its source type where a normaliser is registered for it,
else ``html``: the folders are as many as the formats, whatever types have landed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FALLBACK = "html"


def payload_format(source_type: Column, formats: Sequence[str]) -> Column:
    """The format that reads payloads of a type; null and unknown types are pages."""
    return F.when(source_type.isin(*formats), source_type).otherwise(F.lit(FALLBACK))


def tagged(payloads: DataFrame, formats: Sequence[str], json_formats: Sequence[str],
           variant_only: Sequence[str] = ()) -> DataFrame:
    """``payloads`` with ``format``, ``doc`` (the parsed body of JSON formats),
    ``reason`` (null for a readable payload) and ``readable``. The bodies of readable
    payloads of ``variant_only`` formats are left out: their ``doc`` holds them."""
    kind = payload_format(F.col("source_type"), formats)
    is_json = F.col("format").isin(*json_formats)
    # a one-row generator: the expressions below read the parsed value instead of repeating the parse
    parsed = payloads.withColumn("format", kind).withColumn(
        "__p", F.explode(F.array(F.struct(F.when(is_json, F.try_parse_json("body")).alias("doc")))))
    reason = (F.when(F.coalesce(F.trim("body"), F.lit("")) == "", F.lit("empty"))
              .when(is_json & F.col("__p.doc").isNull(), F.lit("malformed")))
    out = parsed.withColumn("doc", F.col("__p.doc")).withColumn("reason", reason).drop("__p")
    out = out.withColumn("readable", F.col("reason").isNull())
    spare = F.col("readable") & F.col("format").isin(*variant_only) if variant_only else F.lit(False)
    return out.withColumn("body", F.when(~spare, F.col("body")))


class PayloadStore:
    """Payload loads under ``root/load=N``; a load is written whole or not at all
    and a repeated landing of the same load replaces it."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def path(self, load: int) -> str:
        return f"{self.root}/load={int(load)}"

    def land(self, payloads: DataFrame, load: int) -> dict:
        """Write one load; returns how many payloads landed, and were rejected as
        empty or malformed."""
        from ..operators.normalize import JSON_TYPES, VARIANT_TYPES, registry

        rows = tagged(payloads, list(registry()), JSON_TYPES, VARIANT_TYPES)
        seen = Observation(f"load-{load}")
        counted = rows.observe(seen, F.count(F.lit(1)).alias("landed"),
                               F.count_if(F.col("reason") == "empty").alias("empty"),
                               F.count_if(F.col("reason") == "malformed").alias("malformed"))
        # one or few files a folder: partitions are dealt by folder, large ones split by size
        (counted.hint("rebalance", "readable", "format").write.mode("overwrite")
         .partitionBy("readable", "format").parquet(self.path(load)))
        return dict(seen.get)

    def _load(self, spark: SparkSession, load: int, readable: bool) -> DataFrame:
        return spark.read.parquet(self.path(load)).filter(
            F.col("readable") == F.lit(str(readable).lower())).drop("readable")

    def read(self, spark: SparkSession, load: int) -> DataFrame:
        """The readable payloads, with ``format`` and ``doc``."""
        return self._load(spark, load, True).drop("reason")

    def rejected(self, spark: SparkSession, load: int) -> DataFrame:
        """The rejected payloads with their reason."""
        return self._load(spark, load, False).drop("format", "doc")
