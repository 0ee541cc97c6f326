"""Personal-data removal and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C


def strip_pii(df: DataFrame, fields=C.PII_FIELDS) -> DataFrame:
    """Drop personal-data columns."""
    return df.drop(*[f for f in fields if f in df.columns])


def pii_audit(records: DataFrame, target: str, body: str = "body", fields=C.PII_FIELDS) -> DataFrame:
    """A4: per target and field, keys removed and non-null values removed. Key
    presence is read from the raw JSON object (a typed column cannot tell an
    absent key from a null value)."""
    # one scan per target: both counts of every field in one aggregate, then a row per field
    keys = F.coalesce(F.json_object_keys(F.col(body)), F.array().cast("array<string>"))
    read = records.select(keys.alias("__keys"), *[F.get_json_object(F.col(body), f"$.{f}").alias(f"__v{i}")
                                                   for i, f in enumerate(fields)])
    counts = []
    for i, f in enumerate(fields):
        has = F.array_contains("__keys", f)
        counts += [F.count_if(has).alias(f"k{i}"), F.count_if(has & F.col(f"__v{i}").isNotNull()).alias(f"v{i}")]
    totals = read.agg(*counts)
    rows = F.array(*[F.struct(F.lit(target).alias("target"), F.lit(f).alias("field"), F.col(f"k{i}").alias("removed_keys"),
                              F.col(f"v{i}").alias("removed_values")) for i, f in enumerate(fields)])
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def scrub_json(records: DataFrame, body: str = "body", schema=None, fields=C.PII_FIELDS) -> DataFrame:
    """Parse JSON records with ``schema`` and drop the personal-data fields."""
    parsed = records.select(F.from_json(F.col(body), schema).alias("r")).select("r.*")
    return strip_pii(parsed, fields)


def pii_audit_total(audits: DataFrame) -> DataFrame:
    """A5: values removed over all targets."""
    return audits.agg(F.coalesce(F.sum("removed_values"), F.lit(0)).cast("bigint").alias("total_removed"))
