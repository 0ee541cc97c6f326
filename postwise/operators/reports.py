"""Digest rows and headers, counts (K4, K5, A3, A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.scoring import score_band
from ..functions.values import first_truthy
from .merge import as_of_ts


def digest_rows(scored: DataFrame) -> DataFrame:
    """K4: display fields with defaults, score and band."""
    cols = scored.columns

    def c(name):
        return F.col(name) if name in cols else F.lit(None).cast("string")

    return scored.select(
        *[x for x in ("seq", "rank") if x in cols],
        first_truthy(c("job_url"), c("url"), c("careers_url"), default="#").alias("link"),
        first_truthy(c("job_title"), default="Unknown").alias("title"),
        F.coalesce(truthy_or_empty(c("company"))).alias("company"),
        first_truthy(c("location"), default=C.DEFAULT_COUNTRY).alias("location"),
        F.coalesce(truthy_or_empty(c("date_posted"))).alias("posted"),
        F.col("score"),
        score_band("score").alias("band"),
    )


def truthy_or_empty(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(""))


def _plural(n: Column) -> Column:
    return F.when(n != 1, F.lit("s")).otherwise(F.lit(""))


def digest_header(scored: DataFrame, as_of, kind: str = "hourly") -> DataFrame:
    """K5: one row with the count, heading and subject of a digest."""
    ts = as_of_ts(as_of)
    n = F.count(F.lit(1))
    if kind == "hourly":
        when = F.date_format(ts, "MMM dd HH:mm")
        heading = F.format_string("%d new job%s found", n, _plural(n))
        subject = F.format_string("%d new NL jobs | %s UTC", n, when)
    else:
        day = F.date_format(ts, "MMM dd, yyyy")
        heading = F.format_string("Daily Report: %d jobs in the last 24 hours", n)
        subject = F.format_string("Daily job report | %d jobs | %s", n, day)
    return scored.agg(F.lit(kind).alias("kind"), n.alias("n"), heading.alias("heading"), subject.alias("subject"))


def carried_count(merged: DataFrame) -> DataFrame:
    """A3: rows carried forward (stale)."""
    return merged.agg(F.count_if(F.coalesce(F.col("stale"), F.lit(False))).alias("carried"))
