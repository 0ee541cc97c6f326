"""Keyed 24-hour cache as a stream-stream join.

A lookup of key k at time t is a hit when the latest store of k is younger than
the TTL, i.e. when some store of k happened in (t - ttl, t]. That is a left-semi
stream-stream join with an event-time range condition; both sides carry a
watermark, so Spark keeps only the stores that can still match (state bounded
by the TTL). No per-key ordering or grouping is needed. Time is cut into
spans of the TTL and a store stands in its own and the next one, so rows meet by
(key, span): a lookup is compared with the stores of two spans only, and a key with
a third of all events is spread over its spans. ``common.JOIN_STATE`` are settings
under which the state of the join costs little beside its rows.

The batch twin (J7) is ``cache_hits`` over a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C


def ttl_hits(lookups: DataFrame, stores: DataFrame, key: str, ts: str = "ts",
             ttl_hours: int = C.CACHE_TTL_HOURS, *, lateness: str) -> DataFrame:
    """Lookups that find a fresh entry (works on streams and on tables). Rows
    that arrive more than ``lateness`` behind the stream are dropped."""
    def span(c):
        return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(ttl_hours * 3_600_000_000)).cast("long")

    g = lookups.withWatermark(ts, lateness).withColumn("__in", span(ts)).alias("g")
    s = stores.select(F.col(key).alias("__k"), F.col(ts).alias("__put_ts")).withWatermark("__put_ts", lateness)
    s = s.withColumn("__span", F.explode(F.array(span("__put_ts"), span("__put_ts") + 1))).alias("s")
    cond = ((F.col(f"g.{key}") == F.col("s.__k")) & (F.col("g.__in") == F.col("s.__span"))
            & (F.col("s.__put_ts") <= F.col(f"g.{ts}"))
            & (F.col("s.__put_ts") > F.col(f"g.{ts}") - F.expr(f"INTERVAL {int(ttl_hours)} HOURS")))
    return g.join(s, cond, "left_semi").drop("__in")


def ttl_hits_batch(lookups: DataFrame, stores: DataFrame, key: str, ts: str = "ts",
                   ttl_hours: int = C.CACHE_TTL_HOURS) -> DataFrame:
    """Batch twin without watermarks, as equi-joins on (key, day) buckets.

    With a TTL of at most one day, a lookup at t can only be answered by a store
    of its own day or of the previous day. Of the stores of one (key, day) only
    two matter: the earliest (a same-day lookup hits iff it is at or before t)
    and the latest (a next-day lookup hits iff it is after t - ttl). So the store
    side is reduced to one row per (key, day) by a map-side-combined aggregate
    before any join — a key with millions of stores cannot skew it — and each
    lookup is two many-to-one left joins."""
    if ttl_hours > 24:
        raise ValueError("day buckets assume a TTL of at most 24 hours")
    day = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 86400).cast("long")
    per_day = (stores.select(F.col(key).alias("__k"), day.alias("__day"), F.col(ts).cast("timestamp").alias("__t"))
               .groupBy("__k", "__day").agg(F.min("__t").alias("__first"), F.max("__t").alias("__last")))
    g = lookups.withColumn("__day", day).withColumn("__prev", F.col("__day") - 1)
    same = per_day.select(F.col("__k").alias("__k1"), F.col("__day").alias("__d1"), "__first")
    prev = per_day.select(F.col("__k").alias("__k2"), F.col("__day").alias("__d2"), "__last")
    j = (g.join(same, (g[key] == same["__k1"]) & (g["__day"] == same["__d1"]), "left")
         .join(prev, (g[key] == prev["__k2"]) & (g["__prev"] == prev["__d2"]), "left"))
    t = F.col(ts).cast("timestamp")
    window_start = t - F.expr(f"INTERVAL {int(ttl_hours)} HOURS")
    hit = (F.coalesce(F.col("__first") <= t, F.lit(False))
           | F.coalesce((F.col("__last") > window_start) & (F.col("__last") <= t), F.lit(False)))
    return j.filter(hit).select(*lookups.columns)
