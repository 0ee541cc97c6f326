"""Keep-first / keep-last / per-group caps.

All of them are ``row_number() <= n`` over a key window. Spark plans that shape
with a partial WindowGroupLimit *before* the shuffle, so a hot key (even a third
of all rows) reaches the final task as at most ``n`` rows per map partition —
the same effect as a map-side combine. Order columns must make the pick
deterministic (arrival order, unique per key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import first_truthy, truthy


def _ordered(order) -> list[Column]:
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _cols(keys) -> list[Column]:
    keys = [keys] if isinstance(keys, (str, Column)) else list(keys)
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def first_per_key(df: DataFrame, keys, order, n: int = 1, desc: bool = False) -> DataFrame:
    """Keep the first ``n`` rows per key in ``order`` (last ``n`` when ``desc``)."""
    ords = _ordered(order)
    if desc:
        ords = [o.desc() for o in ords]
    w = Window.partitionBy(*_cols(keys)).orderBy(*ords)
    rn = "__rn"
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n).drop(rn)


def dedup_first_by_url(df: DataFrame, url: str = "job_url", order="seq", scope=()) -> DataFrame:
    """First row per URL in arrival order; rows with an empty URL are dropped."""
    kept = df.filter(truthy(url).isNotNull())
    return first_per_key(kept, list(scope) + [url], order)


def dedup_first_keep_empty(df: DataFrame, url: str = "job_url", order="seq", scope=()) -> DataFrame:
    """W1 variant: '' is a key like any other (one '' row survives), NULL → ''."""
    key = "__k"
    out = df.withColumn(key, F.coalesce(F.col(url), F.lit("")))
    return first_per_key(out, list(scope) + [key], order).drop(key)


def dedup_null_passthrough(df: DataFrame, key: Column | str, order="seq", scope=()) -> DataFrame:
    """First row per id; rows without an id ('' or NULL) are all kept. One
    pass: a row without an id gets a key of its own (its row number in its
    partition), so it is always the first of its group."""
    k = "__k"
    ident = truthy(key) if isinstance(key, str) else F.nullif(key, F.lit(""))
    own = F.concat(F.lit("\u0001"), F.monotonically_increasing_id().cast("string"))
    tagged = df.withColumn(k, F.coalesce(ident, own))
    return first_per_key(tagged, list(scope) + [k], order).drop(k)


def dedup_coalesced_key(df: DataFrame, cols, order="seq", scope=()) -> DataFrame:
    """First row per ``first_truthy(*cols, '')`` ('' is a key too)."""
    k = "__k"
    tagged = df.withColumn(k, first_truthy(*cols, default=""))
    return first_per_key(tagged, list(scope) + [k], order).drop(k)


def dedup_last_by_key(df: DataFrame, key: Column | str, order="seq", drop_empty: bool = True) -> DataFrame:
    """Last row per key in arrival order; empty keys dropped."""
    k = "__k"
    tagged = df.withColumn(k, F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")))
    if drop_empty:
        tagged = tagged.filter(F.col(k) != "")
    return first_per_key(tagged, [k], order, desc=True).drop(k)


def distinct_ordered(arr: Column) -> Column:
    """Distinct elements of an array, first occurrence order kept."""
    return F.array_distinct(arr)


def cap_per_group(df: DataFrame, group, order, n: int) -> DataFrame:
    """At most ``n`` rows per group, the first ones in ``order``."""
    return first_per_key(df, group, order, n=n)
