"""Ordering operators (O1-O3).

``global_rank`` numbers rows 1..N in a total order without moving all rows into one
task (a window without PARTITION BY would) and without writing them anywhere. The
order is cut into ranges at boundaries taken once from a bounded sample of the order
columns; they become literals of the plan, so every pass, retry and lost executor sees
the same ranges. Rows are dealt by range; each range is numbered by a window of its
own and moved by the number of rows in the ranges before it. The counts are one
aggregate over the order columns alone, combined map-side to one row per range.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of one ranking, and sampled keys per range.
MAX_RANGES = 2000
SAMPLES_PER_RANGE = 20


def _sort_cols(order) -> list[Column]:
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _keys(order) -> list[tuple[str, bool]]:
    """(column, descending) pairs; a name alone ascends. Nulls come first in an
    ascending and last in a descending column, as Spark sorts by default."""
    order = [order] if isinstance(order, str) else list(order)
    return [(o, False) if isinstance(o, str) else (o[0], bool(o[1])) for o in order]


def _sorted_by(keys) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in keys]


def _before(bound: Column, keys) -> Column:
    """Whether a boundary (struct of the order columns) sorts before the row."""
    def one(c: str, down: bool) -> Column:
        b, r = bound[c], F.col(c)
        if down:
            return F.coalesce(b > r, F.lit(False)) | (b.isNotNull() & r.isNull())
        return F.coalesce(b < r, F.lit(False)) | (b.isNull() & r.isNotNull())

    return reduce(lambda later, k: one(*k) | (bound[k[0]].eqNullSafe(F.col(k[0])) & later), reversed(keys), F.lit(False))


def boundaries(df: DataFrame, keys, ranges: int) -> list:
    """At most ``ranges - 1`` keys that cut ``df`` into ranges of about equal size:
    quantiles of a sample of distinct keys, those with the smallest hashes. Only the
    sample (``ranges * SAMPLES_PER_RANGE`` keys at most) comes to the driver."""
    names = [c for c, _ in keys]
    sample = (df.select(*names).orderBy(F.xxhash64(*names)).limit(ranges * SAMPLES_PER_RANGE).distinct()
              .orderBy(*_sorted_by(keys)).collect())
    step = max(1, -(-len(sample) // ranges))
    return sample[step::step]


def range_of(bounds: list, df: DataFrame, keys) -> Column:
    """The number of boundaries that sort before the row, by binary search. Never null, and
    known to be so: a join on it then adds no filter, which would be pushed below the
    columns' own expressions and evaluate them at every step of the search."""
    if not bounds:
        return F.lit(0)
    kind = T.ArrayType(df.select(*[c for c, _ in keys]).schema)
    # one literal of the plan, however many boundaries
    table = F.from_json(F.lit(json.dumps([r.asDict(recursive=True) for r in bounds], default=str)), kind)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]

    def search(n: Column, step: Column) -> Column:
        more = n + step
        return F.when((more <= len(bounds)) & _before(F.element_at(table, F.least(more, F.lit(len(bounds)))), keys),
                      more).otherwise(n)

    return F.coalesce(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), search), F.lit(0))


def global_rank(df: DataFrame, order, rank_col: str = "rank", ranges: int | None = None) -> DataFrame:
    """O1: add ``rank_col`` = 1-based position in ``order``: column names, or (name,
    descending) pairs, that make a total order. Rows that are equal in all of them
    are numbered in any order."""
    spark, keys = df.sparkSession, _keys(order)
    ranges = min(MAX_RANGES, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = boundaries(df, keys, ranges)
    dealt = df.withColumn("__range", range_of(bounds, df, keys))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*_sorted_by(keys)))
    # one row per range: a bounded table, so the running sum may use one task
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    so_far = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__range", F.coalesce(so_far, F.lit(0)).alias("__off"))
    ranked = dealt.withColumn("__at", local).join(F.broadcast(offsets), "__range")
    return ranked.withColumn(rank_col, (F.col("__off") + F.col("__at")).cast("bigint")).drop("__range", "__off", "__at")


def rank_by_score(df: DataFrame, score: str = "score", tie=("job_url", "place", "seq"), rank_col: str = "rank") -> DataFrame:
    """O1: score descending, ties by URL then arrival, rank column emitted."""
    return global_rank(df, [(score, True), *[t for t in tie if t in df.columns]], rank_col)


def top_k(df: DataFrame, k: int, order, rank_col: str | None = "rank") -> DataFrame:
    """O2: first ``k`` rows in ``order`` (per-partition top-k, then one merge of
    at most k rows per partition); the rank of the k survivors is then cheap."""
    cols = _sort_cols(order)
    out = df.orderBy(*cols).limit(k)
    if rank_col:
        out = out.withColumn(rank_col, F.row_number().over(Window.orderBy(*cols)).cast("bigint"))
    return out


def order_preserved(df: DataFrame, order=("ord", "seq")) -> DataFrame:
    """O3: range-partitioned global sort on the dimension order."""
    return df.orderBy(*_sort_cols(order))
