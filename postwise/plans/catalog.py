"""Registry of named queries: the Spark plan and its DuckDB oracle side by side.

A query is a function ``(spark, sf_dir) -> DataFrame`` over the driver's tables
(or fixtures Spark derives from them). Its oracle is independent SQL over the
same tables; fixtures enter the oracle as CTEs of the same SQL text.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from ..sources.fixtures import oracle_with


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    rows_only_reason: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, fixtures=(), rows_only: str | None = None):
    """Register ``fn`` as query ``name``; ``oracle`` is the SQL body after the
    fixture CTEs (``None`` with a reason when not expressible in SQL)."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        sql = oracle_with(fixtures, oracle) if oracle is not None else None
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, run, sql, rows_only)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills the registry
    from . import q_core, q_flows, q_merge, q_normalize, q_sources, q_stream  # noqa: F401

    return REGISTRY
