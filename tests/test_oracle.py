"""Every registered query against its DuckDB oracle on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import check  # noqa: E402
from postwise.plans.catalog import load_all  # noqa: E402

from .conftest import SMALL  # noqa: E402

REG = load_all()


@pytest.mark.parametrize("name", sorted(REG))
def test_query_matches_oracle(spark, duck, name):
    res = check(spark, duck, name, REG[name], SMALL)
    assert res["status"] in ("ok", "rows-only"), res


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert set(df.columns) == {"job_url", "company", "job_title", "location", "score", "band", "rank"}
    assert df.count() >= 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
