"""Run every registered query on Spark and its oracle on DuckDB; compare.

    python tools/oracle_check.py [sf_dir] [name ...]

Comparison: same column names, same row count, and the same multiset of rows
after normalising values (floats that are whole numbers → int, dates → ISO text).
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from postwise.session import get_session  # noqa: E402
from postwise.sources.fixtures import BASE_TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return norm(float(v))
    if isinstance(v, (dt.datetime,)):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: json.dumps(t, default=str))


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def check(spark, con, name, q, sf_dir):
    t0 = time.time()
    df = q.run(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if q.oracle is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(q.oracle)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    res["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS {sorted(s_cols)} vs {sorted(d_cols)}"
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a == b:
        res["status"] = "ok"
    else:
        sa, sb = set(a), set(b)
        res["status"] = "VALUES"
        res["only_spark"] = [str(x) for x in list(sa - sb)[:3]]
        res["only_oracle"] = [str(x) for x in list(sb - sa)[:3]]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from postwise.plans.catalog import load_all

    reg = load_all()
    if os.environ.get("PLAIN_SESSION"):
        # the session the driver describes: nothing but master and shuffle partitions
        from pyspark.sql import SparkSession

        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .getOrCreate())
    else:
        spark = get_session("local[8]")
    con = duck(sf_dir)
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        try:
            res = check(spark, con, name, q, sf_dir)
        except Exception as e:  # report and go on
            res = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:600]}"}
        if res["status"] not in ("ok", "rows-only"):
            bad += 1
        print(json.dumps(res), flush=True)
    print(f"# {bad} failing of {len([n for n in reg if not names or n in names])}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
