"""Snapshot merge (J5) and key joins on hand tables; merge properties."""

from pyspark.sql import functions as F

from postwise.operators import dedup as W
from postwise.operators import merge as J

PREV = "job_url string, seq long, first_seen string, last_seen string, job_title string"
NEW = "job_url string, seq long, job_title string"
SEEN = "job_url string, seen_at timestamp"


def test_stamp_and_retain_hand_table(spark):
    import datetime as dt

    prev = spark.createDataFrame([
        ("u1", 1, "2024-01-01", "2024-01-05", "old u1"),
        ("u1", 2, "", "2024-01-06", "newer u1"),        # last row per key wins: first_seen '' → falls through
        ("u2", 3, "2024-01-02", "2024-01-09", "u2"),    # not in new, last_seen >= cutoff → carried
        ("u3", 4, "2023-12-01", "2023-12-20", "u3"),    # not in new, too old → expired
        ("u4", 5, None, None, "u4"),                    # not in new, seen date 2024-01-12 → carried
        ("", 6, "2024-01-10", "2024-01-10", "keyless"),  # keyless previous row: dropped
    ], PREV)
    new = spark.createDataFrame([("u1", 10, "u1 again"), ("u1", 11, "u1 twice"), ("", 12, "no key"),
                                 ("u5", 13, "brand new")], NEW)
    seen = spark.createDataFrame([("u1", dt.datetime(2023, 11, 30, 8)), ("u4", dt.datetime(2024, 1, 12, 23))], SEEN)
    out = J.stamp_and_retain(new, prev, seen, "2024-01-15", retain=True, retain_days=10)
    got = sorted((r.job_url, r.seq, r.first_seen, r.last_seen, r.stale) for r in out.collect())
    assert got == [
        ("", 12, "2024-01-15", "2024-01-15", None),
        ("u1", 10, "2023-11-30", "2024-01-15", None),
        ("u1", 11, "2023-11-30", "2024-01-15", None),
        ("u2", 3, "2024-01-02", "2024-01-09", True),
        ("u4", 5, None, None, True),
        ("u5", 13, "2024-01-15", "2024-01-15", None),
    ]
    only = J.stamp_and_retain(new, prev, seen, "2024-01-15", retain=False)
    assert only.count() == 4


def test_merge_idempotent_for_equal_as_of(spark):
    from postwise.sources.fixtures import fixtures

    from .conftest import SMALL

    new, prev, seen = fixtures(spark, SMALL, "fx_posting", "fx_prev", "fx_seen")
    new = W.dedup_first_by_url(new.select("seq", "job_url", "job_title"))
    once = J.stamp_and_retain(new, prev, seen, "1998-01-20")
    twice = J.stamp_and_retain(new, once.withColumn("seq", F.col("seq")), seen, "1998-01-20")
    cols = ["job_url", "first_seen", "last_seen"]
    a = sorted(tuple(r) for r in once.filter(F.col("stale").isNull()).select(*cols).collect())
    b = sorted(tuple(r) for r in twice.filter(F.col("stale").isNull()).select(*cols).collect())
    assert a == b


def test_first_per_url_is_subset(spark):
    from postwise.sources.fixtures import fixture

    from .conftest import SMALL

    p = fixture(spark, SMALL, "fx_posting")
    firsts = W.dedup_first_by_url(p)
    assert firsts.join(p, ["seq", "job_url"], "left_anti").count() == 0
    assert firsts.groupBy("job_url").count().filter("count > 1").count() == 0


def test_sponsor_update_first_row_last_writer(spark):
    sponsors = spark.createDataFrame([(1, "k1", None), (2, "k1", "x"), (3, "k2", "same")],
                                     "ord long, kvk string, careers_url string")
    companies = spark.createDataFrame([(10, "k1", "a"), (11, "k1", "b"), (12, "k2", "same"), (13, "", "c")],
                                      "ord long, kvk string, careers_url string")
    got = sorted(tuple(r) for r in J.sponsor_update(sponsors, companies).select("ord", "careers_url", "changed").collect())
    assert got == [(1, "b", True), (2, "x", False), (3, "same", False)]


def test_an_export_sorts_no_whole_postings(spark):
    """the lookups of an export hash the store's side, and its write needs no sort by feed."""
    from postwise.operators import merge as J
    from postwise.session import scratch_path
    from postwise.sources import snapshots as SN

    posts = spark.createDataFrame([(f"u{i % 7}" if i % 5 else None, i, "x" * 50, "portal" if i % 2 else "search")
                                   for i in range(60)], "job_url string, seq long, description string, feed string")
    seen = spark.createDataFrame([("u1", "2024-01-02"), ("u1", "2024-01-05"), (None, "2024-01-01")],
                                 "job_url string, at string").selectExpr("job_url", "CAST(at AS timestamp) AS seen_at")
    scores = spark.createDataFrame([("u2", 7), ("u2", 9), ("", 1)], "job_url string, score int")
    out = J.attach_scores(J.backfill_first_seen(posts, seen, "2024-02-01"), scores)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
    back = spark.read.parquet(SN.write_snapshot(out, scratch_path(spark, "t-export"), partition_by=["feed"]))
    got = {r.seq: (r.job_url, r.feed, r.first_seen, r.ai_score) for r in back.collect()}
    assert got == {r.seq: (r.job_url, r.feed, "2024-01-05" if r.job_url == "u1" else "2024-02-01",
                           9 if r.job_url == "u2" else None) for r in posts.collect()}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
