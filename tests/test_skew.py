"""Hot keys: a third of the rows share one URL, a third have none. Results stay
exact, and the plans carry the skew defences (partial window limit before the
shuffle, salted empty keys)."""

from pyspark.sql import functions as F

from postwise.operators import dedup as W
from postwise.operators import merge as J
from postwise.operators import scoring_ops as SO

N = 30_000


def skewed(spark):
    url = (F.when(F.col("id") % 3 == 0, F.lit("https://x/hot"))
           .when(F.col("id") % 3 == 1, F.lit(""))
           .otherwise(F.format_string("https://x/%d", "id")))
    return spark.range(0, N, numPartitions=12).select(
        F.col("id").alias("seq"), url.alias("job_url"), F.lit("Senior Java Developer").alias("job_title"),
        F.lit("Co").alias("company"), F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("boolean").alias("visa_support"), F.lit(None).cast("boolean").alias("relocation_support"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_per_url_with_hot_key(spark):
    p = skewed(spark)
    firsts = W.dedup_first_by_url(p)
    rows = {r.job_url: r.seq for r in firsts.collect()}
    assert len(rows) == 1 + N // 3 and rows["https://x/hot"] == 0
    assert "WindowGroupLimit" in plan(firsts)


def test_lookups_with_hot_and_empty_keys(spark):
    p = skewed(spark)
    seen = spark.createDataFrame([("https://x/hot", None)], "job_url string, seen_at timestamp")
    assert J.new_postings(p, seen).count() == N // 3           # hot key seen, empty keys never pass
    scores = spark.createDataFrame([("https://x/hot", 77)], "job_url string, score int")
    scored = SO.score_with_cache(p, scores)
    assert scored.filter(F.col("from_cache")).count() == N // 3
    assert scored.count() == N
    text = plan(scored)
    assert "monotonically_increasing_id" in text.lower() or "\\u0000" in text  # empty keys salted


def test_merge_with_hot_and_empty_keys(spark):
    p = skewed(spark)
    prev = spark.createDataFrame([("https://x/hot", 1, "2024-01-01", "2024-01-10", "t", "c")],
                                 "job_url string, seq long, first_seen string, last_seen string, job_title string, company string")
    seen = spark.createDataFrame([], "job_url string, seen_at timestamp")
    out = J.stamp_and_retain(p, prev, seen, "2024-01-15")
    got = {(r.hot, r.first_seen): r.n for r in
           out.groupBy((F.col("job_url") == "https://x/hot").alias("hot"), "first_seen").agg(F.count("*").alias("n")).collect()}
    assert got == {(True, "2024-01-01"): N // 3, (False, "2024-01-15"): 2 * N // 3}, got
