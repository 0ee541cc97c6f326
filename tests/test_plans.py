"""Plan checks: native queries stay JVM-side, dedup limits before the shuffle,
filters reach the scan."""

import pytest

from postwise.plans.catalog import load_all

from .conftest import SMALL

PYTHON_OK = {"score_plugin"}  # the user scorer is the only Python on a query path


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ranked_new_postings", "rule_score", "html_to_text", "extract_emails",
                                  "norm_greenhouse", "json_job_search", "stamp_and_retain"])
def test_no_python_evaluation(spark, name):
    p = plan(load_all()[name].run(spark, SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p


def test_plugin_uses_arrow_batches(spark):
    p = plan(load_all()["score_plugin"].run(spark, SMALL))
    assert "MapInPandas" in p and "BatchEvalPython" not in p


def test_dedup_limits_before_shuffle(spark):
    df = load_all()["dedup_first_by_url"].run(spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text


def test_filter_pushed_to_scan(spark):
    from pyspark.sql import functions as F

    from postwise.sources.fixtures import table

    df = table(spark, SMALL, "events").filter(F.col("event_type") == "view").select("event_id")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in text
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text


def test_small_dimension_is_broadcast(spark):
    """The employer dimension is small at run time, so the adaptive plan
    broadcasts it; nothing is counted or hinted beforehand."""
    from postwise.operators import normalize as N
    from postwise.plans import q_normalize as QN

    joined = N.with_company(QN.greenhouse_pages(spark, SMALL), QN.dims(spark, SMALL))
    assert "broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString().lower()
    joined.collect()
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_building_a_plan_runs_no_job(spark):
    """Over loaded tables, operators are put together without running a job."""
    from pyspark.sql import functions as F

    from postwise.operators import merge as J
    from postwise.operators import normalize as N
    from postwise.operators import scoring_ops as SO
    from postwise.plans import q_normalize as QN
    from postwise.sources.fixtures import fixture

    payloads, dims = QN.greenhouse_pages(spark, SMALL), QN.dims(spark, SMALL)
    posts, scores, seen = (fixture(spark, SMALL, n) for n in ("fx_posting", "fx_score", "fx_seen"))
    pages = fixture(spark, SMALL, "fx_job_page").select("url", "html")
    sc = spark.sparkContext
    sc.setJobGroup("build", "building plans")
    gh = N.normalize_greenhouse(payloads, dims)
    N.description_ladder(gh.withColumn("jd_base_url", F.lit("")), pages)
    N.normalize_all(payloads.withColumn("url", F.lit("https://c/x")), dims)
    SO.score_with_cache(J.new_postings_incremental(J.attach_scores(posts, scores), seen), scores)
    jobs = list(sc.statusTracker().getJobIdsForGroup("build"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs


def test_bucketed_stores_are_not_shuffled(spark):
    """J5 over a snapshot and seen store bucketed on job_url: the only shuffle in
    the per-key stage is of the new load's keys."""
    import re
    import uuid

    from postwise.operators import merge as J
    from postwise.session import scratch_path
    from postwise.sources import snapshots as SN
    from postwise.sources.fixtures import fixtures

    new, prev, seen = fixtures(spark, SMALL, "fx_posting", "fx_prev", "fx_seen")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tag = uuid.uuid4().hex[:8]
    pp, sp = scratch_path(spark, "t-bprev"), scratch_path(spark, "t-bseen")
    SN.write_bucketed(prev, f"tp_{tag}", pp, buckets=n)
    SN.write_bucketed(seen, f"ts_{tag}", sp, buckets=n)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.stamp_and_retain(new.select("seq", "job_url", "job_title", "company"),
                                 SN.read_bucketed(spark, f"tp_{tag}", pp, prev.schema, buckets=n),
                                 SN.read_bucketed(spark, f"ts_{tag}", sp, seen.schema, buckets=n), "1998-01-20")
        out.count()
        text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in text
    # the new keys, and the two sides of the stamping join; the stores add none
    # (unbucketed they would add three: the snapshot's window, two seen aggregates)
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 3, text


def test_ranking_adds_no_filter_on_the_search_for_the_range(spark):
    """A filter on the range would be pushed below the score and compute it at every step."""
    from pyspark.sql import functions as F

    from postwise.operators import ranking as O

    df = spark.range(1000, numPartitions=4).select(F.pmod(F.hash("id"), F.lit(50)).alias("score"),
                                                   F.col("id").alias("seq"), F.col("id").cast("string").alias("job_url"))
    ranked = O.rank_by_score(df)
    assert "Filter isnotnull(aggregate" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 1001))


def test_the_texts_of_a_score_are_computed_once_a_row(spark):
    """F1: under the condition of the cached score each phrase looked up had its text made anew."""
    from postwise.operators.scoring_ops import score_with_cache
    from postwise.session import scratch_path

    path = scratch_path(spark, "t-score")
    spark.createDataFrame([("u1", "Python Engineer", "c", "Java", True, False), (None, None, None, None, None, None)],
                          "job_url string, job_title string, company string, description string, visa_support boolean, "
                          "relocation_support boolean").write.parquet(path)
    out = score_with_cache(spark.read.parquet(path), spark.createDataFrame([("u2", 5)], "job_url string, score int"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 4
    assert out.columns[-2:] == ["from_cache", "score"] and out.count() == 2
