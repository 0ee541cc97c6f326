"""End-to-end flows on the smallest tables: shapes and cross-flow properties."""

from pyspark.sql import functions as F

from postwise.plans import flows as FL
from postwise.sources.fixtures import fixtures

from .conftest import SMALL


def test_hourly_then_daily(spark):
    p, seen, scores = fixtures(spark, SMALL, "fx_posting", "fx_seen", "fx_score")
    rows, header, marked = FL.hourly_digest(p, seen, scores, "2024-02-01 10:00:00")
    n = header.first()["n"]
    assert rows.count() == n > 0
    # every new posting is marked seen exactly once per key
    assert marked.count() == rows.filter(F.col("link") != "#").select("link").distinct().count()
    # after marking, a second hourly run finds nothing new
    seen2 = seen.unionByName(marked)
    _, header2, _ = FL.hourly_digest(p, seen2, scores, "2024-02-01 11:00:00")
    assert header2.first()["n"] == 0
    # the daily digest at the same time sees exactly what was just marked
    drows, dheader = FL.daily_digest(p, seen2, scores, "2024-02-01 12:00:00")
    assert dheader.first()["n"] == n


def test_aggregator_ingest_and_publish(spark):
    s, prev, seen, scores, p = fixtures(spark, SMALL, "fx_search", "fx_prev", "fx_seen", "fx_score", "fx_posting")
    agg = FL.aggregator_ingest(s, prev.filter("false"), seen, "2024-01-16")
    assert agg.snapshot.filter(F.col("stale")).count() == 0
    assert agg.snapshot.select("job_url").distinct().count() == agg.snapshot.count()  # first per URL
    out = FL.publish(p.withColumn("recruiter_email", F.lit("x@corp.nl")), agg.snapshot, seen, scores, "2024-01-16")
    assert "recruiter_email" not in out.columns
    assert out.filter(F.col("first_seen").isNull()).count() == 0


def test_portal_ingest_subset_run_keeps_other_employers(spark):
    from postwise.plans import q_normalize as QN

    pages = QN.greenhouse_pages(spark, SMALL)
    prev, seen = fixtures(spark, SMALL, "fx_prev", "fx_seen")
    prev = prev.withColumn("company", F.when(F.col("seq") % 2 == 0, F.lit("Other Co")).otherwise(F.col("company")))
    dims = QN.dims(spark, SMALL)
    names = dims.select("ind_name").limit(3)
    run = FL.portal_ingest(pages, dims, prev, seen, "1998-01-20", refreshed=names, types=["greenhouse"])
    snap = run.snapshot
    assert snap.filter(F.col("stale")).count() == 0                      # subset runs only stamp
    assert snap.filter(F.col("company") == "Other Co").count() == prev.filter(F.col("company") == "Other Co").count()
    assert snap.filter(F.col("last_seen") != "1998-01-20").count() == 0  # everything kept is stamped


def test_ingest_runs_over_a_keyed_store(spark):
    """Two runs: the first writes version 1 of a bucketed store, the second reads
    it as its previous snapshot; same rows as with a plain table."""
    import uuid

    from postwise.plans import q_normalize as QN
    from postwise.session import scratch_path
    from postwise.sources.snapshots import KeyedStore

    pages = QN.greenhouse_pages(spark, SMALL)
    prev, seen = fixtures(spark, SMALL, "fx_prev", "fx_seen")
    dims = QN.dims(spark, SMALL)
    store = KeyedStore(scratch_path(spark, "store"), f"snap_{uuid.uuid4().hex[:6]}", buckets=8)
    first = FL.portal_ingest(pages, dims, prev, seen, "1998-01-20", types=["greenhouse"], store=store, version=1)
    again = FL.portal_ingest(pages, dims, store.read(spark, 1, first.snapshot.schema), seen, "1998-01-25",
                             types=["greenhouse"])
    plain = FL.portal_ingest(pages, dims, first.snapshot, seen, "1998-01-25", types=["greenhouse"])
    cols = ["job_url", "first_seen", "last_seen", "stale"]
    a = sorted(tuple(r) for r in again.snapshot.select(*cols).collect())
    b = sorted(tuple(r) for r in plain.snapshot.select(*cols).collect())
    assert a == b and len(a) > 0


def test_portal_ingest_returns_rejected_payloads(spark):
    from postwise.operators import normalize as N
    from postwise.plans.q_normalize import dims

    rows = [("A", "greenhouse", 0, "u", '{"jobs": []}'), ("B", "lever", 0, "u", "[{"), ("C", None, 0, "u", None),
            ("D", "odd", 0, "u", " "), ("E", "workday", 0, "u", "{"), ("F", "html", 0, "u", "<p>no JSON {")]
    payloads = spark.createDataFrame(rows, "company string, source_type string, page int, url string, body string")
    found = lambda types: sorted((r.company, r.reason) for r in N.rejected_payloads(payloads, types).collect())
    assert found(None) == [("B", "malformed"), ("C", "empty"), ("D", "empty"), ("E", "malformed")]
    assert found(["lever"]) == [("B", "malformed")] and found(["html"]) == [("C", "empty"), ("D", "empty")]
    prev, seen = fixtures(spark, SMALL, "fx_prev", "fx_seen")
    run = FL.portal_ingest(payloads, dims(spark, SMALL), prev, seen, "1998-01-20", types=["greenhouse", "lever", "html"])
    assert sorted(r.company for r in run.rejected.collect()) == ["B", "C", "D"]


def test_mixed_pages_are_built_from_their_own_employers(spark):
    from postwise.plans import q_flows as QF
    from postwise.plans import q_normalize as QN

    dealt = QN.Dealt(spark, SMALL, "mixed", QF._part(QF._kind()))
    whole = QN.base(spark, SMALL)
    names = whole.select("company").distinct().count()
    parts = [r[0] for r in QF.employers(spark, SMALL).select(QF._part(F.col("source_type"))).distinct().collect()]
    assert sum(dealt.of(p).postings.select("company").distinct().count() for p in parts) == names
    assert sum(dealt.of(p).postings.count() for p in parts) == whole.count()
    own = dealt.of("lever")
    got = QN.lever_pages(spark, SMALL, only=own).select("company", "page", "body")
    want = QN.lever_pages(spark, SMALL).join(own.employers.select("company"), "company", "left_semi").select(
        "company", "page", "body")
    assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
