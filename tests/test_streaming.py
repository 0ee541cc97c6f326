"""Incremental properties: the hourly job over k batches leaves the same seen
keys as over one batch; a replayed batch writes the same digest."""

from pyspark.sql import functions as F

from postwise.session import scratch_path
from postwise.sources.fixtures import fixtures
from postwise.streaming import common as SC
from postwise.streaming import hourly as SH

from .conftest import SMALL


def run_hourly(spark, rounds):
    p, seen, scores = fixtures(spark, SMALL, "fx_posting", "fx_seen", "fx_score")
    p = p.select("seq", "job_url", "company", "job_title", "location", "description", "visa_support",
                 "relocation_support")
    root = scratch_path(spark, "t-hourly")
    src, seen_dir, digest, ckpt = f"{root}/s", f"{root}/seen", f"{root}/d", f"{root}/c"
    SH.write_initial_seen(seen, seen_dir)
    for r in range(rounds):
        SC.land(p.filter(F.col("seq") % rounds == r), src)
        SC.run_available(SH.hourly_stream(SC.stream_files(spark, src, p.schema), seen_dir, digest, scores,
                                          as_of=lambda b: "2024-02-01 00:00:00"), ckpt)
    keys = {r[0] for r in spark.read.parquet(seen_dir).filter("batch_id >= 0").select("job_url").distinct().collect()}
    return keys, root


def test_k_batches_same_seen_keys_as_one(spark):
    one, _ = run_hourly(spark, 1)
    three, _ = run_hourly(spark, 3)
    assert one == three and len(one) > 0


def test_replayed_batch_is_idempotent(spark):
    p, seen, scores = fixtures(spark, SMALL, "fx_posting", "fx_seen", "fx_score")
    p = p.select("seq", "job_url", "company", "job_title", "location", "description", "visa_support",
                 "relocation_support")
    root = scratch_path(spark, "t-replay")
    SH.write_initial_seen(seen, f"{root}/seen")
    fn = SH.hourly_batch(f"{root}/seen", f"{root}/d", scores, as_of=lambda b: "2024-02-01 00:00:00")
    fn(p, 0)
    first = sorted(tuple(r) for r in spark.read.parquet(f"{root}/d").select("seq", "score").collect())
    fn(p, 0)  # the same batch again (e.g. after a failure before the commit)
    again = sorted(tuple(r) for r in spark.read.parquet(f"{root}/d").select("seq", "score").collect())
    assert first == again and len(first) > 0


def test_keyed_cache_forgets_keys_after_the_ttl(spark):
    """Hits equal those of the rule; the state holds the keys of the last TTL only."""
    import datetime as dt
    import random

    from postwise.session import scratch_path
    from postwise.streaming import common as SC
    from postwise.streaming.first_sight import STATE_STORE
    from postwise.streaming.keyed_cache import keyed_ttl_hits

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rng, day0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(i, rng.randint(0, 15), rng.choice(["put", "get", "get"]), day0 + dt.timedelta(minutes=rng.randint(0, 4 * 24 * 60)))
            for i in range(600)]
    rows += [(1000, 99, "put", day0 + dt.timedelta(days=30))]  # moves the watermark past all the others
    events = spark.createDataFrame(rows, "event_id long, user_id long, kind string, ts timestamp")
    root = scratch_path(spark, "t-ttl")
    totals = []
    for a, b in ((0, 2), (2, 4), (4, 40)):
        SC.land(events.filter((events.ts >= day0 + dt.timedelta(days=a)) & (events.ts < day0 + dt.timedelta(days=b))), f"{root}/s")
        hits = keyed_ttl_hits(SC.stream_files(spark, f"{root}/s", events.schema), "user_id", "kind = 'put'", "event_id",
                              lateness="1 hour")
        q = (hits.writeStream.format("parquet").option("path", f"{root}/o").outputMode("append")
             .option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start())
        assert q.awaitTermination(120) and q.exception() is None
        totals.append(max(p.stateOperators[0].numRowsTotal for p in q.recentProgress[-1:]))
    want = {(u, i) for i, u, k, t in rows if k == "get" and any(
        v == u and kk == "put" and t - dt.timedelta(hours=24) < tt <= t for _, v, kk, tt in rows)}
    got = [(r.user_id, r.id) for r in spark.read.parquet(f"{root}/o").collect()]
    assert sorted(got) == sorted(want)
    assert min(totals[:2]) >= 10 and totals[-1] == 1, totals  # the last key alone is left


def test_a_run_has_no_time_limit_of_its_own():
    import inspect

    from postwise.streaming.common import run_available

    assert inspect.signature(run_available).parameters["timeout_s"].default is None


def test_the_ttl_join_keeps_one_store_a_partition(spark):
    """F16: hits of the stream join equal the rule; of a partition one state store is opened, not four."""
    import datetime as dt
    import random

    from postwise.streaming.first_sight import STATE_STORE
    from postwise.streaming.ttl_cache import ttl_hits

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rng, day0 = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice([None, *range(12)]), rng.choice(["put", "get"]), day0 + dt.timedelta(minutes=rng.randint(0, 6 * 24 * 60)))
            for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, kind string, ts timestamp")
    root, name = scratch_path(spark, "t-ttl-join"), "spark.sql.streaming.join.stateFormatVersion"
    before = spark.conf.get(name)
    for a, b in ((0, 3), (3, 7)):
        SC.land(events.filter((events.ts >= day0 + dt.timedelta(days=a)) & (events.ts < day0 + dt.timedelta(days=b))), f"{root}/s")
        s = SC.stream_files(spark, f"{root}/s", events.schema)
        hits = ttl_hits(s.filter("kind = 'get'"), s.filter("kind = 'put'"), key="user_id", lateness="1 hour")
        with SC.settings(spark, SC.JOIN_STATE):
            q = SC.run_available(hits.select("user_id", "event_id").writeStream.format("parquet").option("path", f"{root}/o")
                                 .outputMode("append"), f"{root}/c")
        state = q.lastProgress.stateOperators[0]
        assert state.numStateStoreInstances == state.numShufflePartitions
    assert spark.conf.get(name) == before
    want = {(u, i) for i, u, k, t in rows if k == "get" and any(
        v == u and v is not None and kk == "put" and t - dt.timedelta(hours=24) < tt <= t for _, v, kk, tt in rows)}
    got = [tuple(r) for r in spark.read.parquet(f"{root}/o").select("user_id", "event_id").collect()]
    assert sorted(got) == sorted(want) and len(want) > 50


def test_calls_of_the_keyed_cache_do_not_grow_with_its_keys(spark):
    """many keys share a state row and a call; null keys and id gaps change nothing."""
    import datetime as dt
    import random

    from postwise.streaming.first_sight import STATE_STORE
    from postwise.streaming.keyed_cache import keyed_ttl_hits

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rng, day0 = random.Random(8), dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice([None, *(f"k{j}" for j in range(200))]), rng.choice(["put", "get"]),
             day0 + dt.timedelta(minutes=rng.randint(0, 3 * 24 * 60))) for i in range(1500)]
    rows += [(9000 + i, *rows[i][1:]) for i in range(100)]  # equal keys and times
    events = spark.createDataFrame(rows, "event_id long, name string, kind string, ts timestamp")
    root, kept = scratch_path(spark, "t-groups"), []
    for a, b in ((0, 1), (1, 4)):
        SC.land(events.filter((events.ts >= day0 + dt.timedelta(days=a)) & (events.ts < day0 + dt.timedelta(days=b))), f"{root}/s")
        hits = keyed_ttl_hits(SC.stream_files(spark, f"{root}/s", events.schema), "name", "kind = 'put'", "event_id",
                              groups=8, lateness="1 hour")
        q = SC.run_available(hits.writeStream.format("parquet").option("path", f"{root}/o").outputMode("append"), f"{root}/c")
        kept.append(q.lastProgress.stateOperators[0].numRowsTotal)
    assert 0 < max(kept) <= 16, kept  # a row and a timer a group
    want = {(u, i) for i, u, k, t in rows if k == "get" and any(
        v == u and v is not None and kk == "put" and t - dt.timedelta(hours=24) < tt <= t for _, v, kk, tt in rows)}
    got = [tuple(r) for r in spark.read.parquet(f"{root}/o").select("name", "id").collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_state_rows_of_first_sight_do_not_grow_with_its_keys(spark):
    """many keys share a state row and a call; the rows that pass are those of the rule."""
    import random

    from postwise.streaming.first_sight import STATE_STORE, first_sight

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rng = random.Random(4)
    keys = [None, "", 'a "b"\n,é', *(f"https://x/{i}" for i in range(300))]
    rows = [(i, rng.choice(keys), rng.choice([None, True, False])) for i in range(900)] + [(1000 + i, "https://x/0", True) for i in range(50)]
    old = [("https://x/5", "2024-01-01 00:00:00"), ("https://x/5", "2024-01-02 00:00:00"), ("https://x/6", None),
           ("https://x/unasked", "2024-01-01 00:00:00"), ("", "2024-01-01 00:00:00"), (None, None)]
    seen = spark.createDataFrame(old, "job_url string, seen_at string")
    postings = spark.createDataFrame(rows, "seq long, job_url string, visa boolean")
    root, kept = scratch_path(spark, "t-first"), []
    for r in range(3):
        SC.land(postings.filter(F.col("seq") % 3 == r), f"{root}/s")
        new = first_sight(SC.stream_files(spark, f"{root}/s", postings.schema), seen, "2024-02-01 00:00:00", groups=4, slots=2)
        q = SC.run_available(new.writeStream.format("parquet").option("path", f"{root}/o").outputMode("append"), f"{root}/c")
        kept.append(q.lastProgress.stateOperators[0].numRowsTotal)
    assert 0 < max(kept) <= 8, kept
    known, want = {k for k, _ in old}, []
    for r in range(3):
        batch = [x for x in rows if x[0] % 3 == r and x[1] and x[1] not in known]
        want += batch
        known |= {x[1] for x in batch}
    got = spark.read.parquet(f"{root}/o")
    assert got.columns == postings.columns
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(want, key=str) and len(want) > 300
