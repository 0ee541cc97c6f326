"""Seen store and bucketed snapshot: which files a batch reads and rewrites."""

import random

from pyspark.sql import functions as F

from postwise.operators import ranking as O
from postwise.session import scratch_path
from postwise.sources import snapshots as SN
from postwise.sources.seen_store import SeenStore
from postwise.streaming import retention as SR

SEEN = "job_url string, seen_at timestamp"


def urls(spark, numbers):
    return spark.createDataFrame([(f"https://j/{n:06d}",) for n in numbers], "job_url string").selectExpr(
        "job_url", "timestamp'2024-01-01' AS seen_at")


def known(store, spark, numbers, before):
    keys = urls(spark, numbers).select("job_url").distinct()
    return {int(r[0][-6:]) for r in store.known(keys, before).collect()}


def test_a_batch_reads_only_files_that_can_hold_its_keys(spark):
    store = SeenStore(scratch_path(spark, "t-seen"), rows_per_file=100)
    store.create(urls(spark, range(0, 2000, 2)))
    ranges = store._ranges(spark, 0)
    assert len(ranges) >= 5
    keys = urls(spark, [10, 11, 12]).select("job_url")
    assert len(store.files_for(keys, ranges)) == 1
    assert known(store, spark, [10, 11, 12, 999_999], 0) == {10, 12}
    assert store.files_for(urls(spark, [999_999]).select("job_url"), ranges) == []


def test_files_read_do_not_grow_with_the_past(spark):
    rng, store = random.Random(2), SeenStore(scratch_path(spark, "t-seen"), rows_per_file=100)
    store.create(urls(spark, range(0, 500)))
    marked, read = set(range(500)), []
    for batch in range(12):
        numbers = {rng.randint(0, 999) for _ in range(20)}
        assert known(store, spark, numbers, batch) == numbers & marked
        upto = store._ranges(spark, batch)[0].upto
        read.append(len(store._ranges(spark, batch)) + batch - 1 - upto)
        store.mark(urls(spark, numbers - marked), batch)
        if batch and batch % 3 == 0:
            # a replay of the maintenance, and of the batch, changes nothing
            assert store.compact(batch) >= 0 and store.compact(batch) >= 0
            assert known(store, spark, numbers, batch) == numbers & marked
        marked |= numbers
    assert max(read[6:]) <= max(read[:6]) + 6  # the files by size, plus at most three batches; not one per batch


def test_maintenance_keeps_files_without_new_keys(spark):
    store = SeenStore(scratch_path(spark, "t-seen"), rows_per_file=100)
    store.create(urls(spark, range(0, 1000)))
    before = {r.file for r in store._ranges(spark, 0)}
    store.mark(urls(spark, [5000, 5001]), 0)
    assert store.compact(1) == 1
    after = {r.file for r in store._ranges(spark, 2)}
    assert len(before - after) == 1 and known(store, spark, [3, 5000, 5002], 2) == {3, 5000}
    empty = SeenStore(scratch_path(spark, "t-seen"))
    empty.create(spark.createDataFrame([], SEEN))
    assert known(empty, spark, [1], 0) == set()
    empty.mark(urls(spark, [1]), 0)
    assert empty.compact(1) == 0 and known(empty, spark, [1, 2], 2) == {1}


def load(spark, rows):
    return spark.createDataFrame(rows, "job_url string, seq long, job_title string")


def test_retention_rewrites_changed_buckets_only(spark):
    root = scratch_path(spark, "t-snap")
    prev = load(spark, [(f"u{i}", i, "old") for i in range(200)]).selectExpr(
        "*", "'2024-01-01' AS first_seen", "if(seq < 190, '2024-01-20', '2024-01-08') AS last_seen")
    seen = spark.createDataFrame([], SEEN)
    days = ["2024-01-21", "2024-01-22", "2024-01-23", "2024-01-29"]
    SR.write_initial_snapshot(prev, root, buckets=32)
    run = SR.merge_batch(root, seen, as_of=lambda b: days[b], buckets=32)
    loads = [[("u1", 1, "new"), ("u1", 2, "again"), ("", 3, "no key")], [("u2", 1, "new")], [("u2", 1, "newer")], [("v", 1, "v")]]
    rewritten = []
    for b, rows in enumerate(loads):
        run(load(spark, rows), b)
        rewritten.append({r.bucket for r in SR._index(spark, root, b) if r.rows_version == b})
        if b == 1:
            files = set(SR.read_snapshot(spark, root, 1).inputFiles())
            run(load(spark, rows), b)  # a replay
    # the first batch turns all rows stale; then the load's bucket, that of the load before, and expiry
    assert len(rewritten[0]) == 32 and len(rewritten[1]) <= 4 and len(rewritten[2]) <= 2
    kept = {f for f in files if "version=0" in f}
    assert kept and len(kept & set(SR.read_snapshot(spark, root, 2).inputFiles())) >= len(kept) - 2
    got = {r.job_url: (r.job_title, r.first_seen, r.last_seen, r.stale) for r in SR.read_snapshot(spark, root, 3).collect()}
    assert got["u1"] == ("again", "2024-01-01", "2024-01-21", True) and got["u2"] == ("newer", "2024-01-01", "2024-01-23", True)
    assert got["v"] == ("v", "2024-01-29", "2024-01-29", None) and "" not in got
    assert got["u5"] == ("old", "2024-01-01", "2024-01-20", True) and "u195" not in got and len(got) == 191


def test_json_lines_are_split_by_one_parse(spark):
    from postwise import schemas

    src, root = scratch_path(spark, "t-lines"), scratch_path(spark, "t-split")
    lines = ['{"seq": 1, "job_url": "u"}', "{", "", '{"seq": 2}', "nonsense"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(src)
    counts = SN.land_json_lines(spark, src, schemas.POSTING_SEQ, root)
    rows = spark.read.parquet(root)
    bad = sorted(r.line for r in rows.where("readable = 'false'").collect())
    assert sorted(r.record.seq for r in rows.where("readable = 'true' AND record.seq IS NOT NULL").collect()) == [1, 2]
    assert set(bad) >= {"{", "nonsense"} and counts["rejected"] == len(bad) and sum(counts.values()) == len(lines)


def test_packed_pages_come_back_whole(spark):
    path = scratch_path(spark, "t-packed")
    pages = spark.createDataFrame([(f"u{i}", f"<p>\n{i} \"x\" é\r\n </p>") for i in range(50)] + [(None, None)], "url string, html string")
    SN.write_page_files(pages.repartition(3), path)
    back = SN.read_page_files(spark, path)
    assert sorted(map(repr, back.select("url", "html").collect())) == sorted(map(repr, pages.collect()))
    assert back.select("file").distinct().count() <= 3


def test_rank_of_ties_nulls_and_any_number_of_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "", "a", "b"]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "score int, job_url string, seq long").withColumn(
        "place", F.struct(F.col("seq").alias("ord"), F.lit("t").alias("term")))
    want = [r[2] for r in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", r[2]))]
    for ranged in (O.rank_by_score(df), *(O.global_rank(df, [("score", True), "job_url", "seq"], ranges=k) for k in (1, 2, 64))):
        assert [r.seq for r in sorted(ranged.collect(), key=lambda r: r["rank"])] == want
    same = spark.createDataFrame([(1, "u", 1)] * 500, "score int, job_url string, seq long")
    assert sorted(r["rank"] for r in O.rank_by_score(same).collect()) == list(range(1, 501))
    assert O.rank_by_score(same.limit(0)).collect() == []


def test_upsert_keeps_repeated_entries_and_needs_no_distinct_keys(spark):
    from postwise.sources import snapshots as SN

    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "job_url string, score int")
    new = spark.createDataFrame([("b", 5), ("b", 6), ("c", 7), (None, 8)], "job_url string, score int")
    out = SN.kv_upsert(old, new)
    assert sorted(tuple(r) for r in out.filter("job_url IS NOT NULL").collect()) == [
        ("a", 1), ("a", 2), ("b", 5), ("b", 6), ("c", 7)]
    assert sorted(r.score for r in out.filter("job_url IS NULL").collect()) == [4, 8]
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
