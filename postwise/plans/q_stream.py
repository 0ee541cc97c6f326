"""Queries: incremental / streaming operators (T1, T2, T4, T5), run to completion
over rounds of landed input, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..session import scratch_path
from ..sources.fixtures import fixtures
from ..streaming import common as SC
from ..streaming import dedup as SD
from ..streaming import hourly as SH
from ..streaming import retention as SR
from ..streaming import ttl_cache as ST
from . import sqlgen as Q
from .catalog import query

ROUNDS = 4
POSTING_COLS = ["seq", "job_url", "company", "job_title", "location", "description", "visa_support",
                "relocation_support"]


def _rounds(df, n, col="seq"):
    return [df.filter(F.col(col) % n == r) for r in range(n)]


@query("stream_new_postings", fixtures=["fx_posting", "fx_seen", "fx_score"], oracle=f"""
, sc AS (SELECT job_url, CAST(max(score) AS INTEGER) AS score FROM fx_score WHERE coalesce(job_url, '') <> '' GROUP BY job_url),
nw AS (SELECT p.*, CAST(p.seq % {ROUNDS} AS BIGINT) AS b FROM fx_posting p WHERE coalesce(job_url, '') <> ''
  AND NOT EXISTS (SELECT 1 FROM fx_seen s WHERE s.job_url = p.job_url)),
mb AS (SELECT job_url, min(b) AS mb FROM nw GROUP BY job_url)
SELECT batch_id, seq, job_url, score, row_number() OVER (PARTITION BY batch_id ORDER BY score DESC, job_url, seq) AS rank
FROM (SELECT nw.b AS batch_id, nw.seq, nw.job_url,
  CASE WHEN sc.score IS NOT NULL THEN sc.score ELSE {Q.rule_score(notes='NULL')} END AS score
  FROM nw JOIN mb ON mb.job_url = nw.job_url AND mb.mb = nw.b LEFT JOIN sc ON sc.job_url = nw.job_url)""")
def stream_new_postings(spark, sf):
    """The hourly job over four rounds of postings; the ranked digest rows of all batches."""
    p, seen, scores = fixtures(spark, sf, "fx_posting", "fx_seen", "fx_score")
    p = p.select(*POSTING_COLS)
    root = scratch_path(spark, "hourly")
    src, seen_dir, digest, ckpt = f"{root}/source", f"{root}/seen", f"{root}/digest", f"{root}/checkpoint"
    SH.write_initial_seen(seen, seen_dir)
    for part in _rounds(p, ROUNDS):
        SC.land(part, src)
        stream = SC.stream_files(spark, src, p.schema)
        SC.run_available(SH.hourly_stream(stream, seen_dir, digest, scores,
                                          as_of=lambda b: f"2024-02-01 {b:02d}:00:00", compact_every=2), ckpt)
    out = spark.read.parquet(digest)
    return out.select(F.col("batch_id").cast("bigint").alias("batch_id"), "seq", "job_url", "score", "rank")


@query("stream_ttl_cache", oracle="""
SELECT g.user_id, g.event_id FROM events g WHERE g.event_type = 'view'
  AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = g.user_id AND p.event_type = 'purchase'
              AND p.ts <= g.ts AND p.ts > g.ts - INTERVAL 24 HOURS)""")
def stream_ttl_cache(spark, sf):
    """Purchases store a per-user entry, views look it up; hits within 24 hours.
    Run as a stream-stream semi join over weekly rounds of events."""
    from ..sources.fixtures import table
    from ..streaming.first_sight import STATE_STORE

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # join state off-heap, spillable
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    root = scratch_path(spark, "ttl")
    src, out, ckpt = f"{root}/source", f"{root}/hits", f"{root}/checkpoint"
    week = F.floor((F.dayofmonth("ts") - 1) / 7)
    for r in range(5):
        SC.land(ev.filter(week == r), src)
        s = SC.stream_files(spark, src, ev.schema)
        hits = ST.ttl_hits(s.filter(F.col("event_type") == "view"), s.filter(F.col("event_type") == "purchase"),
                           key="user_id", lateness="1 hour")
        with SC.settings(spark, SC.JOIN_STATE):
            SC.run_available(hits.select("user_id", "event_id").writeStream.format("parquet").option("path", out)
                             .outputMode("append"), ckpt)
    return spark.read.parquet(out)


@query("stream_ttl_state", oracle="""
SELECT g.user_id, g.event_id FROM events g WHERE g.event_type = 'view'
  AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = g.user_id AND p.event_type = 'purchase'
              AND p.ts <= g.ts AND p.ts > g.ts - INTERVAL 24 HOURS)""")
def stream_ttl_state(spark, sf):
    """T2 as keyed state with event-time expiry, over the same rounds of events."""
    from ..sources.fixtures import table
    from ..streaming.first_sight import STATE_STORE
    from ..streaming.keyed_cache import keyed_ttl_hits

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    root = scratch_path(spark, "ttl-state")
    src, out, ckpt = f"{root}/source", f"{root}/hits", f"{root}/checkpoint"
    week = F.floor((F.dayofmonth("ts") - 1) / 7)
    for r in range(5):
        SC.land(ev.filter(week == r), src)
        s = SC.stream_files(spark, src, ev.schema).filter(F.col("event_type").isin("view", "purchase"))
        hits = keyed_ttl_hits(s, "user_id", "event_type = 'purchase'", "event_id", lateness="1 hour")
        with SC.settings(spark, SC.CHANGES_ONLY):
            SC.run_available(hits.writeStream.format("parquet").option("path", out).outputMode("append"), ckpt)
    return spark.read.parquet(out).select("user_id", F.col("id").alias("event_id"))


@query("cache_hits_ranged", oracle="""
SELECT g.user_id, g.event_id FROM events g WHERE g.event_type = 'view'
  AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = g.user_id AND p.event_type = 'purchase'
              AND p.ts <= g.ts AND p.ts > g.ts - INTERVAL 24 HOURS)""")
def cache_hits_ranged(spark, sf):
    """J7/T2 batch twin: the 24-hour range join as a (key, day) bucket equi-join."""
    from ..sources.fixtures import table

    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    hits = ST.ttl_hits_batch(ev.filter(F.col("event_type") == "view"), ev.filter(F.col("event_type") == "purchase"),
                             key="user_id")
    return hits.select("user_id", "event_id")


RETENTION_AS_OF = ("1998-01-20", "1998-01-25", "1998-01-30")


def _j5_sql(new: str, prev: str, as_of: str, out: str, rnd: int) -> str:
    cutoff = f"strftime(DATE '{as_of}' - INTERVAL {C.RETAIN_DAYS} DAYS, '%Y-%m-%d')"
    return f"""
, {out}_p AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY snap_ord DESC) AS rn
    FROM {prev} WHERE coalesce(job_url, '') <> '') WHERE rn = 1),
{out} AS (
  SELECT n.job_url, n.seq, n.job_title, coalesce(nullif(p.first_seen, ''), sd.d, '{as_of}') AS first_seen,
    '{as_of}' AS last_seen, CAST(NULL AS BOOLEAN) AS stale, n.seq AS snap_ord
  FROM {new} n LEFT JOIN {out}_p p ON p.job_url = coalesce(nullif(n.job_url, ''), '')
  LEFT JOIN sd ON sd.job_url = coalesce(nullif(n.job_url, ''), '')
  UNION ALL
  SELECT p.job_url, p.seq, p.job_title, p.first_seen, p.last_seen, TRUE, {SR.CARRY_OFFSET} * {rnd + 2} + p.snap_ord
  FROM {out}_p p LEFT JOIN sd ON sd.job_url = p.job_url
  WHERE p.job_url NOT IN (SELECT coalesce(nullif(job_url, ''), '') FROM {new})
    AND coalesce(nullif(p.last_seen, ''), nullif(p.first_seen, ''), sd.d, '') <> ''
    AND coalesce(nullif(p.last_seen, ''), nullif(p.first_seen, ''), sd.d, '') >= {cutoff})
"""


def _retention_sql() -> str:
    parts = ["""
, sd AS (SELECT job_url, strftime(max(seen_at), '%Y-%m-%d') AS d FROM fx_seen WHERE coalesce(job_url, '') <> '' GROUP BY job_url),
m0 AS (SELECT job_url, seq, job_title, first_seen, last_seen, CAST(NULL AS BOOLEAN) AS stale, seq AS snap_ord FROM fx_prev)
"""]
    for r, as_of in enumerate(RETENTION_AS_OF):
        parts.append(f", n{r} AS (SELECT seq, job_url, job_title FROM fx_posting WHERE seq % 3 = {r})")
        parts.append(_j5_sql(f"n{r}", f"m{r}", as_of, f"m{r + 1}", r))
    last = len(RETENTION_AS_OF)
    return "".join(parts) + f"SELECT job_url, seq, job_title, first_seen, last_seen, stale FROM m{last}"


@query("stream_retention", fixtures=["fx_posting", "fx_prev", "fx_seen"], oracle=_retention_sql())
def stream_retention(spark, sf):
    """T4: three loads merged in turn (stamp, carry forward, expire), by buckets."""
    p, prev, seen = fixtures(spark, sf, "fx_posting", "fx_prev", "fx_seen")
    p = p.select("seq", "job_url", "job_title")
    root = scratch_path(spark, "retention")
    src, snaps, ckpt = f"{root}/source", f"{root}/snapshots", f"{root}/checkpoint"
    SR.write_initial_snapshot(prev.select("job_url", "seq", "job_title", "first_seen", "last_seen"), snaps)
    for r in range(len(RETENTION_AS_OF)):
        SC.land(p.filter(F.col("seq") % 3 == r), src)
        stream = SC.stream_files(spark, src, p.schema)
        SC.run_available(stream.writeStream.foreachBatch(
            SR.merge_batch(snaps, seen, as_of=lambda b: RETENTION_AS_OF[b])), ckpt)
    last = SR.read_snapshot(spark, snaps, len(RETENTION_AS_OF) - 1)
    return last.select("job_url", "seq", "job_title", "first_seen", "last_seen", "stale")


@query("stream_dedup", fixtures=["fx_posting"], oracle="""
SELECT DISTINCT job_url FROM fx_posting WHERE coalesce(job_url, '') <> ''""")
def stream_dedup(spark, sf):
    """T5: distinct posting URLs over four rounds (state kept across batches, in RocksDB)."""
    from ..streaming.first_sight import STATE_STORE

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    (p,) = fixtures(spark, sf, "fx_posting")
    p = p.select(*POSTING_COLS)
    root = scratch_path(spark, "dedup")
    src, out, ckpt = f"{root}/source", f"{root}/out", f"{root}/checkpoint"
    for part in _rounds(p, ROUNDS):
        SC.land(part, src)
        s = SC.stream_files(spark, src, p.schema)
        SC.run_available(SD.dedup_stream(s).writeStream.format("parquet").option("path", out)
                         .outputMode("append"), ckpt)
    return spark.read.parquet(out).select("job_url")


@query("stream_first_sight", fixtures=["fx_posting", "fx_seen", "fx_score"], oracle=f"""
, sc AS (SELECT job_url, CAST(max(score) AS INTEGER) AS score FROM fx_score WHERE coalesce(job_url, '') <> '' GROUP BY job_url),
nw AS (SELECT p.*, p.seq % {ROUNDS} AS b FROM fx_posting p WHERE coalesce(job_url, '') <> ''
  AND NOT EXISTS (SELECT 1 FROM fx_seen s WHERE s.job_url = p.job_url)),
mb AS (SELECT job_url, min(b) AS mb FROM nw GROUP BY job_url)
SELECT nw.seq, nw.job_url, CASE WHEN sc.score IS NOT NULL THEN sc.score ELSE {Q.rule_score(notes='NULL')} END AS score
FROM nw JOIN mb ON mb.job_url = nw.job_url AND mb.mb = nw.b LEFT JOIN sc ON sc.job_url = nw.job_url""")
def stream_first_sight(spark, sf):
    """T1 with keyed state: the seen set lives in the RocksDB state store (seeded
    from the seen table once), so each batch touches only the state rows its own keys
    fall into; four rounds of postings, then the passing rows scored (cache first)."""
    from ..operators import scoring_ops as SO
    from ..streaming.first_sight import STATE_STORE, first_sight

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    p, seen, scores = fixtures(spark, sf, "fx_posting", "fx_seen", "fx_score")
    p = p.select(*POSTING_COLS)
    root = scratch_path(spark, "first-sight")
    src, out, ckpt = f"{root}/source", f"{root}/out", f"{root}/checkpoint"
    for part in _rounds(p, ROUNDS):
        SC.land(part, src)
        s = SC.stream_files(spark, src, p.schema)
        with SC.settings(spark, SC.CHANGES_ONLY):
            SC.run_available(first_sight(s, seen, "2024-02-01 00:00:00").writeStream.format("parquet")
                             .option("path", out).outputMode("append"), ckpt)
    passed = spark.read.parquet(out)
    return SO.score_with_cache(passed, scores, notes=F.lit(None).cast("string")).select("seq", "job_url", "score")
