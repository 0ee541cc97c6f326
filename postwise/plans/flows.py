"""End-to-end flows: the runs a user of the original tool performs, composed
from the operators (no new logic here).

* ``portal_ingest``      landed payloads → result cache (optional) → normalise (all formats,
                         descriptions completed from pages) → subset refresh (optional) →
                         snapshot merge → new snapshot version + sponsor update
* ``aggregator_ingest``  landed search rows → normalise → merge with its own snapshot
* ``hourly_digest``      both snapshots → unseen postings → scored (cache first) → ranked
                         digest rows + header; new seen entries
* ``daily_digest``       postings seen in the last 24 hours → scored → ranked + header
* ``publish``            export table with scores and first_seen, personal data removed

Every flow takes ``as_of`` and returns DataFrames; writing is explicit (``write_to``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_PROFILE, Profile
from ..operators import merge as J
from ..operators import normalize as N
from ..operators import privacy as PV
from ..operators import ranking as O
from ..operators import reports as R
from ..operators import scoring_ops as SO
from ..session import staged, staged_parts
from ..sources import snapshots as SN
from ..sources.payload_store import PayloadStore
from ..sources.result_cache import ResultCache


@dataclass
class IngestResult:
    snapshot: DataFrame          # merged posting table (stamped + carried)
    sponsors: DataFrame | None   # register with updated careers URLs (J6)
    path: str | None             # where the snapshot version was written
    rejected: DataFrame | None = None  # payloads no normaliser can read, with the reason (P22)


#: Order of a load's postings: employer, search (category or term), page, position.
PLACE = ("ord", "term", "page", "pos")


@dataclass
class CacheRun:
    """The result cache of one ingest run: which version it reads and which it writes."""
    cache: ResultCache
    reads: int | None
    writes: int
    force: bool | DataFrame = False


def portal_ingest(payloads: DataFrame, companies: DataFrame, prev: DataFrame, seen: DataFrame, as_of,
                  refreshed: DataFrame | None = None, sponsors: DataFrame | None = None,
                  write_to: str | None = None, profile: Profile = DEFAULT_PROFILE,
                  types=None, store: SN.KeyedStore | None = None, version: int | None = None,
                  details: DataFrame | None = None, pages: DataFrame | None = None,
                  cached: CacheRun | None = None) -> IngestResult:
    """Portal run: every landed payload normalised by its format (G1), then merged
    with the previous snapshot (J5).

    With ``cached`` employers whose results are younger than the TTL are answered from
    the result cache and their payloads are not read (J7); the results of the others are
    written back (K2). ``pages`` complete short greenhouse descriptions (P13), ``details``
    the slug format. With ``refreshed`` (an employer subset run) the other employers' rows
    are kept (J8) and only stamping happens (no carry). With ``store`` the merged snapshot
    is written as ``version`` of a keyed store (bucketed on the key), which the next run
    reads without a shuffle. Payloads without a readable body are returned as
    ``rejected``; from a payload store they are there already (``ingest_load``)."""
    looked = None
    if cached is not None:
        looked = cached.cache.look_up(companies, cached.reads, as_of, cached.force)
        payloads = payloads.join(staged(looked.missing, "missing"), "company", "left_semi")  # asked by every format
    place = companies.groupBy(F.col("ind_name").alias("company")).agg(F.min("ord").cast("long").alias("__ord"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.drop("source_type").join(place, "company", "left").withColumn("place", F.struct(
            F.col("__ord").alias("ord"), F.coalesce("term", F.lit("")).alias("term"), F.col("page").cast("long").alias("page"),
            F.col("pos").cast("long").alias("pos"))).drop("__ord", "term", "page", "pos")

    if cached is None:
        fresh = placed(N.normalize_all(payloads, companies, profile, types=types, details=details, pages=pages))
    else:
        cols = [f.name for f in cached.cache.schema.fields]
        # written back, and merged; a job a format, whose plan is all the driver holds
        fetched = staged_parts(payloads.sparkSession, map(placed, N.by_format(
            payloads, companies, profile, types, details, pages, written=True)), "fetched")
        cached.cache.write_back(fetched.select(*cols), cached.writes, cached.reads, as_of, answered=looked.fresh)
        fresh = fetched.unionByName(looked.rows, allowMissingColumns=True)
    retain = refreshed is None
    if refreshed is not None:
        fresh = J.partial_refresh(prev, fresh, refreshed)
    # a snapshot of an earlier layout has no place; its own order is in seq
    order = "place" if "place" in prev.columns else "seq"
    merged = J.stamp_and_retain(fresh, prev, seen, as_of, retain=retain, prev_order=order)
    path = SN.write_snapshot(merged, write_to) if write_to else None
    if store is not None:
        path = store.write(merged, version if version is not None else 0)
    updated = J.sponsor_update(sponsors, companies) if sponsors is not None else None
    rejected = None if "format" in payloads.columns else N.rejected_payloads(payloads, types)
    return IngestResult(merged, updated, path, rejected)


def ingest_load(landing: PayloadStore, load: int, companies: DataFrame, prev: DataFrame, seen: DataFrame, as_of,
                **options) -> IngestResult:
    """``portal_ingest`` of one load of a payload store: parsed when it landed, read
    format by format, the rejects of the load beside the snapshot."""
    spark = companies.sparkSession
    run = portal_ingest(landing.read(spark, load), companies, prev, seen, as_of, **options)
    run.rejected = landing.rejected(spark, load)
    return run


def aggregator_ingest(rows: DataFrame, prev: DataFrame, seen: DataFrame, as_of,
                      write_to: str | None = None, store: SN.KeyedStore | None = None,
                      version: int | None = None) -> IngestResult:
    """Aggregator run: search rows normalised (N18), merged with their snapshot."""
    fresh = N.normalize_search_rows(rows)
    merged = J.stamp_and_retain(fresh, prev, seen, as_of, retain=True)
    path = SN.write_snapshot(merged, write_to) if write_to else None
    if store is not None:
        path = store.write(merged, version if version is not None else 0)
    return IngestResult(merged, None, path)


def hourly_digest(postings: DataFrame, seen: DataFrame, scores: DataFrame, as_of):
    """Hourly run (T1 in batch form): rows, header, and the seen entries to append.
    The run's keys are broadcast (count checked) and the seen store only scanned."""
    fresh = J.new_postings_incremental(postings, seen)
    scored = SO.score_with_cache(fresh, scores)
    ranked = O.rank_by_score(scored)
    rows = R.digest_rows(ranked)
    header = R.digest_header(fresh, as_of, "hourly")
    marked = (J.with_key(fresh).select(F.col(J.KEY).alias("job_url")).distinct()
              .withColumn("seen_at", J.as_of_ts(as_of)))
    return rows, header, marked


def daily_digest(postings: DataFrame, seen: DataFrame, scores: DataFrame, as_of,
                 hours: int = C.DAILY_LOOKBACK_HOURS):
    """Daily run (T3): postings seen in the lookback window, scored and ranked."""
    day = J.seen_within(postings, seen, as_of, hours)
    ranked = O.rank_by_score(SO.score_with_cache(day, scores))
    return R.digest_rows(ranked), R.digest_header(day, as_of, "daily")


def publish(portal: DataFrame, aggregator: DataFrame, seen: DataFrame, scores: DataFrame, as_of,
            write_to: str | None = None) -> DataFrame:
    """Export (K3): both feeds, first_seen backfilled, scores attached, personal data removed."""
    both = J.union_feeds(portal.withColumn("feed", F.lit("portal")), aggregator.withColumn("feed", F.lit("search")))
    out = PV.strip_pii(J.attach_scores(J.backfill_first_seen(both, seen, as_of), scores))
    if write_to:
        SN.write_snapshot(out, write_to, partition_by=["feed"])
    return out
