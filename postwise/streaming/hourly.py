"""Hourly digest of postings not seen before, as a Structured Streaming job.

Each micro-batch (``foreachBatch``):
  1. asks the seen store, *as it was before this batch*, for the batch's own keys: of
     the store only the files whose key range can hold one are read (``SeenStore``);
  2. keeps the postings whose key the store lacks (J1, bag semantics);
  3. scores them, cached score first (F6), and ranks them (O1);
  4. writes the digest rows and header (K4, K5), then the new seen entries (K2),
     all under ``batch_id=N`` with overwrite (at-least-once delivery,
     exactly-once output);
  5. every ``compact_every`` batches merges the earlier batches' marks into the store,
     so neither the folders nor the files a batch reads grow with the past.
"""

from __future__ import annotations

from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge as J
from ..operators import ranking as O
from ..operators import reports as R
from ..operators import scoring_ops as SO
from ..sources.seen_store import SeenStore


def write_initial_seen(seen: DataFrame, seen_dir: str) -> None:
    SeenStore(seen_dir).create(seen)


def hourly_batch(seen_dir: str, digest_dir: str, scores: DataFrame, as_of: Callable[[int], str],
                 notes: str | None = None, compact_every: int = 24):
    """The ``foreachBatch`` function of the hourly job."""
    store = SeenStore(seen_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        keyed = J.with_key(batch).filter(F.col(J.KEY) != "")
        known = store.known(keyed.select(J.KEY).distinct(), batch_id, J.KEY)
        # read by the digest, the header and the new marks: computed once per batch
        fresh = keyed.join(known, J.KEY, "left_anti").drop(J.KEY).persist(StorageLevel.MEMORY_AND_DISK)
        scored = SO.score_with_cache(fresh, scores, notes=F.lit(notes).cast("string"))
        ranked = O.rank_by_score(scored)
        ranked.write.mode("overwrite").parquet(f"{digest_dir}/batch_id={batch_id}")
        R.digest_header(fresh, as_of(batch_id), "hourly").write.mode("overwrite").parquet(
            f"{digest_dir}_header/batch_id={batch_id}")
        marked = (J.with_key(fresh).select(F.col(J.KEY).alias("job_url")).distinct()
                  .withColumn("seen_at", F.lit(as_of(batch_id)).cast("timestamp")))
        store.mark(marked, batch_id)
        fresh.unpersist()
        if batch_id and batch_id % compact_every == 0:
            store.compact(batch_id)  # the batches before this one, which are committed

    return run


def hourly_stream(postings_stream: DataFrame, seen_dir: str, digest_dir: str, scores: DataFrame,
                  as_of: Callable[[int], str], notes: str | None = None, compact_every: int = 24):
    """The stream writer; start it with ``run_available`` or a processing-time trigger."""
    return postings_stream.writeStream.foreachBatch(
        hourly_batch(seen_dir, digest_dir, scores, as_of, notes, compact_every))
