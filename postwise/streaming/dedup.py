"""T5: cross-batch dedup by posting URL.

Unbounded retention: ``dropDuplicates([key])`` keeps every key ever seen in the
state store (the seen store's semantics). Bounded retention: with an event-time
column, ``withWatermark`` + ``dropDuplicatesWithinWatermark`` forgets keys once
the watermark has passed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.values import truthy


def dedup_stream(postings: DataFrame, key: str = "job_url", event_time: str | None = None,
                 retention: str | None = None) -> DataFrame:
    keyed = postings.filter(truthy(key).isNotNull())
    if event_time and retention:
        return keyed.withWatermark(event_time, retention).dropDuplicatesWithinWatermark([key])
    return keyed.dropDuplicates([key])
