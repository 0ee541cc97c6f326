"""T1 with keyed state: postings whose URL was never seen pass, once per URL.

The seen set lives in the streaming state store (RocksDB), partitioned by URL,
instead of a table that every micro-batch scans. URLs are dealt by their hash into a
fixed number of groups, and within a group into slots: a group is one call of Python
a batch, so calls do not grow with the number of URLs, and a slot is one state row
(its URLs with the time each was first seen), so a batch reads and writes only the
slots its own URLs fall into. The existing seen store seeds the state once (initial
state). Per URL and batch: when the state has it, its rows are dropped; otherwise all
its rows of this batch pass (duplicates inside one batch all pass, as in J1) and the
URL is marked with the batch's ``as_of``. Rows arrive as pandas chunks, so a URL with
very many rows is streamed through, never held whole.
"""

from __future__ import annotations

import json
from typing import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.values import truthy

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# names without a leading underscore, which pandas would not keep
_GROUP, _SLOT, _AT = "state_group", "state_slot", "state_at"


class FirstSight(StatefulProcessor):
    """'Seen' marks of a group's URLs; rows of URLs without one pass and set it."""

    def __init__(self, as_of: str, key: str):
        self.as_of, self.key = int(pd.Timestamp(as_of).value // 1000), key  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "slot int", "marks string")

    def _load(self, slots: Iterable[int]) -> dict[int, dict]:
        """The marks of slots: URL → microseconds (null of a mark without a time)."""
        if not self.seen.exists():  # each question to the store costs
            return {s: {} for s in slots}
        got = {s: self.seen.getValue((s,)) for s in slots}
        return {s: {} if v is None else json.loads(v[0]) for s, v in got.items()}

    def _keep(self, slot: int, marks: dict) -> None:
        self.seen.updateValue((slot,), (json.dumps(marks, ensure_ascii=False, separators=(",", ":")),))

    def _rows(self, chunk: pd.DataFrame) -> tuple[list[int], list[str]]:
        return [int(s) for s in chunk[_SLOT]], [str(u) for u in chunk[self.key]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: dict[int, dict] = {}  # as before this batch
        fresh: dict[int, dict] = {}
        for chunk in rows:
            slots, urls = self._rows(chunk)
            if missing := set(slots).difference(held):
                held |= self._load(missing)
            new = [u not in held[s] for s, u in zip(slots, urls)]
            if not any(new):
                continue
            for s, u, n in zip(slots, urls, new):
                if n:
                    fresh.setdefault(s, {})[u] = self.as_of
            yield chunk[new].drop(columns=[_GROUP, _SLOT])
        for slot, marks in fresh.items():
            self._keep(slot, held[slot] | marks)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        given: dict[int, dict] = {}
        for s, u, at in zip(*self._rows(initialState), initialState[_AT]):
            given.setdefault(s, {}).setdefault(u, None if pd.isna(at) else int(at))
        held = self._load(given)  # a group's rows may come in several chunks
        for slot, marks in given.items():
            self._keep(slot, marks | held[slot])

    def close(self) -> None:
        pass


def _dealt(df: DataFrame, key: str, columns: Iterable, groups: int, slots: int) -> DataFrame:
    """Rows with a key, with the group and slot of it."""
    h = F.xxhash64(key)
    return df.filter(truthy(key).isNotNull()).select(
        F.pmod(h, F.lit(groups)).cast("int").alias(_GROUP), *columns,
        F.pmod(F.shiftright(h, 32), F.lit(slots)).cast("int").alias(_SLOT))


def first_sight(postings: DataFrame, initial_seen: DataFrame, as_of: str, key: str = "job_url",
                groups: int = 2048, slots: int = 8) -> DataFrame:
    """Streaming postings → postings whose key is new (keyless rows dropped). Keys are dealt
    into ``groups``, of ``slots`` state rows each, which should hold some hundred keys; a
    checkpoint keeps its numbers. The hash of a key depends on its type, so both inputs' keys
    have one."""
    kind = postings.schema[key].dataType
    seed = initial_seen.select(F.col(key).cast(kind).alias(key), F.unix_micros(F.col("seen_at").cast("timestamp")).alias(_AT))
    return _dealt(postings, key, postings.columns, groups, slots).groupBy(_GROUP).transformWithStateInPandas(
        statefulProcessor=FirstSight(as_of, key), outputStructType=postings.schema, outputMode="Append",
        timeMode="None", initialState=_dealt(seed, key, [key, _AT], groups, slots).groupBy(_GROUP))
