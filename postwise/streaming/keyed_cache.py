"""T2 with keyed state: the 24-hour cache as ``transformWithState`` with event-time expiry.

The state keeps, per key, the times of its stores that a lookup can still need and the
lookups that no store has answered yet. A lookup hits when a store of its key is at most
the TTL older (the rule of ``ttl_cache``, whose stream-stream join gives the same rows):
at once if that store is known, later if it arrives within the allowed lateness. Keys are
dealt by their hash into a fixed number of groups, and a group is one state row (an Arrow
table) and one call of Python, which answers all its keys by one sort; so calls do not
grow with the number of keys. An event-time timer per group removes what the watermark
has passed, and the whole row once nothing is left, so the state holds entries of the last
TTL only.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import config as C

_HOUR = 3_600_000_000  # microseconds
_COLS = ["key", "at", "id", "store"]


class KeyedCache(StatefulProcessor):
    """Input: group, ``key``, ``at`` (microseconds), ``id`` and ``store`` (a store, else a
    lookup); output: key and id of the lookups that hit."""

    def __init__(self, key: str, ttl_hours: int):
        self.key, self.ttl = key, ttl_hours * _HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entries", "rows binary, timer long")

    def _load(self) -> tuple[list[pd.DataFrame], int]:
        got = self.state.get() if self.state.exists() else None
        if got is None:
            return [], -1
        return [pa.ipc.open_stream(bytes(got[0])).read_pandas()], int(got[1])

    def _answer(self, code: np.ndarray, at: np.ndarray, store: np.ndarray) -> np.ndarray:
        """Which rows, sorted by key and time with stores first, are lookups that have a
        store of their key in (time - TTL, time]."""
        last = np.maximum.accumulate(np.where(store, np.arange(len(at)), -1))
        found = ~store & (last >= 0)
        found[found] = (code[last[found]] == code[found]) & (at[last[found]] > at[found] - self.ttl)
        return found

    def _needed(self, code: np.ndarray, at: np.ndarray, store: np.ndarray, watermark: int) -> np.ndarray:
        """Which of the sorted rows a later row can need. Of a key's stores up to the
        watermark only the last one can answer a lookup to come."""
        needed = np.where(store, at > watermark - self.ttl, at > watermark)
        s = np.flatnonzero(store)
        passed = (code[s[1:]] == code[s[:-1]]) & (at[s[1:]] <= watermark)
        needed[s[:-1][passed]] = False
        return needed

    def _run(self, parts: list[pd.DataFrame], timer: int, watermark: int) -> pd.DataFrame | None:
        """The lookups that hit; keeps what is needed, sets the group's timer, or forgets the group."""
        hits, rows = None, None
        if parts:
            rows = pd.concat(parts, ignore_index=True)[_COLS]
            code, at, store = pd.factorize(rows["key"])[0], rows["at"].to_numpy(np.int64), rows["store"].to_numpy(bool)
            order = np.lexsort((~store, at, code))
            rows, code, at, store = rows.iloc[order], code[order], at[order], store[order]
            found = self._answer(code, at, store)
            hits = rows.loc[found, ["key", "id"]].rename(columns={"key": self.key}) if found.any() else None
            keep = self._needed(code, at, store, watermark) & ~found
            rows, at, store = rows[keep], at[keep], store[keep]
        if timer >= 0:
            self.handle.deleteTimer(timer)
        if rows is None or not len(rows):
            self.state.clear()
            return hits
        timer = max(int(np.where(store, at + self.ttl, at).min()), watermark) // 1000 + 1  # milliseconds, after the watermark
        self.handle.registerTimer(timer)
        table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(), timer))
        return hits

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._load()
        hits = self._run([*held, *(chunk[_COLS] for chunk in rows)], timer,
                         max(timerValues.getCurrentWatermarkInMs(), 0) * 1000)
        if hits is not None:
            yield hits

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._load()
        self._run(held, -1, max(timerValues.getCurrentWatermarkInMs(), 0) * 1000)
        return iter(())

    def close(self) -> None:
        pass


def keyed_ttl_hits(events: DataFrame, key: str, store: str, id_col: str, ts: str = "ts",
                   ttl_hours: int = C.CACHE_TTL_HOURS, groups: int = 2048, *, lateness: str) -> DataFrame:
    """(key, id) of the lookups in ``events`` that find a fresh entry; ``store`` is the SQL
    condition of rows that store one. Rows more than ``lateness`` behind are dropped. Keys are
    dealt into ``groups``; a checkpoint keeps its number."""
    rows = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("group"), F.col(key).alias("key"), ts,
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.expr(store), F.lit(False)).alias("store")).withWatermark(ts, lateness)
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy("group").transformWithStateInPandas(
        statefulProcessor=KeyedCache(key, ttl_hours), outputStructType=f"{key} {kind}, id long", outputMode="Append",
        timeMode="EventTime")
