"""Sessions as state: one keyed state a session, kept by transformWithState, with timers for expiry and retention.

An event moves its session by the fixed transitions of the batch operator; what is not allowed is counted and changes nothing.
Event ids are remembered, so an event that comes again does nothing. A session without an event for IDLE of event time expires
when the watermark has passed that, unless it is in a final state; after RETENTION without one, all of its state and ids are
forgotten (Spark's own TTL counts processing time, which a replay doesn't follow, so a timer does it). Every change gives a
row; the last row of a session is its state.

Events without a session or a time are left out. Events of a batch are taken in order of time and then id, whatever order they
come in; an event older than the session's last one moves it all the same (its time counts only if it is later).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a session's events do: state -> {event: state}. Fixed values: `completed` and `expired` are final.
MOVES = {
    "new": {"context_supplied": "active", "entity_queried": "active", "exact_source_requested": "active", "artifact_changed": "active"},
    "active": {"context_supplied": "active", "entity_queried": "active", "exact_source_requested": "active", "artifact_changed": "changed", "reasoning_use_reported": "completed"},
    "changed": {"context_supplied": "active", "artifact_changed": "changed", "exact_source_requested": "changed", "reasoning_use_reported": "completed"},
}
FINAL = ("completed", "expired")
IDLE_MS, RETENTION_MS = 6 * 3_600_000, 48 * 3_600_000
OUTPUT = "session_id string, state string, events long, refused long, last timestamp"


class Sessions(StatefulProcessor):
    """state (name, events, refused, last in milliseconds) and the ids seen."""

    def __init__(self, idle_ms: int = IDLE_MS, retention_ms: int = RETENTION_MS):
        self._idle, self._retention = idle_ms, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("session", "name string, events long, refused long, last long")
        self._seen = handle.getMapState("seen", "event_id long", "at long")

    def _row(self, key: Any, now: tuple) -> pd.DataFrame:
        name, events, refused, last = now
        return pd.DataFrame({"session_id": [key[0]], "state": [name], "events": [events], "refused": [refused], "last": pd.to_datetime([last], unit="ms")})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        name, events, refused, last = self._state.get() if self._state.exists() else ("new", 0, 0, 0)
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        changed = False
        moments = batch["ts"].astype("datetime64[ms]").astype("int64")
        for event_id, at, kind in zip(batch["event_id"].tolist(), moments.tolist(), batch["use_type"].tolist(), strict=True):
            if self._seen.containsKey((event_id,)):
                continue
            self._seen.updateValue((event_id,), (at,))
            changed = True
            to = MOVES.get(name, {}).get(kind)
            if to is None:
                refused += 1
            else:
                name, events = to, events + 1
            last = max(last, at)
        if not changed:
            return
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if name not in FINAL:
            self._handle.registerTimer(last + self._idle)
        self._handle.registerTimer(last + self._retention)
        self._state.update((name, events, refused, last))
        yield self._row(key, (name, events, refused, last))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self._state.exists():
            return
        name, events, refused, last = self._state.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= last + self._retention:
            self._state.clear()
            self._seen.clear()
        elif name not in FINAL:
            self._state.update(("expired", events, refused, last))
            yield self._row(key, ("expired", events, refused, last))

    def close(self) -> None:
        pass


def sessions(events: DataFrame, late: str = "1 hour", idle_ms: int = IDLE_MS, retention_ms: int = RETENTION_MS) -> DataFrame:
    """OUTPUT rows of a stream of use events (event_id, ts, session_id, use_type)."""
    rows = events.where("session_id IS NOT NULL AND ts IS NOT NULL").select("event_id", "ts", "session_id", "use_type").withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Sessions(idle_ms, retention_ms), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


def use_state_store(spark) -> None:
    """transformWithState needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def last_rows(rows: DataFrame) -> DataFrame:
    """The last row of each session of what was written: by events and refusals, an expiry after all else."""
    order = F.struct(F.col("events") + F.col("refused"), F.col("state") == "expired")
    best = F.max_by(F.struct("state", "events", "refused", "last"), order).alias("b")
    return rows.groupBy("session_id").agg(best).select("session_id", "b.*")
