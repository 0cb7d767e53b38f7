"""Use events as a stream: deduplicated, counted in windows, followed by session, and reconciled in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import policy

EVENTS = "event_id long, ts timestamp, session_id string, use_type string, entity string, bytes long"


def read(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """EVENTS of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once; ids are forgotten when the watermark has passed them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """start, use_type, n, bytes of tumbling windows of events with a watermark (as `once` gives them); a window is given
    when no more of it can come."""
    rows = events.groupBy(F.window("ts", width), "use_type").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    return rows.select(F.col("window.start").alias("start"), "use_type", "n", "bytes")


#: What an event does to its session's state.
STEPS = {"context_supplied": "context_compiled", "entity_queried": "active", "artifact_changed": "reconciled", "reasoning_use_reported": "completed"}


def step(state: str, use_type: str) -> str:
    """The state after an event; an event whose step isn't allowed changes nothing."""
    to = STEPS.get(use_type, state)
    return to if (state, to) in policy.TRANSITIONS else state


def session_states(events: DataFrame, idle: str = "2 hours") -> DataFrame:
    """session_id, state, n after each micro-batch that has events of it; a session without any for `idle` is abandoned."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def follow(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, n = held.get if held.exists else ("created", 0)
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame({"session_id": [key[0]], "state": ["abandoned" if state not in policy.TERMINAL else state], "n": [n]})
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for use_type in rows["use_type"]:
            state, n = step(state, use_type), n + 1
        held.update((state, n))
        # event time: the timeout must lie past the watermark, which may have passed late rows
        held.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame({"session_id": [key[0]], "state": [state], "n": [n]})

    shape = "session_id string, state string, n long"
    return events.groupBy("session_id").applyInPandasWithState(follow, shape, "state string, n long", "update", GroupStateTimeout.EventTimeTimeout)


def reconcile(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand everything that has arrived to `handle(batch, number)`, one micro-batch after another, and stop.

    The checkpoint names what was handled, so a run that is stopped goes on where it was; a batch may be handed over
    again after a failure, with the same number.
    """
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
