"""Sessions of an event stream by keyed timers in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from polyad.operators.sessions import GAP_SECONDS, Session, SessionTimers, expired, merge

_OUT = "entity string, session_start timestamp, session_end timestamp, duration_s double, n_events long, first_event_id long, last_event_id long"
_STATE = "starts array<long>, ends array<long>, first_ids array<long>, last_ids array<long>, counts array<long>"


def _update(gap_us: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sessions = [Session(*s) for s in zip(*state.get, strict=True)] if state.exists else []
        for f in frames:
            f = f.sort_values(["us", "id"], kind="stable")
            timers = SessionTimers(gap_us)
            names = pa.array(["" for _ in range(len(f))], pa.string())
            for cols in (*timers.feed(names, f["us"].to_numpy(), f["id"].to_numpy()), *timers.close()):
                sessions += [Session(*map(int, s)) for s in zip(*cols[1:], strict=True)]
        mark = state.getCurrentWatermarkMs() * 1000
        fired, still = expired(merge(sessions, gap_us), gap_us, mark)
        if still:
            state.update(tuple(list(c) for c in zip(*still, strict=True)))
            state.setTimeoutTimestamp(max(still[0].deadline(gap_us) // 1000 + 1, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        if fired:
            yield pd.DataFrame({
                "entity": [key[0]] * len(fired),
                "session_start": pd.to_datetime([s.start for s in fired], unit="us"), "session_end": pd.to_datetime([s.end for s in fired], unit="us"),
                "duration_s": [(s.end - s.start) / 1e6 for s in fired], "n_events": [s.n for s in fired],
                "first_event_id": [s.first_id for s in fired], "last_event_id": [s.last_id for s in fired],
            })

    return run


def stream_sessions(events: DataFrame, entity: str = "entity", at: str = "timestamp", event_id: str = "event_id", gap_seconds: int = GAP_SECONDS, late: str = "1 hour") -> DataFrame:
    """Sessions of a streaming DataFrame, as ``operators.sessions.sessionize`` defines them, each emitted once
    when its inactivity timer expires in event time. Events up to ``late`` behind the latest one are put in
    order and may join or bridge open sessions; later ones are dropped. Of rows with one id that arrive within
    ``late`` of each other the one that arrives first counts (of several in one micro-batch any, so copies
    should agree in entity and time). Rows without entity, time or id are left out.

    State is one ``Session`` (start, end, first and last id, count) for each open session of a key, so at most
    ``late`` / ``gap_seconds`` + 2 of them, whatever the number of events; ids are kept for ``late`` only."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    rows = e.select(F.col(entity).cast("string").alias("entity"), at, F.unix_micros(at).alias("us"), F.col(event_id).cast("long").alias("id")).where(F.col("entity").isNotNull() & F.col(at).isNotNull() & F.col("id").isNotNull())
    rows = rows.dropDuplicatesWithinWatermark(["id"])
    return rows.groupBy("entity").applyInPandasWithState(_update(int(gap_seconds * 1_000_000)), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
