"""Splitting events into sessions at gaps of inactivity."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyad.plans.session import cut, need

GAP_SECONDS = 900


class Session(NamedTuple):
    """What a timer keeps of an open session; constant, however many events it has."""

    start: int
    end: int
    first_id: int
    last_id: int
    n: int

    def deadline(self, gap: int) -> int:
        """When the inactivity timer, reset by the last event, expires."""
        return self.end + gap


def merge(sessions: list[Session], gap: int) -> list[Session]:
    """Sessions in order; a session whose events begin before the timer of the one before it
    expires goes on with it, so that late events join or bridge open sessions."""
    out: list[Session] = []
    for s in sorted(sessions):
        if out and s.start <= out[-1].deadline(gap):
            o = out[-1]
            first, last = min((o.start, o.first_id), (s.start, s.first_id)), max((o.end, o.last_id), (s.end, s.last_id))
            out[-1] = Session(first[0], last[0], first[1], last[1], o.n + s.n)
        else:
            out.append(s)
    return out


def expired(sessions: list[Session], gap: int, now: int) -> tuple[list[Session], list[Session]]:
    """(fired, open): the timers that have expired at ``now``, and the others."""
    return [s for s in sessions if s.deadline(gap) < now], [s for s in sessions if s.deadline(gap) >= now]


class SessionTimers:
    """Inactivity timers of keys, driven by events ordered by (key, time, id).

    An event opens a session and arms the key's timer at its time plus ``gap``; a further event
    that comes no later than that resets it. The next event of the input is the clock: if it is
    later than the timer, or of another key, the timer has expired and emits the session's final
    start, end and count. One timer runs at a time, as input is ordered by key, so state is one
    ``Session``. Arrow batches are fed whole: all timers that the events of a batch arm are compared
    with the clock at once. The stream operator keeps the same ``Session`` in its state store.
    """

    def __init__(self, gap: int):
        self.gap = gap
        self.key: str | None = None
        self.open: Session | None = None

    def feed(self, key: pa.Array, at: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        """Columns (key, first_at, last_at, first_id, last_id, n) of the sessions whose timers expire."""
        n = len(at)
        if not n:
            return
        timer = at + self.gap  # armed or reset by each event
        fires = np.ones(n, bool)  # ... and expired before the event after it
        if n > 1:
            other = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            fires[:-1] = other | (at[1:] > timer[:-1])
        resumed = self.open if self.open and key[0].as_py() == self.key and at[0] <= self.open.deadline(self.gap) else None
        if self.open and not resumed:
            yield from self.close()
        ends = np.flatnonzero(fires)  # the last timer of the batch still runs
        starts = np.concatenate([[0], ends[:-1] + 1])
        first_at, first_id, count = at[starts].copy(), ids[starts].copy(), ends - starts + 1
        if resumed:
            first_at[0], first_id[0] = resumed.start, resumed.first_id
            count[0] += resumed.n
        e = int(ends[-1])
        self.key, self.open = key[e].as_py(), Session(int(first_at[-1]), int(at[e]), int(first_id[-1]), int(ids[e]), int(count[-1]))
        done = ends[:-1]
        yield key.take(pa.array(done)), first_at[:-1], at[done], first_id[:-1], ids[done], count[:-1]

    def close(self) -> Iterator[tuple]:
        """The end of input expires the timer that still runs."""
        if self.open:
            s = self.open
            yield (pa.array([self.key], pa.string()), *(np.array([x], np.int64) for x in (s.start, s.end, s.first_id, s.last_id, s.n)))
        self.key = self.open = None


_PIECE = "entity string, first_us long, last_us long, first_event_id long, last_event_id long, n_events long, edge boolean"


def _pieces(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        timers, held, first = SessionTimers(gap), None, True

        def rows():
            for b in batches:
                yield from timers.feed(b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy())
            yield from timers.close()

        def batch(cols, edge):
            return pa.RecordBatch.from_arrays([cols[0], *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array(edge)], names=[x.split()[0] for x in _PIECE.split(", ")])

        for cols in rows():
            if not len(cols[1]):
                continue
            if held is not None:
                edge = np.zeros(len(held[1]), bool)
                edge[0], first = first, False
                yield batch(held, edge)
            held = cols
        if held is not None:  # the partition's last session may go on in the next one
            edge = np.zeros(len(held[1]), bool)
            edge[0] |= first
            edge[-1] = True
            yield batch(held, edge)

    return run


def sessionize(events: DataFrame, entity: str = "entity", at: str = "timestamp", event_id: str = "event_id", gap_seconds: int = GAP_SECONDS, received: str | None = None) -> DataFrame:
    """Sessions of each entity: (entity, session_start, session_end, duration_s, n_events,
    first_event_id, last_event_id), one row per session, single events included.

    Events are ordered by (``at``, ``event_id``); a gap of more than ``gap_seconds``, to the
    microsecond, opens a session. Rows without entity, time or id are left out. Rows with one id
    are one event: the one received first (``received``, nulls first), then the earliest. Ties in
    time are ordered by id. An empty table gives no rows; other columns are ignored.

    Events are range partitioned by (entity, time, id), so an entity with a third of all rows is
    spread over many tasks; keyed timers run over each ordered partition, and only the first and
    last session of a partition, two rows a partition, are stitched afterwards.
    """
    need(events, entity, at, event_id, *([received] if received else []))
    rows = events.select(
        F.col(entity).cast("string").alias("entity"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("us"),
        F.col(event_id).cast("long").alias("id"),
        (F.unix_micros(F.col(received).cast("timestamp")) if received else F.lit(0).cast("long")).alias("got"),
    ).where("entity is not null and us is not null and id is not null")
    one = rows.groupBy("id").agg(F.min(F.struct("got", "us", "entity")).alias("e")).select(F.col("e.entity").alias("entity"), F.col("e.us").alias("us"), "id")
    ordered = one.repartitionByRange("entity", "us", "id").sortWithinPartitions("entity", "us", "id")
    gap = int(gap_seconds * 1_000_000)
    pieces = cut(ordered.mapInArrow(_pieces(gap), _PIECE))
    # edge pieces are neighbours in their entity's order exactly if no longer gap lies between them
    w = Window.partitionBy("entity").orderBy("first_us", "first_event_id")
    edges = pieces.where("edge").withColumn("new", F.coalesce((F.col("first_us") - F.lag("last_us").over(w) > gap).cast("int"), F.lit(1)))
    edges = edges.withColumn("grp", F.sum("new").over(w))
    joined = edges.groupBy("entity", "grp").agg(
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.min_by("first_event_id", F.struct("first_us", "first_event_id")).alias("first_event_id"),
        F.max_by("last_event_id", F.struct("last_us", "last_event_id")).alias("last_event_id"),
        F.sum("n_events").alias("n_events"),
    )
    every = pieces.where("not edge").drop("edge").unionByName(joined.drop("grp"))
    return every.select(
        "entity",
        F.timestamp_micros("first_us").alias("session_start"),
        F.timestamp_micros("last_us").alias("session_end"),
        ((F.col("last_us") - F.col("first_us")) / 1e6).alias("duration_s"),
        "n_events",
        "first_event_id",
        "last_event_id",
    )


def entity_of(user: str, device: str):
    """The user in lower case without surrounding spaces and tabs; where that is null or empty,
    the device."""
    who = F.lower(F.regexp_replace(user, r"^[ \t]+|[ \t]+$", ""))
    return F.coalesce(F.when(who != "", who), F.col(device))
