"""Queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad import catalogue
from polyad.operators.periods import periods_and_gaps
from polyad.operators.sessions import entity_of, sessionize
from polyad.plans.session import table

OBSERVED_UNTIL = "2025-07-01 00:00:00"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "long_events").withColumn("entity", entity_of("user", "device"))
    s = sessionize(e, "entity", "timestamp", "event_id", received="received_at")
    return s.select("entity", "first_event_id", "last_event_id")


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with start, end, duration and number of events."""
    e = table(spark, d, "long_events").withColumn("entity", entity_of("user", "device"))
    return sessionize(e, "entity", "timestamp", "event_id", received="received_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    p = periods_and_gaps(table(spark, d, "interval_log"), ["actor", "group"], observed_until=OBSERVED_UNTIL)
    return p.select(F.col("actor").alias("node"), F.col("group").alias("edge"), "kind", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"))


P2_SESSIONS = """
with raw as (
  select event_id, "timestamp" t, coalesce(nullif(lower(regexp_replace("user", '^[ \\t]+|[ \\t]+$', '', 'g')), ''), device) entity, received_at
  from long_events where event_id is not null and "timestamp" is not null),
ev as (select event_id, t, entity from raw where entity is not null
  qualify row_number() over (partition by event_id order by received_at nulls first, t, entity) = 1),
b as (select *, case when epoch_us(t) - epoch_us(lag(t) over w) <= 900000000 then 0 else 1 end as brk from ev window w as (partition by entity order by t, event_id)),
s as (select *, sum(brk) over (partition by entity order by t, event_id rows unbounded preceding) g from b)
select entity, min(t) as session_start, max(t) as session_end, (epoch_us(max(t)) - epoch_us(min(t))) / 1e6 as duration_s,
  count(*) as n_events, arg_min(event_id, (t, event_id)) as first_event_id, arg_max(event_id, (t, event_id)) as last_event_id
from s group by entity, g"""

P3 = """
with s as (select actor node, "group" edge, "start" a, least(coalesce("end", timestamp '2025-07-01'), timestamp '2025-07-01') z
  from interval_log where actor is not null and "group" is not null and "start" is not null and ("end" is null or "end" >= "start")),
m as (select *, max(z) over (partition by node, edge order by a, z rows between unbounded preceding and 1 preceding) hi from s where z >= a),
g as (select *, sum(case when hi >= a then 0 else 1 end) over (partition by node, edge order by a, z rows unbounded preceding) n from m),
p as (select node, edge, n, min(a) a, max(z) z from g group by all),
x as (select node, edge, 'period' as kind, a, z from p union all
  select node, edge, 'gap', z, nxt from (select *, lead(a) over (partition by node, edge order by a) nxt from p) where nxt is not null)
select node, edge, kind, cast(floor(epoch_us(a) / 1000000) as bigint) as start_s, cast(floor(epoch_us(z) / 1000000) as bigint) as end_s from x"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_sessions, p3_found)}
SQL: dict[str, str] = {
    "p2_sessions": P2_SESSIONS,
    "p2_found": f"select entity, first_event_id, last_event_id from ({P2_SESSIONS})",
    "p3_found": P3,
}
QUERIES |= catalogue.QUERIES
SQL |= catalogue.SQL
