"""Temporal hypergraphs: spells (node, edge, start, end[, weight]) measured on a grid of times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyad.errors import BadInput, UnparsedTime
from polyad.operators.structure import components
from polyad.plans.session import need

# Names under which a role is looked for, in order of priority, and the formats of times.
ROLE_NAMES = {
    "from": ["from", "source", "sender", "tail", "ego", "actor1", "node1", "sourceid", "fromid", "i"],
    "to": ["to", "target", "receiver", "head", "alter", "actor2", "node2", "targetid", "toid", "j"],
    "start": ["start", "onset", "begin", "starttime", "startdate", "tstart", "fromtime"],
    "end": ["end", "terminus", "finish", "endtime", "enddate", "tend", "totime", "stop"],
    "duration": ["duration", "dur", "elapsed", "length", "lasted"],
    "time": ["time", "timestamp", "datetime", "date", "when", "t", "occurred", "createdat", "posttime"],
    "thread": ["thread", "threadid", "discussion", "discussiontitle", "topic", "conversation", "parent", "postid", "root"],
    "session": ["session", "period", "wave", "phase", "cohort", "course"],
    "group": ["group", "event", "context", "room", "class", "meeting", "venue", "team", "channel"],
    "actor": ["actor", "person", "member", "student", "participant", "user", "id", "name"],
    "weight": ["weight", "weights", "strength"],
}
FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy",
    "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd-MM-yyyy", "d MMM yyyy HH:mm", "d MMMM yyyy HH:mm", "d MMM yyyy", "d MMMM yyyy",
]

#: Formats of our own, tried after those.
EXTRA_FORMATS = ["dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yyyy", "yyyyMMdd"]


def find_roles(df: DataFrame) -> dict[str, str]:
    """Roles by column name, lower case without other signs than letters and digits. No job."""
    flat = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in reversed(df.columns)}
    out: dict[str, str] = {}
    for role, names in ROLE_NAMES.items():
        hit = next((flat[n] for n in names if n in flat and flat[n] not in out.values()), None)
        if hit:
            out[role] = hit
    return out


def parse_times(df: DataFrame, column: str, formats: list[str] | None = None) -> DataFrame:
    """``df`` with a string column as timestamp, by the format that reads most of its values."""
    formats = formats or [*FORMATS, *EXTRA_FORMATS]
    c = F.btrim(column)
    got = df.agg(*[F.count(F.try_to_timestamp(c, F.lit(f))).alias(str(i)) for i, f in enumerate(formats)]).first()
    best = max(range(len(formats)), key=lambda i: (got[i], -i))
    if not got[best]:
        raise UnparsedTime(f"no format reads {column}")
    return df.withColumn(column, F.try_to_timestamp(c, F.lit(formats[best])))


def spells(log: DataFrame, actor: str, group: str, start: str, end: str | None = None, weight: str | None = None) -> DataFrame:
    """(node, edge, start, end, weight) of an interval log, or of a contact log (``end`` None; a contact
    starts and ends at its time). A null end is open; an end before its start is refused."""
    need(log, actor, group, start, *([end] if end else []), *([weight] if weight else []))
    s = log.select(F.col(actor).cast("string").alias("node"), F.col(group).cast("string").alias("edge"), F.col(start).alias("start"), F.col(end or start).alias("end"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    s = s.where("node is not null and edge is not null and start is not null and weight is not null")
    if end and s.where("end < start").limit(1).count():
        raise BadInput("a spell ends before it starts")
    return s


def edge_spans(s: DataFrame) -> DataFrame:
    """(edge, start, end): the hull of an edge's spells; open if one of them is."""
    return s.groupBy("edge").agg(F.min("start").alias("start"), F.when(F.max(F.col("end").isNull().cast("int")) == 0, F.max("end")).alias("end"))


def grid(spark: SparkSession, start: str, stop: str, step: str) -> DataFrame:
    """(t) from ``start`` to ``stop`` by an interval such as '1 month'."""
    return spark.sql(f"select explode(sequence(timestamp'{start}', timestamp'{stop}', interval {step})) t")


def active(s: DataFrame, times: DataFrame, mode: str = "active", window: str | None = None, contacts: bool = False) -> DataFrame:
    """``s`` once per grid time t at which it counts: begun by t (before t + window, if there is one),
    and for ``active`` not ended before t; a contact must also not lie before t. The grid is small
    and known on the driver, so the range join never moves ``s``."""
    if mode not in ("active", "cumulative"):
        raise BadInput("mode is active or cumulative")
    upto = F.expr(f"t + interval {window}") if window else F.col("t")
    begun = F.col("start") < upto if window else F.col("start") <= upto
    on = begun if mode == "cumulative" else begun & (F.col("end").isNull() | (F.col("end") >= F.col("t")))
    if contacts and mode == "active":
        on = on & (F.col("start") >= F.col("t"))
    return s.join(F.broadcast(times.select("t")), on)


def snapshots(s: DataFrame, times: DataFrame, mode: str = "active", window: str | None = None, multiedges: bool = True) -> DataFrame:
    """(t, node, edge, weight): the hypergraph at every grid time, as one table. Without ``multiedges``
    edges of equal members are one, the least name, with weights 1."""
    a = active(s, times, mode, window).groupBy("t", "node", "edge").agg(F.sum("weight").alias("weight"))
    if multiedges:
        return a
    k = a.groupBy("t", "edge").agg(F.array_sort(F.collect_list("node")).alias("members")).groupBy("t", "members").agg(F.min("edge").alias("edge"))
    return k.select("t", F.explode("members").alias("node"), "edge", F.lit(1.0).alias("weight"))


#: Times of a grid at most; a grid is broadcast, or goes into expressions.
MAX_TIMES = 100_000


def growth(s: DataFrame, times: DataFrame, window: str | None = None) -> DataFrame:
    """(t, nodes, edges, distinct_edges, memberships, cum_nodes, cum_edges, cum_memberships). What has
    begun by t is counted from the first time of each node, edge and membership, once each, and
    summed along the grid; the log is not joined to every time for that."""
    a = active(s, times, "active", window).select("t", "node", "edge").distinct()
    e = a.groupBy("t", "edge").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h2"))
    by_edge = e.groupBy("t").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("h1", "h2", "c").alias("distinct_edges"), F.sum("c").alias("memberships"))
    by_node = a.groupBy("t").agg(F.count_distinct("node").alias("nodes"))
    grid_ = [r["t"] for r in times.select("t").distinct().orderBy("t").limit(MAX_TIMES + 1).collect()]
    if len(grid_) > MAX_TIMES:
        raise BadInput(f"a grid of more than {MAX_TIMES} times")
    upto = F.expr(f"t + interval {window}") if window else F.col("t")
    marks = F.array(*[F.struct(F.lit(t).alias("t")) for t in grid_]) if len(grid_) <= 64 else None

    def first(*keys: str) -> DataFrame:
        f = s.groupBy(*keys).agg(F.min("start").alias("start"))
        begun = (lambda t: F.col("start") < t + F.expr(f"interval {window}")) if window else (lambda t: F.col("start") <= t)
        if marks is not None:
            f = f.select(F.array_min(F.transform(F.filter(marks, lambda x: begun(x["t"])), lambda x: x["t"])).alias("t"))
        else:
            f = f.groupBy("start").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(times.select("t")), F.col("start") < upto if window else F.col("start") <= upto).groupBy("start", "m").agg(F.min("t").alias("t"))
            return f.where("t is not null").groupBy("t").agg(F.sum("m").alias("n"))
        return f.where("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    out = times.select("t").distinct().join(by_edge, "t", "left").join(by_node, "t", "left")
    along = Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # the grid, at most MAX_TIMES rows
    for name, keys in (("cum_nodes", ["node"]), ("cum_edges", ["edge"]), ("cum_memberships", ["node", "edge"])):
        out = out.join(first(*keys).withColumnRenamed("n", "_n"), "t", "left").withColumn(name, F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    return out.na.fill(0).select("t", "nodes", "edges", "distinct_edges", "memberships", "cum_nodes", "cum_edges", "cum_memberships")


def growth_components(s: DataFrame, times: DataFrame, mode: str = "active") -> DataFrame:
    """(t, n_components, largest_component): connected components of each snapshot and the share of its
    nodes in the largest; all snapshots are settled in the same rounds. Empty snapshots have 0 and null."""
    a = snapshots(s, times, mode).select("t", F.concat_ws("\x1f", F.unix_micros("t"), "node").alias("node"), F.concat_ws("\x1f", F.unix_micros("t"), "edge").alias("edge"))
    c = components(a).where("kind = 'node'").groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    c = c.select(F.timestamp_micros(F.split("component", "\x1f")[0].cast("long")).alias("t"), "n")
    c = c.groupBy("t").agg(F.count(F.lit(1)).alias("n_components"), (F.max("n") / F.sum("n")).alias("largest_component"))
    return times.select(F.col("t").cast("timestamp").alias("t")).distinct().join(c, "t", "left").select("t", F.coalesce("n_components", F.lit(0)).alias("n_components"), "largest_component")


def snapshot_edges(s: DataFrame, times: DataFrame, mode: str = "active") -> DataFrame:
    """(t, edge, size, n_incident_edges) per snapshot."""
    a = snapshots(s, times, mode)
    size = a.groupBy("t", "edge").agg(F.count(F.lit(1)).alias("size"))
    x = a.select("t", "node", F.col("edge").alias("ea")).join(a.select("t", "node", F.col("edge").alias("edge")), ["t", "node"]).where("ea <> edge").select("t", "edge", "ea").distinct().groupBy("t", "edge").agg(F.count(F.lit(1)).alias("n_incident_edges"))
    return size.join(x, ["t", "edge"], "left").withColumn("n_incident_edges", F.coalesce("n_incident_edges", F.lit(0)))


def clock(df: DataFrame, column: str, unit_seconds: float = 86400.0) -> DataFrame:
    """``df`` with ``column`` as a double: units since its least value."""
    us = F.unix_micros(F.col(column).cast("timestamp"))
    least = df.agg(F.min(us).alias("_least"))
    return df.crossJoin(F.broadcast(least)).withColumn(column, (us - F.col("_least")) / F.lit(unit_seconds * 1e6)).drop("_least")
