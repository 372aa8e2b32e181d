"""Continuous periods and gaps of interval data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyad.plans import hot
from polyad.plans.session import bounded, cut, need


def periods_and_gaps(spells: DataFrame, keys: list[str], start: str = "start", end: str = "end", observed_until: str | None = None, rows_per_task: int = hot.ROWS_PER_TASK) -> DataFrame:
    """(keys..., kind, start, end, n_open): one row per continuous period and per gap between two
    consecutive periods of a key; ``n_open`` is the number of spells open right after the row's start.

    Spells are closed on both sides, so two that share an instant belong to one period. Rows with
    a null key or start are left out, and so are spells that end before they start. An open spell
    (null end) and one that ends after ``observed_until`` end with it; without ``observed_until``
    an open spell is left out. Spells that start after it are left out too. Repeated rows change
    no period. Columns other than keys, start and end are ignored.

    Sweep line: each spell gives a plus event and a minus event; a running sum over the events of
    a key counts open spells, and only instants at which the count leaves or reaches zero are
    kept. Hot keys are cut by time: the sum of a part's events is carried into the parts after it,
    and the last instant of a part looks up the first one of the next part.
    """
    need(spells, *keys, start, end)
    until = F.lit(observed_until).cast("timestamp")
    own = [f"_k{i}" for i in range(len(keys))]
    s = spells.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(start).cast("timestamp").alias("s"), F.col(end).cast("timestamp").alias("e"))
    s = s.where(" and ".join(f"{o} is not null" for o in own) + " and s is not null").where("e is null or e >= s")
    if observed_until:
        s = s.withColumn("e", F.least(F.coalesce("e", until), until))
    s = s.where("e >= s").withColumns({"s": F.unix_micros("s"), "e": F.unix_micros("e")})
    cuts = hot.hot_cuts(s, own, "s", rows_per_task)
    ev = s.select(*own, F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("e").alias("at"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select(*own, "x.*")
    ev = hot.with_parts(ev, own, "at", cuts)
    if cuts is not None:
        ev = ev.repartition(*own, "_part")
    else:
        ev = ev.repartition(*own)
    ev = ev.groupBy(*own, "_part", "_hot", "at").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    if cuts is not None:
        ev = cut(ev)
        over = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carry = ev.where("_hot").groupBy(*own, "_part").agg(F.sum(F.col("up") - F.col("down")).alias("net"))
        carry = carry.select(*own, "_part", F.coalesce(F.sum("net").over(over), F.lit(0)).alias("carry"))
        ev = ev.join(bounded(carry), [*own, "_part"], "left")
    else:
        ev = ev.withColumn("carry", F.lit(None).cast("long"))
    w = Window.partitionBy(*own, "_part").orderBy("at")
    ev = ev.withColumn("after", F.sum(F.col("up") - F.col("down")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("carry", F.lit(0)))
    ev = ev.withColumn("starts", F.col("after") + F.col("down") - F.col("up") == 0).withColumn("ends", F.col("after") == 0)
    b = ev.where("starts or ends").withColumn("next", F.lead("at").over(w))
    if cuts is not None:
        b = cut(b)
        after = Window.partitionBy(*own).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
        firsts = b.where("_hot").groupBy(*own, "_part").agg(F.min("at").alias("at"))
        firsts = firsts.select(*own, "_part", F.min("at").over(after).alias("later"))
        b = b.join(bounded(firsts), [*own, "_part"], "left").withColumn("next", F.coalesce("next", "later"))
    period = F.when(F.col("starts"), F.struct(F.lit("period").alias("kind"), F.col("at").alias("a"), F.when(F.col("ends"), F.col("at")).otherwise(F.col("next")).alias("z"), F.when(F.col("ends"), F.col("up")).otherwise(F.col("after")).alias("n")))
    gap = F.when(F.col("ends") & F.col("next").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("at").alias("a"), F.col("next").alias("z"), F.lit(0).cast("long").alias("n")))
    out = b.select(*own, F.explode(F.filter(F.array(period, gap), lambda x: x.isNotNull())).alias("x"))
    return out.select(
        *[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)],
        F.col("x.kind").alias("kind"),
        F.timestamp_micros("x.a").alias("start"),
        F.timestamp_micros("x.z").alias("end"),
        F.col("x.n").alias("n_open"),
    )
