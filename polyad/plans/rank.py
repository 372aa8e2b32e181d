"""Ranks and running sums over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyad.plans.session import cut

_ROW = (1 << 33) - 1


def numbered(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with a row number from 1 in the given total order: rows are range partitioned and
    sorted, and each partition starts after the rows of those before it (one number a partition).
    Orders with ties give the tied rows any order."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = sorted(map(tuple, placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()))
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "_p long, _before long")
    return placed.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(name, F.col("_at").bitwiseAND(F.lit(_ROW)) + 1 + F.col("_before")).drop("_at", "_p", "_before")


def with_total(df: DataFrame, **sums: str | Column) -> DataFrame:
    """``df`` with whole-table sums as columns: a two-stage aggregate whose one row is broadcast."""
    row = df.agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    return df.crossJoin(F.broadcast(row))


_MERGE = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, order: list, name: str, value, how: str = "sum", rank: str = "rank") -> DataFrame:
    """``df`` with its row number ``rank`` in ``order`` and ``name``, the sum, min or max of ``value`` (a
    column, or a function of the row number's column) over the rows up to each. A range partition
    takes what the partitions before it come to, one value each, and goes on from there."""
    placed = numbered(df, *order, name=rank).withColumn("_v", value(F.col(rank)) if callable(value) else F.col(value) if isinstance(value, str) else value)
    placed = cut(placed.repartitionByRange(rank).withColumn("_p", F.spark_partition_id()))
    carry, before = None, []
    for p, v in sorted(map(tuple, placed.groupBy("_p").agg(_AGG[how]("_v")).collect())):
        before.append((p, carry))
        carry = v if carry is None else {"sum": carry + v, "min": min(carry, v), "max": max(carry, v)}[how]
    kind = "double" if any(isinstance(c, float) for _, c in before) else "long"
    starts = df.sparkSession.createDataFrame([(p, c if c is None or kind == "long" else float(c)) for p, c in before], f"_p int, _c {kind}")
    own = _AGG[how]("_v").over(Window.partitionBy("_p").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    out = placed.join(F.broadcast(starts), "_p").withColumn(name, own)
    return out.withColumn(name, F.when(F.col("_c").isNull(), F.col(name)).otherwise(_MERGE[how](F.col(name), F.col("_c")))).drop("_p", "_c", "_v")
