"""Splitting large groups by order, so that no group has to fit one task.

Window functions need a whole group in one partition. A key with more rows than a task should
take is therefore cut along its order column into parts of about that many rows, however large
the key; operators work on (key, part) and then settle what crosses a cut from one or two rows
a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.plans.session import bounded, cut

#: Rows of one key that a task should take.
ROWS_PER_TASK = 500_000


def hot_cuts(raw: DataFrame, keys: list[str], order: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """Cut points of the keys of ``raw`` with more than ``rows_per_task`` rows: (keys..., _cuts array
    of the order column), or None if there are none. A key of n rows gets the power of two of parts
    that brings a part to at most ``rows_per_task`` rows, so there are fewer cuts in all than twice
    the rows over ``rows_per_task``. ``raw`` should be a cheap scan. Only the numbers of parts
    that occur, a few powers of two, come to the driver."""
    counted = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_task)
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_n") / rows_per_task))).cast("int")
    hot = cut(counted.select(*keys, parts.alias("_parts")))
    sizes = [r["_parts"] for r in hot.select("_parts").distinct().collect()]
    if not sizes:
        return None
    rows = raw.join(bounded(hot), keys)
    found = [F.percentile_approx(F.when(F.col("_parts") == p, F.col(order)), [i / p for i in range(1, p)], max(1000, 8 * p)) for p in sorted(sizes)]
    return cut(rows.groupBy(*keys).agg(F.array_distinct(F.coalesce(*found)).alias("_cuts")))


def with_parts(df: DataFrame, keys: list[str], order: str, cuts: DataFrame | None) -> DataFrame:
    """Add ``_part`` (0 for keys that are not split) and ``_hot``. Rows with equal order value
    are never parted."""
    if cuts is None:
        return df.withColumns({"_part": F.lit(0), "_hot": F.lit(False)})
    joined = df.join(bounded(cuts), keys, "left")
    part = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return joined.withColumns({"_part": F.when(F.col("_cuts").isNull(), 0).otherwise(part), "_hot": F.col("_cuts").isNotNull()}).drop("_cuts")
