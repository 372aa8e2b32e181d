"""Shortest paths of unweighted graphs from every node at once, level by level on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.errors import NoConverge
from polyad.plans.session import cut


def shortest_paths(links: DataFrame, nodes: DataFrame, max_length: int = 1000) -> DataFrame:
    """(s, v, d, sigma): length and number of shortest paths along (a, b) from every node to every node
    it reaches, itself at 0 included. A level is one join of the frontier, one sum and one
    anti-join; levels end when the frontier is empty."""
    e = cut(links.where("a <> b").select("a", "b").distinct())
    front = nodes.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma"))
    seen = front = cut(front)
    for d in range(1, max_length + 1):
        step = front.join(e, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum("sigma").alias("sigma"))
        front = cut(step.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(d).alias("d"), "sigma"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front) if d % 8 else cut(seen.unionByName(front))
    raise NoConverge(f"paths longer than {max_length}")


def closeness(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, value): nodes reached less one over the sum of distances, times their share of all others;
    0 for a node that reaches none."""
    n = nodes.count()
    by = shortest_paths(links, nodes).groupBy("s").agg((F.count(F.lit(1)) - 1).alias("r"), F.sum("d").alias("far"))
    value = F.when(F.col("far") > 0, F.col("r") / F.col("far") * F.col("r") / F.lit(max(n - 1, 1))).otherwise(0.0)
    return by.select(F.col("s").alias("node"), value.alias("value"))


def betweenness(links: DataFrame, nodes: DataFrame, directed: bool = False, normalised: bool = True) -> DataFrame:
    """(node, value): shortest paths through a node, each pair of ends sharing one among its paths. Counts
    go forward level by level, dependencies back from the farthest level."""
    n = nodes.count()
    p = cut(shortest_paths(links, nodes))
    e = cut(links.where("a <> b").select("a", "b").distinct())
    far = p.agg(F.max("d")).first()[0] or 0
    above: DataFrame | None = None  # (s, v, sigma, delta) of the level just done
    total: DataFrame | None = None
    for d in range(far, 0, -1):
        level = p.where(F.col("d") == d).select("s", "v", "sigma")
        level = level.withColumn("delta", F.lit(0.0)) if above is None else level.join(above, ["s", "v"], "left").na.fill(0.0, ["delta"])
        level = cut(level)
        part = level.where("delta > 0").groupBy("v").agg(F.sum("delta").alias("x"))
        total = part if total is None else total.unionByName(part)
        back = level.join(e, F.col("v") == F.col("b")).select("s", F.col("a").alias("u"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        below = p.where(F.col("d") == d - 1).select("s", F.col("v").alias("u"), F.col("sigma").alias("sigma_u"))
        above = back.join(below, ["s", "u"]).groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("share") * F.col("sigma_u")).alias("delta"))
    scale = (1.0 if directed else 0.5) * ((1.0 if directed else 2.0) / ((n - 1) * (n - 2)) if normalised and n > 2 else 1.0)
    sums = nodes.select("node").withColumn("x", F.lit(0.0)) if total is None else nodes.select("node").join(total.groupBy(F.col("v").alias("node")).agg(F.sum("x").alias("x")), "node", "left")
    return sums.select("node", (F.coalesce("x", F.lit(0.0)) * F.lit(scale)).alias("value"))


