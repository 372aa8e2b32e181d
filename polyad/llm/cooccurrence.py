"""Items that appear together: pair counts over baskets, against chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.plans.session import bounded, cut, need

#: Members of a basket are paired in blocks of this many, so that one very large basket is many rows.
BLOCK = 128
#: Pairs that a task should make.
PAIRS_PER_TASK = 4_000_000


def memberships(hyperedges: DataFrame, incidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hg, edge, item): a node of ``nodes`` is a member of an edge if the list of the edge holds
    its index or a row of ``incidence`` has it with a weight other than 0 (null counts as 1).
    Null or unknown indexes and names, null lists and null hg or edge give nothing; repeated rows
    may come out repeated. ``item`` is the least index of the node's name."""
    need(hyperedges, "hg", "edge", "hyperedges")
    need(incidence, "hg", "edge", "node", "weight")
    need(nodes, "node", "node_idx")
    known = nodes.where("node is not null and node_idx is not null")
    ids = known.groupBy("node").agg(F.min("node_idx").alias("item"))
    by_idx = known.select("node", "node_idx").distinct().join(ids, "node").select("node_idx", "item").distinct()
    lists = hyperedges.select("hg", "edge", F.explode("hyperedges").alias("node_idx")).where("node_idx is not null")
    listed = lists.join(by_idx, "node_idx").select("hg", "edge", "item")
    named = incidence.where("coalesce(weight, 1) <> 0").select("hg", "edge", "node").join(ids, "node").select("hg", "edge", "item")
    return listed.unionByName(named).where("hg is not null and edge is not null")


def pair_counts(members: DataFrame, group: str = "hg", basket: str = "edge", item: str = "item", min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """(group, item_a, item_b, n_both, n_a, n_b, n_baskets, lift, conviction_ab, conviction_ba) with
    item_a < item_b, for every pair that shares at least ``min_count`` baskets and whose lift
    n_both * n_baskets / (n_a * n_b) is at least ``min_lift``. ``conviction`` of a certain rule is
    infinite. Rows with a null are left out, repeated members count once, empty tables give no row.
    Items are integers.

    Basket collapsing: repeated members go, baskets with the same set of members (told by their
    number and 128 bits of hash, so that no basket is ever gathered in one row) become one with a
    weight, pairs are enumerated once per distinct basket and weights are summed, partly before the
    shuffle. Both thresholds first remove items, without loss: n_both <= min(n_a, n_b), so a pair
    that qualifies needs n >= min_count and n * min_lift <= n_baskets of both; items in a large
    share of all baskets go before any pair is made. Members of a basket lie in blocks of about
    BLOCK by hash; each pair of blocks is a row of its own, and these rows are spread by the number
    of pairs they make before they make them.
    """
    spark = members.sparkSession
    m = members.select(F.col(group).alias("g"), F.col(basket).alias("b"), F.col(item).cast("int").alias("i"))
    m = m.where("g is not null and b is not null and i is not null").distinct()
    signed = m.groupBy("g", "b").agg(F.bit_xor(F.xxhash64("i")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "i")).alias("y"), F.count(F.lit(1)).alias("n"))
    kinds = cut(signed.groupBy("g", "x", "y", "n").agg(F.count(F.lit(1)).alias("w"), F.min("b").alias("b")).select("g", "b", "w", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")).withColumn("k", F.monotonically_increasing_id()))
    total = kinds.groupBy("g").agg(F.sum("w").alias("n_baskets"))
    whole = cut(m.join(kinds, ["g", "b"]).select("g", "k", "w", "nb", "i"))
    degree = whole.groupBy("g", "i").agg(F.sum("w").alias("d"))
    degree = cut(degree.join(bounded(total), "g").where((F.col("d") >= min_count) & (F.col("d") * F.lit(float(min_lift)) <= F.col("n_baskets"))))
    left = whole.join(bounded(degree.select("g", "i")), ["g", "i"], "left_semi").withColumn("p", F.pmod(F.xxhash64(F.lit(2), "i"), F.col("nb")).cast("int"))
    blocks = left.groupBy("g", "k", "w", "nb", "p").agg(F.collect_list("i").alias("xs"))
    blocks = cut(blocks.where("nb > 1 or size(xs) > 1"))
    made = blocks.groupBy("k").agg(F.sum(F.size("xs")).alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n") / 2), F.lit(0.0)).alias("n")).first()["n"]
    inside = blocks.select("g", "w", "xs", F.lit(None).cast("array<int>").alias("ys"))
    wide = blocks.where("nb > 1")
    ahead = wide.where("p < nb - 1").select("g", "k", "w", "xs", F.explode(F.sequence(F.col("p") + 1, F.col("nb") - 1)).alias("p"))
    across = ahead.join(wide.select("k", "p", F.col("xs").alias("ys")), ["k", "p"]).select("g", "w", "xs", "ys")
    two = inside.unionByName(across).repartition(max(spark.sparkContext.defaultParallelism, int(made) // PAIRS_PER_TASK))
    pair = two.select("g", "w", F.explode("xs").alias("s"), F.coalesce("ys", "xs").alias("t"), F.col("ys").isNull().alias("inside"))
    pair = pair.select("g", "w", "inside", "s", F.explode("t").alias("t")).where("not inside or s < t")
    ab = pair.select("g", "w", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
    key = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    c = ab.select("g", "w", key.alias("ab")).groupBy("g", "ab").agg(F.sum("w").alias("n_both")).where(F.col("n_both") >= min_count)
    c = c.select("g", F.shiftright("ab", 32).cast("int").alias("a"), F.col("ab").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "n_both")
    c = c.join(bounded(degree.select("g", F.col("i").alias("a"), F.col("d").alias("n_a"), "n_baskets")), ["g", "a"])
    c = c.join(bounded(degree.select("g", F.col("i").alias("b"), F.col("d").alias("n_b"))), ["g", "b"])
    c = c.where(F.col("n_both") * F.col("n_baskets") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    n = F.col("n_baskets").cast("double")

    def conviction(x: str, y: str):
        miss = F.col(x) - F.col("n_both")
        return F.when(miss == 0, F.lit(float("inf"))).otherwise((F.lit(1.0) - F.col(y) / n) / (miss / F.col(x)))

    return c.select(
        F.col("g").alias(group), F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_both", "n_a", "n_b", "n_baskets",
        (F.col("n_both") * n / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        conviction("n_a", "n_b").alias("conviction_ab"), conviction("n_b", "n_a").alias("conviction_ba"),
    )


def named_pairs(pairs: DataFrame, nodes: DataFrame, group: str = "hg") -> DataFrame:
    """``pairs`` with node names, node_a < node_b by code point."""
    names = nodes.where("node is not null and node_idx is not null").groupBy("node").agg(F.min("node_idx").alias("item"))
    x = pairs.join(names.select(F.col("item").alias("item_a"), F.col("node").alias("na")), "item_a")
    x = x.join(names.select(F.col("item").alias("item_b"), F.col("node").alias("nb")), "item_b")
    swap = F.col("na") > F.col("nb")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return x.select(
        group, pick("na", "nb").alias("node_a"), pick("nb", "na").alias("node_b"), "n_both",
        pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "n_baskets", "lift",
        pick("conviction_ab", "conviction_ba").alias("conviction_ab"), pick("conviction_ba", "conviction_ab").alias("conviction_ba"),
    )
