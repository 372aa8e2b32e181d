"""Structural measures and projections of hypergraphs given as memberships (node, edge, weight)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyad.errors import BadInput
from polyad.functions.stats import hypergeometric_tails, p_adjust
from polyad.operators.configuration import dealt, draw_sums, observed_sums
from polyad.operators.hypergraph import collapse_duplicates
from polyad.operators.paths import betweenness, closeness
from polyad.plans.rank import numbered, running, with_total
from polyad.plans.session import bounded, cut
from polyad.plans.together import number


def _sizes(m: DataFrame) -> DataFrame:
    return m.groupBy("edge").agg(F.count(F.lit(1)).alias("size"))


#: Rows of one join key that a task should pair; more are paired block by block.
PAIR_BLOCK = 1000


def _paired(m: DataFrame, key: str, item: str, *carry: str) -> DataFrame:
    """Rows of ``m`` that share ``key``, once per pair with the lesser ``item`` as _a and the greater
    as _b, ``carry`` with them. A key of more than PAIR_BLOCK rows is cut into blocks by hash, and
    each block of the right side is a join key of its own, so no key's pairs lie in one task."""
    side = lambda t, x: t.select(*keys, F.col(item).alias(f"{item}_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in carry])
    keys = [key]
    large = cut(m.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PAIR_BLOCK))
    if large.isEmpty():
        return side(m, "a").join(side(m, "b"), keys).where(f"{item}_a < {item}_b")
    keys = [key, "_q"]
    blocks = m.join(bounded(large), key, "left").withColumn("_k", F.coalesce(F.ceil(F.col("_n") / PAIR_BLOCK), F.lit(1)).cast("int"))
    asks = blocks.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    data = blocks.withColumn("_q", F.pmod(F.xxhash64(item), F.col("_k")).cast("int"))
    return side(asks, "a").join(side(data, "b"), keys).where(f"{item}_a < {item}_b").drop("_q")


def node_pairs(m: DataFrame) -> DataFrame:
    """(node_a, node_b, edge, w_a, w_b), node_a < node_b, one row per pair and edge."""
    return _paired(m, "edge", "node", "weight").select("edge", "node_a", "node_b", F.col("weight_a").alias("w_a"), F.col("weight_b").alias("w_b"))


def neighbours(m: DataFrame) -> DataFrame:
    """(node, o): distinct co-members, both ways; pairs are made distinct one way first."""
    p = node_pairs(m).select("node_a", "node_b").distinct()
    return p.select(F.explode(F.array(F.struct(F.col("node_a").alias("node"), F.col("node_b").alias("o")), F.struct(F.col("node_b").alias("node"), F.col("node_a").alias("o")))).alias("x")).select("x.*")


def node_measures(m: DataFrame) -> DataFrame:
    """(node, hyperdegree, strength, max_edge_size, n_neighbors); strength adds the sizes of a
    node's edges, neighbours are distinct co-members."""
    base = m.join(_sizes(m), "edge").groupBy("node").agg(F.count(F.lit(1)).alias("hyperdegree"), F.sum("size").alias("strength"), F.max("size").alias("max_edge_size"))
    n = neighbours(m).groupBy("node").agg(F.count(F.lit(1)).alias("n_neighbors"))
    return base.join(n, "node", "left").withColumn("n_neighbors", F.coalesce("n_neighbors", F.lit(0)))


def edge_overlaps(m: DataFrame) -> DataFrame:
    """(edge_a, edge_b, overlap, size_a, size_b, min_share, jaccard) of edges that share a node."""
    s = m.join(_sizes(m), "edge").select("node", "edge", "size")
    o = _paired(s, "node", "edge", "size").groupBy("edge_a", "edge_b").agg(F.count(F.lit(1)).alias("overlap"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    return o.withColumns({"min_share": F.col("overlap") / F.least("size_a", "size_b"), "jaccard": F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))})


def edge_measures(m: DataFrame, s: int = 1, neighbours: bool = False) -> DataFrame:
    """(edge, size, weight, n_incident_edges[, n_neighbors]): other edges that share at least ``s``
    nodes; non-members that share an edge with a member."""
    base = m.groupBy("edge").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"))
    o = edge_overlaps(m).where(F.col("overlap") >= s)
    inc = o.select(F.explode(F.array("edge_a", "edge_b")).alias("edge")).groupBy("edge").agg(F.count(F.lit(1)).alias("n_incident_edges"))
    out = base.join(inc, "edge", "left").withColumn("n_incident_edges", F.coalesce("n_incident_edges", F.lit(0)))
    if neighbours:
        near = neighbours(m)
        reach = m.select("edge", "node").join(near, "node").select("edge", F.col("o").alias("node")).distinct()
        n = reach.join(m.select("edge", "node"), ["edge", "node"], "left_anti").groupBy("edge").agg(F.count(F.lit(1)).alias("n_neighbors"))
        out = out.join(n, "edge", "left").withColumn("n_neighbors", F.coalesce("n_neighbors", F.lit(0)))
    return out


def summary(m: DataFrame) -> DataFrame:
    """One row: n_nodes, n_hyperedges, density, avg_size, pairwise_participation. Density of a uniform
    hypergraph is m over C(n, k), of any other the filled share of cells."""
    n = m.agg(F.count_distinct("node").alias("n_nodes"))
    e = _sizes(m).agg(F.count(F.lit(1)).alias("n_hyperedges"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.sum("size").alias("cells"))
    pairs = node_pairs(m).select("node_a", "node_b").distinct().agg(F.count(F.lit(1)).alias("pairs"))
    x = n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(pairs))
    choose = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("lo")), F.lit(1.0), lambda acc, i: acc * (F.col("n_nodes") - F.col("lo") + i) / i)
    density = F.when(F.col("lo") == F.col("hi"), F.col("n_hyperedges") / choose).otherwise(F.col("cells") / (F.col("n_nodes") * F.col("n_hyperedges")))
    return x.select("n_nodes", "n_hyperedges", density.alias("density"), (F.col("cells") / F.col("n_hyperedges")).alias("avg_size"), (F.col("pairs") / (F.col("n_nodes") * (F.col("n_nodes") - 1) / 2)).alias("pairwise_participation"))


def distribution(values: DataFrame, column: str) -> DataFrame:
    """(value, n, proportion, ccdf): ccdf is the share of values at least as large. The distinct values
    are ranked by range, their running sum is that of the partitions before plus that inside one."""
    g = values.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    r = running(with_total(cut(g), every="n"), [F.desc("value")], "upto", "n")
    return r.select("value", "n", (F.col("n") / F.col("every")).alias("proportion"), (F.col("upto") / F.col("every")).alias("ccdf"))


def summarise(values: DataFrame, column: str) -> DataFrame:
    c = F.col(column).cast("double")
    return values.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("min"), F.percentile(c, F.lit(0.25)).alias("q25"), F.percentile(c, F.lit(0.5)).alias("median"), F.percentile(c, F.lit(0.75)).alias("q75"), F.max(c).alias("max"))


def components(m: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(kind, name, component): node and edge of each connected component, named by its least node.

    Labels spread node -> edge -> node; every round also follows labels of labels, so the number of
    rounds grows with the logarithm of the diameter. Each round is materialised in the shared
    checkpoint folder."""
    links = cut(m.select("node", "edge"))
    lab = cut(links.groupBy("edge").agg(F.min("node").alias("label")))
    node = cut(links.join(lab, "edge").groupBy("node").agg(F.min("label").alias("label")))
    for _ in range(max_rounds):
        edge = links.join(node, "node").groupBy("edge").agg(F.min("label").alias("label"))
        near = links.join(edge, "edge").groupBy("node").agg(F.min("label").alias("near"))
        hop = node.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        nxt = cut(node.join(near, "node").join(hop, "label", "left").select("node", "label", F.least("near", "hop").alias("new")))
        changed = nxt.where("new <> label").limit(1).count()
        node = nxt.select("node", F.col("new").alias("label"))
        if not changed:
            break
    else:
        raise BadInput(f"components did not settle in {max_rounds} rounds")
    edge = links.join(node, "node").groupBy("edge").agg(F.min("label").alias("component"))
    return node.select(F.lit("node").alias("kind"), F.col("node").alias("name"), F.col("label").alias("component")).unionByName(edge.select(F.lit("edge").alias("kind"), F.col("edge").alias("name"), "component"))


def component_table(m: DataFrame) -> DataFrame:
    """(component, n_nodes, n_edges, share, rank), largest first, ties by name."""
    c = components(m).groupBy("component").agg(F.sum((F.col("kind") == "node").cast("long")).alias("n_nodes"), F.sum((F.col("kind") == "edge").cast("long")).alias("n_edges"))
    c = with_total(cut(c), every="n_nodes").withColumn("share", F.col("n_nodes") / F.col("every")).drop("every")
    return numbered(c, F.desc("n_nodes"), "component")


def clique_projection(m: DataFrame, weighted: bool = False) -> DataFrame:
    """(node_a, node_b, weight): shared edges, or the sum of weight products."""
    w = F.sum(F.col("w_a") * F.col("w_b")) if weighted else F.count(F.lit(1)).cast("double")
    return node_pairs(m).groupBy("node_a", "node_b").agg(w.alias("weight"))


def association_projection(m: DataFrame, collapse: bool = False) -> DataFrame:
    """(node_a, node_b, weight): each shared edge adds 1 / (size - 1), so that a node's row sums to
    its hyperdegree. ``collapse`` counts edges with equal members once."""
    b = collapse_duplicates(m).select("edge", F.explode("members").alias("node"), F.lit(1.0).alias("weight")) if collapse else m
    s = _sizes(b).where("size > 1")
    return node_pairs(b).join(s, "edge").groupBy("node_a", "node_b").agg(F.sum(F.lit(1.0) / (F.col("size") - 1)).alias("weight"))


def citation_projection(m: DataFrame, source: DataFrame, directed: bool = True) -> DataFrame:
    """(source, target, weight): edges' sources (edge, source) to their members, itself excluded."""
    p = m.join(source, "edge").select(F.col("source").cast("string").alias("source"), F.col("node").alias("target")).where("source <> target")
    if not directed:
        p = p.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    return p.groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def line_graph(m: DataFrame, s: int = 1) -> DataFrame:
    """(edge_a, edge_b, weight): edges that share at least ``s`` nodes."""
    return edge_overlaps(m).where(F.col("overlap") >= s).select("edge_a", "edge_b", F.col("overlap").alias("weight"))


def edge_centrality(m: DataFrame, s: int = 1, measure: str = "closeness", normalised: bool = True) -> DataFrame:
    """(edge, s, measure, value) on the graph of edges that share at least ``s`` nodes: closeness with
    the correction for components, or betweenness over 2 / ((n - 1)(n - 2))."""
    half = cut(line_graph(m, s).select(F.col("edge_a").alias("a"), F.col("edge_b").alias("b")))
    links = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = cut(m.select(F.col("edge").alias("node")).distinct())
    if measure == "closeness":
        v = closeness(links, nodes)
    elif measure == "betweenness":
        v = betweenness(links, nodes, normalised=normalised)
    else:
        raise BadInput("measure is closeness or betweenness")
    return v.select(F.col("node").alias("edge"), F.lit(s).alias("s"), F.lit(measure).alias("measure"), "value")


def extra_overlap(m: DataFrame) -> DataFrame:
    """(edge_a, edge_b, overlap_beyond): of edges that share a node, the share of members of either alone
    that have a neighbour among the members of the other alone; 0 for equal edges.

    A member x of e alone is a neighbour of all that e and f share; so it has one in f alone if it has
    more neighbours in f than e and f share, which takes two at least."""
    b = cut(m.select("node", "edge"))
    pairs = cut(edge_overlaps(m).select("edge_a", "edge_b", "overlap", (F.col("size_a") + F.col("size_b") - 2 * F.col("overlap")).alias("alone")))
    met = neighbours(m).join(b.select(F.col("node").alias("o"), F.col("edge").alias("f")), "o").groupBy("node", "f").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = met.join(b.select("node", F.col("edge").alias("f")), ["node", "f"], "left_anti").join(b, "node")
    hits = met.select(F.least("edge", "f").alias("edge_a"), F.greatest("edge", "f").alias("edge_b"), F.col("n").alias("near")).join(pairs.where("alone > 0").select("edge_a", "edge_b", "overlap"), ["edge_a", "edge_b"]).where("near > overlap")
    hits = hits.groupBy("edge_a", "edge_b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(hits, ["edge_a", "edge_b"], "left").select("edge_a", "edge_b", F.when(F.col("alone") > 0, F.coalesce("n", F.lit(0)) / F.col("alone")).otherwise(0.0).alias("overlap_beyond"))


def extra_overlap_transitivity(m: DataFrame) -> DataFrame:
    """(node, transitivity): the mean ``extra_overlap`` of the pairs of a node's edges; 0 for a node of
    one edge. Nodes and edges go by number, so that pairs are narrow."""
    names, cells, _ = number(m)
    _, cells, _ = number(cells, "edge", "i")  # (i, edge) are now the edge's number and the node's
    b = cut(cells.select(F.col("edge").alias("node"), F.col("i").alias("edge"), "weight"))
    d = b.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    p = _paired(b, "node", "edge").join(extra_overlap(b), ["edge_a", "edge_b"]).groupBy("node").agg(F.sum("overlap_beyond").alias("x"))
    k = F.col("k")
    t = d.join(p, "node", "left").select(F.col("node").alias("i"), F.when(k == 1, 0.0).otherwise(2 * F.coalesce("x", F.lit(0.0)) / (k * (k - 1))).alias("transitivity"))
    return names.join(t, "i").select("node", "transitivity")


#: Pairs of a graph that a task of the triangle count should hold.
TRIANGLE_PAIRS = 6_000_000


def triangles(p: DataFrame) -> DataFrame:
    """(i, closed): triangles at each node of distinct pairs (a, b) of node numbers below 2^31. Nodes fall
    into groups; a task holds the pairs among three groups and counts the triangles whose members are
    of just these, so that no two-path is written anywhere."""
    g = max(3, math.ceil(math.sqrt(6 * p.count() / TRIANGLE_PAIRS)))
    three = F.array_sort(F.array(F.col("a") % g, F.col("b") % g, F.col("third")))
    x = p.withColumn("third", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long")))).withColumn("three", three)
    x = x.select(((F.col("three")[0] * g + F.col("three")[1]) * g + F.col("three")[2]).alias("t"), F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("pair"))

    def count(key, pdf):
        import numpy as np
        import pandas as pd

        pair, t = pdf["pair"].to_numpy(), int(key[0])
        names, at = np.unique(np.concatenate([pair >> 32, pair & 0xFFFFFFFF]), return_inverse=True)
        n = len(names)
        place = np.argsort(np.bincount(at, minlength=n), kind="stable")  # from few neighbours to many keeps lists short
        rank = np.argsort(place).astype(np.int32)
        lo, hi = rank[at[: len(pair)]], rank[at[len(pair) :]]
        u, v = np.minimum(lo, hi), np.maximum(lo, hi)
        order = np.argsort(u, kind="stable")
        v, first = v[order], np.searchsorted(u[order], np.arange(n + 1))
        own, want = names[place] % g, t % g + t // g % g + t // g**2
        closed, flag = np.zeros(n, np.int64), np.zeros(n, bool)
        for k in range(n):
            near = v[first[k] : first[k + 1]]
            flag[near] = True
            for c in range(0, len(near), 1000):
                mid = near[c : c + 1000]
                size = first[mid + 1] - first[mid]
                far = v[np.repeat(first[mid] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                hit = np.flatnonzero(flag[far])
                mid, far = np.repeat(mid, size)[hit], far[hit]
                just = own[k] + own[mid] + own[far] == want  # not all three of the group that occurs twice
                mid, far = mid[just], far[just]
                closed[k] += len(far)
                closed += np.bincount(mid, minlength=n) + np.bincount(far, minlength=n)
            flag[near] = False
        return pd.DataFrame({"i": names[place], "closed": closed})

    return x.groupBy("t").applyInPandas(count, "i long, closed long").groupBy("i").agg(F.sum("closed").alias("closed"))


def projection_transitivity(m: DataFrame) -> DataFrame:
    """(node, transitivity): closed two-paths over pairs of neighbours in the clique projection; null
    below two neighbours."""
    names, cells, _ = number(m)
    p = cut(node_pairs(cells.withColumnRenamed("i", "node")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    deg = p.select(F.explode(F.array("a", "b")).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("k"))
    every = names.join(deg, "i", "left").join(triangles(p), "i", "left")
    k = F.col("k")
    return every.select("node", F.when(k >= 2, F.coalesce("closed", F.lit(0)) / (k * (k - 1) / 2)).alias("transitivity"))


def pair_transitivity(m: DataFrame, kind: str = "union") -> DataFrame:
    """(node, transitivity): shared edges of a node and a neighbour over the union, the smaller or the
    larger of their hyperdegrees, averaged over neighbours; null without neighbours."""
    d = m.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    c = node_pairs(m).groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("n"))
    c = c.join(d.select(F.col("node").alias("node_a"), F.col("d").alias("da")), "node_a").join(d.select(F.col("node").alias("node_b"), F.col("d").alias("db")), "node_b")
    below = {"union": F.col("da") + F.col("db") - F.col("n"), "min": F.least("da", "db"), "max": F.greatest("da", "db")}
    if kind not in below:
        raise BadInput("kind is union, min or max")
    c = c.withColumn("v", F.col("n") / below[kind])
    half = c.select(F.col("node_a").alias("node"), "v").unionByName(c.select(F.col("node_b").alias("node"), "v"))
    return d.select("node").join(half.groupBy("node").agg(F.avg("v").alias("transitivity")), "node", "left")


def assortativity(m: DataFrame, kind: str = "uniform", rank: bool = False) -> DataFrame:
    """One row (kind, assortativity): correlation of hyperdegrees of two members of an edge, each edge
    of at least two members weighing the same. ``uniform`` takes all ordered pairs of distinct
    members, ``top_2`` the two largest, ``top_bottom`` the largest and the smallest, both ways."""
    d = m.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("d"))
    if rank:
        w = Window.orderBy("d")
        d = d.withColumn("d", F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy("d")) - 1) / 2.0)
    e = m.join(d, "node").groupBy("edge").agg(F.count(F.lit(1)).alias("k"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"), F.sort_array(F.collect_list("d"), asc=False).alias("ds")).where("k >= 2")
    if kind == "uniform":
        x, xx, xy = F.col("s") / F.col("k"), F.col("q") / F.col("k"), (F.col("s") * F.col("s") - F.col("q")) / (F.col("k") * (F.col("k") - 1))
    elif kind in ("top_2", "top_bottom"):
        a = F.element_at("ds", 1)
        b = F.element_at("ds", 2 if kind == "top_2" else -1)
        x, xx, xy = (a + b) / 2, (a * a + b * b) / 2, a * b
    else:
        raise BadInput("kind is uniform, top_2 or top_bottom")
    t = e.agg(F.avg(x).alias("x"), F.avg(xx).alias("xx"), F.avg(xy).alias("xy"))
    var = F.col("xx") - F.col("x") * F.col("x")
    return t.select(F.lit(kind).alias("kind"), F.when(var > 1e-12, (F.col("xy") - F.col("x") * F.col("x")) / var).alias("assortativity"))


def degree_correlation(m: DataFrame) -> DataFrame:
    """(size_a, size_b, correlation): Pearson correlation over all nodes of their hyperdegrees by edge
    size, zeros included."""
    s = m.join(_sizes(m), "edge").groupBy("node", "size").agg(F.count(F.lit(1)).alias("d"))
    sizes = s.select("size").distinct()
    grid = m.select("node").distinct().crossJoin(F.broadcast(sizes))  # a node by a distinct size
    full = grid.join(s, ["node", "size"], "left").select("node", "size", F.coalesce("d", F.lit(0)).cast("double").alias("d"))
    a, b = full.select("node", F.col("size").alias("size_a"), F.col("d").alias("x")), full.select("node", F.col("size").alias("size_b"), F.col("d").alias("y"))
    g = a.join(b, "node").where("size_a < size_b").groupBy("size_a", "size_b").agg(F.corr("x", "y").alias("correlation"), F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy"))
    return g.select("size_a", "size_b", F.when((F.col("_sx") > 0) & (F.col("_sy") > 0), F.col("correlation")).alias("correlation"))


def representations(m: DataFrame) -> DataFrame:
    """(representation, n_edges, mean_degree, median_degree): simple graph (bg), multigraph (mg),
    simple hypergraph (bh) and multi-hypergraph (mh) of the same memberships."""
    pairs = node_pairs(m).select("node_a", "node_b")
    simple = pairs.distinct()
    once = collapse_duplicates(m).select("edge", F.explode("members").alias("node"))
    ends = lambda p: p.select(F.explode(F.array("node_a", "node_b")).alias("node"))
    nodes = m.select("node").distinct()

    def row(name: str, edges: DataFrame, incident: DataFrame) -> DataFrame:
        d = nodes.join(incident.groupBy("node").agg(F.count(F.lit(1)).alias("d")), "node", "left").agg(F.avg(F.coalesce("d", F.lit(0))).alias("mean_degree"), F.percentile(F.coalesce(F.col("d"), F.lit(0)).cast("double"), F.lit(0.5)).alias("median_degree"))
        return edges.agg(F.count(F.lit(1)).alias("n_edges")).crossJoin(d).select(F.lit(name).alias("representation"), "n_edges", "mean_degree", "median_degree")

    return row("bg", simple, ends(simple)).unionByName(row("mg", pairs, ends(pairs))).unionByName(row("bh", once.select("edge").distinct(), once)).unionByName(row("mh", m.select("edge").distinct(), m))


def _urn(m: DataFrame, min_count: int) -> DataFrame:
    d = m.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    c = clique_projection(m).withColumn("observed", F.col("weight").cast("long"))
    c = c.join(d.select(F.col("node").alias("node_a"), F.col("d").alias("da")), "node_a").join(d.select(F.col("node").alias("node_b"), F.col("d").alias("db")), "node_b")
    c = cut(c.select("node_a", "node_b", "observed", (F.col("da") * F.col("db")).alias("k")))
    c = with_total(c, urn="k", draws="observed").where(F.col("observed") >= min_count)
    return c.withColumn("expected", F.col("draws") * F.col("k") / F.col("urn")).withColumn("ratio", F.col("observed") / F.col("expected"))


def pair_expected(m: DataFrame, min_count: int = 5) -> DataFrame:
    """(node_a, node_b, observed, expected, ratio) of ``pair_anomaly``, without its tails."""
    return _urn(m, min_count).select("node_a", "node_b", "observed", "expected", "ratio")


def pair_anomaly(m: DataFrame, min_count: int = 5, alpha: float = 0.05) -> DataFrame:
    """(node_a, node_b, observed, expected, ratio, p_over, p_under, p_over_adj, p_under_adj, anomaly):
    pairs that share more or fewer edges than degrees let expect. The urn holds d_a d_b balls of every
    co-occurring pair and is drawn once per co-occurrence; both sums are taken before pairs under
    ``min_count`` are dropped, so the threshold changes rows and never the expectation."""
    c = _urn(m, min_count).withColumn("t", hypergeometric_tails("observed", "k", "urn", "draws"))
    c = c.select("node_a", "node_b", "observed", "expected", "ratio", F.col("t.upper").alias("p_over"), F.col("t.lower").alias("p_under"))
    c = p_adjust(p_adjust(c, "p_over", "p_over_adj"), "p_under", "p_under_adj")
    return c.withColumn("anomaly", F.when(F.col("p_over_adj") < alpha, "over").when(F.col("p_under_adj") < alpha, "under").otherwise("normal"))


def triple_motifs(m: DataFrame) -> DataFrame:
    """One row (y, t, o): sets of four nodes that hold one, three or six pairs of distinct 3-member
    edges with two nodes in common."""
    e = collapse_duplicates(m).where("size = 3").select(F.array_join("members", "|").alias("e"), "members")
    two = e.select("e", "members", F.explode(F.array(F.array(F.col("members")[0], F.col("members")[1]), F.array(F.col("members")[0], F.col("members")[2]), F.array(F.col("members")[1], F.col("members")[2]))).alias("pair"))
    j = two.select(F.col("e").alias("ea"), F.col("members").alias("ma"), "pair").join(two.select(F.col("e").alias("eb"), F.col("members").alias("mb"), "pair"), "pair").where("ea < eb")
    four = j.groupBy(F.array_sort(F.array_union("ma", "mb")).alias("four")).agg(F.count(F.lit(1)).alias("n"))
    one = lambda k: F.coalesce(F.sum((F.col("n") == k).cast("long")), F.lit(0))
    return four.agg(one(1).alias("y"), one(3).alias("t"), one(6).alias("o"))


def null_statistics(m: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., density, avg_size, avg_jaccard, participation, repeated_edges, repeated_pairs), by
    ``keys`` (a replicate), over memberships (keys..., node, edge)."""
    keys = keys or []
    b = m.select(*keys, "node", "edge")
    size = b.groupBy(*keys, "edge").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("node")).alias("set"))
    base = b.groupBy(*keys).agg(F.count_distinct("node").alias("n"), F.count_distinct("edge").alias("m"), F.count(F.lit(1)).alias("cells"))
    rep = size.groupBy(*keys, "set").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.sum(F.when(F.col("c") > 1, F.col("c") - 1).otherwise(0)).alias("repeated_edges"))
    s = b.join(size.select(*keys, "edge", "size"), [*keys, "edge"])
    pr = s.select(*keys, "edge", "size", F.col("node").alias("a")).join(b.select(*keys, "edge", F.col("node").alias("z")), [*keys, "edge"]).where("a < z")
    x = pr.groupBy(*keys, "a", "z").agg(F.count(F.lit(1)).alias("c"))
    pairs = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.when(F.col("c") > 1, 1).otherwise(0)).alias("repeated_pairs"))
    # every shared node adds 1 / (sa + sb - 1), by sizes at each node; edges that share more are found by the pairs they repeat and corrected
    h = s.groupBy(*keys, "node", "size").agg(F.count(F.lit(1)).alias("h"))
    hh = h.withColumnsRenamed({"size": "sa", "h": "ha"}).join(h.withColumnsRenamed({"size": "sb", "h": "hb"}), [*keys, "node"]).where("sa <= sb")
    met = F.when(F.col("sa") == F.col("sb"), F.col("ha") * (F.col("ha") - 1) / 2).otherwise(F.col("ha") * F.col("hb"))
    o = hh.groupBy(*keys).agg(F.sum(met / (F.col("sa") + F.col("sb") - 1)).alias("js"))
    again = pr.join(x.where("c > 1").drop("c"), [*keys, "a", "z"], "left_semi")
    two = again.withColumnsRenamed({"edge": "ea", "size": "sa"}).join(again.withColumnsRenamed({"edge": "eb", "size": "sb"}), [*keys, "a", "z"]).where("ea < eb").groupBy(*keys, "ea", "eb", "sa", "sb").agg(F.count(F.lit(1)).alias("p"))
    c, both = F.round((1 + F.sqrt(1 + 8 * F.col("p"))) / 2), F.col("sa") + F.col("sb")
    more = two.groupBy(*keys).agg(F.sum(c / (both - c) - c / (both - 1)).alias("more"))

    def link(a: DataFrame, c: DataFrame) -> DataFrame:
        return a.join(c, keys, "left") if keys else a.crossJoin(F.broadcast(c))

    return _null_ratios(link(link(link(link(base, rep), pairs), o), more), keys)


def _null_ratios(t: DataFrame, keys: list[str]) -> DataFrame:
    """The statistics from their sums (keys..., n, m, cells, repeated_edges, pairs, repeated_pairs, js, more)."""
    n, e = F.col("n"), F.col("m")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return t.select(*keys, (F.col("cells") / (n * e)).alias("density"), (F.col("cells") / e).alias("avg_size"), ((F.coalesce("js", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))) / (e * (e - 1) / 2)).alias("avg_jaccard"), (zero("pairs") / (n * (n - 1) / 2)).alias("participation"), zero("repeated_edges").alias("repeated_edges"), zero("repeated_pairs").alias("repeated_pairs"))


def configuration_draws(m: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(replicate, node, edge): stubs of nodes dealt anew to edges, degrees and sizes kept before
    repeated members of an edge collapse."""
    b = cut(m.select("node", "edge"))
    rows = lambda c: F.count(F.lit(1)).alias(c)
    stubs = numbered(b.join(b.groupBy("node").agg(rows("s")), "node"), "s", "node", "edge").select((F.col("rank") - 1).alias("j"), "node")
    places = numbered(b.join(b.groupBy("edge").agg(rows("s")), "edge"), "s", "edge", "node").select((F.col("rank") - 1).alias("i"), "edge")
    out = stubs.mapInArrow(dealt(b.count(), n, seed), f"replicate int, node {dict(b.dtypes)['node']}, i long")
    return out.join(places, "i").select("replicate", "node", "edge").distinct()


def null_test(m: DataFrame, n: int = 99, seed: int = 1) -> DataFrame:
    """(statistic, observed, null_mean, null_sd, z, p_value) against configuration draws."""
    names = ["density", "avg_size", "avg_jaccard", "participation", "repeated_edges", "repeated_pairs"]
    tall = lambda df, *k: df.select(*k, F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("v")) for s in names])).alias("x")).select(*k, "x.*")
    sums, nodes, edges = observed_sums(m)
    obs = tall(_null_ratios(sums, [])).withColumnRenamed("v", "observed")
    nul = tall(_null_ratios(cut(draw_sums(m.sparkSession, nodes, edges, n, seed)), ["replicate"]), "replicate")
    j = nul.join(F.broadcast(obs), "statistic").groupBy("statistic", "observed").agg(F.avg("v").alias("null_mean"), F.stddev_samp("v").alias("null_sd"), F.sum((F.col("v") >= F.col("observed")).cast("int")).alias("ge"), F.sum((F.col("v") <= F.col("observed")).cast("int")).alias("le"))
    p = F.least(F.lit(1.0), 2 * (1 + F.least("ge", "le")) / F.lit(n + 1))
    return j.select("statistic", "observed", "null_mean", "null_sd", ((F.col("observed") - F.col("null_mean")) / F.nullif("null_sd", F.lit(0.0))).alias("z"), p.alias("p_value"))


