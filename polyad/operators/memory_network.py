"""Memory networks as graphs: centrality, embeddings, path anomalies and the map equation.

A network is the table ``sequences.memory_network`` gives: (path, source, destination, count,
probability, from_order, to_order); a node's label lists its states, " -> " between them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.errors import BadInput, DenseTooLarge, NotErgodic
from polyad.functions.stats import hypergeometric_tails, p_adjust
from polyad.operators.communities import louvain
from polyad.operators.sequences import kgrams, rule_label
from polyad.operators.paths import betweenness, shortest_paths
from polyad.plans.session import cut

MAX_NODES = 3000


def _graph(net: DataFrame) -> tuple[list[str], np.ndarray]:
    """Node labels in code point order and the weights between them, on the driver within a guard."""
    rows = net.groupBy("source", "destination").agg(F.sum("count").alias("w")).limit(MAX_NODES * 100 + 1).collect()
    nodes = sorted({r["source"] for r in rows} | {r["destination"] for r in rows})
    if len(nodes) > MAX_NODES or len(rows) > MAX_NODES * 100:
        raise DenseTooLarge(f"more than {MAX_NODES} nodes")
    at = {n: i for i, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for r in rows:
        w[at[r["source"]], at[r["destination"]]] = r["w"]
    return nodes, w


def project(values: DataFrame, projection: str = "scaled") -> DataFrame:
    """(state, value) of (node, value): every state of a node gets an equal share (scaled), or the whole
    value goes to its last, its first or all its states."""
    p = F.split("node", " -> ")
    pick = {"scaled": p, "all": p, "last": F.array(F.element_at(p, -1)), "first": F.array(p[0])}
    if projection not in pick:
        raise BadInput("projection is scaled, last, first or all")
    v = F.col("value") / F.size(p) if projection == "scaled" else F.col("value")
    return values.select(F.explode(pick[projection]).alias("state"), v.alias("value")).groupBy("state").agg(F.sum("value").alias("value"))


def network_pagerank(net: DataFrame, damping: float = 0.85, rounds: int = 50, weighted: bool = False) -> DataFrame:
    """(node, value): PageRank over the network's links, each of weight 1 unless ``weighted``; nodes without
    a way out restart anywhere."""
    e = net.groupBy("source", "destination").agg((F.sum("count") if weighted else F.lit(1.0)).alias("w"))
    out = e.groupBy("source").agg(F.sum("w").alias("s"))
    e = cut(e.join(out, "source").select("source", "destination", (F.col("w") / F.col("s")).alias("p")))
    nodes = cut(e.select(F.explode(F.array("source", "destination")).alias("node")).distinct().join(out.select(F.col("source").alias("node"), F.lit(True).alias("leads")), "node", "left"))
    n = nodes.count()
    r = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("r"))
    for _ in range(rounds):
        lost = nodes.where("leads is null").join(r, "node").agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
        y = e.join(r, e["source"] == r["node"]).groupBy(F.col("destination").alias("node")).agg(F.sum(F.col("r") * F.col("p")).alias("y"))
        new = cut(nodes.select("node").join(y, "node", "left").select("node", (F.lit((1 - damping + damping * lost) / n) + F.lit(damping) * F.coalesce("y", F.lit(0.0))).alias("r")))
        moved = new.join(r.withColumnRenamed("r", "o"), "node").agg(F.sum(F.abs(F.col("r") - F.col("o")))).first()[0]
        r = new
        if moved < 1e-10:
            break
    return r.select("node", F.col("r").alias("value"))


def network_distances(net: DataFrame) -> DataFrame:
    """(a, b, d): least first-order distance between states: hops from a node that starts with the first
    to a node that ends in the second, plus the order of the start less one. Breadth first from
    all nodes at once, on tables."""
    links = net.select(F.col("source").alias("a"), F.col("destination").alias("b"))
    nodes = cut(links.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    p = shortest_paths(links, nodes)
    names = lambda c: F.split(c, " -> ")
    d = p.select(names(F.col("s"))[0].alias("a"), F.element_at(names(F.col("v")), -1).alias("b"), (F.col("d") + F.size(names(F.col("s"))) - 1).alias("d"))
    return d.where("a <> b").groupBy("a", "b").agg(F.min("d").alias("d"))


def network_closeness(net: DataFrame) -> DataFrame:
    """(state, value): harmonic closeness over incoming first-order distances."""
    d = cut(network_distances(net))
    into = d.groupBy(F.col("b").alias("state")).agg(F.sum(1 / F.col("d")).alias("value"))
    return into.unionByName(d.select(F.col("a").alias("state"), F.lit(0.0).alias("value")).distinct()).groupBy("state").agg(F.sum("value").alias("value"))


def network_betweenness(net: DataFrame, projection: str = "scaled") -> DataFrame:
    """(state, value): directed betweenness of the network's nodes, unscaled, projected to states."""
    links = net.select(F.col("source").alias("a"), F.col("destination").alias("b"))
    nodes = cut(links.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    return project(betweenness(links, nodes, directed=True, normalised=False), projection)


def network_embedding(net: DataFrame, dim: int = 8, max_power: int = 10) -> DataFrame:
    """(node, coordinates, variance): truncated singular vectors of the sum of powers of the transition
    matrix with weights exp(-k); the largest entry of each vector is positive."""
    nodes, w = _graph(net)
    if not 1 <= dim <= max(1, len(nodes) - 1):
        raise BadInput("dim is between 1 and the number of nodes less one")
    s = w.sum(1, keepdims=True)
    p = np.divide(w, s, out=np.zeros_like(w), where=s > 0)
    acc, power = np.zeros_like(p), np.eye(len(p))
    for k in range(1, max_power + 1):
        power = power @ p
        acc += math.exp(-k) * power
    u, val, _ = np.linalg.svd(acc)
    u = u[:, :dim] * np.sign(u[np.abs(u[:, :dim]).argmax(0), range(dim)])
    share = float((val[:dim] ** 2).sum() / (val**2).sum()) if val.any() else 0.0
    x = u * np.sqrt(val[:dim])
    return net.sparkSession.createDataFrame([(n, [float(v) for v in row], share) for n, row in zip(nodes, x, strict=True)], "node string, coordinates array<double>, variance double")


def path_anomaly(seqs: DataFrame, order: int = 2, min_count: int = 5, alpha: float = 0.05, rounds: int = 10) -> DataFrame:
    """(path, observed, expected, ratio, p_over, p_under, p_over_adj, p_under_adj, anomaly): paths walked more
    or less often than the strengths of their two halves let expect. The urn holds one ball per way to
    draw an allowed transition; its propensities start as out-strength times in-strength and are scaled
    to the observed strengths in ``rounds`` grouped sums."""
    g = kgrams(seqs, order).where(F.col("order") == order).select(F.col("context").alias("u"), F.concat(F.slice("context", 2, order), F.array("target")).alias("v"), F.col("count").alias("f"))
    g = cut(g)
    so, si = g.groupBy("u").agg(F.sum("f").alias("so")), g.groupBy("v").agg(F.sum("f").alias("si"))
    key = lambda c, a: F.array_join(F.slice(c, a, order - 1), "|") if order > 1 else F.lit("")
    allowed = so.withColumn("k", key("u", 2)).join(si.withColumn("k", key("v", 1)), "k").drop("k")
    m = g.agg(F.sum("f")).first()[0] or 0
    x = cut(allowed.withColumn("xi", F.col("so").cast("double") * F.col("si")))
    for _ in range(rounds):
        r = x.groupBy("u").agg(F.sum("xi").alias("t"))
        x = x.join(r, "u").withColumn("xi", F.col("xi") * F.col("so") * F.lit(float(m)) / F.col("t")).drop("t")
        c = x.groupBy("v").agg(F.sum("xi").alias("t"))
        x = cut(x.join(c, "v").withColumn("xi", F.col("xi") * F.col("si") * F.lit(float(m)) / F.col("t")).drop("t"))
    urn = x.agg(F.sum("xi").alias("urn"))
    j = g.where(F.col("f") >= min_count).join(x.select("u", "v", "xi"), ["u", "v"]).crossJoin(F.broadcast(urn)).withColumn("draws", F.lit(float(m)))
    j = j.withColumn("t", hypergeometric_tails("f", "xi", "urn", "draws")).withColumn("expected", F.col("draws") * F.col("xi") / F.col("urn"))
    j = j.select(rule_label(F.concat("u", F.array(F.element_at("v", -1)))).alias("path"), F.col("f").alias("observed"), "expected", (F.col("f") / F.col("expected")).alias("ratio"), F.col("t.upper").alias("p_over"), F.col("t.lower").alias("p_under"))
    j = p_adjust(p_adjust(j, "p_over", "p_over_adj"), "p_under", "p_under_adj")
    return j.withColumn("anomaly", F.when(F.col("p_over_adj") < alpha, "over").when(F.col("p_under_adj") < alpha, "under").otherwise("normal"))


def network_flow(net: DataFrame, teleportation: float = 0.15) -> DataFrame:
    """(source, destination, flow): stationary flow over links, summing to 1. The walker restarts, at the tail
    of a link drawn by weight, with probability ``teleportation`` and always where no link leaves; only
    steps over links are recorded."""
    nodes, w = _graph(net)
    out = w.sum(1)
    if out.sum() <= 0:
        raise BadInput("the network has no links")
    p = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    g = (1 - teleportation) * p + np.outer(np.where(out > 0, teleportation, 1.0), out / out.sum())
    a = g.T - np.eye(len(w))
    if np.linalg.matrix_rank(a) < len(w) - 1:
        raise NotErgodic("the walk has no unique flow; use teleportation above 0")
    a[-1] = 1
    pi = np.maximum(np.linalg.solve(a, np.append(np.zeros(len(w) - 1), 1.0)), 0)
    i, j = np.nonzero(w)
    f = pi[i] * p[i, j]
    f /= f.sum()
    return net.sparkSession.createDataFrame([(nodes[a], nodes[b], float(v)) for a, b, v in zip(i, j, f, strict=True)], "source string, destination string, flow double")


def codelength(flow: DataFrame, partition: DataFrame) -> DataFrame:
    """One row (codelength, index_length, module_length) in bits of a two-level partition (node, module) of the
    network's nodes. Codebooks are written over physical states, the last of a node's label, so nodes of
    one state share a codeword inside a module. Aggregations only."""
    plogp = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    part = partition.select("node", F.col("module").cast("string").alias("module"))
    x = flow.join(part.select(F.col("node").alias("source"), F.col("module").alias("ms")), "source").join(part.select(F.col("node").alias("destination"), F.col("module").alias("md")), "destination")
    cross = x.where("ms <> md")
    exits = cross.groupBy(F.col("ms").alias("module")).agg(F.sum("flow").alias("exit"))
    enters = cross.groupBy(F.col("md").alias("module")).agg(F.sum("flow").alias("enter"))
    own = x.groupBy(F.col("md").alias("module")).agg(F.sum("flow").alias("own"))
    phys = x.groupBy(F.col("md").alias("module"), F.element_at(F.split("destination", " -> "), -1).alias("state")).agg(F.sum("flow").alias("p")).agg(F.sum(plogp(F.col("p"))).alias("phys"))
    m = part.select("module").distinct().join(exits, "module", "left").join(enters, "module", "left").join(own, "module", "left").na.fill(0.0)
    t = m.agg(F.sum("enter").alias("e"), F.sum(plogp(F.col("enter"))).alias("pe"), F.sum(plogp(F.col("exit") + F.col("own"))).alias("pt"), F.sum(plogp(F.col("exit"))).alias("px")).crossJoin(phys)
    index, module = plogp(F.col("e")) - F.col("pe"), F.col("pt") - F.col("px") - F.col("phys")
    return t.select((index + module).alias("codelength"), index.alias("index_length"), module.alias("module_length"))


def network_communities(net: DataFrame, trials: int = 5, teleportation: float = 0.15) -> DataFrame:
    """(node, module) of the least codelength among the one-module partition and Louvain partitions of the flow
    from several seeds."""
    flow = cut(network_flow(net, teleportation))
    nodes = cut(flow.select(F.explode(F.array("source", "destination")).alias("node")).distinct())
    pairs = flow.where("source <> destination").select(F.least("source", "destination").alias("node_a"), F.greatest("source", "destination").alias("node_b"), "flow").groupBy("node_a", "node_b").agg(F.sum("flow").alias("weight"))
    pairs = cut(pairs)
    best, least = nodes.withColumn("module", F.lit(1)), None
    for seed in [None, *range(1, trials + 1)]:
        part = nodes.withColumn("module", F.lit(1)) if seed is None else nodes.join(louvain(pairs, seed), "node", "left").select("node", F.coalesce("label", F.lit(0)).alias("module"))
        length = codelength(flow, part).first()["codelength"]
        if least is None or length < least - 1e-12:
            best, least = part, length
    return best
