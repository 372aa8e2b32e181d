"""Hypergraphs as long tables, and their constructors.

A hypergraph is a table of memberships (node STRING, edge STRING, weight DOUBLE), unique on
(node, edge); edge and node attributes are tables of their own. No matrix is ever formed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyad.errors import BadInput, NonpositiveSimilarity
from polyad.plans.rank import numbered
from polyad.plans.session import need


@dataclass(frozen=True)
class Hypergraph:
    """``memberships`` (node, edge, weight), ``edges`` (edge, edge_weight or null, ...) and ``nodes``
    (node, ...); the last two may hold members that no membership has."""

    memberships: DataFrame
    edges: DataFrame | None = None
    nodes: DataFrame | None = None

    def all_nodes(self) -> DataFrame:
        own = self.memberships.select("node").distinct()
        return own if self.nodes is None else own.unionByName(self.nodes.select("node")).distinct()


def groups(log: DataFrame, actor: str, group: str, weight: str | None = None) -> DataFrame:
    """Memberships of a co-presence log. Rows with a null are dropped; without a weight repeated
    rows count once, with one they add up and edges without a positive cell are dropped."""
    need(log, actor, group, *([weight] if weight else []))
    rows = log.select(F.col(actor).cast("string").alias("node"), F.col(group).cast("string").alias("edge"), *([F.col(weight).cast("double").alias("weight")] if weight else [])).dropna()
    if not weight:
        return rows.groupBy("node", "edge").agg(F.lit(1.0).alias("weight"))
    cells = rows.groupBy("node", "edge").agg(F.sum("weight").alias("weight"))
    return cells.withColumn("_m", F.max("weight").over(Window.partitionBy("edge"))).where("_m > 0 and weight <> 0").drop("_m")


def edge_list(pairs: DataFrame, source: str, target: str, weight: str | None = None) -> DataFrame:
    """Each row as an edge of two members e1..en in the order of (source, target); a loop has one."""
    rows = pairs.select(F.col(source).cast("string").alias("a"), F.col(target).cast("string").alias("b"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight")).dropna()
    named = numbered(rows, "a", "b", "weight", name="k").withColumn("edge", F.concat(F.lit("e"), F.col("k")))
    return named.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("node"), "edge", "weight")


def delimited(log: DataFrame, members: str, group: str, separator: str = ";") -> DataFrame:
    """Memberships of a column that lists members; names are trimmed, empty ones dropped."""
    need(log, members, group)
    parts = F.transform(F.split(F.col(members), "\\Q" + separator + "\\E"), lambda x: F.trim(x))
    rows = log.select(F.explode(parts).alias("node"), F.col(group).cast("string").alias("edge")).where("node <> '' and edge is not null")
    return rows.groupBy("node", "edge").agg(F.lit(1.0).alias("weight"))


def constant_attributes(log: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(edge, columns...): the columns whose non-null values agree within every group; the others
    come out null in groups where they differ."""
    need(log, group, *columns)
    g = log.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("edge"))
    return g.agg(*[F.when(F.min(c) == F.max(c), F.max(c)).alias(c) for c in columns])


def windows(seqs: DataFrame, width: int = 3, step: int = 1, min_weight: int = 1, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """(memberships, edges) of the state sets in full windows of sequences. Equal sets are one edge
    whose ``edge_weight`` is the number of windows; a cell is how often the state occurs in them.
    Null states stand in a window but are no member; windows of nulls only give nothing."""
    if width < 1 or step < 1:
        raise BadInput("width and step are positive")
    w = Window.partitionBy("seq_id").orderBy("pos")
    led = seqs.select("seq_id", F.row_number().over(w).alias("n"), F.array(F.col("state"), *[F.lead("state", i).over(w) for i in range(1, width)]).alias("win"), F.lead("pos", width - 1).over(w).isNotNull().alias("whole") if width > 1 else F.lit(True).alias("whole"))
    full = led.where(F.col("whole") & ((F.col("n") - 1) % step == 0)).select(F.filter("win", lambda x: x.isNotNull()).alias("win")).where("size(win) > 0")
    sets = full.groupBy(F.array_sort("win").alias("win")).agg(F.count(F.lit(1)).alias("c"))
    sets = sets.withColumn("key", F.array_join(F.array_distinct("win"), " | "))
    edges = sets.groupBy("key").agg(F.sum("c").alias("edge_weight"), F.max(F.size(F.array_distinct("win"))).alias("size")).where((F.col("edge_weight") >= min_weight) & (F.col("size") >= min_size))
    cells = sets.select("key", F.explode("win").alias("node"), "c").groupBy("node", "key").agg(F.sum("c").cast("double").alias("weight"))
    m = cells.join(edges.select("key"), "key", "left_semi")
    return m.select("node", F.col("key").alias("edge"), "weight"), edges.select(F.col("key").alias("edge"), F.col("edge_weight").cast("double").alias("edge_weight"), "size")


def dual(m: DataFrame) -> DataFrame:
    return m.select(F.col("edge").alias("node"), F.col("node").alias("edge"), "weight")


def subset(m: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """Edges entirely inside ``nodes`` (node), among ``edges`` (edge), of a size in range."""
    out = m
    if nodes is not None:
        outside = m.join(nodes.select("node").distinct(), "node", "left_anti").select("edge").distinct()
        out = out.join(outside, "edge", "left_anti")
    if edges is not None:
        out = out.join(edges.select("edge").distinct(), "edge", "left_semi")
    if min_size is not None or max_size is not None:
        size = m.groupBy("edge").agg(F.count(F.lit(1)).alias("_s")).where(F.col("_s").between(min_size or 0, max_size or 2**31 - 1))
        out = out.join(size.select("edge"), "edge", "left_semi")
    return out.select("node", "edge", "weight")


def set_keys(m: DataFrame) -> DataFrame:
    """(edge, members array, size): the sorted members of each edge."""
    return m.groupBy("edge").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("size"))


def collapse_duplicates(m: DataFrame) -> DataFrame:
    """(edge, members, size, multiplicity): edges with equal member sets as one, the least name."""
    return set_keys(m).groupBy("members", "size").agg(F.min("edge").alias("edge"), F.count(F.lit(1)).alias("multiplicity")).select("edge", "members", "size", "multiplicity")


def network_cliques(edges: DataFrame, max_size: int = 3, threshold: float = 0.0, include_pairs: bool = True, p: float = 1.0, seed: int = 1) -> DataFrame:
    """(edge, members, size): cliques of 3..max_size nodes of the graph (source, target, weight) with
    weights above ``threshold``, each kept with probability ``p`` by a seeded hash, and its pairs."""
    e = edges.where((F.col("weight") > threshold) & (F.col("source") != F.col("target")))
    e = e.select(F.least("source", "target").cast("string").alias("a"), F.greatest("source", "target").cast("string").alias("b")).distinct()
    pairs = e.select(F.array("a", "b").alias("members"))
    layers, layer = [], pairs
    for _ in range(3, max_size + 1):
        j = layer.join(e, F.element_at("members", -1) == F.col("a")).select("members", F.col("b").alias("x"))
        need_all = j.select("members", "x", F.posexplode("members").alias("p", "a")).join(e.select("a", F.col("b").alias("x")), ["a", "x"], "left_semi")
        layer = need_all.groupBy("members", "x").agg(F.count(F.lit(1)).alias("n")).where("n = size(members)").select(F.concat("members", F.array("x")).alias("members"))
        layers.append(layer if p >= 1 else layer.where(F.pmod(F.xxhash64(F.lit(seed), F.array_join("members", "|")), F.lit(1 << 20)) < p * (1 << 20)))
    out = pairs if include_pairs else pairs.limit(0)
    for x in layers:
        out = out.unionByName(x)
    return out.select(F.array_join("members", "|").alias("edge"), "members", F.size("members").alias("size"))


def nearest(items: DataFrame, ident: str, vector: str, k: int, weighted: bool = True, block: int = 4096) -> DataFrame:
    """Memberships of the neighbour hypergraph: one edge per item, with itself (1) and its ``k`` most
    similar items by cosine (their cosine), ties by id. Exact: every item meets every block of items
    once and only the best ``k`` of a block leave it. Zero or null vectors are refused."""
    need(items, ident, vector)
    v = items.select(F.col(ident).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = v.where("v is null or not exists(v, x -> x <> 0)").limit(1).count()
    if bad:
        raise BadInput("a zero or null vector has no direction")
    n = v.count()
    blocks = max(1, -(-n // block))
    side = v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    ask = side.select("id", "v", F.col("b").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("db"), F.lit(True).alias("ask"))
    data = side.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"), F.col("b").alias("db"), F.lit(False).alias("ask"))

    def top(pdf):
        import pandas as pd

        q, d = pdf[pdf["ask"]], pdf[~pdf["ask"]].sort_values("id")
        if not len(q) or not len(d):
            return pd.DataFrame({"id": [], "x": [], "s": []})
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        a, b = unit(np.stack(q["v"].to_numpy())), unit(np.stack(d["v"].to_numpy()))
        ids, qi, out = d["id"].to_numpy(), q["id"].to_numpy(), []
        at = {x: i for i, x in enumerate(ids)}
        for i in range(0, len(a), 512):
            s = np.round(a[i : i + 512] @ b.T, 12)
            for r in range(len(s)):
                if (j := at.get(qi[i + r])) is not None:
                    s[r, j] = -np.inf
            o = np.argsort(-s, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"id": np.repeat(qi[i : i + 512], o.shape[1]), "x": ids[o].ravel(), "s": np.take_along_axis(s, o, 1).ravel()}))
        r = pd.concat(out)
        return r[np.isfinite(r["s"])]

    best = ask.unionByName(data).groupBy("qb", "db").applyInPandas(top, "id string, x string, s double")
    w = Window.partitionBy("id").orderBy(F.desc("s"), "x")
    picked = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    if weighted:
        if picked.where("s <= 0").limit(1).count():
            raise NonpositiveSimilarity("a selected neighbour has no positive similarity")
    rows = picked.select(F.col("x").alias("node"), F.col("id").alias("edge"), (F.col("s") if weighted else F.lit(1.0)).alias("weight"))
    return rows.unionByName(v.select(F.col("id").alias("node"), F.col("id").alias("edge"), F.lit(1.0).alias("weight")))


def sample_gnp(spark, n: int, m: int, p: float, seed: int = 1) -> DataFrame:
    """Random memberships: every node in every edge with probability ``p``."""
    rows = spark.range(n * m).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("j"))
    hit = F.pmod(F.xxhash64(F.lit(seed), "i", "j"), F.lit(1 << 30)) < p * (1 << 30)
    return rows.where(hit).select(F.concat(F.lit("v"), "i").alias("node"), F.concat(F.lit("h"), "j").alias("edge"), F.lit(1.0).alias("weight"))


def sample_uniform(spark, n: int, m: int, size: int, seed: int = 1, regular: bool = False) -> DataFrame:
    """``m`` edges of ``size`` distinct random nodes; with ``regular``, ``size`` edges per node."""
    inner, outer = (m, n) if regular else (n, m)
    rows = spark.range(inner * outer).select((F.col("id") % inner).alias("x"), F.floor(F.col("id") / inner).alias("y"))
    w = Window.partitionBy("y").orderBy(F.xxhash64(F.lit(seed), "y", "x"), "x")
    kept = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size)
    node, edge = ("y", "x") if regular else ("x", "y")
    return kept.select(F.concat(F.lit("v"), node).alias("node"), F.concat(F.lit("h"), edge).alias("edge"), F.lit(1.0).alias("weight"))
