"""Factor models, resampling and propagation operators of hypergraphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyad.errors import BadInput
from polyad.operators.spectral import spectral_clusters
from polyad.plans.session import bounded, cut
from polyad.plans.together import Cells, in_step, kmeans, leading, number, rows


def cocluster(m: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(kind, name, cluster): nodes and edges together, by k-means on the scaled singular vectors of
    D_r^-1/2 B D_c^-1/2 after the first, ceil(log2 k) of them. The fewer of nodes and edges are held as
    vectors, the others stay with their memberships."""
    few = m.agg(F.count_distinct("node").alias("n"), F.count_distinct("edge").alias("e")).first()
    short, long = ("node", "edge") if few["n"] <= few["e"] else ("edge", "node")
    names, cells, n = number(m, short, long)
    d = max(1, int(np.ceil(np.log2(k))))

    def fit(group, batches):
        import pyarrow as pa

        own = Cells(batches, names=True)
        root = np.sqrt(group.total(sum((np.bincount(i, w, n) for _, i, w, *_ in own.blocks()), np.zeros(n))))
        val, u = leading(group, lambda x: group.total(own.there_and_back(x / root, weighted=True)) / root, n, min(d + 1, n), seed)
        u, s = u[1:] / root, np.sqrt(np.maximum(val[1:], 1e-300))
        v = np.zeros((len(own.starts), len(u)))
        for at, i, w, first, _ in own.blocks():
            c = np.add.reduceat(w, first)
            v[at] = np.stack([np.add.reduceat(row[i] * w, first) / c for row in u], 1) / s if len(u) else 0.0
        here = np.arange(n if group.rank == (0 if short == "node" else group.size - 1) else 0)  # nodes come before edges
        x = np.vstack([u.T[here], v] if short == "node" else [v, u.T[here]])
        lab = kmeans(group, x, k, 25, seed)
        of_short, of_long = (lab[: len(here)], lab[len(here) :]) if short == "node" else (lab[len(v) :], lab[: len(v)])
        if len(here):
            yield from rows(i=here, name=pa.nulls(len(here), pa.string()), cluster=of_short)
        if len(v):
            yield from rows(i=pa.nulls(len(v), pa.int64()), name=pa.chunked_array(own.names).combine_chunks(), cluster=of_long)

    got = in_step(cells, fit, "i long, name string, cluster long")
    cluster = F.col("cluster").cast("int").alias("cluster")
    a = got.where("i is not null").select("i", "cluster").join(bounded(names), "i").select(F.lit(short).alias("kind"), F.col("node").alias("name"), cluster)
    return a.unionByName(got.where("i is null").select(F.lit(long).alias("kind"), "name", cluster))


def symmetric_nmf(m: DataFrame, k: int, starts: int = 5, rounds: int = 300, seed: int = 1) -> DataFrame:
    """(node, cluster, membership): S ~ H H' with H >= 0 by damped multiplicative updates, best of several
    starts; the cluster is the largest entry and the membership its share. S is applied by passes over
    the memberships and never formed."""
    names, cells, n = number(m)

    def fit(group, batches):
        own = Cells(batches)
        root = np.sqrt(group.total(sum((np.bincount(i, minlength=n) for _, i, *_ in own.blocks()), np.zeros(n))))
        times = lambda x: group.total(own.there_and_back(x / root)) / root
        mean = times(np.ones((1, n))).sum() / n**2
        h = np.hstack([np.random.default_rng(seed + t).random((n, k)) * 2 * np.sqrt(mean / k) for t in range(starts)]).T
        parts = [slice(t * k, (t + 1) * k) for t in range(starts)]
        for _ in range(rounds):  # the starts side by side
            sh = times(h)
            h = np.vstack([h[p] * (0.5 + 0.5 * sh[p] / np.maximum((h[p] @ h[p].T) @ h[p], 1e-12)) for p in parts])
        sh = times(h)
        costs = [((h[p] @ h[p].T) ** 2).sum() - 2 * (sh[p] * h[p]).sum() for p in parts]  # less the square of S
        mine = group.own(n)
        best = h[parts[int(group.each(costs)[0].argmin())], mine].T
        share = best / np.maximum(best.sum(1, keepdims=True), 1e-12)
        yield from rows(i=np.arange(mine.start, mine.stop), cluster=share.argmax(1) + 1, membership=share.max(1))

    got = in_step(cells, fit, "i long, cluster long, membership double")
    return names.join(bounded(got), "i").select("node", F.col("cluster").cast("int").alias("cluster"), "membership")


def block_model(m: DataFrame, k: int, starts: int = 3, rounds: int = 100, seed: int = 1) -> DataFrame:
    """(node, community, membership): Poisson mixed memberships, assortative: an edge's rate is the sum over
    communities of w_c (s_c^2 - sum u_ic^2) / 2 with s_c the members' sum. Expectation maximisation by
    passes over the memberships, the likeliest of several starts."""
    names, cells, n = number(m.select("node", "edge", F.lit(1.0).alias("weight")).distinct())

    def fit(group, batches):
        own, best, kept = Cells(batches), -np.inf, None

        def pairs(u):
            """By block: where its edges start, their cells, nodes, sums, and pairs of each community."""
            for _, i, _, s, size in own.blocks():
                x = u[:, i]
                sums = np.add.reduceat(x, s, axis=1)
                yield i, x, size, sums, np.maximum((sums**2 - np.add.reduceat(x**2, s, axis=1)) / 2, 0)

        for t in range(starts):
            rng = np.random.default_rng(seed + t)
            u, w = rng.random((n, k)).T + 0.1, rng.random(k) + 0.1
            for _ in range(rounds):
                num, got = np.zeros((k, n)), np.zeros(k)
                for i, x, size, sums, pair in pairs(u):
                    lam = np.maximum(w @ pair, 1e-12)
                    got += (pair / lam).sum(1)
                    each = np.repeat(1 / lam, size)
                    for c in range(k):
                        num[c] += np.bincount(i, (np.repeat(sums[c], size) - x[c]) * each, n)
                both = group.total(np.append(num.ravel(), got))
                num, got = both[:-k].reshape(k, n), both[-k:]
                tot, sq = u.sum(1), (u**2).sum(1)
                was, w = w, w * got / np.maximum((tot**2 - sq) / 2, 1e-12)
                # the root, as rates are of second degree in u, and the former w in what num explains: the likelihood never falls
                u = u * np.sqrt(num * was[:, None] / np.maximum(w[:, None] * (tot[:, None] - u), 1e-12))
            ll = sum(float(np.log(np.maximum(w @ pair, 1e-12)).sum()) for *_, pair in pairs(u))
            ll = group.total([ll])[0] - ((u.sum(1) ** 2 - (u**2).sum(1)) / 2 * w).sum()
            if group.agree(kept is None or ll >= best):
                best, kept = ll, u
        mine = group.own(n)
        share = kept[:, mine].T
        share = share / np.maximum(share.sum(1, keepdims=True), 1e-12)
        yield from rows(i=np.repeat(np.arange(mine.start, mine.stop), k), community=np.tile(np.arange(1, k + 1), len(share)), membership=share.ravel())

    got = in_step(cells, fit, "i long, community long, membership double")
    return got.join(bounded(names), "i").select("node", F.col("community").cast("int").alias("community"), "membership")


def cluster_stability(m: DataFrame, k: int, n_boot: int = 5, fraction: float = 0.5, seed: int = 1) -> DataFrame:
    """(cluster, mean_jaccard, dissolved, recovered): clusters of node subsamples against those of all nodes;
    dissolved at 0.5 or less, recovered above 0.75."""
    full = cut(spectral_clusters(m, k, seed=seed))
    rows = None
    for r in range(n_boot):
        part = m.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "node"), F.lit(1000)) < int(fraction * 1000))
        sub = spectral_clusters(part, k, seed=seed).select("node", F.col("cluster").alias("other"))
        j = full.join(sub, "node")
        inter = j.groupBy("cluster", "other").agg(F.count(F.lit(1)).alias("n"))
        u = inter.withColumns({"a": F.sum("n").over(Window.partitionBy("cluster")), "b": F.sum("n").over(Window.partitionBy("other"))})
        one = u.groupBy("cluster").agg(F.max(F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).alias("jaccard"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("cluster").agg(F.avg("jaccard").alias("mean_jaccard"), F.sum((F.col("jaccard") <= 0.5).cast("int")).alias("dissolved"), F.sum((F.col("jaccard") > 0.75).cast("int")).alias("recovered"))


def propagation(m: DataFrame, alpha: float = 0.0, beta: float = 0.0) -> DataFrame:
    """(node, edge, node_to_edge, edge_to_node): row-normalised propagation weights; ``beta`` weighs nodes by
    degree on the way to edges, ``alpha`` edges by size on the way back."""
    d = m.groupBy("node").agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(beta)).alias("dv"))
    s = m.groupBy("edge").agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(alpha)).alias("de"))
    x = m.select("node", "edge").join(d, "node").join(s, "edge")
    return x.select("node", "edge", (F.col("dv") / F.sum("dv").over(Window.partitionBy("edge"))).alias("node_to_edge"), (F.col("de") / F.sum("de").over(Window.partitionBy("node"))).alias("edge_to_node"))


def mediated_graph(m: DataFrame, features: DataFrame, mediators: bool = True) -> DataFrame:
    """(node_a, node_b, weight): each edge as its two members farthest apart in (node, coordinates), ties by
    name, and, with ``mediators``, every other member joined to both; weights 1 / (2 n - 3), or 1."""
    x = m.select("node", "edge").join(features.select("node", "coordinates"), "node")
    a, b = x.select("edge", F.col("node").alias("a"), F.col("coordinates").alias("ca")), x.select("edge", F.col("node").alias("b"), F.col("coordinates").alias("cb"))
    far = a.join(b, "edge").where("a < b").withColumn("d", F.round(F.aggregate(F.zip_with("ca", "cb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v), 9))
    w = Window.partitionBy("edge").orderBy(F.desc("d"), "a", "b")
    ends = far.withColumn("r", F.row_number().over(w)).where("r = 1").select("edge", "a", "b")
    if not mediators:
        return ends.groupBy(F.col("a").alias("node_a"), F.col("b").alias("node_b")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    n = m.groupBy("edge").agg(F.count(F.lit(1)).alias("n"))
    rest = ends.join(m.select("edge", "node"), "edge").where("node <> a and node <> b")
    links = ends.select("edge", "a", "b").unionByName(rest.select("edge", F.col("a"), F.col("node").alias("b"))).unionByName(rest.select("edge", F.col("b").alias("a"), F.col("node").alias("b")))
    links = links.join(n, "edge").select(F.least("a", "b").alias("node_a"), F.greatest("a", "b").alias("node_b"), (F.lit(1.0) / (2 * F.col("n") - 3)).alias("v"))
    return links.groupBy("node_a", "node_b").agg(F.sum("v").alias("weight"))


def read(table: DataFrame, sort_by: str | None = None, top: int | None = None, ties: list[str] | None = None, **filters) -> DataFrame:
    """Rows of a result where columns equal the given values, then by ``sort_by`` descending (ties by the
    named columns), then the first ``top``."""
    for c, v in filters.items():
        if c not in table.columns:
            raise BadInput(f"no column {c}")
        table = table.where(F.col(c).isin(v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    if sort_by:
        table = table.orderBy(F.desc(sort_by), *(ties or [c for c in table.columns if c != sort_by]))
    return table if top is None else table.limit(top)
