"""Simplicial complexes: simplices (dimension, members sorted array, filtration) and their homology."""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyad.errors import DenseTooLarge
from polyad.plans.session import cut

MAX_SIMPLICES = 50_000


def close(sets: DataFrame, max_dim: int = 10) -> DataFrame:
    """(members, dimension, count): member sets (members, count) of any size closed under subsets
    of at most ``max_dim`` + 1 members; a face takes the largest count of the sets it lies in."""
    s = sets.select(F.array_sort(F.array_distinct("members")).alias("m"), "count").where("size(m) > 0")
    layer = s.select("m", "count", F.posexplode("m").alias("i", "x")).select("m", "count", "i", F.array("x").alias("members"))
    out = layer.select("members", "count")
    for _ in range(max_dim):  # faces grow by a later member, as far as the sets go
        layer = layer.where(F.col("i") < F.size("m") - 1).select("m", "count", "members", F.explode(F.sequence(F.col("i") + 1, F.size("m") - 1)).alias("i"))
        layer = layer.select("m", "count", "i", F.concat("members", F.array(F.element_at("m", F.col("i") + 1))).alias("members"))
        out = out.unionByName(layer.select("members", "count"))
    return out.groupBy("members").agg(F.max("count").alias("count")).withColumn("dimension", F.size("members") - 1)


def cliques(edges: DataFrame, max_dim: int | None = 3, ascending: bool = False, vertices: DataFrame | None = None) -> DataFrame:
    """(members, dimension, filtration): all cliques of (a, b, weight), a < b, up to ``max_dim``, or with
    None until there are no larger ones. The
    filtration of a simplex is its least weight, or with ``ascending`` (distances) its largest; that of
    a vertex is its strongest edge, or 0."""
    e = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("weight").cast("double").alias("w")).where("a < b")
    worst = F.greatest if ascending else F.least
    layer = e.select(F.array("a", "b").alias("members"), F.col("w").alias("f"))
    layers = [layer]
    for k in count(2) if max_dim is None else range(2, max_dim + 1):
        j = layer.join(e, F.element_at("members", -1) == F.col("a")).select("members", "f", F.col("b").alias("x"))
        links = j.select("members", "f", "x", F.explode("members").alias("a")).join(e.select("a", F.col("b").alias("x"), "w"), ["a", "x"])
        g = links.groupBy("members", "x", "f").agg(F.count(F.lit(1)).alias("n"), (F.max("w") if ascending else F.min("w")).alias("w")).where(F.col("n") == k)
        layer = g.select(F.concat("members", F.array("x")).alias("members"), worst("f", "w").alias("f"))
        if max_dim is None:
            layer = cut(layer)
            if layer.isEmpty():
                break
        layers.append(layer)
    ends = e.select(F.explode(F.array("a", "b")).alias("v"), "w").groupBy("v").agg((F.lit(0.0) if ascending else F.max("w")).alias("f"))
    if vertices is not None:
        ends = vertices.select(F.col("node").cast("string").alias("v")).join(ends, "v", "left").select("v", F.coalesce("f", F.lit(0.0)).alias("f"))
    out = ends.select(F.array("v").alias("members"), "f")
    for x in layers:
        out = out.unionByName(x)
    return out.select("members", (F.size("members") - 1).alias("dimension"), F.col("f").alias("filtration"))


def f_vector(sc: DataFrame) -> DataFrame:
    return sc.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"))


def euler(sc: DataFrame) -> DataFrame:
    return sc.agg(F.sum(F.when(F.col("dimension") % 2 == 0, 1).otherwise(-1)).alias("euler"))


def degrees(sc: DataFrame) -> DataFrame:
    """(node, dimension, n): simplices of each dimension that hold a node."""
    return sc.select(F.explode("members").alias("node"), "dimension").groupBy("node", "dimension").agg(F.count(F.lit(1)).alias("n"))


def facets(sc: DataFrame) -> DataFrame:
    """(members, dimension) of simplices in no larger one."""
    sub = sc.where("dimension > 0").select(F.explode(F.transform(F.sequence(F.lit(0), F.size("members") - 1), lambda i: F.filter("members", lambda x, j: j != i))).alias("members")).distinct()
    return sc.select("members", "dimension").join(sub, "members", "left_anti")


def q_analysis(sc: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(q, n_components): facets of dimension at least q, connected where they share a face of dimension at
    least q."""
    from polyad.operators.structure import components

    f = cut(facets(sc).withColumn("id", F.array_join("members", "|")))
    top = f.agg(F.max("dimension")).first()[0]
    own = f.select("id", "dimension", F.explode("members").alias("v"))
    o = own.select(F.col("id").alias("a"), "v").join(own.select(F.col("id").alias("b"), "v"), "v").where("a < b").groupBy("a", "b").agg((F.count(F.lit(1)) - 1).alias("q"))
    o = cut(o)
    out = None
    for q in range(int(top) + 1 if top is not None else 0):
        big = f.where(F.col("dimension") >= q)
        m = big.select(F.col("id").alias("node"), F.concat(F.lit("own:"), "id").alias("edge")).unionByName(o.where(F.col("q") >= q).select(F.explode(F.array("a", "b")).alias("node"), F.concat_ws("&", "a", "b").alias("edge")))
        row = components(m.withColumn("weight", F.lit(1.0)), max_rounds).where("kind = 'node'").agg(F.count_distinct("component").alias("n_components")).select(F.lit(q).alias("q"), "n_components")
        out = row if out is None else out.unionByName(row)
    return out


def _reduce(simplices: list[tuple[float, tuple[str, ...]]], ascending: bool) -> list[tuple[int, float, float]]:
    """Persistence pairs (dimension, birth, death) by column reduction over Z/2; a death of infinity is
    essential. Simplices enter by value, faces first."""
    order = sorted(simplices, key=lambda s: ((s[0] if ascending else -s[0]), len(s[1]), s[1]))
    at = {s[1]: i for i, s in enumerate(order)}
    low: dict[int, int] = {}
    cols: dict[int, set[int]] = {}
    out, paired = [], set()
    for j, (v, s) in enumerate(order):
        col = {at[s[:i] + s[i + 1 :]] for i in range(len(s))} if len(s) > 1 else set()
        while col and max(col) in low:
            col = col ^ cols[low[max(col)]]
        if col:
            i = max(col)
            low[i], cols[j] = j, col
            paired |= {i, j}
            if order[i][0] != v:
                out.append((len(order[i][1]) - 1, order[i][0], v))
    out += [(len(s) - 1, v, float("inf")) for j, (v, s) in enumerate(order) if j not in paired]
    return sorted(out)


def homology(sc: DataFrame, ascending: bool = False) -> DataFrame:
    """(dimension, birth, death, persistence) of the filtration; on the driver within a guard."""
    rows = sc.select("members", "filtration").limit(MAX_SIMPLICES + 1).collect()
    if len(rows) > MAX_SIMPLICES:
        raise DenseTooLarge(f"more than {MAX_SIMPLICES} simplices")
    pairs = _reduce([(float(r["filtration"]), tuple(r["members"])) for r in rows], ascending)
    return sc.sparkSession.createDataFrame([(d, b, z, abs(z - b)) for d, b, z in pairs], "dimension int, birth double, death double, persistence double")


def betti(sc: DataFrame) -> DataFrame:
    """(dimension, betti): ranks over Z/2 of the whole complex; on the driver within a guard."""
    h = homology(sc.select("members", F.lit(0.0).alias("filtration")), True)
    dims = sc.select("dimension").distinct()
    return dims.join(h.where("death = double('infinity')").groupBy("dimension").agg(F.count(F.lit(1)).alias("betti")), "dimension", "left").na.fill(0, ["betti"])


def landscape(diagram: DataFrame, grid: DataFrame, k_max: int = 5) -> DataFrame:
    """(t, k, value): k-th largest of max(0, min(t - birth, death - t)) over finite pairs, on a grid (t)."""
    d = diagram.where("death <> double('infinity')")
    v = d.crossJoin(F.broadcast(grid)).select("t", F.greatest(F.lit(0.0), F.least(F.col("t") - F.least("birth", "death"), F.greatest("birth", "death") - F.col("t"))).alias("value"))
    w = Window.partitionBy("t").orderBy(F.desc("value"))
    return v.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k_max).select("t", "k", "value")


def _points(diagram: DataFrame) -> tuple[list[tuple[float, float]], list[float]]:
    rows = diagram.select("birth", "death").limit(3001).collect()
    if len(rows) > 3000:
        raise DenseTooLarge("more than 3000 points in a diagram")
    return [(r[0], r[1]) for r in rows if np.isfinite(r[1])], sorted(r[0] for r in rows if not np.isfinite(r[1]))


def assign(cost: np.ndarray) -> list[int]:
    """Columns of a minimal assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v, way_of = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        way_of[0], j0 = i, 0
        dist, prev, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = way_of[j0]
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[i0 - 1, free - 1] - u[i0] - v[free]
            closer = slack < dist[free]
            dist[free[closer]], prev[free[closer]] = slack[closer], j0
            j1 = free[np.argmin(dist[free])]
            delta = dist[j1]
            u[way_of[used]] += delta
            v[used] -= delta
            dist[~used] -= delta
            j0 = j1
            if way_of[j0] == 0:
                break
        while j0:
            way_of[j0] = way_of[prev[j0]]
            j0 = prev[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[way_of[j] - 1] = j - 1
    return out


def wasserstein(a: DataFrame, b: DataFrame, order: float = 1.0, internal: float = np.inf) -> float:
    """Distance of two diagrams with matching to the diagonal; essential classes are matched in order of
    birth and give infinity where their numbers differ."""
    (pa, ea), (pb, eb) = _points(a), _points(b)
    if len(ea) != len(eb):
        return float("inf")
    d = lambda p, q: float(np.linalg.norm([p[0] - q[0], p[1] - q[1]], internal))
    diag = lambda p: ((p[0] + p[1]) / 2,) * 2
    n, m = len(pa), len(pb)
    c = np.zeros((n + m, n + m))
    for i, p in enumerate(pa):
        c[i, :m] = [d(p, q) ** order for q in pb]
        c[i, m:] = d(p, diag(p)) ** order
    for j, q in enumerate(pb):
        c[n:, j] = d(q, diag(q)) ** order
    total = sum(c[i, j] for i, j in enumerate(assign(c))) if n + m else 0.0
    total += sum(abs(x - y) ** order for x, y in zip(ea, eb, strict=True))
    return float(total ** (1 / order))


def bottleneck(a: DataFrame, b: DataFrame) -> float:
    """Least r at which a matching moves no point by more than r in the maximum norm."""
    (pa, ea), (pb, eb) = _points(a), _points(b)
    if len(ea) != len(eb):
        return float("inf")
    n, m = len(pa), len(pb)
    half = lambda p: abs(p[1] - p[0]) / 2
    c = np.zeros((n + m, n + m))
    for i, p in enumerate(pa):
        c[i, :m] = [max(abs(p[0] - q[0]), abs(p[1] - q[1])) for q in pb]
        c[i, m:] = half(p)
    for j, q in enumerate(pb):
        c[n:, j] = half(q)

    def fits(r: float) -> bool:
        match: dict[int, int] = {}

        def grow(i: int, seen: set[int]) -> bool:
            for j in np.flatnonzero(c[i] <= r + 1e-12).tolist():
                if j not in seen:
                    seen.add(j)
                    if j not in match or grow(match[j], seen):
                        match[j] = i
                        return True
            return False

        return all(grow(i, set()) for i in range(n + m))

    values = sorted({0.0, *c.ravel().tolist()})
    lo, hi = 0, len(values) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(values[mid]) else (mid + 1, hi)
    return max([values[lo], *(abs(x - y) for x, y in zip(ea, eb, strict=True))])

