"""Walks, centralities, Laplacians, label spreading and clusters on memberships (node, edge, weight).

Operators on nodes are chains of two joins through the memberships, node -> edge -> node; the node
by node matrix is never formed. Iterations return one scalar a round to the driver and cut their
lineage in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyad.errors import BadInput, DenseTooLarge, NoConverge
from polyad.operators.structure import neighbours
from polyad.plans.iterate import fixed_point
from polyad.plans.rank import with_total
from polyad.plans.session import BROADCAST_ROWS, bounded, cut
from polyad.plans.together import Cells, in_step, kmeans, leading, number, rows

MAX_DENSE = 5000
Side = Callable[[DataFrame], DataFrame]


def edge_weights(m: DataFrame, given: DataFrame | None = None, kind: str = "random_walk") -> DataFrame:
    """(edge, omega): given weights (edge, edge_weight); else 1 for zhou and for the random walk the
    population deviation of the edge's weights plus 1."""
    if given is not None:
        return given.select("edge", F.col("edge_weight").cast("double").alias("omega"))
    omega = F.lit(1.0) if kind == "zhou" else F.stddev_pop("weight") + 1
    return m.groupBy("edge").agg(omega.alias("omega"))


def walk(m: DataFrame, omega: DataFrame) -> DataFrame:
    """(node, edge, out, into): a walker at a node takes an edge with probability ``out`` and a member
    of the edge with ``into``."""
    delta = m.groupBy("edge").agg(F.sum("weight").alias("delta"))
    x = m.join(omega, "edge").join(delta, "edge")
    d = Window.partitionBy("node")
    return x.select("node", "edge", (F.col("omega") / F.sum("omega").over(d)).alias("out"), (F.col("weight") / F.col("delta")).alias("into"))


def _both_ways(b: DataFrame) -> tuple[DataFrame, DataFrame, Side, Side]:
    """The incidence materialised by node and by edge, so that rounds shuffle vectors only, and how a
    vector over nodes and one over edges is joined to them: broadcast if the hypergraph has few
    enough of them, counted once."""
    n = int(b.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = cut(b)
    few = once.agg(F.count_distinct("node").alias("n"), F.count_distinct("edge").alias("e")).first()
    side = lambda k: F.broadcast if k <= BROADCAST_ROWS else (lambda x: x)
    return cut(once.repartition(n, "node")), cut(once.repartition(n, "edge")), side(few["n"]), side(few["e"])


def pagerank(m: DataFrame, damping: float = 0.85, omega: DataFrame | None = None, teleport: DataFrame | None = None, iterations: int = 200, tol: float = 1e-10) -> DataFrame:
    """(node, pagerank) of the walk; ``teleport`` (node, p) defaults to uniform. NoConverge is raised if
    values still move by ``tol`` after ``iterations`` rounds."""
    by_node, by_edge, node_side, edge_side = _both_ways(walk(m, edge_weights(m, omega)))
    nodes = by_node.select("node").distinct()
    base = nodes.join(teleport.select("node", F.col("p").alias("t")), "node", "left").na.fill(0.0) if teleport is not None else nodes.withColumn("t", F.lit(1.0))
    base = cut(with_total(cut(base), every="t").select("node", (F.col("t") / F.col("every")).alias("t")))

    def step(r: DataFrame) -> DataFrame:
        e = by_node.join(node_side(r), "node").groupBy("edge").agg(F.sum(F.col("r") * F.col("out")).alias("x"))
        n = by_edge.join(edge_side(e), "edge").groupBy("node").agg(F.sum(F.col("x") * F.col("into")).alias("y"))
        return base.join(n, "node", "left").select("node", (F.lit(1 - damping) * F.col("t") + F.lit(damping) * F.coalesce("y", F.lit(0.0))).alias("r"))

    r = fixed_point(base.select("node", F.col("t").alias("r")), step, ["node"], "r", iterations, tol)
    return with_total(r, every="r").select("node", (F.col("r") / F.col("every")).alias("pagerank"))


def clique_eigenvector(m: DataFrame, iterations: int = 200, tol: float = 1e-9) -> DataFrame:
    """(node, centrality): dominant eigenvector of the binary clique expansion, unit length, by power
    iteration on A + I. NoConverge is raised if it does not settle."""
    a = cut(neighbours(m))

    def step(x: DataFrame) -> DataFrame:
        y = a.join(x.select(F.col("node").alias("o"), "x"), "o").groupBy("node").agg(F.sum("x").alias("y"))
        return _unit(x.join(y, "node", "left").select("node", (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("x")))

    x = fixed_point(_unit(m.select("node").distinct().withColumn("x", F.lit(1.0))), step, ["node"], "x", iterations, tol, every=1)
    return x.select("node", F.col("x").alias("centrality"))


def _unit(x: DataFrame) -> DataFrame:
    x = cut(x)
    return with_total(x, square=F.col("x") * F.col("x")).select("node", (F.col("x") / F.sqrt("square")).alias("x"))


def tensor_centrality(m: DataFrame, kind: str = "Z", iterations: int = 300, tol: float = 1e-9) -> DataFrame:
    """(node, centrality): Z and H eigenvectors of the adjacency tensor, y_i = sum over edges of the
    product of the other members' values; H takes the (largest size - 1)-th root. Shifted power
    iteration; values are positive. NoConverge is raised if it does not settle."""
    if kind not in ("Z", "H"):
        raise BadInput("kind is Z or H")
    b = cut(m.select("node", "edge"))
    big = b.groupBy("edge").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 2

    def step(x: DataFrame) -> DataFrame:
        logs = b.join(x, "node").withColumn("l", F.log(F.greatest("x", F.lit(1e-300))))
        e = logs.groupBy("edge").agg(F.sum("l").alias("s"))
        y = logs.join(e, "edge").groupBy("node").agg(F.sum(F.exp(F.col("s") - F.col("l"))).alias("y"))
        y = y.withColumn("y", F.pow("y", F.lit(1.0 / (big - 1)))) if kind == "H" and big > 1 else y
        return _unit(x.join(y, "node").select("node", (F.col("x") + F.col("y")).alias("x")))

    x = fixed_point(_unit(b.select("node").distinct().withColumn("x", F.lit(1.0))), step, ["node"], "x", iterations, tol, every=1)
    return x.select("node", F.col("x").alias("centrality"))


def katz(m: DataFrame, alpha: float | None = None, iterations: int = 400, tol: float = 1e-10) -> DataFrame:
    """(node, katz): sum over k >= 1 of alpha^k A^k 1 on the weighted clique expansion, as the fixed
    point of x = alpha A (1 + x). ``alpha`` must lie below 1 over A's largest eigenvalue, else
    NoConverge is raised; by default it is half of 1 over A's largest row sum, which always does."""
    by_node, by_edge, node_side, edge_side = _both_ways(m.select("node", "edge", "weight"))
    own = cut(by_node.groupBy("node").agg(F.sum(F.col("weight") * F.col("weight")).alias("own")))

    def times(x: DataFrame) -> DataFrame:  # (node, own, x) to (node, y): A x
        e = by_node.join(node_side(x.select("node", "x")), "node").groupBy("edge").agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
        y = by_edge.join(edge_side(e), "edge").groupBy("node").agg(F.sum(F.col("weight") * F.col("y")).alias("y"))
        return x.join(y, "node").select("node", "own", (F.col("y") - F.col("own") * F.col("x")).alias("y"))

    first = cut(times(own.withColumn("x", F.lit(1.0))))
    if alpha is None:
        alpha = 0.5 / (first.agg(F.max("y")).first()[0] or 1.0)
    step = lambda s: times(s.select("node", "own", (F.col("s") + 1.0).alias("x"))).select("node", "own", (F.lit(alpha) * F.col("y")).alias("s"))
    s = fixed_point(first.select("node", "own", (F.lit(alpha) * F.col("y")).alias("s")), step, ["node", "own"], "s", iterations, tol)
    return s.select("node", F.col("s").alias("katz"))


def laplacian(m: DataFrame, kind: str = "zhou", omega: DataFrame | None = None) -> DataFrame:
    """(i, j, value): non-zero cells of a Laplacian. ``zhou``: I - D^-1/2 H W De^-1 H' D^-1/2 with W = 1 and
    binary H, i <= j. ``random_walk``: I - P of ``walk``, every cell (it is not symmetric)."""
    if kind == "random_walk":
        w = walk(m, edge_weights(m, omega))
        s = w.select("edge", F.col("node").alias("i"), "out").join(w.select("edge", F.col("node").alias("j"), "into"), "edge")
        s = s.groupBy("i", "j").agg(F.sum(F.col("out") * F.col("into")).alias("s"))
    elif kind == "zhou":
        size = m.groupBy("edge").agg(F.count(F.lit(1)).alias("k"))
        d = m.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
        b = m.select("node", "edge").join(size, "edge").join(d, "node").withColumn("v", F.lit(1.0) / F.sqrt("d"))
        a = b.select("edge", F.col("node").alias("i"), F.col("v").alias("vi"), "k")
        z = b.select("edge", F.col("node").alias("j"), F.col("v").alias("vj"))
        s = a.join(z, "edge").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("vi") * F.col("vj") / F.col("k")).alias("s"))
    else:
        raise BadInput("kind is zhou or random_walk")
    return s.select("i", "j", (F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(0.0)) - F.col("s")).alias("value"))


def spread_labels(m: DataFrame, labels: DataFrame, xi: float = 0.99, normalisation: str = "none", iterations: int = 200, tol: float = 1e-8) -> DataFrame:
    """(node, predicted, score, margin): F = (1 - xi)(I - xi S)^-1 Y for S of ``laplacian``, all classes at
    once. ``labels`` is (node, label). ``class_mass`` divides each class by its sum. Ties go to the
    lesser label; nodes out of reach of any label get null. Solved by conjugate gradients, classes
    side by side as columns; two numbers a class come to the driver each round. NoConverge is raised if the error bound stays above ``tol``."""
    size = m.groupBy("edge").agg(F.count(F.lit(1)).alias("k"))
    d = m.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    by_node, by_edge, node_side, edge_side = _both_ways(m.select("node", "edge").join(size, "edge").join(d, "node").select("node", "edge", "k", (F.lit(1.0) / F.sqrt("d")).alias("v")))
    known = labels.where("node is not null and label is not null").select("node", F.col("label").cast("string").alias("label")).distinct()
    known = cut(known.join(by_node.select("node").distinct(), "node", "left_semi"))
    classes = [r["label"] for r in known.select("label").distinct().orderBy("label").limit(MAX_CLASSES + 1).collect()]
    if len(classes) > MAX_CLASSES:
        raise BadInput(f"more than {MAX_CLASSES} classes")
    f = known.select("node", "label", F.lit(0.0).alias("f")).limit(0)
    for at in range(0, len(classes), WIDE):  # classes do not touch each other
        own = classes[at : at + WIDE]
        x = _solve(by_node, by_edge, node_side, edge_side, known, own, xi, iterations, tol)
        long = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"x{i}").alias("f")) for i, c in enumerate(own)])).alias("c")
        f = f.unionByName(x.select("node", long).select("node", "c.label", "c.f").where("f <> 0"))
    f = cut(f)
    if normalisation == "class_mass":
        f = f.withColumn("f", F.col("f") / F.sum("f").over(Window.partitionBy("label")))
    elif normalisation != "none":
        raise BadInput("normalisation is none or class_mass")
    w = Window.partitionBy("node").orderBy(F.desc("f"), "label")
    best = f.withColumns({"r": F.row_number().over(w), "second": F.lead("f").over(w)}).where("r = 1")
    out = best.select("node", F.col("label").alias("predicted"), F.col("f").alias("score"), (F.col("f") - F.coalesce("second", F.lit(0.0))).alias("margin"))
    return by_node.select("node").distinct().join(out, "node", "left")


#: Classes of label spreading at most, and classes solved side by side as columns of one table.
MAX_CLASSES, WIDE = 4096, 32


def _solve(by_node: DataFrame, by_edge: DataFrame, node_side: Side, edge_side: Side, known: DataFrame, classes: list[str], xi: float, iterations: int, tol: float) -> DataFrame:
    """(node, x0, x1, ...): (I - xi S) x = (1 - xi) y by conjugate gradients, a column for each class."""
    n = range(len(classes))
    c = lambda k: [F.col(f"{k}{i}") for i in n]
    y = known.groupBy("node").agg(*[F.max(F.when(F.col("label") == k, 1 - xi).otherwise(0.0)).alias(f"r{i}") for i, k in enumerate(classes)])
    state = by_node.select("node").distinct().join(y, "node", "left").na.fill(0.0).select("node", *[F.lit(0.0).alias(f"x{i}") for i in n], *c("r"), *[F.col(f"r{i}").alias(f"p{i}") for i in n])
    for _ in range(iterations):
        e = by_node.join(node_side(state.select("node", *c("p"))), "node").groupBy("edge").agg(*[F.sum(F.col("v") * F.col(f"p{i}") / F.col("k")).alias(f"y{i}") for i in n])
        z = by_edge.join(edge_side(e), "edge").groupBy("node").agg(*[F.sum(F.col("v") * F.col(f"y{i}")).alias(f"z{i}") for i in n])
        st = cut(state.join(z, "node").select("node", *c("x"), *c("r"), *c("p"), *[(F.col(f"p{i}") - F.lit(xi) * F.col(f"z{i}")).alias(f"q{i}") for i in n]))
        got = st.agg(*[F.sum(F.col(f"p{i}") * F.col(f"q{i}")).alias(f"a{i}") for i in n], *[F.sum(F.col(f"r{i}") * F.col(f"r{i}")).alias(f"b{i}") for i in n]).first()
        go = [F.lit((got[f"b{i}"] or 0.0) / got[f"a{i}"] if got[f"a{i}"] else 0.0) for i in n]
        st = st.select("node", *[(F.col(f"x{i}") + go[i] * F.col(f"p{i}")).alias(f"x{i}") for i in n], *[(F.col(f"r{i}") - go[i] * F.col(f"q{i}")).alias(f"r{i}") for i in n], *c("p"))
        now = st.agg(*[F.sum(F.col(f"r{i}") * F.col(f"r{i}")).alias(f"b{i}") for i in n], F.max(F.array_max(F.transform(F.array(*c("r")), F.abs))).alias("worst")).first()
        turn = [F.lit((now[f"b{i}"] or 0.0) / got[f"b{i}"] if got[f"b{i}"] else 0.0) for i in n]
        state = st.select("node", *c("x"), *c("r"), *[(F.col(f"r{i}") + turn[i] * F.col(f"p{i}")).alias(f"p{i}") for i in n])
        if (now["worst"] or 0.0) < tol * (1 - xi):
            return state.select("node", *c("x"))
    raise NoConverge(f"label spreading did not settle in {iterations} rounds")


def _dense(m: DataFrame) -> tuple[list[str], np.ndarray]:
    """Nodes and S = I - L on the driver, within the guard."""
    n = m.select("node").distinct().count()
    if n > MAX_DENSE:
        raise DenseTooLarge(f"{n} nodes; this verb is dense and takes {MAX_DENSE}")
    nodes = [r[0] for r in m.select("node").distinct().orderBy("node").collect()]
    at = {x: i for i, x in enumerate(nodes)}
    s = np.zeros((n, n))
    for r in laplacian(m).toLocalIterator():
        i, j = at[r["i"]], at[r["j"]]
        s[i, j] = s[j, i] = float(i == j) - r["value"]
    return nodes, s


def spectral_clusters(m: DataFrame, k: int, starts: int = 25, seed: int = 1) -> DataFrame:
    """(node, cluster): k-means on the rows, at unit length, of the k leading eigenvectors of S, found by
    passes over the memberships; no node by node matrix is formed."""
    names, cells, n = number(m)
    if not 1 <= k <= n:
        raise BadInput("k is between 1 and the number of nodes")

    def fit(group, batches):
        own = Cells(batches)
        root = np.sqrt(group.total(sum((np.bincount(i, minlength=n) for _, i, *_ in own.blocks()), np.zeros(n))))
        _, u = leading(group, lambda x: group.total(own.there_and_back(x / root)) / root, n, k, seed)
        mine = group.own(n)
        u = u[:, mine].T / np.maximum(np.linalg.norm(u[:, mine], axis=0), 1e-12)[:, None]
        yield from rows(i=np.arange(mine.start, mine.stop), cluster=kmeans(group, u, k, starts, seed))

    return names.join(bounded(in_step(cells, fit, "i long, cluster long")), "i").select("node", F.col("cluster").cast("int").alias("cluster"))


def embed(m: DataFrame, dimensions: int) -> DataFrame:
    """(node, coordinates array, pi): leading eigenvectors of S after the first, the largest entry of each
    positive, and the stationary share of the node."""
    nodes, s = _dense(m)
    _, vec = np.linalg.eigh(s)
    u = vec[:, ::-1][:, 1 : dimensions + 1]
    u = u * np.sign(u[np.abs(u).argmax(0), range(u.shape[1])])
    d = m.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    x = m.sparkSession.createDataFrame([(a, [float(v) for v in row]) for a, row in zip(nodes, u, strict=True)], "node string, coordinates array<double>")
    return x.join(d, "node").select("node", "coordinates", (F.col("d") / F.sum("d").over(Window.partitionBy())).alias("pi"))


def subgraph_centrality(m: DataFrame) -> DataFrame:
    """(node, centrality): log of the diagonal of exp(A) of the binary clique expansion; dense, guarded."""
    n = m.select("node").distinct().count()
    if n > MAX_DENSE:
        raise DenseTooLarge(f"{n} nodes; this verb is dense and takes {MAX_DENSE}")
    nodes = [r[0] for r in m.select("node").distinct().orderBy("node").collect()]
    at = {x: i for i, x in enumerate(nodes)}
    a = np.zeros((n, n))
    for r in neighbours(m).where("node < o").toLocalIterator():
        a[at[r[0]], at[r[1]]] = a[at[r[1]], at[r[0]]] = 1
    val, vec = np.linalg.eigh(a)
    top = val.max() if n else 0.0
    diag = (vec**2 * np.exp(val - top)).sum(1)
    return m.sparkSession.createDataFrame([(x, float(top + np.log(v))) for x, v in zip(nodes, diag, strict=True)], "node string, centrality double")


def fuzzy_membership(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, cluster, membership): fuzzy c-means memberships (m = 2) of (node, coordinates) to the
    centroids of (node, cluster). A node on a centroid belongs to it."""
    j = points.join(clusters, "node")
    cen = j.select("cluster", F.posexplode("coordinates").alias("p", "x")).groupBy("cluster", "p").agg(F.avg("x").alias("x"))
    cen = cen.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("c"))
    d = points.crossJoin(F.broadcast(cen)).withColumn("d", F.aggregate(F.zip_with("coordinates", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    w = Window.partitionBy("node")
    inv = F.when(F.min("d").over(w) == 0, (F.col("d") == 0).cast("double")).otherwise(F.lit(1.0) / F.col("d"))
    d = d.withColumn("inv", inv)
    return d.select("node", "cluster", (F.col("inv") / F.sum("inv").over(w)).alias("membership"))
