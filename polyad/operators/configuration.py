"""Sums of the null statistics by ranges of nodes, and configuration draws of which any part can be
looked up: a seeded permutation deals the stubs of nodes to places in edges, and a task follows it
both ways from the nodes it owns. Names do not matter to the statistics of a draw, so its nodes and
edges are known by their degrees and sizes alone. Memberships are sent once to each range they meet."""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.plans.session import cut

#: Up to so many stubs a permutation is drawn whole; beyond, it is mixed from random functions in ROUNDS rounds.
TABLE, ROUNDS = 1 << 16, 4
#: Pairs of members that a task should hold, and rows of its arrays handled at once.
PAIRS_PER_TASK, BLOCK = 1 << 22, 1 << 19
#: Pairs that are sorted together.
PAIRS_AT_ONCE = 1 << 21
#: Values of the hash that ranges of named nodes are made of.
RANGES = 1 << 20


class Permutation:
    """A permutation of 0..n-1, by ``seed`` and ``replicate``. A large one is a Feistel network on a grid of
    about sqrt(n) rows and columns with random tables as functions; numbers outside go round again."""

    def __init__(self, n: int, seed: int, replicate: int, table: int | None = None):
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed % (1 << 64), replicate])))
        self.n, self.whole = n, n <= (TABLE if table is None else table)
        if self.whole:
            self.there = rng.permutation(n)
            self.back = np.argsort(self.there)
            return
        self.a = math.isqrt(n - 1) + 1
        self.b = -(-n // self.a)
        self.tables = [(rng.integers(0, self.a, self.b), rng.integers(0, self.b, self.a)) for _ in range(ROUNDS)]

    def _round(self, x: np.ndarray, back: bool) -> np.ndarray:
        at = x // self.b
        rest = x - at * self.b
        sides = [(side, t) for f, g in self.tables for side, t in ((0, f), (1, g))]
        v, most = [at, rest], (self.a, self.b)
        for side, t in reversed(sides) if back else sides:
            w = v[side]
            if back:
                w -= t.take(v[1 - side])
            else:
                w += t.take(v[1 - side])
                w -= most[side]
            w += (w >> 63) & most[side]
        return at * self.b + rest

    def _follow(self, x: np.ndarray, back: bool) -> np.ndarray:
        if self.whole:
            return (self.back if back else self.there)[x]
        out = np.empty(len(x), np.int64)
        for k in range(0, len(x), 1 << 15):  # in the processor's cache
            y = self._round(x[k : k + (1 << 15)], back)
            while len(far := np.flatnonzero(y >= self.n)):
                y[far] = self._round(y[far], back)
            out[k : k + (1 << 15)] = y
        return out

    def to(self, x: np.ndarray) -> np.ndarray:
        return self._follow(x, False)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._follow(x, True)


class Runs:
    """Items in ascending order of how many stubs they have, from ``counts``: (stubs, items) pairs."""

    def __init__(self, counts: list[tuple[int, int]]):
        self.each, items = np.array(sorted(counts), np.int64).reshape(-1, 2).T
        self.first = np.concatenate([[0], np.cumsum(items)])
        self.start = np.concatenate([[0], np.cumsum(items * self.each)])
        self.items, self.stubs = int(self.first[-1]), int(self.start[-1])

    def item(self, stub: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.start, stub, "right") - 1
        return self.first[k] + (stub - self.start[k]) // self.each[k]

    def begin(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first stub of each item, and how many it has."""
        k = np.minimum(np.searchsorted(self.first, item, "right") - 1, len(self.each) - 1)
        return self.start[k] + (item - self.first[k]) * self.each[k], self.each[k]


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each row, n of them, one after another."""
    ends = np.cumsum(n)
    return np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The values of ``x`` in order, which is sorted in place; np.unique hashes, which takes longer."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _blocks(n: np.ndarray, most: int = BLOCK) -> Iterator[slice]:
    """Slices of rows that spread to about ``most`` each; a row of more is alone."""
    ends, k = np.cumsum(n), 0
    while k < len(n):
        z = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right")))
        yield slice(k, z)
        k = z


def _earlier(new: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (earlier, later) of all pairs of rows in one group; ``new`` marks a group's first row."""
    at = np.arange(len(new))
    before = at - np.maximum.accumulate(np.where(new, at, 0))
    for s in _blocks(before):
        yield _spread(at[s] - before[s], before[s]), np.repeat(at[s], before[s])


def _members(nodes: Runs, edges: Runs, p: Permutation, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all edges with a node in lo..hi-1: their numbers of members, and the members in order."""
    if hi - lo == nodes.items:
        own = np.arange(edges.items)
    else:
        a, z = (int(nodes.begin(np.array([x]))[0][0]) if x < nodes.items else nodes.stubs for x in (lo, hi))
        own = _distinct(np.concatenate([_distinct(edges.item(p.to(np.arange(k, min(z, k + BLOCK))))) for k in range(a, z, BLOCK)]))
    begin, n = edges.begin(own)
    sizes, members, kind = [], [], np.int32 if nodes.items < 1 << 31 else np.int64
    for s in _blocks(n):
        cell = _distinct(np.repeat(np.arange(s.stop - s.start), n[s]) * nodes.items + nodes.item(p.of(_spread(begin[s], n[s]))))
        e = cell // nodes.items
        sizes.append(np.bincount(e, minlength=s.stop - s.start))
        members.append((cell - e * nodes.items).astype(kind))
    return np.concatenate(sizes), np.concatenate(members)


def _equal_sets(size: np.ndarray, begin: np.ndarray, v: np.ndarray) -> int:
    """How many of these edges have the members of an earlier one. Sums of hashes name candidates, members decide."""
    if not len(size):
        return 0
    x = (v.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    h = np.add.reduceat(x, begin)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    some = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    return len(some) - len({v[b : b + n].tobytes() for b, n in zip(begin[some].tolist(), size[some].tolist(), strict=True)})


def _shared_sizes(node: np.ndarray, size: np.ndarray) -> float:
    """Over all pairs of edges at a node: 1 / (sum of their sizes - 1), edges of one size together."""
    wide = int(size.max()) + 1
    k, h = np.unique(node * wide + size, return_counts=True)
    node, size = np.divmod(k, wide)
    out = float(np.sum(h * (h - 1) / 2 / (2 * size - 1)))
    for a, z in _earlier(np.concatenate([[True], node[1:] != node[:-1]])):
        out += float(np.sum(h[a] * h[z] / (size[a] + size[z] - 1)))
    return out


def _repeated(key: np.ndarray) -> tuple[int, np.ndarray]:
    """How many distinct keys there are, and those that occur again."""
    s = np.sort(key)
    new = np.concatenate([[True], s[1:] != s[:-1]])
    return int(new.sum()), s[new & np.concatenate([~new[1:], [False]])]


def _corrections(key: np.ndarray, edge: np.ndarray, n: int, size: np.ndarray, begin: np.ndarray, v: np.ndarray) -> float:
    """What edges that share several nodes add to the overlap beyond one node at a time. ``key`` (the pair)
    and ``edge`` of all edges of repeated pairs; two edges count at the two least nodes they share."""
    order = np.lexsort((edge, key))
    key, z = key[order], key[order] % n
    own, edge = np.unique(edge[order], return_inverse=True)
    size, begin = size[own], begin[own]
    cells = np.repeat(np.arange(len(own)), size) * n + v[_spread(begin, size)]
    first, out = np.cumsum(size) - size, 0.0
    for i, j in _earlier(np.concatenate([[True], key[1:] != key[:-1]])):
        for s in _blocks(size[edge[i]]):
            a, b, last = edge[i[s]], edge[j[s]], z[i[s]]
            node, row = cells[_spread(first[a], size[a])] % n, np.repeat(np.arange(len(a)), size[a])
            ask = b[row] * n + node
            both = cells[np.minimum(np.searchsorted(cells, ask), len(cells) - 1)] == ask
            c = np.bincount(row[both], minlength=len(a))
            least = np.bincount(row[both & (node <= last[row])], minlength=len(a)) == 2
            c, sizes = c[least], (size[a] + size[b])[least]
            out += float(np.sum(c / (sizes - c) - c / (sizes - 1)))
    return out


def part_of_sums(size: np.ndarray, v: np.ndarray, n: int, lo: int, hi: int) -> tuple:
    """What the nodes lo..hi-1 of ``n`` add to the sums: (cells, repeated_edges, pairs, repeated_pairs, js, more),
    from all edges that hold one: their sizes, and their members in order. A cell belongs to its node; a
    pair, an edge and an overlap to their least nodes."""
    end = np.cumsum(size)
    begin = end - size
    least = v[begin]
    ours = np.flatnonzero((least >= lo) & (least < hi))
    known = size[ours]
    equal = _equal_sets(known, np.cumsum(known) - known, v[_spread(begin[ours], known)])
    at = np.flatnonzero((v >= lo) & (v < hi))
    edge = np.searchsorted(end, at, "right")
    js = _shared_sizes(v[at].astype(np.int64) - lo, size[edge])
    ahead = end[edge] - at - 1
    owned = np.cumsum(np.bincount(v[at] - lo, ahead, hi - lo)).astype(np.int64)
    group = (owned - 1) // PAIRS_AT_ONCE  # of each node, so that few pairs are held
    group = group[v[at] - lo]
    pairs = again = 0
    more = 0.0
    for g in np.unique(group[ahead > 0]):
        own = np.flatnonzero((group == g) & (ahead > 0))
        p, r, x = _pairs(at[own], edge[own], ahead[own], lo, n, size, begin, v)
        pairs, again, more = pairs + p, again + r, more + x
    return len(at), equal, pairs, again, js, more


def _pairs(at: np.ndarray, edge: np.ndarray, ahead: np.ndarray, lo: int, n: int, size: np.ndarray, begin: np.ndarray, v: np.ndarray) -> tuple[int, int, float]:
    """Distinct and repeated pairs of each cell of ``at`` with the ``ahead`` that follow it in its edge, and their corrections."""
    key, done = np.empty(int(ahead.sum()), np.int64), 0
    for s in _blocks(ahead):
        z = _spread(at[s] + 1, ahead[s])
        key[done : done + len(z)] = np.repeat((v[at[s]].astype(np.int64) - lo) * n, ahead[s]) + v[z]
        done += len(z)
    pairs, again = _repeated(key)
    if not len(again):
        return pairs, 0, 0.0
    marks = np.zeros(1 << 22, bool)
    mark = lambda x: (x * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) >> 42) & ((1 << 22) - 1)
    marks[mark(again)] = True
    some = np.concatenate([k + np.flatnonzero(marks[mark(key[k : k + BLOCK])]) for k in range(0, len(key), BLOCK)])
    some = some[again[np.minimum(np.searchsorted(again, key[some]), len(again) - 1)] == key[some]]
    return pairs, len(again), _corrections(key[some], edge[np.searchsorted(np.cumsum(ahead), some, "right")], n, size, begin, v)


def part_of_draw(nodes: Runs, edges: Runs, p: Permutation, lo: int, hi: int) -> tuple:
    """The same of a draw. Nodes of many edges come last, so that they own pairs with one another only."""
    return part_of_sums(*_members(nodes, edges, p, lo, hi), nodes.items, lo, hi)


_SUMS = {"cells": "long", "repeated_edges": "long", "pairs": "long", "repeated_pairs": "long", "js": "double", "more": "double"}


def _counted(x: np.ndarray) -> bytes:
    return np.column_stack(np.unique(x, return_counts=True)).astype(np.int64).tobytes()


def _added(counts: list[bytes]) -> list[tuple[int, int]]:
    """(number, how many) from what _counted gave of parts."""
    value, k = np.concatenate([np.frombuffer(c, np.int64) for c in counts] or [np.zeros(0, np.int64)]).reshape(-1, 2).T
    own, at = np.unique(value, return_inverse=True)
    return list(zip(own.tolist(), np.bincount(at, k, len(own)).astype(np.int64).tolist(), strict=True))


def _blob(t: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return out.getvalue()


def _unblob(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def _parted(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: rows (edge, node, h, p) to blobs (p, blob) of many rows, which take less to shuffle."""

    def send(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(some).combine_chunks()
        p = t["p"].to_numpy()
        order = np.argsort(p, kind="stable")
        t, cuts = t.select(["edge", "node", "h"]).take(order), np.searchsorted(p[order], np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield pa.RecordBatch.from_pydict({"p": pa.array([k], pa.int32()), "blob": [_blob(t.slice(cuts[k], cuts[k + 1] - cuts[k]))]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, rows = [], 0
        for b in batches:
            some.append(b)
            rows += b.num_rows
            if rows >= BLOCK:
                yield from send(some)
                some, rows = [], 0
        if rows:
            yield from send(some)

    return run


def _coded(parts: list[pa.ChunkedArray]) -> tuple[np.ndarray, int]:
    """Numbers for the strings of all ``parts``, and how many strings there are."""
    coded = pa.chunked_array([c.combine_chunks().cast(pa.large_string()).dictionary_encode() for c in parts]).unify_dictionaries()
    return np.concatenate([c.indices.to_numpy() for c in coded.chunks]), len(coded.chunk(0).dictionary)


def _packed(rows: pa.Table) -> pa.Table:
    """applyInArrow function: blobs of rows (edge, node, h) to blobs of edges one after another, (first, node, h),
    and their sizes; repeated rows count once."""
    t = pa.concat_tables([_unblob(b.as_py()) for b in rows["blob"]])
    e, v = _coded([t["edge"]])[0], _coded([t["node"]])[0]
    order = np.lexsort((v, e))
    e, v = e[order], v[order]
    new = np.concatenate([[True], (e[1:] != e[:-1]) | (v[1:] != v[:-1])])
    order, size = order[new], np.bincount(e[new])
    end, t = np.cumsum(size), t.select(["node", "h"]).combine_chunks()
    sizes, blobs = [], []
    for s in _blocks(size):
        at = order[(end[s.start - 1] if s.start else 0) : end[s.stop - 1]]
        first = np.zeros(len(at), bool)
        first[np.cumsum(size[s]) - size[s]] = True
        sizes.append(_counted(size[s]))
        blobs.append(_blob(t.take(at).append_column("first", pa.array(first))))
    return pa.table({"sizes": pa.array(sizes, pa.binary()), "blob": pa.array(blobs, pa.binary())})


def _split(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: blobs to (bucket, blob) for each range of ``h``, of the edges that have a node there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                t = _unblob(blob.as_py())
                first = t["first"].to_numpy()
                begin, e = np.flatnonzero(first), np.cumsum(first) - 1
                size = np.diff([*begin, len(first)])
                bucket = t["h"].to_numpy().astype(np.int64) * buckets // RANGES
                t = pa.table({"node": t["node"], "bucket": pa.array(bucket, pa.int32()), "first": first})
                k, e = np.divmod(_distinct(bucket * len(begin) + e), len(begin))
                for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(k)) + 1):
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([k[part[0]]], pa.int32()), "blob": [_blob(t.take(_spread(begin[e[part]], size[e[part]])))]})

    return run


def _bucket(rows: pa.Table) -> pa.Table:
    """applyInArrow function: the sums of a bucket's nodes, and their degrees."""
    own, names, where, marks = rows["bucket"][0].as_py(), [], [], []
    for b in rows["blob"]:
        t = _unblob(b.as_py())
        names.append(t["node"])
        where.append(t["bucket"].to_numpy())
        marks.append(t["first"].to_numpy())
    code, n = _coded(names)
    del names
    bucket = np.empty(n, np.int32)
    bucket[code] = np.concatenate(where)
    rank = np.empty(n, np.int64)
    rank[np.argsort(bucket, kind="stable")] = np.arange(n)
    first = np.concatenate(marks)
    size = np.diff([*np.flatnonzero(first), len(first)])
    v, done = np.empty(len(code), np.int32 if n < 1 << 31 else np.int64), 0
    for s in _blocks(size):
        cells = int(size[s].sum())
        cell = np.repeat(np.arange(s.stop - s.start, dtype=np.int64), size[s]) * n + rank[code[done : done + cells]]
        cell.sort()
        v[done : done + cells] = cell % n
        done += cells
    del code, first, where, marks
    lo = int((bucket < own).sum())
    hi = lo + int((bucket == own).sum())
    sums = part_of_sums(size, v, n, lo, hi)
    degrees = _counted(np.bincount(v[(v >= lo) & (v < hi)] - lo))
    return pa.table({**{c: pa.array([x], pa.int64() if k == "long" else pa.float64()) for (c, k), x in zip(_SUMS.items(), sums, strict=True)}, "degrees": [degrees]})


def parts_for(sizes: list[tuple[int, int]], pairs_per_task: int) -> int:
    return max(1, math.ceil(sum(s * s * k for s, k in sizes) / 2 / pairs_per_task))


def observed_sums(m: DataFrame, pairs_per_task: int = PAIRS_PER_TASK) -> tuple[DataFrame, Runs, Runs]:
    """One row (n, m, cells, repeated_edges, pairs, repeated_pairs, js, more) of memberships (node, edge), and
    the degrees of nodes and sizes of edges. Memberships are read once, gathered by edge, where repeated rows
    are dropped, and kept as blobs."""
    hashed = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    parts = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = m.select(F.col("edge").cast("string").alias("edge"), F.col("node").cast("string").alias("node")).dropna()
    rows = names.withColumns({"h": hashed("node", RANGES), "p": hashed("edge", parts)}).mapInArrow(_parted(parts), "p int, blob binary")
    packed = cut(rows.groupBy("p").applyInArrow(_packed, "sizes binary, blob binary"))
    sizes = _added([bytes(r["sizes"]) for r in packed.select("sizes").toLocalIterator()])
    buckets = min(RANGES, parts_for(sizes, pairs_per_task))
    kinds = ", ".join([*(f"{c} {k}" for c, k in _SUMS.items()), "degrees binary"])
    rows = packed.select("blob").mapInArrow(_split(buckets), "bucket int, blob binary").groupBy("bucket").applyInArrow(_bucket, kinds).collect()
    nodes, edges = Runs(_added([bytes(r["degrees"]) for r in rows])), Runs(sizes)
    total = [nodes.items, edges.items, *((math.fsum if kind == "double" else sum)(r[c] for r in rows) for c, kind in _SUMS.items())]
    return m.sparkSession.createDataFrame([tuple(total)], "n long, m long, " + kinds.rpartition(",")[0]), nodes, edges


def draw_sums(spark: SparkSession, nodes: Runs, edges: Runs, n: int, seed: int = 1, pairs_per_task: int = PAIRS_PER_TASK, table: int = TABLE) -> DataFrame:
    """(replicate, n, m, cells, repeated_edges, pairs, repeated_pairs, js, more) of ``n`` configuration draws.
    Each task deals the edges of a range of nodes by itself; a few sums leave it."""
    parts = parts_for(list(zip(edges.each.tolist(), np.diff(edges.first).tolist(), strict=True)), pairs_per_task)
    cuts = np.unique([0, *nodes.item(np.array([nodes.stubs * k // parts for k in range(1, parts)], np.int64)), nodes.items]).tolist()
    ranges = list(zip(cuts[:-1], cuts[1:], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.column(0).to_pylist():
                r, k = task // len(ranges) + 1, task % len(ranges)
                sums = part_of_draw(nodes, edges, Permutation(nodes.stubs, seed, r, table), *ranges[k])
                yield pa.RecordBatch.from_pydict({"replicate": pa.array([r], pa.int32()), **{c: pa.array([x], pa.int64() if kind == "long" else pa.float64()) for (c, kind), x in zip(_SUMS.items(), sums, strict=True)}})

    tasks = n * len(ranges)
    out = spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(run, ", ".join(["replicate int", *(f"{c} {k}" for c, k in _SUMS.items())]))
    return out.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in _SUMS]).withColumns({"n": F.lit(nodes.items).cast("long"), "m": F.lit(edges.items).cast("long")})


def dealt(stubs: int, n: int, seed: int, table: int = TABLE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: rows (j, node) to (replicate, node, i), the place i of stub j in each of ``n`` draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = [(r, Permutation(stubs, seed, r, table)) for r in range(1, n + 1)]
        for b in batches:
            j = b.column(0).to_numpy()
            for r, p in draws:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), r, np.int32)), b.column(1), pa.array(p.to(j))], ["replicate", "node", "i"])

    return run
