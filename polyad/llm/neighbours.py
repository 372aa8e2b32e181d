"""Most similar vectors for every vector, by rotated one-bit codes in inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyad.plans.session import cut, need

#: The coarse centroids are fitted on at most this many rows, whatever the table's size.
SAMPLE_ROWS = 32_768
#: Rows per inverted list aimed at, and lists at most.
LIST_ROWS, MAX_LISTS = 200, 2048
#: A query looks into the lists whose centroid is at most MARGIN less similar than the nearest one,
#: MAX_PROBES at most; the measured recall is in the README.
MARGIN, MAX_PROBES = 0.2, 24
#: Rows of a cell: larger lists are cut into blocks of data and blocks of queries.
BLOCK = 8192
#: Standard deviations in the error bound of an estimate.
EPSILON = 1.9
QUERY_BITS = 4
SALTS = 16


@lru_cache(8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, n_lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows."""
    rng = np.random.default_rng(seed)
    s = sample.astype(np.float32)
    c = s[rng.choice(len(s), min(n_lists, len(s)), replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([(s[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(s), 4096)])
        m = np.zeros((len(c), s.shape[1]))
        np.add.at(m, at, s)
        norm = np.linalg.norm(m, axis=1)
        full = norm > 1e-9
        c[full] = (m[full] / norm[full, None]).astype(np.float32)
        if (~full).any():
            c[~full] = s[rng.choice(len(s), int((~full).sum()))]
    return c


class Codes:
    """One-bit codes of the rows of one list around its centroid.

    A row's residual is rotated; the signs are its code, packed into one word per 64 dimensions,
    and two scalars correct the estimate: the residual's length and the cosine between residual
    and code. A query's residual is rotated and quantised to four bits, whose planes meet the code
    by AND and popcount.
    """

    def __init__(self, unit: np.ndarray, centroid: np.ndarray, seed: int):
        self.c, self.dim = centroid.astype(np.float64), unit.shape[1]
        self.turn = rotation(self.dim, seed)
        res = unit - self.c
        self.length = np.linalg.norm(res, axis=1)
        turned = np.divide(res, self.length[:, None], out=np.zeros_like(res), where=self.length[:, None] > 0) @ self.turn
        self.code = self.pack(turned > 0)
        self.ones = np.bitwise_count(self.code).sum(1).astype(np.float32)
        fit = np.abs(turned).sum(1) / np.sqrt(self.dim)
        self.fit = np.where(self.length > 0, fit, 1.0).astype(np.float32)
        self.along = (self.c @ self.c + res @ self.c).astype(np.float32)
        self.slack = (self.length * np.sqrt(np.maximum(0, 1 - self.fit**2)) / self.fit * EPSILON / np.sqrt(max(1, self.dim - 1))).astype(np.float32)

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        pad = -bits.shape[1] % 64
        return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)).view(np.uint64)

    def estimate(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated cosines, bounds of their errors), queries by rows."""
        res = unit - self.c
        turned = res @ self.turn
        low = turned.min(1, keepdims=True)
        step = np.maximum((turned.max(1, keepdims=True) - low) / (2**QUERY_BITS - 1), 1e-12)
        q = np.rint((turned - low) / step).astype(np.uint8)
        dot = np.zeros((len(unit), len(self.code)), np.uint16)
        for j in range(QUERY_BITS):
            plane = self.pack((q >> j) & 1 == 1)
            for w in range(plane.shape[1]):
                dot += np.bitwise_count(plane[:, w, None] & self.code[None, :, w]).astype(np.uint16) << j
        root = np.sqrt(self.dim)
        step32, low32 = step.astype(np.float32), low.astype(np.float32)
        side = (-(step * q.sum(1, dtype=np.int64)[:, None]) - self.dim * low).astype(np.float32)
        along = (2 * step32 * dot + 2 * low32 * self.ones + side) / np.float32(root)
        scale = (self.length / self.fit).astype(np.float32)
        est = along * scale + self.along + (res @ self.c).astype(np.float32)[:, None]
        size = np.linalg.norm(res, axis=1).astype(np.float32)[:, None]
        bound = size * self.slack + step32 * (np.float32(EPSILON * 0.5) * scale) + np.float32(1e-6)
        return est, bound

    def search(self, unit: np.ndarray, data: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query row, data row, cosine) of the best ``k`` of each query; ``own`` are the queries'
        ids, which are no answer to themselves. Candidates are compared exactly if the upper bound
        of their estimate reaches both ``least`` and the k-th best exact value seen so far."""
        n = len(data)
        per = max(1, 2_000_000 // n)
        for s in range(0, len(unit), per):
            u = unit[s : s + per]
            est, bound = self.estimate(u)
            upper = est + bound
            upper[own[s : s + per, None] == ids[None, :]] = -9
            floor = np.full(len(u), least - 1e-9, np.float64)
            if n > 4 * k:
                first = np.argpartition(-np.where(upper > -9, est, -9), k, axis=1)[:, : k + 1]
                exact = np.einsum("qd,qkd->qk", u, data[first])
                exact[np.take_along_axis(upper, first, 1) == -9] = -9
                floor = np.maximum(floor, np.sort(exact, axis=1)[:, 1] - 1e-9)  # k-th of k + 1
            qi, xi = np.nonzero(upper >= floor[:, None])
            if not len(qi):
                continue
            cos = np.concatenate([np.einsum("pd,pd->p", u[qi[i : i + 65536]], data[xi[i : i + 65536]]) for i in range(0, len(qi), 65536)])
            cos = np.round(cos, 9)
            good = cos >= least
            qi, xi, cos = qi[good], xi[good], cos[good]
            order = np.lexsort((ids[xi], -cos, qi))
            qi, xi, cos = qi[order], xi[order], cos[order]
            first_of = np.searchsorted(qi, qi)
            top = np.arange(len(qi)) - first_of < k
            yield qi[top] + s, xi[top], cos[top]


def _floats(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit rows; each is first divided by its largest entry, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_CELL = "list int, db int, qb int, is_data boolean, id long, v binary, mem array<long>"


def _assign(centroids: np.ndarray, blocks: np.ndarray, dim: int, probes: int, margin: float):
    """Rows of the cells that a vector takes part in, as data of its own list and as a query of
    every list it probes. A list of b blocks has b x b cells of (data block, query block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                ids = b.column(0).to_numpy()
                sims = _unit(_floats(b.column(1), dim)).astype(np.float32) @ centroids.T
                p = min(probes, sims.shape[1])
                near = np.argpartition(-sims, p - 1, axis=1)[:, :p]
                val = np.take_along_axis(sims, near, 1)
                best = sims.max(1)
                home = sims.argmax(1)
                qrow, qpos = np.nonzero(val >= best[:, None] - margin)
                qlist = near[qrow, qpos]
                spread = ids * np.int64(0x9E3779B1) >> np.int64(7)
                rows, lists, dbs, qbs, data = [], [], [], [], []
                for is_data, r, li in ((True, np.arange(len(ids)), home), (False, qrow, qlist)):
                    nb = blocks[li]
                    mine = spread[r] % nb
                    rr = np.repeat(np.arange(len(r)), nb)
                    other = np.arange(len(rr)) - np.repeat(np.cumsum(nb) - nb, nb)
                    rows.append(r[rr])
                    lists.append(li[rr])
                    dbs.append(mine[rr] if is_data else other)
                    qbs.append(other if is_data else mine[rr])
                    data.append(np.full(len(rr), is_data))
                take = pa.array(np.concatenate(rows))
                cols = [pa.array(np.concatenate(x).astype(np.int32)) for x in (lists, dbs, qbs)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(data)), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take)], names=[x.split()[0] for x in _CELL.split(", ")])

    return run


def _search(centroids: np.ndarray, dim: int, k: int, least: float, seed: int):
    empty = pa.table({"id": pa.array([], pa.int64()), "x": pa.array([], pa.int64()), "cos": pa.array([], pa.float64())})

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        is_data = t.column("is_data").combine_chunks().to_numpy(zero_copy_only=False)
        where, ask = np.flatnonzero(is_data), np.flatnonzero(~is_data)
        if not len(where) or not len(ask):
            return empty
        ids = t.column("id").to_numpy()
        mem = t.column("mem").take(pa.array(where)).to_pylist()
        data = _unit(_floats(t.column("v").take(pa.array(where)), dim))
        codes = Codes(data, centroids[key[0].as_py()], seed)
        out = []
        for a in range(0, len(ask), 16384):
            part = ask[a : a + 16384]
            unit = _unit(_floats(t.column("v").take(pa.array(part)), dim))
            for qi, xi, cos in codes.search(unit, data, ids[part], ids[where], k, least):
                many = np.array([len(mem[x]) if mem[x] else 1 for x in xi], np.int64)
                x = np.fromiter((m for j in xi for m in (mem[j] or (ids[where[j]],))), np.int64, int(many.sum()))
                out.append((np.repeat(ids[part[qi]], many), x, np.repeat(cos, many)))
        if not out:
            return empty
        return pa.table({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("id", "x", "cos"))})

    return run


def clean_vectors(vectors: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """(id, v array<float>) of the vectors that count: ``dim`` finite numbers, not all zero. Rows
    with one id are one vector, the least."""
    v = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id is not null").where(F.size("v") == dim)
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(3.4028235e38)))).where(F.exists("v", lambda x: x != 0))
    return v.groupBy("id").agg(F.min("v").alias("v")).select("id", F.transform("v", lambda x: x + F.lit(0).cast("float")).alias("v"))


def _binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        raw = flat.tobytes()
        step = len(raw) // b.num_rows if b.num_rows else 0
        v = pa.array([raw[i * step : (i + 1) * step] for i in range(b.num_rows)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("id"), v], names=["id", "v"])


def similar_vectors(vectors: DataFrame, ident: str = "emb_id", vector: str = "embeddings", dim: int = 64, k: int = 5, least: float = -1.0, seed: int = 7, margin: float = MARGIN, probes: int = MAX_PROBES, list_rows: int = LIST_ROWS) -> DataFrame:
    """(id, other, rank, cosine): for every vector the ``k`` others of largest cosine, at least
    ``least``; the cosine is in double precision, rounded to 9 decimals, and equal ones rank by
    smaller id. Only vectors of ``dim`` finite numbers that are not all zero count, as queries and
    as answers; rows with one id are one vector (the least). Nulls, empty lists and other lengths
    are left out, an empty table gives no rows, other columns are ignored.

    Every vector is indexed and every vector is a query. Vectors with the same floats are one class
    with one search: it answers with up to k + 1 least ids of a class, which is all that can rank.
    Centroids, fitted on SAMPLE_ROWS rows at most, cut the table into lists; a query looks into its
    nearest lists (MARGIN, MAX_PROBES). In a list, one-bit codes of randomly rotated residuals
    estimate cosines from packed bits and two scalars a row, and only rows whose upper error bound
    reaches the k-th best are compared exactly. Lists of more than BLOCK rows are cut into cells of
    data blocks and query blocks, so no list, however large, meets one task.
    """
    need(vectors, ident, vector)
    spark = vectors.sparkSession
    v = clean_vectors(vectors, ident, vector, dim)
    keyed = v.withColumns({"k1": F.xxhash64("v"), "k2": F.hash("v")})
    w = Window.partitionBy("k1", "k2").orderBy("id")
    first = keyed.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
    classes = first.groupBy("k1", "k2").agg(F.min_by("v", "id").alias("v"), F.array_sort(F.collect_list("id")).alias("mem"))
    binary = classes.select(F.element_at("mem", 1).alias("id"), "v").mapInArrow(_binary, "id long, v binary")
    small = classes.select(F.element_at("mem", 1).alias("id"), F.when(F.size("mem") > 1, F.col("mem")).alias("mem"), "k1", "k2")
    many = cut(small.where("mem is not null"))
    reps = cut(binary.join(many.select("id", "mem"), "id", "left"))
    n = reps.count()
    if n == 0:
        return spark.createDataFrame([], "id long, other long, rank int, cosine double")
    share = min(1.0, SAMPLE_ROWS / n)
    picked = reps.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toArrow()
    sample = _unit(_floats(picked.column("v"), dim)) if picked.num_rows else _unit(_floats(reps.limit(1).toArrow().column("v"), dim))
    centroids = fit_centroids(sample, max(1, min(MAX_LISTS, n // list_rows)), seed)
    load = np.bincount(np.concatenate([(sample[i : i + 4096].astype(np.float32) @ centroids.T).argmax(1) for i in range(0, len(sample), 4096)]), minlength=len(centroids))
    blocks = np.maximum(1, np.ceil(load * (n / len(sample)) / BLOCK)).astype(np.int64)
    cells = reps.mapInArrow(_assign(centroids, blocks, dim, probes, margin), _CELL)
    found = cells.groupBy("list", "db", "qb").applyInArrow(_search(centroids, dim, k, least, seed), "id long, x long, cos double")
    copies = many.select("id", F.explode("mem").alias("x"), F.lit(1.0).alias("cos"))
    if least > 1:
        copies = copies.limit(0)
    top = found.unionByName(copies).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("m"), F.col("x").alias("x")))), 1, k + 1).alias("top"))
    # every member of a class of copies has its class's answers, but for itself
    spread = keyed.select("k1", "k2", F.col("id").alias("member"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    salted = many.select("k1", "k2", "id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = spread.join(salted, ["k1", "k2", "salt"]).select("id", "member", "salt")
    answers = top.join(many.select("id"), "id", "left_semi").select("id", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of_copies = members.join(answers, ["id", "salt"]).select(F.col("member").alias("id"), "top")
    every = top.join(many.select("id"), "id", "left_anti").unionByName(of_copies)
    ranked = every.select("id", F.posexplode(F.slice(F.filter("top", lambda t: t["x"] != F.col("id")), 1, k)).alias("p", "t"))
    return ranked.select("id", F.col("t.x").alias("other"), (F.col("p") + 1).alias("rank"), (-F.col("t.m")).alias("cosine"))
