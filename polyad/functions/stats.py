"""Statistical functions that Spark has no built-in for."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyad.errors import BadInput
from polyad.plans.rank import running
from polyad.plans.session import cut


def _log_choose(n, k):
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric_tail(x: float, good: float, total: float, draws: float) -> tuple[float, float]:
    """(P(X <= x), P(X >= x)) of ``draws`` from an urn of ``total`` with ``good`` marked balls. The sum
    starts at x and runs away from the mean, where terms fall; the other tail is its complement."""
    good, total, draws, x = round(good), round(total), round(draws), round(x)
    lo, hi = max(0, draws + good - total), min(good, draws)
    if x < lo:
        return 0.0, 1.0
    if x > hi:
        return 1.0, 0.0
    at = math.exp(_log_choose(good, x) + _log_choose(total - good, draws - x) - _log_choose(total, draws))
    up = x >= draws * good / total
    s = term = at
    k = x
    while (k < hi) if up else (k > lo):
        if up:
            term *= (good - k) * (draws - k) / ((k + 1) * (total - good - draws + k + 1))
            k += 1
        else:
            term *= k * (total - good - draws + k) / ((good - k + 1) * (draws - k + 1))
            k -= 1
        s += term
        if term < s * 1e-17:
            break
    s = min(1.0, s)
    rest = min(1.0, max(0.0, 1 - s + at))
    return (rest, s) if up else (s, rest)


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def hypergeometric_tail_arrays(x, good, total, draws) -> tuple[np.ndarray, np.ndarray]:
    """``hypergeometric_tail`` of whole arrays: one step of all sums that still change at a time."""
    x, good, total, draws = (np.rint(np.asarray(v, np.float64)) for v in (x, good, total, draws))
    lo, hi = np.maximum(0, draws + good - total), np.minimum(good, draws)
    inside = (x >= lo) & (x <= hi)
    k = np.where(inside, x, lo)
    lg = lambda v: _lgamma(v + 1).astype(np.float64)
    choose = lambda n, r: lg(n) - lg(r) - lg(n - r)
    at = np.exp(choose(good, k) + choose(total - good, draws - k) - choose(total, draws))
    up = k >= draws * good / np.maximum(total, 1)
    s, term, live = at.copy(), at.copy(), inside & np.where(up, k < hi, k > lo)
    while live.any():
        i = np.flatnonzero(live)
        j, g, t, d, u = k[i], good[i], total[i], draws[i], up[i]
        ratio = np.where(u, (g - j) * (d - j) / ((j + 1) * (t - g - d + j + 1)), j * (t - g - d + j) / ((g - j + 1) * (d - j + 1)))
        term[i] *= ratio
        k[i] = np.where(u, j + 1, j - 1)
        s[i] += term[i]
        live[i] = (term[i] >= s[i] * 1e-17) & np.where(u, k[i] < hi[i], k[i] > lo[i])
    s = np.minimum(1.0, s)
    rest = np.clip(1 - s + at, 0.0, 1.0)
    lower, upper = np.where(up, rest, s), np.where(up, s, rest)
    return np.where(x < lo, 0.0, np.where(x > hi, 1.0, lower)), np.where(x < lo, 1.0, np.where(x > hi, 0.0, upper))


def hypergeometric_tails(x: str, good: str, total: str, draws: str) -> Column:
    """Struct (lower, upper) of both inclusive tails, Arrow batches at a time."""

    @F.pandas_udf("lower double, upper double")
    def tails(x: pd.Series, g: pd.Series, t: pd.Series, d: pd.Series) -> pd.DataFrame:
        lower, upper = hypergeometric_tail_arrays(x, g, t, d)
        return pd.DataFrame({"lower": lower, "upper": upper})

    return tails(F.col(x).cast("double"), F.col(good).cast("double"), F.col(total).cast("double"), F.col(draws).cast("double"))


def p_adjust(df: DataFrame, p: str, out: str, method: str = "BH", keys: list[str] | None = None) -> DataFrame:
    """``df`` with adjusted p-values in ``out``, within ``keys``: BH, BY, bonferroni, holm, hochberg or
    none."""
    if not keys and method not in ("none", "bonferroni"):
        return _p_adjust_all(df, p, out, method)
    if not keys and method == "bonferroni":
        return df.crossJoin(F.broadcast(df.agg(F.count(p).alias("_n")))).withColumn(out, F.least(F.lit(1.0), F.col(p) * F.col("_n"))).drop("_n")
    keys = keys or []
    every = Window.partitionBy(*keys)
    n = F.count(p).over(every)
    rank = F.rank().over(every.orderBy(p)) + F.count(F.lit(1)).over(Window.partitionBy(*keys, p)) - 1
    down = every.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    if method == "none":
        return df.withColumn(out, F.col(p))
    if method == "bonferroni":
        return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * n))
    if method in ("BH", "BY"):
        c = F.lit(1.0) if method == "BH" else F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
        return df.withColumn("_r", F.col(p) * n * c / rank).withColumn(out, F.least(F.lit(1.0), F.min("_r").over(down))).drop("_r")
    first = F.rank().over(every.orderBy(p))
    if method == "holm":
        up = every.orderBy(p).rangeBetween(Window.unboundedPreceding, 0)
        return df.withColumn("_r", F.col(p) * (n - first + 1)).withColumn(out, F.least(F.lit(1.0), F.max("_r").over(up))).drop("_r")
    if method == "hochberg":
        return df.withColumn("_r", F.col(p) * (n - rank + 1)).withColumn(out, F.least(F.lit(1.0), F.min("_r").over(down))).drop("_r")
    raise BadInput("method is BH, BY, bonferroni, holm, hochberg or none")


def _p_adjust_all(df: DataFrame, p: str, out: str, method: str) -> DataFrame:
    """``p_adjust`` over the whole table, by range: a running minimum from the largest p down, or for
    holm a running maximum up. Nulls stay null and do not count."""
    known = cut(df.where(F.col(p).isNotNull()))
    n = known.count()
    c = sum(1.0 / i for i in range(1, n + 1)) if method == "BY" else 1.0
    if method in ("BH", "BY"):
        r = running(known, [F.desc(p)], out, lambda k: F.col(p) * F.lit(n * c) / (F.lit(n + 1) - k), "min", "_k")
    elif method == "hochberg":
        r = running(known, [F.desc(p)], out, lambda k: F.col(p) * k, "min", "_k")
    elif method == "holm":
        r = running(known, [F.asc(p)], out, lambda k: F.col(p) * (F.lit(n + 1) - k), "max", "_k")
    else:
        raise BadInput("method is BH, BY, bonferroni, holm, hochberg or none")
    r = r.withColumn(out, F.least(F.lit(1.0), out)).drop("_k")
    return r.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))
