"""Fixed points of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.errors import NoConverge
from polyad.plans.session import cut

#: Rounds between two lineage cuts; a plan holds this many rounds.
EVERY = 4


def fixed_point(x: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], value: str, iterations: int, tol: float, every: int = EVERY) -> DataFrame:
    """``step`` applied to ``x`` until no value of a key moves by ``tol`` or more over ``every`` rounds.

    Every ``every`` rounds the frame is materialised in the shared checkpoint folder and compared
    with the one before it; one number comes to the driver. Raises NoConverge if ``iterations``
    rounds do not settle it; with ``tol`` 0 exactly ``iterations`` rounds are made."""
    x, done, gap = cut(x), 0, 0.0
    while done < iterations:
        new = x
        for _ in range(min(every, iterations - done)):
            new = step(new)
            done += 1
        new = cut(new)
        if tol > 0:
            pair = new.join(x.withColumnRenamed(value, "_was"), keys, "full")
            gap = pair.agg(F.max(F.abs(F.coalesce(value, F.lit(0.0)) - F.coalesce("_was", F.lit(0.0))))).first()[0] or 0.0
            if gap < tol:
                return new
        x = new
    if tol > 0:
        raise NoConverge(f"values still move by {gap:.3g} after {iterations} rounds")
    return x
