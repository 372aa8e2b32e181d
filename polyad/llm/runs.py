"""Repeated consecutive events: collapsing runs of one code to one event."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyad.plans import hot
from polyad.plans.session import bounded, cut, need

#: A codebook is hand-made reference data; more entries than this are refused.
MAX_CODEBOOK = 5000


def _fold_table() -> tuple[str, str]:
    """Characters and their base letters, from Unicode's compatibility decompositions: accented
    Latin letters, full-width forms and the like."""
    src, dst = [], []
    for a, z in ((0xA0, 0x250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F)):
        for o in range(a, z):
            base = "".join(c for c in unicodedata.normalize("NFKD", chr(o)) if not unicodedata.combining(c))
            if len(base) == 1 and base != chr(o) and ord(base) < 128:
                src.append(chr(o))
                dst.append(base)
    return "".join(src), "".join(dst)


def fold(text: Column) -> Column:
    """Lower case without accents, with full-width characters as plain ones."""
    src, dst = _fold_table()
    return F.lower(F.regexp_replace(F.translate(text, src, dst), r"\p{M}+", ""))


def code_key(text: Column) -> Column:
    """A code without what hands add: a speaker or quote mark before it, a repeat count or remark
    after it, case, accents and separators."""
    t = F.regexp_replace(fold(text), r"^[\s>]*([a-z]+\s*:)?[\s>]*", "")
    t = F.regexp_replace(t, r"(\s*\(\d+\)|\s*#\s*\d+|[_\s]+\d+|\s+x\s*\d+|\s*\[[^\]]*\]|[.,;:!\s]+)+$", "")
    return F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")


def resolve_code(text: Column, codebook: DataFrame) -> Column:
    """The codebook entry that ``text`` writes, or null: by ``code_key`` equal to the key of a
    code or of its short form, else by one slip (a letter lost, doubled, changed or swapped with
    its neighbour) from exactly one code. JVM expressions only; slips are tried only on codes that
    match nothing. The codebook (code, short) is fixed reference data of at most MAX_CODEBOOK rows."""
    rows = codebook.select("code", code_key(F.col("code")).alias("k"), code_key(F.col("short")).alias("s")).where("code is not null").limit(MAX_CODEBOOK + 1).collect()
    if len(rows) > MAX_CODEBOOK:
        raise ValueError(f"a codebook of more than {MAX_CODEBOOK} rows")
    exact: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: r["code"]):
        for k in (r["k"], r["s"]):
            if k:
                exact.setdefault(k, r["code"])
    if not exact:
        return F.lit(None).cast("string")
    long = sorted({r["k"]: r["code"] for r in rows if r["k"] and len(r["k"]) > 4}.items())
    key = code_key(text)
    table = F.create_map(*[F.lit(x) for kv in sorted(exact.items()) for x in kv])
    letters = lambda c: F.array_sort(F.split(c, ""))
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in long]) if long else None

    def near(e: Column) -> Column:
        d = F.levenshtein(e["k"], key)
        swapped = (d == 2) & (F.length(e["k"]) == F.length(key)) & (letters(e["k"]) == letters(key))
        return (d <= 1) | swapped

    hit = table[key]
    if entries is None:
        return hit
    close = F.filter(entries, near)
    slip = F.when(F.length(key) > 3, F.when(F.size(close) == 1, close[0]["c"]))
    return F.coalesce(hit, slip)


def collapse_runs(turns: DataFrame, key: str, at: str, ident: str, code: str, codebook: DataFrame | None = None, rows_per_task: int = hot.ROWS_PER_TASK) -> DataFrame:
    """One row per run: (key, code, n_events, first_id, last_id, first_s, last_s, duration_s). A run
    is a longest stretch of neighbouring rows of a key with one code; runs of one row are included.

    ``at`` is a unix time; values above 10^11 are milliseconds and are cut to seconds. Order is
    (second, id). Rows with one id are one event: the smallest row of (key, second, code). Rows
    without key, time or id are left out; a code that is null, blank or not in the codebook ends a
    run and is in none. Without a codebook codes are compared as ``code_key`` folds them. Empty
    tables give no rows; other columns are ignored; durations are from first to last event.

    Boundary rows only: ``lag`` finds rows that differ from their predecessor, all others but the
    last are dropped, and ``lead`` over what is left gives counts as differences of positions and
    ends as the time before the next boundary. Keys with more rows than a task should take are cut by time (``plans.hot``); runs that
    touch a cut, at most two a part, are joined afterwards.
    """
    need(turns, key, at, ident, code)
    src = turns.select(F.col(key).cast("string").alias("k"), F.col(at).cast("long").alias("t"), F.col(ident).cast("long").alias("i"), F.col(code).cast("string").alias("c"))
    src = src.where("k is not null and t is not null and i is not null")
    src = src.withColumn("t", F.when(F.col("t") > 100_000_000_000, F.floor(F.col("t") / 1000)).otherwise(F.col("t")).cast("long"))
    cuts = hot.hot_cuts(src, ["k"], "t", rows_per_task)
    one = src.groupBy("i").agg(F.min(F.struct("k", "t", "c")).alias("x")).select("i", "x.*")
    # each writing of a code is resolved once, not each row
    named = resolve_code(F.col("c"), codebook) if codebook is not None else F.when(code_key(F.col("c")) != "", code_key(F.col("c")))
    writings = cut(src.select("c").where("c is not null").distinct().withColumn("named", named).where("named is not null"))
    one = one.join(bounded(writings), "c", "left").select("i", "k", "t", F.col("named").alias("c"))
    rows = hot.with_parts(one, ["k"], "t", cuts)
    w = Window.partitionBy("k", "_part").orderBy("t", "i")
    rows = rows.withColumns({
        "pos": F.row_number().over(w),
        "pc": F.lag("c").over(w), "pt": F.lag("t").over(w), "pi": F.lag("i").over(w),
        "last": F.lead("i").over(w).isNull(),
    })
    rows = rows.withColumn("bound", (F.col("pos") == 1) | ~F.col("c").eqNullSafe(F.col("pc")) | F.col("c").isNull())
    kept = rows.where("bound or last")
    nxt = {"n_pos": "pos", "n_pt": "pt", "n_pi": "pi", "n_t": "t", "n_i": "i", "n_bound": "bound"}
    kept = kept.withColumns({k: F.lead(v).over(w) for k, v in nxt.items()}).where("bound")
    runs = kept.select(
        "k", "_part", "_hot", "c", F.col("i").alias("first_id"), F.col("t").alias("first_s"),
        F.expr("case when n_pos is null then i when n_bound then n_pi else n_i end").alias("last_id"),
        F.expr("case when n_pos is null then t when n_bound then n_pt else n_t end").alias("last_s"),
        F.expr("cast(case when n_pos is null then 1 when n_bound then n_pos - pos else n_pos - pos + 1 end as long)").alias("n"),
        (F.col("pos") == 1).alias("head"), F.expr("n_pos is null or not n_bound").alias("tail"),
    )
    if cuts is None:
        out = runs.where("c is not null")
    else:
        runs = cut(runs)
        touch = F.col("_hot") & (F.col("head") | F.col("tail"))
        over = Window.partitionBy("k").orderBy("first_s", "first_id")
        same = F.col("c").eqNullSafe(F.lag("c").over(over)) & F.col("c").isNotNull() & F.col("head") & F.lag("tail").over(over)
        edge = runs.where(touch).withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("g", F.sum("new").over(over))
        edge = edge.groupBy("k", "g", "c").agg(
            F.min("first_s").alias("first_s"), F.min_by("first_id", F.struct("first_s", "first_id")).alias("first_id"),
            F.max("last_s").alias("last_s"), F.max_by("last_id", F.struct("last_s", "last_id")).alias("last_id"), F.sum("n").alias("n"),
        )
        cols = ["k", "c", "n", "first_id", "last_id", "first_s", "last_s"]
        out = runs.where(~touch).select(*cols).unionByName(edge.select(*cols)).where("c is not null")
    return out.select(
        F.col("k").alias(key), F.col("c").alias("code"), F.col("n").alias("n_events"), "first_id", "last_id", "first_s", "last_s",
        (F.col("last_s") - F.col("first_s")).alias("duration_s"),
    )
