"""Mixing sources to target weights."""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyad.llm import tokens
from polyad.plans.session import bounded, cut, need

#: Target tables with more rows are refused; they are hand-made reference data.
MAX_TARGETS = 1000
#: Tokens of a block at most; small mixes have smaller blocks, so that there are at least FINE of them.
BLOCK_TOKENS, FINE = 65_536, 20_000
#: Documents per shard aimed at, and shards of a source at most: what the driver sees has this bound.
SHARD_DOCS, MAX_SHARDS = 50_000, 16_384


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), ties by position, never above a cap; seats
    that no one can take stay empty. All quotients above a divisor are dealt at once and only the
    last few one by one, so the work does not grow with the number of seats."""
    exact = [Fraction(w) if w > 0 else Fraction(0) for w in weights]
    least = [(w, c) for w, c in zip(exact, caps, strict=True) if w and c > 0]
    if not least or seats <= 0:
        return [0] * len(weights)
    if sum(c for _, c in least) <= seats:
        return [c if w else 0 for w, c in zip(exact, caps, strict=True)]

    def dealt(divisor: Fraction) -> list[int]:  # seats with weight / (2 k + 1) > divisor
        return [max(0, min(c, -(-(w / divisor - 1) // 2))) if w else 0 for w, c in zip(exact, caps, strict=True)]

    low, high = Fraction(min(float(w) for w, _ in least)) / (4 * seats + 4), max(w for w, _ in least)
    while sum(dealt(low)) < seats:
        low /= 16
    for _ in range(80):  # the largest divisor that deals no more than the seats, near enough
        mid = Fraction((float(low) + float(high)) / 2)
        if not low < mid < high:
            break
        low, high = (mid, high) if sum(dealt(mid)) > seats else (low, mid)
    got = [int(x) for x in dealt(high)]
    heap = [(-w / (2 * g + 1), i) for i, (w, g) in enumerate(zip(exact, got, strict=True)) if w and g < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-exact[i] / (2 * got[i] + 1), i))
    return got


def source_key(source: str):
    """Sources compare without case and surrounding white space; blank is null."""
    s = F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))
    return F.when(s != "", s)


class Mix:
    """The chosen documents and the report of one mix."""

    def __init__(self, chosen: DataFrame, targets: list[dict], total: int, block: int):
        self._chosen, self.targets, self.total, self.block = chosen, targets, total, block

    def documents(self) -> DataFrame:
        """(doc_id, source, n_tokens, copies), one row per document used."""
        return self._chosen.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")

    def shares(self) -> DataFrame:
        """One row per target source: (source, target_share, max_repeats, available_tokens,
        quota_blocks, mixed_tokens, actual_share, most_copies). A target without documents has 0."""
        spark = self._chosen.sparkSession
        plan = spark.createDataFrame([(t["source"], t["share"], t["repeats"], t["tokens"], t["quota"]) for t in self.targets], "source string, target_share double, max_repeats int, available_tokens long, quota_blocks long")
        used = self._chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("m"), F.max("copies").alias("most_copies"))
        j = plan.join(used, "source", "left").withColumn("mixed_tokens", F.coalesce("m", F.lit(0)))
        every = j.agg(F.sum("mixed_tokens").alias("every"))
        return j.crossJoin(F.broadcast(every)).select("source", "target_share", "max_repeats", "available_tokens", "quota_blocks", "mixed_tokens", F.coalesce(F.col("mixed_tokens") / F.nullif("every", F.lit(0)), F.lit(0.0)).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))


def mix_sources(documents: DataFrame, targets: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", total_tokens: int | None = None, seed: int = 42, root: str = tokens.ROOT, name: str = tokens.NAME, sizes: DataFrame | None = None) -> Mix:
    """Documents and how often each is used, so that every source gets its target share of tokens.

    ``targets`` is (source, target_share, max_repeats). ``total_tokens`` defaults to the largest
    mix in which every source that has documents reaches its share within its repeats; a larger
    total is cut down for the sources that run out, and ``shares()`` shows what was reached.
    Targets without documents get nothing and the others grow in proportion; documents of sources
    without a target are not used. Sources compare without case and surrounding white space;
    targets that are then equal add their shares and take the smaller max_repeats. Null shares and
    repeats count as 0. Documents without a token, without a source or without an ident are not
    used; rows with one ident are one document, the least (source, size). An empty table gives an
    empty mix.

    The mix is cut into equal-token blocks, which Sainte-Lague apportionment gives to the sources
    and, within a source, to shards of its documents by their tokens; the quotas are integers. In a
    shard documents lie in seeded order, cut into blocks; every full pass over it is one copy of all
    its documents, and the rest of the quota goes to its blocks in the order of a seeded hash. A
    document longer than a block takes as many seats as it fills, if it still finds them; the
    others then fill what is left to within one of them, so that long texts shift no share; where
    they would run out, long ones that were passed over are taken before them, by size.
    The driver sees sums per source and shard only; a large source has many shards.
    """
    need(documents, ident, source, text)
    need(targets, "source", "target_share", "max_repeats")
    spark = documents.sparkSession
    want = targets.select(source_key("source").alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("repeats")).where("source is not null")
    want = want.groupBy("source").agg(F.sum("share").alias("share"), F.min("repeats").alias("repeats")).orderBy("source").limit(MAX_TARGETS + 1).collect()
    if len(want) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    plan = [{"source": r["source"], "share": max(0.0, r["share"]), "repeats": max(0, r["repeats"]), "tokens": 0, "docs": 0, "quota": 0} for r in want]
    src = documents.select(F.col(ident).alias("doc_id"), source_key(source).alias("source"), F.col(text).alias("text")).where("doc_id is not null")
    known = src.where(F.col("source").isin([t["source"] for t in plan])) if plan else src.limit(0)
    if sizes is None:
        packed = known.select(F.struct("doc_id", "source").alias("key"), "text")
        sized = tokens.encode(packed, "key", "text", root, name, count_only=True).select("key.doc_id", "key.source", "n_tokens")
    else:
        sized = known.join(sizes.select("doc_id", "n_tokens"), "doc_id").select("doc_id", "source", "n_tokens")
    sized = sized.where("n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("x")).select("doc_id", "x.*")
    sized = cut(sized)
    have = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("d")).collect()}
    for t in plan:
        if t["source"] in have:
            t["tokens"], t["docs"] = have[t["source"]]["t"], have[t["source"]]["d"]
    live = [t for t in plan if t["tokens"] and t["share"] > 0 and t["repeats"] > 0]
    n_docs, all_tokens, weight = sum(t["docs"] for t in live), sum(t["tokens"] for t in live), sum(t["share"] for t in live)
    if not live:
        return Mix(sized.select("*", F.lit(0).alias("copies")).limit(0), plan, 0, 0)
    total = int(total_tokens or min(t["tokens"] * t["repeats"] * weight / t["share"] for t in live))
    block = max(1, min(BLOCK_TOKENS, max(total // FINE, 2 * all_tokens // n_docs)))
    shards = {t["source"]: min(MAX_SHARDS, max(1, t["docs"] // SHARD_DOCS)) for t in live}
    of = F.create_map(*[F.lit(x) for kv in sorted(shards.items()) for x in kv])
    sharded = sized.where(F.col("source").isin(sorted(shards))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), of[F.col("source")]).cast("int"))
    sums = sharded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")).collect()
    by_source: dict[str, list] = {}
    for r in sorted(sums, key=lambda r: (r["source"], r["shard"])):
        by_source.setdefault(r["source"], []).append((r["shard"], r["t"]))
    most = [[-(-tok * t["repeats"] // block) for _, tok in by_source[t["source"]]] for t in live]
    rows = []
    for t, quota, caps in zip(live, sainte_lague([t["share"] for t in live], total // block, [sum(c) for c in most]), most, strict=True):
        t["quota"], own = quota, by_source[t["source"]]
        for (shard, tok), q in zip(own, sainte_lague([x[1] for x in own], quota, caps), strict=True):
            passes, rest = divmod(min(q * block, tok * t["repeats"]), tok)
            rows.append((t["source"], shard, tok, -(-tok // block), passes, rest))
    quotas = spark.createDataFrame(rows, "source string, shard int, shard_tokens long, n_blocks long, passes int, rest long")
    in_shard = Window.partitionBy("source", "shard")
    upto = (Window.unboundedPreceding, 0)
    placed = sharded.withColumn("at", F.sum("n_tokens").over(in_shard.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(*upto)) - F.col("n_tokens"))
    placed = placed.join(bounded(quotas), ["source", "shard"]).withColumn("b", F.floor(F.col("at") / F.col("shard_tokens") * F.col("n_blocks")))
    drawn = in_shard.orderBy(F.xxhash64(F.lit(seed), "source", "shard", "b"), "b", "at", "doc_id").rowsBetween(*upto)
    long = F.col("n_tokens") > block
    placed = placed.withColumns({"all": F.sum("n_tokens").over(drawn), "short": F.sum(F.when(long, 0).otherwise(F.col("n_tokens"))).over(drawn)})
    first = long & (F.col("all") <= F.col("rest"))
    by_size = in_shard.orderBy(F.when(long & ~first, F.col("n_tokens")).asc_nulls_last(), "b", "at", "doc_id").rowsBetween(*upto)
    placed = placed.withColumns({
        "taken": F.coalesce(F.sum(F.when(first, F.col("n_tokens"))).over(in_shard), F.lit(0)),
        "shorts": F.sum(F.when(long, 0).otherwise(F.col("n_tokens"))).over(in_shard),
        "late": F.sum(F.when(long & ~first, F.col("n_tokens")).otherwise(0)).over(by_size),
    })
    # where the short ones cannot fill what is left, long ones that were passed over come first, by size
    open_ = F.col("rest") - F.col("taken")
    second = long & ~first & (F.col("late") - F.col("n_tokens") < open_ - F.col("shorts")) & (F.col("late") <= open_)
    placed = placed.withColumn("second", second).withColumn("also", F.sum(F.when(F.col("second"), F.col("n_tokens")).otherwise(0)).over(in_shard))
    extra = F.when(long, first | F.col("second")).otherwise(F.col("short") <= open_ - F.col("also"))
    return Mix(placed.withColumn("copies", F.col("passes") + extra.cast("int")), plan, total, block)
