"""Sequences of states: preparation, k-grams and what follows from their counts.

A table of sequences is (seq_id STRING, pos INT, state STRING), pos from 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyad.errors import BadInput, DenseTooLarge, LongFormat, NotErgodic
from polyad.plans.rank import numbered, with_total
from polyad.plans.session import cut, need

MAX_STATES = 4000


def from_events(events: DataFrame, actor: list[str], order: list[str], action: str, session: list[str] | None = None, gap_seconds: float | None = None, time: str | None = None) -> DataFrame:
    """Sequences of a long event table: one per actor (and session), cut where two neighbours are
    more than ``gap_seconds`` apart in ``time``. Rows with a null actor or action are left out."""
    keys = [*actor, *(session or [])]
    need(events, *keys, *order, action)
    rows = events.where(" and ".join(f"`{k}` is not null" for k in [*keys, action]))
    w = Window.partitionBy(*keys).orderBy(*order)
    name = [F.col(k).cast("string") for k in keys]
    if gap_seconds is None:
        seq = F.concat_ws("|", *name)
        base = rows.withColumn("seq_id", seq)
    else:
        t = F.unix_micros(F.col(time or order[0]).cast("timestamp"))
        gap = t - F.lag(t).over(w) > F.lit(int(gap_seconds * 1_000_000))
        base = rows.withColumn("_cut", F.coalesce(gap.cast("int"), F.lit(0)))
        base = base.withColumn("_run", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        base = base.withColumn("seq_id", F.concat_ws("|", *name, F.col("_run").cast("string")))
    w2 = w if gap_seconds is None else Window.partitionBy(*keys, "_run").orderBy(*order)
    return base.select("seq_id", F.row_number().over(w2).alias("pos"), F.col(action).cast("string").alias("state"))


def from_wide(wide: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """Wide rows T1..Tn; trailing nulls end a sequence, inner nulls stay as gaps. A table with
    columns that look like a long event table is refused."""
    if len({c.lower() for c in wide.columns} & {"action", "time", "session", "session_id"}) >= 2:
        raise LongFormat("this looks like a long event table; use from_events")
    arr = F.array(*[F.col(c).cast("string") for c in columns])
    end = F.array_max(F.transform(arr, lambda x, i: F.when(x.isNotNull(), i)))
    rows = wide.select(F.col(ident).cast("string").alias("seq_id"), F.posexplode(arr).alias("p", "state"), end.alias("e"))
    return rows.where("p <= e").select("seq_id", (F.col("p") + 1).alias("pos"), "state")


def collapse_repeats(seqs: DataFrame, least: int = 2) -> DataFrame:
    """Neighbouring equal states as one; sequences shorter than ``least`` after that are dropped."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    kept = seqs.withColumns({"_p": F.lag("state").over(w), "_n": F.row_number().over(w)})
    kept = kept.where((F.col("_n") == 1) | ~F.col("_p").eqNullSafe(F.col("state")))
    out = kept.select("seq_id", F.row_number().over(w).alias("pos"), "state", F.count(F.lit(1)).over(Window.partitionBy("seq_id")).alias("_len"))
    return out.where(F.col("_len") >= least).drop("_len")


def state_sets(seqs: DataFrame, group: DataFrame, top: int = 8) -> DataFrame:
    """(group, members, n, share, rank): per group of sequences, the most frequent distinct state
    sets; ties by members. ``group`` is (seq_id, group)."""
    sets = seqs.where("state is not null").groupBy("seq_id").agg(F.array_sort(F.collect_set("state")).alias("s"))
    g = sets.join(group, "seq_id").groupBy("group", F.array_join("s", " + ").alias("members")).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("group")
    g = g.withColumn("share", F.col("n") / F.sum("n").over(total))
    g = g.withColumn("rank", F.row_number().over(total.orderBy(F.desc("n"), "members")))
    return g.where(F.col("rank") <= top)


def kgrams(seqs: DataFrame, max_order: int, keys: list[str] | None = None) -> DataFrame:
    """(keys..., order, context array, target, count) for every window of 1..max_order states and
    the state after it; windows with a null state do not count. One shuffle by sequence, then
    counts combined before the second."""
    keys = keys or []
    w = Window.partitionBy(*keys, "seq_id").orderBy("pos")
    led = seqs.select(*keys, "seq_id", "pos", F.col("state").alias("s0"), *[F.lead("state", i).over(w).alias(f"s{i}") for i in range(1, max_order + 1)])
    grams = F.array(*[F.struct(F.lit(k).alias("order"), F.array(*[F.col(f"s{i}") for i in range(k)]).alias("context"), F.col(f"s{k}").alias("target")) for k in range(1, max_order + 1)])
    rows = led.select(*keys, F.explode(grams).alias("g")).select(*keys, "g.*").where("target is not null and not exists(context, x -> x is null)")
    return rows.groupBy(*keys, "order", "context", "target").agg(F.count(F.lit(1)).alias("count"))


def distributions(counts: DataFrame, min_freq: int = 1, keys: list[str] | None = None) -> DataFrame:
    """``counts`` with ``total`` and ``probability`` of the target given its context; counts below
    ``min_freq`` are dropped before totals are taken."""
    w = Window.partitionBy(*(keys or []), "order", "context")
    kept = counts.where(F.col("count") >= min_freq).withColumn("total", F.sum("count").over(w))
    return kept.withColumn("probability", F.col("count") / F.col("total"))


def memory_rules(seqs: DataFrame, max_order: int = 5, min_freq: int = 1) -> DataFrame:
    """(context array, order, target, count, probability): rules of the variable-order network.

    Growth starts at every single state; a longer context is accepted if its distribution differs
    from the last accepted one by more than order / log2(1 + total) bits; growth goes on from
    rejected contexts too, against the same accepted one. Where it ends, the accepted context and
    its prefixes are rules. ``max_order`` joins, no recursion."""
    d = cut(distributions(kgrams(seqs, max_order), min_freq))
    ctx = d.select("order", "context", "total").distinct()
    frontier = ctx.where("order = 1").select(F.col("context").alias("curr"), F.col("context").alias("valid"))
    done: list[DataFrame] = []
    for k in range(1, max_order):
        ext = ctx.where(F.col("order") == k + 1).select(F.col("context").alias("ext"), F.slice("context", 2, k).alias("curr"), "total")
        done.append(frontier.join(ext.select("curr").distinct(), "curr", "left_anti").select("valid"))
        pair = frontier.join(ext, "curr").select("ext", "valid", "total")
        p = d.where(F.col("order") == k + 1).select(F.col("context").alias("ext"), "target", F.col("probability").alias("p"))
        q = d.select(F.col("context").alias("valid"), "target", F.col("probability").alias("q"))
        kl = pair.join(p, "ext").join(q, ["valid", "target"], "left").groupBy("ext", "valid", "total").agg(F.sum(F.when(F.col("q").isNull(), F.lit(float("inf"))).otherwise(F.col("p") * F.log2(F.col("p") / F.col("q")))).alias("kl"))
        better = F.col("kl") > F.lit(k + 1) / F.log2(F.lit(1) + F.col("total"))
        frontier = cut(kl.select(F.col("ext").alias("curr"), F.when(better, F.col("ext")).otherwise(F.col("valid")).alias("valid")))
    done.append(frontier.select("valid"))
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    rules = every.distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size("valid")), lambda n: F.slice("valid", 1, n))).alias("context")).distinct()
    return rules.join(d, "context").select("context", "order", "target", "count", "probability")


def rule_label(context: Column) -> Column:
    return F.array_join(context, " -> ")


def memory_network(rules: DataFrame) -> DataFrame:
    """(path, source, destination, count, probability, from_order, to_order): each rule as an edge
    from its context to the longest known context that ends (context, target)."""
    known = rules.select(F.col("context").alias("cand"), F.col("order").alias("to_order")).distinct()
    full = rules.withColumn("full", F.concat("context", F.array("target")))
    cands = full.withColumn("cand", F.explode(F.transform(F.sequence(F.lit(1), F.size("full")), lambda n: F.slice("full", F.size("full") - n + 1, n))))
    j = cands.join(known, "cand", "left").where("to_order is not null or size(cand) = 1")
    w = Window.partitionBy("context", "target").orderBy(F.desc(F.size("cand")))
    best = j.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.select(rule_label(F.col("full")).alias("path"), rule_label(F.col("context")).alias("source"), rule_label(F.col("cand")).alias("destination"), "count", "probability", F.col("order").alias("from_order"), F.size("cand").alias("to_order"))


def path_counts(seqs: DataFrame, length: int, top: int | None = None) -> DataFrame:
    """(path, count, proportion, rank) of paths of ``length`` states; count descending, then path."""
    g = kgrams(seqs, length - 1).where(F.col("order") == length - 1) if length > 1 else seqs.where("state is not null").groupBy(F.array("state").alias("context"), F.lit(None).cast("string").alias("target")).count()
    path = F.concat_ws(" -> ", F.col("context"), F.col("target")) if length > 1 else F.col("context")[0]
    g = g.select(path.alias("path"), "count")
    total = g.agg(F.sum("count").alias("_t"))
    g = g.crossJoin(F.broadcast(total)).select("path", "count", F.round(F.col("count") / F.col("_t"), 4).alias("proportion"))
    if top is not None:  # only the head is sorted
        g = g.orderBy(F.desc("count"), "path").limit(top)
    return numbered(g, F.desc("count"), "path")


def path_dependence(seqs: DataFrame, order: int = 2, min_count: int = 5, base: float = 2.0) -> DataFrame:
    """Per context of ``order`` states: count, entropy of the next state given the last one and
    given the context, their difference, divergence, the likeliest states and whether they differ."""
    g = cut(distributions(kgrams(seqs, order)))
    ln = F.log(F.lit(base))
    one = g.where("order = 1").select(F.element_at("context", -1).alias("last"), "target", F.col("probability").alias("q"))
    h1 = one.groupBy("last").agg((-F.sum(F.col("q") * F.log("q") / ln)).alias("entropy_first"), F.max_by("target", F.struct(F.col("q"), F.col("target"))).alias("likeliest_first"))
    hi = g.where((F.col("order") == order) & (F.col("total") >= min_count)).withColumn("last", F.element_at("context", -1))
    j = hi.join(one, ["last", "target"], "left").groupBy("context", "last", "total").agg(
        (-F.sum(F.col("probability") * F.log("probability") / ln)).alias("entropy_order"),
        F.sum(F.col("probability") * F.log(F.col("probability") / F.col("q")) / ln).alias("divergence"),
        F.max_by("target", F.struct(F.col("probability"), F.col("target"))).alias("likeliest_order"),
    )
    j = j.join(h1, "last")
    return j.select(rule_label(F.col("context")).alias("context"), F.col("total").alias("count"), "entropy_first", "entropy_order", (F.col("entropy_first") - F.col("entropy_order")).alias("entropy_drop"), "divergence", "likeliest_first", "likeliest_order", (F.col("likeliest_first") != F.col("likeliest_order")).alias("flips"))


def order_tests(seqs: DataFrame, max_order: int = 3) -> DataFrame:
    """(order, g2): likelihood ratio of each order against the one below, over the windows of that
    order: 2 sum n_cjk ln(n_cjk n_j / (n_cj n_jk)) with c the first state and j the rest."""
    g = kgrams(seqs, max_order).select("order", F.element_at("context", 1).alias("c"), F.when(F.size("context") > 1, rule_label(F.slice("context", 2, 100))).otherwise(F.lit("")).alias("j"), "target", "count")
    g = g.withColumns({
        "n_cj": F.sum("count").over(Window.partitionBy("order", "c", "j")),
        "n_jk": F.sum("count").over(Window.partitionBy("order", "j", "target")),
        "n_j": F.sum("count").over(Window.partitionBy("order", "j")),
    })
    n = F.col("count").cast("double")
    return g.groupBy("order").agg((2 * F.sum(n * F.log(n * F.col("n_j") / (F.col("n_cj").cast("double") * F.col("n_jk"))))).alias("g2"))


def model_scores(seqs: DataFrame, max_order: int = 3, from_order: int = 1) -> DataFrame:
    """(order, log_likelihood, n_contexts, parameters, aic, bic, n) of each fixed order. Parameters
    are the observed transitions less one per context. Order 0 (``from_order`` 0) is the distribution of
    all states; it has one empty context."""
    d = distributions(kgrams(seqs, max_order)).select("order", "context", "count", "probability")
    if from_order == 0:
        zero = seqs.where("state is not null").groupBy("state").agg(F.count(F.lit(1)).alias("count"))
        zero = with_total(cut(zero), every="count")
        d = d.unionByName(zero.select(F.lit(0).alias("order"), F.array().cast("array<string>").alias("context"), "count", (F.col("count") / F.col("every")).alias("probability")))
    s = d.groupBy("order").agg(F.sum(F.col("count") * F.log("probability")).alias("log_likelihood"), F.count_distinct("context").alias("n_contexts"), F.count(F.lit(1)).alias("_m"), F.sum("count").alias("n"))
    k = F.col("_m") - F.col("n_contexts")
    return s.select("order", "log_likelihood", "n_contexts", k.alias("parameters"), (2 * k - 2 * F.col("log_likelihood")).alias("aic"), (k * F.log("n") - 2 * F.col("log_likelihood")).alias("bic"), "n")


def choose_order(scores: DataFrame, criterion: str = "aic") -> DataFrame:
    """(order, criterion, value): the order of least aic or bic, ties to the lower order."""
    if criterion not in ("aic", "bic"):
        raise BadInput("criterion is aic or bic")
    return scores.orderBy(criterion, "order").limit(1).select("order", F.lit(criterion).alias("criterion"), F.col(criterion).alias("value"))


def from_documents(docs: DataFrame, actor: str, order_by: str, state: str, ident: str = "doc_id", clusters: DataFrame | None = None) -> DataFrame:
    """Sequences of an actor's documents in the order of ``order_by``, ties by ident as text; the state is
    a column or, with ``clusters`` (doc, cluster), the cluster of the document. A missing actor, time
    or state is refused."""
    need(docs, actor, order_by, ident, *([] if clusters is not None else [state]))
    d = docs.select(F.col(actor).cast("string").alias("seq_id"), F.col(order_by).alias("_t"), F.col(ident).cast("string").alias("_d"), *([] if clusters is not None else [F.col(state).cast("string").alias("state")]))
    if clusters is not None:
        d = d.join(clusters.select(F.col("doc").alias("_d"), F.col("cluster").cast("string").alias("state")), "_d", "left")
    if d.where("seq_id is null or _t is null or state is null").limit(1).count():
        raise BadInput("an actor, a time or a state is missing")
    return d.select("seq_id", F.row_number().over(Window.partitionBy("seq_id").orderBy("_t", "_d")).alias("pos"), "state")


_SEP = "\x1f"


def memory_rules_by_group(seqs: DataFrame, groups: DataFrame, max_order: int = 5, min_freq: int = 1) -> DataFrame:
    """(grp, context array, order, target, count, probability): ``memory_rules`` of each group of sequences
    (seq_id, grp), all groups in the same joins: states carry their group's name while rules grow, so
    no context lies in two groups. Sequences without a group are left out."""
    named = seqs.join(groups.where("grp is not null").select("seq_id", F.col("grp").cast("string").alias("grp")), "seq_id")
    r = memory_rules(named.select("seq_id", "pos", F.concat("grp", F.lit(_SEP), "state").alias("state")), max_order, min_freq)
    plain = lambda c: F.element_at(F.split(c, _SEP), 2)
    return r.select(F.split("target", _SEP)[0].alias("grp"), F.transform("context", plain).alias("context"), "order", plain(F.col("target")).alias("target"), "count", "probability")


def transition_matrix(seqs: DataFrame) -> tuple[list[str], np.ndarray]:
    """States in code point order and their counts of transitions, on the driver; guarded."""
    g = kgrams(seqs, 1).select(F.col("context")[0].alias("a"), F.col("target").alias("b"), "count")
    rows = g.limit(MAX_STATES * 250 + 1).collect()
    states = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    if len(states) > MAX_STATES or len(rows) > MAX_STATES * 250:
        raise DenseTooLarge(f"more than {MAX_STATES} states")
    at = {s: i for i, s in enumerate(states)}
    m = np.zeros((len(states), len(states)))
    for r in rows:
        m[at[r["a"]], at[r["b"]]] = r["count"]
    return states, m


def chain_stability(p: np.ndarray) -> dict[str, np.ndarray]:
    """persistence, stationary, return_time, sojourn and first_passage of an irreducible chain."""
    n = len(p)
    p = p / p.sum(1, keepdims=True)
    reach = (np.linalg.matrix_power(np.eye(n) + (p > 0), n) > 0) if n else np.zeros((0, 0), bool)
    if not reach.all():
        raise NotErgodic("the chain is reducible")
    pi = np.linalg.solve(np.vstack([(np.eye(n) - p.T)[:-1], np.ones(n)]), np.append(np.zeros(n - 1), 1.0))
    z = np.linalg.inv(np.eye(n) - p + np.outer(np.ones(n), pi))
    first = (np.diag(z)[None, :] - z) / pi[None, :]
    first[np.diag_indices(n)] = 1 / pi
    stay = np.diag(p)
    return {"persistence": stay, "stationary": pi, "return_time": 1 / pi, "sojourn": np.divide(1, 1 - stay, out=np.full(n, np.inf), where=stay < 1), "first_passage": first}


def markov_stability(seqs: DataFrame) -> DataFrame:
    """(state, persistence, stationary, return_time, sojourn, mean_first_passage) per state."""
    states, m = transition_matrix(seqs)
    if (m.sum(1) == 0).any():
        raise NotErgodic("a state has no successor: " + ", ".join(s for s, x in zip(states, m.sum(1), strict=True) if not x))
    r = chain_stability(m)
    off = r["first_passage"].copy()
    np.fill_diagonal(off, 0)
    mean = off.sum(0) / max(1, len(states) - 1)
    rows = [(s, *(float(r[k][i]) for k in ("persistence", "stationary", "return_time", "sojourn")), float(mean[i])) for i, s in enumerate(states)]
    return seqs.sparkSession.createDataFrame(rows, "state string, persistence double, stationary double, return_time double, sojourn double, mean_first_passage double")


def bootstrap(seqs: DataFrame, n_boot: int = 100, order: int = 1, level: float = 0.95, seed: int = 1) -> DataFrame:
    """(context, target, probability, lower, upper, support): sequences drawn with replacement.
    Counts are taken once per sequence; replicates only reweight them."""
    if not 0 < level < 1:
        raise BadInput("level lies between 0 and 1")
    per = cut(kgrams(seqs.withColumn("_s", F.col("seq_id")), order, ["_s"]).where(F.col("order") == order))
    ids = numbered(seqs.select("seq_id").distinct(), "seq_id", name="k").withColumn("k", F.col("k") - 1)
    ids = cut(ids)
    n = ids.count()
    reps = seqs.sparkSession.range(n_boot).withColumnRenamed("id", "rep")
    draws = reps.crossJoin(ids.select(F.col("k").alias("i"))).select("rep", F.pmod(F.xxhash64(F.lit(seed), "rep", "i"), F.lit(n)).cast("int").alias("k"))
    weight = draws.groupBy("rep", "k").agg(F.count(F.lit(1)).alias("w")).join(ids, "k").select("rep", F.col("seq_id").alias("_s"), "w")
    b = per.join(weight, "_s").groupBy("rep", "context", "target").agg(F.sum(F.col("count") * F.col("w")).alias("c"))
    b = b.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("rep", "context")))
    lo, hi = (1 - level) / 2, (1 + level) / 2
    full = per.groupBy("context", "target").agg(F.sum("count").alias("c")).withColumn("probability", F.col("c") / F.sum("c").over(Window.partitionBy("context")))
    seen = b.groupBy("context").agg(F.count_distinct("rep").alias("present"))
    q = b.groupBy("context", "target").agg(F.collect_list("p").alias("ps")).join(seen, "context")
    # a replicate that has the context but not the target counts as 0
    padded = q.select("context", "target", "present", F.concat("ps", F.array_repeat(F.lit(0.0), (F.col("present") - F.size("ps")).cast("int"))).alias("ps"))
    ci = padded.select("context", "target", "present", F.explode("ps").alias("p")).groupBy("context", "target", "present").agg(F.percentile("p", F.lit(lo)).alias("lower"), F.percentile("p", F.lit(hi)).alias("upper"))
    return full.join(ci, ["context", "target"]).select(rule_label(F.col("context")).alias("context"), "target", "probability", "lower", "upper", (F.col("present") / F.lit(n_boot)).alias("support"))


def compare_groups(seqs: DataFrame, groups: DataFrame, order: int = 1, n_perm: int = 0, seed: int = 1) -> DataFrame:
    """(context, target, p_a, p_b, difference[, p_value]) of two groups of sequences; ``groups`` is
    (seq_id, grp) with two values, a the lesser. With ``n_perm`` labels are permuted between
    sequences, and p = (exceeding + 1) / (valid + 1)."""
    per = cut(kgrams(seqs.withColumn("_s", F.col("seq_id")), order, ["_s"]).where(F.col("order") == order))
    first = groups.agg(F.min("grp")).first()[0]
    lab = cut(groups.select(F.col("seq_id").alias("_s"), (F.col("grp") == first).alias("a")))

    def diff(labels: DataFrame, keys: list[str]) -> DataFrame:
        c = per.join(labels, "_s").groupBy(*keys, "context", "target").agg(F.sum(F.when(F.col("a"), F.col("count")).otherwise(0)).alias("na"), F.sum(F.when(F.col("a"), 0).otherwise(F.col("count"))).alias("nb"))
        w = Window.partitionBy(*keys, "context")
        c = c.withColumns({"p_a": F.col("na") / F.nullif(F.sum("na").over(w), F.lit(0)), "p_b": F.col("nb") / F.nullif(F.sum("nb").over(w), F.lit(0))})
        return c.withColumn("difference", F.col("p_a") - F.col("p_b"))

    seen = diff(lab, []).select("context", "target", "p_a", "p_b", "difference")
    if n_perm:
        reps = seqs.sparkSession.range(n_perm).withColumnRenamed("id", "rep")
        mixed = reps.crossJoin(lab.select("_s")).withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.xxhash64(F.lit(seed), "rep", "_s"), "_s")))
        n_a = lab.where("a").count()
        null = diff(mixed.select("rep", "_s", (F.col("r") <= n_a).alias("a")), ["rep"]).select("context", "target", F.col("difference").alias("d0"))
        j = seen.join(null, ["context", "target"], "left").groupBy("context", "target", "p_a", "p_b", "difference").agg(((F.sum((F.abs("d0") >= F.abs("difference") - 1e-12).cast("int")) + 1) / (F.count("d0") + 1)).alias("p_value"))
        seen = j
    return seen.withColumn("context", rule_label(F.col("context")))
