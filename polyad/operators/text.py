"""Corpora as hypergraphs: cleaning, tokens, bags, windows, sentences, keywords, topic measures."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyad.errors import BadInput, EmptyCorpus
from polyad.plans.rank import running, with_total
from polyad.plans.session import bounded, cut, need
from polyad.plans.together import Cells, in_step, number, rows

# The stop words, as vocabularies must agree on them.
STOP_WORDS = (
    "the a an and or of to in on for with by from as at this that these those is are was were be been being it its we our their they has have had not no but which "
    "who during into through between among also can could may will would than then there here such more most other both each all some any how what when where while because about"
).split()
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}


def clean(text: Column, html: bool = True, urls: bool = True, copyright: bool = True, citations: bool = True, numbers: bool = False, remove: list[str] | None = None, min_chars: int = 0, min_content: float = 0.0) -> Column:
    """A text cleaned in this order: html, control signs, urls, copyright lines, citations, ``remove``,
    content ratio, numbers, short words, white space. A text whose share of letters is below
    ``min_content`` becomes empty. Null stays null."""
    t = text
    if html:
        t = F.regexp_replace(t, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
        t = F.regexp_replace(t, r"(?s)<!--.*?-->|<[a-zA-Z/!][^>]*>", " ")
        for k, v in _ENTITIES.items():
            t = F.replace(t, F.lit(k), F.lit(v))
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F﻿­​]", "")
    if urls:
        t = F.regexp_replace(t, r"(?i)\b(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+\.[\w.-]+", " ")
    if copyright:
        t = F.regexp_replace(t, r"(?im)(?:©|\(c\)|copyright)\s*(?:\d{4})?[^.\n]*(?:all rights reserved)?\.?", " ")
    if citations:
        t = F.regexp_replace(t, r"\[\d+(?:\s*[,–-]\s*\d+)*\]|\((?:[^()]*\bet al\.[^()]*|[A-Z][\w'-]+(?: (?:and|&) [A-Z][\w'-]+)?,? \d{4}[a-z]?)\)", " ")
    for r in remove or []:
        t = F.regexp_replace(t, r, " ")
    if min_content:
        letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
        t = F.when(letters >= min_content * F.length(F.regexp_replace(t, r"\s", "")), t).otherwise(F.when(t.isNotNull(), ""))
    if numbers:
        t = F.regexp_replace(t, r"\b\d+(?:[.,]\d+)*\b", " ")
    if min_chars > 1:
        t = F.regexp_replace(t, rf"(?<![\p{{L}}'])[\p{{L}}']{{1,{min_chars - 1}}}(?![\p{{L}}'])", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and apostrophes, apostrophes at the edges trimmed."""
    words = F.split(F.replace(F.lower(text), F.lit("’"), F.lit("'")), r"[^\p{L}']+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^'+|'+$", "")), lambda w: w != "")


def token_table(docs: DataFrame, ident: str = "doc_id", text: str = "text", stop_words: list[str] | None = None, min_chars: int = 1) -> DataFrame:
    """(doc, pos, word); stop words and words shorter than ``min_chars`` are dropped before numbering.
    Null and empty texts give nothing."""
    need(docs, ident, text)
    w = tokens(F.col(text))
    if min_chars > 1:
        w = F.filter(w, lambda x: F.length(x) >= min_chars)
    if stop_words:
        stop = F.array(*[F.lit(x) for x in sorted(set(stop_words))])
        w = F.filter(w, lambda x: ~F.array_contains(stop, x))
    return docs.select(F.col(ident).cast("string").alias("doc"), F.posexplode(w).alias("p", "word")).select("doc", (F.col("p") + 1).alias("pos"), "word")


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("doc", "word").agg(F.count(F.lit(1)).alias("count"))


def vocabulary(counts: DataFrame, min_count: int = 1, max_words: int | None = None, coverage: float = 1.0) -> DataFrame:
    """(word, count, doc_freq, rank) of the words kept: count at least ``min_count``, rank (count
    descending, then word) at most ``max_words`` and at most the first rank whose running share reaches
    ``coverage``. The vocabulary is ranked by range, no task sees all of it."""
    v = counts.groupBy("word").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("doc_freq"))
    v = running(with_total(cut(v), all="count"), [F.desc("count"), "word"], "run", "count")
    before = (F.col("run") - F.col("count")) / F.col("all")
    keep = (F.col("count") >= min_count) & (before < coverage - 1.5e-8)
    return v.where(keep if max_words is None else keep & (F.col("rank") <= max_words)).select("word", "count", "doc_freq", "rank")


def bag(counts: DataFrame, weight: str = "count") -> DataFrame:
    """(doc, word, count, weight): the count, or count * (ln((1 + N) / (1 + df)) + 1) for tfidf, N the
    documents with a token."""
    if weight == "count":
        return counts.withColumn("weight", F.col("count").cast("double"))
    if weight != "tfidf":
        raise BadInput("weight is count or tfidf")
    df = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = counts.agg(F.count_distinct("doc").alias("n"))
    idf = df.crossJoin(F.broadcast(n)).select("word", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return counts.join(idf, "word").select("doc", "word", "count", (F.col("count") * F.col("idf")).alias("weight"))


def text_windows(words: DataFrame, width: int, tumbling: bool = False) -> tuple[DataFrame, DataFrame]:
    """(memberships, edges) of word sets in windows of a document. Sliding: a shorter document is one
    window. Tumbling: the tail is a window. Equal sets are one edge; a cell is its number of windows."""
    w = Window.partitionBy("doc").orderBy("pos")
    every = words.withColumns({"n": F.row_number().over(w), "len": F.count(F.lit(1)).over(Window.partitionBy("doc"))})
    led = every.select("doc", "n", "len", F.array(F.col("word"), *[F.lead("word", i).over(w) for i in range(1, width)]).alias("win"))
    at = ((F.col("n") - 1) % width == 0) if tumbling else ((F.col("n") + width - 1 <= F.col("len")) | ((F.col("n") == 1) & (F.col("len") < width)))
    sets = led.where(at).select(F.array_sort(F.array_distinct(F.filter("win", lambda x: x.isNotNull()))).alias("s")).groupBy("s").agg(F.count(F.lit(1)).cast("double").alias("edge_weight"))
    edges = sets.select(F.array_join("s", " | ").alias("edge"), "s", "edge_weight")
    return edges.select(F.explode("s").alias("node"), "edge", F.col("edge_weight").alias("weight")), edges.select("edge", "edge_weight", F.size("s").alias("size"))


def sentences(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(edge, doc, sentence, word, count): words of each sentence that has any, numbered per document."""
    s = docs.select(F.col(ident).cast("string").alias("doc"), F.posexplode(F.split(F.col(text), r"[.!?;]+")).alias("p", "s")).withColumn("w", tokens(F.col("s"))).where("size(w) > 0")
    s = s.withColumn("sentence", F.row_number().over(Window.partitionBy("doc").orderBy("p")))
    g = s.select("doc", "sentence", F.explode("w").alias("word")).groupBy("doc", "sentence", "word").agg(F.count(F.lit(1)).alias("count"))
    return g.select(F.concat_ws("#", "doc", "sentence").alias("edge"), "doc", "sentence", "word", "count")


def keywords(b: DataFrame, clusters: DataFrame, n: int = 10, kind: str = "mass", min_docs: int = 1) -> DataFrame:
    """(cluster, word, score, share, n_docs, rank): the ``n`` words of largest score of each cluster, ties by
    share, then word. ``b`` is (doc, word, count, weight), ``clusters`` (doc, cluster). mass sums weights,
    frequency counts; ctfidf is (count / cluster tokens) ln(floor(mean cluster tokens) / count of the word + 1)."""
    j = b.join(clusters.select(F.col("doc").cast("string").alias("doc"), F.col("cluster").cast("string").alias("cluster")), "doc")
    g = j.groupBy("cluster", "word").agg(F.sum("weight").alias("mass"), F.sum("count").alias("c"), F.count(F.lit(1)).alias("n_docs"))
    if kind == "ctfidf":
        tok = g.groupBy("cluster").agg(F.sum("c").alias("tok"))
        mean = tok.agg(F.floor(F.avg("tok")).alias("mean"))
        f = g.groupBy("word").agg(F.sum("c").alias("f"))
        g = g.join(tok, "cluster").join(f, "word").crossJoin(F.broadcast(mean)).withColumn("score", F.col("c") / F.col("tok") * F.log(F.col("mean") / F.col("f") + 1))
    elif kind in ("mass", "frequency"):
        g = g.withColumn("score", F.col("mass") if kind == "mass" else F.col("c").cast("double"))
    else:
        raise BadInput("kind is mass, frequency or ctfidf")
    g = g.withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy("word")))
    w = Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 9)), F.desc(F.round("share", 9)), "word")
    return g.where((F.col("score") > 0) & (F.col("n_docs") >= min_docs)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("cluster", "word", "score", "share", "n_docs", "rank")


def topic_relations(b: DataFrame, clusters: DataFrame) -> DataFrame:
    """(topic_a, topic_b, association, cosine, jaccard, inclusion, equivalence) from word document counts of
    clusters: association is the product sum, the diagonal serves as totals."""
    c = b.join(clusters.select(F.col("doc").cast("string").alias("doc"), F.col("cluster").cast("string").alias("cluster")), "doc").groupBy("cluster", "word").agg(F.count(F.lit(1)).cast("double").alias("n"))
    d = c.groupBy("cluster").agg(F.sum(F.col("n") * F.col("n")).alias("t"))
    x = c.select("word", F.col("cluster").alias("topic_a"), F.col("n").alias("na")).join(c.select("word", F.col("cluster").alias("topic_b"), F.col("n").alias("nb")), "word").where("topic_a < topic_b")
    x = x.groupBy("topic_a", "topic_b").agg(F.sum(F.col("na") * F.col("nb")).alias("co"))
    x = x.join(d.select(F.col("cluster").alias("topic_a"), F.col("t").alias("ta")), "topic_a").join(d.select(F.col("cluster").alias("topic_b"), F.col("t").alias("tb")), "topic_b")
    co, ta, tb = F.col("co"), F.col("ta"), F.col("tb")
    return x.select("topic_a", "topic_b", co.alias("association"), (co / F.sqrt(ta * tb)).alias("cosine"), (co / (ta + tb - co)).alias("jaccard"), (co / F.least(ta, tb)).alias("inclusion"), (co * co / (ta * tb)).alias("equivalence"))


def topic_sizes(clusters: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(cluster, n, share[, weighted]) of (doc, cluster); ``weights`` is (doc, weight)."""
    j = clusters if weights is None else clusters.join(weights, "doc", "left")
    g = j.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *([] if weights is None else [F.sum("weight").alias("weighted")]))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def coherence(b: DataFrame, top: DataFrame) -> DataFrame:
    """(cluster, umass, npmi) of top words (cluster, word, rank) by document co-occurrence in ``b``: UMass sums
    ln((D_ml + .01) / (D_l + .01)) over ranks m > l; NPMI averages, -1 for pairs that never meet and 1
    for pairs always there."""
    words = top.select("word").distinct()
    d = b.join(words, "word", "left_semi").select("doc", "word").distinct()
    n = b.agg(F.count_distinct("doc").cast("double").alias("n"))
    one = d.groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("d"))
    two = d.select("doc", F.col("word").alias("wl")).join(d.select("doc", F.col("word").alias("wm")), "doc").groupBy("wl", "wm").agg(F.count(F.lit(1)).cast("double").alias("both"))
    p = top.select("cluster", F.col("word").alias("wl"), F.col("rank").alias("l")).join(top.select("cluster", F.col("word").alias("wm"), F.col("rank").alias("m")), "cluster").where("m > l")
    p = p.join(two, ["wl", "wm"], "left").na.fill(0.0, ["both"]).join(one.select(F.col("word").alias("wl"), F.col("d").alias("dl")), "wl").join(one.select(F.col("word").alias("wm"), F.col("d").alias("dm")), "wm").crossJoin(F.broadcast(n))
    pj = F.col("both") / F.col("n")
    npmi = F.when(F.col("both") == 0, -1.0).when(F.col("both") == F.col("n"), 1.0).otherwise(F.log(pj / (F.col("dl") / F.col("n") * F.col("dm") / F.col("n"))) / -F.log(pj))
    return p.groupBy("cluster").agg(F.sum(F.log((F.col("both") + 0.01) / (F.col("dl") + 0.01))).alias("umass"), F.avg(npmi).alias("npmi"))


def topics(b: DataFrame, k: int, iterations: int = 100, starts: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """((doc, topic, weight), (topic, word, weight)) of non-negative factors under Kullback-Leibler
    divergence: multiplicative updates, best of several seeded starts. Documents stay in ranges with
    their weights, the words' weights are added up after each pass."""
    x = b.select("doc", "word", F.col("weight").cast("double").alias("weight")).where("weight > 0")
    if x.isEmpty():
        raise EmptyCorpus("no token is left")
    names, cells, n = number(x, "word", "doc")

    def fit(group, batches):
        import pyarrow as pa

        own, best, kept = Cells(batches, names=True), np.inf, None
        counts = group.each([len(own.starts)])[:, 0].astype(int)
        before, docs, d = int(counts[: group.rank].sum()), int(counts.sum()), len(own.starts)

        def numbers(t: int, after: int, shape: tuple[int, int]) -> np.ndarray:
            """The part after ``after`` numbers of one stream a start, whichever task draws it."""
            rng = np.random.default_rng(seed + t)
            rng.bit_generator.advance(after)
            return rng.random(shape) + 0.1

        for t in range(starts):
            w, h = numbers(t, before * k, (d, k)).T, numbers(t, docs * k, (k, n))
            for _ in range(iterations):
                total, num = h.sum(1), np.zeros_like(h)
                for at, i, x, s, size in own.blocks():
                    hi = h[:, i]
                    r = x / np.maximum((np.repeat(w[:, at], size, axis=1) * hi).sum(0), 1e-12)
                    w[:, at] = np.maximum(w[:, at] * np.add.reduceat(r * hi, s, axis=1) / np.maximum(total, 1e-12)[:, None], 1.19e-7)
                    wd = np.repeat(w[:, at], size, axis=1)
                    r = x / np.maximum((wd * hi).sum(0), 1e-12)
                    for c in range(k):
                        num[c] += np.bincount(i, r * wd[c], n)
                both = group.total(np.append(num.ravel(), w.sum(1)))
                h = h * both[:-k].reshape(k, n) / np.maximum(both[-k:], 1e-12)[:, None]
                h[h < 2.2e-16] = 0
            cost = 0.0
            for at, i, x, _, size in own.blocks():
                y = (np.repeat(w[:, at], size, axis=1) * h[:, i]).sum(0)
                cost += float((x * np.log(x / np.maximum(y, 1e-12)) - x).sum())
            both = group.total(np.append(w.sum(1), cost))
            cost = both[-1] + (both[:-1] * h.sum(1)).sum()
            if group.agree(cost < best or kept is None):
                best, kept = cost, (w, h)
        w, h = kept
        w, h = w * h.sum(1)[:, None], h / np.maximum(h.sum(1, keepdims=True), 1e-12)
        order = np.argsort(-group.total(w.sum(1)), kind="stable")
        w, h = w[order], h[order]
        mine = group.own(n)
        for c in range(k):
            if d:
                yield from rows(i=pa.nulls(d, pa.int64()), doc=pa.chunked_array(own.names).combine_chunks(), topic=np.full(d, c + 1), weight=w[c])
            if mine.stop > mine.start:
                yield from rows(i=np.arange(mine.start, mine.stop), doc=pa.nulls(mine.stop - mine.start, pa.string()), topic=np.full(mine.stop - mine.start, c + 1), weight=h[c, mine])

    f = in_step(cells, fit, "i long, doc string, topic long, weight double").withColumn("topic", F.col("topic").cast("int"))
    return f.where("i is null").select("doc", "topic", "weight"), f.where("i is not null and weight > 0").join(bounded(names), "i").select("topic", F.col("node").alias("word"), "weight")


def exclusivity(b: DataFrame, clusters: DataFrame, top: DataFrame, weight: float = 0.7) -> DataFrame:
    """(cluster, frex, share) over top words (cluster, word): frex sums 1 / (w / e + (1 - w) / f), e and f the
    average ranks of a word's share over clusters and of its probability in the cluster, over the
    vocabulary size; share averages the part of a word's count that falls in the cluster."""
    j = b.join(clusters.select(F.col("doc").cast("string").alias("doc"), F.col("cluster").cast("string").alias("cluster")), "doc")
    c = j.groupBy("cluster", "word").agg(F.sum("count").cast("double").alias("c"))
    grid = c.select("word").distinct().crossJoin(F.broadcast(c.select("cluster").distinct()))
    g = grid.join(c, ["cluster", "word"], "left").na.fill(0.0)
    g = g.withColumn("beta", F.col("c") / F.sum("c").over(Window.partitionBy("cluster")))
    word = Window.partitionBy("word")
    g = g.withColumns({"ex": F.col("beta") / F.sum("beta").over(word), "part": F.col("c") / F.sum("c").over(word)})
    v = F.count(F.lit(1)).over(Window.partitionBy("cluster"))
    r = lambda x: (F.rank().over(Window.partitionBy("cluster").orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy("cluster", x)) - 1) / 2.0) / v
    g = g.withColumns({"beta": F.round("beta", 12), "ex": F.round("ex", 12)}).withColumns({"e": r("ex"), "f": r("beta")})
    k = g.join(top.select("cluster", "word"), ["cluster", "word"])
    return k.groupBy("cluster").agg(F.sum(F.lit(1.0) / (F.lit(weight) / F.col("e") + F.lit(1 - weight) / F.col("f"))).alias("frex"), F.avg("part").alias("share"))


#: Distinct rows of scores that a task compares with one another.
FRONT_BLOCK = 1000


def dominant(scores: DataFrame, better: list[str]) -> DataFrame:
    """``scores`` with ``frontier``: no other row is at least as good in every column of ``better`` and
    better in one. A row with a null beats none and is beaten by none. Blocks by hash drop what is
    beaten inside them for as long as that thins the rows; each of the rest meets every block."""
    s = cut(scores)
    left = cut(s.select(*better).dropna().distinct())
    n, was = left.count(), None
    while n > FRONT_BLOCK and (was is None or n < 0.8 * was):
        blocks = F.pmod(F.xxhash64(*better), F.lit(-(-n // FRONT_BLOCK))).alias("_k")
        left = cut(left.select("*", blocks).join(_rivals(left, better, blocks), (F.col("_k") == F.col("_j")) & _beaten(better), "left_anti").select(*better))
        n, was = left.count(), n
    blocks = max(1, -(-n // FRONT_BLOCK))
    asks = left.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    lost = asks.join(_rivals(left, better, F.pmod(F.xxhash64(*better), F.lit(blocks))), (F.col("_k") == F.col("_j")) & _beaten(better), "left_semi").select(*better).distinct()
    kept = left.join(lost, better, "left_anti").withColumn("_f", F.lit(True))
    whole = reduce(and_, [F.col(c).isNotNull() for c in better])
    return s.join(kept, better, "left").withColumn("frontier", F.when(whole, F.coalesce("_f", F.lit(False))).otherwise(True)).select(*scores.columns, "frontier")


def _rivals(rows: DataFrame, better: list[str], block: Column) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"_{c}") for c in better], block.alias("_j"))


def _beaten(better: list[str]) -> Column:
    at_least = reduce(and_, [F.col(f"_{c}") >= F.col(c) for c in better])
    return at_least & reduce(or_, [F.col(f"_{c}") > F.col(c) for c in better])
