"""Queries of the hypergraph, memory, temporal, text and simplicial operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyad.operators import communities as C
from polyad.operators import factor as L
from polyad.operators import hypergraph as H
from polyad.operators import memory_network as N
from polyad.operators import sequences as Q
from polyad.operators import simplicial as K
from polyad.operators import spectral as P
from polyad.operators import structure as S
from polyad.operators import temporal as T
from polyad.operators import text as X
from polyad.plans.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# ---- inputs -------------------------------------------------------------------------------------


def event_sequences(spark: SparkSession, d: str) -> DataFrame:
    return Q.from_events(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


def part_orders(spark: SparkSession, d: str) -> DataFrame:
    return H.groups(table(spark, d, "lineitem"), "l_partkey", "l_orderkey")


def supplier_orders(spark: SparkSession, d: str) -> DataFrame:
    return H.groups(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")


def supplier_nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("node"), F.col("s_nationkey").cast("string").alias("label"))


def tribunal_spells(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "interval_log").where("`end` is null or `end` >= `start`")
    return T.spells(log, "actor", "group", "start", "end")


def years(spark: SparkSession) -> DataFrame:
    return T.grid(spark, "2012-07-01", "2025-07-01", "1 year")


def sources(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(F.trim("source"))
    return table(spark, d, "documents").where("source is not null").select(F.col("doc_id").cast("string").alias("doc"), s.alias("cluster"))


SEQ = """seq as (select cast(user_id as varchar) seq_id, row_number() over (partition by user_id order by ts, event_id) pos, event_type state
  from events where user_id is not null and event_type is not null)"""
PO = "b as (select distinct cast(l_partkey as varchar) node, cast(l_orderkey as varchar) edge from lineitem)"
SO = "b as (select distinct cast(l_suppkey as varchar) node, cast(l_orderkey as varchar) edge from lineitem)"
LED = "led as (select seq_id, pos, state s0, lead(state, 1) over w s1, lead(state, 2) over w s2, lead(state, 3) over w s3 from seq window w as (partition by seq_id order by pos))"
GRAMS = """g as (select 1 as "order", s0 as context, s1 as target, s0 as last, s0 as first_state, '' as rest, count(*) as count from led where s1 is not null group by all
  union all select 2, s0 || ' -> ' || s1, s2, s1, s0, s1, count(*) from led where s2 is not null group by all
  union all select 3, s0 || ' -> ' || s1 || ' -> ' || s2, s3, s2, s0, s1 || ' -> ' || s2, count(*) from led where s3 is not null group by all)"""
TOKENS = r"""raw as (select doc_id, unnest(list_transform(string_split_regex(lower(replace(text, '’', '''')), '[^\p{L}'']+'), lambda w: trim(w, ''''))) word,
    generate_subscripts(string_split_regex(lower(replace(text, '’', '''')), '[^\p{L}'']+'), 1) i from documents where text is not null),
  words as (select cast(doc_id as varchar) doc, word, row_number() over (partition by doc_id order by i) pos from raw where word <> ''),
  counts as (select doc, word, count(*) as count from words group by all)"""


# ---- sequences and memory -----------------------------------------------------------------------


@query(f"with {SEQ}, {LED}, {GRAMS} select \"order\", context, target, count from g")
def kgram_counts(spark, d):
    g = Q.kgrams(event_sequences(spark, d), 3)
    return g.select("order", Q.rule_label(F.col("context")).alias("context"), "target", "count")


@query(f"with {SEQ}, {LED}, {GRAMS} select context, target, count, round(count / sum(count) over (partition by context), 6) as probability from g where \"order\" = 1")
def transition_probabilities(spark, d):
    g = Q.distributions(Q.kgrams(event_sequences(spark, d), 1))
    return rounded(g.select(F.col("context")[0].alias("context"), "target", "count", "probability"), "probability")


@query(f"""with {SEQ}, {LED}, {GRAMS},
p as (select *, sum(count) over (partition by "order", context) total from g where "order" <= 2),
q as (select context, target, count / total p, total, last from p where "order" = 2),
o as (select context, target, count / total p from p where "order" = 1),
-- a second-order context extends the state it ends in
kl as (select q.context, any_value(q.last) cur, any_value(q.total) total, sum(case when o.p is null then 'infinity'::double else q.p * log2(q.p / o.p) end) kl
  from q left join o on o.context = q.last and o.target = q.target group by q.context),
leaf as (select case when kl > 2 / log2(1 + total) then context else cur end valid from kl
  union select context from o where context not in (select cur from kl)),
rules as (select valid context from leaf union select split_part(valid, ' -> ', 1) from leaf)
select p.context, p."order", p.target, p.count, round(p.count / p.total, 6) as probability from p join rules using (context)""")
def memory_rules_order2(spark, d):
    r = Q.memory_rules(event_sequences(spark, d), 2)
    return rounded(r.withColumn("context", Q.rule_label(F.col("context"))), "probability")


@query()
def memory_network_order3(spark, d):
    return Q.memory_network(Q.memory_rules(event_sequences(spark, d), 3))


@query(f"""with {SEQ}, {LED}, {GRAMS},
p as (select *, sum(count) over (partition by "order", context) total from g),
f as (select last, target, count / total q from p where "order" = 1),
h1 as (select last, -sum(q * log2(q)) entropy_first, arg_max(target, (q, target)) likeliest_first from f group by last),
k as (select p.context, p.last, p.total, p.target, p.count / p.total p, f.q from p left join f using (last, target) where "order" = 2 and total >= 5),
hk as (select context, last, total, -sum(p * log2(p)) entropy_order, sum(p * log2(p / q)) divergence, arg_max(target, (p, target)) likeliest_order from k group by all)
select context, cast(total as bigint) as count, round(entropy_first, 6) entropy_first, round(entropy_order, 6) entropy_order, round(entropy_first - entropy_order, 6) entropy_drop,
  round(divergence, 6) divergence, likeliest_first, likeliest_order, likeliest_first <> likeliest_order as flips from hk join h1 using (last)""")
def path_dependence_order2(spark, d):
    return rounded(Q.path_dependence(event_sequences(spark, d), 2, 5), "entropy_first", "entropy_order", "entropy_drop", "divergence")


@query(f"""with {SEQ}, {LED}, {GRAMS},
n as (select *, sum(count) over (partition by "order", first_state, rest) cj, sum(count) over (partition by "order", rest, target) jk, sum(count) over (partition by "order", rest) j from g)
select "order", round(2 * sum(count * ln(count * j::double / (cj * jk::double))), 6) as g2 from n group by all""")
def markov_g2_by_order(spark, d):
    return rounded(Q.order_tests(event_sequences(spark, d), 3), "g2")


@query(f"""with {SEQ}, {LED}, {GRAMS},
p as (select *, sum(count) over (partition by "order", context) total from g),
s as (select "order", sum(count * ln(count / total)) ll, count(distinct context) c, count(*) m, sum(count) n from p group by all)
select "order", round(ll, 6) as log_likelihood, c as n_contexts, m - c as parameters, round(2 * (m - c) - 2 * ll, 6) as aic, round((m - c) * ln(n) - 2 * ll, 6) as bic, cast(n as bigint) as n from s""")
def order_model_scores(spark, d):
    return rounded(Q.model_scores(event_sequences(spark, d), 3), "log_likelihood", "aic", "bic")


@query(f"""with {SEQ}, {LED}, c as (select s0 || ' -> ' || s1 || ' -> ' || s2 as path, count(*) as count from led where s2 is not null group by all)
select path, count, round(count / sum(count) over (), 4) as proportion, row_number() over (order by count desc, path) as rank from c""")
def path_counts_3(spark, d):
    return Q.path_counts(event_sequences(spark, d), 3)


@query("""with e as (select *, epoch_us(ts) - epoch_us(lag(ts) over w) > 172800000000 as brk from events where user_id is not null and event_type is not null window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(case when brk then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) run from e)
select user_id || '|' || run as seq_id, row_number() over (partition by user_id, run order by ts, event_id) as pos, event_type as state from s""")
def sequences_gap_48h(spark, d):
    return Q.from_events(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", gap_seconds=172800, time="ts")


@query(f"""with {SEQ}, l as (select *, lag(state) over (partition by seq_id order by pos) p from seq),
k as (select *, count(*) over (partition by seq_id) n from l where p is distinct from state)
select seq_id, row_number() over (partition by seq_id order by pos) as pos, state from k where n >= 2""")
def sequences_without_repeats(spark, d):
    return Q.collapse_repeats(event_sequences(spark, d))


@query(f"""with {SEQ}, s as (select seq_id, list_sort(list(distinct state)) m from seq group by seq_id),
g as (select case when cast(seq_id as bigint) % 2 = 0 then 'even' else 'odd' end as "group", array_to_string(m, ' + ') members, count(*) n from s group by all)
select "group", members, n, round(n / sum(n) over (partition by "group"), 6) as share, row_number() over (partition by "group" order by n desc, members) as rank from g qualify rank <= 8""")
def clustered_state_sets(spark, d):
    seqs = event_sequences(spark, d)
    g = seqs.select("seq_id").distinct().withColumn("group", F.when(F.col("seq_id").cast("long") % 2 == 0, "even").otherwise("odd"))
    return rounded(Q.state_sets(seqs, g), "share")


@query()
def markov_stability(spark, d):
    return Q.markov_stability(event_sequences(spark, d))


@query()
def bootstrap_transitions(spark, d):
    return Q.bootstrap(event_sequences(spark, d), n_boot=50)


@query(f"""with {SEQ}, {LED}, c as (select s0 context, s1 target, count(*) filter (cast(seq_id as bigint) % 2 = 0) na, count(*) filter (cast(seq_id as bigint) % 2 = 1) nb from led where s1 is not null group by all),
p as (select *, na / nullif(sum(na) over (partition by context), 0) p_a, nb / nullif(sum(nb) over (partition by context), 0) p_b from c)
select context, target, round(p_a, 6) p_a, round(p_b, 6) p_b, round(p_a - p_b, 6) difference from p""")
def compare_cohorts(spark, d):
    seqs = event_sequences(spark, d)
    g = seqs.select("seq_id").distinct().withColumn("grp", F.when(F.col("seq_id").cast("long") % 2 == 0, "a").otherwise("b"))
    return rounded(Q.compare_groups(seqs, g), "p_a", "p_b", "difference")


# ---- constructors -------------------------------------------------------------------------------


@query("select cast(l_partkey as varchar) node, cast(l_orderkey as varchar) edge, round(sum(l_quantity), 6) as weight from lineitem where l_partkey is not null and l_orderkey is not null and l_quantity is not null group by all")
def group_incidence_weighted(spark, d):
    return rounded(H.groups(table(spark, d, "lineitem"), "l_partkey", "l_orderkey", "l_quantity"), "weight")


@query("""select cast(l_orderkey as varchar) edge, case when min(l_returnflag) = max(l_returnflag) then max(l_returnflag) end as l_returnflag, case when min(l_linestatus) = max(l_linestatus) then max(l_linestatus) end as l_linestatus
from lineitem where l_orderkey is not null group by l_orderkey""")
def edge_attributes_constant(spark, d):
    return H.constant_attributes(table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


WINDOWS = f"""{SEQ}, {LED}, win as (select list_sort([s0, s1, s2]) w from led where s2 is not null and (pos - 1) % {{step}} = 0),
k as (select array_to_string(list_sort(list_distinct(w)), ' | ') edge, w from win)"""


@query(f"with {WINDOWS.format(step=1)} select edge, cast(count(*) as double) as edge_weight, any_value(len(list_distinct(w))) as size from k group by edge")
def window_hyperedges_w3(spark, d):
    return H.windows(event_sequences(spark, d), 3)[1]


@query(f"with {WINDOWS.format(step=1)} select node, edge, cast(count(*) as double) as weight from (select edge, unnest(w) node from k) group by all")
def window_cells_w3(spark, d):
    return H.windows(event_sequences(spark, d), 3)[0]


@query(f"with {WINDOWS.format(step=3)} select edge, cast(count(*) as double) as edge_weight, any_value(len(list_distinct(w))) as size from k group by edge")
def window_hyperedges_tumbling(spark, d):
    return H.windows(event_sequences(spark, d), 3, step=3)[1]


@query(f"with {SO} select edge as node, node as edge, cast(1 as double) as weight from b")
def dual_hypergraph(spark, d):
    return H.dual(supplier_orders(spark, d))


@query(f"with {SO}, n as (select cast(s_suppkey as varchar) node from supplier where s_acctbal > 0) select node, edge, cast(1 as double) as weight from b where edge not in (select edge from b where node not in (select node from n))")
def edges_inside_node_set(spark, d):
    good = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("node"))
    return H.subset(supplier_orders(spark, d), nodes=good)


@query(f"with {SO}, s as (select edge, list_sort(list(node)) members, count(*) size from b group by edge) select min(edge) as edge, array_to_string(members, ',') as members, size, count(*) as multiplicity from s group by members, size")
def collapsed_duplicate_edges(spark, d):
    return H.collapse_duplicates(supplier_orders(spark, d)).withColumn("members", F.array_join("members", ","))


@query("""with v as (select cast(vec_id as varchar) id, list_transform(embedding, lambda x: x::double) e from embeddings),
c as (select a.id edge, b.id node, round(list_cosine_similarity(a.e, b.e), 12) s from v a join v b on a.id <> b.id),
t as (select * from c qualify row_number() over (partition by edge order by s desc, node) <= 5)
select node, edge, cast(1 as double) as weight from t union all select id, id, 1 from v""")
def knn_hypergraph(spark, d):
    return H.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 5, weighted=False)


NEAR = """v as (select cast(vec_id as varchar) id, list_transform(embedding, lambda x: x::double) e from embeddings),
c as (select a.id x, b.id y, round(list_cosine_similarity(a.e, b.e), 12) s from v a join v b on a.id <> b.id),
t as (select * from c qualify row_number() over (partition by x order by s desc, y) <= 5), e as (select least(x, y) a, greatest(x, y) b, max(s) w from t group by all),
c2 as (select [a, b] m, b as last, w f from e)"""
for _k in range(3, 13):  # cliques of one more member, until there are none
    NEAR += f""",
c{_k} as (select list_append(c.m, x.b) m, x.b as last, least(c.f, min(y.w)) f from c{_k - 1} c join e x on x.a = c.last join e y on y.b = x.b and list_contains(c.m, y.a) group by c.m, x.b, c.f having count(*) = {_k - 1})"""
COMPLEX = f"{NEAR}, sx as (select [v] m, max(w) f from (select a v, w from e union all select b, w from e) group by v" + "".join(f" union all select m, f from c{_k}" for _k in range(2, 13)) + ")"


def neighbour_graph(spark, d):
    """(a, b, weight): vectors of which one is among the five most similar of the other, with their cosine."""
    n = H.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 5).where("node <> edge")
    return n.select(F.least("node", "edge").alias("a"), F.greatest("node", "edge").alias("b"), "weight").groupBy("a", "b").agg(F.max("weight").alias("weight"))


def neighbour_complex(spark, d):
    return K.cliques(neighbour_graph(spark, d), None)


@query(f"with {NEAR} select array_to_string(m, '|') as edge, len(m) as size from c2 union all select array_to_string(m, '|'), len(m) from c3")
def network_cliques_3(spark, d):
    e = neighbour_graph(spark, d).select(F.col("a").alias("source"), F.col("b").alias("target"), "weight")
    return H.network_cliques(e, 3).select("edge", "size")


# ---- structure ----------------------------------------------------------------------------------

SIZES = "sz as (select edge, count(*) size from b group by edge)"
PAIRS = "pr as (select x.node node_a, y.node node_b, x.edge from b x join b y on x.edge = y.edge and x.node < y.node)"


@query(f"""with {SO}, {SIZES}, {PAIRS}, n as (select node, count(*) n from (select distinct node_a node, node_b o from pr union select distinct node_b, node_a from pr) group by node)
select node, count(*) as hyperdegree, cast(sum(size) as bigint) as strength, max(size) as max_edge_size, coalesce(any_value(n), 0) as n_neighbors from b join sz using (edge) left join n using (node) group by node""")
def node_measures(spark, d):
    return S.node_measures(supplier_orders(spark, d))


OVERLAP = f"{PO}, {SIZES}, o as (select x.edge edge_a, y.edge edge_b, count(*) overlap from b x join b y on x.node = y.node and x.edge < y.edge group by all)"


@query(f"""with {OVERLAP}, i as (select edge, count(*) n from (select edge_a edge from o union all select edge_b from o) group by edge)
select edge, size, cast(size as double) as weight, coalesce(n, 0) as n_incident_edges from sz left join i using (edge)""")
def edge_measures(spark, d):
    return S.edge_measures(part_orders(spark, d))


@query(f"with {OVERLAP} select edge_a, edge_b, overlap, a.size as size_a, c.size as size_b, round(overlap / least(a.size, c.size), 6) as min_share, round(overlap / (a.size + c.size - overlap), 6) as jaccard from o join sz a on a.edge = edge_a join sz c on c.edge = edge_b")
def edge_overlap_jaccard(spark, d):
    return rounded(S.edge_overlaps(part_orders(spark, d)), "min_share", "jaccard")


@query(f"with {OVERLAP} select edge_a, edge_b, overlap as weight from o where overlap >= 2")
def line_graph_s2(spark, d):
    return S.line_graph(part_orders(spark, d), 2)


@query(f"""with {SO}, {SIZES}, {PAIRS}, n as (select count(distinct node) n from b), e as (select count(*) m, sum(size) c from sz), p as (select count(*) p from (select distinct node_a, node_b from pr))
select n as n_nodes, m as n_hyperedges, round(c / (n * m), 6) as density, round(c / m, 6) as avg_size, round(p / (n * (n - 1) / 2), 6) as pairwise_participation from n, e, p""")
def hypergraph_summary(spark, d):
    return rounded(S.summary(supplier_orders(spark, d)), "density", "avg_size", "pairwise_participation")


@query(f"with {SO}, {SIZES}, g as (select size as value, count(*) n from sz group by all) select value, n, round(n / sum(n) over (), 6) as proportion, round(sum(n) over (order by value desc) / sum(n) over (), 6) as ccdf from g")
def size_distribution(spark, d):
    return rounded(S.distribution(S._sizes(supplier_orders(spark, d)), "size"), "proportion", "ccdf")


@query(f"""with {SO}, v as (select cast(count(*) as double) v from b group by node) select count(*) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, min(v) as min, round(quantile_cont(v, 0.25), 6) as q25,
  round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.75), 6) as q75, max(v) as max from v""")
def hyperdegree_summary(spark, d):
    v = supplier_orders(spark, d).groupBy("node").agg(F.count(F.lit(1)).alias("v"))
    return rounded(S.summarise(v, "v"), "mean", "sd", "q25", "median", "q75")


@query(f"with {SO}, {PAIRS} select node_a, node_b, cast(count(*) as double) as weight from pr group by all")
def clique_projection(spark, d):
    return S.clique_projection(supplier_orders(spark, d))


@query("""with b as (select cast(l_suppkey as varchar) node, cast(l_orderkey as varchar) edge, sum(l_quantity) w from lineitem group by all)
select x.node node_a, y.node node_b, round(sum(x.w * y.w), 6) as weight from b x join b y on x.edge = y.edge and x.node < y.node group by all""")
def clique_projection_weighted(spark, d):
    return rounded(S.clique_projection(H.groups(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "l_quantity"), True), "weight")


@query(f"with {SO}, {SIZES}, {PAIRS} select node_a, node_b, round(sum(1 / (size - 1)), 6) as weight from pr join sz using (edge) group by all")
def association_projection(spark, d):
    return rounded(S.association_projection(supplier_orders(spark, d)), "weight")


@query(f"""with {SO}, k as (select edge, list_sort(list(node)) m from b group by edge), one as (select m, min(edge) edge, len(m) size from k group by m), c as (select edge, size, unnest(m) node from one)
select x.node node_a, y.node node_b, round(sum(1 / (x.size - 1)), 6) as weight from c x join c y on x.edge = y.edge and x.node < y.node group by all""")
def association_projection_collapsed(spark, d):
    return rounded(S.association_projection(supplier_orders(spark, d), True), "weight")


@query(f"with {SO} select 'c' || o_custkey as source, node as target, cast(count(*) as double) as weight from b join orders on edge = cast(o_orderkey as varchar) group by all")
def citation_projection(spark, d):
    src = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("edge"), F.concat(F.lit("c"), "o_custkey").alias("source"))
    return S.citation_projection(supplier_orders(spark, d), src)


@query()
def connected_components(spark, d):
    return S.components(part_orders(spark, d))


@query()
def component_table(spark, d):
    return rounded(S.component_table(part_orders(spark, d)), "share")


@query(f"""with {SO}, {PAIRS}, p as (select distinct node_a, node_b from pr), s as (select node_a node, node_b o from p union all select node_b, node_a from p), k as (select node, count(*) k from s group by all),
t as (select x.node, count(*) n from s x join s y on x.node = y.node and x.o < y.o join p on p.node_a = x.o and p.node_b = y.o group by all)
select distinct b.node, round(case when k >= 2 then coalesce(n, 0) / (k * (k - 1) / 2) end, 6) as transitivity from b left join k using (node) left join t using (node)""")
def transitivity_projection(spark, d):
    return rounded(S.projection_transitivity(supplier_orders(spark, d)), "transitivity")


def _two_node(kind: str, below: str):
    sql = f"""with {SO}, {PAIRS}, dg as (select node, count(*) d from b group by all), c as (select node_a, node_b, count(*) n from pr group by all),
v as (select node_a, node_b, n / ({below}) v from c join dg a on a.node = node_a join dg z on z.node = node_b),
h as (select node_a node, v from v union all select node_b, v from v) select dg.node, round(avg(v), 6) as transitivity from dg left join h using (node) group by dg.node"""

    def run(spark, d):
        return rounded(S.pair_transitivity(supplier_orders(spark, d), kind), "transitivity")

    run.__name__ = f"transitivity_two_node_{kind}"
    query(sql)(run)


_two_node("union", "a.d + z.d - n")
_two_node("min", "least(a.d, z.d)")
_two_node("max", "greatest(a.d, z.d)")


def _assort(kind: str, x: str, xx: str, xy: str):
    sql = f"""with {SO}, dg as (select node, cast(count(*) as double) d from b group by all),
e as (select edge, count(*) k, sum(d) s, sum(d * d) q, list_reverse_sort(list(d)) ds from b join dg using (node) group by edge having count(*) >= 2),
t as (select avg({x}) x, avg({xx}) xx, avg({xy}) xy from e) select '{kind}' as kind, round((xy - x * x) / (xx - x * x), 6) as assortativity from t"""

    def run(spark, d):
        return rounded(S.assortativity(supplier_orders(spark, d), kind), "assortativity")

    run.__name__ = f"assortativity_{kind}"
    query(sql)(run)


_assort("uniform", "s / k", "q / k", "(s * s - q) / (k * (k - 1))")
_assort("top_2", "(ds[1] + ds[2]) / 2", "(ds[1] * ds[1] + ds[2] * ds[2]) / 2", "ds[1] * ds[2]")
_assort("top_bottom", "(ds[1] + ds[-1]) / 2", "(ds[1] * ds[1] + ds[-1] * ds[-1]) / 2", "ds[1] * ds[-1]")


@query(f"""with {SO}, {SIZES}, s as (select node, size, count(*) d from b join sz using (edge) group by all), g as (select n.node, z.size, coalesce(d, 0) d from (select distinct node from b) n cross join (select distinct size from sz) z left join s on s.node = n.node and s.size = z.size)
select x.size size_a, y.size size_b, round(corr(x.d, y.d), 6) as correlation from g x join g y on x.node = y.node and x.size < y.size group by all""")
def degree_correlation(spark, d):
    return rounded(S.degree_correlation(supplier_orders(spark, d)), "correlation")


@query(f"""with {SO}, {PAIRS}, s as (select distinct node_a, node_b from pr), k as (select list_sort(list(node)) m, edge from b group by edge), one as (select m, min(edge) edge from k group by m), c as (select edge, unnest(m) node from one),
inc as (select 'bg' r, node_a node from s union all select 'bg', node_b from s union all select 'mg', node_a from pr union all select 'mg', node_b from pr union all select 'bh', node from c union all select 'mh', node from b),
dg as (select r, n.node, count(inc.node) d from (select distinct node from b) n cross join (select unnest(['bg', 'mg', 'bh', 'mh']) r) left join inc using (r, node) group by all),
e as (select 'bg' r, count(*) n from s union all select 'mg', count(*) from pr union all select 'bh', count(*) from one union all select 'mh', count(distinct edge) from b)
select r as representation, any_value(n) as n_edges, round(avg(d), 6) as mean_degree, round(quantile_cont(d, 0.5), 6) as median_degree from dg join e using (r) group by r""")
def representations(spark, d):
    return rounded(S.representations(supplier_orders(spark, d)), "mean_degree", "median_degree")


@query(f"""with {SO}, {PAIRS}, dg as (select node, count(*) d from b group by all), c as (select node_a, node_b, count(*) observed, a.d * z.d k from pr join dg a on a.node = node_a join dg z on z.node = node_b group by all),
t as (select sum(k) urn, sum(observed) draws from c) select node_a, node_b, observed, round(draws * k::double / urn, 6) as expected, round(observed / (draws * k::double / urn), 6) as ratio from c, t where observed >= 5""")
def pair_anomaly_expected(spark, d):
    return rounded(S.pair_expected(supplier_orders(spark, d)), "expected", "ratio")


@query()
def pair_anomaly(spark, d):
    return S.pair_anomaly(supplier_orders(spark, d))


@query(f"""with {SO}, k as (select list_sort(list(node)) m from b group by edge having count(*) = 3), e as (select distinct m from k),
j as (select list_sort(list_distinct(list_concat(x.m, y.m))) four from e x join e y on x.m < y.m and len(list_intersect(x.m, y.m)) = 2), f as (select four, count(*) n from j group by four)
select count(*) filter (n = 1) as y, count(*) filter (n = 3) as t, count(*) filter (n = 6) as o from f""")
def motifs_yto(spark, d):
    return S.triple_motifs(supplier_orders(spark, d))


@query(f"""with {PO}, {SIZES}, {PAIRS}, k as (select list_sort(list(node)) m from b group by edge), rp as (select sum(c - 1) r from (select count(*) c from k group by m)),
pp as (select count(*) p, count(*) filter (c > 1) rep from (select count(*) c from pr group by node_a, node_b)),
o as (select sum(c / (s1 + s2 - c)) js from (select x.edge, y.edge, any_value(a.size) s1, any_value(z.size) s2, count(*) c from b x join b y on x.node = y.node and x.edge < y.edge join sz a on a.edge = x.edge join sz z on z.edge = y.edge group by x.edge, y.edge)),
t as (select count(distinct node) n, count(distinct edge) m, count(*) cells from b)
select round(cells / (n * m), 6) as density, round(cells / m, 6) as avg_size, round(js / (m * (m - 1) / 2), 9) as avg_jaccard, round(p / (n * (n - 1) / 2), 6) as participation, cast(r as bigint) as repeated_edges, rep as repeated_pairs from t, rp, pp, o""")
def null_statistics(spark, d):
    return rounded(S.null_statistics(part_orders(spark, d)), "density", "avg_size", "participation").withColumn("avg_jaccard", F.round("avg_jaccard", 9))


@query()
def null_test_configuration(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("node"), F.col("l_orderkey").cast("string").alias("edge"))
    return S.null_test(lines.dropna(), n=19)  # which counts repeated rows once, as part_orders does


# ---- temporal -----------------------------------------------------------------------------------

SPELLS = """s as (select actor node, "group" edge, "start" a, "end" z from interval_log where actor is not null and "group" is not null and "start" is not null and ("end" is null or "end" >= "start")),
grid as (select unnest(generate_series(timestamp '2012-07-01', timestamp '2025-07-01', interval 1 year)) t),
act as (select distinct t, node, edge from s join grid on a <= t and (z is null or z >= t)), cum as (select distinct t, node, edge from s join grid on a <= t)"""


@query(f"""with {SPELLS}, e as (select t, edge, count(*) c, list_sort(list(node)) m from act group by t, edge),
x as (select t, count(*) edges, count(distinct m) de, sum(c) mem from e group by t), y as (select t, count(distinct node) nodes from act group by t),
cx as (select t, count(distinct edge) ce, count(distinct node) cn, count(*) cm from cum group by t)
select t, coalesce(nodes, 0) nodes, coalesce(edges, 0) edges, coalesce(de, 0) distinct_edges, cast(coalesce(mem, 0) as bigint) memberships, coalesce(cn, 0) cum_nodes, coalesce(ce, 0) cum_edges, coalesce(cm, 0) cum_memberships
from grid left join x using (t) left join y using (t) left join cx using (t)""")
def growth_yearly(spark, d):
    return T.growth(tribunal_spells(spark, d), years(spark))


@query(f"with {SPELLS} select t, node, edge, cast(count(*) as double) as weight from s join grid on a <= t and (z is null or z >= t) group by all")
def snapshots_yearly(spark, d):
    return T.snapshots(tribunal_spells(spark, d), years(spark))


@query(f"with {SPELLS}, sz as (select t, edge, count(*) size from act group by all), i as (select x.t, x.edge, count(distinct y.edge) n from act x join act y on x.t = y.t and x.node = y.node and x.edge <> y.edge group by all) select t, edge, size, coalesce(n, 0) as n_incident_edges from sz left join i using (t, edge)")
def snapshot_edges_yearly(spark, d):
    return T.snapshot_edges(tribunal_spells(spark, d), years(spark))


@query(f"with {SPELLS} select edge, cast(epoch(min(a)) as bigint) as start_s, case when count(*) = count(z) then cast(epoch(max(z)) as bigint) end as end_s from s group by edge")
def edge_spans(spark, d):
    return T.edge_spans(tribunal_spells(spark, d)).select("edge", F.unix_seconds(F.col("start").cast("timestamp")).alias("start_s"), F.unix_seconds(F.col("end").cast("timestamp")).alias("end_s"))


# ---- walks and spectra --------------------------------------------------------------------------


def _unrolled(steps: list[str], last: str, head: str) -> str:
    return "with " + head + "".join(f",\n{s}" for s in steps) + "\n" + last


def _pagerank_sql(n: int) -> str:
    head = f"{SO}, d as (select edge, count(*) delta from b group by edge), p as (select node, edge, 1.0::double / count(*) over (partition by node) o, 1.0::double / delta i from b join d using (edge)), nn as (select count(distinct node) n from b), r0 as (select distinct node, 1.0::double / n r from b, nn)"
    steps = []
    for k in range(1, n + 1):
        steps.append(f"e{k} as materialized (select edge, sum(r * o) x from p join r{k - 1} using (node) group by edge)")
        steps.append(f"r{k} as materialized (select node, 0.15 / any_value(n) + 0.85 * sum(x * i) r from p join e{k} using (edge), nn group by node)")
    return _unrolled(steps, f"select node, round(r / sum(r) over (), 9) as pagerank from r{n}", head)


@query(_pagerank_sql(40))
def pagerank(spark, d):
    return rounded(P.pagerank(supplier_orders(spark, d)), "pagerank", digits=9)


@query(f"""with {SO}, {SIZES}, dg as (select node, count(*) d from b group by node), v as (select node, edge, size, 1 / sqrt(d) v from b join sz using (edge) join dg using (node)),
s as (select x.node i, y.node j, sum(x.v * y.v / x.size) s from v x join v y on x.edge = y.edge and x.node <= y.node group by all)
select i, j, round(case when i = j then 1 else 0 end - s, 6) as value from s""")
def laplacian_zhou(spark, d):
    return rounded(P.laplacian(supplier_orders(spark, d)), "value")


def _katz_sql(n: int) -> str:
    """x = alpha A (1 + x), alpha half of 1 over the largest row sum of A."""
    head = f"""{SO}, own as (select node, count(*) own from b group by node), e0 as (select edge, count(*) y from b group by edge),
a as (select 0.5::double / max(y) alpha from (select node, sum(y) - any_value(own) y from b join e0 using (edge) join own using (node) group by node)), t0 as (select node, 0.0::double s from own)"""
    steps = []
    for k in range(1, n + 1):
        steps.append(f"e{k} as materialized (select edge, sum(s + 1) y from b join t{k - 1} using (node) group by edge)")
        steps.append(f"t{k} as materialized (select node, any_value(alpha) * (sum(y) - any_value(own) * (1 + any_value(s))) s from b join e{k} using (edge) join own using (node) join t{k - 1} using (node), a group by node)")
    return _unrolled(steps, f"select node, round(s, 7) as katz from t{n}", head)


@query(_katz_sql(40))
def katz(spark, d):
    return rounded(P.katz(supplier_orders(spark, d)), "katz", digits=7)


def _spread_sql(n: int, xi: float) -> str:
    head = f"""{SO}, {SIZES}, dg as (select node, count(*) d from b group by node), v as (select node, edge, size, 1 / sqrt(d) v from b join sz using (edge) join dg using (node)),
y as (select cast(s_suppkey as varchar) node, cast(s_nationkey as varchar) label, {1 - xi!r}::double f from supplier where s_suppkey in (select l_suppkey from lineitem)), f0 as (select * from y)"""
    steps = []
    for k in range(1, n + 1):
        steps.append(f"e{k} as materialized (select edge, label, sum(v * f / size) x from v join f{k - 1} using (node) group by all)")
        steps.append(f"f{k} as materialized (select node, label, sum(f) f from (select node, label, {xi} * sum(v * x) f from v join e{k} using (edge) group by all union all select * from y) group by all)")
    return _unrolled(steps, f"select node, label as predicted, round(f, 7) as score from f{n} qualify row_number() over (partition by node order by f desc, label) = 1", head)


@query(_spread_sql(32, 0.5))
def label_spreading(spark, d):
    return rounded(P.spread_labels(supplier_orders(spark, d), supplier_nations(spark, d), xi=0.5, tol=1e-9).select("node", "predicted", "score"), "score", digits=7)


@query()
def clique_eigenvector(spark, d):
    return P.clique_eigenvector(supplier_orders(spark, d))


@query()
def tensor_centrality_z(spark, d):
    return P.tensor_centrality(supplier_orders(spark, d), "Z", tol=1e-6)


@query()
def tensor_centrality_h(spark, d):
    return P.tensor_centrality(supplier_orders(spark, d), "H", tol=1e-6)


@query(f"""with {SO}, {SIZES}, dg as (select node, count(*) d from b group by node)
select x.node i, y.node j, round(case when x.node = y.node then 1 else 0 end - sum(1.0::double / d / size), 6) as value from b x join b y using (edge) join sz using (edge) join dg on dg.node = x.node group by x.node, y.node""")
def laplacian_random_walk(spark, d):
    return rounded(P.laplacian(supplier_orders(spark, d), "random_walk"), "value")


@query()
def spectral_clusters(spark, d):
    return P.spectral_clusters(supplier_orders(spark, d), 4)


@query("""with v as (select cast(vec_id as varchar) node, cast(label as varchar) cluster, list_transform(embedding, lambda x: x::double) e from embeddings),
u as (select node, cluster, unnest(e) x, generate_subscripts(e, 1) p from v), c as (select cluster, p, avg(x) c from u group by all),
d as (select u.node, c.cluster, sum((x - c) * (x - c)) d from u join c using (p) group by u.node, c.cluster)
select node, cluster, round((1 / d) / sum(1 / d) over (partition by node), 6) as membership from d""")
def fuzzy_membership(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("node"), F.col("embedding").cast("array<double>").alias("coordinates"), F.col("label").cast("string").alias("cluster"))
    return rounded(P.fuzzy_membership(e.select("node", "coordinates"), e.select("node", "cluster")), "membership")


# ---- partitions ---------------------------------------------------------------------------------


@query("""with c as (select c_nationkey a, c_mktsegment b, count(*) n from customer where c_nationkey is not null and c_mktsegment is not null group by all),
t as (select sum(n) n, sum(n * (n - 1) / 2) s, sum(n * ln(n)) lc from c), x as (select a, sum(n) v, max(n) top from c group by a), y as (select b, sum(n) v from c group by b),
u as (select sum(v * (v - 1) / 2) sa, sum(top) al, sum(v * ln(v)) la from x), w as (select sum(v * (v - 1) / 2) sb, sum(v * ln(v)) lb from y)
select cast(n as bigint) as n, cast(al as bigint) as aligned, round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) as ari,
  round(((ln(n) - la / n) + (ln(n) - lb / n) - (ln(n) - lc / n)) / (((ln(n) - la / n) + (ln(n) - lb / n)) / 2), 6) as nmi from t, u, w""")
def agreement_ari_nmi(spark, d):
    c = table(spark, d, "customer")
    return rounded(C.agreement_sql(c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("label")), c.select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("label"))), "ari", "nmi")


@query()
def agreement_with_ami(spark, d):
    c = table(spark, d, "customer")
    return C.agreement(c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("label")), c.select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("label")))


def _modularity(kind: str, part: str):
    sql = f"""with {SO}, l as (select node, edge, s_nationkey label from b join supplier on node = cast(s_suppkey as varchar)), c as (select edge, label, count(*) c from l group by all), sz as (select edge, count(*) d from l group by edge),
got as (select sum(case when c > d / 2 then {part} else 0 end) g from c join sz using (edge)), v as (select count(*) / sum(count(*)) over () p from l group by label), m as (select d, count(*) m from sz group by d),
gr as (select d, m, unnest(generate_series(cast(floor(d / 2) as bigint) + 1, d)) c from m),
tax as (select sum(m * ({part}) * exp(lgamma(d + 1) - lgamma(c + 1) - lgamma(d - c + 1) + c * ln(p) + (d - c) * ln(1 - p))) t from gr, v)
select '{kind}' as kind, round((g - t) / (select count(*) from sz), 6) as modularity from got, tax"""

    def run(spark, d):
        return rounded(C.modularity(supplier_orders(spark, d), supplier_nations(spark, d), kind), "modularity")

    run.__name__ = f"modularity_{kind}"
    query(sql)(run)


_modularity("linear", "c / d")
_modularity("majority", "1")
_modularity("strict", "case when c = d then 1 else 0 end")


@query(f"""with {SO}, {PAIRS}, w as (select node_a, node_b, cast(count(*) as double) w from pr group by all), l as (select cast(s_suppkey as varchar) node, s_nationkey label from supplier),
p as (select w, x.label la, y.label lb, x.label = y.label as inn from w join l x on x.node = node_a join l y on y.node = node_b),
t as (select count(*) e, sum(w) w, count(*) filter (inn) ein, sum(case when inn then w else 0 end) win from p), s as (select label, count(*) k from l group by label), nn as (select sum(k) n, sum(k * (k - 1) / 2) pin from s),
h as (select label, sum(w) vol, sum(case when inn then 0 else w end) cut from (select la label, w, inn from p union all select lb, w, inn from p) group by label), v as (select sum(vol * vol) v2 from h), mc as (select max(cut / nullif(least(vol, 2 * t.w - vol), 0)) mc from h, t)
select round(ein / e, 6) as coverage, round(win / w, 6) as weighted_coverage, round((ein + (n * (n - 1) / 2 - pin) - (e - ein)) / (n * (n - 1) / 2), 6) as performance, round(win / w - v2 / (4 * w * w), 6) as modularity, round(mc, 6) as max_conductance from t, nn, v, mc""")
def community_quality(spark, d):
    return rounded(C.community_quality(S.clique_projection(supplier_orders(spark, d)), supplier_nations(spark, d)), "coverage", "weighted_coverage", "performance", "modularity", "max_conductance")


@query()
def louvain_communities(spark, d):
    return C.louvain(S.clique_projection(supplier_orders(spark, d)))


# ---- text ---------------------------------------------------------------------------------------


def _words(spark, d):
    return X.token_table(table(spark, d, "documents"))


@query(rf"with {TOKENS} select doc, pos, word from words")
def tokens(spark, d):
    return _words(spark, d)


@query(rf"""with {TOKENS}, v as (select word, cast(sum(count) as bigint) as count, count(*) doc_freq from counts group by word),
r as (select *, row_number() over (order by count desc, word) as rank, (sum(count) over (order by count desc, word rows unbounded preceding) - count) / sum(count) over () before from v)
select word, count, doc_freq, rank from r where count >= 5 and rank <= 500 and before < 0.9 - 1.5e-8""")
def vocabulary(spark, d):
    return X.vocabulary(X.word_counts(_words(spark, d)), 5, 500, 0.9)


@query(rf"""with {TOKENS}, n as (select count(distinct doc) n from counts), f as (select word, count(*) df from counts group by word)
select doc, word, count, round(count * (ln((1 + n) / (1 + df)) + 1), 6) as weight from counts join f using (word), n""")
def bag_tfidf(spark, d):
    return rounded(X.bag(X.word_counts(_words(spark, d)), "tfidf"), "weight")


@query(rf"""with {TOKENS}, n as (select doc, count(*) len from words group by doc), led as (select doc, pos, [word, lead(word, 1) over w, lead(word, 2) over w] win from words window w as (partition by doc order by pos)),
s as (select list_sort(list_distinct(list_filter(win, lambda x: x is not null))) s from led join n using (doc) where pos + 2 <= len or (pos = 1 and len < 3))
select array_to_string(s, ' | ') as edge, cast(count(*) as double) as edge_weight, len(s) as size from s group by s""")
def text_windows_sliding(spark, d):
    return X.text_windows(_words(spark, d), 3)[1]


@query(rf"""with sent as (select doc_id, unnest(string_split_regex(text, '[.!?;]+')) s, generate_subscripts(string_split_regex(text, '[.!?;]+'), 1) p from documents where text is not null),
w as (select doc_id, p, list_filter(list_transform(string_split_regex(lower(replace(s, '’', '''')), '[^\p{{L}}'']+'), lambda x: trim(x, '''')), lambda x: x <> '') ws from sent),
k as (select doc_id, dense_rank() over (partition by doc_id order by p) i, ws from w where len(ws) > 0)
select doc_id || '#' || i as edge, cast(doc_id as varchar) as doc, i as sentence, word, count(*) as count from (select doc_id, i, unnest(ws) word from k) group by all""")
def sentence_cells(spark, d):
    return X.sentences(table(spark, d, "documents"))


CLUSTERS = "cl as (select cast(doc_id as varchar) doc, lower(trim(source)) cluster from documents where source is not null)"


def _keywords(kind: str, score: str):
    sql = rf"""with {TOKENS}, {CLUSTERS}, n as (select count(distinct doc) n from counts), f as (select word, count(*) df from counts group by word),
bg as (select doc, word, count c, count * (ln((1 + n) / (1 + df)) + 1) wt from counts join f using (word), n),
g as (select cluster, word, sum(wt) mass, sum(c) c, count(*) n_docs from bg join cl using (doc) group by all), tk as (select cluster, sum(c) tok from g group by cluster), mn as (select floor(avg(tok)) mean from tk), fw as (select word, sum(c) f from g group by word),
s as (select g.cluster, word, {score} score, n_docs from g join tk using (cluster) join fw using (word), mn), h as (select *, score / sum(score) over (partition by word) share from s),
r as (select *, row_number() over (partition by cluster order by round(score, 9) desc, round(share, 9) desc, word) as rank from h where score > 0)
select cluster, word, round(score, 6) as score, round(share, 6) as share, n_docs, rank from r where rank <= 10"""

    def run(spark, d):
        b = X.bag(X.word_counts(_words(spark, d)), "tfidf")
        return rounded(X.keywords(b, sources(spark, d), 10, kind), "score", "share")

    run.__name__ = f"keywords_{kind}"
    query(sql)(run)


_keywords("mass", "mass")
_keywords("frequency", "cast(c as double)")
_keywords("ctfidf", "c / tok * ln(mean / f + 1)")


@query(rf"""with {TOKENS}, {CLUSTERS}, c as (select cluster, word, cast(count(*) as double) n from counts join cl using (doc) group by all), t as (select cluster, sum(n * n) t from c group by cluster),
x as (select p.cluster topic_a, q.cluster topic_b, sum(p.n * q.n) co from c p join c q on p.word = q.word and p.cluster < q.cluster group by all)
select topic_a, topic_b, co as association, round(co / sqrt(a.t * z.t), 6) as cosine, round(co / (a.t + z.t - co), 6) as jaccard, round(co / least(a.t, z.t), 6) as inclusion, round(co * co / (a.t * z.t), 6) as equivalence from x join t a on a.cluster = topic_a join t z on z.cluster = topic_b""")
def topic_relations(spark, d):
    return rounded(X.topic_relations(X.bag(X.word_counts(_words(spark, d))), sources(spark, d)), "cosine", "jaccard", "inclusion", "equivalence")


@query(f"with {CLUSTERS} select cluster, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from cl group by cluster")
def topic_sizes(spark, d):
    return rounded(X.topic_sizes(sources(spark, d)), "share")


@query(rf"""with {TOKENS}, {CLUSTERS}, g as (select cluster, word, sum(count) c from counts join cl using (doc) group by all), tp as (select *, row_number() over (partition by cluster order by c desc, word) rank from g qualify rank <= 10),
dw as (select distinct doc, word from counts where word in (select word from tp)), nn as (select cast(count(distinct doc) as double) n from counts), o as (select word, cast(count(*) as double) d from dw group by word),
tw as (select x.word wl, y.word wm, cast(count(*) as double) b from dw x join dw y using (doc) group by all),
p as (select l.cluster, l.word wl, m.word wm from tp l join tp m on l.cluster = m.cluster and m.rank > l.rank),
q as (select cluster, coalesce(b, 0) b, ol.d dl, om.d dm, n from p left join tw using (wl, wm) join o ol on ol.word = wl join o om on om.word = wm, nn)
select cluster, round(sum(ln((b + 0.01) / (dl + 0.01))), 6) as umass, round(avg(case when b = 0 then -1 when b = n then 1 else ln(b * n / (dl * dm)) / -ln(b / n) end), 6) as npmi from q group by cluster""")
def topic_coherence(spark, d):
    b = X.bag(X.word_counts(_words(spark, d)))
    g = b.join(sources(spark, d), "doc").groupBy("cluster", "word").agg(F.sum("count").alias("c"))
    top = g.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "word"))).where("rank <= 10")
    return rounded(X.coherence(b, top), "umass", "npmi")


@query()
def cleaned_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean(F.col("text"), min_content=0.2).alias("text"))


@query()
def topic_model(spark, d):
    w = X.token_table(table(spark, d, "documents"), stop_words=X.STOP_WORDS, min_chars=3)
    c = X.word_counts(w)
    kept = X.vocabulary(c, 5, 2000)
    return X.topics(X.bag(c.join(kept.select("word"), "word", "left_semi"), "count"), 5, iterations=30, starts=2)[1]


# ---- simplicial ---------------------------------------------------------------------------------

WSETS = f"{WINDOWS.format(step=1)}, ws as (select list_sort(list_distinct(w)) m, count(*) c from k group by all)"


@query(f"""with {WSETS}, u as (select m, c, unnest(m) a from ws), f as (select [a] f, c from u union all select [x.a, y.a], x.c from u x join u y on x.m = y.m and x.a < y.a
  union all select [x.a, y.a, z.a], x.c from u x join u y on x.m = y.m and x.a < y.a join u z on z.m = x.m and y.a < z.a)
select array_to_string(f, '|') as members, cast(max(c) as double) as count, len(f) - 1 as dimension from f group by f""")
def window_complex(spark, d):
    _, e = H.windows(event_sequences(spark, d), 3)
    sets = e.select(F.split("edge", r" \| ").alias("members"), F.col("edge_weight").alias("count"))
    return K.close(sets).select(F.array_join("members", "|").alias("members"), "count", "dimension")


@query(f"with {COMPLEX} select array_to_string(m, '|') as members, len(m) - 1 as dimension, round(f, 9) as filtration from sx")
def clique_complex(spark, d):
    return rounded(neighbour_complex(spark, d).select(F.array_join("members", "|").alias("members"), "dimension", "filtration"), "filtration", digits=9)


@query(f"with {COMPLEX} select len(m) - 1 as dimension, count(*) as n from sx group by all")
def clique_f_vector(spark, d):
    return K.f_vector(neighbour_complex(spark, d))


@query(f"with {COMPLEX} select cast(sum(case when len(m) % 2 = 1 then 1 else -1 end) as bigint) as euler from sx")
def clique_euler(spark, d):
    return K.euler(neighbour_complex(spark, d))


@query(f"with {COMPLEX} select node, d as dimension, count(*) as n from (select unnest(m) node, len(m) - 1 d from sx) group by all")
def clique_degrees(spark, d):
    return K.degrees(neighbour_complex(spark, d))


@query()
def clique_homology(spark, d):
    return K.homology(neighbour_complex(spark, d))


@query()
def clique_q_analysis(spark, d):
    return K.q_analysis(neighbour_complex(spark, d))


# ---- memory networks as graphs, factors, propagation --------------------------------------------


def _network(spark, d):
    return Q.memory_network(Q.memory_rules(event_sequences(spark, d), 3))


@query()
def memory_network_pagerank(spark, d):
    return N.project(N.network_pagerank(_network(spark, d), rounds=20))


@query()
def memory_network_closeness(spark, d):
    return N.network_closeness(_network(spark, d))


@query()
def memory_network_embedding(spark, d):
    return N.network_embedding(_network(spark, d), 3)


@query()
def memory_network_communities(spark, d):
    return N.network_communities(_network(spark, d), trials=2)


FLOW = f"with {SEQ}, {LED}, fl as (select s0 source, s1 destination, count(*) / sum(count(*)) over () f from led where s1 is not null group by all), pt as (select distinct state node, case when state < 'm' then 'x' else 'y' end module from seq)"


@query(f"""{FLOW}, x as (select f, a.module ms, z.module md, destination from fl join pt a on a.node = source join pt z on z.node = destination),
e as (select ms module, sum(f) ex from x where ms <> md group by ms), n as (select md module, sum(f) en from x where ms <> md group by md), o as (select md module, sum(f) own from x group by md), ph as (select sum(p * log2(p)) ph from (select md, destination, sum(f) p from x group by all)),
m as (select module, coalesce(ex, 0) ex, coalesce(en, 0) en, coalesce(own, 0) own from (select distinct module from pt) left join e using (module) left join n using (module) left join o using (module)),
t as (select sum(en) e, sum(case when en > 0 then en * log2(en) else 0 end) pe, sum(case when ex + own > 0 then (ex + own) * log2(ex + own) else 0 end) pt, sum(case when ex > 0 then ex * log2(ex) else 0 end) px from m)
select round(case when e > 0 then e * log2(e) else 0 end - pe + pt - px - ph, 6) as codelength, round(case when e > 0 then e * log2(e) else 0 end - pe, 6) as index_length, round(pt - px - ph, 6) as module_length from t, ph""")
def codelength_of_partition(spark, d):
    g = Q.kgrams(event_sequences(spark, d), 1)
    total = g.agg(F.sum("count").alias("t"))
    flow = g.crossJoin(F.broadcast(total)).select(F.col("context")[0].alias("source"), F.col("target").alias("destination"), (F.col("count") / F.col("t")).alias("flow"))
    part = event_sequences(spark, d).select(F.col("state").alias("node")).distinct().withColumn("module", F.when(F.col("node") < "m", "x").otherwise("y"))
    return rounded(N.codelength(flow, part), "codelength", "index_length", "module_length")


@query()
def path_anomaly_order2(spark, d):
    return N.path_anomaly(event_sequences(spark, d), 2)


@query(f"with {SO}, dg as (select node, sqrt(count(*)) dv from b group by node), {SIZES}, x as (select node, edge, dv, 1 / size de from b join dg using (node) join sz using (edge)) select node, edge, round(dv / sum(dv) over (partition by edge), 6) as node_to_edge, round(de / sum(de) over (partition by node), 9) as edge_to_node from x")
def propagation_weights(spark, d):
    return rounded(L.propagation(supplier_orders(spark, d), alpha=-1.0, beta=0.5), "node_to_edge").withColumn("edge_to_node", F.round("edge_to_node", 9))


@query(f"""with {SO}, {SIZES}, ft as (select cast(s_suppkey as varchar) node, s_acctbal x from supplier), p as (select a.edge, a.node a, z.node b, round((fa.x - fz.x) * (fa.x - fz.x), 9) d from b a join b z on a.edge = z.edge and a.node < z.node join ft fa on fa.node = a.node join ft fz on fz.node = z.node),
e as (select edge, a, b from p qualify row_number() over (partition by edge order by d desc, a, b) = 1), r as (select e.edge, e.a, e.b, b.node from e join b on b.edge = e.edge and b.node <> e.a and b.node <> e.b),
l as (select edge, a, b from e union all select edge, a, node from r union all select edge, b, node from r)
select least(a, b) as node_a, greatest(a, b) as node_b, round(sum(1 / (2 * size - 3)), 6) as weight from l join sz using (edge) group by all""")
def mediated_graph(spark, d):
    ft = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("node"), F.array(F.col("s_acctbal").cast("double")).alias("coordinates"))
    return rounded(L.mediated_graph(supplier_orders(spark, d), ft), "weight")


@query()
def coclusters(spark, d):
    return L.cocluster(supplier_orders(spark, d), 3)


@query()
def block_model(spark, d):
    return L.block_model(supplier_orders(spark, d), 3, starts=2, rounds=40)


@query()
def symmetric_nmf_clusters(spark, d):
    return L.symmetric_nmf(supplier_orders(spark, d), 3, starts=2)


@query(rf"""with {TOKENS}, {CLUSTERS}, c as (select cluster, word, cast(sum(count) as double) c from counts join cl using (doc) group by all), tp as (select cluster, word from c qualify row_number() over (partition by cluster order by c desc, word) <= 10),
g as (select k.cluster, w.word, coalesce(c, 0) c from (select distinct cluster from c) k cross join (select distinct word from c) w left join c on c.cluster = k.cluster and c.word = w.word),
b as (select *, c / sum(c) over (partition by cluster) beta from g), x as (select *, round(beta / sum(beta) over (partition by word), 12) ex, c / sum(c) over (partition by word) part, round(beta, 12) be from b),
r as (select *, (rank() over (partition by cluster order by ex) + (count(*) over (partition by cluster, ex) - 1) / 2) / count(*) over (partition by cluster) e, (rank() over (partition by cluster order by be) + (count(*) over (partition by cluster, be) - 1) / 2) / count(*) over (partition by cluster) f from x)
select cluster, round(sum(1 / (0.7 / e + 0.3 / f)), 5) as frex, round(avg(part), 6) as share from r join tp using (cluster, word) group by cluster""")
def topic_exclusivity(spark, d):
    b = X.bag(X.word_counts(_words(spark, d)))
    g = b.join(sources(spark, d), "doc").groupBy("cluster", "word").agg(F.sum("count").alias("c"))
    top = g.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "word"))).where("rank <= 10")
    return rounded(X.exclusivity(b, sources(spark, d), top), "share").withColumn("frex", F.round("frex", 5))


@query("select s_suppkey, s_nationkey, s_acctbal, not exists (select 1 from supplier o where o.s_nationkey >= s.s_nationkey and o.s_acctbal >= s.s_acctbal and (o.s_nationkey > s.s_nationkey or o.s_acctbal > s.s_acctbal)) as frontier from supplier s")
def pareto_frontier(spark, d):
    return X.dominant(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey", "s_acctbal"])


# ---- further constructors and readers -----------------------------------------------------------


@query("""with e as (select cast(o_custkey as varchar) a, cast(o_orderpriority as varchar) b, o_totalprice w, row_number() over (order by cast(o_custkey as varchar), cast(o_orderpriority as varchar), o_totalprice) k
  from orders where o_custkey is not null and o_orderpriority is not null and o_totalprice is not null)
select a as node, 'e' || k as edge, round(w, 4) as weight from e union all select b, 'e' || k, round(w, 4) from e where b <> a""")
def edge_list_orders(spark, d):
    return rounded(H.edge_list(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice"), "weight", digits=4)


@query("""select trim(x) as node, cast(p_partkey as varchar) as edge, cast(1 as double) as weight from (select p_partkey, unnest(string_split(p_name, ' ')) x from part where p_name is not null) where trim(x) <> '' group by all""")
def delimited_part_names(spark, d):
    return H.delimited(table(spark, d, "part"), "p_name", "p_partkey", " ")


@query("""with w as (select cast(o_orderkey as varchar) seq_id, [cast(o_orderstatus as varchar), case when o_orderpriority like '1%' then null else o_orderpriority end, case when o_totalprice > 150000 then cast(o_orderstatus as varchar) end] a from orders where o_orderkey is not null),
e as (select seq_id, a, list_max([case when a[i] is not null then i end for i in [1, 2, 3]]) z from w),
x as (select seq_id, unnest(a) state, generate_subscripts(a, 1) pos, z from e) select seq_id, cast(pos as int) as pos, state from x where pos <= z""")
def wide_to_long(spark, d):
    o = table(spark, d, "orders").where("o_orderkey is not null")
    wide = o.select("o_orderkey", F.col("o_orderstatus").alias("T1"), F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("T2"), F.when(F.col("o_totalprice") > 150000, F.col("o_orderstatus")).alias("T3"))
    return Q.from_wide(wide, "o_orderkey", ["T1", "T2", "T3"])


@query(rf"""with {TOKENS}, led as (select doc, pos, [word, lead(word, 1) over w, lead(word, 2) over w] win from words window w as (partition by doc order by pos)),
s as (select list_sort(list_distinct(list_filter(win, lambda x: x is not null))) s from led where (pos - 1) % 3 = 0)
select array_to_string(s, ' | ') as edge, cast(count(*) as double) as edge_weight, len(s) as size from s group by s""")
def text_windows_tumbling(spark, d):
    return X.text_windows(_words(spark, d), 3, tumbling=True)[1]


@query("""select spell_id, strptime(strftime("start", '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M') as t from interval_log where "start" is not null""")
def parsed_times(spark, d):
    log = table(spark, d, "interval_log").where("`start` is not null").select("spell_id", F.date_format("start", "dd/MM/yyyy HH:mm").alias("t"))
    return T.parse_times(log, "t").withColumn("t", F.col("t").cast("timestamp_ntz"))


@query("""select event_id, round((epoch_us(ts) - min(epoch_us(ts)) over ()) / 3600e6, 6) as ts from events where ts is not null""")
def event_clock_hours(spark, d):
    return rounded(T.clock(table(spark, d, "events").where("ts is not null").select("event_id", "ts"), "ts", 3600.0), "ts")


@query("""with s as (select cast(user_id as varchar) seq_id, row_number() over (partition by user_id order by ts, cast(event_id as varchar)) pos, event_type state from events where user_id is not null and ts is not null and event_type is not null) select seq_id, cast(pos as int) as pos, state from s""")
def sequences_of_documents(spark, d):
    e = table(spark, d, "events").where("user_id is not null and ts is not null and event_type is not null")
    return Q.from_documents(e, "user_id", "ts", "event_type", "event_id")


# ---- paths, overlap, growth, groups -------------------------------------------------------------

TR = "b as (select distinct actor node, \"group\" edge from interval_log where actor is not null and \"group\" is not null)"


def tribunal_groups(spark: SparkSession, d: str) -> DataFrame:
    return H.groups(table(spark, d, "interval_log"), "actor", "group")


def _closeness_sql(s: int, levels: int) -> str:
    head = f"""{TR}, o as (select x.edge a, y.edge c from b x join b y on x.node = y.node and x.edge <> y.edge group by all having count(*) >= {s}), r0 as (select distinct edge s, edge t, 0 d from b)"""
    steps = [f"r{k} as materialized (select * from r{k - 1} union all select distinct x.s, o.c, {k} from r{k - 1} x join o on x.t = o.a where x.d = {k - 1} and not exists (select 1 from r{k - 1} y where y.s = x.s and y.t = o.c))" for k in range(1, levels + 1)]
    return _unrolled(steps, f"select s as edge, {s} as s, 'closeness' as measure, round(case when sum(d) > 0 then (count(*) - 1) / sum(d) * (count(*) - 1) / (select count(distinct edge) - 1 from b) else 0 end, 6) as value from r{levels} group by s", head)


@query(_closeness_sql(4, 12))
def edge_closeness_s4(spark, d):
    return rounded(S.edge_centrality(tribunal_groups(spark, d), 4), "value")


@query()
def edge_betweenness_s4(spark, d):
    return S.edge_centrality(tribunal_groups(spark, d), 4, "betweenness")


@query(f"""with {TR}, nb as (select distinct x.node x, y.node y from b x join b y on x.edge = y.edge and x.node <> y.node), p as (select distinct x.edge e, y.edge f from b x join b y on x.node = y.node and x.edge <> y.edge),
al as (select p.e, p.f, b.node x from p join b on b.edge = p.e where not exists (select 1 from b z where z.edge = p.f and z.node = b.node)),
hit as (select distinct a.e, a.f, a.x from al a join nb on nb.x = a.x join al c on c.e = a.f and c.f = a.e and c.x = nb.y),
eo as (select p.e, p.f, coalesce(h, 0) / nullif(k, 0) v from p left join (select least(e, f) a, greatest(e, f) z, count(*) h from hit group by all) on a = least(p.e, p.f) and z = greatest(p.e, p.f)
  left join (select least(e, f) a2, greatest(e, f) z2, count(*) k from al group by all) on a2 = least(p.e, p.f) and z2 = greatest(p.e, p.f)),
d as (select node, count(*) k from b group by node), s as (select x.node, sum(coalesce(v, 0)) t from b x join b y on x.node = y.node and x.edge < y.edge join eo on eo.e = x.edge and eo.f = y.edge group by x.node)
select d.node, round(case when k = 1 then 0 else 2 * coalesce(t, 0) / (k * (k - 1)) end, 6) as transitivity from d left join s using (node)""")
def transitivity_extra_overlap(spark, d):
    return rounded(S.extra_overlap_transitivity(tribunal_groups(spark, d)), "transitivity")


@query(f"""with recursive {SPELLS}, l as (select distinct x.t, x.node a, y.node c from act x join act y on x.t = y.t and x.edge = y.edge), r as (select distinct t, node a, node c from act union select r.t, r.a, l.c from r join l on l.t = r.t and l.a = r.c),
lab as (select t, a, min(c) k from r group by t, a), g as (select t, k, count(*) n from lab group by t, k)
select t, coalesce(any_value(c), 0) as n_components, round(any_value(x), 6) as largest_component from grid left join (select t, count(*) c, max(n) / sum(n) x from g group by t) using (t) group by t""")
def growth_components_yearly(spark, d):
    g = T.growth_components(tribunal_spells(spark, d), years(spark))
    return rounded(g.withColumn("t", F.col("t").cast("timestamp_ntz")), "largest_component")


@query(f"""with {SEQ}, g as (select state, count(*) c from seq group by state), t as (select sum(c) n from g) select 0 as "order", round(sum(c * ln(c / n)), 6) as log_likelihood, cast(count(*) - 1 as bigint) as parameters, cast(any_value(n) as bigint) as n from g, t""")
def order_zero_score(spark, d):
    s = Q.model_scores(event_sequences(spark, d), 1, from_order=0).where(F.col("order") == 0)
    return rounded(s.select("order", "log_likelihood", "parameters", "n"), "log_likelihood")


@query()
def chosen_order(spark, d):
    return Q.choose_order(Q.model_scores(event_sequences(spark, d), 3, from_order=0), "bic")


GROUPED = """seq as (select cast(user_id as varchar) seq_id, user_id % 3 grp, row_number() over (partition by user_id order by ts, event_id) pos, event_type state from events where user_id is not null and event_type is not null),
led as (select grp, state s0, lead(state, 1) over w s1, lead(state, 2) over w s2 from seq window w as (partition by seq_id order by pos)),
g as (select grp, 1 as "order", s0 as context, s1 as target, s0 as last, count(*) as count from led where s1 is not null group by all union all select grp, 2, s0 || ' -> ' || s1, s2, s1, count(*) from led where s2 is not null group by all)"""


@query(f"""with {GROUPED}, p as (select *, sum(count) over (partition by grp, "order", context) total from g), q as (select grp, context, target, count / total p, total, last from p where "order" = 2), o as (select grp, context, target, count / total p from p where "order" = 1),
kl as (select q.grp, q.context, any_value(q.last) cur, any_value(q.total) total, sum(case when o.p is null then 'infinity'::double else q.p * log2(q.p / o.p) end) kl from q left join o on o.grp = q.grp and o.context = q.last and o.target = q.target group by q.grp, q.context),
leaf as (select grp, case when kl > 2 / log2(1 + total) then context else cur end valid from kl union select grp, context from o where not exists (select 1 from kl where kl.grp = o.grp and kl.cur = o.context)),
rules as (select grp, valid context from leaf union select grp, split_part(valid, ' -> ', 1) from leaf)
select cast(p.grp as varchar) as grp, p.context, p."order", p.target, p.count, round(p.count / p.total, 6) as probability from p join rules using (grp, context)""")
def memory_rules_by_group(spark, d):
    e = table(spark, d, "events").where("user_id is not null").select(F.col("user_id").cast("string").alias("seq_id"), (F.col("user_id") % 3).cast("string").alias("grp")).distinct()
    return rounded(Q.memory_rules_by_group(event_sequences(spark, d), e, 2).withColumn("context", Q.rule_label(F.col("context"))), "probability")


@query()
def memory_network_betweenness(spark, d):
    return N.network_betweenness(_network(spark, d))


# ---- dense verbs and topology beside the complex ------------------------------------------------


@query()
def subgraph_centrality(spark, d):
    return P.subgraph_centrality(tribunal_groups(spark, d))


@query()
def spectral_embedding(spark, d):
    return P.embed(tribunal_groups(spark, d), 3)


@query()
def cluster_seeds(spark, d):
    m = tribunal_groups(spark, d)
    return C.cluster_seeds(P.embed(m, 3), P.spectral_clusters(m, 3).select("node", "cluster"), 2)


@query()
def cluster_stability(spark, d):
    return L.cluster_stability(tribunal_groups(spark, d), 3)


@query(f"with {COMPLEX} select cast(sum(case when len(m) % 2 = 1 then 1 else -1 end) as bigint) as alternating from sx")
def betti_alternating_sum(spark, d):
    """Betti numbers, as their alternating sum, which is the Euler characteristic."""
    return K.betti(neighbour_complex(spark, d)).agg(F.sum(F.when(F.col("dimension") % 2 == 0, F.col("betti")).otherwise(-F.col("betti"))).cast("long").alias("alternating"))


@query()
def persistence_landscape(spark, d):
    grid = spark.range(0, 101).select((F.col("id") / 100).alias("t"))
    return K.landscape(K.homology(neighbour_complex(spark, d)), grid)


@query("select 40 as edges, 3 as least_size, 3 as largest_size")
def sampled_uniform_shape(spark, d):
    """Random hypergraph of 60 nodes and 40 edges of three: every edge has its size."""
    m = H.sample_uniform(spark, 60, 40, 3).groupBy("edge").agg(F.count(F.lit(1)).alias("k"))
    return m.agg(F.count(F.lit(1)).cast("int").alias("edges"), F.min("k").cast("int").alias("least_size"), F.max("k").cast("int").alias("largest_size"))
