"""SQL of the training-data queries, where SQL can express them."""

from __future__ import annotations

from polyad.llm.runs import _fold_table


def _p1() -> str:
    src, dst = _fold_table()
    esc = lambda s: s.replace("'", "''")
    fold = lambda c: f"lower(regexp_replace(translate({c}, '{esc(src)}', '{esc(dst)}'), '\\p{{M}}+', '', 'g'))"

    def key(c: str) -> str:
        t = f"regexp_replace({fold(c)}, '^[\\s>]*([a-z]+\\s*:)?[\\s>]*', '')"
        t = f"regexp_replace({t}, '(\\s*\\(\\d+\\)|\\s*#\\s*\\d+|[_\\s]+\\d+|\\s+x\\s*\\d+|\\s*\\[[^\\]]*\\]|[.,;:!\\s]+)+$', '')"
        return f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

    return f"""
with book as (select code, {key('code')} k, {key('short')} s from codebook),
turns as (select message_id i, session_id k, case when timestamp > 100000000000 then timestamp // 1000 else timestamp end t, code c
  from human_long where session_id is not null and timestamp is not null and message_id is not null
  qualify row_number() over (partition by message_id order by session_id, case when timestamp > 100000000000 then timestamp // 1000 else timestamp end, code nulls first) = 1),
codes as (select distinct c, {key('c')} ck from turns where c is not null),
hits as (select c, min(b.code) code from codes join book b on ck <> '' and (ck = b.k or ck = b.s) group by c),
slips as (select c, min(b.code) code from codes join book b on length(ck) > 3 and length(b.k) > 4 and
    (levenshtein(ck, b.k) <= 1 or (levenshtein(ck, b.k) = 2 and length(ck) = length(b.k) and list_sort(string_split(ck, '')) = list_sort(string_split(b.k, ''))))
  where c not in (select c from hits) group by c having count(*) = 1),
named as (select t.k, t.t, t.i, coalesce(h.code, s.code) code from turns t left join hits h using (c) left join slips s using (c)),
m as (select *, case when code is not distinct from lag(code) over w and code is not null then 0 else 1 end as brk from named window w as (partition by k order by t, i)),
g as (select *, sum(brk) over (partition by k order by t, i rows unbounded preceding) n from m),
runs as (select k session_id, code, count(*) n_events, arg_min(i, (t, i)) first_id, arg_max(i, (t, i)) last_id, min(t) first_s, max(t) last_s, max(t) - min(t) duration_s
  from g where code is not null group by k, code, n)"""


_P4 = """
with known as (select node, min(node_idx) id from hg_nodes where node is not null and node_idx is not null group by node),
idx as (select distinct n.node_idx, k.id from hg_nodes n join known k using (node) where n.node_idx is not null),
m as (select hg, edge, id from (select hg, edge, unnest(hyperedges) node_idx from hyperedges) join idx using (node_idx)
  union select i.hg, i.edge, k.id from incidence i join known k using (node) where coalesce(weight, 1) <> 0),
mm as (select distinct hg, edge, id from m where hg is not null and edge is not null),
tot as (select hg, count(distinct edge) n_baskets from mm group by hg),
deg as (select hg, id, count(*) d from mm group by hg, id),
c as (select a.hg, a.id ia, b.id ib, count(*) n_both from mm a join mm b on a.hg = b.hg and a.edge = b.edge and a.id <> b.id group by all),
x as (select c.hg, ka.node node_a, kb.node node_b, n_both, da.d n_a, db.d n_b, n_baskets
  from c join tot using (hg) join deg da on da.hg = c.hg and da.id = ia join deg db on db.hg = c.hg and db.id = ib
  join known ka on ka.id = ia join known kb on kb.id = ib where ka.node < kb.node)"""

_P5 = """
with v as (select emb_id, min(embeddings) e from honem where emb_id is not null and len(embeddings) = 64
    and len(list_filter(embeddings, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embeddings, lambda x: x <> 0)) > 0 group by emb_id),
d as (select emb_id, list_transform(e, lambda x: x::double) e from v),
c as (select a.emb_id a, b.emb_id b, round(list_cosine_similarity(a.e, b.e), 9) s from d a join d b on a.emb_id <> b.emb_id),
t as (select a, b, s from c qualify row_number() over (partition by a order by s desc, b) <= 5)
select distinct least(a, b) as emb_a, greatest(a, b) as emb_b from t where s >= 0.8"""

SQL = {
    "p1_found": _p1() + " select session_id, first_id as first_message_id, last_id as last_message_id from runs where n_events >= 2",
    "p1_runs": _p1() + " select * from runs",
    "p4_found": _P4 + " select hg, node_a, node_b from x where n_both >= 8 and n_both * n_baskets >= 5 * n_a * n_b",
    "p4_pairs": _P4 + " select hg, node_a, node_b, n_both, n_a, n_b, n_baskets, round(n_both * n_baskets::double / (n_a * n_b), 6) as lift from x",
    "p5_found": _P5,
}
