"""Queries of the core; ``ORACLES`` has the same in SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import PAPER_SIGNALS, SENSITIVE_SUFFIXES, SKIPPED_DIRS
from ..operators import analyze, cluster, detect, export, extraction, incremental, ingest, orphans, report, search, traverse, validate
from ..operators.graph import build_graph, first_statement_wins, hyperedge_members as hyperedge_rows, merge_repositories, relativized, update_graph, upsert_attributes
from ..sources import sql
from ..sources.session import bounded
from ..sources.tables import table
from ..streaming import watch
from .graphs import GRAPH_SQL, PLACES_SQL, code_graph, graph_sql, place_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


_PATH = r"regexp_replace(replace(rel_path, '\', '/'), '^(\./+)+', '')"
_DIGEST = r"nullif(regexp_replace(regexp_replace(lower(hash), '\s+', '', 'g'), '^[a-z0-9_-]*[:=]', ''), '')"
_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"


@query(f"""
with good as (select * from (select repo, {_PATH} p, m.run_id, {_DIGEST} h, file_type t, row_number() over (partition by repo, {_PATH}, m.run_id order by entry_id desc) rn
    from manifest_entries m join runs r on m.run_id = r.run_id where r.status = 'success' and rel_path is not null) where rn = 1),
listed as (select distinct run_id, repo, {_PATH} p, {_DIGEST} h, file_type t from scan_entries where rel_path is not null),
latest as (select l.*, (select max(g.run_id) from good g where g.repo = l.repo and g.p = l.p and g.run_id < l.run_id) k from listed l)
select distinct l.run_id, l.repo, l.p as rel_path from latest l left join good g on g.repo = l.repo and g.p = l.p and g.run_id = l.k
where g.run_id is null or l.h is null or g.h is null or l.h <> g.h or l.t is distinct from g.t
""")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending_entries(table(spark, d, "scan_entries"), table(spark, d, "manifest_entries"), table(spark, d, "runs"))


_ORPHANS = f"""
with refs as (select ord, 'source' as endpoint, {_KEY.format('source')} k, seen_at from edges where trim(source) <> ''
    union all select ord, 'target', {_KEY.format('target')}, seen_at from edges where trim(target) <> ''),
parents as (select distinct {_KEY.format('id')} k, added_at, deleted_at from nodes where id is not null),
alive as (select distinct r.ord, r.endpoint from refs r join parents p on r.k = p.k and p.added_at <= r.seen_at and (p.deleted_at is null or p.deleted_at > r.seen_at))
"""


@query(_ORPHANS + "select r.ord, r.endpoint from refs r left join alive a on r.ord = a.ord and r.endpoint = a.endpoint where a.ord is null")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "edges"), table(spark, d, "nodes"))


@query(_ORPHANS + """
select 'edges' as table_name, r.endpoint, cast(date_trunc('month', r.seen_at) as date) as period, count(*) as n_references,
    count(*) filter (where a.ord is null) as n_orphans, count(*) filter (where k.k is null) as n_never_existed
from refs r left join alive a on r.ord = a.ord and r.endpoint = a.endpoint left join (select distinct k from parents) k on k.k = r.k group by all
""")
def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(table(spark, d, "edges"), table(spark, d, "nodes"))


# -- building the graph


@query(f"with {GRAPH_SQL} select ord, id, x.label as label, x.file_type as file_type, x.source_file as source_file, x.community as community, x.repo as repo from n")
def build_nodes(spark: SparkSession, d: str) -> DataFrame:
    return code_graph(spark, d).nodes.select("ord", "id", "label", "file_type", "source_file", "community", "repo")


@query(f"with {GRAPH_SQL} select src, tgt, y.ord as ord, y.orig_src as orig_src, y.orig_tgt as orig_tgt, y.relation as relation, y.confidence as confidence, y.context as context from e")
def build_edges(spark: SparkSession, d: str) -> DataFrame:
    return code_graph(spark, d).edges.select("src", "tgt", "ord", "orig_src", "orig_tgt", "relation", "confidence", "context")


@query("""
with f as (select 'o_' || o_orderkey id, o_orderkey * 2 ord, 'status' k, o_orderstatus v from orders union all select 'o_' || o_orderkey, o_orderkey * 2, 'priority', o_orderpriority from orders
    union all select 'o_' || l_orderkey, l_orderkey * 2 + 1, 'status', case when max(l_quantity) > 40 then 'bulk' end from lineitem group by l_orderkey)
select id, k, min(ord) over (partition by id) ord, v from (select id, k, arg_max(struct_pack(v := v), ord).v v, min(ord) ord from f group by id, k)
""")
def build_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Orders' attributes, some of them overwritten by their lines: per-key upsert, exploded for comparison."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("ord"), F.concat(F.lit("o_"), F.col("o_orderkey").cast("string")).alias("id"), F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")).alias("attrs"))
    big = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"))
    x = big.select((F.col("l_orderkey") * 2 + 1).alias("ord"), F.concat(F.lit("o_"), F.col("l_orderkey").cast("string")).alias("id"), F.create_map(F.lit("status"), F.when(F.col("q") > 40, "bulk")).alias("attrs"))
    return upsert_attributes(o.unionByName(x)).select("id", "ord", F.explode("attrs").alias("k", "v"))


@query(f"with {GRAPH_SQL} select id, degree from deg")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return code_graph(spark, d).degrees()


@query(f"with {GRAPH_SQL} select (select count(*) from n) n_nodes, (select (2 * count(*) - count(*) filter (where src = tgt)) // 2 from e) n_edges")
def graph_size(spark: SparkSession, d: str) -> DataFrame:
    return code_graph(spark, d).size()


@query(f"with {GRAPH_SQL}, first as (select least(orig_src, orig_tgt) src, greatest(orig_src, orig_tgt) tgt, arg_min(relation, z.ord) relation, min(z.ord) ord from (select orig_src, orig_tgt, arg_max(struct_pack(relation := coalesce(relation, '')), ord).relation relation, max(ord) ord from r where orig_src is not null and orig_tgt is not null group by 1, 2) z group by 1, 2) select src, tgt, relation, ord from first")
def to_undirected(spark: SparkSession, d: str) -> DataFrame:
    return code_graph(spark, d, directed=True).undirected().edges.select("src", "tgt", F.coalesce("relation", F.lit("")).alias("relation"), "ord")


@query(f"with {GRAPH_SQL} select src, tgt from e where src in (select id from n where x.file_type = 'code') and tgt in (select id from n where x.file_type = 'code')")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = code_graph(spark, d)
    return g.subgraph(g.nodes.where("file_type = 'code'").select("id")).edges.select("src", "tgt")


@query(f"with {GRAPH_SQL}, gone as (select id from nodes where deleted_at is not null) select src, tgt from e where src not in (select id from gone) and tgt not in (select id from gone)")
def remove_nodes(spark: SparkSession, d: str) -> DataFrame:
    return code_graph(spark, d).without(table(spark, d, "nodes").where("deleted_at is not null").select("id")).edges.select("src", "tgt")


@query("""
with h as (select id, label, coalesce(repo, case when ord % 2 = 0 then 'left' else 'right' end) repo, ord % 2 half, ord from nodes where id is not null)
select id, arg_max(struct_pack(v := label), half * 1099511627776 + ord).v as label, arg_max(struct_pack(v := repo), half * 1099511627776 + ord).v repo from h group by id
""")
def merge_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Graphs of two halves of the table as one; the right one's statements come after the left one's."""
    n, e = table(spark, d, "nodes"), table(spark, d, "edges")
    halves = {}
    for name, cond in (("left", "ord % 2 = 0"), ("right", "ord % 2 = 1")):
        halves[name] = build_graph(n.where(cond), e.where(cond))
    return merge_repositories(halves).nodes.select("id", "label", "repo")


_DAY = "timestamp '2026-04-01'"
_UPDATED = f"""
with o_nodes as (select * from nodes where added_at < {_DAY}), o_edges as (select * from edges where seen_at < {_DAY}), {graph_sql('o_nodes', 'o_edges', 'o_')},
f_nodes as (select * from nodes where added_at >= {_DAY}), f_edges as (select * from edges where seen_at >= {_DAY}), redone as (select distinct source_file from f_nodes where source_file is not null),
u_nodes as (select ord, id, x.label as label, x.file_type file_type, x.source_file source_file, x.source_location source_location, x.community community, x.repo repo from o_n
        where (x.source_file is null or x.source_file not in (select source_file from redone)) and id not in (select id from f_nodes where id is not null)
    union all select ord + 1099511627776, id, label, file_type, source_file, source_location, community, repo from f_nodes),
u_edges as (select y.ord as ord, y.orig_src source, y.orig_tgt target, y.relation relation, y.confidence confidence, y.confidence_score confidence_score, y.weight weight, y.context context, y.source_file source_file, y.source_location source_location from o_e
    union all select ord + 1099511627776, source, target, relation, confidence, confidence_score, weight, context, source_file, source_location from f_edges),
{graph_sql('u_nodes', 'u_edges', 'u_')}
"""


def _updated(spark: SparkSession, d: str):
    """The graph of what was known before a day, updated by what came later."""
    n, e = table(spark, d, "nodes"), table(spark, d, "edges")
    old = build_graph(n.where(f"added_at < {_DAY}"), e.where(f"seen_at < {_DAY}"))
    fresh = n.where(f"added_at >= {_DAY}")
    return update_graph(old, fresh, e.where(f"seen_at >= {_DAY}"), fresh.select("source_file").distinct())


@query(_UPDATED + "select id, x.label as label, x.source_file source_file from u_n")
def update_merge(spark: SparkSession, d: str) -> DataFrame:
    return _updated(spark, d).nodes.select("id", "label", "source_file")


@query(_UPDATED + "select src, tgt, y.relation relation, y.confidence confidence from u_e")
def update_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    return _updated(spark, d).edges.select("src", "tgt", "relation", "confidence")


@query("select id, arg_min(struct_pack(v := label), ord).v as label, arg_min(struct_pack(v := source_file), ord).v source_file from nodes where id is not null group by id")
def merge_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return first_statement_wins(table(spark, d, "nodes").select("ord", "id", "label", "source_file")).select("id", "label", "source_file")


@query("select ord, coalesce(case confidence when 'EXTRACTED' then confidence_score = 1.0 when 'INFERRED' then confidence_score in (0.95, 0.85, 0.75, 0.65, 0.55) when 'AMBIGUOUS' then confidence_score between 0.1 and 0.3 end, true) fits from edges where confidence_score is not null")
def confidence_rubric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").where("confidence_score is not null").select("ord", validate.fits_rubric(F.col("confidence"), F.col("confidence_score")).alias("fits"))


_RULES = "union all ".join(
    f"select 'node' as section, ord as idx, {i} as rule_no, 'node: missing field ''{c}''' as message from nodes where {c} is null " for i, c in enumerate(validate.NODE_FIELDS)
) + "union all select 'node', ord, 4, 'node: invalid file_type ''' || file_type || '''' from nodes where file_type not in ('code','document','paper','image','rationale','concept') union all " + "union all ".join(
    f"select 'edge', ord, {i}, 'edge: missing field ''{c}''' from edges where {c} is null " for i, c in enumerate(validate.EDGE_FIELDS)
) + "union all select 'edge', ord, 5, 'edge: invalid confidence ''' || confidence || '''' from edges where confidence not in ('EXTRACTED','INFERRED','AMBIGUOUS')" + "".join(
    f" union all select 'edge', ord, {6 + i}, '{c} ''' || {c} || ''' names no node' from edges where {c} is not null and {c} not in (select id from nodes where id is not null)" for i, c in enumerate(("source", "target"))
)


@query(_RULES)
def validate_fragments(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate_fragments(table(spark, d, "nodes"), table(spark, d, "edges")).withColumn("rule_no", F.col("rule_no").cast("bigint"))


@query("select ord, case when starts_with(source_file, '/srv/ingest/') then substr(source_file, 13) else source_file end source_file from nodes")
def relativize_paths(spark: SparkSession, d: str) -> DataFrame:
    return relativized(table(spark, d, "nodes"), "/srv/ingest").select("ord", "source_file")


# -- analysis


@query(f"with {GRAPH_SQL} select id, coalesce(label, id) as label, degree, ord from d where not is_file and not is_concept order by degree desc, ord limit 10")
def god_nodes(spark: SparkSession, d: str) -> DataFrame:
    return analyze.god_nodes(code_graph(spark, d))


_EXT = "case when contains({0}, '.') then lower(split_part({0}, '.', -1)) else '' end"
_CATEGORY = "case when {0} in (" + ", ".join(f"'{x}'" for x in analyze.CODE_EXTENSIONS) + ") then 'code' when {0} = 'pdf' then 'paper' when {0} in (" + ", ".join(f"'{x}'" for x in analyze.IMAGE_EXTENSIONS) + ") then 'image' else 'doc' end"
_FAMILY = "case " + " ".join("when {0} in (" + ", ".join(f"'{x}'" for x in v) + f") then '{k}'" for k, v in analyze.LANGUAGE_FAMILIES.items()) + " end"


@query(f"with {GRAPH_SQL}, p as (select *, {_EXT.format('sf')} ext from d) select id, is_file, is_concept, {_CATEGORY.format('ext')} category, {_FAMILY.format('ext')} family, split_part(sf, '/', 1) top_dir from p where sf is not null")
def node_predicates(spark: SparkSession, d: str) -> DataFrame:
    n = analyze.described_nodes(code_graph(spark, d)).where("source_file is not null")
    f = F.col("source_file")
    return n.select("id", "is_file", "is_concept", analyze.file_category(f).alias("category"), analyze.language_family(f).alias("family"), T.top_level_dir(f).alias("top_dir"))


_SURPRISE = f"""
with {GRAPH_SQL}, j as (select e.src, e.tgt, coalesce(y.confidence, 'EXTRACTED') conf, coalesce(y.relation, '') rel, a.sf fa, b.sf fb, a.com ca, b.com cb, a.degree da, b.degree db, {_EXT.format('a.sf')} xa, {_EXT.format('b.sf')} xb
    from e join d a on y.orig_src = a.id join d b on y.orig_tgt = b.id where coalesce(y.relation, '') not in ('imports','imports_from','contains','method')
    and coalesce(a.sf, '') <> '' and coalesce(b.sf, '') <> '' and a.sf <> b.sf and not a.is_file and not b.is_file and not a.is_concept and not b.is_concept),
k as (select *, {_FAMILY.format('xa')} la, {_FAMILY.format('xb')} lb from j),
s as (select src, tgt, conf as confidence, rel as relation, case when conf = 'INFERRED' and rel = 'calls' and la <> lb then 0 when conf = 'AMBIGUOUS' then 3 when conf = 'INFERRED' then 2 else 1 end
    + case when {_CATEGORY.format('xa')} <> {_CATEGORY.format('xb')} then 2 else 0 end + case when split_part(fa, '/', 1) <> split_part(fb, '/', 1) then 2 else 0 end + case when ca <> cb then 1 else 0 end base,
    case when least(da, db) <= 2 and greatest(da, db) >= 5 then 1 else 0 end hub from k),
scored as (select src, tgt, confidence, relation, cast(case when relation = 'semantically_similar_to' then floor(base * 1.5) else base end + hub as bigint) score from s)
"""


@query(_SURPRISE + "select * from scored")
def surprise_scores(spark: SparkSession, d: str) -> DataFrame:
    return analyze.surprise_scores(code_graph(spark, d)).select("src", "tgt", "confidence", "relation", "score")


@query(_SURPRISE + "select src, tgt, confidence, relation, score from scored order by score desc, src, tgt limit 5")
def surprise_cross_file(spark: SparkSession, d: str) -> DataFrame:
    return analyze.cross_file_surprises(code_graph(spark, d)).select("src", "tgt", "confidence", "relation", "score")


@query(f"""
with {GRAPH_SQL}, p as (select least(a.com, b.com) low, greatest(a.com, b.com) high, case coalesce(y.confidence, 'EXTRACTED') when 'AMBIGUOUS' then 0 when 'INFERRED' then 1 when 'EXTRACTED' then 2 else 3 end conf_ord, e.src, e.tgt
    from e join d a on e.src = a.id join d b on e.tgt = b.id where a.com <> b.com and not a.is_file and not b.is_file and coalesce(y.relation, '') not in ('imports','imports_from','contains','method'))
select low, high, cast(conf_ord as bigint) conf_ord, src, tgt, 'Bridges community ' || low || ' → community ' || high note from p
qualify row_number() over (partition by low, high order by conf_ord, src, tgt) = 1 order by conf_ord, src, tgt limit 5
""")
def surprise_cross_community(spark: SparkSession, d: str) -> DataFrame:
    return analyze.cross_community_surprises(code_graph(spark, d))


@query("with " + PLACES_SQL.format(customers="") + """
, sizes as (select 's' k, id, up, 1 s from pl where id like 's%' union all select 'n', a.id, a.up, 1 + count(b.id) from pl a left join pl b on b.up = a.id where a.id like 'n%' group by 1, 2, 3),
tree as (select p.id, p.up, s.s, coalesce(case when p.id like 'n%' then p.up else q.up end, '') root from pl p join sizes s on p.id = s.id left join pl q on p.up = q.id),
total as (select root, 1 + sum(case when id like 'n%' then s else 0 end) t from tree group by 1)
select least(id, up) src, greatest(id, up) tgt, cast(s * (t - s) as double) betweenness from tree join total on tree.root = total.root
""")
def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Of a forest, where an edge that cuts s of t nodes off has s * (t - s)."""
    return analyze.edge_betweenness(place_graph(spark, d))


_DIFF = """
with o as (select distinct id from nodes where added_at < timestamp '2026-02-01'), w as (select distinct id from nodes where added_at < timestamp '2026-06-01' and (deleted_at is null or deleted_at >= timestamp '2026-06-01')),
x as (select 'new' as change, id from w where id not in (select id from o) union all select 'removed', id from o where id not in (select id from w))
"""


def _two_states(spark: SparkSession, d: str):
    n, e = table(spark, d, "nodes").where("id is not null"), table(spark, d, "edges")
    old = build_graph(n.where("added_at < timestamp '2026-02-01'"), e.where("seen_at < timestamp '2026-02-01'"))
    new = build_graph(n.where("added_at < timestamp '2026-06-01' and (deleted_at is null or deleted_at >= timestamp '2026-06-01')"), e.where("seen_at < timestamp '2026-06-01'"))
    return old, new


@query(_DIFF + "select * from x")
def graph_diff_nodes(spark: SparkSession, d: str) -> DataFrame:
    return analyze.graph_diff(*_two_states(spark, d))[0]


_DIFF_EDGES = f"""
with a_nodes as (select * from nodes where id is not null and added_at < timestamp '2026-02-01'), a_edges as (select * from edges where seen_at < timestamp '2026-02-01'), {graph_sql('a_nodes', 'a_edges', 'a_')},
b_nodes as (select * from nodes where id is not null and added_at < timestamp '2026-06-01' and (deleted_at is null or deleted_at >= timestamp '2026-06-01')), b_edges as (select * from edges where seen_at < timestamp '2026-06-01'), {graph_sql('b_nodes', 'b_edges', 'b_')},
o as (select src, tgt, coalesce(y.relation, '') relation from a_e), w as (select src, tgt, coalesce(y.relation, '') relation from b_e),
x as (select 'new' as change, * from (select * from w except select * from o) union all select 'removed', * from (select * from o except select * from w)),
c as (select (select count(*) from (select id from b_n except select id from a_n)) new_nodes, (select count(*) from (select id from a_n except select id from b_n)) removed_nodes,
    (select count(*) from x where change = 'new') new_edges, (select count(*) from x where change = 'removed') removed_edges)
"""


@query(_DIFF_EDGES + "select * from x")
def graph_diff_edges(spark: SparkSession, d: str) -> DataFrame:
    return analyze.graph_diff(*_two_states(spark, d))[1]


@query(_DIFF_EDGES + "select *, concat_ws(', ', " + ", ".join(f"case when {c} > 0 then {c} || ' {what}' || case when {c} = 1 then '' else 's' end || '{tail}' end" for c, what, tail in (("new_nodes", "new node", ""), ("new_edges", "new edge", ""), ("removed_nodes", "node", " removed"), ("removed_edges", "edge", " removed"))) + ") summary from c")
def graph_diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return analyze.diff_summary(*analyze.graph_diff(*_two_states(spark, d)))


@query(f"""
with {GRAPH_SQL}, m as (select com cid, id from d where com is not null), s as (select cid, count(*) n from m group by 1),
i as (select a.cid, count(*) k from e join m a on e.src = a.id join m b on e.tgt = b.id where a.cid = b.cid and e.src <> e.tgt group by 1)
select s.cid, n, coalesce(k, 0) internal, case when n <= 1 then 1.0 else floor(coalesce(k, 0) / (n * (n - 1) / 2.0) * 100.0 + 0.5) / 100.0 end cohesion from s left join i on s.cid = i.cid
""")
def cohesion(spark: SparkSession, d: str) -> DataFrame:
    g = code_graph(spark, d)
    return cluster.cohesion(g, cluster.stored_communities(g))


@query(f"with {GRAPH_SQL} select least(a.com, b.com) low, greatest(a.com, b.com) high, count(*) n_edges from e join d a on e.src = a.id join d b on e.tgt = b.id where a.com <> b.com group by 1, 2")
def meta_graph(spark: SparkSession, d: str) -> DataFrame:
    g = code_graph(spark, d)
    return cluster.meta_graph(g, cluster.stored_communities(g))


@query()
def louvain_exact(spark: SparkSession, d: str) -> DataFrame:
    """The forest of places has fewer edges than the exact mode's bound at the test scales."""
    return cluster.cluster_exact(place_graph(spark, d))


@query()
def louvain_scalable(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster_scalable(code_graph(spark, d))


@query(f"""
with {GRAPH_SQL}, t as (select count(*) n from e) select (select count(*) from n) n_nodes, (select (2 * count(*) - count(*) filter (where src = tgt)) // 2 from e) n_edges, (select count(distinct com) from d) n_communities,
    100 * count(*) filter (where y.confidence = 'EXTRACTED') // count(*) extracted_pct, 100 * count(*) filter (where y.confidence = 'INFERRED') // count(*) inferred_pct, 100 * count(*) filter (where y.confidence = 'AMBIGUOUS') // count(*) ambiguous_pct from e
""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return analyze.graph_stats(code_graph(spark, d))


@query(f"""
with {GRAPH_SQL}, c as (select coalesce(y.confidence, 'EXTRACTED') c, y.confidence_score s from e)
select count(*) filter (where c = 'EXTRACTED') n_extracted, cast(floor(count(*) filter (where c = 'EXTRACTED') * 100.0 / count(*) + 0.5) as bigint) pct_extracted,
    count(*) filter (where c = 'INFERRED') n_inferred, cast(floor(count(*) filter (where c = 'INFERRED') * 100.0 / count(*) + 0.5) as bigint) pct_inferred,
    count(*) filter (where c = 'AMBIGUOUS') n_ambiguous, cast(floor(count(*) filter (where c = 'AMBIGUOUS') * 100.0 / count(*) + 0.5) as bigint) pct_ambiguous,
    floor(avg(case when c = 'INFERRED' then coalesce(s, 0.5) end) * 100 + 0.5) / 100 inferred_mean from c
""")
def confidence_mix(spark: SparkSession, d: str) -> DataFrame:
    return analyze.confidence_mix(code_graph(spark, d))


@query(f"with {GRAPH_SQL} select id, coalesce(label, id) as label, degree, ord from d where degree <= 1 and not is_file and not is_concept")
def knowledge_gaps(spark: SparkSession, d: str) -> DataFrame:
    return analyze.knowledge_gaps(code_graph(spark, d))


@query(f"""
with {GRAPH_SQL}, names as (select id, coalesce(label, id) as label from d),
a as (select src, tgt from e where y.confidence = 'AMBIGUOUS' order by src, tgt limit 7), h as (select id, coalesce(label, id) as label, degree from d where not is_file and not is_concept order by degree desc, ord limit 7),
o as (select z.id, any_value(coalesce(z.label, z.id)) as label, count(distinct w.com) k, any_value(z.degree) degree, any_value(z.ord) ord from adj join d z on adj.src = z.id join d w on adj.tgt = w.id
    where z.com <> w.com and not z.is_file and not z.is_concept group by z.id order by k desc, degree desc, ord limit 7),
s as (select com cid, count(*) n from d where com is not null group by 1), i as (select p.com cid, count(*) k from e join d p on e.src = p.id join d q on e.tgt = q.id where p.com = q.com and e.src <> e.tgt group by 1),
c as (select s.cid, n, case when n <= 1 then 1.0 else floor(coalesce(k, 0) / (n * (n - 1) / 2.0) * 100.0 + 0.5) / 100.0 end cohesion from s left join i on s.cid = i.cid),
l as (select * from c where n >= 5 and cohesion < 0.15 order by cohesion, n desc, cid limit 7), g as (select coalesce(label, id) as label from d where degree <= 1 and not is_file and not is_concept order by ord limit 7)
select 'ambiguous' kind, 'How is ' || x.label || ' related to ' || y.label || '?' question, 'the edge is marked ambiguous' why from a join names x on a.src = x.id join names y on a.tgt = y.id
union all select 'bridge', 'Why does ' || label || ' connect different communities?', 'neighbours in ' || k || ' other communities' from o
union all select 'hub', 'What depends on ' || label || '?', degree || ' connections' from h union all select 'loose', 'Should community ' || cid || ' be split?', n || ' members with few links among them' from l
union all select 'gap', 'What does ' || label || ' belong to?', 'at most one connection' from g
""")
def suggested_questions(spark: SparkSession, d: str) -> DataFrame:
    return analyze.suggested_questions(code_graph(spark, d))


# -- aggregation over several groupings, and SQL text


_BY = "coalesce(repo, 'none') repo, coalesce(relation, 'none') relation, coalesce(confidence, 'none') confidence"


def _labelled_edges(spark: SparkSession, d: str) -> DataFrame:
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    return table(spark, d, "edges").select(none("repo"), none("relation"), none("confidence"), "weight")


@query(f"select repo, relation, confidence, count(*) n, grouping(repo, relation, confidence) level from (select {_BY} from edges) group by cube (repo, relation, confidence)")
def edge_cube(spark: SparkSession, d: str) -> DataFrame:
    return _labelled_edges(spark, d).cube("repo", "relation", "confidence").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query(f"select repo, relation, count(*) n, grouping(repo, relation) level from (select {_BY} from edges) group by rollup (repo, relation)")
def edge_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _labelled_edges(spark, d).rollup("repo", "relation").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query(f"select repo, relation, confidence, count(*) n from (select {_BY} from edges) group by grouping sets ((repo, confidence), (relation), ())")
def edge_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    e = _labelled_edges(spark, d)
    return e.groupingSets([["repo", "confidence"], ["relation"], []], "repo", "relation", "confidence").agg(F.count(F.lit(1)).alias("n")).select("repo", "relation", "confidence", "n")


_SQL_TEXT = """
select n.repo, count(*) n_nodes, count(distinct n.label) n_labels from nodes n
where n.id is not null and exists (select 1 from edges e where e.target = n.id and e.relation = 'calls')
  and n.ord <= (select max(ord) from nodes) group by n.repo having count(*) > (select count(*) / 100 from repos)
"""


@query("with repos as (select distinct repo from nodes)" + _SQL_TEXT)
def sql_text(spark: SparkSession, d: str) -> DataFrame:
    """SQL text with subqueries over the tables as views."""
    return sql.run(spark, d, _SQL_TEXT, {"repos": "select distinct repo from nodes"})


@query(f"select distinct id, {_KEY.format('id')} normal, lower(regexp_replace(regexp_replace(regexp_replace(id, '^[_.]+|[_.]+$', '', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) made from nodes where id is not null")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions that are registered for SQL."""
    return sql.run(spark, d, "select distinct id, normalize_id(id) normal, make_id(id) made from nodes where id is not null")


# -- searching


def _fold_sql(x: str) -> str:
    """SQL of ``search.norm_label``: compatibility forms written out, accents off, lower case."""
    one, many = {}, {}
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0xFFF0)]:
        c = chr(code)
        if unicodedata.decomposition(c).startswith("<") and (to := unicodedata.normalize("NFKD", c)) != c:
            (one if len(to) == 1 else many)[c] = to
    for c in (c for c in many if unicodedata.name(c).startswith("LATIN ")):
        x = f"replace({x}, '{c}', '{many[c]}')"
    # marks of their own go; a quote is doubled
    text = lambda cs: "".join(cs).replace("'", "''")
    return f"lower(strip_accents(regexp_replace(translate({x}, '{text(one)}', '{text(one.values())}'), '\\p{{M}}', '', 'g')))"


_ASKED = (("q1", "where does the catalog load its schema"), ("q2", "main()"), ("q3", "render filter module"))
_TERMS = [(q, search.query_terms(t)) for q, t in _ASKED]
_SCORES = rf"""
with {GRAPH_SQL}, q(q_id, terms) as (values {", ".join(f"('{q}', [{', '.join(repr(w) for w in t)}])" for q, t in _TERMS)}),
l as (select id, ord, {_fold_sql("coalesce(x.label, '')")} l, lower(coalesce(x.source_file, '')) f from n),
hit as (select q_id, id, ord, list_sum([case when contains(l, t) then 1.0 else 0.0 end + case when contains(f, t) then 0.5 else 0.0 end for t in terms])
    + case when len([t for t in terms if t = l or t = regexp_replace(l, '(\(\))+$', '')]) > 0 then 100.0 else 0.0 end score from l, q)
"""


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TERMS, "q_id string, terms array<string>")


@query(_SCORES + "select q_id, id, cast(score as double) score, ord from hit where score > 0")
def score_nodes(spark: SparkSession, d: str) -> DataFrame:
    return search.score_nodes(code_graph(spark, d).nodes, _questions(spark))


@query(_SCORES + "select q_id, row_number() over (partition by q_id order by score desc, ord) place, id, cast(score as double) score from hit where score > 0 qualify place <= 3")
def query_seeds(spark: SparkSession, d: str) -> DataFrame:
    return search.query_seeds(code_graph(spark, d).nodes, _questions(spark))


@query(f"with {GRAPH_SQL} select ord, id, x.label as label from n where contains(lower(x.label), 'catalog') or lower(id) = 'catalog'")
def find_nodes(spark: SparkSession, d: str) -> DataFrame:
    return search.find_nodes(code_graph(spark, d).nodes, "Catalog")


@query(f"with {GRAPH_SQL} select id, {_fold_sql('x.label')} norm_label from n")
def norm_labels(spark: SparkSession, d: str) -> DataFrame:
    """Null for a null label."""
    return search.with_norm_label(code_graph(spark, d).nodes).select("id", "norm_label")


@query("with recursive " + PLACES_SQL.format(customers=" union all select 'c_' || c_custkey, 'n_' || c_nationkey from customer") + """
, b as (select 'r_0' id, 0 depth union select padj.tgt, depth + 1 from b join padj on b.id = padj.src where depth < 3)
select 0 as q_id, id, cast(min(depth) as bigint) depth from b group by id
""")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([(0, "r_0")], "q_id int, id string")
    return traverse.bfs_levels(place_graph(spark, d, customers=True), start)


_REACH = f"""
with recursive {GRAPH_SQL}, start as (select id from d where not is_file and not is_concept order by degree desc, d.ord limit 1),
b as (select id, 0 depth from start union select adj.tgt, depth + 1 from b join adj on b.id = adj.src where depth < 2 and adj.y.context = 'call'), lv as (select id, min(depth) depth from b group by id)
"""


def _hub_call_levels(spark: SparkSession, d: str):
    g = code_graph(spark, d)
    start = analyze.god_nodes(g, 1).select(F.lit(0).alias("q_id"), "id")
    return g, traverse.bfs_levels(g, start, 2, ["call"])


@query(_REACH + "select 0 as q_id, id, cast(depth as bigint) depth from lv")
def bfs_context_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _hub_call_levels(spark, d)[1]


@query(_REACH + "select 0 as q_id, adj.src, adj.tgt from adj join lv a on adj.src = a.id join lv b on adj.tgt = b.id where b.depth = a.depth + 1 and adj.y.context = 'call'")
def bfs_edges(spark: SparkSession, d: str) -> DataFrame:
    g, levels = _hub_call_levels(spark, d)
    return traverse.bfs_edges(g, levels, ["call"])


@query("with recursive " + PLACES_SQL.format(customers="") + """
, b as (select 'n_3' id, ['n_3'] path, 0 depth union all select padj.tgt, list_append(path, padj.tgt), depth + 1 from b join padj on b.id = padj.src where depth < 3 and not list_contains(path, padj.tgt))
select 0 q_id, row_number() over (order by path) - 1 place, id, cast(depth as bigint) depth from b
""")
def dfs_order(spark: SparkSession, d: str) -> DataFrame:
    """Of a tree, where depth-first order is the order of paths."""
    g = place_graph(spark, d)
    return traverse.dfs_order(g, spark.createDataFrame([(0, "n_3")], "q_id int, id string"))


@query("with recursive " + PLACES_SQL.format(customers="") + """
, pairs as (select s_suppkey q_id, 's_' || s_suppkey source, 'r_0' target from supplier), b as (select q_id, source id, target, 0 hops from pairs union select b.q_id, padj.tgt, b.target, hops + 1 from b join padj on b.id = padj.src where hops < 4)
select p.q_id, (select min(hops) from b where b.q_id = p.q_id and b.id = p.target) hops from pairs p
""")
def shortest_path_hops(spark: SparkSession, d: str) -> DataFrame:
    """From every supplier to the first region, which is in the same tree or out of reach."""
    pairs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("q_id"), F.concat(F.lit("s_"), F.col("s_suppkey").cast("string")).alias("source"), F.lit("r_0").alias("target"))
    return traverse.shortest_paths(place_graph(spark, d), pairs, 4).select("q_id", "hops")


@query(f"""
with {GRAPH_SQL}, hub as (select id from d where not is_file and not is_concept order by degree desc, ord limit 3)
select adj.src id, row_number() over (partition by adj.src order by deg.degree desc, adj.tgt) place, adj.tgt neighbor, coalesce(adj.y.relation, '') relation, deg.degree, count(*) over (partition by adj.src) n_neighbors
from adj join hub on adj.src = hub.id join deg on adj.tgt = deg.id qualify place <= 20
""")
def explain_neighbors(spark: SparkSession, d: str) -> DataFrame:
    g = code_graph(spark, d)
    return search.explain_neighbors(g, analyze.god_nodes(g, 3))


_SHOWN = "regexp_replace(coalesce({0}, {1}), '\\p{{Cc}}', '', 'g')"


@query(_SCORES + f"""
, seed as (select q_id, id, row_number() over (partition by q_id order by score desc, ord) place from hit where score > 0 qualify place <= 3),
lv as (select q_id, id, min(depth) depth from (select q_id, id, 0 depth from seed union all select q_id, adj.tgt, 1 from seed join adj on seed.id = adj.src) group by 1, 2),
ln as (select lv.q_id, 0 kind, coalesce(seed.place, 1099511627776) a, -degree b, d.ord c, 'NODE ' || {_SHOWN.format('d.label', 'd.id')} || ' [src=' || {_SHOWN.format('x.source_file', "''")} || ' loc=' || {_SHOWN.format('x.source_location', "''")} || ' community=' || coalesce(cast(com as varchar), '') || ']' line
        from lv join d on lv.id = d.id join n on n.id = d.id left join seed on seed.q_id = lv.q_id and seed.id = lv.id
    union all select p.q_id, 1, 0, 0, e.y.ord, 'EDGE ' || {_SHOWN.format('da.label', 'da.id')} || ' --' || coalesce(e.y.relation, '') || ' [' || coalesce(e.y.confidence, '') || ']--> ' || {_SHOWN.format('db.label', 'db.id')}
        from (select distinct a.q_id, least(adj.src, adj.tgt) src, greatest(adj.src, adj.tgt) tgt from adj join lv a on adj.src = a.id and a.depth = 0 join lv z on adj.tgt = z.id and z.q_id = a.q_id and z.depth = 1) p
        join e on e.src = p.src and e.tgt = p.tgt join d da on da.id = p.src join d db on db.id = p.tgt),
o as (select q_id, line, row_number() over w place, sum(strlen(line) + 1) over (w rows unbounded preceding) used from ln window w as (partition by q_id order by kind, a, b, c, line))
select q_id, place, line from o where used <= 6000
""")
def query_lines(spark: SparkSession, d: str) -> DataFrame:
    g = code_graph(spark, d)
    seeds = search.query_seeds(g.nodes, _questions(spark))
    levels = traverse.bfs_levels(g, seeds, 1)
    return search.render_lines(g, levels, traverse.bfs_edges(g, levels), seeds)


_BENCHMARK = ("catalog schema", "render filter", "no such words anywhere")


@query(f"""
with recursive {GRAPH_SQL}, q(q_id, terms) as (values {", ".join(f"({i}, [{', '.join(repr(w.lower()) for w in t.split() if len(w) > 2)}])" for i, t in enumerate(_BENCHMARK))}),
hit as (select q_id, id, ord, len(list_filter(terms, lambda t: contains(lower(coalesce(x.label, '')), t))) hits from n, q),
seed as (select q_id, id from hit where hits > 0 qualify row_number() over (partition by q_id order by hits desc, ord) <= 3),
b as (select q_id, id, 0 depth from seed union select b.q_id, adj.tgt, depth + 1 from b join adj on b.id = adj.src where depth < 3), lv as (select q_id, id, min(depth) depth from b group by 1, 2),
nm as (select id, coalesce(x.label, id) as label, coalesce(x.source_file, '') f, coalesce(x.source_location, '') l from n),
line as (select q_id, 'NODE ' || label || ' src=' || f || ' loc=' || l t from lv join nm on lv.id = nm.id
    union all select a.q_id, 'EDGE ' || na.label || ' --' || coalesce(adj.y.relation, '') || '--> ' || nb.label from adj join lv a on adj.src = a.id join lv z on adj.tgt = z.id and z.q_id = a.q_id and z.depth = a.depth + 1 join nm na on na.id = adj.src join nm nb on nb.id = adj.tgt),
tok as (select q_id, greatest((sum(strlen(t) + 1) - 1) // 4, 1) tokens from line group by 1), c as (select count(*) * 50 * 100 // 75 corpus_tokens from n)
select corpus_tokens, count(*) n_questions, cast(floor(avg(tokens)) as bigint) avg_tokens, floor(corpus_tokens / cast(floor(avg(tokens)) as bigint) * 10 + 0.5) / 10 ratio from tok, c group by corpus_tokens
""")
def token_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return search.run_benchmark(code_graph(spark, d), _BENCHMARK)


# -- texts and files


@query("select doc_id, greatest(strlen(text) // 4, 1) tokens from documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """1 for a null text, as for an empty one."""
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"""
select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') html, replace(text, '</', '<\/') script, url_encode(text) url,
    regexp_replace(replace(replace(text, '\', '\\'), '"', '\"'), '[\r\n]', ' ', 'g') yaml, format('{:,}', n_chars) chars, substr(regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g'), 1, 256) as label from documents
""")
def text_escapes(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as they go into pages, scripts, addresses and front matter."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.html_escape(t).alias("html"), T.script_escape(t).alias("script"), T.url_component(t).alias("url"), T.yaml_string(t).alias("yaml"), T.thousands(F.col("n_chars")).alias("chars"), T.sanitize_label(t).alias("label"))


@query(r"""
with l as (select distinct label from nodes where label is not null),
s as (select label, coalesce(nullif(substr(regexp_replace(regexp_replace(translate(label, '/: ', '--_'), '[\\*?"<>|#^\[\]\x00-\x1F]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g'), 1, 200), ''), 'unnamed') s from l),
k as (select label, s, row_number() over (partition by lower(s) order by label) k from s)
select label as name, case when k = 1 then s else s || '_' || k end slug from k
""")
def wiki_names(spark: SparkSession, d: str) -> DataFrame:
    """File names of articles on all labels, numbered where several labels have the same."""
    return export.wiki_slugs(table(spark, d, "nodes").where("label is not null").select(F.col("label").alias("name")))


@query(r"""
select file_id, split_part(rel_path, '/', -1) as name, case when contains(rel_path, '.') then lower(split_part(rel_path, '.', -1)) else '' end ext, split_part(rel_path, '/', 1) top,
    case when contains(rel_path, '/') then coalesce(nullif(split_part(rel_path, '/', -2), '') || '.', '') else '' end || regexp_replace(split_part(rel_path, '/', -1), '^(.+)\.[^.]*$', '\1') stem,
    lower(regexp_replace(regexp_replace(regexp_replace(rel_path, '^[_.]+|[_.]+$', '', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) id from source_files
""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("rel_path")
    return table(spark, d, "source_files").select("file_id", T.basename(p).alias("name"), T.file_extension(p).alias("ext"), T.top_level_dir(p).alias("top"), T.file_stem(p).alias("stem"), T.make_id(p).alias("id"))


_SPACES = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"select doc_id, case when text is null then 0 else len(list_filter(regexp_split_to_array(text, '{_SPACES}'), lambda w: w <> '')) end n_words from documents")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


#: Unicode's words, digits and white space for an engine whose classes are ASCII; a word's border as a character beside it.
_UNICODE = lambda p: p.replace(r"\b", r"(?:^|$|[^\p{L}\p{M}\p{N}\p{Pc}])").replace(r"\s", r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]").replace(r"\d", r"\p{Nd}")
_HEAD = "coalesce(" + ", ".join(f"try(decode(encode(text)[1:{3000 - k}]))" for k in range(4)) + ", '')"


@query("select doc_id, " + " + ".join(f"case when regexp_matches(head, '{_UNICODE(p)}') then 1 else 0 end" for p in PAPER_SIGNALS) + f" signals from (select doc_id, {_HEAD} head from documents)")
def paper_signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", detect.paper_signals(F.col("text")).alias("signals"))


_NAME = "split_part(replace(rel_path, '\\', '/'), '/', -1)"
_FT = f"lower(case when contains({_NAME}, '.') then split_part({_NAME}, '.', -1) else '' end)"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query(f"select entry_id, case when {_FT} in {_IN(detect.X.PAPER_EXTENSIONS)} then 'paper' when {_FT} in {_IN(detect.X.IMAGE_EXTENSIONS)} then 'image' when {_FT} in {_IN(detect.X.VIDEO_EXTENSIONS)} then 'video' when {_FT} in {_IN(detect.X.CODE_EXTENSIONS)} then 'code' when {_FT} in {_IN(detect.X.DOC_EXTENSIONS)} then 'document' end kind from scan_entries")
def classify_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scan_entries").select("entry_id", detect.file_type(F.translate("rel_path", "\\", "/")).alias("kind"))


@query("select file_id, lower(split_part(rel_path, '/', -1)) in ('.env', '.envrc') " + "".join(f" or lower(split_part(rel_path, '/', -1)) like '%{s}'" for s in SENSITIVE_SUFFIXES) + " or regexp_matches(lower(split_part(rel_path, '/', -1)), 'credential|secret|passwd|password|token|private_key') sensitive from source_files")
def sensitive_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", detect.is_sensitive(F.col("rel_path")).alias("sensitive"))


_RULE_LINES = ["*.java", "tests/", "!keep.java", "/src/*.py"]


@query(r"select file_id, regexp_matches(rel_path, '(^|/)tests(/|$)') or (regexp_matches(rel_path, '\.java(/|$)') and not regexp_matches(rel_path, '(^|/)keep\.java(/|$)')) or regexp_matches(rel_path, '^src/.*\.py(/|$)') ignored, len(list_filter(split(rel_path, '/')[:-2], lambda p: p in " + _IN((*SKIPPED_DIRS, "graph-out")) + " or p like '.%')) > 0 skipped from source_files")
def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("rel_path")
    return table(spark, d, "source_files").select("file_id", detect.IgnoreRules(_RULE_LINES).column(path).alias("ignored"), detect.in_skipped_dir(path).alias("skipped"))


_FILE_HASH = "sha256(encode(body) || '\\x00'::blob || encode(rel_path))"


@query(f"select file_id, {_FILE_HASH} hash from source_files")
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", ingest.file_hash(F.col("body"), F.col("rel_path")).alias("hash"))


@query(f"""
with s as (select run_id, repo || '/' || {_PATH} p, min({_DIGEST}) h, min(file_type) t from scan_entries where rel_path is not null group by 1, 2), runs_of as (select distinct run_id from scan_entries),
k as (select run_id, repo || '/' || {_PATH} p, {_DIGEST} h, file_type t, entry_id from manifest_entries where rel_path is not null),
m as (select r.run_id, k.p, arg_max(struct_pack(h := k.h, t := k.t), k.run_id * 1000000000 + k.entry_id) x from runs_of r join k on k.run_id < r.run_id group by 1, 2)
select coalesce(s.run_id, m.run_id) run_id, coalesce(s.p, m.p) rel_path, case when s.p is null then 'deleted' when m.p is null then 'new' when s.h = x.h then 'unchanged' else 'changed' end status,
    case when s.p is null or (m.p is not null and s.h = x.h) then x.t else s.t end file_type from s full join m on s.p = m.p and s.run_id = m.run_id
""")
def manifest_status(spark: SparkSession, d: str) -> DataFrame:
    """The scan of every run against everything recorded before it; the last record before a run is found by the runs (a fixed few)."""
    path = F.concat("repo", F.lit("/"), T.forward_path(F.col("rel_path"))).alias("rel_path")
    scans = table(spark, d, "scan_entries").where("rel_path is not null")
    scan = scans.groupBy("run_id", path).agg(F.min(T.digest(F.col("hash"))).alias("hash"), F.min("file_type").alias("file_type"))
    records = table(spark, d, "manifest_entries").where("rel_path is not null").groupBy(path, "run_id").agg(F.max_by(F.struct(T.digest(F.col("hash")).alias("hash"), "file_type"), "entry_id").alias("x"))
    # a record counts for the runs after its own up to the one of the next record of its path
    until = F.lead("run_id").over(Window.partitionBy("rel_path").orderBy("run_id"))
    kept = records.withColumn("until", until).alias("k")
    runs = scans.select("run_id").distinct().alias("r")
    held = (F.col("k.run_id") < F.col("r.run_id")) & (F.col("k.until").isNull() | (F.col("r.run_id") <= F.col("k.until")))
    known = kept.join(F.broadcast(bounded(runs, 100_000, "runs")), held).select("r.run_id", "k.rel_path", "k.x.hash", "k.x.file_type")
    return detect.manifest_status(scan, known, ["run_id"])


_URL = r"nullif(regexp_replace(regexp_extract(regexp_extract(text, '^---\r?\n((?s:.*?))\r?\n---', 1), '(?m)^source_url: *(.*?)\r?$', 1), '^\x22|\x22$', '', 'g'), '')"


@query(f"select doc_id, u url, case when contains(lower(u), 'twitter.com') or contains(lower(u), 'x.com') then 'tweet' when contains(lower(u), 'arxiv.org') then 'arxiv' when contains(lower(u), 'github.com') then 'github' when contains(lower(u), 'youtube.com') or contains(lower(u), 'youtu.be') then 'youtube' when regexp_extract(lower(u), '^[a-z][a-z0-9_+.-]*://[^/?#]*([^?#]*)', 1) like '%.pdf' then 'pdf' else 'webpage' end kind from (select doc_id, {_URL} u from documents) where u is not null")
def url_types(spark: SparkSession, d: str) -> DataFrame:
    """Of the addresses in the front matter of captured pages."""
    u = table(spark, d, "documents").select("doc_id", ingest.front_matter(F.col("text"), "source_url").alias("url")).where("url is not null")
    return u.select("doc_id", "url", ingest.url_type(F.col("url")).alias("kind"))


@query(rf"select doc_id, substr(regexp_replace(regexp_replace(regexp_replace(u, '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) name from (select doc_id, {_URL} u from documents) where u is not null")
def safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "documents").select("doc_id", ingest.front_matter(F.col("text"), "source_url").alias("url")).where("url is not null")
    return u.select("doc_id", T.safe_filename(F.col("url")).alias("name"))


@query(r"select doc_id, substr(trim(regexp_replace(regexp_replace('<title> t ' || doc_id || ' </title><script x>v</script><p>' || text, '(?is)<script[^>]*>.*?</script>', ' ', 'g').regexp_replace('(?is)<style[^>]*>.*?</style>', ' ', 'g').regexp_replace('<[^>]+>', ' ', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g'), ' '), 1, 8000) body from documents where text is not null")
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents wrapped in markup and unwrapped again."""
    html = F.concat(F.lit("<title> t "), F.col("doc_id").cast("string"), F.lit(" </title><script x>v</script><p>"), F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", ingest.html_to_text(html).alias("body"))


@query("""
with n as (select ord doc, id, label, file_type, source_file from nodes)
select doc, 'node' section, 0 idx, 1 rule_no, 'node: missing field ''id''' message from n where id is null union all select doc, 'node', 0, 2, 'node: missing field ''label''' from n where label is null
union all select doc, 'node', 0, 3, 'node: missing field ''file_type''' from n where file_type is null union all select doc, 'node', 0, 4, 'node: missing field ''source_file''' from n where source_file is null
union all select doc, 'node', 0, 5, 'node: invalid file_type ''' || file_type || '''' from n where file_type not in ('code','document','paper','image','rationale','concept')
union all select doc, 'edges', null, 0, 'missing key ''edges''' from n where doc % 5 = 0
""")
def validate_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every node statement as a JSON document of its own, some without edges."""
    node = F.struct("id", "label", "file_type", "source_file")
    none = F.array().cast("array<string>")
    docs = table(spark, d, "nodes").select(F.col("ord").alias("doc"), F.to_json(F.struct(F.array(node).alias("nodes"), F.when(F.col("ord") % 5 != 0, none).alias("edges"))).alias("json"))
    return validate.validate_documents(docs)


@query(r"""
with p as (select doc_id, 't ' || doc_id title, 'https://h.org/' || doc_id url, '<title> t ' || doc_id || ' </title><script x>v</script><p>' || text html from documents),
b as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g'), ' ') body from p)
select url, '---' || chr(10) || 'source_url: "' || url || '"' || chr(10) || 'type: webpage' || chr(10) || 'title: "' || title || '"' || chr(10) || 'contributor: "unknown"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || substr(body, 1, 12000) || chr(10) document from b where html is not null
union all select url, null from b where html is null
""")
def page_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents wrapped in markup, as captured pages; null for a null page."""
    html = F.concat(F.lit("<title> t "), F.col("doc_id").cast("string"), F.lit(" </title><script x>v</script><p>"), F.col("text"))
    return ingest.page_documents(table(spark, d, "documents").select(F.concat(F.lit("https://h.org/"), F.col("doc_id").cast("string")).alias("url"), html.alias("html")))


@query(r"""
select substr(regexp_replace(regexp_replace(lower(q), '[^\w]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50) slug, '---' || chr(10) || 'type: ' || kind || chr(10) || 'question: "' || q || '"' || chr(10) || 'nodes: [' || repo || ', ' || doc_id || ']' || chr(10) || '---' || chr(10) || chr(10) || '# Answer' || chr(10) || chr(10) || text || chr(10) document
from (select *, 'What of ' || repo || ' (' || doc_id || ')?' q from documents)
""")
def answer_documents(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("What of "), "repo", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")?"))
    rows = table(spark, d, "documents").select(q.alias("question"), F.col("text").alias("answer"), "kind", F.array("repo", F.col("doc_id").cast("string")).alias("nodes"))
    return ingest.answer_documents(rows)


@query(r"""
select doc_id, sha256(encode(case when lower(rel_path) like '%.md' then regexp_replace(text, '^---\r?\n(?s:.*?)\r?\n---[ \t]*(\r?\n|$)', '') else text end) || '\x00'::blob || encode(rel_path)) hash from documents
""")
def document_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Markdown counts without its front matter; null without text or path."""
    return table(spark, d, "documents").select("doc_id", ingest.file_hash(F.col("text"), F.col("rel_path")).alias("hash"))


@query("""
with p as (select doc_id, doc_id % 256 a, (doc_id // 256) * 37 % 256 b, doc_id % 3 c from documents)
select doc_id, case when a in (0, 10, 127) or a >= 224 or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 169 and b = 254) or (a = 100 and b between 64 and 127) or (a = 192 and b = 0 and c in (0, 2))
    or (a = 198 and b = 51 and c = 100) or (a = 203 and b = 0 and c = 113) then 'internal address' end reason, a || '.' || b || '.' || c || '.1' host, true as url from p
""")
def url_safety(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made of the documents' numbers."""
    i = F.col("doc_id")
    host = F.concat_ws(".", (i % 256).cast("string"), F.pmod(F.floor(i / 256) * 37, F.lit(256)).cast("string"), (i % 3).cast("string"), F.lit("1"))
    u = F.concat(F.lit("http://user@"), host, F.lit(":80/x?y#z"))
    return table(spark, d, "documents").select("doc_id", ingest.unsafe_url(u).alias("reason"), ingest.url_host(u).alias("host"), ingest.is_url(u).alias("url"))


@query(r"""
with h as (select distinct label, trim(regexp_replace(regexp_replace(label, '\r\n|\r|\n', ' ', 'g'), '[\\/*?:"<>|#^\[\]]', '', 'g'), ' ') n from nodes where label is not null)
select label, coalesce(nullif(trim(regexp_replace(n, '(?i)\.(mdx|md|markdown)$', ''), ' '), ''), 'unnamed') heading from h
""")
def community_headings(spark: SparkSession, d: str) -> DataFrame:
    """All labels as headings of a report's links."""
    return table(spark, d, "nodes").where("label is not null").select("label").distinct().select("label", T.community_name(F.col("label")).alias("heading"))


@query(f"""
with f as (select file_type t, coalesce(n_words, 0) w, lower(split_part(replace(rel_path, '\\', '/'), '/', -1)) b from scan_entries),
s as (select *, b in ('.env', '.envrc') {"".join(f" or b like '%{x}'" for x in SENSITIVE_SUFFIXES)} or regexp_matches(b, 'credential|secret|passwd|password|token|private_key') hid from f)
select count(*) filter (where t = 'code' and not hid) n_code, count(*) filter (where t = 'document' and not hid) n_document, count(*) filter (where t = 'paper' and not hid) n_paper, count(*) filter (where t = 'image' and not hid) n_image,
    count(*) filter (where t = 'video' and not hid) n_video, cast(sum(w) as bigint) total_words, count(*) filter (where hid) n_sensitive, count(*) filter (where not hid) total_files, count(*) filter (where not hid) > 0 needs_graph, sum(w) > 50000 large from s
""")
def detection_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of everything that was ever scanned."""
    files = table(spark, d, "scan_entries").select("file_type", "n_words", detect.is_sensitive(T.forward_path(F.col("rel_path"))).alias("sensitive"))
    return detect.detection_summary(files)


# -- extraction and outputs


@query(r"""
with n as (select distinct repo, regexp_replace(regexp_replace(label, '^\\.', ''), '(\\(\\))+$', '') as name, id, source_file from nodes where label is not null and source_file is not null and label like '%()'),
s as (select distinct e.repo, e.source, t.name, e.source_file, e.ord line from edges e join n t on e.target = t.id and e.repo = t.repo where e.relation = 'calls'),
c as (select s.*, count(*) filter (where n.source_file = s.source_file) here, count(*) filter (where n.source_file <> s.source_file) away, min(n.id) filter (where n.source_file = s.source_file) a, min(n.id) filter (where n.source_file <> s.source_file) b
    from s join n on n.repo = s.repo and n.name = s.name group by all)
select repo, source, a as target, 'EXTRACTED' as confidence, source_file, line from c where here = 1 union all select repo, source, b, 'INFERRED', source_file, line from c where away = 1
""")
def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Calls by bare name, made of the resolved ones of the table, resolved again by their names."""
    n = table(spark, d, "nodes").where("label is not null and source_file is not null and label like '%()'").select("repo", "id", "label", "source_file").distinct()
    named = n.select("repo", F.col("id").alias("target"), T.strip_call(F.regexp_replace("label", r"^\.", "")).alias("name"))
    calls = table(spark, d, "edges").where("relation = 'calls'").select("repo", "source", "target", "source_file", F.col("ord").alias("line"))
    stubs = calls.join(named, ["repo", "target"]).select("repo", "source", "name", "source_file", "line").distinct()
    return extraction.resolve_calls(n, stubs, ["repo"])


@query()
def extracted_nodes(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract_repositories(table(spark, d, "source_files"))[0]


@query()
def extracted_edges(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract_repositories(table(spark, d, "source_files"))[1]


@query(f"with h as (select file_id, rel_path, {_FILE_HASH} hash from source_files) select file_id, hash from h where hash not in (select hash from h where file_id % 3 = 0)")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Of all files, with a cache that holds every third one."""
    f = table(spark, d, "source_files").select("file_id", "rel_path", "body")
    cache = f.where("file_id % 3 = 0").select(ingest.file_hash(F.col("body"), F.col("rel_path")).alias("hash"), F.lit("ast").alias("kind"))
    return extraction.cache_misses(f, cache).select("file_id", "hash")


@query(rf"""
with {GRAPH_SQL}, esc as (select ord, replace(replace(id, '\\', '\\\\'), '''', '\\''') i, replace(replace(coalesce(x.label, id), '\\', '\\\\'), '''', '\\''') l, coalesce(x.file_type, 'Node') t from n)
select ord, 0 as part, 'MERGE (n:' || regexp_replace(upper(substr(t, 1, 1)) || substr(t, 2), '[^A-Za-z0-9_]', '_', 'g') || ' {{id: ''' || i || '''}}) SET n.label = ''' || l || ''';' line from esc
union all select y.ord, 1, 'MATCH (a {{id: ''' || replace(y.orig_src, '''', '\\''') || '''}}), (b {{id: ''' || replace(y.orig_tgt, '''', '\\''') || '''}}) MERGE (a)-[:' || regexp_replace(upper(coalesce(y.relation, 'RELATED_TO')), '[ -]', '_', 'g') || ' {{confidence: ''' || coalesce(y.confidence, 'EXTRACTED') || '''}}]->(b);' from e
""")
def cypher_lines(spark: SparkSession, d: str) -> DataFrame:
    return export.cypher_lines(code_graph(spark, d))


_XML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(f"""
with {GRAPH_SQL} select ord, 0 as part, '<node id="' || {_XML.format('id')} || '"><data key="label">' || {_XML.format('coalesce(x.label, id)')} || '</data><data key="community">' || coalesce(cast(x.community as varchar), '') || '</data></node>' line from n
union all select y.ord, 1, '<edge id="e' || (row_number() over (order by y.ord) - 1) || '" source="' || {_XML.format('src')} || '" target="' || {_XML.format('tgt')} || '"><data key="relation">' || {_XML.format("coalesce(y.relation, 'related')")} || '</data><data key="confidence">' || coalesce(y.confidence, 'EXTRACTED') || '</data></edge>' from e
""")
def graphml_lines(spark: SparkSession, d: str) -> DataFrame:
    return export.graphml_lines(code_graph(spark, d))


@query(f"""
with {GRAPH_SQL} select 'nodes' part, ord, cast(json_merge_patch('{{}}', to_json(struct_pack(id := id, label := x.label, file_type := x.file_type, source_file := x.source_file, source_location := x.source_location, community := x.community, repo := x.repo,
    norm_label := coalesce({_fold_sql('x.label')}, lower(id))))) as varchar) json from n
union all select 'links', y.ord, cast(json_merge_patch('{{}}', to_json(struct_pack(source := y.orig_src, target := y.orig_tgt, relation := y.relation, confidence := y.confidence, confidence_score := y.confidence_score, weight := y.weight, context := y.context,
    source_location := y.source_location))) as varchar) from e
""")
def node_link_records(spark: SparkSession, d: str) -> DataFrame:
    return export.node_link_records(code_graph(spark, d))


_DARK = ["#" + "".join(f"{max(0, int(c[i : i + 2], 16) - 30):02x}" for i in (1, 3, 5)) for c in export.PALETTE]


@query(f"""
with {GRAPH_SQL}, rk as (select com, row_number() over (order by count(*) desc, com) - 1 r from d where com is not null group by com)
select id, coalesce(label, id) as label, case when is_file then 12.0 else least(10 + 3 * sqrt(degree), 50.0) end size, coalesce(['#4E79A7','#F28E2B','#E15759','#76B7B2','#59A14F','#EDC948','#B07AA1','#FF9DA7','#9C755F','#BAB0AC'][r % 10 + 1], '#BAB0AC') color, coalesce([{', '.join(repr(c) for c in _DARK)}][r % 10 + 1], {_DARK[-1]!r}) border from d left join rk on d.com = rk.com
""")
def viz_nodes(spark: SparkSession, d: str) -> DataFrame:
    return export.viz_nodes(code_graph(spark, d))


@query(f"with {GRAPH_SQL} select src, tgt, coalesce(y.relation, 'related') relation, coalesce(y.confidence, 'EXTRACTED') in ('INFERRED', 'AMBIGUOUS') dashes, greatest(0.3, least(1.0, coalesce(y.confidence_score, 1.0))) opacity from e")
def viz_edges(spark: SparkSession, d: str) -> DataFrame:
    return export.viz_edges(code_graph(spark, d))


@query(f"""
with {GRAPH_SQL}, c as (select id, ord, coalesce(com, -1) community, row_number() over (partition by coalesce(com, -1) order by ord) - 1 k from d), g as (select community, row_number() over (order by count(*) desc, community) - 1 g from c group by 1)
select id, c.community, cast(g * 740 + (k % 3) * 220 + 40 as bigint) x, cast((k // 3) * 80 + 40 as bigint) y from c join g on c.community = g.community
""")
def canvas_cards(spark: SparkSession, d: str) -> DataFrame:
    return export.canvas_cards(code_graph(spark, d))


@query(f"with {GRAPH_SQL} select src, tgt, coalesce(y.weight, 1.0) weight, coalesce(y.relation, 'related') relation from e order by weight desc, src, tgt limit 200")
def canvas_edges(spark: SparkSession, d: str) -> DataFrame:
    return export.canvas_edges(code_graph(spark, d))


@query(f"with {GRAPH_SQL} select com as cid, row_number() over (partition by com order by degree desc, ord) place, id, coalesce(label, id) as label, degree from d where com is not null qualify place <= 25")
def community_members(spark: SparkSession, d: str) -> DataFrame:
    return export.community_top(code_graph(spark, d))


@query(f"with {GRAPH_SQL}, l as (select a.com cid, b.com other, count(*) n_links from adj join d a on adj.src = a.id join d b on adj.tgt = b.id where a.com <> b.com group by 1, 2) select * from l qualify row_number() over (partition by cid order by n_links desc, other) <= 12")
def cross_community_counts(spark: SparkSession, d: str) -> DataFrame:
    return export.community_links(code_graph(spark, d))


@query(f"with {GRAPH_SQL} select a.com cid, coalesce(y.confidence, 'EXTRACTED') confidence, count(*) n from adj join d a on adj.src = a.id where a.com is not null group by 1, 2")
def community_confidences(spark: SparkSession, d: str) -> DataFrame:
    return export.community_confidences(code_graph(spark, d))


@query(f"""
with {GRAPH_SQL}, hub as (select id from d where not is_file and not is_concept order by degree desc, ord limit 10)
select adj.src id, coalesce(adj.y.relation, 'related') relation, row_number() over (partition by adj.src, coalesce(adj.y.relation, 'related') order by deg.degree desc, adj.tgt) place, adj.tgt neighbor from adj join hub on adj.src = hub.id join deg on adj.tgt = deg.id qualify place <= 20
""")
def hub_articles(spark: SparkSession, d: str) -> DataFrame:
    g = code_graph(spark, d)
    return export.hub_neighbors(g, analyze.god_nodes(g))


@query("""
with k as (select repo || '/' || source_file path, count(distinct id) k from nodes where source_file <> '' group by 1), p as (select repo || '/' || rel_path path from source_files),
f as (select split(p.path, '/') s, coalesce(k, 0) k from p left join k on p.path = k.path), e as (select unnest(range(0, len(s))) i, s, k from f)
select array_to_string(s[1:i], '/') folder, count(*) n_files, cast(sum(greatest(k, 1)) as bigint) n_symbols from e group by 1
""")
def tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Folders of the scanned files, with the nodes that each file has."""
    path = lambda c: F.concat("repo", F.lit("/"), c).alias("path")
    symbols = table(spark, d, "nodes").where("source_file <> ''").groupBy(path("source_file")).agg(F.count_distinct("id").alias("k"))
    paths = table(spark, d, "source_files").select(path("rel_path")).join(symbols, "path", "left")
    return export.tree_rollup(paths.select("path", F.coalesce("k", F.lit(0).cast("bigint")).alias("n_symbols")))


@query(f"""
with {GRAPH_SQL}, s as (select x.source_file source_file, coalesce(x.label, id) as label, x.file_type ft, ord from n where coalesce(x.source_file, '') <> ''),
t as (select * from s where not (label = split_part(source_file, '/', -1) and coalesce(ft = 'code', false)))
select source_file, row_number() over (partition by source_file order by starts_with(label, '_'), lower(label), ord) place, label, greatest(count(*) over (partition by source_file) - 200, 0) hidden from t qualify place <= 200
""")
def tree_symbols(spark: SparkSession, d: str) -> DataFrame:
    return export.file_symbols(code_graph(spark, d))


@query(f"""
with {GRAPH_SQL}, m as (select com cid, coalesce(label, id) as label, row_number() over (partition by com order by ord) rn, count(*) over (partition by com) n from d where com is not null and not is_file),
s as (select com cid, count(*) n from d where com is not null group by 1), i as (select a.com cid, count(*) k from e join d a on e.src = a.id join d b on e.tgt = b.id where a.com = b.com and e.src <> e.tgt group by 1)
select m.cid, max(m.n) n_members, string_agg(label, ' | ' order by rn) filter (where rn <= 8) labels, greatest(max(m.n) - 8, 0) n_more,
    any_value(case when s.n <= 1 then 1.0 else floor(coalesce(k, 0) / (s.n * (s.n - 1) / 2.0) * 100.0 + 0.5) / 100.0 end) cohesion
from m join s on m.cid = s.cid left join i on m.cid = i.cid group by m.cid having max(m.n) >= 3
""")
def report_communities(spark: SparkSession, d: str) -> DataFrame:
    return report.community_sections(code_graph(spark, d)).withColumn("labels", F.array_join("labels", " | "))


@query(f"with {GRAPH_SQL} select src, tgt, coalesce(y.relation, 'unknown') relation from e where y.confidence = 'AMBIGUOUS'")
def ambiguous_edges(spark: SparkSession, d: str) -> DataFrame:
    return report.ambiguous_edges(code_graph(spark, d))


@query(f"with {GRAPH_SQL} select com cid, count(*) n_members from d where com is not null and not is_file group by 1 having count(*) < 3")
def thin_communities(spark: SparkSession, d: str) -> DataFrame:
    return report.thin_communities(code_graph(spark, d))


@query("select 'o_' || l_orderkey as id, 'p_' || l_partkey as node from (select l_orderkey, l_partkey from lineitem qualify count(*) over (partition by l_orderkey) >= 3 union all select 0, 0 where false)")
def hyperedge_members(spark: SparkSession, d: str) -> DataFrame:
    """Orders of at least three lines as hyperedges over their parts."""
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(named("p_", "l_partkey")).alias("nodes")).where(F.size("nodes") >= 3)
    return hyperedge_rows(orders.select(named("o_", "l_orderkey").alias("id"), "nodes"))


# -- streams


@query("""
with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end fresh from events where ts is not null), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from e)
select user_id, min(ts) as begin, max(ts) + interval 6 hour as "end", count(*) n from s group by user_id, k
""")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    return watch.debounced(table(spark, d, "events").where("ts is not null"), "ts", ["user_id"], "6 hours")


@query("""
select distinct a.user_id, a.event_id, a.ts from events a join events b on a.user_id = b.user_id and a.event_type = 'purchase' and b.event_type = 'click' and b.ts <= a.ts and b.ts >= a.ts - interval 1 day
""")
def joined_within(spark: SparkSession, d: str) -> DataFrame:
    """Purchases that a click of the same user came before within a day."""
    e = table(spark, d, "events")
    bought, clicked = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), e.where("event_type = 'click'").select("user_id", "ts")
    return watch.joined_within(bought, clicked, ["user_id"], "ts", "1 day").select("user_id", "event_id", "ts").distinct()


@query("select event_type, time_bucket(interval 1 hour, ts) as begin, count(*) n from events where ts is not null group by 1, 2")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    return watch.windowed_counts(table(spark, d, "events").where("ts is not null"), "ts", ["event_type"], "1 hour")


@query(f"select run_id, bool_or(lower(case when contains({_NAME}, '.') then split_part({_NAME}, '.', -1) else '' end) not in {_IN(detect.X.CODE_EXTENSIONS)}) has_non_code from scan_entries group by 1")
def has_non_code(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scan_entries").select("run_id", T.basename(T.forward_path(F.col("rel_path"))).alias("path"))
    return watch.has_non_code(s, ["run_id"])
