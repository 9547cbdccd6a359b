"""Property graphs over the tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, build_graph
from ..sources.tables import table

KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"


def code_graph(spark: SparkSession, d: str, directed: bool = False) -> Graph:
    """The graph of tables nodes and edges: statements upserted, ends resolved, dangling edges dropped."""
    return build_graph(table(spark, d, "nodes"), table(spark, d, "edges"), directed)


def place_graph(spark: SparkSession, d: str, customers: bool = False) -> Graph:
    """A forest: suppliers (and customers) refer to nations, regions contain nations."""
    region, nation, supplier = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        region.select(key("r_", "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit(None).cast("string").alias("up"), F.lit("contains").alias("relation")),
        nation.select(key("n_", "n_nationkey").alias("id"), F.col("n_name").alias("label"), key("r_", "n_regionkey").alias("up"), F.lit("contains").alias("relation")),
        supplier.select(key("s_", "s_suppkey").alias("id"), F.col("s_name").alias("label"), key("n_", "s_nationkey").alias("up"), F.lit("references").alias("relation")),
    ]
    if customers:
        parts.append(table(spark, d, "customer").select(key("c_", "c_custkey").alias("id"), F.col("c_name").alias("label"), key("n_", "c_nationkey").alias("up"), F.lit("references").alias("relation")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # ids are unique here, so any order of statements gives the same graph
    rows = rows.withColumn("ord", F.xxhash64("id"))
    nodes = rows.select("ord", "id", "label", F.lit("document").alias("file_type"), F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("bigint").alias("community"))
    edges = rows.where("up is not null").select("ord", F.col("id").alias("source"), F.col("up").alias("target"), "relation", F.lit("EXTRACTED").alias("confidence"), F.lit("ref").alias("context"))
    return build_graph(nodes, edges)


PLACES_SQL = """
pl as (select 'r_' || r_regionkey id, cast(null as varchar) up from region union all select 'n_' || n_nationkey, 'r_' || n_regionkey from nation
    union all select 's_' || s_suppkey, 'n_' || s_nationkey from supplier{customers}),
padj as (select id src, up tgt from pl where up is not null union all select up, id from pl where up is not null)
"""

def graph_sql(nodes: str = "nodes", edges: str = "edges", p: str = "") -> str:
    """Common table expressions {p}n (nodes), {p}nk, {p}r (resolved statements) and {p}e (edges) of statements in two tables."""
    return f"""
{p}n as (select min(ord) as ord, id, arg_max(struct_pack(label := label, file_type := file_type, source_file := source_file, source_location := source_location, community := community, repo := repo), ord) x
    from {nodes} where id is not null group by id),
{p}nk as (select {KEY.format('id')} k, arg_max(id, ord) fid from {p}n group by 1),
{p}r as (select e.ord, coalesce(a.id, ka.fid) orig_src, coalesce(b.id, kb.fid) orig_tgt, e.relation, e.confidence, e.confidence_score, e.weight, e.context, e.source_file, e.source_location
    from {edges} e left join {p}n a on e.source = a.id left join {p}nk ka on {KEY.format('e.source')} = ka.k left join {p}n b on e.target = b.id left join {p}nk kb on {KEY.format('e.target')} = kb.k),
{p}e as (select least(orig_src, orig_tgt) src, greatest(orig_src, orig_tgt) tgt, arg_max(struct_pack(ord := ord, orig_src := orig_src, orig_tgt := orig_tgt, relation := relation, confidence := confidence,
    confidence_score := confidence_score, weight := weight, context := context, source_file := source_file, source_location := source_location), ord) y from {p}r where orig_src is not null and orig_tgt is not null group by 1, 2)
"""


GRAPH_SQL = graph_sql() + """,
adj as (select src, tgt, y from e union all select tgt, src, y from e where src <> tgt),
deg as (select n.id, coalesce(c, 0) degree from n left join (select src, count(*) c from adj group by 1) a on n.id = a.src),
d as (select n.ord, n.id, x.label as label, x.source_file sf, x.community com, degree,
    coalesce(x.label, '') <> '' and (coalesce(x.label, '') = split_part(coalesce(x.source_file, ''), '/', -1) or (x.label like '.%' and x.label like '%()') or (x.label like '%()' and degree <= 1)) is_file,
    coalesce(x.source_file, '') = '' or not contains(split_part(coalesce(x.source_file, ''), '/', -1), '.') is_concept
    from n join deg on n.id = deg.id)
"""
