"""The property graph: two DataFrames, nodes and canonical edges.

A graph is simple: one edge per ordered pair of ids, or per unordered pair when it is
undirected; the last statement of a pair replaces all of its attributes.  Ties and
orders come from ``ord``, the place of a statement in its input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_id
from ..sources.session import written

NODE_ATTRS = ("label", "file_type", "source_file", "source_location", "community", "repo")
EDGE_ATTRS = ("relation", "confidence", "confidence_score", "weight", "context", "source_file", "source_location")


@dataclass
class Graph:
    """nodes: ord, id, attributes; edges: ord, src, tgt (src <= tgt when undirected), orig_src, orig_tgt, attributes."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False
    hyperedges: DataFrame | None = field(default=None)

    def written(self) -> Graph:
        """The same graph, its frames written once for what reads them several times."""
        return Graph(written(self.nodes), written(self.edges), self.directed, self.hyperedges)

    @property
    def adjacency(self) -> DataFrame:
        """Every edge from each of its ends (a self-loop once); only out-edges when directed.  One pass over the edges."""
        e = self.edges
        if self.directed:
            return e
        ends = F.when(F.col("src") == F.col("tgt"), F.array(F.struct(F.col("src").alias("a"), F.col("tgt").alias("b")))).otherwise(
            F.array(F.struct(F.col("src").alias("a"), F.col("tgt").alias("b")), F.struct(F.col("tgt").alias("a"), F.col("src").alias("b")))
        )
        rest = [c for c in e.columns if c not in ("src", "tgt")]
        return e.select(F.explode(ends).alias("_e"), *rest).select(F.col("_e.a").alias("src"), F.col("_e.b").alias("tgt"), *rest)

    def degrees(self) -> DataFrame:
        """(id, degree) of every node: distinct neighbours, a self-loop 1, none 0; out-degree when directed."""
        counted = self.adjacency.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("id").join(counted, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def size(self) -> DataFrame:
        """One row: n_nodes and n_edges, where two undirected self-loops count as one edge."""
        loops = F.count_if(F.col("src") == F.col("tgt"))
        n = F.count(F.lit(1)) if self.directed else F.floor((2 * F.count(F.lit(1)) - loops) / 2).cast("bigint")
        # both sides are one row
        return self.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(self.edges.agg(n.alias("n_edges")))

    def neighbors(self, ids: DataFrame) -> DataFrame:
        """Adjacency rows of the ids in ``ids`` (id)."""
        return self.adjacency.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")

    def undirected(self) -> Graph:
        """Reciprocal arcs become one edge; the earliest statement wins."""
        if not self.directed:
            return self
        e = self.edges.withColumnsRenamed({"src": "_s", "tgt": "_t"})
        return Graph(self.nodes, _one_per_pair(e, F.least("_s", "_t"), F.greatest("_s", "_t"), first=True).drop("_s", "_t"), False, self.hyperedges)

    def subgraph(self, ids: DataFrame) -> Graph:
        """Induced by the ids in ``ids`` (id)."""
        keep = ids.select("id").distinct()
        edges = self.edges.join(keep, F.col("src") == F.col("id"), "left_semi").join(keep, F.col("tgt") == F.col("id"), "left_semi")
        return Graph(self.nodes.join(keep, "id", "left_semi"), edges, self.directed, self.hyperedges)

    def without(self, ids: DataFrame) -> Graph:
        """Without these nodes and the edges at them."""
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone, F.col("src") == F.col("id"), "left_anti").join(gone, F.col("tgt") == F.col("id"), "left_anti")
        return Graph(self.nodes.join(gone, "id", "left_anti"), edges, self.directed, self.hyperedges)


def _one_per_pair(edges: DataFrame, a: Column, b: Column, first: bool = False) -> DataFrame:
    rest = F.struct(*[F.col(c) for c in edges.columns])
    pick = (F.min_by if first else F.max_by)(rest, "ord").alias("_x")
    return edges.groupBy(a.alias("src"), b.alias("tgt")).agg(pick).select("src", "tgt", "_x.*")


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """One row per id of rows (ord, id, attributes): the last statement's attributes at the first statement's place.

    A null attribute of the last statement is a value and wins; rows without id are left out.
    """
    attrs = [c for c in rows.columns if c not in ("ord", "id")]
    agg = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("ord").alias("ord"), F.max_by(F.struct(*attrs), "ord").alias("_x"))
    return agg.select("ord", "id", "_x.*")


def first_statement_wins(rows: DataFrame) -> DataFrame:
    """One row per id of rows (ord, id, attributes), its first statement as it is: how parsed and judged fragments are merged."""
    attrs = [c for c in rows.columns if c not in ("ord", "id")]
    agg = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("ord").alias("ord"), F.min_by(F.struct(*attrs), "ord").alias("_x"))
    return agg.select("ord", "id", "_x.*")


def token_totals(fragments: DataFrame) -> DataFrame:
    """One row: input_tokens and output_tokens of fragments, missing ones as 0."""
    return fragments.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens")])


def upsert_attributes(rows: DataFrame) -> DataFrame:
    """Per-key upsert of rows (ord, id, attrs map<string,string>): absent keys keep their value, present nulls overwrite.

    Returns ord (first), id, attrs.
    """
    places = rows.where(F.col("id").isNotNull())
    keys = places.select("id", "ord", F.explode("attrs").alias("k", "v"))
    last = keys.groupBy("id", "k").agg(F.max_by(F.struct("v"), "ord").alias("x"))
    maps = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.col("x.v").alias("v"))))).alias("attrs"))
    return places.groupBy("id").agg(F.min("ord").alias("ord")).join(maps, "id", "left").select("ord", "id", "attrs")


def resolve_endpoints(edges: DataFrame, nodes: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Edges with ``orig_src`` and ``orig_tgt`` set to node ids: the exact id, else the last node of the same normal form.

    Edges with an end that names no node are dropped.  Distinct names are resolved once, when this is
    called, and joined back.
    """
    ids = nodes.select("id", "ord")
    normal = ids.groupBy(normalize_id(F.col("id")).alias("_n")).agg(F.max_by("id", "ord").alias("_fuzzy"))
    names = edges.select(F.explode(F.array(source, target)).alias("_name")).where("_name is not null").distinct()
    exact = names.join(ids.select(F.col("id").alias("_exact")), F.col("_name") == F.col("_exact"), "left")
    # written, so that its size is known: a small one is sent to the edges, which then aren't shuffled for it
    found = written(exact.withColumn("_n", normalize_id(F.col("_name"))).join(normal, "_n", "left").select("_name", F.coalesce("_exact", "_fuzzy").alias("_id")).where("_id is not null"))
    one = edges.join(found.select(F.col("_name").alias(source), F.col("_id").alias("orig_src")), source)
    return one.join(found.select(F.col("_name").alias(target), F.col("_id").alias("orig_tgt")), target)


def _attribute(rows: DataFrame, name: str) -> Column:
    kind = {"community": "bigint", "confidence_score": "double", "weight": "double"}.get(name, "string")
    return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)


def build_graph(node_rows: DataFrame, edge_rows: DataFrame, directed: bool = False, hyperedges: DataFrame | None = None) -> Graph:
    """A graph of statements: node_rows (ord, id, ...), edge_rows (ord, source, target, ...).

    Nodes are upserted, ends resolved, dangling edges dropped, and the last statement of a pair
    kept.  Only the columns of ``NODE_ATTRS`` and ``EDGE_ATTRS`` come along, null where an input has
    none; empty inputs give an empty graph.
    """
    nodes = upsert_nodes(node_rows.select("ord", "id", *[_attribute(node_rows, c) for c in NODE_ATTRS]))
    resolved = resolve_endpoints(edge_rows.select("ord", "source", "target", *[_attribute(edge_rows, c) for c in EDGE_ATTRS]), nodes).select("ord", "orig_src", "orig_tgt", *EDGE_ATTRS)
    a, b = F.col("orig_src"), F.col("orig_tgt")
    edges = _one_per_pair(resolved, a if directed else F.least(a, b), b if directed else F.greatest(a, b))
    return Graph(nodes, edges, directed, hyperedges)


def combine(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Statements of several fragments (nodes, edges) as one: later fragments come after earlier ones."""
    span = 1 << 40

    def shifted(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for k, p in enumerate(parts[1:], 1):
            out = out.unionByName(p.withColumn("ord", F.col("ord") + k * span), allowMissingColumns=True)
        return out

    return shifted([g[0] for g in graphs]), shifted([g[1] for g in graphs])


def merge_repositories(graphs: dict[str, Graph]) -> Graph:
    """One graph of several repositories; nodes without a repo get their graph's name."""
    parts = []
    for name, g in graphs.items():
        nodes = g.nodes.withColumn("repo", F.coalesce("repo", F.lit(name)) if "repo" in g.nodes.columns else F.lit(name))
        parts.append((nodes, g.edges.drop("src", "tgt").withColumnsRenamed({"orig_src": "source", "orig_tgt": "target"})))
    return build_graph(*combine(*parts))


def update_graph(old: Graph, node_rows: DataFrame, edge_rows: DataFrame, extracted: DataFrame, deleted: DataFrame | None = None, prefer: str = "new") -> Graph:
    """The graph after files were extracted again.

    extracted (source_file): files whose old nodes are replaced; deleted (source_file): files whose
    nodes go.  prefer='new' lets fresh edges win over kept ones of the same pair, 'old' the reverse.
    """
    if prefer not in ("new", "old"):
        raise ValueError("prefer is 'new' or 'old'")
    kept = old.nodes.join(extracted.select("source_file").distinct(), "source_file", "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select("source_file").distinct(), "source_file", "left_anti")
    kept = kept.join(node_rows.select("id").distinct(), "id", "left_anti")
    edges = old.edges.drop("src", "tgt").withColumnsRenamed({"orig_src": "source", "orig_tgt": "target"})
    fresh, stale = (node_rows, edge_rows), (kept, edges)
    nodes, statements = combine(fresh, stale) if prefer == "old" else combine(stale, fresh)
    return build_graph(nodes, statements, old.directed, old.hyperedges)


def relativized(df: DataFrame, root: str) -> DataFrame:
    """source_file below ``root`` made relative to it; other paths stay."""
    base = root.rstrip("/") + "/"
    return df.withColumn("source_file", F.when(F.startswith("source_file", F.lit(base)), F.substr("source_file", F.lit(len(base) + 1))).otherwise(F.col("source_file")))


def hyperedge_members(hyperedges: DataFrame) -> DataFrame:
    """(id, node) of every member of every hyperedge (id, nodes)."""
    return hyperedges.select("id", F.explode("nodes").alias("node"))
