"""Hubs, surprising edges, differences, betweenness and statistics of a graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CODE_EXTENSIONS, IMAGE_EXTENSIONS, LANGUAGE_FAMILIES
from ..functions.text import basename, file_extension, top_level_dir
from .graph import Graph

STRUCTURAL = ("imports", "imports_from", "contains", "method")
BETWEENNESS_NODES = 5000


def language_family(path: Column) -> Column:
    """Family of the extension's language, null for others."""
    ext, out = file_extension(path), F.lit(None).cast("string")
    for family, exts in LANGUAGE_FAMILIES.items():
        out = F.when(ext.isin(*exts), F.lit(family)).otherwise(out)
    return out


def file_category(path: Column) -> Column:
    ext = file_extension(path)
    return F.when(ext.isin(*CODE_EXTENSIONS), "code").when(ext == "pdf", "paper").when(ext.isin(*IMAGE_EXTENSIONS), "image").otherwise("doc")


def is_file_node(label: Column, source_file: Column, degree: Column) -> Column:
    """A file's own node, or one that stands for a bare method or an unconnected function; false without a label."""
    name = F.coalesce(label, F.lit(""))
    own = (name == basename(F.coalesce(source_file, F.lit("")))) | (name.startswith(".") & name.endswith("()")) | (name.endswith("()") & (degree <= 1))
    return (name != "") & own


def is_concept_node(source_file: Column) -> Column:
    """A node without a source file, or whose file has no extension."""
    path = F.coalesce(source_file, F.lit(""))
    return (path == "") | ~basename(path).contains(".")


def described_nodes(g: Graph) -> DataFrame:
    """Nodes with degree, is_file, is_concept."""
    d = g.nodes.join(g.degrees(), "id")
    return d.withColumns({"is_file": is_file_node(F.col("label"), F.col("source_file"), F.col("degree")), "is_concept": is_concept_node(F.col("source_file"))})


def god_nodes(g: Graph, top_n: int = 10) -> DataFrame:
    """(id, label, degree, ord) of the top_n nodes of highest degree that are neither file nor concept nodes; ties by ord."""
    d = described_nodes(g).where("not is_file and not is_concept").select("id", F.coalesce("label", "id").alias("label"), "degree", "ord")
    return d.orderBy(F.desc("degree"), "ord").limit(top_n)


def surprise_scores(g: Graph) -> DataFrame:
    """Cross-file edges with score and reasons: structural ones, concept and file nodes, and equal or missing files left out."""
    cols = ["label", "source_file", "community", "degree", "is_file", "is_concept"]
    # nodes are described once; both joins read that exchange
    d = described_nodes(g).select("id", *cols)
    side = lambda p: d.select(F.col("id").alias(p + "id"), *[F.col(c).alias(p + c) for c in cols])
    e = g.edges.where(~F.coalesce(F.col("relation"), F.lit("")).isin(*STRUCTURAL))
    j = e.join(side("a_"), F.col("orig_src") == F.col("a_id")).join(side("b_"), F.col("orig_tgt") == F.col("b_id"))
    fa, fb = F.coalesce("a_source_file", F.lit("")), F.coalesce("b_source_file", F.lit(""))
    j = j.where((fa != "") & (fb != "") & (fa != fb)).where("not (a_is_file or b_is_file or a_is_concept or b_is_concept)")
    conf, rel = F.coalesce("confidence", F.lit("EXTRACTED")), F.coalesce("relation", F.lit(""))
    la, lb = language_family(fa), language_family(fb)
    foreign = (conf == "INFERRED") & (rel == "calls") & la.isNotNull() & lb.isNotNull() & (la != lb)
    base = F.when(foreign, 0).when(conf == "AMBIGUOUS", 3).when(conf == "INFERRED", 2).otherwise(1)
    ca, cb = file_category(fa), file_category(fb)
    dirs = top_level_dir(fa) != top_level_dir(fb)
    communities = F.coalesce(F.col("a_community") != F.col("b_community"), F.lit(False))
    similar = rel == "semantically_similar_to"
    edge_of_hub = (F.least("a_degree", "b_degree") <= 2) & (F.greatest("a_degree", "b_degree") >= 5)
    score = base + F.when(ca != cb, 2).otherwise(0) + F.when(dirs, 2).otherwise(0) + F.when(communities, 1).otherwise(0)
    score = F.when(similar, (score * F.lit(1.5)).cast("int")).otherwise(score) + F.when(edge_of_hub, 1).otherwise(0)
    reasons = F.array(
        F.when(conf.isin("AMBIGUOUS", "INFERRED") & ~foreign, F.concat(F.lower(conf), F.lit(" connection"))),
        F.when(ca != cb, F.concat(F.lit("crosses file types ("), ca, F.lit(", "), cb, F.lit(")"))),
        F.when(dirs, F.lit("connects different top folders")),
        F.when(communities, F.lit("bridges communities")),
        F.when(similar, F.lit("semantically similar")),
        F.when(edge_of_hub, F.lit("a peripheral node reaches a hub")),
    )
    why = F.array_join(F.filter(reasons, lambda x: x.isNotNull()), "; ")
    return j.select("src", "tgt", F.coalesce("a_label", "orig_src").alias("source_label"), F.coalesce("b_label", "orig_tgt").alias("target_label"), fa.alias("source_file_a"), fb.alias("source_file_b"),
                    conf.alias("confidence"), rel.alias("relation"), score.cast("bigint").alias("score"), F.when(why == "", "cross-file semantic connection").otherwise(why).alias("why"))


def cross_file_surprises(g: Graph, top_n: int = 5) -> DataFrame:
    """The top_n of ``surprise_scores``; ties by src, tgt."""
    return surprise_scores(g).orderBy(F.desc("score"), "src", "tgt").limit(top_n)


def cross_community_surprises(g: Graph, top_n: int = 5) -> DataFrame:
    """The best edge between every two communities, best first: ambiguous, inferred, extracted, others; ties by src, tgt."""
    d = described_nodes(g).where("community is not null and not is_file").select("id", "community")
    side = lambda p: d.select(F.col("id").alias(p), F.col("community").alias(p + "_c"))
    e = g.edges.where(~F.coalesce(F.col("relation"), F.lit("")).isin(*STRUCTURAL)).join(side("src"), "src").join(side("tgt"), "tgt").where("src_c <> tgt_c")
    conf = F.coalesce("confidence", F.lit("EXTRACTED"))
    rank = F.when(conf == "AMBIGUOUS", 0).when(conf == "INFERRED", 1).when(conf == "EXTRACTED", 2).otherwise(3)
    pairs = e.select(F.least("src_c", "tgt_c").alias("low"), F.greatest("src_c", "tgt_c").alias("high"), F.struct(rank.alias("conf_ord"), "src", "tgt").alias("x"))
    best = pairs.groupBy("low", "high").agg(F.min("x").alias("x"))
    note = F.concat(F.lit("Bridges community "), F.col("low").cast("string"), F.lit(" → community "), F.col("high").cast("string"))
    return best.select("low", "high", F.col("x.conf_ord").cast("bigint").alias("conf_ord"), "x.src", "x.tgt", note.alias("note")).orderBy("conf_ord", "src", "tgt").limit(top_n)


def surprising_connections(g: Graph, top_n: int = 5) -> DataFrame:
    """Cross-file surprises, or cross-community ones if there are none, or the edges of highest betweenness without communities.

    Betweenness is left out beyond BETWEENNESS_NODES nodes, which gives no rows.
    The choice reads at most two distinct files and one row of each candidate.
    """
    files = g.nodes.where("source_file is not null and source_file <> ''").select("source_file").distinct().limit(2).count()
    if files > 1:
        found = cross_file_surprises(g, top_n)
        if not found.isEmpty():
            return found
    if not g.nodes.where("community is not null").isEmpty():
        return cross_community_surprises(g, top_n)
    scores = edge_betweenness(g, BETWEENNESS_NODES)
    return scores.orderBy(F.desc("betweenness"), "src", "tgt").limit(top_n)


def graph_diff(old: Graph, new: Graph) -> tuple[DataFrame, DataFrame]:
    """(change, id) of nodes and (change, src, tgt, relation) of edges, change 'new' or 'removed'; attributes play no part."""
    nodes = _difference(old.nodes.select("id"), new.nodes.select("id"))
    key = [F.col("src"), F.col("tgt"), F.coalesce("relation", F.lit("")).alias("relation")]
    return nodes, _difference(old.edges.select(*key), new.edges.select(*key))


def _difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both one-sided differences by one aggregation instead of two joins."""
    both = old.withColumn("_o", F.lit(1)).withColumn("_n", F.lit(0)).unionByName(new.withColumn("_o", F.lit(0)).withColumn("_n", F.lit(1)))
    seen = both.groupBy(*old.columns).agg(F.max("_o").alias("_o"), F.max("_n").alias("_n")).where("_o <> _n")
    return seen.select(F.when(F.col("_n") == 1, "new").otherwise("removed").alias("change"), *old.columns)


def diff_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the four counts and a sentence."""
    n = nodes.agg(F.count_if(F.expr("change = 'new'")).alias("new_nodes"), F.count_if(F.expr("change = 'removed'")).alias("removed_nodes"))
    e = edges.agg(F.count_if(F.expr("change = 'new'")).alias("new_edges"), F.count_if(F.expr("change = 'removed'")).alias("removed_edges"))
    part = lambda c, what, tail: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what}"), F.when(F.col(c) != 1, "s").otherwise(""), F.lit(tail)))
    text = F.concat_ws(", ", part("new_nodes", "new node", ""), part("new_edges", "new edge", ""), part("removed_nodes", "node", " removed"), part("removed_edges", "edge", " removed"))
    return n.crossJoin(e).withColumn("summary", F.when(text == "", "no changes").otherwise(text))


def edge_betweenness(g: Graph, max_nodes: int | None = None) -> DataFrame:
    """(src, tgt, betweenness) of every edge by shortest paths from every node; no rows beyond ``max_nodes`` nodes, if given.

    The work is nodes times edges; sources are spread over the tasks, each with the whole adjacency as
    two broadcast arrays, and their contributions summed.  Undirected paths count once.
    """
    spark = g.nodes.sparkSession
    schema = "src string, tgt string, betweenness double"
    if max_nodes is not None and g.nodes.limit(max_nodes + 1).count() > max_nodes or g.edges.isEmpty():
        return spark.createDataFrame([], schema)
    arcs = g.adjacency.where("src <> tgt").select("src", "tgt").toPandas()
    ids = sorted(set(arcs.src) | set(arcs.tgt))
    at = {x: i for i, x in enumerate(ids)}
    order = np.lexsort((arcs.tgt.map(at).to_numpy(np.int64), arcs.src.map(at).to_numpy(np.int64))) if len(arcs) else np.zeros(0, np.int64)
    heads, tails = arcs.src.map(at).to_numpy(np.int64)[order], arcs.tgt.map(at).to_numpy(np.int64)[order]
    shared = spark.sparkContext.broadcast((ids, np.searchsorted(heads, np.arange(len(ids) + 1)), tails))
    halved = not g.directed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, begin, tails = shared.value
        total = np.zeros(len(tails))
        for pdf in batches:
            for s in pdf["id"]:
                _brandes(int(s), begin, tails, len(ids), total)
        heads = np.repeat(np.arange(len(ids)), np.diff(begin))
        rows = [(ids[min(heads[i], tails[i])], ids[max(heads[i], tails[i])], total[i]) for i in np.flatnonzero(total)]
        yield pd.DataFrame(rows, columns=["src", "tgt", "betweenness"])

    sources = spark.range(len(ids), numPartitions=max(1, min(len(ids), spark.sparkContext.defaultParallelism * 2)))
    scale = F.lit(0.5 if halved else 1.0)
    sums = sources.mapInPandas(run, schema).groupBy("src", "tgt").agg((F.sum("betweenness") * scale).alias("betweenness"))
    pairs = g.edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct()
    return pairs.join(sums, ["src", "tgt"], "left").select("src", "tgt", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _brandes(s: int, begin: np.ndarray, tails: np.ndarray, n: int, total: np.ndarray) -> None:
    """Adds the dependencies of the shortest paths from s to the arcs on them."""
    depth, paths = np.full(n, -1), np.zeros(n)
    depth[s], paths[s] = 0, 1.0
    levels, frontier = [], np.array([s])
    while len(frontier):
        counts = begin[frontier + 1] - begin[frontier]
        a = np.repeat(frontier, counts)
        arcs = np.repeat(begin[frontier] - np.cumsum(counts) + counts, counts) + np.arange(len(a))
        b = tails[arcs]
        depth[b[depth[b] < 0]] = len(levels) + 1
        down = depth[b] == len(levels) + 1
        np.add.at(paths, b[down], paths[a[down]])
        levels.append((a[down], b[down], arcs[down]))
        frontier = np.unique(b[down])
    rest = np.zeros(n)
    for a, b, arcs in reversed(levels):
        share = paths[a] / np.where(paths[b] > 0, paths[b], 1) * (1 + rest[b])
        np.add.at(rest, a, share)
        total[arcs] += share


def graph_stats(g: Graph) -> DataFrame:
    """One row: nodes, edges, communities, and whole percentages of the confidences; edges without one count only in the total."""
    n = F.count(F.lit(1))
    pct = lambda c: F.floor(100 * F.count_if(F.col("confidence") == c) / F.greatest(n, F.lit(1))).cast("bigint")
    e = g.edges.agg(pct("EXTRACTED").alias("extracted_pct"), pct("INFERRED").alias("inferred_pct"), pct("AMBIGUOUS").alias("ambiguous_pct"))
    c = g.nodes.agg(F.count_distinct("community").alias("n_communities"))
    return g.size().crossJoin(c).crossJoin(e)


def confidence_mix(g: Graph) -> DataFrame:
    """One row: counts and rounded percentages with missing confidences as EXTRACTED, and the mean score of inferred edges (missing: 0.5)."""
    conf = F.coalesce("confidence", F.lit("EXTRACTED"))
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    out = []
    for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS"):
        k = F.count_if(conf == c)
        out += [k.alias("n_" + c.lower()), F.floor(k * 100.0 / n + 0.5).cast("bigint").alias("pct_" + c.lower())]
    mean = F.avg(F.when(conf == "INFERRED", F.coalesce("confidence_score", F.lit(0.5))))
    return g.edges.agg(*out, (F.floor(mean * 100 + 0.5) / 100).alias("inferred_mean"))


def knowledge_gaps(g: Graph) -> DataFrame:
    """(id, label, degree, ord) of nodes with at most one neighbour that are neither files nor concepts."""
    return described_nodes(g).where("degree <= 1 and not is_file and not is_concept").select("id", F.coalesce("label", "id").alias("label"), "degree", "ord")


def bridges(g: Graph, top_n: int = 7) -> DataFrame:
    """(id, label, n_communities, degree, ord) of the nodes whose neighbours lie in most communities besides their own; ties by degree, then ord."""
    c = g.nodes.where("community is not null").select("id", "community")
    near = g.adjacency.select("src", "tgt").join(c.select(F.col("id").alias("src"), F.col("community").alias("own")), "src").join(c.select(F.col("id").alias("tgt"), F.col("community").alias("other")), "tgt")
    n = near.where("own <> other").groupBy(F.col("src").alias("id")).agg(F.count_distinct("other").alias("n_communities"))
    d = described_nodes(g).where("not is_file and not is_concept").join(n, "id")
    return d.select("id", F.coalesce("label", "id").alias("label"), "n_communities", "degree", "ord").orderBy(F.desc("n_communities"), F.desc("degree"), "ord").limit(top_n)


#: A community of at least so many members with a smaller cohesion is loose.
LOOSE_SIZE, LOOSE = 5, 0.15


def suggested_questions(g: Graph, top_n: int = 7) -> DataFrame:
    """(kind, question, why): on ambiguous edges, bridges between communities, hubs, loose communities and unconnected nodes, top_n of each kind."""
    from .cluster import cohesion, stored_communities

    names = g.nodes.select("id", F.coalesce("label", "id").alias("label"))
    a = g.edges.where("confidence = 'AMBIGUOUS'").orderBy("src", "tgt").limit(top_n).join(names.withColumnsRenamed({"id": "src", "label": "la"}), "src").join(names.withColumnsRenamed({"id": "tgt", "label": "lb"}), "tgt")
    ask = lambda df, kind, question, why: df.select(F.lit(kind).alias("kind"), question.alias("question"), why.alias("why"))
    around = lambda before, what, after: F.concat(F.lit(before), what, F.lit(after))
    ambiguous = ask(a, "ambiguous", F.concat(F.lit("How is "), "la", F.lit(" related to "), "lb", F.lit("?")), F.lit("the edge is marked ambiguous"))
    crossing = ask(bridges(g, top_n), "bridge", around("Why does ", F.col("label"), " connect different communities?"), F.concat(F.lit("neighbours in "), "n_communities", F.lit(" other communities")))
    hubs = ask(god_nodes(g, top_n), "hub", around("What depends on ", F.col("label"), "?"), F.concat("degree", F.lit(" connections")))
    members = cohesion(g, stored_communities(g)).where((F.col("n") >= LOOSE_SIZE) & (F.col("cohesion") < LOOSE)).orderBy("cohesion", F.desc("n"), "cid").limit(top_n)
    loose = ask(members, "loose", around("Should community ", F.col("cid").cast("string"), " be split?"), F.concat("n", F.lit(" members with few links among them")))
    gaps = ask(knowledge_gaps(g).orderBy("ord").limit(top_n), "gap", around("What does ", F.col("label"), " belong to?"), F.lit("at most one connection"))
    return ambiguous.unionByName(crossing).unionByName(hubs).unionByName(loose).unionByName(gaps)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every group in an order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
