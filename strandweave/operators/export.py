"""Graphs as text formats, layouts, articles and trees.

Every format is first a DataFrame of lines or attributes, so that large graphs are
written in parallel; only the bounded ones (pages for a browser) go through the driver.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import PALETTE
from ..functions.text import basename, capitalise, cypher_escape, wiki_filename, xml_escape
from ..sources import files
from ..sources.session import checkpoint
from .analyze import described_nodes, god_nodes, top_per_group
from .graph import Graph, build_graph
from .incremental import VersionedTable
from .ranking import placed, rank_by_count
from .search import with_norm_label

#: A page for a browser holds at most so many nodes.
HTML_NODES, HTML_EDGES, CANVAS_EDGES = 5000, 200_000, 200


def cypher_lines(g: Graph) -> DataFrame:
    """(ord, part, line): a MERGE per node and per edge."""
    label = F.regexp_replace(capitalise(F.coalesce("file_type", F.lit("Node"))), r"[^A-Za-z0-9_]", "_")
    node = F.concat(F.lit("MERGE (n:"), label, F.lit(" {id: '"), cypher_escape(F.col("id")), F.lit("'}) SET n.label = '"), cypher_escape(F.coalesce("label", "id")), F.lit("';"))
    relation = F.regexp_replace(F.upper(F.coalesce("relation", F.lit("RELATED_TO"))), r"[ \-]", "_")
    edge = F.concat(F.lit("MATCH (a {id: '"), cypher_escape(F.col("orig_src")), F.lit("'}), (b {id: '"), cypher_escape(F.col("orig_tgt")), F.lit("'}) MERGE (a)-[:"), relation,
                    F.lit(" {confidence: '"), cypher_escape(F.coalesce("confidence", F.lit("EXTRACTED"))), F.lit("'}]->(b);"))
    return g.nodes.select("ord", F.lit(0).alias("part"), node.alias("line")).unionByName(g.edges.select("ord", F.lit(1).alias("part"), edge.alias("line")))


def graphml_lines(g: Graph) -> DataFrame:
    """(ord, part, line) of the elements between a GraphML head and foot; edges are numbered e0, e1 ... in the order of ord."""
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), xml_escape(c), F.lit("</data>"))
    node = F.concat(F.lit('<node id="'), xml_escape(F.col("id")), F.lit('">'), data("label", F.coalesce("label", "id")), data("community", F.coalesce(F.col("community").cast("string"), F.lit(""))), F.lit("</node>"))
    edge = F.concat(F.lit('<edge id="e'), F.col("place").cast("string"), F.lit('" source="'), xml_escape(F.col("src")), F.lit('" target="'), xml_escape(F.col("tgt")), F.lit('">'), data("relation", F.coalesce("relation", F.lit("related"))),
                    data("confidence", F.coalesce("confidence", F.lit("EXTRACTED"))), F.lit("</edge>"))
    return g.nodes.select("ord", F.lit(0).alias("part"), node.alias("line")).unionByName(placed(g.edges, [], "ord").select("ord", F.lit(1).alias("part"), edge.alias("line")))


GRAPHML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "".join(
    f'<key id="{k}" for="{w}" attr.name="{k}" attr.type="string"/>\n' for k, w in (("label", "node"), ("community", "node"), ("relation", "edge"), ("confidence", "edge"))
) + '<graph edgedefault="undirected">'
GRAPHML_FOOT = "</graph>\n</graphml>"


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order as text files: range-partitioned, so that parts follow each other."""
    lines.orderBy("part", "ord").select("line").write.mode("overwrite").text(path)


def write_graph(g: Graph, path: str) -> None:
    """The native form: nodes and edges as Parquet, with the direction and original ends kept."""
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.withColumn("directed", F.lit(g.directed)).write.mode("overwrite").parquet(f"{path}/edges")
    if g.hyperedges is not None:
        g.hyperedges.write.mode("overwrite").parquet(f"{path}/hyperedges")


def read_graph(spark: SparkSession, path: str) -> Graph:
    """A graph that ``write_graph`` wrote."""
    edges = spark.read.parquet(f"{path}/edges")
    first = edges.select("directed").first()
    return Graph(spark.read.parquet(f"{path}/nodes"), edges.drop("directed"), bool(first and first[0]))


def save_graph(g: Graph, path: str) -> int:
    """The graph as the next version of a folder of graphs; readers see it when its manifest is published.

    The folder keeps the last version besides, for those who are reading it.
    """
    spark = g.nodes.sparkSession
    log = VersionedTable(spark, path)
    folder, version = f"graph-{uuid4()}", log.latest()
    write_graph(g, f"{path}/{folder}")
    before = log.manifest(version)["info"].get("folder")
    log._publish(version + 1, {"files": {}, "info": {"folder": folder, "before": before}})
    for name in files.children(spark, path):
        if name.startswith("graph-") and name not in (folder, before):
            files.remove(spark, f"{path}/{name}")
    return version + 1


def saved_graph(spark: SparkSession, path: str) -> Graph | None:
    """The graph saved last, None without any."""
    log = VersionedTable(spark, path)
    folder = log.manifest(log.latest())["info"].get("folder")
    return read_graph(spark, f"{path}/{folder}") if folder else None


def node_link_records(g: Graph) -> DataFrame:
    """(part, ord, json): nodes with norm_label and links as JSON objects."""
    n = with_norm_label(g.nodes).withColumn("norm_label", F.coalesce("norm_label", F.lower("id")))
    nodes = n.select(F.lit("nodes").alias("part"), "ord", F.to_json(F.struct("id", "label", "file_type", "source_file", "source_location", "community", "repo", "norm_label")).alias("json"))
    cols = [c for c in ("relation", "confidence", "confidence_score", "weight", "context", "source_location") if c in g.edges.columns]
    links = g.edges.select(F.lit("links").alias("part"), "ord", F.to_json(F.struct(F.col("orig_src").alias("source"), F.col("orig_tgt").alias("target"), *cols)).alias("json"))
    return nodes.unionByName(links)


def write_node_link(g: Graph, path: str, force: bool = False, max_rows: int = 2_000_000) -> bool:
    """One JSON document, for graphs of a bounded size; False if it would shrink an existing one and ``force`` isn't set."""
    records = node_link_records(g)
    rows = records.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError("too large for one document; use write_graph")
    nodes = [json.loads(r.json) for r in sorted((r for r in rows if r.part == "nodes"), key=lambda r: r.ord)]
    links = [json.loads(r.json) for r in sorted((r for r in rows if r.part == "links"), key=lambda r: r.ord)]
    spark = g.nodes.sparkSession
    old = None if force else files.read_text(spark, path)
    if old is not None and len(json.loads(old)["nodes"]) > len(nodes):
        return False
    hyper = [r.asDict(True) for r in g.hyperedges.collect()] if g.hyperedges is not None else []
    files.write_text(spark, path, json.dumps({"directed": g.directed, "nodes": nodes, "links": links, "hyperedges": hyper}, ensure_ascii=False))
    return True


def read_node_link(spark: SparkSession, path: str, directed: bool | None = None) -> Graph:
    """A graph of node-link documents: 'links' count where 'edges' is absent, 'source' of a node is its file, 'from' and 'to' are ends.

    ``path`` may hold several documents; later ones come after earlier ones.
    """
    doc = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))
    # only the documents' names are put in order, not what they hold
    names = doc.select("file").withColumn("doc", (F.row_number().over(Window.orderBy("file")) - 1).cast("bigint"))
    node = "array<struct<id:string,label:string,file_type:string,source_file:string,source:string,source_location:string,community:bigint,repo:string>>"
    edge = "array<struct<source:string,target:string,from:string,to:string,relation:string,confidence:string,confidence_score:double,weight:double,context:string,source_file:string,source_location:string>>"
    hyper = "array<struct<id:string,label:string,nodes:array<string>,relation:string,confidence:string,confidence_score:double,source_file:string>>"
    x = doc.select("file", F.from_json("value", f"directed boolean, nodes {node}, edges {edge}, links {edge}, hyperedges {hyper}").alias("d"))
    x = checkpoint(x.join(names, "file").drop("file"))
    n = x.select("doc", F.posexplode("d.nodes").alias("i", "n")).select((F.col("doc") * (1 << 40) + F.col("i")).alias("ord"), "n.id", "n.label", "n.file_type", F.coalesce("n.source_file", "n.source").alias("source_file"), "n.source_location", "n.community", "n.repo")
    e = x.select("doc", F.posexplode(F.coalesce("d.edges", "d.links")).alias("i", "e")).select((F.col("doc") * (1 << 40) + F.col("i")).alias("ord"), F.coalesce("e.source", "e.from").alias("source"), F.coalesce("e.target", "e.to").alias("target"), "e.relation", "e.confidence", "e.confidence_score", "e.weight", "e.context", "e.source_file", "e.source_location")
    if directed is None:
        first = x.select("d.directed").first()
        directed = bool(first and first[0])
    h = x.select(F.explode("d.hyperedges").alias("h")).select("h.*")
    return build_graph(n, e, directed, h)


def community_color(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(rank, F.lit(len(PALETTE))) + 1).cast("int"))


def darken(color: Column, by: int = 30) -> Column:
    """A hex colour with every channel lowered, not below 0."""
    channel = lambda i: F.greatest(F.conv(F.substring(color, i, 2), 16, 10).cast("int") - by, F.lit(0))
    return F.format_string("#%02x%02x%02x", channel(2), channel(4), channel(6))


def viz_nodes(g: Graph) -> DataFrame:
    """(id, label, size, color, border): file nodes 12, others 10 + 3 * sqrt(degree) up to 50; colours by the rank of communities."""
    ranks = g.nodes.where("community is not null").groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    ranks = rank_by_count(ranks, "community").select("community", "rank")
    d = described_nodes(g).join(ranks, "community", "left")
    size = F.when(F.col("is_file"), F.lit(12.0)).otherwise(F.least(10 + 3 * F.sqrt("degree"), F.lit(50.0)))
    color = F.coalesce(community_color(F.col("rank")), F.lit(PALETTE[-1]))
    return d.select("id", F.coalesce("label", "id").alias("label"), size.alias("size"), color.alias("color"), darken(color).alias("border"))


def viz_edges(g: Graph) -> DataFrame:
    """(src, tgt, relation, dashes, opacity): inferred and ambiguous edges dashed, the score as opacity between 0.3 and 1."""
    conf = F.coalesce("confidence", F.lit("EXTRACTED"))
    opacity = F.greatest(F.lit(0.3), F.least(F.lit(1.0), F.coalesce("confidence_score", F.lit(1.0))))
    return g.edges.select("src", "tgt", F.coalesce("relation", F.lit("related")).alias("relation"), conf.isin("INFERRED", "AMBIGUOUS").alias("dashes"), opacity.alias("opacity"))


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Graph</title></head><body><canvas id="c" width="1600" height="1000"></canvas><script>
const data = %s;
const at = new Map(data.nodes.map((n, i) => [n.id, [800 + 420 * Math.cos(i * 2.399) * Math.sqrt(i / data.nodes.length), 500 + 420 * Math.sin(i * 2.399) * Math.sqrt(i / data.nodes.length)]]));
const x = document.getElementById("c").getContext("2d");
for (const e of data.edges) { const a = at.get(e.src), b = at.get(e.tgt); x.globalAlpha = e.opacity; x.setLineDash(e.dashes ? [4, 4] : []); x.beginPath(); x.moveTo(...a); x.lineTo(...b); x.stroke(); }
x.globalAlpha = 1; x.setLineDash([]);
for (const n of data.nodes) { const p = at.get(n.id); x.fillStyle = n.color; x.strokeStyle = n.border; x.beginPath(); x.arc(...p, n.size / 2, 0, 7); x.fill(); x.stroke(); x.fillStyle = "#000"; x.fillText(n.label, p[0] + n.size / 2, p[1]); }
</script></body></html>"""


def write_html(g: Graph, path: str, max_nodes: int = HTML_NODES) -> None:
    """A page that draws the graph; ValueError beyond ``max_nodes`` nodes."""
    nodes = [r.asDict() for r in viz_nodes(g).limit(max_nodes + 1).collect()]
    if len(nodes) > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes")
    edges = [r.asDict() for r in viz_edges(g).limit(HTML_EDGES + 1).collect()]
    if len(edges) > HTML_EDGES:
        raise ValueError(f"more than {HTML_EDGES} edges")
    files.write_text(g.nodes.sparkSession, path, _PAGE % json.dumps({"nodes": nodes, "edges": edges}).replace("</", "<\\/"))


def canvas_cards(g: Graph) -> DataFrame:
    """(id, community, x, y): cards of 200 by 60 in three columns per community, communities beside each other."""
    cid = F.coalesce("community", F.lit(-1)).alias("community")
    sizes = g.nodes.groupBy(cid).agg(F.count(F.lit(1)).alias("n"))
    group = rank_by_count(sizes, "community").select("community", F.col("rank").alias("group"))
    cards = placed(g.nodes.select("id", "ord", cid), ["community"], "ord").withColumnRenamed("place", "k")
    x = F.col("group") * (3 * 220 + 2 * 40) + F.pmod(F.col("k"), F.lit(3)) * 220 + 40
    return cards.join(group, "community").select("id", "community", x.cast("bigint").alias("x"), (F.floor(F.col("k") / 3) * 80 + 40).cast("bigint").alias("y"))


def canvas_edges(g: Graph, n: int = CANVAS_EDGES) -> DataFrame:
    """The n edges of most weight; ties by src, tgt."""
    return g.edges.select("src", "tgt", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("relation", F.lit("related")).alias("relation")).orderBy(F.desc("weight"), "src", "tgt").limit(n)


def write_canvas(g: Graph, path: str, max_nodes: int = HTML_NODES) -> None:
    """A canvas document of cards and edges; ValueError beyond ``max_nodes`` nodes."""
    cards = canvas_cards(g).join(g.nodes.select("id", F.coalesce("label", "id").alias("label")), "id").limit(max_nodes + 1).collect()
    if len(cards) > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes")
    here = {c.id for c in cards}
    nodes = [{"id": c.id, "type": "text", "text": c.label, "x": c.x, "y": c.y, "width": 200, "height": 60} for c in cards]
    edges = [{"id": f"e{i}", "fromNode": e.src, "toNode": e.tgt, "label": e.relation} for i, e in enumerate(canvas_edges(g).collect()) if e.src in here and e.tgt in here]
    files.write_text(g.nodes.sparkSession, path, json.dumps({"nodes": nodes, "edges": edges}))


# -- articles


def community_top(g: Graph, n: int = 25) -> DataFrame:
    """(cid, place, id, label, degree): the n members of every community with most neighbours."""
    d = described_nodes(g).where("community is not null").select(F.col("community").alias("cid"), "id", F.coalesce("label", "id").alias("label"), "degree", "ord")
    w = Window.partitionBy("cid").orderBy(F.desc("degree"), "ord")
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("cid", F.col("place").cast("bigint").alias("place"), "id", "label", "degree")


def community_links(g: Graph, n: int = 12) -> DataFrame:
    """(cid, other, n_links): the n communities that each has most adjacency rows to; ties by the smaller one."""
    c = g.nodes.where("community is not null").select("id", "community")
    a = g.adjacency.select("src", "tgt").join(c.select(F.col("id").alias("src"), F.col("community").alias("cid")), "src").join(c.select(F.col("id").alias("tgt"), F.col("community").alias("other")), "tgt")
    counted = a.where("cid <> other").groupBy("cid", "other").agg(F.count(F.lit(1)).alias("n_links"))
    return top_per_group(counted, ["cid"], [F.desc("n_links"), F.col("other")], n)


def community_confidences(g: Graph) -> DataFrame:
    """(cid, confidence, n): adjacency rows of members, so that an inner edge counts twice."""
    c = g.nodes.where("community is not null").select(F.col("id").alias("src"), F.col("community").alias("cid"))
    conf = F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence")
    return g.adjacency.select("src", conf).join(c, "src").groupBy("cid", "confidence").agg(F.count(F.lit(1)).alias("n"))


def hub_neighbors(g: Graph, hubs: DataFrame, n: int = 20) -> DataFrame:
    """(id, relation, place, neighbor): per hub and relation the n neighbours of highest degree."""
    near = g.neighbors(hubs).select(F.col("src").alias("id"), F.col("tgt").alias("neighbor"), F.coalesce("relation", F.lit("related")).alias("relation"))
    d = near.join(g.degrees().withColumnRenamed("id", "neighbor"), "neighbor")
    w = Window.partitionBy("id", "relation").orderBy(F.desc("degree"), "neighbor")
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("id", "relation", F.col("place").cast("bigint").alias("place"), "neighbor")


def write_wiki(g: Graph, folder: str, labels: dict[int, str] | None = None, max_articles: int = 10_000) -> int:
    """An article per community and hub and an index; the number of articles.  Old articles are removed."""
    name = lambda c: (labels or {}).get(c, f"Community {c}")
    # at most 25, 12 and a few rows of each article, whose number is checked
    n = g.nodes.where("community is not null").select("community").distinct().limit(max_articles + 1).count()
    if n > max_articles:
        raise ValueError(f"more than {max_articles} communities")
    spark = g.nodes.sparkSession
    for old in files.children(spark, folder):
        if old.endswith(".md"):
            files.remove(spark, f"{folder}/{old}")
    write = lambda slug, lines: files.write_text(spark, f"{folder}/{slug}.md", "\n".join(lines) + "\n")
    pages: dict[int, list[str]] = {}
    for r in community_top(g).orderBy("cid", "place").collect():
        pages.setdefault(r.cid, [f"# {name(r.cid)}", "", "## Members", ""]).append(f"- {r.label} ({r.degree})")
    for r in community_links(g).orderBy("cid", F.desc("n_links"), "other").collect():
        if "## Links" not in pages[r.cid]:
            pages[r.cid] += ["", "## Links", ""]
        pages[r.cid].append(f"- [[{name(r.other)}]] ({r.n_links})")
    for r in community_confidences(g).orderBy("cid", "confidence").collect():
        pages[r.cid].append(f"\n{r.confidence}: {r.n}")
    hubs = god_nodes(g).collect()
    near: dict[str, dict[str, list[str]]] = {}
    for r in hub_neighbors(g, g.nodes.where(F.col("id").isin([h.id for h in hubs]))).orderBy("id", "relation", "place").collect():
        near.setdefault(r.id, {}).setdefault(r.relation, []).append(f"- {r.neighbor}")
    order = sorted(pages, key=lambda c: (-len(pages[c]), c))
    titles = list(dict.fromkeys([name(c) for c in order] + [h.label for h in hubs]))
    slugs = dict(wiki_slugs(spark.createDataFrame([(t,) for t in titles], "name string")).collect()) if titles else {}
    index = ["# Index", ""]
    for c in order:
        write(slugs[name(c)], pages[c])
        index.append(f"- [[{slugs[name(c)]}]]")
    for h in hubs:
        lines = [f"# {h.label}", "", f"Degree {h.degree}"]
        for relation, rows in near.get(h.id, {}).items():
            lines += ["", f"## {relation}", "", *rows]
        write(slugs[h.label], lines)
        index.append(f"- [[{slugs[h.label]}]]")
    write("index", index)
    return len(pages) + len(hubs)


def wiki_slugs(names: DataFrame) -> DataFrame:
    """(name, slug) of distinct names (name): file names, '_2', '_3' for further names of the same one."""
    s = names.select("name").distinct().withColumn("s", wiki_filename(F.col("name")))
    k = F.row_number().over(Window.partitionBy(F.lower("s")).orderBy("name"))
    return s.select("name", F.when(k == 1, F.col("s")).otherwise(F.concat("s", F.lit("_"), k.cast("string"))).alias("slug"))


# -- trees


def tree_rollup(paths: DataFrame) -> DataFrame:
    """(folder, n_files, n_symbols): every folder of paths (path, n_symbols) with what lies below it; '' is the root.

    A path counts for each of its prefixes; a file without symbols counts 1.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = paths.select(F.explode(prefixes).alias("folder"), F.greatest("n_symbols", F.lit(1)).alias("n"))
    return each.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_symbols"))


def file_symbols(g: Graph, max_children: int = 200) -> DataFrame:
    """(source_file, place, label, hidden): the symbols of every file, non-underscore first, at most max_children and how many more there are."""
    n = g.nodes.where("source_file is not null and source_file <> ''").select("source_file", F.coalesce("label", "id").alias("label"), "file_type", "ord")
    n = n.where(~((F.col("label") == basename(F.col("source_file"))) & F.coalesce(F.col("file_type") == "code", F.lit(False))))
    # ranked apart from the count, so that partitions cut a large file's symbols before they meet
    place = F.row_number().over(Window.partitionBy("source_file").orderBy(F.col("label").startswith("_"), F.lower("label"), "ord"))
    first = n.withColumn("place", place).where(F.col("place") <= max_children)
    total = n.groupBy("source_file").agg(F.count(F.lit(1)).alias("total"))
    return first.join(total, "source_file").select("source_file", F.col("place").cast("bigint").alias("place"), "label", F.greatest(F.col("total") - max_children, F.lit(0)).alias("hidden"))


def common_root(paths: list[str]) -> str:
    """The longest folder that all paths lie in."""
    parts = [p.split("/")[:-1] for p in paths]
    out: list[str] = []
    for level in zip(*parts):
        if len(set(level)) > 1:
            break
        out.append(level[0])
    return "/".join(out)


_TREE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Tree</title></head><body><div id="t"></div><script>
const make = n => { const e = document.createElement(n.children.length ? "details" : "div"); const s = document.createElement(n.children.length ? "summary" : "span");
  s.textContent = n.name + (n.children.length ? " (" + n.count + ")" : ""); e.style.marginLeft = "1em"; e.append(s, ...n.children.map(make)); return e; };
document.getElementById("t").append(make(%s));
</script></body></html>"""


def write_tree(g: Graph, path: str, max_children: int = 200, max_rows: int = 500_000) -> None:
    """The folder tree as one nested JSON document, or a page that folds it if ``path`` ends in .html; ValueError beyond ``max_rows`` symbols."""
    rows = file_symbols(g, max_children).orderBy("source_file", "place").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} symbols")
    base = common_root(sorted({r.source_file for r in rows}))
    root: dict = {"name": base or "/", "count": 0, "children": {}}
    for r in rows:
        at = root
        for part in r.source_file.removeprefix(base).strip("/").split("/"):
            at["count"] += 1
            at = at["children"].setdefault(part, {"name": part, "count": 0, "children": {}})
        at["count"] += 1
        at["children"][f"{r.place}"] = {"name": r.label, "count": 1, "children": {}}
        if r.hidden and r.place == max_children:
            at["children"]["more"] = {"name": f"(+{r.hidden} more)", "count": r.hidden, "children": {}}
    flat = lambda n: {"name": n["name"], "count": n["count"], "children": [flat(c) for c in n["children"].values()]}
    text = json.dumps(flat(root))
    files.write_text(g.nodes.sparkSession, path, _TREE % text.replace("</", "<\\/") if path.endswith(".html") else text)
