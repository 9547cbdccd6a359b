"""From a folder of files to a graph and its outputs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import basename
from .operators.cluster import EXACT_EDGES, cluster_exact, cluster_scalable
from .operators.detect import detect, detection_summary, file_type, in_skipped_dir, is_sensitive, read_contents, scan_folder
from .operators.export import save_graph, saved_graph, write_html, write_node_link
from .operators.extraction import extract_repositories
from .operators.graph import Graph, build_graph, update_graph
from .operators.report import report_text
from .sources import files
from .streaming.watch import FILES, has_non_code, watch_files


def _named(root: str) -> str:
    """What a root is called: the last part of its path."""
    return (root if "://" in root else str(Path(root).resolve())).rstrip("/").rsplit("/", 1)[-1]


def _relative(path, root: str):
    """A file's path below ``root``, whatever its scheme."""
    base = (root.split("://", 1)[1].split("/", 1)[-1] if "://" in root else str(Path(root).resolve()).lstrip("/")).rstrip("/")
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/+", "")
    return F.substr(F.when(F.startswith(bare, F.lit(base + "/")), F.substr(bare, F.lit(len(base) + 1))).otherwise(F.concat(F.lit("/"), bare)), F.lit(2))


def _wanted(found: DataFrame, output_dir: str) -> DataFrame:
    """Rows (rel_path, ...) of code that isn't hidden, skipped, sensitive or output."""
    p = F.col("rel_path")
    return found.where(~in_skipped_dir(p, output_dir) & ~F.startswith(p, F.lit(output_dir + "/")) & ~F.startswith(basename(p), F.lit(".")) & ~is_sensitive(p) & F.coalesce(file_type(p) == "code", F.lit(False)))


def code_files(spark: SparkSession, root: str, output_dir: str) -> DataFrame:
    """(repo, rel_path, body) of the code below ``root``.

    A path is a folder that the driver and all executors see, scanned by its ignore files; a URI of
    any file system is listed and read by Spark.
    """
    if "://" in root:
        raw = spark.read.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(root)
        found = _wanted(raw.select(_relative(F.col("path"), root).alias("rel_path"), "content"), output_dir)
    else:
        found = read_contents(scan_folder(spark, root, output_dir=output_dir).where("file_type = 'code' and not sensitive"))
    return found.select(F.lit(_named(root)).alias("repo"), "rel_path", _text(F.col("content")).alias("body"))


def _text(content):
    """Bytes as text; what isn't UTF-8 is replaced."""
    return F.make_valid_utf8(content.cast("string"))


def with_communities(g: Graph) -> Graph:
    """The graph with its nodes' community; the exact mode while it can move anything."""
    small = g.edges.limit(EXACT_EDGES + 1).count() <= EXACT_EDGES
    c = cluster_exact(g) if small else cluster_scalable(g)
    nodes = g.nodes.drop("community").join(c.select("id", F.col("cid").alias("community")), "id", "left")
    return Graph(nodes, g.edges, g.directed, g.hyperedges)


def write_outputs(g: Graph, out: str, document: bool = True, page: bool = True, detection: DataFrame | None = None) -> Graph:
    """Saves the graph in ``out`` and writes the report, and as far as the graph isn't too large for them the single document and the page; the graph as saved."""
    spark = g.nodes.sparkSession
    save_graph(g, f"{out}/graph")
    g = saved_graph(spark, f"{out}/graph")
    files.write_text(spark, f"{out}/report.md", report_text(g, detection=detection))
    for wanted, write, name in ((document, lambda p: write_node_link(g, p, force=True), "graph.json"), (page, lambda p: write_html(g, p), "graph.html")):
        if wanted:
            try:
                write(f"{out}/{name}")
            except ValueError:
                # too large for one document; an old one would be of another graph
                files.remove(spark, f"{out}/{name}")
    return g


def generate(spark: SparkSession, root: str, output_dir: str = "graph-out", update: bool = False, html: bool = True, document: bool = True) -> Graph:
    """Scans, extracts, builds, clusters and writes; with ``update`` the graph written before is merged in."""
    found = code_files(spark, root, output_dir)
    nodes, edges = extract_repositories(found)
    out = f"{root.rstrip('/')}/{output_dir}"
    old = saved_graph(spark, f"{out}/graph") if update else None
    if old is not None:
        now = found.select(F.col("rel_path").alias("source_file"))
        gone = old.nodes.select("source_file").distinct().join(now, "source_file", "left_anti")
        g = update_graph(old, nodes, edges, now, gone)
    else:
        g = build_graph(nodes, edges)
    files.write_text(spark, f"{out}/root", root)
    detection = None if "://" in root else detection_summary(detect(spark, root, output_dir=output_dir))
    return write_outputs(with_communities(g.written()), out, document, html, detection)


def update_files(spark: SparkSession, changed: DataFrame, out: str, document: bool = True) -> Graph:
    """The graph saved in ``out`` after some files (repo, rel_path, body) were read again; only these are extracted."""
    old = saved_graph(spark, f"{out}/graph")
    if old is None:
        g = build_graph(*extract_repositories(changed))
    else:
        nodes, edges = extract_repositories(changed, old.nodes)
        g = update_graph(old, nodes, edges, changed.select(F.col("rel_path").alias("source_file")))
    return write_outputs(with_communities(g.written()), out, document, False)


def write_new(spark: SparkSession, folder: str, name: str, text: str) -> str:
    """Writes a document under a name that isn't taken: name.md, name_1.md ..."""
    for k in range(1000):
        p = f"{folder}/{name}.md" if not k else f"{folder}/{name}_{k}.md"
        if not files.exists(spark, p):
            files.write_text(spark, p, text)
            return p
    raise FileExistsError(name)


def update_flag(root: str, output_dir: str = "graph-out") -> str:
    """Set while files other than code changed, which only a full run takes in."""
    return f"{root.rstrip('/')}/{output_dir}/needs_update"


def watch(spark: SparkSession, root: str, output_dir: str = "graph-out", once: bool = False):
    """Updates the graph by each batch of changed files; batches with other than code only set the flag.

    A stream doesn't tell of deleted files; ``generate`` with ``update`` drops their nodes.
    """
    base = root.rstrip("/") if "://" in root else str(Path(root).resolve())
    out, flag = f"{base}/{output_dir}", update_flag(base, output_dir)

    def handle(batch: DataFrame, number: int) -> None:
        p = F.col("rel_path")
        seen = batch.select(_relative(F.col("path"), base).alias("rel_path"), "content")
        seen = seen.where(~in_skipped_dir(p, output_dir) & ~F.startswith(p, F.lit(output_dir + "/")))
        found = has_non_code(seen.select(p.alias("path"), F.lit(0).alias("k")), ["k"]).first()
        if found is None:
            return
        if found["has_non_code"]:
            files.write_text(spark, flag, "")
        else:
            update_files(spark, _wanted(seen, output_dir).select(F.lit(_named(base)).alias("repo"), "rel_path", _text(F.col("content")).alias("body")), out)
            files.remove(spark, flag)

    return watch_files(spark, base, handle, f"{out}/watch-state", once=once)
