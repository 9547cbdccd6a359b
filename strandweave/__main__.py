"""Command line."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import pipeline
from .functions.text import safe_filename
from .operators import export, ingest, report, search, traverse
from .operators.incremental import VersionedTable
from .server import ToolServer
from .sources import files
from .sources.session import local_session


def _graph(spark: SparkSession, path: str):
    """A graph from its native folder or a node-link document."""
    if path.endswith(".json"):
        return export.read_node_link(spark, path)
    return export.saved_graph(spark, path) or export.read_graph(spark, path)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strandweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("generate", "update"):
        c = sub.add_parser(name)
        c.add_argument("path")
    for name, extra in (("query", ["question"]), ("path", ["source", "target"]), ("explain", ["term"]), ("benchmark", []), ("serve", []), ("cluster-only", []), ("tree", ["out"]), ("wiki", ["out"]), ("cypher", ["out"]), ("graphml", ["out"]), ("canvas", ["out"])):
        c = sub.add_parser(name)
        for e in extra:
            c.add_argument(e)
        c.add_argument("--graph", default="graph-out/graph.json")
        if name == "query":
            c.add_argument("--dfs", action="store_true")
            c.add_argument("--context", action="append")
            c.add_argument("--budget", type=int, default=2000)
            c.add_argument("--depth", type=int)
            c.add_argument("--min-chars", type=int)
    c = sub.add_parser("merge-graphs")
    c.add_argument("paths", nargs="+")
    c.add_argument("--out", required=True)
    c = sub.add_parser("watch")
    c.add_argument("path")
    c.add_argument("--once", action="store_true")
    c = sub.add_parser("add")
    c.add_argument("page", help="a saved page")
    c.add_argument("url")
    c.add_argument("--out", default="raw")
    c = sub.add_parser("save-result")
    c.add_argument("question")
    c.add_argument("answer")
    c.add_argument("--nodes", nargs="*", default=[])
    c.add_argument("--out", default="graph-out/memory")
    c = sub.add_parser("cost")
    c.add_argument("ledger")
    c.add_argument("--add", nargs=3, metavar=("RUN", "IN", "OUT"))
    c = sub.add_parser("check-update")
    c.add_argument("path")
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    if a.command in ("generate", "update"):
        g = pipeline.generate(spark, a.path, update=a.command == "update")
        print(g.size().first())
        return 0
    if a.command == "watch":
        pipeline.watch(spark, a.path, once=a.once).awaitTermination()
        return 0
    if a.command == "check-update":
        print("update needed" if files.exists(spark, pipeline.update_flag(a.path)) else "up to date")
        return 0
    if a.command == "cost":
        ledger = VersionedTable(spark, a.ledger)
        if a.add:
            report.add_cost(ledger, a.add[0], int(a.add[1]), int(a.add[2]))
        print(report.cost_totals(ledger.read()).first() if ledger.latest() else "no runs")
        return 0
    if a.command in ("add", "save-result"):
        if a.command == "add":
            pages = spark.createDataFrame([(a.url, Path(a.page).read_text(errors="replace"))], "url string, html string")
            found = ingest.page_documents(pages).select(safe_filename(F.col("url")).alias("name"), "document").first()
        else:
            rows = spark.createDataFrame([(a.question, a.answer, "query", a.nodes)], "question string, answer string, kind string, nodes array<string>")
            found = ingest.answer_documents(rows).select(F.col("slug").alias("name"), "document").first()
        print(pipeline.write_new(spark, a.out, found["name"], found["document"]))
        return 0
    if a.command == "merge-graphs":
        from .operators.graph import merge_repositories

        merged = merge_repositories({Path(x).resolve().parent.parent.name or x: _graph(spark, x) for x in a.paths})
        export.write_node_link(merged, a.out, force=True)
        print(merged.size().first())
        return 0
    g = _graph(spark, a.graph)
    if a.command == "query":
        print(search.query_text(g, a.question, "dfs" if a.dfs else "bfs", a.depth, a.budget, a.context, a.min_chars))
    elif a.command == "path":
        q = spark.createDataFrame([(i, search.query_terms(t, 1)) for i, t in enumerate((a.source, a.target))], "q_id bigint, terms array<string>")
        ends = {r.q_id: r.id for r in search.query_seeds(g.nodes, q, 1).collect()}
        if len(ends) < 2:
            print("No matching nodes found.")
            return 1
        hit = traverse.shortest_paths(g, spark.createDataFrame([(0, ends[0], ends[1])], "q_id int, source string, target string"), None).first()
        print("no path" if hit.path is None else " -> ".join(hit.path))
    elif a.command == "explain":
        print(search.explanation(g, a.term))
    elif a.command == "benchmark":
        print(search.benchmark_text(search.run_benchmark(g)))
    elif a.command == "cluster-only":
        g = pipeline.with_communities(g).written()
        out = a.graph.rsplit("/", 1)[0] if "/" in a.graph else "."
        pipeline.write_outputs(g, out)
        print(report.report_text(g))
    elif a.command == "serve":
        ToolServer(g).serve()
    elif a.command == "tree":
        export.write_tree(g, a.out)
    elif a.command == "wiki":
        print(export.write_wiki(g, a.out))
    elif a.command == "canvas":
        export.write_canvas(g, a.out)
    else:
        export.write_lines(export.cypher_lines(g) if a.command == "cypher" else export.graphml_lines(g), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
