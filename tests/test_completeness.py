"""Documents, validation of JSON, paths, caches, reports, the command line, SQL text, and graphs on a file system."""

import json
import os

import pytest
from pyspark.sql import functions as F

from strandweave import pipeline
from strandweave.__main__ import main
from strandweave.functions import text as T
from strandweave.operators import analyze, cluster, detect, export, extraction, ingest, report, search, traverse, validate
from strandweave.operators.graph import build_graph, first_statement_wins, token_totals
from strandweave.operators.incremental import VersionedTable
from strandweave.server import ToolServer
from strandweave.sources import sql
from strandweave.sources.paths import safe_graph_path

N = "ord long, id string, label string, file_type string, source_file string, community long"
E = "ord long, source string, target string, relation string, confidence string, context string"


def small(spark):
    nodes = [(0, "a", "Alpha", "code", "x/a.py", 0), (1, "b", "beta()", "code", "x/b.py", 0), (2, "c", "Gamma", "document", "y/c.md", 1), (3, "d", None, "code", "x/a.py", None), (4, "e", "Épsilon", "code", "z/e.js", 1)]
    edges = [(0, "a", "b", "calls", "EXTRACTED", "call"), (1, "b", "c", "references", "AMBIGUOUS", None), (2, "c", "e", "references", "INFERRED", None), (3, "a", "c", "references", "EXTRACTED", None)]
    return build_graph(spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E))


def test_labels_cut_at_bytes(spark):
    one = lambda c, s: spark.createDataFrame([(s,)], "s string").select(c).first()[0]
    s = F.col("s")
    assert one(T.render_label(s), "a\x00b\x85c\n") == "abc" and one(T.sanitize_label(s), "a\x00b\x85c") == "ab\x85c"
    assert one(T.render_label(s), "x" * 300) == "x" * 256 and one(T.render_label(s), None) is None
    assert one(T.render_label(s), "x" + "é" * 200) == "x" + "é" * 127 and one(T.render_label(s), "日" * 100) == "日" * 85 and one(T.render_label(s), "😀" * 65) == "😀" * 64
    assert one(T.byte_prefix(s, 4), "ab��") == "ab" and one(T.byte_prefix(s, 5), "ab��") == "ab�"
    assert one(T.thousands(F.lit(1234567)), "") == "1,234,567" and one(T.estimate_tokens(s), None) == 1
    assert one(detect.paper_signals(s), "x" * 2999 + "é arxiv") == 0 and one(detect.paper_signals(s), "arxiv DOI : 1706.03762") == 3 and one(detect.paper_signals(s), None) == 0
    assert one(detect.paper_signals(s), "éarxivé") == 0


def test_validation_of_documents(spark, rows):
    good = {"nodes": [{"id": "a", "label": None, "file_type": "code", "source_file": "a.py"}], "edges": [{"source": "a", "target": "a", "relation": "r", "confidence": "EXTRACTED", "source_file": "a.py"}]}
    docs = {
        "good": json.dumps(good), "list": "[1]", "text": "no json", "null": None, "empty": "{}", "kinds": '{"nodes": {}, "links": 3}',
        "links": json.dumps({"nodes": [], "links": good["edges"]}),
        "rows": json.dumps({"nodes": [1, {"id": "a", "file_type": "spam", "label": 1}, {"id": 7, "label": "", "file_type": 3, "source_file": ""}], "edges": [None, {**good["edges"][0], "target": "zz", "confidence": "MAYBE"}]}),
    }
    got = {}
    for r in validate.validate_documents(spark.createDataFrame(list(docs.items()), "doc string, json string")).collect():
        got.setdefault(r.doc, []).append((r.section, r.idx, r.rule_no, r.message))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {
        "list": [("document", None, 0, "not a JSON object")], "text": [("document", None, 0, "not a JSON object")], "null": [("document", None, 0, "not a JSON object")],
        "empty": [("edges", None, 0, "missing key 'edges'"), ("nodes", None, 0, "missing key 'nodes'")],
        "kinds": [("edges", None, 1, "'edges' is not a list"), ("nodes", None, 1, "'nodes' is not a list")],
        "rows": sorted([("node", 0, 0, "node: not an object"), ("node", 1, 4, "node: missing field 'source_file'"), ("node", 1, 5, "node: invalid file_type 'spam'"), ("edge", 0, 0, "edge: not an object"),
                        ("edge", 1, 6, "edge: invalid confidence 'MAYBE'"), ("edge", 1, 8, "target 'zz' names no node")], key=repr),
    }
    assert validate.validate_documents(spark.createDataFrame([], "doc string, json string")).count() == 0
    s = spark.createDataFrame([(1, "EXTRACTED", 1.0), (2, "EXTRACTED", 0.9), (3, "INFERRED", 0.85), (4, "INFERRED", 0.8), (5, "AMBIGUOUS", 0.2), (6, "AMBIGUOUS", 0.5), (7, None, 0.5), (8, "INFERRED", None)], "i int, c string, s double")
    assert rows(s.where(~validate.fits_rubric(F.col("c"), F.col("s"))).select("i")) == [(2,), (4,), (6,)]


def test_paths_stay_in_the_output(tmp_path):
    out = tmp_path / "graph-out"
    out.mkdir()
    (out / "graph.json").write_text("{}")
    (tmp_path / "secret").write_text("x")
    os.symlink(tmp_path / "secret", out / "link")
    assert safe_graph_path("graph.json", str(tmp_path)) == (out / "graph.json").resolve() == safe_graph_path(str(out / "graph.json"), str(tmp_path))
    for bad in ("../secret", "link", str(tmp_path / "secret"), "/etc"):
        with pytest.raises(PermissionError):
            safe_graph_path(bad, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        safe_graph_path("none.json", str(tmp_path))


def test_links_that_go_round(spark, tmp_path, rows):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "other").mkdir()
    (tmp_path / "a" / "x.py").write_text("x")
    (tmp_path / "other" / "y.py").write_text("y")
    os.symlink(tmp_path, tmp_path / "a" / "b" / "up")
    os.symlink(tmp_path / "other", tmp_path / "a" / "linked")
    assert rows(detect.scan_folder(spark, str(tmp_path)), "rel_path") == [("a/x.py",), ("other/y.py",)]
    found = [r[0] for r in rows(detect.scan_folder(spark, str(tmp_path), follow_symlinks=True), "rel_path")]
    assert "a/x.py" in found and len(found) == 2 and sum(p.endswith("y.py") for p in found) == 1
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "z.py").write_text("z")
    assert ("build/z.py",) in rows(detect.collect_files(spark, str(tmp_path)), "rel_path")


def test_manifest_is_kept_between_scans(spark, tmp_path, rows):
    src, log = tmp_path / "src", str(tmp_path / "manifest")
    src.mkdir()
    for n in ("a.py", "b.md", "c.py"):
        (src / n).write_text(n)
    assert {r.status for r in detect.detect_incremental(spark, str(src), log).collect()} == {"new"}
    assert detect.load_manifest(spark, log).count() == 0
    detect.save_manifest(detect.detect(spark, str(src)), log)
    # an unchanged file keeps the type it was saved with
    detect.save_manifest(detect.load_manifest(spark, log).withColumn("file_type", F.when(F.col("rel_path") == "b.md", "paper").otherwise(F.col("file_type"))), log)
    (src / "a.py").write_text("changed")
    (src / "c.py").unlink()
    (src / "d.py").write_text("d")
    assert rows(detect.detect_incremental(spark, str(src), log), "rel_path", "status", "file_type") == [("a.py", "changed", "code"), ("b.md", "unchanged", "paper"), ("c.py", "deleted", "code"), ("d.py", "new", "code")]
    assert detect.load_manifest(spark, log).count() == 3


def test_captured_documents(spark):
    posts = spark.createDataFrame([("https://x.com/a/1", json.dumps({"html": "<p>Hi <b>all</b></p>", "author_name": 'A "B"'})), ("u2", "oops"), ("u3", None)], "url string, answer string")
    p = {r.url: r.document for r in ingest.post_documents(posts).collect()}
    assert 'author: "A \\"B\\""' in p["https://x.com/a/1"] and "Hi all" in p["https://x.com/a/1"] and 'type: "tweet"' in p["https://x.com/a/1"]
    assert "not understood" in p["u2"] and "not fetched" in p["u3"] and "@unknown" in p["u3"]
    html = '<h1 class="title mathjax"><span>Title:</span> On\n graphs</h1><div class="authors"><a>A. One</a>, <a>B. Two</a></div><blockquote class="abstract"><b>We</b> propose.</blockquote>'
    pages = spark.createDataFrame([("https://arxiv.org/abs/1706.03762", html), ("https://arxiv.org/abs/2001.00001", None), ("https://h.org/p", "<title>T</title>x")], "url string, html string")
    d = {r.url: r for r in ingest.paper_documents(pages).collect()}
    one = d["https://arxiv.org/abs/1706.03762"]
    assert one.name == "arxiv_1706_03762" and 'title: "Title: On graphs"' in one.document and "**Authors:** A. One, B. Two" in one.document and "We propose." in one.document
    assert 'title: "2001.00001"' in d["https://arxiv.org/abs/2001.00001"].document and "# T" in d["https://h.org/p"].document and d["https://h.org/p"].name == "https_h_org_p"
    hubs = spark.createDataFrame([(i, f"h{i}") for i in range(7)], "ord int, label string")
    assert "h0, h1, h2, h3, h4." in ingest.transcript_prompt(hubs).first()[0] and ingest.transcript_prompt(hubs, "mine").first()[0] == "mine" and "Technical" not in ingest.transcript_prompt(hubs.limit(0)).first()[0]


def test_cache_listing(spark, tmp_path, rows):
    path = str(tmp_path / "cache")
    assert extraction.cached_files(spark, path).count() == 0 and extraction.clear_cache(spark, path) is False
    for kind in ("ast", "semantic"):
        extraction.save_cache(spark.createDataFrame([("h1", kind, "{}"), ("h2", kind, "{}")], "hash string, kind string, fragment string"), path)
    assert extraction.cached_files(spark, path).count() == 4
    assert extraction.clear_cache(spark, path, "ast") and rows(extraction.cached_files(spark, path)) == [("h1", "semantic"), ("h2", "semantic")]
    assert extraction.clear_cache(spark, path) and extraction.cached_files(spark, path).count() == 0


def test_fragments_and_costs(spark, tmp_path, rows):
    f = spark.createDataFrame([(1200, 340), (None, 5)], "input_tokens long, output_tokens long")
    assert tuple(token_totals(f).first()) == (1200, 345) and tuple(token_totals(f.limit(0)).first()) == (0, 0)
    d = spark.createDataFrame([(2, "a", "late"), (1, "a", None), (3, "b", "x"), (0, None, "n")], "ord long, id string, label string")
    assert rows(first_statement_wins(d)) == [(1, "a", None), (3, "b", "x")]
    ledger = VersionedTable(spark, str(tmp_path / "ledger"))
    report.add_cost(ledger, "2026-01-01", 10, 2)
    report.add_cost(ledger, "2026-01-02", 5, None)
    assert tuple(report.cost_totals(ledger.read()).first()) == (2, 15, 2)


def test_report_and_tools(spark):
    g = small(spark)
    detection = spark.createDataFrame([(2, 1234, False, True)], "total_files long, total_words long, large boolean, needs_graph boolean")
    text = report.report_text(g, detection=detection, tokens=(1200, 340), shown=1)
    assert "2 files, about 1,234 words" in text and "tokens: 1,200 in, 340 out" in text and "[[Community 0|Community 0]]" in text and "- and 1 more" in text
    assert "costly" in report.corpus_lines(detection.withColumn("large", F.lit(True)))[0]
    s = ToolServer(g)
    assert "Id: a\n" in s.call("get_node", {"label": "the alpha node"}) and "Degree: 2" in s.call("get_node", {"label": "alph"})
    # a label that is missing lies in every term
    assert "Id: d\n" in s.call("get_node", {"label": "no such"})
    x = search.explanation(g, "gamma", 2)
    assert "Degree: 3" in x and "... and 1 more" in x and "-> Alpha [references] [EXTRACTED]" in x and search.explanation(g, "zzz").startswith("no node")
    import strandweave.server as server

    old, server.MAX_ROWS = server.MAX_ROWS, 1
    try:
        assert s.call("get_neighbors", {"label": "gamma"}).endswith("... and 2 more")
    finally:
        server.MAX_ROWS = old
    assert [r.id for r in search.find_nodes(g.nodes, "epsilon").collect()] == ["e"]


def test_paths_of_any_length(spark):
    n = spark.range(12).select(F.col("id").alias("ord"), F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("id"))
    ids = [f"k{i:02}" for i in range(12)]
    edges = [(i, ids[i], ids[i + 1]) for i in range(10)] + [(20, "k00", "k05"), (21, "k05", "k02")]
    g = build_graph(n, spark.createDataFrame(edges, "ord long, source string, target string"))
    pairs = spark.createDataFrame([(0, "k00", "k10"), (1, "k03", "k03"), (2, "k00", "k11"), (3, "k00", "zz"), (4, "k00", "k04"), (5, "k01", "k05")], "q_id int, source string, target string")
    got = {r.q_id: (r.hops, r.path) for r in traverse.shortest_paths(g, pairs, None).collect()}
    assert got[0] == (6, ["k00", "k05", "k06", "k07", "k08", "k09", "k10"]) and got[1] == (0, ["k03"]) and got[2] == got[3] == (None, None)
    # of two paths of two hops the one with the smaller node before the target
    assert got[4] == (2, ["k00", "k05", "k04"]) and got[5] == (2, ["k01", "k00", "k05"])
    assert {r.q_id: r.hops for r in traverse.shortest_paths(g, pairs, 2).collect()} == {0: None, 1: 0, 2: None, 3: None, 4: 2, 5: 2}


def test_scalable_communities_are_nearly_as_good(spark):
    """Modularity of both modes on graphs of dense groups."""
    import random

    random.seed(11)
    edges = set()
    for group in range(6):
        members = [f"n{group}_{i}" for i in range(12)]
        edges |= {tuple(sorted(random.sample(members, 2))) for _ in range(45)}
    for _ in range(12):
        a, b = random.sample(range(6), 2)
        edges.add(tuple(sorted((f"n{a}_{random.randrange(12)}", f"n{b}_{random.randrange(12)}"))))
    ids = sorted({x for e in edges for x in e})
    g = build_graph(spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "ord long, id string"), spark.createDataFrame([(i, *e) for i, e in enumerate(sorted(edges))], "ord long, source string, target string"))

    def modularity(found):
        where = {r.id: r.cid for r in found.collect()}
        assert set(where) == set(ids)
        m, degree = len(edges), {x: sum(x in e for e in edges) for x in ids}
        inside = sum(where[a] == where[b] for a, b in edges) / m
        total = {}
        for x in ids:
            total[where[x]] = total.get(where[x], 0) + degree[x]
        return inside - sum((t / (2 * m)) ** 2 for t in total.values())

    exact, scalable = modularity(cluster.cluster_exact(g)), modularity(cluster.cluster_scalable(g))
    assert exact > 0.4 and scalable > 0.9 * exact, (exact, scalable)


def test_sql_text_and_functions(spark, tmp_path):
    spark.createDataFrame([(1, "A B", "r"), (2, "c-d", "r")], "ord long, id string, repo string").write.parquet(str(tmp_path / "nodes.parquet"))
    assert [r[0] for r in sql.run(spark, str(tmp_path), "select normalize_id(id) from nodes order by ord").collect()] == ["a_b", "c_d"]
    assert spark.sql("select norm_label('Éa'), basename('a/b.c'), estimate_tokens('12345678')").first()[:] == ("ea", "b.c", 2)
    got = spark.sql("select label from symbols_of('m/a.py', 'def f():\\n    return 1\\n')").collect()
    assert "f()" in {r.label for r in got}
    assert "a" == search.query_terms("Á", 1)[0]


def test_pages_and_saved_graphs(spark, tmp_path, rows):
    g = small(spark)
    path = str(tmp_path / "graph")
    assert export.saved_graph(spark, path) is None
    for _ in range(3):
        export.save_graph(g, path)
    assert rows(export.saved_graph(spark, path).nodes, "id") == rows(g.nodes, "id") and sum(x.startswith("graph-") for x in os.listdir(path)) == 2
    assert export.write_node_link(g, str(tmp_path / "g.json")) and not export.write_node_link(build_graph(spark.createDataFrame([], N), spark.createDataFrame([], E)), str(tmp_path / "g.json"))
    (tmp_path / "more.json").write_text(json.dumps({"nodes": [{"id": "f"}], "edges": [{"from": "f", "to": "a"}], "directed": False}))
    back = export.read_node_link(spark, str(tmp_path / "*.json"))
    assert rows(back.nodes, "id") == [(x,) for x in "abcdef"] and back.edges.count() == 5
    assert export.write_wiki(g, str(tmp_path / "wiki")) >= 2 and "[[Community_0]]" in (tmp_path / "wiki" / "index.md").read_text()
    assert export.write_wiki(g, str(tmp_path / "wiki2"), {0: "Same", 1: "same"}) >= 2 and (tmp_path / "wiki2" / "same_2.md").exists()
    export.write_html(g, str(tmp_path / "g.html"))
    export.write_canvas(g, str(tmp_path / "g.canvas"))
    export.write_tree(g, str(tmp_path / "tree.json"))
    assert "Alpha" in (tmp_path / "g.html").read_text() and json.loads((tmp_path / "tree.json").read_text())["count"] == 5
    with pytest.raises(ValueError):
        export.write_html(g, str(tmp_path / "no.html"), 2)


def test_generate_watch_and_commands(spark, tmp_path, rows, capsys):
    src = tmp_path / "repo"
    src.mkdir()
    (src / "a.py").write_text("def one():\n    return two()\n")
    (src / "b.py").write_text("def two():\n    return 1\n")
    root = str(src)
    assert main(["generate", root]) == 0
    assert main(["explain", "two", "--graph", f"{root}/graph-out/graph"]) == 0 and "Node: two()" in capsys.readouterr().out
    assert main(["cluster-only", "--graph", f"{root}/graph-out/graph.json"]) == 0 and (src / "graph-out" / "report.md").exists()
    assert main(["path", "one", "two", "--graph", f"{root}/graph-out/graph.json"]) == 0 and "->" in capsys.readouterr().out
    assert main(["cost", str(tmp_path / "cost"), "--add", "r1", "3", "4"]) == 0 and "input_tokens=3" in capsys.readouterr().out
    # the same through Spark's own listing
    by_uri = pipeline.code_files(spark, "file://" + root, "graph-out")
    assert rows(by_uri, "repo", "rel_path") == rows(pipeline.code_files(spark, root, "graph-out"), "repo", "rel_path") == [("repo", "a.py"), ("repo", "b.py")]
    # a changed file alone is extracted, its calls still find other files
    changed = spark.createDataFrame([("repo", "a.py", "def three():\n    return two()\n")], "repo string, rel_path string, body string")
    g = pipeline.update_files(spark, changed, f"{root}/graph-out")
    assert {r.id for r in g.nodes.collect()} >= {"a_three", "b_two"} and "a_one" not in {r.id for r in g.nodes.collect()}
    assert ("a_three", "b_two") in {(r.orig_src, r.orig_tgt) for r in g.edges.where("relation = 'calls'").collect()}
    pipeline.watch(spark, root, once=True).awaitTermination()
    assert "a_one" in {r.id for r in export.saved_graph(spark, f"{root}/graph-out/graph").nodes.collect()} and main(["check-update", root]) == 0 and "up to date" in capsys.readouterr().out
    (src / "n.md").write_text("x")
    pipeline.watch(spark, root, once=True).awaitTermination()
    assert main(["check-update", root]) == 0 and "update needed" in capsys.readouterr().out


def test_hubs_between_ties(spark):
    g = small(spark)
    assert [r.id for r in analyze.god_nodes(g, 2).collect()] == ["c", "a"]
