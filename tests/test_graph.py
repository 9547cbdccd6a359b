import json
import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import analyze, cluster, export, report, search, traverse
from strandweave.operators.graph import Graph, build_graph, merge_repositories, update_graph, upsert_attributes
from strandweave.operators.validate import assert_valid, validate_fragments

N = "ord long, id string, label string, file_type string, source_file string, source_location string, community long, repo string"
E = "ord long, source string, target string, relation string, confidence string, confidence_score double, weight double, context string, source_file string, source_location string"


def graph(spark, edges, nodes=None, directed=False):
    ids = sorted({x for e in edges for x in e[:2]}) if nodes is None else nodes
    n = spark.createDataFrame([(i, x, x, "code", f"src/{x}.py", None, None, None) if isinstance(x, str) else (i, *x) for i, x in enumerate(ids)], N)
    e = spark.createDataFrame([(i, e[0], e[1], e[2] if len(e) > 2 else "calls", e[3] if len(e) > 3 else "EXTRACTED", None, None, e[4] if len(e) > 4 else None, None, None) for i, e in enumerate(edges)], E)
    return build_graph(n, e, directed)


def test_build_rules(spark, rows):
    n = spark.createDataFrame([(1, "A.b", "x", "code", "f.py", None, 1, None), (2, "c", "y", None, None, None, None, None), (3, "A.b", None, "code", "g.py", None, 2, None), (4, None, "z", None, None, None, None, None)], N)
    e = spark.createDataFrame([(1, "a_b", "c", "calls", None, None, None, None, None, None), (2, "c", "A.b", "imports", None, None, None, None, None, None), (3, "c", "nowhere", "calls", None, None, None, None, None, None), (4, None, "c", "calls", None, None, None, None, None, None)], E)
    g = build_graph(n, e)
    assert rows(g.nodes, "ord", "id", "label", "community") == [(1, "A.b", None, 2), (2, "c", "y", None)]
    assert rows(g.edges, "src", "tgt", "orig_src", "relation") == [("A.b", "c", "c", "imports")]
    assert rows(build_graph(n, e, True).edges, "src", "tgt") == [("A.b", "c"), ("c", "A.b")]
    empty = build_graph(n.limit(0), e.limit(0))
    assert empty.size().first() == (0, 0) and analyze.god_nodes(empty).count() == 0


def test_self_loop_degrees(spark, rows):
    g = graph(spark, [("a", "a"), ("a", "b")])
    assert rows(g.degrees()) == [("a", 2), ("b", 1)]
    assert tuple(g.size().first()) == (2, 1) and g.edges.count() == 2
    assert rows(g.without(spark.createDataFrame([("b",)], "id string")).edges, "src", "tgt") == [("a", "a")]
    assert rows(g.subgraph(spark.createDataFrame([("b",)], "id string")).nodes, "id") == [("b",)]


def test_attributes_keep_absent_keys_and_present_nulls(spark):
    d = spark.createDataFrame([(1, "a", {"x": "1", "y": "2"}), (2, "a", {"x": None})], "ord long, id string, attrs map<string,string>")
    assert upsert_attributes(d).first().attrs == {"x": None, "y": "2"}


def test_validation(spark, rows):
    n = spark.createDataFrame([(1, "a", None, "video", "f", None, None, None)], N)
    e = spark.createDataFrame([(1, "a", "b", "r", "SURE", None, None, None, "f", None)], E)
    assert [r[3] for r in rows(validate_fragments(n, e))] == ["edge: invalid confidence 'SURE'", "target 'b' names no node", "node: missing field 'label'", "node: invalid file_type 'video'"]
    with pytest.raises(ValueError):
        assert_valid(n, e)
    assert validate_fragments(n.limit(0), e).where("message like '%names no node'").count() == 0


def test_fixture_hubs_and_surprises(spark):
    nodes = [("transformer", "Transformer", "code", "model.py", "L1", None, None), ("attention", "MultiHeadAttention", "code", "model.py", "L2", None, None), ("layernorm", "LayerNorm", "code", "model.py", "L3", None, None), ("concept", "attention mechanism", "document", "paper.md", None, None, None)]
    edges = [("transformer", "attention", "contains"), ("transformer", "layernorm", "contains"), ("attention", "concept", "implements", "INFERRED"), ("layernorm", "concept", "referenced", "AMBIGUOUS")]
    g = graph(spark, edges, nodes)
    assert [(r.id, r.degree) for r in analyze.god_nodes(g).collect()] == [("transformer", 2), ("attention", 2), ("layernorm", 2), ("concept", 2)]
    got = [(r.source_label, r.score) for r in analyze.surprising_connections(g).collect()]
    assert got == [("LayerNorm", 7), ("MultiHeadAttention", 6)]
    m = analyze.confidence_mix(g).first()
    assert (m.pct_extracted, m.pct_inferred, m.pct_ambiguous, m.inferred_mean) == (50, 25, 25, 0.5)
    c = cluster.cluster_exact(g).collect()
    assert sorted(r.id for r in c) == ["attention", "concept", "layernorm", "transformer"] and {r.cid for r in c} == {0, 1}
    assert "more than a fifth" in report.report_text(g)


def test_two_triangles(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")])
    parts = {}
    for r in cluster.cluster_exact(g).collect():
        parts.setdefault(r.cid, set()).add(r.id)
    assert sorted(map(sorted, parts.values())) == [["a", "b", "c"], ["x", "y", "z"]]
    members = spark.createDataFrame([(0, x) for x in "abcx"] + [(1, "y")], "cid long, id string")
    assert {r.cid: r.cohesion for r in cluster.cohesion(g, members).collect()} == {0: 0.67, 1: 1.0}
    assert cluster.cluster_scalable(g).count() == 6
    with pytest.raises(ValueError):
        cluster.cluster_exact(g, max_edges=3)


def _bfs(adj, s):
    depth, todo = {s: 0}, [s]
    for x in todo:
        for y in sorted(adj.get(x, ())):
            if y not in depth:
                depth[y] = depth[x] + 1
                todo.append(y)
    return depth


def test_searches_and_betweenness_on_random_graphs(spark, rows):
    random.seed(3)
    ids = [f"n{i:02}" for i in range(18)]
    pairs = {tuple(sorted(random.sample(ids, 2))) for _ in range(26)}
    g = graph(spark, sorted(pairs), ids)
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    start = spark.createDataFrame([(0, "n00"), (1, "n05"), (1, "gone")], "q_id int, id string")
    got = {(r.q_id, r.id): r.depth for r in traverse.bfs_levels(g, start, 4).collect()}
    assert got == {(q, x): d for q, s in ((0, "n00"), (1, "n05")) for x, d in _bfs(adj, s).items() if d <= 4}
    asked = spark.createDataFrame([(i, "n00", x) for i, x in enumerate(ids)], "q_id int, source string, target string")
    hops = {r.q_id: (r.hops, r.path) for r in traverse.shortest_paths(g, asked, 20).collect()}
    full = _bfs(adj, "n00")
    for i, x in enumerate(ids):
        assert hops[i][0] == full.get(x)
        if hops[i][1]:
            assert all(b in adj[a] for a, b in zip(hops[i][1], hops[i][1][1:]))
    order = [r.id for r in traverse.dfs_order(g, spark.createDataFrame([(0, "n00")], "q_id int, id string"), 30).orderBy("place").collect()]
    assert order[0] == "n00" and set(order) == set(full)
    want = dict.fromkeys(pairs, 0.0)
    for s in ids:
        d = _bfs(adj, s)
        sigma = {x: 0 for x in d}
        sigma[s] = 1
        for x in sorted(d, key=d.get):
            for y in adj.get(x, ()):
                if d.get(y) == d[x] + 1:
                    sigma[y] += sigma[x]
        delta = dict.fromkeys(d, 0.0)
        for x in sorted(d, key=d.get, reverse=True):
            for y in adj.get(x, ()):
                if d.get(y) == d[x] + 1:
                    c = sigma[x] / sigma[y] * (1 + delta[y])
                    delta[x] += c
                    want[tuple(sorted((x, y)))] += c / 2
    for r in analyze.edge_betweenness(g).collect():
        assert abs(r.betweenness - want[(r.src, r.tgt)]) < 1e-9
    assert analyze.edge_betweenness(g, max_nodes=5).count() == 0


def test_diff_merge_and_update(spark, rows):
    old, new = graph(spark, [("a", "b"), ("b", "c")]), graph(spark, [("a", "b", "imports"), ("b", "d")])
    nodes, edges = analyze.graph_diff(old, new)
    assert rows(nodes) == [("new", "d"), ("removed", "c")]
    assert analyze.diff_summary(nodes, edges).first().summary == "1 new node, 2 new edges, 1 node removed, 2 edges removed"
    assert analyze.diff_summary(*analyze.graph_diff(old, old)).first().summary == "no changes"
    m = merge_repositories({"one": old, "two": new})
    assert rows(m.nodes, "id", "repo") == [("a", "two"), ("b", "two"), ("c", "one"), ("d", "two")]
    fresh_n = spark.createDataFrame([(0, "a", "new", "code", "src/a.py", None, None, None)], N)
    fresh_e = spark.createDataFrame([(0, "a", "c", "calls", None, None, None, None, None, None)], E)
    files = lambda *p: spark.createDataFrame([(x,) for x in p], "source_file string")
    u = update_graph(old, fresh_n, fresh_e, files("src/a.py"), files("src/b.py"))
    assert rows(u.nodes, "id", "label") == [("a", "new"), ("c", "c")] and rows(u.edges, "src", "tgt") == [("a", "c")]


def test_search_and_text(spark):
    nodes = [("foo", "FooBar", "code", "src/foo.rs", None, 1, None), ("caf", "Café()", "code", "src/x.py", None, 2, None), ("n", None, None, None, None, None, None)]
    g = graph(spark, [("foo", "caf", "calls", "INFERRED", "call")], nodes)
    q = spark.createDataFrame([(0, ["foobar"]), (1, ["cafe"])], "q_id int, terms array<string>")
    got = {(r.q_id, r.id): r.score for r in search.score_nodes(g.nodes, q).collect()}
    assert got == {(0, "foo"): 101.0, (1, "caf"): 101.0}
    text = search.query_text(g, "who calls FooBar")
    assert "Context: call" in text and "NODE FooBar" in text and "EDGE" in text
    assert search.query_text(g, "zzz") == "No matching nodes found."
    assert search.query_text(g, "FooBar", budget=1).endswith("cut at the token budget")
    assert search.resolved_contexts("x", ["Call", "call "]) == ["call"]


def test_round_trips(spark, tmp_path, rows):
    g = graph(spark, [("a", "b", "calls", "AMBIGUOUS"), ("b", "c")])
    export.write_graph(g, str(tmp_path / "g"))
    back = export.read_graph(spark, str(tmp_path / "g"))
    assert rows(back.edges, "src", "tgt", "relation") == rows(g.edges, "src", "tgt", "relation") and not back.directed
    doc = str(tmp_path / "graph.json")
    assert export.write_node_link(g, doc)
    assert not export.write_node_link(g.subgraph(spark.createDataFrame([("a",)], "id string")), doc)
    again = export.read_node_link(spark, doc)
    assert rows(again.edges, "src", "tgt", "relation") == rows(g.edges, "src", "tgt", "relation")
    (tmp_path / "alias.json").write_text(json.dumps({"nodes": [{"id": "p", "source": "p.py"}, {"id": "q"}], "edges": [{"from": "p", "to": "q"}], "links": []}))
    alias = export.read_node_link(spark, str(tmp_path / "alias.json"))
    assert rows(alias.nodes, "id", "source_file") == [("p", "p.py"), ("q", None)] and alias.edges.count() == 1
    export.write_lines(export.cypher_lines(g), str(tmp_path / "cy"))
    assert spark.read.text(str(tmp_path / "cy")).count() == 5
    export.write_html(g, str(tmp_path / "g.html"))
    with pytest.raises(ValueError):
        export.write_html(g, str(tmp_path / "g.html"), max_nodes=2)
    named = Graph(g.nodes.withColumn("community", F.lit(1).cast("long")), g.edges)
    assert export.write_wiki(named, str(tmp_path / "w")) >= 1 and (tmp_path / "w" / "index.md").exists()
    export.write_tree(g, str(tmp_path / "tree.json"))
    assert json.loads((tmp_path / "tree.json").read_text())["count"] == 3
    export.write_canvas(g, str(tmp_path / "c.canvas"))
    assert len(json.loads((tmp_path / "c.canvas").read_text())["nodes"]) == 3


def test_tool_server(spark):
    from strandweave.server import ToolServer

    s = ToolServer(graph(spark, [("alpha", "beta"), ("beta", "gamma")]))
    call = lambda name, **a: s.handle({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]
    assert len(s.handle({"id": 1, "method": "tools/list"})["result"]["tools"]) == 7
    assert "2 hops" in call("shortest_path", source="alpha", target="gamma")["content"][0]["text"]
    assert "alpha" in call("get_node", label="alpha")["content"][0]["text"]
    assert "beta" in call("get_neighbors", label="alpha")["content"][0]["text"]
    assert call("get_node", label="nothing")["isError"] and call("what")["isError"]
    assert s.handle({"id": 2, "method": "nope"})["error"]["code"] == -32601 and s.handle({"method": "x"}) is None


@pytest.mark.parametrize("directed", [False, True])
def test_paths_of_pairs_that_share_either_end(spark, directed):
    random.seed(8)
    ids = [f"n{i:02}" for i in range(16)]
    arcs = {tuple(random.sample(ids, 2)) for _ in range(34)}
    g = graph(spark, sorted(arcs), ids, directed)
    adj = {}
    for a, b in arcs:
        adj.setdefault(a, set()).add(b)
        if not directed:
            adj.setdefault(b, set()).add(a)
    pairs = [("n00", x) for x in ids] + [(x, "n01") for x in ids] + [("n02", "gone")] + [tuple(random.sample(ids, 2)) for _ in range(12)]
    asked = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "q_id int, source string, target string")
    for most in (None, 2):
        want = {}
        for i, (s, t) in enumerate(pairs):
            depth, path = _bfs(adj, s), [t]
            if t not in depth or (most is not None and depth[t] > most):
                want[i] = (None, None)
                continue
            while path[0] != s:
                path.insert(0, min(x for x in ids if path[0] in adj.get(x, ()) and depth.get(x) == depth[path[0]] - 1))
            want[i] = (depth[t], path)
        assert {r.q_id: (r.hops, r.path) for r in traverse.shortest_paths(g, asked, most).collect()} == want


def test_pairs_that_share_a_hub_and_their_target_are_searched_together(spark, monkeypatch):
    n, sizes, checkpoint = 200, [], traverse.checkpoint

    def counted(df):
        df = checkpoint(df)
        sizes.append(df.count())
        return df

    monkeypatch.setattr(traverse, "checkpoint", counted)
    g = graph(spark, [("hub", f"s{i:03}") for i in range(n)] + [("hub", "mid"), ("mid", "far")], ["hub", "mid", "far", "alone", *(f"s{i:03}" for i in range(n))])
    pairs = spark.createDataFrame([(i, f"s{i:03}", "far") for i in range(n)] + [(n + i, f"s{i:03}", "alone") for i in range(n)], "q_id int, source string, target string")
    got = {r.q_id: (r.hops, r.path) for r in traverse.shortest_paths(g, pairs, 4).collect()}
    assert got == {i: (3, [f"s{i:03}", "hub", "mid", "far"]) for i in range(n)} | {n + i: (None, None) for i in range(n)}
    assert max(sizes) <= 3 * n
