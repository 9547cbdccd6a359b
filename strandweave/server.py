"""The tools of the graph over JSON-RPC lines."""

from __future__ import annotations

import json
import sys
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.analyze import god_nodes, graph_stats
from .operators.graph import Graph
from .operators.search import find_nodes, node_details, query_text
from .operators.traverse import shortest_paths

TOOLS = {
    "query_graph": ("Search the graph for a question", {"question": "string", "mode": "string", "depth": "integer", "token_budget": "integer"}, ["question"]),
    "get_node": ("Details of a node", {"label": "string"}, ["label"]),
    "get_neighbors": ("Neighbours of a node", {"label": "string", "relation_filter": "string"}, ["label"]),
    "get_community": ("Members of a community", {"community_id": "integer"}, ["community_id"]),
    "god_nodes": ("Nodes of highest degree", {"top_n": "integer"}, []),
    "graph_stats": ("Counts and shares", {}, []),
    "shortest_path": ("Shortest path between two nodes", {"source": "string", "target": "string", "max_hops": "integer"}, ["source", "target"]),
}
MAX_DEPTH, MAX_ROWS = 6, 1000


class ToolServer:
    """Answers requests about one graph, whose frames are kept in memory or on disk."""

    def __init__(self, g: Graph):
        self.g = Graph(g.nodes.persist(), g.edges.persist(), g.directed, g.hyperedges)

    def tools(self) -> list[dict]:
        return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}, "required": r}} for n, (d, p, r) in TOOLS.items()]

    def _first(self, term: str):
        found = find_nodes(self.g.nodes, term).limit(1).collect()
        if not found:
            raise LookupError(f"no node matches '{term}'")
        return found[0]

    @staticmethod
    def _page(rows: DataFrame, line) -> str:
        """The first MAX_ROWS rows as lines; the last line says how many more there are."""
        found = rows.limit(MAX_ROWS + 1).collect()
        more = [f"... and {rows.count() - MAX_ROWS} more"] if len(found) > MAX_ROWS else []
        return "\n".join([line(r) for r in found[:MAX_ROWS]] + more)

    def call(self, name: str, a: dict) -> str:
        g = self.g
        if name == "query_graph":
            return query_text(g, a["question"], a.get("mode", "bfs"), min(int(a.get("depth", 3)), MAX_DEPTH), int(a.get("token_budget", 2000)))
        if name == "get_node":
            row = node_details(g, a["label"]).first()
            if row is None:
                raise LookupError(f"no node matches '{a['label']}'")
            show = lambda x: "" if x is None else x
            return f"Node: {row.label}\n  Id: {row.id}\n  Source: {show(row.source_file)} {show(row.source_location)}\n  Type: {show(row.file_type)}\n  Community: {show(row.community)}\n  Degree: {row.degree}"
        if name == "get_neighbors":
            n = self._first(a["label"])
            near = g.adjacency.where(F.col("src") == n.id)
            if a.get("relation_filter"):
                near = near.where(F.lower(F.coalesce("relation", F.lit(""))).contains(a["relation_filter"].lower()))
            return self._page(near.orderBy("tgt"), lambda r: f"{r.relation} -> {r.tgt}")
        if name == "get_community":
            return self._page(g.nodes.where(F.col("community") == int(a["community_id"])).orderBy("ord"), lambda r: f"{r.label} ({r.source_file})")
        if name == "god_nodes":
            return "\n".join(f"{r.label}: {r.degree}" for r in god_nodes(g, int(a.get("top_n", 10))).collect())
        if name == "graph_stats":
            return json.dumps(graph_stats(g).first().asDict())
        if name == "shortest_path":
            s, t = self._first(a["source"]), self._first(a["target"])
            pair = g.nodes.sparkSession.createDataFrame([(0, s.id, t.id)], "q_id int, source string, target string")
            hit = shortest_paths(g, pair, int(a.get("max_hops", 8))).first()
            if hit.hops is None:
                raise LookupError("no path within the hops allowed")
            return f"{hit.hops} hops: " + " -> ".join(hit.path)
        raise LookupError(f"unknown tool '{name}'")

    def handle(self, request: dict) -> dict | None:
        """The answer to one request, None for a notification."""
        rid, method, params = request.get("id"), request.get("method"), request.get("params") or {}
        if rid is None:
            return None
        ok = lambda r: {"jsonrpc": "2.0", "id": rid, "result": r}
        if method == "initialize":
            return ok({"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "strandweave", "version": "0.1"}})
        if method == "ping":
            return ok({})
        if method == "tools/list":
            return ok({"tools": self.tools()})
        if method == "tools/call":
            try:
                return ok({"content": [{"type": "text", "text": self.call(params.get("name", ""), params.get("arguments") or {})}], "isError": False})
            except (LookupError, KeyError, ValueError, TypeError) as e:
                return ok({"content": [{"type": "text", "text": str(e)}], "isError": True})
        return {"jsonrpc": "2.0", "id": rid, "error": {"code": -32601, "message": f"unknown method {method}"}}

    def serve(self, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
        """Answers line by line; lines that don't parse are passed over."""
        for line in source:
            try:
                request = json.loads(line)
            except ValueError:
                continue
            if isinstance(request, dict) and (answer := self.handle(request)) is not None:
                sink.write(json.dumps(answer) + "\n")
                sink.flush()
