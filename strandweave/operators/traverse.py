"""Breadth-first, depth-first and shortest-path searches as joins of frontiers with the adjacency."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import checkpoint
from .graph import Graph


#: Arcs of the ball that a depth-first order is made of.
MAX_BALL = 5_000_000


def filtered_adjacency(g: Graph, contexts: list[str] | None = None) -> DataFrame:
    """(src, tgt) of the adjacency; with contexts only edges of these, and none without a context."""
    adj = g.adjacency
    if contexts:
        adj = adj.where(F.col("context").isin(*contexts))
    return adj.select("src", "tgt")


def bfs_levels(g: Graph, starts: DataFrame, depth: int = 3, contexts: list[str] | None = None) -> DataFrame:
    """(q_id, id, depth) of all nodes within ``depth`` of the starts (q_id, id), for many questions at once.

    The adjacency is written once and every level reads it; a level joins the frontier with it and
    leaves out what was visited.  Starts that aren't nodes are dropped; repeated starts count once.
    """
    adj = checkpoint(filtered_adjacency(g, contexts))
    first = starts.select("q_id", "id").distinct().join(g.nodes.select("id"), "id", "left_semi").select("q_id", "id", F.lit(0).cast("bigint").alias("depth"))
    seen = frontier = checkpoint(first)
    for d in range(depth):
        step = adj.join(frontier.select("q_id", F.col("id").alias("src")), "src").select("q_id", F.col("tgt").alias("id")).distinct()
        frontier = checkpoint(step.join(seen.select("q_id", "id"), ["q_id", "id"], "left_anti").select("q_id", "id", F.lit(d + 1).cast("bigint").alias("depth")))
        seen = seen.unionByName(frontier)
    return seen


def bfs_edges(g: Graph, levels: DataFrame, contexts: list[str] | None = None) -> DataFrame:
    """(q_id, src, tgt) of the edges a breadth-first search crosses: from each level to the next one."""
    a = levels.select("q_id", F.col("id").alias("src"), F.col("depth").alias("_a"))
    b = levels.select("q_id", F.col("id").alias("tgt"), F.col("depth").alias("_b"))
    return filtered_adjacency(g, contexts).join(a, "src").join(b, ["q_id", "tgt"]).where("_b = _a + 1").select("q_id", "src", "tgt")


def dfs_order(g: Graph, starts: DataFrame, depth: int = 3, contexts: list[str] | None = None) -> DataFrame:
    """(q_id, place, id, depth) in depth-first order with neighbours ascending, cut below ``depth``.

    Only the ball of that radius is visited.  The order of a question is one task's work, as each step
    depends on all before it; ValueError if a ball has more than ``MAX_BALL`` arcs.
    """
    levels = checkpoint(bfs_levels(g, starts, depth, contexts))
    ids = levels.select("q_id", "id")
    inside = filtered_adjacency(g, contexts).join(ids.withColumnRenamed("id", "src"), "src").join(ids.withColumnRenamed("id", "tgt"), ["q_id", "tgt"])
    rows = inside.select("q_id", "src", "tgt").unionByName(levels.where("depth = 0").select("q_id", F.col("id").alias("src"), F.lit(None).cast("string").alias("tgt")))

    largest = rows.groupBy("q_id").count().agg(F.max("count")).first()[0] or 0
    if largest > MAX_BALL:
        raise ValueError(f"{largest} arcs within depth {depth}; depth-first order is for {MAX_BALL} at most")

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for s, t in zip(pdf["src"], pdf["tgt"]):
            if t is not None:
                near.setdefault(s, []).append(t)
        begin = sorted(pdf["src"][pdf["tgt"].isna()])
        stack, visited, out = [(s, 0) for s in reversed(begin)], set(), []
        while stack:
            x, d = stack.pop()
            if x in visited or d > depth:
                continue
            visited.add(x)
            out.append((key[0], len(out), x, d))
            stack += [(y, d + 1) for y in sorted(near.get(x, ()), reverse=True) if y not in visited]
        return pd.DataFrame(out, columns=["q_id", "place", "id", "depth"])

    kind = dict(starts.dtypes)["q_id"]
    return rows.groupBy("q_id").applyInPandas(walk, f"q_id {kind}, place bigint, id string, depth bigint")


def shortest_paths(g: Graph, pairs: DataFrame, max_hops: int | None = 8) -> DataFrame:
    """(q_id, hops, path) for every pair (q_id, source, target); hops and path are null where no path of at most max_hops exists
    (None: of any length).

    Of equal paths the one whose predecessors are smallest from the target back is taken; a pair of equal ids
    has 0 hops.  Pairs that share an end are searched together, once from the end that more pairs share: a search stops
    as soon as the other ends of all its pairs are reached, and every level keeps the nodes that it reached.  Paths are laid
    at the end, for the pairs that have one.
    """
    adj = checkpoint(filtered_adjacency(g))
    known = g.nodes.select("id")
    asked = pairs.select("q_id", "source", "target").join(known, F.col("source") == F.col("id"), "left_semi").join(known, F.col("target") == F.col("id"), "left_semi")
    shared = lambda end: asked.groupBy(end).agg(F.count(F.lit(1)).alias(f"n_{end}"))
    asked = checkpoint(asked.join(shared("source"), "source").join(shared("target"), "target").select("q_id", "source", "target", (F.col("n_target") > F.col("n_source")).alias("back")))
    onward = _paths_onward(adj, asked.where("not back"), max_hops)
    backward = _paths_backward(adj, asked.where("back"), max_hops)
    return pairs.select("q_id").join(onward.unionByName(backward), "q_id", "left")


def _reached(adj: DataFrame, ends: DataFrame, max_hops: int | None) -> list[DataFrame]:
    """Levels (begin, id, before) of the searches from each ``begin`` of ends (begin, end), until every end is reached; before is the least predecessor."""
    ends = checkpoint(ends.distinct())
    levels = [checkpoint(ends.select("begin", F.col("begin").alias("id"), F.lit(None).cast("string").alias("before")).distinct())]
    seen = levels[0].select("begin", "id")
    open_ = checkpoint(ends.where("begin <> end"))
    while max_hops is None or len(levels) <= max_hops:
        frontier = levels[-1].join(open_.select("begin"), "begin", "left_semi")
        step = adj.join(frontier.select("begin", F.col("id").alias("src")), "src").groupBy("begin", F.col("tgt").alias("id")).agg(F.min("src").alias("before"))
        fresh = checkpoint(step.join(seen, ["begin", "id"], "left_anti").select("begin", "id", "before"))
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen = seen.unionByName(fresh.select("begin", "id"))
        open_ = checkpoint(open_.join(fresh.select("begin", F.col("id").alias("end")), ["begin", "end"], "left_anti"))
    return levels


def _paths_onward(adj: DataFrame, asked: DataFrame, max_hops: int | None) -> DataFrame:
    """(q_id, hops, path) of pairs (q_id, source, target) by searches from their sources: walked from the target back, by those of shorter paths level by level."""
    levels = _reached(adj, asked.select(F.col("source").alias("begin"), F.col("target").alias("end")), max_hops)
    back = None
    for h in range(len(levels) - 1, -1, -1):
        met = levels[h].select(F.col("begin").alias("source"), F.col("id").alias("target"))
        begun = asked.join(met, ["source", "target"]).select("q_id", "source", F.lit(h).cast("bigint").alias("hops"), F.col("target").alias("at"), F.array("target").alias("path"))
        back = begun if back is None else back.unionByName(begun)
        if h:
            here = levels[h].select(F.col("begin").alias("source"), F.col("id").alias("at"), "before")
            back = back.join(here, ["source", "at"]).select("q_id", "source", "hops", F.col("before").alias("at"), F.concat(F.array("before"), "path").alias("path"))
    return back.select("q_id", "hops", "path")


def _paths_backward(adj: DataFrame, asked: DataFrame, max_hops: int | None) -> DataFrame:
    """(q_id, hops, path) of pairs (q_id, source, target) by searches from their targets against the arcs.

    A node of a shortest path is one hop nearer to the target than the one before it, so from the source on
    every level keeps the least path that leads to each such node.
    """
    levels = _reached(adj.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")), asked.select(F.col("target").alias("begin"), F.col("source").alias("end")), max_hops)
    on = None
    for h in range(len(levels) - 1, -1, -1):
        met = levels[h].select(F.col("begin").alias("target"), F.col("id").alias("source"))
        begun = asked.join(met, ["source", "target"]).select("q_id", "target", F.lit(h).cast("bigint").alias("hops"), F.col("source").alias("at"), F.array("source").alias("back"))
        on = begun if on is None else on.unionByName(begun)
        if h:
            # of a node's arcs only those that lead nearer, before they meet the pairs
            here = levels[h].select(F.col("begin").alias("target"), F.col("id").alias("at"))
            near = levels[h - 1].select(F.col("begin").alias("target"), F.col("id").alias("next"))
            arcs = adj.select(F.col("src").alias("at"), F.col("tgt").alias("next")).join(here, "at").join(near, ["target", "next"])
            # paths are held from their last node back, in which order they compare
            step = on.join(arcs, ["target", "at"])
            on = step.groupBy("q_id", "target", "hops", F.col("next").alias("at")).agg(F.min("back").alias("back")).select("q_id", "target", "hops", "at", F.concat(F.array("at"), "back").alias("back"))
    return on.select("q_id", "hops", F.reverse("back").alias("path"))
