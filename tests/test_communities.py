"""Scalable communities: moving until nothing moves, and the split of large ones."""

import random
from itertools import combinations

from pyspark.sql import functions as F
from test_graph import graph

from strandweave.operators import cluster


def test_scalable_moving_goes_on_until_no_node_gains(spark):
    pairs = [(f"n{i:04}", f"n{i + 1:04}") for i in range(1500)] + [("hub", f"n{i:04}") for i in range(0, 300, 3)]
    where = {r.id: r.cid for r in cluster.cluster_scalable(graph(spark, pairs)).collect()}
    near, total, m = {}, {}, len(pairs)
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    for x, ys in near.items():
        total[where[x]] = total.get(where[x], 0) + len(ys)
    assert len(where) == len(near) and max(total.values()) > 10
    for x, ys in near.items():
        links = {}
        for y in ys:
            links[where[y]] = links.get(where[y], 0) + 1
        gains = {c: 2 * m * k - (total[c] - len(ys) * (c == where[x])) * len(ys) for c, k in links.items()}
        best = max(gains.values())
        assert best <= 0 or gains.get(where[x]) == best, x


def test_scalable_splits_a_community_of_over_a_quarter(spark, monkeypatch):
    cliques = ["abcdef", "uvwxyz"]
    g = graph(spark, [p for c in cliques for p in combinations(c, 2)] + [("f", "u")])
    settled, calls = cluster._settled, []

    def first_whole(adj, ids, sweeps):
        calls.append(adj.count())
        return ids.select("id", F.lit(7).cast("bigint").alias("c")) if len(calls) == 1 else settled(adj, ids, sweeps)

    monkeypatch.setattr(cluster, "_settled", first_whole)
    parts = {}
    for r in cluster.cluster_scalable(g).collect():
        parts.setdefault(r.cid, set()).add(r.id)
    assert sorted("".join(sorted(p)) for p in parts.values()) == cliques and calls == [62, 62]


def test_scalable_moving_takes_few_rounds_and_ends_alike_by_one_task_or_many(spark, monkeypatch):
    random.seed(5)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((random.randrange(60), random.randrange(60)) for _ in range(200)) if a != b} | {(i, 60) for i in range(0, 60, 2)})
    g = graph(spark, [(f"n{a:02}", f"n{b:02}") for a, b in pairs] + [("n07", "n07")], [f"n{i:02}" for i in range(62)])
    near, m, saved, rounds = {}, len(pairs), cluster._saved, []
    for a, b in pairs:
        near.setdefault(f"n{a:02}", []).append(f"n{b:02}")
        near.setdefault(f"n{b:02}", []).append(f"n{a:02}")
    monkeypatch.setattr(cluster, "SPLIT_SHARE", 1.0)
    monkeypatch.setattr(cluster, "_saved", lambda df: rounds.append(1) or saved(df))
    # all in one task, in small blocks with every node a hub; by joins until few want to move
    for arcs, most, block, hub in ((2 * m, 10, 50, 0), (m, 40, 1_000, 100)):
        monkeypatch.setattr(cluster, "TASK_ARCS", arcs)
        monkeypatch.setattr(cluster, "BLOCK_ARCS", block)
        monkeypatch.setattr(cluster, "HUB", hub)
        rounds.clear()
        where = {r.id: r.cid for r in cluster.cluster_scalable(g).collect()}
        assert len(where) == 62 and sum(c == where["n61"] for c in where.values()) == 1 and len(rounds) <= most
        total = {}
        for x, ys in near.items():
            total[where[x]] = total.get(where[x], 0) + len(ys)
        for x, ys in near.items():
            gains = {c: 2 * m * sum(where[y] == c for y in ys) - (total[c] - len(ys) * (c == where[x])) * len(ys) for c in {where[y] for y in ys}}
            assert max(gains.values()) <= 0 or gains.get(where[x]) == max(gains.values()), x
