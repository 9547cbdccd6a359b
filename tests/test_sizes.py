"""Betweenness and communities beyond the sizes at which they used to stop."""

from pyspark.sql import functions as F
from test_graph import graph

from strandweave.operators import analyze, cluster
from strandweave.plans import queries


def test_betweenness_and_exact_communities_of_many_places(spark, tmp_path):
    n = 10_010
    spark.createDataFrame([(0, "R0"), (1, "R1")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(i, f"N{i}", i % 2) for i in range(5)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"), F.expr("cast(id % 5 as int)").alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    per = n // 5
    trees = {0: 1 + 3 * (per + 1), 1: 1 + 2 * (per + 1)}
    want = {tuple(sorted((f"s_{i}", f"n_{i % 5}"))): trees[i % 5 % 2] - 1.0 for i in range(n)}
    want |= {(f"n_{i}", f"r_{i % 2}"): (per + 1.0) * (trees[i % 2] - per - 1) for i in range(5)}
    assert {(r.src, r.tgt): r.betweenness for r in queries.edge_betweenness(spark, str(tmp_path)).collect()} == want
    # one link of 10,015 gains less than the threshold, so nothing moves
    ids = sorted([f"s_{i}" for i in range(n)] + [f"n_{i}" for i in range(5)] + ["r_0", "r_1"])
    assert sorted((r.cid, r.id) for r in queries.louvain_exact(spark, str(tmp_path)).collect()) == list(enumerate(ids))


def test_only_surprises_are_bounded_by_nodes(spark, monkeypatch):
    nodes = [(x, x, "code", "src/a.py", None, None, None) for x in "abcd"]
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "d")], nodes)
    assert analyze.surprising_connections(g).count() == 3
    monkeypatch.setattr(analyze, "BETWEENNESS_NODES", 3)
    assert analyze.surprising_connections(g).count() == 0 and analyze.edge_betweenness(g).count() == 3
