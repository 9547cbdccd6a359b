import datetime as dt

from strandweave.operators.orphans import lifetimes, orphan_counts, orphan_references
from strandweave.functions.text import normalize_id
from pyspark.sql import functions as F

T = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
N = "id string, added_at timestamp, deleted_at timestamp, label string"
E = "ord long, source string, target string, seen_at timestamp, label string"


def brute(nodes, edges):
    import re

    key = lambda s: tuple(re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), s)))
    out = set()
    for o, s, t, seen, _ in edges:
        for end, x in (("source", s), ("target", t)):
            if x is not None and x.strip() and not any(i is not None and a is not None and seen is not None and key(i) == key(x) and a <= seen and (d is None or d > seen) for i, a, d, _ in nodes):
                out.add((o, end))
    return out


def test_against_brute_force(spark):
    nodes = [("a_b", T(0), T(5), None), ("A-B", T(4), T(6), None), ("a_b", T(10), None, None), ("c", T(3), T(3), None), ("d", None, None, None), (None, T(0), None, None), ("e", T(0), T(40), None), ("e", T(0), T(40), None), ("É", T(0), None, None)]
    edges = []
    for i, name in enumerate(["a_b", "_A__b_", "c", "d", "e", "zz", None, "", "  ", "a b c", "ab", "é", " "]):
        for day in (-1, 0, 3, 5, 6, 9, 10, 39, 40):
            edges.append((len(edges), name, "e" if i % 2 else "a.b", T(day), "x"))
    edges.append((len(edges), "a_b", "e", None, "x"))
    edges.append(edges[0])
    n, e = spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)
    got = orphan_references(e, n).collect()
    assert {tuple(r) for r in got} == brute(nodes, [x for x in edges if x[1] != " "]) | {(o, "target") for o, s, t, seen, _ in edges if s == " " and (o, "target") in brute(nodes, edges)}
    total = orphan_counts(e, n).agg(F.sum("n_orphans"), F.sum("n_references")).first()
    assert total[0] == len(got)


def test_lifetimes_are_disjoint_and_empty_tables_work(spark):
    n = spark.createDataFrame([("k", T(i), T(i + 1 + i % 3), None) for i in range(400)], N)
    spans = lifetimes(n, normalize_id(F.col("id"))).first().spans
    assert len(spans) == 1 and spans[0].begin == T(0)
    none_e, none_n = spark.createDataFrame([], E), spark.createDataFrame([], N)
    assert orphan_references(none_e, n).count() == 0
    assert orphan_references(spark.createDataFrame([(1, "k", "q", T(1), None)], E), none_n).count() == 2


def test_hot_keys_are_salted_without_a_change_of_rows(spark, monkeypatch):
    from strandweave.operators import orphans

    nodes = [("hot", T(0), T(5), None), ("cold", T(0), None, None), ("never lived", None, None, None)]
    edges = [(i, "hot" if i % 3 else "gone", ("cold", "never_lived", "Hot", None)[i % 4], T(i % 9) if i % 7 else None, "x") for i in range(3000)]
    n, e = spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)
    want = brute(nodes, edges)
    for one_in, threshold in ((1000, "10MB"), (1000, "-1"), (1, "-1"), (10**9, "-1"), (10**9, "10MB")):
        monkeypatch.setattr(orphans, "HOT_ONE_IN", one_in)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = [tuple(r) for r in orphan_references(e, n).collect()]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert len(got) == len(want) and set(got) == want
    counts = orphan_counts(e, n).collect()
    assert sum(r.n_orphans for r in counts) == len(want) and sum(r.n_never_existed for r in counts) == sum(x[1] == "gone" for x in edges)
    plan = orphans.suspect_keys(orphans.references(e), n, normalize_id(F.col("id")))._jdf.queryExecution().toString()
    assert "LeftAnti" in plan
