"""Communities: one level of local moving, splitting, cohesion, and the graph of communities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import checkpoint, checkpoint_dir
from .graph import Graph
from .ranking import rank_by_count

#: Gain below which a node doesn't move, and edges up to which the exact mode runs (it can't move anything beyond).
THRESHOLD, EXACT_EDGES = 1e-4, 10_000
SPLIT_SHARE, SPLIT_LEAST = 0.25, 10
#: Sweeps after which a smaller share of the nodes moves at once.
HALVES = 8
#: Arcs of the nodes that one task moves one after the other (about 40 bytes each).
TASK_ARCS = 16_000_000
#: Arcs that are looked at together there, and neighbours from which they are counted by sorting.
BLOCK_ARCS, HUB = 1_000_000, 100


def seeded_permutation(n: int, seed: int = 42) -> list[int]:
    """A fixed shuffle of range(n) by a linear congruential generator."""
    out, state = list(range(n)), seed
    for i in range(n - 1, 0, -1):
        state = (state * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)
        j = state % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def local_moving(ids: list[str], edges: list[tuple[str, str]], threshold: float = THRESHOLD) -> dict[str, int]:
    """Community of every id: sweeps in a fixed order move each node to the neighbouring community of most gain, ascending on ties.

    Weights are 1; communities are numbered in the order of ids.
    """
    ids = sorted(ids)
    at = {x: i for i, x in enumerate(ids)}
    near: list[set[int]] = [set() for _ in ids]
    m = 0
    for a, b in edges:
        i, j = at[a], at[b]
        if i != j and j not in near[i]:
            m += 1
        near[i].add(j)
        near[j].add(i)
    if not m:
        return {x: i for i, x in enumerate(ids)}
    degree = [len(s) for s in near]
    where, total = list(range(len(ids))), [float(d) for d in degree]
    order, moved = seeded_permutation(len(ids)), True
    while moved:
        moved = False
        for i in order:
            own, k = where[i], degree[i]
            links: dict[int, int] = {}
            for j in near[i]:
                if j != i:
                    links[where[j]] = links.get(where[j], 0) + 1
            stay = links.get(own, 0) / m - (total[own] - k) * k / (2.0 * m * m)
            best, to = 0.0, own
            for c in sorted(links):
                if c == own:
                    continue
                gain = links[c] / m - total[c] * k / (2.0 * m * m) - stay
                if gain > best + threshold:
                    best, to = gain, c
            if to != own:
                total[own] -= k
                total[to] += k
                where[i], moved = to, True
    names: dict[int, int] = {}
    return {x: names.setdefault(where[i], len(names)) for i, x in enumerate(ids)}


def cluster_exact(g: Graph, threshold: float = THRESHOLD, max_edges: int = EXACT_EDGES) -> DataFrame:
    """(cid, id): local moving in one task, communities of over a quarter of the nodes (and over 10) split once, ranked by size.

    Where one link's share of the edges is no more than the threshold, no first move gains enough, so every
    node stays alone at any size.  Raises ValueError for other graphs of over ``max_edges`` edges.
    """
    g = g.undirected()
    if g.edges.limit(max_edges + 1).count() > max_edges:
        if threshold * g.edges.where("src <> tgt").count() >= 1:
            return ranked_communities(g.nodes.select(F.col("id").alias("c"), "id"))
        raise ValueError(f"more than {max_edges} edges; use cluster_scalable")
    rows = g.nodes.select(F.lit(0).alias("k"), F.col("id").alias("src"), F.lit(None).cast("string").alias("tgt")).unionByName(g.edges.select(F.lit(0).alias("k"), "src", "tgt"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        alone = pdf["tgt"].isna()
        ids, edges = list(pdf["src"][alone]), list(zip(pdf["src"][~alone], pdf["tgt"][~alone]))
        linked = {x for e in edges for x in e}
        parts: dict[int, list[str]] = {}
        for x, c in local_moving([x for x in ids if x in linked], edges, threshold).items():
            parts.setdefault(c, []).append(x)
        groups = list(parts.values()) + [[x] for x in sorted(set(ids) - linked)]
        limit, out = max(int(SPLIT_SHARE * len(ids)), SPLIT_LEAST), []
        for members in groups:
            if len(members) > limit:
                inside = set(members)
                sub: dict[int, list[str]] = {}
                for x, c in local_moving(members, [e for e in edges if e[0] in inside and e[1] in inside], threshold).items():
                    sub.setdefault(c, []).append(x)
                out += list(sub.values())
            else:
                out.append(members)
        out = sorted((sorted(x) for x in out), key=lambda x: (-len(x), x[0]))
        return pd.DataFrame([(c, x) for c, members in enumerate(out) for x in members], columns=["cid", "id"])

    return rows.groupBy("k").applyInPandas(run, "cid bigint, id string")


def cluster_scalable(g: Graph, sweeps: int | None = None) -> DataFrame:
    """(cid, id): local moving until no node gains by a move, for graphs of any size.

    Communities of over a quarter of the nodes (and over 10) are split once, by local moving on their own
    edges.  ``sweeps`` bounds the sweeps of each moving; without it there are as many as it takes.
    """
    g = g.undirected()
    adj = checkpoint(g.adjacency.where("src <> tgt").select("src", "tgt"))
    state = _settled(adj, g.nodes.select("id"), sweeps)
    limit = max(int(SPLIT_SHARE * state.count()), SPLIT_LEAST)
    # communities of over a quarter of the nodes are three at most, and of over 10 of fewer nodes none
    for (c,) in state.groupBy("c").count().where(F.col("count") > limit).select("c").collect():
        members = state.where(F.col("c") == c).select("id")
        inside = adj.join(members.withColumnRenamed("id", "src"), "src", "left_semi").join(members.withColumnRenamed("id", "tgt"), "tgt", "left_semi")
        # a part is named by both, as a node's own name may be in use for a community elsewhere
        parts = _settled(checkpoint(inside), members, sweeps).select(F.xxhash64(F.lit(c), "c").alias("c"), "id")
        state = state.where(F.col("c") != c).select("c", "id").unionByName(parts)
    return ranked_communities(state.select("c", "id"))


def _saved(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoints' folder and read back: unlike a checkpoint's, its estimated size doesn't grow with every sweep's joins."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _single(wanted: DataFrame) -> DataFrame:
    """(i, single): of the wanted moves (i, own, to, more) those that gain most of all that leave or enter either community.

    No two of them touch the same community, so each gains what was reckoned and the modularity rises.
    """
    key = F.struct("more", F.xxhash64("i").alias("h"), "i")
    first = wanted.select(F.explode(F.array("own", "to")).alias("c"), key.alias("x")).groupBy("c").agg(F.max("x").alias("x"))
    top = lambda end: first.select(F.col("c").alias(end), F.col("x.i").alias("i"))
    return wanted.select("i", "own", "to").join(top("own"), ["own", "i"], "left_semi").join(top("to"), ["to", "i"], "left_semi").select("i", F.lit(True).alias("single"))


def _numbered(ids: DataFrame) -> DataFrame:
    """(id, i): the place of every id in their order, whatever the partitions are."""
    rows = _saved(ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("x"))).select("id", F.shiftright("x", 33).alias("p"), F.col("x").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    # a row per partition
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _saved(rows.join(F.broadcast(rows.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", ahead.alias("ahead"))), "p").select("id", (F.col("nth") + F.col("ahead")).alias("i")))


def _wanted(near: np.ndarray, begin: np.ndarray, where: np.ndarray, degree: np.ndarray, total: np.ndarray, two_m: int) -> np.ndarray:
    """Nodes that gain by a move: a block of arcs after the other."""
    found, n, low = [], len(degree), 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(begin, begin[low] + BLOCK_ARCS, "right")) - 1)
        node = np.repeat(np.arange(low, high), np.diff(begin[low : high + 1]))
        # one row per node and community, in this order
        key = np.sort((node - low) * len(total) + where[near[begin[low] : begin[high]]])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        links = np.diff(first, append=len(key))
        node, c = key[first] // len(total) + low, key[first] % len(total)
        same = c == where[node]
        gain = links * two_m - (total[c] - np.where(same, degree[node], 0)) * degree[node]
        start = np.flatnonzero(np.diff(node, prepend=-1))
        if len(start):
            most = np.maximum.reduceat(gain, start)
            # of equal gains the own community
            kept = (most <= 0) | np.logical_or.reduceat(same & (gain == np.repeat(most, np.diff(start, append=len(node)))), start)
            found.append(node[start[~kept]])
        low = high
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _drained(who: np.ndarray, near: np.ndarray, begin: np.ndarray, where: np.ndarray, degree: np.ndarray, total: np.ndarray, turn: np.ndarray, two_m: int, passes: int | None) -> int:
    """Moves the nodes ``who`` one after the other, then the neighbours of those that moved, until none of them gains; the number of passes."""
    at, sums, degrees, starts, n = where.tolist(), total.tolist(), degree.tolist(), begin.tolist(), len(degree)
    todo, done = who[np.argsort(turn[who])].tolist(), 0
    while todo and (passes is None or done < passes):
        again: set[int] = set()
        for i in todo:
            k, own = degrees[i], at[i]
            around = near[starts[i] : starts[i + 1]]
            if len(around) > HUB:
                links = dict(zip(*(x.tolist() for x in np.unique(where[around], return_counts=True))))
            else:
                links = {}
                for j in around.tolist():
                    c = at[j]
                    links[c] = links.get(c, 0) + 1
            # of equal gains the own community, then the smallest one
            to, best = own, 0
            if own in links:
                best = max(0, links.pop(own) * two_m - (sums[own] - k) * k)
            for c, x in links.items():
                gain = x * two_m - sums[c] * k
                if gain > best or (gain == best and to != own and c < to):
                    to, best = c, gain
            if to != own:
                sums[own] -= k
                sums[to] += k
                at[i] = where[i] = to
                again.update(j for j in around.tolist() if j < n and at[j] != to)
        done += 1
        todo = sorted(again, key=turn.__getitem__)
    total[:] = sums
    return done


def _moving(two_m: int, passes: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Moves nodes until none of them gains, or for some ``passes``; (i, c) of those that may move.

    Rows (kind, a, b, c): 0 a node that stays and its community; 1 one that may move, its community and degree;
    2 an arc from one that may move; 3 a community and its total degree.  They move one after the other in the order of the exact
    mode, each gain reckoned from the communities as they are just then, so that each move raises the modularity, which ends it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[tuple[np.ndarray, ...]]] = [[], [], [], []]
        for batch in batches:
            kind, *columns = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            for k in np.unique(kind):
                parts[k].append(tuple(x[kind == k] for x in columns[: 3 if k == 1 else 2]))
        stay, free, arcs, sums = (
            [np.concatenate([x[n] for x in p]) if p else np.empty(0, np.int64) for n in range(3 if k == 1 else 2)] for k, p in enumerate(parts)
        )
        parts.clear()
        # nodes and communities are numbered by their order, those that may move first
        names, ids = np.sort(sums[0]), np.sort(free[0])
        others, n = np.sort(stay[0]), len(ids)
        home = np.empty(n + len(others), np.int64)
        home[np.searchsorted(ids, free[0])] = np.searchsorted(names, free[1])
        home[n + np.searchsorted(others, stay[0])] = np.searchsorted(names, stay[1])
        where, degree, total = home, free[2][np.argsort(free[0])], sums[1][np.argsort(sums[0])]
        source = np.searchsorted(ids, arcs[0]).astype(np.int32)
        at = np.searchsorted(ids, arcs[1]).astype(np.int32)
        if len(others):
            outside = ids[np.minimum(at, n - 1)] != arcs[1]
            at[outside] = n + np.searchsorted(others, arcs[1][outside])
        del arcs, stay, free, sums
        near = at[np.argsort(source, kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=n))])
        del source, at
        turn = np.empty(n, np.int64)
        turn[seeded_permutation(n)] = np.arange(n)
        done = 0
        while passes is None or done < passes:
            # totals change for others than neighbours too, so the moving ends when of all nodes none gains
            who = _wanted(near, begin, where, degree, total, two_m)
            if not len(who):
                break
            done += _drained(who, near, begin, where, degree, total, turn, two_m, None if passes is None else passes - done)
        found = names[where[:n]]
        for x in range(0, n, 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[x : x + 100_000]), pa.array(found[x : x + 100_000])], names=["i", "c"])

    return run


def _one_by_one(adj: DataFrame, state: DataFrame, free: DataFrame, two_m: int, passes: int | None) -> DataFrame:
    """(i, k, c) of all nodes after those of ``free`` (i) were moved in one task; it gets their arcs, and of other nodes and communities only those they touch."""
    zero = F.lit(0).cast("bigint")
    row = lambda df, kind, a, b, c=zero: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), c.alias("c"))
    if free is state:
        # nodes without arcs stay alone
        arcs, stay = adj, None
        own = sums = state.where("k > 0")
    else:
        arcs = _saved(adj.join(free.select(F.col("i").alias("src")), "src", "left_semi"))
        own = state.join(free.select("i"), "i", "left_semi")
        stay = state.join(arcs.select(F.col("tgt").alias("i")).distinct(), "i", "left_semi").join(free.select("i"), "i", "left_anti")
        sums = state.join(own.unionByName(stay).select("c").distinct(), "c", "left_semi")
    rows = row(own, 1, "i", "c", F.col("k")).unionByName(row(arcs, 2, "src", "tgt")).unionByName(row(sums.groupBy("c").agg(F.sum("k").alias("total")), 3, "c", "total"))
    if stay is not None:
        rows = rows.unionByName(row(stay, 0, "i", "c"))
    moved = _saved(rows.repartition(1).mapInArrow(_moving(two_m, passes), "i bigint, c bigint"))
    return _saved(state.select("i", "k", F.col("c").alias("_c")).join(moved, "i", "left").select("i", "k", F.coalesce("c", "_c").alias("c")))


def _settled(adj: DataFrame, ids: DataFrame, sweeps: int | None) -> DataFrame:
    """(id, c): communities of local moving over the arcs ``adj`` (src, tgt), every node on its own at first.

    A node wants the neighbouring community of most positive gain.  Up to ``TASK_ARCS`` arcs one task moves the nodes one after
    the other (``_moving``).  Of more, joins find the nodes that want to move; once these have no more arcs than that, one task
    moves them, again and again until none wants to.  Before, half of those that want to move do
    in every sweep (by a hash of number and sweep), so that neighbours don't swap for ever; later ever smaller shares, and
    besides them the best move of every community (``_single``), each of which raises the modularity.  Gains are whole
    numbers (in units of 1 / 2m²), so that equal ones are equal.  Links are counted per node and community
    before they are shuffled; community totals are one aggregation.
    """
    numbers = _numbered(ids)
    end = lambda name: numbers.select(F.col("id").alias(name), F.col("i").alias(f"{name}_i"))
    adj = _saved(adj.join(end("src"), "src").join(end("tgt"), "tgt").select(F.col("src_i").alias("src"), F.col("tgt_i").alias("tgt")))
    arcs = adj.count()
    m = max(1, arcs // 2)
    degree = adj.groupBy("src").agg(F.count(F.lit(1)).alias("k")).select(F.col("src").alias("i"), "k")
    state = _saved(numbers.select("i").join(degree, "i", "left").select("i", F.coalesce("k", F.lit(0)).alias("k"), F.col("i").alias("c")))
    if arcs <= TASK_ARCS:
        return numbers.join(_one_by_one(adj, state, state, 2 * m, sweeps), "i").select("id", "c")
    sweep = 0
    while sweeps is None or sweep < sweeps:
        totals = state.groupBy("c").agg(F.sum("k").alias("total"))
        here = state.select(F.col("i").alias("src"), "k", F.col("c").alias("own"))
        links = adj.join(state.select(F.col("i").alias("tgt"), "c"), "tgt").groupBy("src", "c").agg(F.count(F.lit(1)).alias("n"))
        options = links.join(here, "src").join(totals, "c")
        same = F.col("c") == F.col("own")
        gain = F.col("n") * (2 * m) - (F.col("total") - F.when(same, F.col("k")).otherwise(0)) * F.col("k")
        # of equal gains the own community, then the smallest one
        best = options.groupBy("src").agg(F.max(F.struct(gain.alias("gain"), same.alias("same"), (-F.col("c")).alias("minus"))).alias("x"), F.first("own").alias("own"), F.first("k").alias("k"), F.max(F.when(same, gain)).alias("stay"))
        more = F.col("x.gain") - F.coalesce(F.col("stay"), F.lit(0))
        wanted = _saved(best.where("x.gain > 0 and not x.same").select(F.col("src").alias("i"), "k", "own", (-F.col("x.minus")).alias("to"), more.alias("more")))
        wanting = wanted.agg(F.sum("k")).first()[0]
        if wanting is None:
            break
        if wanting <= TASK_ARCS:
            state = _one_by_one(adj, state, wanted, 2 * m, None if sweeps is None else 1)
        else:
            moves = F.pmod(F.xxhash64("i", F.lit(sweep)), F.lit(2 + sweep // HALVES)) == 0
            chosen = wanted.where(moves).select("i", "to")
            if sweep >= HALVES:
                chosen = wanted.join(_single(wanted), "i", "left").where(moves | F.col("single").isNotNull()).select("i", "to")
            state = _saved(state.join(chosen, "i", "left").select("i", "k", F.coalesce("to", "c").alias("c")))
        sweep += 1
    return numbers.join(state, "i").select("id", "c")


def ranked_communities(assigned: DataFrame) -> DataFrame:
    """(cid, id) of (c, id): communities ranked by size, then by their least id.  The ranking is of communities, not of nodes."""
    sizes = assigned.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    ranked = rank_by_count(sizes, "first")
    return assigned.join(ranked.select("c", F.col("rank").alias("cid")), "c").select("cid", "id")


def cohesion(g: Graph, members: DataFrame) -> DataFrame:
    """(cid, n, internal, cohesion) of every community of ``members`` (cid, id): internal edges over possible pairs, two decimals half up; 1 for one node."""
    a = members.select(F.col("id").alias("src"), F.col("cid").alias("_a"))
    b = members.select(F.col("id").alias("tgt"), F.col("cid").alias("_b"))
    inside = g.edges.select("src", "tgt").where("src <> tgt").join(a, "src").join(b, "tgt").where("_a = _b").groupBy(F.col("_a").alias("cid")).agg(F.count(F.lit(1)).alias("internal"))
    n = members.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).join(inside, "cid", "left").withColumn("internal", F.coalesce("internal", F.lit(0)))
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    return n.withColumn("cohesion", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.floor(F.col("internal") / pairs * 100.0 + 0.5) / 100.0))


def stored_communities(g: Graph) -> DataFrame:
    """(cid, id) by the nodes' community attribute."""
    return g.nodes.where("community is not null").select(F.col("community").alias("cid"), "id")


def meta_graph(g: Graph, members: DataFrame) -> DataFrame:
    """(low, high, n_edges) between communities."""
    a = members.select(F.col("id").alias("src"), F.col("cid").alias("_a"))
    b = members.select(F.col("id").alias("tgt"), F.col("cid").alias("_b"))
    e = g.edges.select("src", "tgt").join(a, "src").join(b, "tgt").where("_a <> _b")
    return e.groupBy(F.least("_a", "_b").alias("low"), F.greatest("_a", "_b").alias("high")).agg(F.count(F.lit(1)).alias("n_edges"))
