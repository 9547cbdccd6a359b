"""Problem 7: filling containers of fixed capacity.

Only the histogram of sizes enters the packing, which is bounded by the capacity and
not by the number of documents.  Martello and Toth's dominance criterion first fixes
sets of up to three sizes that no other choice can beat, many containers at a time;
best fit packs what remains.  Documents then take their places by their rank among
those of equal size, counted in salted groups.  Full parts of documents beyond the
capacity fill a container each and are only numbered.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import bounded, written

#: Documents of a size are ranked in this many groups at least, and in more if one would have over GROUP documents.
SALTS, GROUP = 64, 500_000
#: Windows (parameters, not data) that documents are packed for at once.
MAX_WINDOWS = 1000
OUTPUT = "window_name string, capacity bigint, container_id bigint, doc_id bigint, part bigint, start_token bigint, n_tokens bigint"


class _Stock:
    """How many items of each size are left, sizes in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def largest_upto(self, room: int) -> int | None:
        i = bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else None

    def smallest(self, n: int) -> list[int]:
        """The n smallest items, repeated sizes repeated."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(self.count[s], n - len(out))
            if len(out) == n:
                break
        return out


def _fixed_set(stock: _Stock, size: int, capacity: int) -> tuple[int, ...] | None:
    """The sizes that dominate every other company of an item of ``size`` in a container; None if nothing is sure."""
    stock.take(size, 1)
    try:
        room = capacity - size
        low = stock.smallest(3)
        most, used = 0, 0
        for s in low:
            used += s
            if used > room:
                break
            most += 1
        if most == 0:
            return ()
        mate = stock.largest_upto(room)
        if most == 1 or mate == room:
            return (mate,)
        if most != 2:
            return None
        best: tuple[int, int] | None = None
        for a in reversed(stock.sizes[: bisect_right(stock.sizes, room)]):
            b = stock.largest_upto(min(room - a, a))
            if b == a and stock.count[a] < 2:
                i = bisect_left(stock.sizes, a)
                b = stock.sizes[i - 1] if i else None
            if b is not None and (best is None or a + b > best[0] + best[1]):
                best = (a, b)
        if best is None or mate >= best[0] + best[1]:
            return (mate,)
        a, b = best
        if a == mate:
            # no two items lie between a and b, or the two next larger than b don't fit
            i, j = bisect_left(stock.sizes, b), bisect_left(stock.sizes, a)
            between = sum(stock.count[s] for s in stock.sizes[i + 1 : j]) if j > i else 0
            larger = [s for x in stock.sizes[i + 1 : i + 3] for s in [x] * min(2, stock.count[x])][:2]
            if between <= 1 or len(larger) == 2 and sum(larger) > room:
                return (a, b)
        return None
    finally:
        if size in stock.count:
            stock.count[size] += 1
        else:
            stock.count[size] = 1
            insort(stock.sizes, size)


def pack_sizes(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Places (size, items, first container, items in each container) for ``counts`` of sizes from 1 to capacity.

    A place of n items with c in each fills ceil(n / c) containers from the first on; only the
    last may have fewer than c.
    """
    stock, places, used = _Stock(counts), [], 0
    # 1. dominance: sets that can be fixed, the same one for as many containers as its sizes last
    for size in sorted(counts, reverse=True):
        while size in stock.count:
            mates = _fixed_set(stock, size, capacity)
            if mates is None:
                break
            need: dict[int, int] = {}
            for s in (size, *mates):
                need[s] = need.get(s, 0) + 1
            times = min(stock.count[s] // k for s, k in need.items())
            for s, k in need.items():
                places.append((s, times * k, used, k))
                stock.take(s, times * k)
            used += times
    # 2. best fit, the larger first; containers of equal room are kept as runs (first, number)
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for size in reversed(list(stock.sizes)):
        left = stock.count[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                n = -(-left // each)
                runs.setdefault(capacity, []).append((used, n))
                insort(rooms, capacity)
                used += n
                continue
            room = rooms[i]
            first, n = runs[room].pop()
            if not runs[room]:
                del runs[room], rooms[i]
            each = room // size
            whole = min(n, left // each)
            if whole:
                places.append((size, whole * each, first, each))
                keep(room - each * size, first, whole)
                left -= whole * each
            if whole < n and left:
                # the last items don't fill what one container could take; here left < each
                places.append((size, left, first + whole, left))
                keep(room - left * size, first + whole, 1)
                left, whole = 0, whole + 1
            keep(room, first + whole, n - whole)
    return places


def _solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    name, capacity = key
    rows, start = [], {}
    for size, n, first, each in pack_sizes(dict(zip(pdf["size"].tolist(), pdf["n"].tolist())), int(capacity)):
        begin = start.get(size, 0)
        rows.append((name, capacity, size, begin, begin + n, first, each))
        start[size] = begin + n
    return pd.DataFrame(rows, columns=["window_name", "capacity", "size", "rank_from", "rank_to", "first", "each"])


PLACES = "window_name string, capacity bigint, size bigint, rank_from bigint, rank_to bigint, first bigint, each bigint"


def cut(sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, capacity, doc_id, n_full, size): per window, the full parts that a document is cut into and what is left.

    size is null where full parts leave nothing, and 0 for an empty document.
    """
    usable = windows.where("capacity > 0 and window_name is not null").select("window_name", F.col("capacity").cast("bigint").alias("capacity")).distinct()
    both = sizes.crossJoin(bounded(usable, MAX_WINDOWS, "windows"))
    rest = F.col("n_tokens") % F.col("capacity")
    return both.select("window_name", "capacity", "doc_id", F.floor(F.col("n_tokens") / F.col("capacity")).alias("n_full"), F.when((rest > 0) | (F.col("n_tokens") <= 0), rest).alias("size"))


def pack_documents(sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """``OUTPUT``: every document of ``sizes`` (doc_id, n_tokens) in containers of each of ``windows`` (window_name, capacity).

    A document is split only if it is larger than the capacity: into full parts, which have a container
    each, and a rest.  Documents of size 0 go to the containers in turn (container 0 if there are no
    others); a null size counts as 0.  Windows without a name or a positive capacity are left out,
    repeated windows count once; repeated doc_ids are items of their own.  ``sizes`` is read several
    times, so it should be written before; groups and places of sizes are written when this is called.
    """
    w = ["window_name", "capacity"]
    salts = max(SALTS, sizes.count() // GROUP)
    known = sizes.select("doc_id", F.greatest(F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint")).alias("n_tokens"))
    items = cut(known, windows).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    rests, whole = items.where("size is not null"), items.where("n_full > 0")
    start = lambda part: (part * F.col("capacity")).alias("start_token")

    # where every group's ranks begin, and the places that they meet
    groups = written(rests.groupBy(*w, "size", "salt").agg(F.count(F.lit(1)).alias("n")))
    before = lambda *by: Window.partitionBy(*by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("offset", F.coalesce(F.sum("n").over(before(*w, "size")), F.lit(0)))
    histogram = groups.where("size > 0").groupBy(*w, "size").agg(F.sum("n").alias("n"))
    places = written(histogram.groupBy(*w).applyInPandas(_solve, PLACES))
    g, p = offsets.alias("g"), places.alias("p")
    meets = [F.col(f"g.{c}") == F.col(f"p.{c}") for c in (*w, "size")] + [F.col("p.rank_from") < F.col("g.offset") + F.col("g.n"), F.col("g.offset") < F.col("p.rank_to")]
    located = g.join(p, meets, "left").groupBy(*[F.col(f"g.{c}").alias(c) for c in (*w, "size", "salt")], "g.offset").agg(F.array_sort(F.collect_list(F.struct("p.rank_from", "p.first", "p.each"))).alias("places"))

    # containers of the packing and of full parts, as many rows as windows
    packed = places.groupBy(*w).agg(F.max(F.col("first") + F.ceil((F.col("rank_to") - F.col("rank_from")) / F.col("each"))).alias("n_packed"))
    full = whole.groupBy(*w, "salt").agg(F.sum("n_full").alias("n"))
    starts = full.withColumn("before", F.coalesce(F.sum("n").over(before(*w)), F.lit(0)))
    zero = F.lit(0).cast("bigint")
    totals = packed.join(full.groupBy(*w).agg(F.sum("n").alias("n_whole")), w, "full").select(*w, F.coalesce("n_packed", zero).alias("n_packed"), F.coalesce("n_whole", zero).alias("n_whole"))

    within = Window.partitionBy(*w, "size", "salt").orderBy("doc_id", "n_full")
    ranked = rests.withColumn("nth", F.row_number().over(within) - 1).join(located, [*w, "size", "salt"]).withColumn("rank", F.col("nth") + F.col("offset"))
    place = F.element_at(F.filter("places", lambda x: x["rank_from"] <= F.col("rank")), -1)
    found = ranked.where("size > 0").withColumn("place", place).withColumn("container_id", F.col("place.first") + F.floor((F.col("rank") - F.col("place.rank_from")) / F.col("place.each")))
    empty = ranked.where("size = 0").join(F.broadcast(totals), w, "left").withColumn("container_id", F.coalesce(F.pmod("rank", F.nullif(F.col("n_packed") + F.col("n_whole"), F.lit(0))), zero))

    ahead = Window.partitionBy(*w, "salt").orderBy("doc_id", "n_full").rowsBetween(Window.unboundedPreceding, -1)
    numbered = whole.withColumn("ahead", F.coalesce(F.sum("n_full").over(ahead), F.lit(0))).join(starts, [*w, "salt"]).join(F.broadcast(totals), w)
    parts = numbered.select("*", F.explode(F.sequence(zero, F.col("n_full") - 1)).alias("part")).withColumn("container_id", F.col("n_packed") + F.col("before") + F.col("ahead") + F.col("part"))

    out = lambda df, part, size: df.select(*w, F.col("container_id").cast("bigint").alias("container_id"), "doc_id", part.alias("part"), start(part), size.cast("bigint").alias("n_tokens"))
    return out(found, F.col("n_full"), F.col("size")).unionByName(out(empty, F.col("n_full"), F.col("size"))).unionByName(out(parts, F.col("part"), F.col("capacity")))


def fill_report(packed: DataFrame) -> DataFrame:
    """Per window: containers, the least that the tokens need, tokens, unused space and its share in parts per million."""
    each = packed.groupBy("window_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("used"))
    return (
        each.groupBy("window_name", "capacity")
        .agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
        .withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity")).cast("bigint"))
        .withColumn("unused", F.col("n_containers") * F.col("capacity") - F.col("n_tokens"))
        .withColumn("unused_ppm", F.floor(F.col("unused") * 1e6 / (F.col("n_containers") * F.col("capacity"))).cast("bigint"))
    )
