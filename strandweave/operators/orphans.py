"""Problem 4: references to records that do not exist.

Distinct non-null foreign keys are anti-joined with the parents' keys: those left never
existed, or no lifetime of theirs covers all references.  These keys are joined back to
the references, of which the rest are passed over by a mark of a fixed size and aren't
shuffled again.  Keys that hold a large part of all references are salted for that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, normalize_id
from ..sources.session import written

_END = "timestamp_micros(9223372036854775807)"


def lifetimes(parents: DataFrame, key: Column) -> DataFrame:
    """(key, spans): the disjoint spans [added_at, deleted_at) in which a record of the key was alive, none for a null key.

    Rows without added_at never lived; a key of only such rows has an empty array.  Spans are merged
    within a month first and then over all, so that a key with many rows is not one task's work.
    """
    end = F.coalesce(F.col("deleted_at"), F.expr(_END))
    alive = F.col("added_at").isNotNull() & (end > F.col("added_at"))
    rows = parents.select(key.alias("key"), F.when(alive, F.col("added_at")).alias("begin"), F.when(alive, end).alias("end")).where("key is not null")
    once = rows.groupBy("key", "begin").agg(F.max("end").alias("end"))
    merged = _merge(_merge(once.withColumn("month", F.trunc("begin", "month")), "key", "month").drop("month"), "key")
    return merged.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("begin").isNotNull(), F.struct("begin", "end")))).alias("spans"))


def _merge(spans: DataFrame, *by: str) -> DataFrame:
    """Unions of overlapping or touching spans within ``by``."""
    before = Window.partitionBy(*by).orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("begin").rowsBetween(Window.unboundedPreceding, 0)
    marked = spans.withColumn("new", F.coalesce((F.max("end").over(before) < F.col("begin")).cast("int"), F.lit(1)))
    return marked.withColumn("island", F.sum("new").over(upto)).groupBy(*by, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island")


def references(edges: DataFrame) -> DataFrame:
    """(ord, endpoint, key, seen_at): the endpoints of ``edges`` that are not null or blank, by their ids' runs of letters and digits."""
    ends = F.array(*[F.struct(F.lit(c).alias("endpoint"), F.col(c).cast("string").alias("id")) for c in ("source", "target")])
    return edges.select("ord", "seen_at", F.inline(ends)).where(F.col("id").isNotNull() & ~is_blank(F.col("id"))).select("ord", "endpoint", normalize_id(F.col("id")).alias("key"), "seen_at")


#: A key that holds more than one reference in so many is hot (there are fewer such keys than that) and is split into SALTS.
HOT_ONE_IN, SALTS = 1000, 64


def suspect_keys(refs: DataFrame, parents: DataFrame, key: Column) -> DataFrame:
    """(key, n, spans): the distinct keys of ``refs`` that may have orphans, with the number of their references.

    They are the left anti-join of all keys with the parents one of whose lifetimes holds all references of
    the key, from the first seen_at to the last.  spans is null for keys that no parent ever had.
    """
    keys = refs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count("seen_at").alias("n_seen"), F.min("seen_at").alias("first"), F.max("seen_at").alias("last"))
    known = lifetimes(parents.where(F.col("id").isNotNull()), key)
    k, p = keys.alias("k"), known.alias("p")
    covered = (F.col("k.n") == F.col("k.n_seen")) & F.exists("p.spans", lambda s: (s["begin"] <= F.col("k.first")) & (F.col("k.last") < s["end"]))
    return k.join(p, (F.col("k.key") == F.col("p.key")) & covered, "left_anti").select("key", "n").join(known, "key", "left")


#: Bits of the mark that most references of other keys are told by; a broadcast of this size at most, whatever the data.
MARK_BITS = 1 << 26


def _marked(refs: DataFrame, suspects: DataFrame) -> DataFrame:
    """The rows of ``refs`` whose key's bit is set: all of suspect keys, and by chance some of others."""
    bit = F.pmod(F.xxhash64("key"), F.lit(MARK_BITS))
    # at most MARK_BITS / 32768 rows of 4 KB
    marks = suspects.select(F.shiftright(bit, 15).alias("_page"), bit.bitwiseAND(F.lit(32767)).alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    placed = refs.select("*", F.shiftright(bit, 15).alias("_page"), bit.bitwiseAND(F.lit(32767)).alias("_bit")).join(F.broadcast(marks), "_page")
    byte = F.conv(F.hex(F.substr("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.where(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1).drop("_page", "_bit", "_bits")


def judged_suspects(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ord, endpoint, seen_at, ever) of every reference of ``edges`` to a node that isn't alive at seen_at.

    ever: whether a node of that key was in the table at all.  A null seen_at is in no lifetime, so its
    references are orphans.  Edges delivered twice count each.
    """
    refs = references(edges)
    # written, since it is read three times
    suspects = written(suspect_keys(refs, nodes, normalize_id(F.col("id"))))
    refs = _marked(refs, suspects)
    hot = F.col("n") * HOT_ONE_IN > 2 * edges.count()
    # fewer than HOT_ONE_IN rows
    marked = refs.join(F.broadcast(suspects.where(hot).select("key", F.lit(True).alias("hot"))), "key", "left")
    salted = marked.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("ord", "endpoint"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("hot")
    copies = suspects.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    seen = F.col("seen_at")
    alive = F.coalesce(F.exists("spans", lambda s: (s["begin"] <= seen) & (seen < s["end"])), F.lit(False))
    return salted.join(copies, ["key", "salt"]).where(~alive).select("ord", "endpoint", "seen_at", F.col("spans").isNotNull().alias("ever"))


def orphan_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ord, endpoint) of every reference to a node that isn't alive at seen_at; a table of suspects is written when it is called."""
    return judged_suspects(edges, nodes).select("ord", "endpoint")


def orphan_counts(edges: DataFrame, nodes: DataFrame, table: str = "edges") -> DataFrame:
    """Per table, endpoint and month of seen_at: references, orphans, and those whose key never existed."""
    by = lambda df, *more: df.groupBy("endpoint", F.trunc("seen_at", "month").alias("period")).agg(*more)
    all_ = by(references(edges), F.count(F.lit(1)).alias("n_references"))
    lost = by(judged_suspects(edges, nodes), F.count(F.lit(1)).alias("n_orphans"), F.count_if(~F.col("ever")).alias("n_never_existed")).select(F.col("endpoint").alias("_e"), F.col("period").alias("_p"), "n_orphans", "n_never_existed")
    joined = all_.join(lost, (F.col("endpoint") == F.col("_e")) & F.col("period").eqNullSafe(F.col("_p")), "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(F.lit(table).alias("table_name"), "endpoint", "period", "n_references", F.coalesce("n_orphans", zero).alias("n_orphans"), F.coalesce("n_never_existed", zero).alias("n_never_existed"))
