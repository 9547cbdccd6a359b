"""Ranks and places without one task that orders all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of an order in which rows are counted before they are placed.
RANGES = 1024


def rank_by_count(groups: DataFrame, tie: str) -> DataFrame:
    """``groups`` (n, ...) with rank, from 0: by n from the largest down, then by ``tie``.

    Groups are counted per n first, and only those of equal n are ordered.
    """
    per_size = groups.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    before = per_size.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = groups.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(tie)))
    return within.join(before.select("n", "before"), "n").withColumn("rank", (F.col("before") + F.col("r") - 1).cast("bigint")).drop("before", "r")


def placed(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``rows`` with place, from 0 within ``by`` in the order of the whole number ``order``.

    Rows are counted in RANGES of the order, whose ends are found first; only those of a range are ordered.
    A null in ``by`` is no group, so that such rows are left out.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    low, width = low or 0, max(1, ((high or 0) - (low or 0)) // RANGES + 1)
    ranged = rows.withColumn("_range", F.floor((F.col(order) - F.lit(low)) / F.lit(width)))
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order)) - 1
    return ranged.withColumn("_nth", nth).join(counts.select(*by, "_range", ahead.alias("_ahead")), [*by, "_range"]).withColumn("place", (F.col("_nth") + F.col("_ahead")).cast("bigint")).drop("_range", "_nth", "_ahead")
