"""Watching folders and event streams: debounced sessions, late data, incremental results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fixed import CODE_EXTENSIONS
from ..functions.text import file_extension
from ..operators.incremental import VersionedTable

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def debounced(events: DataFrame, time: str, by: list[str], gap: str = "3 seconds", watermark: str | None = None) -> DataFrame:
    """(by..., begin, end, n): bursts of events that are no further apart than ``gap``.

    The same function serves tables and streams; a stream needs a watermark, beyond which late events
    are left out and a burst is final.
    """
    e = events.withWatermark(time, watermark) if watermark else events
    w = F.session_window(time, gap)
    return e.groupBy(*by, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, time: str, by: list[str], size: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(by..., begin, n) in tumbling or sliding windows."""
    e = events.withWatermark(time, watermark) if watermark else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return e.groupBy(*by, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("begin"), "n")


def joined_within(later: DataFrame, earlier: DataFrame, keys: list[str], time: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Rows of ``later`` with each row of ``earlier`` of the same keys, not null, that came at most ``gap`` before; its time is ``earlier_<time>``.

    Tables and streams alike; two streams need a watermark, which lets the join forget what can't meet any more.
    """
    then = f"earlier_{time}"
    a, b = later, earlier.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(time).alias(then))
    if watermark:
        a, b = a.withWatermark(time, watermark), b.withWatermark(then, watermark)
    on = (F.col(then) <= F.col(time)) & (F.col(then) >= F.col(time) - F.expr(f"interval {gap}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, on).drop(*[f"_{k}" for k in keys])


def without_repeats(events: DataFrame, keys: list[str], time: str, watermark: str = "1 hour") -> DataFrame:
    """A stream's events once per key, as far as repeats come within the watermark."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def has_non_code(files: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """(by..., has_non_code): whether a batch holds other than code, which needs more than extraction."""
    other = ~file_extension(F.col(path)).isin(*CODE_EXTENSIONS)
    return files.groupBy(*by).agg(F.coalesce(F.bool_or(other), F.lit(False)).alias("has_non_code"))


def watch_files(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """Calls ``handle`` with each batch of new or touched files below ``folder``; ``checkpoint`` is a shared folder.

    The source remembers what it has seen there, so a restart neither skips nor repeats a batch.
    """
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    out = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


def append_once(sink: VersionedTable) -> Callable[[DataFrame, int], None]:
    """A batch handler that commits each batch exactly once: the batch number is saved in the output's commit."""

    def handle(batch: DataFrame, number: int) -> None:
        done = int(sink.manifest(sink.latest())["info"].get("batch", -1))
        if number > done:
            sink.commit(add=batch, info={"batch": number})

    return handle


def degree_updates(degrees: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) after the edges (src, tgt) of a batch that the graph didn't hold before."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "tgt"))).alias("id"))
    return degrees.unionByName(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))).groupBy("id").agg(F.sum("degree").alias("degree"))
