"""Problem 1: source files that do not parse.

Every file's tokens are read by memoised derivatives of its language's grammar
(see ``derivative``): an empty derivative marks the failing token, a derivative
that isn't nullable at the end means the file was cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "file_id bigint, parses boolean, truncated boolean, fail_line int, fail_token string"
#: Extension -> name of its language.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "c": "c"}


def extension(path: Column) -> Column:
    """The lower-case extension of a path, '' without one."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    """The language of a path's extension, null for others."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, F.lit(name)).otherwise(out)
    return out


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .languages import verdict

    for b in batches:
        out = [verdict(ext, body) for ext, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.record_batch(
            [b.column(0), pa.array([v.ok for v in out], pa.bool_()), pa.array([v.truncated for v in out], pa.bool_()),
             pa.array([v.line for v in out], pa.int32()), pa.array([v.token for v in out], pa.string())],
            names=["file_id", "parses", "truncated", "fail_line", "fail_token"],
        )


def check_syntax(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` (file_id, rel_path, body; other columns play no part): ``SCHEMA``.

    A null or empty body parses, and so does a file whose extension names no known language.
    Repeated file_ids are checked each; no rows give no rows.  Bodies are read whole.
    """
    return files.select(F.col("file_id").cast("bigint").alias("file_id"), extension(F.col("rel_path")).alias("ext"), F.col("body").cast("string").alias("body")).mapInArrow(_check, SCHEMA)


def unparseable(files: DataFrame) -> DataFrame:
    """The files that don't parse, with the place of failure."""
    return check_syntax(files).where(~F.col("parses")).drop("parses")


def syntax_rates(files: DataFrame) -> DataFrame:
    """Files, unparseable files, truncated files and the rate per repo and language of the extension.

    A null repo or unknown language is a group of its own.
    """
    marked = files.select("file_id", "repo", "rel_path", "body")
    checked = marked.select(
        F.struct(F.col("repo"), language_of(F.col("rel_path")).alias("language")).alias("g"), extension(F.col("rel_path")).alias("ext"), F.col("body").cast("string").alias("body")
    ).mapInArrow(_check_grouped, "repo string, language string, parses boolean, truncated boolean")
    return (
        checked.groupBy("repo", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("parses")).alias("n_unparseable"), F.count_if("truncated").alias("n_truncated"))
        .withColumn("rate", F.round(F.col("n_unparseable") * 1e6 / F.col("n_files")) / 1e6)
    )


def _check_grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    for b in batches:
        groups = b.column(0)
        for c in _check(iter([pa.record_batch([pa.nulls(b.num_rows, pa.int64()), b.column(1), b.column(2)], names=["a", "b", "c"])])):
            yield pa.record_batch([pc.struct_field(groups, 0), pc.struct_field(groups, 1), c.column(1), c.column(2)], names=["repo", "language", "parses", "truncated"])
