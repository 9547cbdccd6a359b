"""Small text files on any Hadoop file system; a path without a scheme is the default file system's."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder; False if there was none."""
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it doesn't exist."""
    fs, p = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text, None without it."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file aside and puts it in the place of an old one."""
    fs, p = _at(spark, path)
    _, aside = _at(spark, f"{path}.{uuid4()}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(aside, p)
