"""Fragments of many files: extraction where the files lie, merging and call resolution as joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_call
from ..sources.session import checkpoint
from .ingest import file_hash

FRAGMENT = "repo string, source_file string, kind string, place int, id string, label string, target string, relation string, line int, error string"


def extract_fragments(files: DataFrame) -> DataFrame:
    """``FRAGMENT`` rows of files (repo, rel_path, body): kind 'node', 'edge', 'stub' (a call by name) or 'error'.

    One bad file gives an error row beside its own node.  Languages without an extractor and null
    paths give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..extract.symbols import extract_text

        for pdf in batches:
            rows = []
            for repo, path, body in zip(pdf["repo"], pdf["rel_path"], pdf["body"]):
                f = extract_text(path, body) if path else None
                if f is None:
                    continue
                rows += [(repo, path, "node", i, n, label, None, None, line, None) for i, (n, label, line) in enumerate(f.nodes)]
                rows += [(repo, path, "edge", i, s, None, t, r, line, None) for i, (s, t, r, line) in enumerate(f.edges)]
                rows += [(repo, path, "stub", i, s, None, name, "calls", line, None) for i, (s, name, line) in enumerate(f.stubs)]
                if f.error:
                    rows.append((repo, path, "error", 0, f.file_id, None, None, None, None, f.error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FRAGMENT.split(", ")])

    return files.where(F.col("rel_path").isNotNull()).select("repo", "rel_path", "body").mapInPandas(run, FRAGMENT)


def merged_nodes(fragments: DataFrame) -> DataFrame:
    """One node per repo and id: the last file's whole node wins, files in the order of their paths."""
    order = F.struct("source_file", "place")
    n = fragments.where("kind = 'node'").groupBy("repo", "id").agg(F.max_by(F.struct("label", "source_file", F.concat(F.lit("L"), F.col("line").cast("string")).alias("source_location")), order).alias("x"), F.min(order).alias("first"))
    return n.select("repo", "id", "x.*", F.lit("code").alias("file_type"))


def resolve_calls(nodes: DataFrame, stubs: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(source, target, confidence, source_file, line) of calls whose name has exactly one candidate.

    nodes: id, label, source_file; stubs: source, name, source_file, line; ``by`` names columns (such as the
    repository) that both must agree in.  One candidate in other files makes an inferred call, one in
    the same file an extracted one; both may come of a call.  Names are counted before they meet, so a
    name that many nodes share is one row and never a product.
    """
    n = nodes.select(*by, strip_call(F.regexp_replace("label", r"^\.", "")).alias("name"), "id", "source_file").where("name <> ''").distinct()
    per_file = n.groupBy(*by, "name", "source_file").agg(F.count(F.lit(1)).alias("n_here"), F.min("id").alias("id_here"))
    # of all files: how many candidates, and the two files that matter when exactly one lies elsewhere
    overall = per_file.groupBy(*by, "name").agg(F.sum("n_here").alias("n_all"), F.min(F.struct("source_file", "id_here")).alias("a"), F.max(F.struct("source_file", "id_here")).alias("b"))
    s = stubs.join(overall, [*by, "name"]).join(per_file, [*by, "name", "source_file"], "left").withColumn("n_here", F.coalesce("n_here", F.lit(0)))
    elsewhere = F.when(F.col("a.source_file") != F.col("source_file"), F.col("a.id_here")).otherwise(F.col("b.id_here"))
    cross = F.when(F.col("n_all") - F.col("n_here") == 1, F.struct(elsewhere.alias("target"), F.lit("INFERRED").alias("confidence")))
    same = F.when(F.col("n_here") == 1, F.struct(F.col("id_here").alias("target"), F.lit("EXTRACTED").alias("confidence")))
    hit = F.filter(F.array(same, cross), lambda x: x.isNotNull())
    return s.select(*by, "source", "source_file", "line", F.inline(hit)).select(*by, "source", "target", "confidence", "source_file", "line")


def extract_repositories(files: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and edge statements (with ord) of files (repo, rel_path, body): symbols, relations and resolved calls.

    known: nodes (repo, id, label, source_file) of other files, which calls of these may mean too.
    """
    # three things are made of the fragments; files are read and parsed once
    f = checkpoint(extract_fragments(files))
    nodes = merged_nodes(f)
    e = f.where("kind = 'edge'").select("repo", F.col("id").alias("source"), "target", "relation", F.lit("EXTRACTED").alias("confidence"), F.lit(None).cast("string").alias("context"), "source_file", "line")
    stubs = f.where("kind = 'stub'").select("repo", F.col("id").alias("source"), F.col("target").alias("name"), "source_file", "line")
    named = nodes.select("repo", "id", "label", "source_file")
    if known is not None:
        named = named.unionByName(known.select("repo", "id", "label", "source_file").join(files.select(F.col("rel_path").alias("source_file")).distinct(), "source_file", "left_anti"))
    c = resolve_calls(named, stubs, ["repo"]).select("repo", "source", "target", F.lit("calls").alias("relation"), "confidence", F.lit("call").alias("context"), "source_file", "line")
    both = e.unionByName(c).withColumn("source_location", F.concat(F.lit("L"), F.col("line").cast("string"))).withColumn("weight", F.lit(1.0))
    # a place that depends on content only, so that runs agree
    return nodes.withColumn("ord", F.xxhash64("repo", "id")), both.withColumn("ord", F.xxhash64("repo", "source", "target", "relation", "source_file", "line")).drop("line")


def cache_misses(files: DataFrame, cache: DataFrame, kind: str = "ast") -> DataFrame:
    """Files (rel_path, body, ...) whose content hash isn't in the cache (hash, kind)."""
    keyed = files.withColumn("hash", file_hash(F.col("body"), F.col("rel_path")))
    return keyed.join(cache.where(F.col("kind") == kind).select("hash").distinct(), "hash", "left_anti")


def cache_hits(files: DataFrame, cache: DataFrame, kind: str = "ast") -> DataFrame:
    """Cached fragments of the files (rel_path, body) that the cache (hash, kind, fragment) knows."""
    keyed = files.select("rel_path", file_hash(F.col("body"), F.col("rel_path")).alias("hash"))
    return keyed.join(cache.where(F.col("kind") == kind), "hash").select("rel_path", "hash", "fragment")


def save_cache(fragments: DataFrame, path: str) -> None:
    """Adds fragments (hash, kind, fragment) to the cache; the writer's commit makes them appear at once."""
    fragments.write.mode("append").partitionBy("kind").parquet(path)


def cached_files(spark: SparkSession, path: str) -> DataFrame:
    """(hash, kind) of everything in the cache, once each; no rows without a cache."""
    try:
        return spark.read.parquet(path).select("hash", F.col("kind").cast("string").alias("kind")).distinct()
    except AnalysisException:
        return spark.createDataFrame([], "hash string, kind string")


def clear_cache(spark: SparkSession, path: str, kind: str | None = None) -> bool:
    """Removes the cache, or one kind of it; False if there was nothing."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path if kind is None else f"{path}/kind={kind}")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
