"""Scanning: which files there are, of what type, and what changed."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from .incremental import VersionedTable
from ..functions.text import basename, byte_prefix, file_extension, word_count


def paper_signals(text: Column) -> Column:
    """How many of the signals of a paper the first 3000 bytes hold, but for a character that they cut; 0 for null."""
    head = byte_prefix(text, X.PAPER_SCAN_BYTES)
    terms = [head.rlike("(?U)" + p).cast("bigint") for p in X.PAPER_SIGNALS]
    return F.coalesce(sum(terms[1:], terms[0]), F.lit(0).cast("bigint"))


def file_type(path: Column, text: Column | None = None) -> Column:
    """Type by the last extension; text files with enough signals are papers; null for unknown ones."""
    ext = file_extension(basename(path))
    out = F.when(ext.isin(*X.PAPER_EXTENSIONS), "paper").when(ext.isin(*X.IMAGE_EXTENSIONS), "image").when(ext.isin(*X.VIDEO_EXTENSIONS), "video").when(ext.isin(*X.CODE_EXTENSIONS), "code")
    if text is not None:
        out = out.when(ext.isin(*X.TEXT_EXTENSIONS) & (paper_signals(text) >= X.PAPER_SIGNAL_COUNT), "paper")
    return out.when(ext.isin(*X.DOC_EXTENSIONS), "document")


def is_sensitive(path: Column) -> Column:
    """Names of environment files, keys and whatever may hold a secret."""
    name = F.lower(basename(path))
    out = name.isin(*X.SENSITIVE_NAMES)
    for s in X.SENSITIVE_SUFFIXES:
        out = out | name.endswith(s)
    return out | name.rlike("|".join(X.SENSITIVE_WORDS))


def in_skipped_dir(path: Column, output_dir: str = "graph-out") -> Column:
    """A hidden folder or one of caches, builds and environments on the way."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(parts, lambda p: p.isin(*X.SKIPPED_DIRS, output_dir) | (p.startswith(".") & ~p.isin(".", "..")))


class IgnoreRules:
    """Patterns of ignore files: '!' takes back, an inner slash anchors, the last match decides.

    Compiled once to regular expressions; ``column`` folds them over paths inside the JVM.
    """

    def __init__(self, lines: list[str] = ()):
        self.rules: list[tuple[bool, str]] = []
        for line in lines:
            self.add(line)

    def add(self, line: str) -> None:
        line = line.rstrip()
        if not line or line.startswith("#"):
            return
        keep, line = line.startswith("!"), line.removeprefix("!")
        line = line.rstrip("/")
        anchored = "/" in line
        pattern = line.lstrip("/")
        if not pattern:
            return
        glob = "".join(_glob(pattern))
        self.rules.append((keep, ("^" if anchored else "^(?:.*/)?") + glob + "(?:/.*)?$"))

    def ignored(self, path: str) -> bool:
        out = False
        for keep, rx in self.rules:
            if re.search(rx, path):
                out = not keep
        return out

    def column(self, path: Column) -> Column:
        out = F.lit(False)
        for keep, rx in self.rules:
            out = F.when(path.rlike(rx), F.lit(not keep)).otherwise(out)
        return out


def _glob(pattern: str):
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            yield "(?:.*/)?"
            i += 3
        elif c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            yield ".*"
            i += 1
        elif c == "?":
            yield "."
            i += 1
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : j]
            yield "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]"
            i = j + 1
        else:
            yield re.escape(c)
            i += 1


def ignore_rules(root: str, ignore_file: str = ".graphignore") -> IgnoreRules:
    """Rules of the ignore files from the nearest repository root down to ``root``, outer ones first."""
    here = Path(root).resolve()
    top = next((p for p in [here, *here.parents] if any((p / v).exists() for v in (".git", ".hg", ".svn"))), here)
    chain = [p for p in reversed([here, *here.parents]) if p == top or top in p.parents]
    rules = IgnoreRules()
    for p in chain:
        if (p / ignore_file).is_file():
            for line in (p / ignore_file).read_text(errors="replace").splitlines():
                rules.add(line)
    return rules


def scan_folder(spark: SparkSession, root: str, follow_symlinks: bool = False, output_dir: str = "graph-out", ignore_file: str = ".graphignore", extensions: tuple[str, ...] | None = None, prune: bool = True) -> DataFrame:
    """(path, rel_path, file_type, sensitive): files below a folder that driver and executors see, in order of their paths.

    Folders are pruned before they are entered (only hidden ones without ``prune``); contents aren't read.
    A folder that links lead to again, within itself or twice, is entered once.
    """
    rules, rows, base = ignore_rules(root, ignore_file) if ignore_file else IgnoreRules(), [], Path(root).resolve()
    entered = {os.path.realpath(base)}
    for folder, dirs, files in os.walk(base, followlinks=follow_symlinks):
        rel = os.path.relpath(folder, base)
        at = "" if rel == "." else rel + "/"
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and (not prune or d not in X.SKIPPED_DIRS and d != output_dir and not rules.ignored(at + d)))
        if follow_symlinks:
            real = {d: os.path.realpath(os.path.join(folder, d)) for d in dirs}
            dirs[:] = [d for d in dirs if real[d] not in entered and not entered.add(real[d])]
        for f in sorted(files):
            secret = f.lower() in X.SENSITIVE_NAMES or f.lower().endswith(X.SENSITIVE_SUFFIXES) or any(w in f.lower() for w in X.SENSITIVE_WORDS)
            if not secret and (f.startswith(".") or f in X.LOCK_FILES or rules.ignored(at + f)):
                continue
            if extensions is None or f.rsplit(".", 1)[-1].lower() in extensions:
                rows.append((os.path.join(folder, f), at + f, secret))
    df = spark.createDataFrame(rows, "path string, rel_path string, sensitive boolean")
    return df.select("path", "rel_path", file_type(F.col("rel_path")).alias("file_type"), "sensitive")


def read_contents(files: DataFrame) -> DataFrame:
    """``files`` (path) with content (binary), read where the tasks run; null for what can't be read."""

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                try:
                    out.append(Path(p).read_bytes())
                except OSError:
                    out.append(None)
            yield pdf.assign(content=out)

    schema = ", ".join(f"{c} {t}" for c, t in files.dtypes) + ", content binary"
    return files.mapInPandas(run, schema)


def detect(spark: SparkSession, root: str, **options) -> DataFrame:
    """(path, rel_path, file_type, n_words, hash, sensitive) of the classified files below ``root``."""
    found = scan_folder(spark, root, **options)
    text = F.decode(F.col("content"), "UTF-8")
    read = read_contents(found.where("not sensitive"))
    kind = file_type(F.col("rel_path"), text)
    words = F.when(kind.isin("code", "document", "paper"), word_count(text)).otherwise(F.lit(0))
    good = read.select("path", "rel_path", kind.alias("file_type"), words.cast("bigint").alias("n_words"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("hash"), "sensitive")
    secret = found.where("sensitive").select("path", "rel_path", F.lit(None).cast("string").alias("file_type"), F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast("string").alias("hash"), "sensitive")
    return good.where("file_type is not null").unionByName(secret)


def detection_summary(files: DataFrame) -> DataFrame:
    """One row: files per type, words, sensitive files, whether a graph is needed and whether the corpus is large."""
    kinds = [F.count_if((F.col("file_type") == k) & ~F.col("sensitive")).alias("n_" + k) for k in ("code", "document", "paper", "image", "video")]
    out = files.agg(*kinds, F.coalesce(F.sum("n_words"), F.lit(0)).alias("total_words"), F.count_if("sensitive").alias("n_sensitive"), F.count_if(~F.col("sensitive")).alias("total_files"))
    return out.withColumns({"needs_graph": F.col("total_files") > 0, "large": F.col("total_words") > X.CORPUS_WARNING_WORDS})


def manifest_status(scan: DataFrame, manifest: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., rel_path, status, file_type): 'new', 'changed', 'unchanged' or 'deleted' of scan against manifest (by..., rel_path, hash, file_type).

    ``by`` names columns, such as the run, that a scan is compared within.  An unchanged file keeps the
    manifest's type.
    """
    keys = [*by, "rel_path"]
    a, b = scan.select(*keys, F.col("hash").alias("_h"), F.col("file_type").alias("_t")), manifest.select(*keys, F.col("hash").alias("_mh"), F.col("file_type").alias("_mt"), F.lit(True).alias("_m"))
    j = a.withColumn("_s", F.lit(True)).join(b, keys, "full_outer")
    status = F.when(F.col("_s").isNull(), "deleted").when(F.col("_m").isNull(), "new").when(F.col("_h") == F.col("_mh"), "unchanged").otherwise("changed")
    return j.select(*keys, status.alias("status"), F.when(status.isin("unchanged", "deleted"), F.col("_mt")).otherwise(F.col("_t")).alias("file_type"))


MANIFEST = "rel_path string, file_type string, hash string"


def save_manifest(files: DataFrame, path: str) -> int:
    """Saves (rel_path, file_type, hash) of ``detect`` as the manifest's next version; the version.

    The manifest is a ``VersionedTable``: the new rows and the removal of the old ones are one commit.
    """
    log = VersionedTable(files.sparkSession, path)
    rows = files.where(F.col("file_type").isNotNull()).select(*[F.col(c.split()[0]) for c in MANIFEST.split(", ")])
    return log.commit(add=rows, remove=list(log.manifest(log.latest())["files"]))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(rel_path, file_type, hash) as last saved, no rows if there is no manifest."""
    log = VersionedTable(spark, path)
    return log.read() if log.latest() else spark.createDataFrame([], MANIFEST)


def detect_incremental(spark: SparkSession, root: str, manifest_path: str, **options) -> DataFrame:
    """(rel_path, status, file_type) of the files below ``root`` against the manifest saved last, which stays as it is.

    A file that can't be read has an empty hash and is never unchanged.
    """
    found = detect(spark, root, **options).where(F.col("file_type").isNotNull()).withColumn("hash", F.nullif("hash", F.lit("")))
    return manifest_status(found, load_manifest(spark, manifest_path))


def collect_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = X.CODE_EXTENSIONS, follow_symlinks: bool = False) -> DataFrame:
    """(path, rel_path) of the files below ``root`` with one of the extensions: hidden names are left out, no ignore file counts."""
    return scan_folder(spark, root, follow_symlinks, ignore_file="", extensions=extensions, prune=False).select("path", "rel_path")
