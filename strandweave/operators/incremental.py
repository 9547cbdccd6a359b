"""Problem 2: processing only what is new or changed.

``VersionedTable`` is a folder of immutable data files and version manifests: every
version lists its files and, per file, the vectors of deleted rows that concern it.
The difference of two manifests is the change between them, found without reading
files that both hold alike.  ``process_changes`` applies a function to the change
since the last success and saves the processed version in the very commit that
publishes the output, so a failure at any point neither skips nor repeats a record.

``pending_entries`` is the same over run logs: every successful run commits its records
as a version, and each scan is held against the version that the runs before it left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import digest, forward_path
from ..sources.session import checkpoint_dir


#: File systems whose rename may replace or copy, so that a manifest is created in one request instead.
OBJECT_STORES = ("s3", "s3a", "gs", "oss", "cosn", "wasb", "wasbs")
#: A data file's folder below the table.
_FOLDER = r"(data-[^/]+(?:/_by=[^/]+)?)/[^/]+$"
_PLACE = ["_folder", "_file", "_row"]


class VersionedTable:
    """A table whose versions are immutable manifests in ``path``/_versions, on any Hadoop file system.

    A manifest is {'files': {folder: [deletion vectors]}, 'info': {...}}.  A vector is a folder of
    (_folder, _file, _row); only the folders whose rows it names list it.  ``info`` is kept from
    version to version; a commit replaces the keys that it gives.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _names(self, *parts: str) -> list[str]:
        folder = self._p(*parts)
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def latest(self) -> int:
        """The latest version, 0 for a table without any."""
        return max((int(n[:-5]) for n in self._names("_versions") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        """{'files': {folder: [deletion vectors]}, 'info': {...}} of a version; version 0 is empty."""
        if version == 0:
            return {"files": {}, "info": {}}
        stream = self._fs.open(self._p("_versions", f"{version:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        """Creates a version's manifest whole or not at all; fails if another writer took the version.

        A local file is written aside and linked, an object is created by one conditional request, and
        elsewhere (HDFS) a file is written aside and renamed: each refuses an existing name by itself.
        """
        fs, target = self._fs, self._p("_versions", f"{version:020d}.json")
        fs.mkdirs(self._p("_versions"))
        scheme = fs.getUri().getScheme()
        aside = target if scheme in OBJECT_STORES else self._p("_versions", f".{version:020d}.{self._token()}")
        try:
            out = fs.create(aside, False)
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
            out.close()
            if scheme == "file":
                local = lambda p: self._jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
                try:
                    self._jvm.java.nio.file.Files.createLink(local(target), local(aside))
                except Py4JJavaError as e:
                    if "AlreadyExists" in str(e.java_exception):
                        raise
                    # a file system without links: moving refuses an existing name, if not in one step
                    self._jvm.java.nio.file.Files.move(local(aside), local(target), self.spark.sparkContext._gateway.new_array(self._jvm.java.nio.file.CopyOption, 0))
                done = True
            else:
                done = aside is target or fs.rename(aside, target)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            done = False
        finally:
            if aside is not target:
                fs.delete(aside, False)
        if not done:
            raise RuntimeError(f"version {version} of {self.path} was committed by another writer")

    def _token(self) -> str:
        return str(self._jvm.java.util.UUID.randomUUID())[:13]

    def commit(self, add: DataFrame | None = None, remove: list[str] = (), delete_where: str | None = None, info: dict | None = None) -> int:
        """The next version: ``add``'s rows as new files, folders of ``remove`` dropped, rows that match ``delete_where`` deleted."""
        base = self.latest()
        old = self.manifest(base)
        files = {k: v for k, v in old["files"].items() if k not in set(remove)}
        token = f"{base + 1:08d}-{self._token()}"
        if delete_where is not None and files:
            vector = f"_deleted/{token}"
            self._positions(files).where(delete_where).select(*_PLACE).write.parquet(f"{self.path}/{vector}")
            # as many rows as there are folders
            hit = {r[0] for r in self.spark.read.parquet(f"{self.path}/{vector}").select("_folder").distinct().collect()}
            files = {k: [*v, vector] if k in hit else v for k, v in files.items()}
        if add is not None:
            add.write.parquet(f"{self.path}/data-{token}")
            files[f"data-{token}"] = []
        self._publish(base + 1, {"files": files, "info": {**old["info"], **(info or {})}})
        return base + 1

    def commit_each(self, rows: DataFrame, by: str, keys: list[str]) -> dict[int, int]:
        """One version per value of ``by`` (a whole number), in order; {value: version}.

        A row deletes the row with the same ``keys`` that a smaller value left, by a deletion vector of
        its version; keys are unique within a value.  All files and vectors are written by two jobs, so
        many versions cost no more than one; only manifests are published one by one.
        """
        base = self.latest()
        old = self.manifest(base)
        token = f"{base + 1:08d}-{self._token()}"
        rows.withColumn("_by", F.col(by)).write.partitionBy("_by").parquet(f"{self.path}/data-{token}")
        values = sorted(int(n[4:]) for n in self._names(f"data-{token}") if n.startswith("_by="))
        folders = {v: f"data-{token}/_by={v}" for v in values}
        vector = f"_deleted/{token}"
        hits: dict[int, list[str]] = {}
        if values:
            fresh = self._read_places([*folders.values()]).select(*keys, F.col(by).alias("_at"), *_PLACE)
            # a key has at most as many rows as there are values
            nxt = F.lead("_at").over(Window.partitionBy(*keys).orderBy("_at"))
            dead = fresh.withColumn("_by", nxt).where("_by is not null").select(*_PLACE, "_by")
            if old["files"]:
                first = fresh.groupBy(*keys).agg(F.min("_at").alias("_by"))
                f, o = first.alias("f"), self._positions(old["files"]).alias("o")
                on = [F.col(f"f.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
                dead = dead.unionByName(o.join(f, on).select(*[f"o.{c}" for c in _PLACE], "f._by"))
            dead.write.partitionBy("_by").parquet(f"{self.path}/{vector}")
            if dead_values := [n for n in self._names(vector) if n.startswith("_by=")]:
                # at most one row for two versions
                for r in self.spark.read.parquet(*[f"{self.path}/{vector}/{n}" for n in dead_values]).select("_folder", F.regexp_extract(F.col("_metadata.file_path"), r"_by=(\d+)", 1).cast("bigint")).distinct().collect():
                    hits.setdefault(r[1], []).append(r[0])
        files, info, versions = dict(old["files"]), dict(old["info"]), {}
        for i, v in enumerate(values):
            for folder in hits.get(v, ()):
                files[folder] = [*files[folder], f"{vector}/_by={v}"]
            files[folders[v]] = []
            info = {**info, by: v}
            self._publish(base + 1 + i, {"files": files, "info": info})
            versions[v] = base + 1 + i
        return versions

    def _read_places(self, folders: list[str]) -> DataFrame:
        """Rows of these folders with the place of each."""
        read = self.spark.read.parquet(*[f"{self.path}/{f}" for f in sorted(folders)])
        return read.select("*", F.regexp_extract(F.col("_metadata.file_path"), _FOLDER, 1).alias("_folder"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _vectors(self, names: Iterable[str]) -> DataFrame | None:
        paths = sorted(set(names))
        return self.spark.read.parquet(*[f"{self.path}/{v}" for v in paths]) if paths else None

    def _positions(self, files: dict) -> DataFrame:
        """Live rows of these folders with the place of each."""
        rows = self._read_places([*files])
        dead = self._vectors(v for vs in files.values() for v in vs)
        return rows if dead is None else rows.join(dead.select(*_PLACE), _PLACE, "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; a version without files raises ValueError."""
        files = self.manifest(self.latest() if version is None else version)["files"]
        if not files:
            raise ValueError("a version without files has no schema")
        return self._positions(files).drop(*_PLACE)

    def changes(self, since: int, until: int | None = None) -> DataFrame | None:
        """Rows added ('insert') and removed ('delete') between two versions, None if nothing changed.

        Files that both versions hold are read only where a deletion vector was added.
        """
        a, b = self.manifest(since)["files"], self.manifest(self.latest() if until is None else until)["files"]
        parts = []
        if added := {k: v for k, v in b.items() if k not in a}:
            parts.append(self._positions(added).withColumn("_change", F.lit("insert")))
        if removed := {k: v for k, v in a.items() if k not in b}:
            parts.append(self._positions(removed).withColumn("_change", F.lit("delete")))
        if grown := {k: set(b[k]) - set(v) for k, v in a.items() if k in b and b[k] != v}:
            new = self._vectors(v for vs in grown.values() for v in vs).select(*_PLACE)
            parts.append(self._read_places([*grown]).join(new, _PLACE, "left_semi").withColumn("_change", F.lit("delete")))
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.drop(*_PLACE)

    def deltas(self, since: int = 0, until: int | None = None) -> DataFrame | None:
        """The changes of every version after ``since`` at once: rows that a version added, with _added and _removed.

        _added is the version whose manifest first lists the row's file, _removed the one whose manifest
        dropped the file or added a deletion vector with the row (null: still there).  None without added files.
        """
        until = self.latest() if until is None else until
        added: dict[str, int] = {}
        dropped: dict[str, int] = {}
        vectors: dict[str, int] = {}
        before = self.manifest(since)["files"]
        for version in range(since + 1, until + 1):
            now = self.manifest(version)["files"]
            added |= {k: version for k in now if k not in before}
            dropped |= {k: version for k in before if k not in now}
            vectors |= {v: version for k, vs in now.items() for v in vs if v not in before.get(k, ()) and v not in vectors}
            before = now
        if not added:
            return None
        of = lambda column, known: F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in known.items()], F.lit(None).cast("int"))
        rows = self._read_places([*added]).withColumn("_added", of(F.col("_folder"), added)).withColumn("_removed", of(F.col("_folder"), dropped))
        if vectors:
            dead = self._vectors(vectors).select(*_PLACE, of(F.regexp_extract(F.col("_metadata.file_path"), r"(_deleted/[^/]+(?:/_by=[^/]+)?)/[^/]+$", 1), vectors).alias("_dead"))
            rows = rows.join(dead, _PLACE, "left").withColumn("_removed", F.least("_removed", "_dead")).drop("_dead")
        return rows.drop(*_PLACE)


def process_changes(source: VersionedTable, sink: VersionedTable, transform: Callable[[DataFrame], DataFrame]) -> int | None:
    """Applies ``transform`` to what changed in ``source`` since ``sink`` last took it; the new version of ``sink``, None if nothing changed.

    The processed version is part of the output's commit, kept per source through all later commits of
    the sink.  A run that fails before it leaves at most unlisted files; the next run starts from the
    same version again.
    """
    key = f"processed {source.path}"
    done = int(sink.manifest(sink.latest())["info"].get(key, 0))
    now = source.latest()
    changed = source.changes(done, now)
    if changed is None:
        return None
    return sink.commit(add=transform(changed), info={key: now})


def record_versions(records: DataFrame, runs: DataFrame) -> DataFrame | None:
    """(repo, rel_path, added_in, deleted_in, hash, file_type): what every version of the manifest added and removed.

    Each run that ended well commits its records as a version of a ``VersionedTable`` in the shared
    folder; a record deletes the one of the same path that an earlier run left.  The rows are the
    table's ``deltas``: added_in and deleted_in (null: still there) are run_ids.  Of equal runs the
    record of the largest entry_id counts.  None if no run ended well with a record.
    """
    spark = records.sparkSession
    good = runs.where(F.col("status") == "success").select("run_id")
    last = (
        records.where(F.col("rel_path").isNotNull())
        .join(good, "run_id", "left_semi")
        .groupBy("repo", forward_path(F.col("rel_path")).alias("rel_path"), F.col("run_id").cast("bigint").alias("run_id"))
        .agg(F.max_by(F.struct(digest(F.col("hash")).alias("hash"), F.col("file_type").alias("file_type")), "entry_id").alias("x"))
        .select("repo", "rel_path", "run_id", "x.hash", "x.file_type")
    )
    log = VersionedTable(spark, f"{checkpoint_dir(spark)}/versions-{uuid.uuid4()}")
    run_of = {version: run for run, version in log.commit_each(last, "run_id", ["repo", "rel_path"]).items()}
    deltas = log.deltas()
    if deltas is None:
        return None
    deleted = F.coalesce(*[F.when(F.col("_removed") == v, F.lit(r)) for v, r in run_of.items()]).cast("bigint")
    return deltas.select("repo", "rel_path", F.col("run_id").alias("added_in"), deleted.alias("deleted_in"), "hash", "file_type")


def pending_entries(scans: DataFrame, records: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, repo, rel_path), once each: what every run's scan has to process.

    scans and records: run_id, repo, rel_path, hash, file_type (records also entry_id); runs: run_id,
    status.  Each scan is held against the version that the successful runs before it left
    (``record_versions``): a path is pending if that version doesn't hold it, holds it with another
    digest or file_type, or if either digest is missing.  Paths that are null play no part; a null
    repo is a repo of its own; repeated rows count once; empty tables give no rows.  The versions
    are written when the function is called.
    """
    listed = scans.where(F.col("rel_path").isNotNull() & F.col("run_id").isNotNull()).groupBy("repo", forward_path(F.col("rel_path")).alias("rel_path"), "run_id", digest(F.col("hash")).alias("hash"), "file_type").agg(F.lit(1).alias("_"))
    versions = record_versions(records, runs)
    if versions is None:
        return listed.select("run_id", "repo", "rel_path").distinct()
    v = versions.alias("v")
    held = F.col("s.repo").eqNullSafe(F.col("v.repo")) & (F.col("s.rel_path") == F.col("v.rel_path")) & (F.col("v.added_in") < F.col("s.run_id")) & (F.col("v.deleted_in").isNull() | (F.col("s.run_id") <= F.col("v.deleted_in")))
    same = (F.col("s.hash") == F.col("v.hash")) & F.col("s.file_type").eqNullSafe(F.col("v.file_type"))
    found = listed.alias("s").join(v, held, "left").where(~F.coalesce(same, F.lit(False)))
    return found.select("s.run_id", "s.repo", "s.rel_path").distinct()
