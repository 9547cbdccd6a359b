import pytest
from pyspark.sql import functions as F

from strandweave.operators.incremental import VersionedTable, pending_entries, process_changes
from strandweave.streaming.watch import append_once

S = "entry_id long, run_id long, repo string, rel_path string, hash string, file_type string, extra string"


def test_versions_changes_and_deletes(spark, tmp_path, rows):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.latest() == 0 and t.changes(0) is None
    t.commit(spark.range(4).toDF("k"))
    t.commit(spark.range(4, 6).toDF("k"))
    t.commit(delete_where="k in (1, 5)")
    assert rows(t.read()) == [(0,), (2,), (3,), (4,)]
    assert rows(t.read(1)) == [(0,), (1,), (2,), (3,)]
    # 5 came and went in between
    assert rows(t.changes(1), "k", "_change") == [(1, "delete"), (4, "insert")]
    assert rows(t.changes(2), "k", "_change") == [(1, "delete"), (5, "delete")]
    first = next(iter(t.manifest(1)["files"]))
    t.commit(remove=[first])
    assert rows(t.changes(3), "k", "_change") == [(0, "delete"), (2, "delete"), (3, "delete")]
    with pytest.raises(RuntimeError):
        t._publish(2, {"files": {}, "info": {}})


def test_failure_neither_skips_nor_repeats(spark, tmp_path, rows):
    a, b = VersionedTable(spark, str(tmp_path / "a")), VersionedTable(spark, str(tmp_path / "b"))
    a.commit(spark.range(3).toDF("k"))

    def broken(df):
        raise OSError("lost")

    with pytest.raises(OSError):
        process_changes(a, b, broken)
    assert process_changes(a, b, lambda df: df.select("k")) == 1
    assert process_changes(a, b, lambda df: df.select("k")) is None
    a.commit(spark.range(3, 5).toDF("k"))
    process_changes(a, b, lambda df: df.select("k"))
    assert rows(b.read()) == [(i,) for i in range(5)]


def test_other_commits_of_the_sink_repeat_nothing(spark, tmp_path, rows):
    a, b, c = (VersionedTable(spark, str(tmp_path / x)) for x in "abc")
    take = lambda df: df.select("k")
    a.commit(spark.range(5).toDF("k"))
    c.commit(spark.range(70, 72).toDF("k"))
    process_changes(a, b, take)
    b.commit(delete_where="k = 1")
    a.commit(spark.range(5, 7).toDF("k"))
    process_changes(c, b, take)
    process_changes(a, b, take)
    assert rows(b.read()) == [(i,) for i in (0, 2, 3, 4, 5, 6, 70, 71)]
    # a compaction: all rows in one new file, the old ones dropped
    b.commit(add=b.read().coalesce(1), remove=list(b.manifest(b.latest())["files"]))
    assert process_changes(a, b, take) is None and b.read().count() == 8
    handle = append_once(b)
    handle(spark.range(90, 91).toDF("k"), 0)
    b.commit(delete_where="k = 0")
    handle(spark.range(90, 91).toDF("k"), 0)
    assert b.read().where("k = 90").count() == 1


def test_a_delete_touches_only_its_files(spark, tmp_path, rows):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(spark.range(3).toDF("k"))
    t.commit(spark.range(3, 6).toDF("k"))
    t.commit(delete_where="k = 4")
    files = t.manifest(3)["files"]
    first, second = sorted(files)
    assert files[first] == [] and len(files[second]) == 1
    read = {f.split("/data-")[1].split("/")[0] for f in t.changes(2).inputFiles() if "/data-" in f}
    assert read == {second.removeprefix("data-")}
    t.commit(delete_where="k = 99")
    assert t.manifest(4)["files"] == files and t.changes(3) is None


def test_two_writers_cannot_take_the_same_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    t = VersionedTable(spark, str(tmp_path / "t"))

    def one(i):
        try:
            t._publish(1, {"files": {}, "info": {"writer": i}})
            return i
        except RuntimeError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [i for i in pool.map(one, range(16)) if i is not None]
    assert len(won) == 1 and t.manifest(1)["info"] == {"writer": won[0]}


def test_commit_each_and_deltas(spark, tmp_path, rows):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(spark.createDataFrame([(0, "a", "old"), (0, "z", "old")], "run int, k string, v string"))
    d = spark.createDataFrame([(3, "a", "x"), (3, None, "n"), (5, "a", "y"), (5, "b", "y"), (9, None, "m")], "run int, k string, v string")
    assert t.commit_each(d, "run", ["k"]) == {3: 2, 5: 3, 9: 4}
    assert rows(t.read(2), "k", "v") == sorted([("a", "x"), ("z", "old"), (None, "n")], key=repr)
    assert rows(t.read(), "k", "v") == sorted([("a", "y"), ("z", "old"), ("b", "y"), (None, "m")], key=repr)
    assert rows(t.changes(2, 3), "k", "v", "_change") == [("a", "x", "delete"), ("a", "y", "insert"), ("b", "y", "insert")]
    got = rows(t.deltas(), "k", "v", "_added", "_removed")
    assert got == sorted([("a", "old", 1, 2), ("z", "old", 1, None), ("a", "x", 2, 3), (None, "n", 2, 4), ("a", "y", 3, None), ("b", "y", 3, None), (None, "m", 4, None)], key=repr)
    assert t.commit_each(d.limit(0), "run", ["k"]) == {} and t.deltas(4) is None


def test_batches_are_committed_once(spark, tmp_path, rows):
    t = VersionedTable(spark, str(tmp_path / "s"))
    handle = append_once(t)
    for number in (0, 0, 1):
        handle(spark.range(2).toDF("k"), number)
    assert t.read().count() == 4


def test_pending_entries(spark, rows):
    h = "ab" * 20
    scans = spark.createDataFrame(
        [(1, 1, "r", "a.py", h, "code", None), (2, 2, "r", "./a.py", " SHA1:" + h.upper(), "code", None), (3, 3, "r", "a.py", h, "document", None), (4, 2, "r", "b\\c.py", h, "code", None),
         (5, 2, "r", "b/c.py", h, "code", None), (6, 3, "r", "n.py", None, "code", None), (7, 3, "r", None, h, "code", None), (8, 3, None, "a.py", h, "code", None), (9, 4, "r", "e.py", h, None, None)], S)
    records = spark.createDataFrame(
        [(1, 1, "r", "a.py", h, "code", "x"), (2, 2, "r", "n.py", h, "code", None), (3, 2, "r", "b/c.py", h, "code", None), (4, 1, "r", "e.py", h, None, None), (5, 3, "r", "e.py", "ff", None, None)], S)
    runs = spark.createDataFrame([(1, "success"), (2, "success"), (3, "failed")], "run_id long, status string")
    got = rows(pending_entries(scans, records, runs))
    assert got == sorted([(1, "r", "a.py"), (2, "r", "b/c.py"), (3, "r", "a.py"), (3, "r", "n.py"), (3, None, "a.py")], key=repr)


def test_pending_entries_of_nothing_and_hot_paths(spark):
    none = spark.createDataFrame([], S)
    runs = spark.createDataFrame([(1, "success")], "run_id long, status string")
    assert pending_entries(none, none, runs).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("entry_id"), F.lit(2).alias("run_id"), F.lit("r").alias("repo"), F.lit("a" * 5000).alias("rel_path"), F.lit("").alias("hash"), F.lit("code").alias("file_type"))
    assert pending_entries(hot, none, runs).count() == 1
