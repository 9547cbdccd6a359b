"""Session defaults for local runs, and the shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "strandweave", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only in a local session without it."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"strandweave-{os.getpid()}")
    sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` read back from the shared folder, its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read back: its lineage cut, its size known."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's code to the executors' Python workers, once per application.

    The archive is code for the driver's file server to hand out; no data goes through it.
    """
    import shutil
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="strandweave-code-")
    for p in root.rglob("*.py"):
        to = Path(folder, "src", root.name, p.relative_to(root))
        to.parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(p, to)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "strandweave"), "zip", os.path.join(folder, "src")))
    _SHIPPED.add(app)


def bounded(df: DataFrame, rows: int, what: str) -> DataFrame:
    """``df`` for a broadcast, its size checked: ValueError beyond ``rows`` rows, so that nothing is left out unseen."""
    from pyspark.sql import functions as F

    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} {what}")
    return F.broadcast(df)
