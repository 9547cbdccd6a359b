"""Reading the tables a query needs, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Parquet file or folder ``name`` of ``directory``; its scan prunes columns and takes filters."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
