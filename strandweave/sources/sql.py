"""SQL text over the tables, with the package's functions registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.search import _without_marks
from .tables import table

TABLES = ("nodes", "edges", "source_files", "scan_entries", "manifest_entries", "runs", "documents", "events")

#: SQL functions, inlined by the optimizer: what ``functions.text`` does to columns.
FUNCTIONS = {
    "normalize_id": ("s string", "string", "btrim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '_'), '_')"),
    "make_id": ("s string", "string", "lower(regexp_replace(regexp_replace(regexp_replace(s, '^[_.]+|[_.]+$', ''), '[^A-Za-z0-9]+', '_'), '^_+|_+$', ''))"),
    "estimate_tokens": ("s string", "bigint", "greatest(octet_length(s) div 4, 1L)"),
    "basename": ("s string", "string", "substring_index(s, '/', -1)"),
}


def register_views(spark: SparkSession, directory: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the tables of a folder."""
    for name in names:
        table(spark, directory, name).createOrReplaceTempView(name)


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions, the Arrow function ``norm_label``, and the table function ``symbols_of(path, body)``."""
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {returns} return {body}")
    spark.udf.register("norm_label", _without_marks)
    spark.udtf.register("symbols_of", symbols_udtf())


def symbols_udtf():
    from pyspark.sql.functions import udtf

    @udtf(returnType="kind string, id string, label string, line int")
    class Symbols:
        """The nodes of one file as rows."""

        def eval(self, path: str, body: str):
            from ..extract.symbols import extract_text

            found = extract_text(path, body) if path else None
            for node, label, line in found.nodes if found else ():
                yield "node", node, label, line

    return Symbols


def run(spark: SparkSession, directory: str, text: str, views: dict[str, str] | None = None) -> DataFrame:
    """The result of SQL text over a folder's tables and further views, given as SQL."""
    register_views(spark, directory, tuple(t for t in TABLES if t in text or any(t in v for v in (views or {}).values())))
    register_functions(spark)
    for name, query in (views or {}).items():
        spark.sql(query).createOrReplaceTempView(name)
    return spark.sql(text)
