"""How a named query is declared, and the tables that the driver hands over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Parquet tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def lines(self) -> DataFrame:
        """Objects: the lines of documents with their position."""
        return self.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def query(sql: str | None = None) -> Callable:
    """Register ``f(tables)`` under its name, with DuckDB SQL for the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: SQL of the objects, for the checks.
LINES = "lines as (select doc_id, source, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as pos from (select doc_id, source, string_split(text, chr(10)) as ls from documents))"


def tokens_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '[^a-z0-9]+'), lambda t: t <> '')"
