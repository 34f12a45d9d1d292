"""Readers and writers: layout files, logs, CSV and JSON results, keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators.analytics import key_values

LAYOUT = "start_page int, chunk_index int, pages array<struct<number:int,blocks:array<struct<kind:string,text:string>>>>"


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """(page, pos, kind, text) of layout JSON files split by page ranges: numbers count from each file's first page."""
    pages = spark.read.schema(LAYOUT).option("multiLine", True).json(path).select("start_page", F.explode("pages").alias("p"))
    return pages.select((F.col("p.number") + F.col("start_page") - 1).alias("page"), F.posexplode("p.blocks").alias("pos", "b")).select("page", "pos", "b.kind", "b.text")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, fields) of a text log with key=value pairs."""
    return spark.read.text(path).select(F.col("value").alias("line"), key_values(F.col("value")).alias("fields"))


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in a fixed order; arrays and structs as JSON."""
    nested = {f.name for f in rows.schema if f.dataType.typeName() in ("array", "map", "struct")}
    rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def upsert(held: DataFrame | None, more: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of both with the latest version of each key; the same batch twice changes nothing."""
    rows = more if held is None else held.unionByName(more)
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
