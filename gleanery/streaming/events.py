"""Streaming jobs over a folder of event files: keyed upserts, windows with watermarks, late data."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.sources.files import upsert


def scratch(spark: SparkSession) -> str:
    """A folder for state and results: in the shared one that the session names, else in the warehouse."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/_streams"
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table's Parquet file or folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")


def finished(rows: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is and give its result."""
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    if mode == "append":
        q = rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        q.awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{folder}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    rows.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def at(column: str = "ts"):
    return F.col(column).cast("timestamp")


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    w = F.window("at", width)
    return events.withColumn("at", at()).withWatermark("at", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    w = F.session_window("at", gap)
    return events.withColumn("at", at()).withWatermark("at", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def distinct_ids(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event id once, within the watermark."""
    return events.withColumn("at", at()).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def upserted(events: DataFrame, key: str = "user_id", version: str = "event_id") -> DataFrame:
    """The latest row of each key, kept by batches: each one is merged into a table of its own, so a repeated batch changes nothing."""
    spark, folder = events.sparkSession, scratch(events.sparkSession)

    merged: list[int] = []

    def merge(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{folder}/table-{number - 1}") if number else None
        upsert(before, batch, key, version).write.mode("overwrite").parquet(f"{folder}/table-{number}")
        merged.append(number)

    events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/table-{max(merged)}") if merged else spark.createDataFrame([], events.schema)


def in_batches(rows: list[DataFrame]) -> DataFrame:
    """A stream that reads each of some tables as a batch of its own, in order."""
    spark, folder = rows[0].sparkSession, scratch(rows[0].sparkSession)
    for number, batch in enumerate(rows):
        batch.coalesce(1).write.parquet(f"{folder}/in-{number}")
    return spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-*")


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) of each user by a state of its own: how many events so far, and the sum of their values."""
    spark, folder = events.sparkSession, scratch(events.sparkSession)

    def add(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    kind = "user_id long, n long, total double"
    out = events.groupBy("user_id").applyInPandasWithState(add, kind, "n long, total double", "update", "NoTimeout")
    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kind + ", batch int").parquet(f"{folder}/out").groupBy("user_id").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
