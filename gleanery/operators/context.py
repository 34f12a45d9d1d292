"""Context of hits: neighbours, previous and next texts, best objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Priority of object types when the best object of a chunk is chosen.
TYPE_PRIORITY = {"sentence": 3, "paragraph": 2, "heading": 1, "row": 1}


def neighbours(hits: DataFrame, objects: DataFrame, reach: int) -> DataFrame:
    """(.., center, pos, distance, text): objects within ``reach`` positions of each hit (doc_id, center).

    The positions are spelled out, so the range join is an equi-join on (doc_id, pos).
    """
    wanted = hits.withColumn("pos", F.explode(F.sequence(F.col("center") - reach, F.col("center") + reach)))
    return wanted.join(objects, ["doc_id", "pos"]).withColumn("distance", F.abs(F.col("pos") - F.col("center")))


def previous_and_next(rows: DataFrame, key: str, order: str, text: str, n: int) -> DataFrame:
    """The last ``n`` characters of the text before and the first ``n`` of the text after."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumns({"before": F.right(F.lag(text).over(w), F.lit(n)), "after": F.left(F.lead(text).over(w), F.lit(n))})


def best_object(rows: DataFrame, keys: list[str], hit: Column, priority: Column, order: str) -> DataFrame:
    """Of each chunk the object with a literal hit, then of the best type, then the first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(hit.cast("int")), F.desc(priority), order)
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
