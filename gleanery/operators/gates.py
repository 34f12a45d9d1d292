"""Gates, highlights and merging of accepted candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import clip, saturate

#: Order of evidence labels in the final sort.
EVIDENCE_RANK = {"DIRECT": 0, "SUPPORTING": 1, "SAME_STUDY": 1, "BACKGROUND": 4, "UNRELATED": 9}
#: Confidence below which a candidate is gated.
LEAST_CONFIDENCE = 0.2


def merge_pages(hits: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """Number groups of page ranges: a row joins the previous row's group if it starts by that row's end plus one.

    The previous row counts, not the furthest end so far.
    """
    w = Window.partitionBy(*keys).orderBy("page_start", *ties)
    starts = F.when(F.col("page_start") <= F.lag("page_end").over(w) + 1, 0).otherwise(1)
    return hits.withColumn("starts", starts).withColumn("group", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def best_per(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key by an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("order", F.row_number().over(w)).filter("order = 1").drop("order")


def candidate_confidence(score: Column, identity: Column, enrichment: Column) -> Column:
    """Half the doubled score, and the shares left by the absence penalties (at most -0.4 and -0.25)."""
    return 0.5 * clip(2 * score) + 0.3 * F.greatest(F.lit(0.0), 1 + identity / 0.4) + 0.2 * F.greatest(F.lit(0.0), 1 + enrichment / 0.25)


def calibrated(confidence: Column, quality: Column, skipped: Column) -> Column:
    """Evidence confidence by match quality; 0.25 of it where verification was skipped, 0.1 at no quality."""
    return confidence * F.when(skipped, 0.25).when(quality <= 0, 0.1).otherwise(saturate(quality, 0.05))


def highlight_score(literal: Column, evidence: Column) -> Column:
    return F.when(literal, 1.0).when(evidence, 0.9).otherwise(0.0)


def provenance(direct: Column, sources: Column, unit: Column) -> Column:
    """'a+b/unit' of the retrievers that found it, 'chunk' as the unit of indirect hits."""
    return F.concat(F.array_join(F.array_sort(sources), "+"), F.lit("/"), F.when(direct, unit).otherwise("chunk"))
