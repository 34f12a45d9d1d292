"""Reranking: features, comparators, severity and caps, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of severities, and the score that each caps a candidate at.
SEVERITY = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "FATAL": 4}
VETO = {"FATAL": 3.0, "HIGH": 4.2, "MEDIUM": 6.5}
#: Weights of a difference between identities, from equal to different.
RELATION_WEIGHTS = {"EXACT": 0.0, "COMBINATION": -0.10, "SAME_FAMILY": -0.18, "RELATED": -0.25, "DIFFERENT": -0.35}
MARGINS = (8, 7, 6, 5, 4, 3, 2, 1)


def position_bonus(place: Column, low: float, high: float, most: float = 0.30, fade: float = 0.30) -> Column:
    """``most`` within a range, fading linearly over ``fade`` beyond it."""
    away = F.greatest(low - place, place - high, F.lit(0.0))
    return F.greatest(F.lit(0.0), most * (1 - away / fade))


def within(a: Column, b: Column, kind: Column) -> Column:
    """Equality of numbers by kind: counts exactly, p-values to 5e-5, shares to 0.5, ratios to 1.5 %."""
    gap = F.abs(a - b)
    return F.when(kind == "count", gap == 0).when(kind == "p", gap <= 5e-5).when(kind == "share", gap <= 0.5).otherwise(gap <= 0.015 * F.abs(a))


def severity_of(conflicts: Column, fatal: Column, own: Column) -> Column:
    """Severity of a candidate from its number of conflicts, a fatal pair, and the worst one's own severity."""
    return F.when(fatal, "FATAL").when(conflicts >= 3, "HIGH").when((conflicts == 2) & (own != "HIGH"), "MEDIUM").when(conflicts >= 1, own).otherwise("NONE")


def capped(score: Column, severity: Column) -> Column:
    out = F.when(severity == "FATAL", F.least(score, F.lit(VETO["FATAL"])))
    for name in ("HIGH", "MEDIUM"):
        out = out.when(severity == name, F.least(score, F.lit(VETO[name])))
    return out.otherwise(score)


def kept(rows: DataFrame, by: str, score: str, threshold: float, most: int, pages: Column | None = None) -> DataFrame:
    """Rows at or above a threshold, up to 100; if a query has none, its best ``most`` (35 for 10,000 pages or more)."""
    every = Window.partitionBy(by)
    above = F.count_if(F.col(score) >= threshold).over(every)
    place = F.row_number().over(every.orderBy(F.desc(score), "doc_id"))
    limit = F.lit(most) if pages is None else F.when(pages >= 10_000, 35).otherwise(most)
    ranked = rows.withColumns({"above": above, "place": place})
    return ranked.filter(F.when(F.col("above") > 0, (F.col(score) >= threshold) & (F.col("place") <= 100)).otherwise(F.col("place") <= limit)).drop("above")


def histogram(rows: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Rows with a score of at least each margin."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(score) >= m).alias(f"ge_{m}") for m in MARGINS])


def composite(features: dict[str, Column], weights: dict[str, float], extra: Column, most: float = 10.0) -> Column:
    """Weighted sum of features of 0 to 10 and what is added, from 0 to ``most``."""
    total = extra
    for name, weight in weights.items():
        total = total + weight * features[name]
    return F.greatest(F.lit(0.0), F.least(total, F.lit(most)))


def study_score(asked: Column, found: Column) -> Column:
    """5 if nothing is asked, 4 if none is found, 0 for no overlap, else 4 and up to 6 by recall."""
    share = F.size(F.array_intersect(asked, found)) / F.size(asked)
    return F.when(F.size(asked) == 0, 5.0).when(F.size(found) == 0, 4.0).when(share == 0, 0.0).otherwise(4 + 6 * share)
