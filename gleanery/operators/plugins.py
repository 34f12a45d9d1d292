"""Plug-in points for models, each with the offline fallback: scorer, verifier, evidence classifier, embedder, entity finder.

A plug-in is a function from a pandas batch to a column (or rows); batches come through Arrow. Without one the fallback
is a literal, and no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import sigmoid

#: Characters that a scorer and an embedder see at most; the bypassed rerank score; verdict and confidence without a verifier.
PASSAGE, EMBEDDED = 3000, 25_000
BYPASS, VERDICT, CONFIDENCE = 10.0, "MAYBE", 0.5


def applied(rows: DataFrame, model: Callable[[pd.DataFrame], pd.Series] | None, name: str, kind: str, fallback: Column) -> DataFrame:
    """``rows`` with the column ``name`` of a model over pandas batches, or of the fallback."""
    if model is None:
        return rows.withColumn(name, fallback.cast(kind))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: model(batch)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, `{name}` {kind}")


def cross_encoded(rows: DataFrame, model: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Logit of (query, passage) and its sigmoid times ten; a logit of 0 without a model. The model sees the first PASSAGE characters, as the features' text does not."""
    scored = applied(rows.withColumn("passage", F.left("text", F.lit(PASSAGE))), model, "logit", "double", F.lit(0.0))
    return scored.withColumn("ce_score", 10 * sigmoid(F.col("logit"))).drop("passage")


def verified(rows: DataFrame, model: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Verdict of each candidate; MAYBE at 0.5 without a model or where it gives none."""
    out = applied(rows, model, "verdict", "string", F.lit(VERDICT))
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(VERDICT))).withColumn("confidence", F.lit(CONFIDENCE))


def classified(rows: DataFrame, model: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Evidence label of each hit; RELATED without a model, which calibration turns to SUPPORTING for weak matches."""
    return applied(rows, model, "evidence", "string", F.lit("RELATED"))


def bypassed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rerank_score", F.lit(BYPASS))


def embedded(rows: DataFrame, model: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Vector of each text; null without a model, where given vectors are joined instead."""
    return applied(rows, model, "vector", "array<float>", F.lit(None))
