"""Stage store: what a stage gave is written once and read by all that follows; and broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side up to which it is broadcast; query terms, dictionaries and bounds have some hundred bytes a row.
MOST_BROADCAST = 200_000


def staged(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the folder that the session names (``spark.checkpoint.dir``), else in the warehouse. Both are shared on a cluster."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows; else as it is, so that the planner shuffles it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
