"""Roll-ups of runs and logs, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens and prices behind the cost of a verified candidate.
TOKENS_IN, TOKENS_OUT = 418, 85
PRICE_IN, PRICE_OUT = 0.80e-6, 4.00e-6


def key_values(line: Column) -> Column:
    """Map of the key=value pairs of a log line."""
    pattern = r"(\w+)=(\S+)"
    return F.map_from_arrays(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), F.regexp_extract_all(line, F.lit(pattern), F.lit(2)))


def floor_percentile(values: Column, share: float) -> Column:
    """The value at index floor(share * (n - 1)) of the sorted values."""
    held = F.sort_array(F.collect_list(values))
    return F.element_at(held, (F.floor(share * (F.size(held) - 1)) + 1).cast("int"))


def slowest(rows: DataFrame, by: str, value: str, name: str, n: int) -> DataFrame:
    """The n largest of each group as 'name:value', by a window that keeps n rows."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), name))).filter(F.col("place") <= n)
    return ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", name))), lambda x: x[name].cast("string")), ",").alias("slowest"))


def bucketed(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(low, n, percent) of buckets [low, next), the last one open."""
    low = F.lit(edges[0])
    for e in edges[1:]:
        low = F.when(F.col(value) >= e, e).otherwise(low)
    counts = rows.filter(F.col(value) >= edges[0]).groupBy(low.alias("low")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def compared(old: DataFrame, new: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """Rows of both runs zipped by rank within a key: BOTH, OLD ONLY or NEW ONLY."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    side = lambda d, n: d.withColumn("nth", F.row_number().over(w)).select(*keys, "nth", F.col(score).alias(n))
    both = side(old, "old").join(side(new, "new"), [*keys, "nth"], "full_outer")
    return both.withColumn("status", F.when(F.col("old").isNull(), "NEW ONLY").when(F.col("new").isNull(), "OLD ONLY").otherwise("BOTH"))


def best_state(rows: DataFrame, keys: list[str], order: dict[str, int], state: str, *ties: str) -> DataFrame:
    """Of rows of a key the one whose state comes first."""
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col(state)]
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, *ties))).filter("nth = 1").drop("nth")


def causes(rules: list[tuple[str, Column]]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))
