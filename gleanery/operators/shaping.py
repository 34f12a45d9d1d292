"""Lookups, row shapes, spans and roll-ups between the stages, as DataFrame code."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import LINE_BYTES, ODD_CAPITALS


def fetched(asked: DataFrame, held: DataFrame, key: str, again: Column) -> DataFrame:
    """Rows of ``held`` for the asked keys, and those found at the second try by the key ``again`` for what the first one missed."""
    first = asked.join(held, key).withColumn("tries", F.lit(1))
    missed = asked.join(held.select(key), key, "left_anti").withColumn("asked_key", F.col(key)).withColumn(key, again)
    second = missed.join(held, key).drop(key).withColumnRenamed("asked_key", key).withColumn("tries", F.lit(2))
    return first.unionByName(second)


def looked_up(asked: DataFrame, held: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Asked keys that exist, missing fields filled; those that don't are dropped."""
    return asked.join(held, key).withColumns({c: F.coalesce(c, d) for c, d in defaults.items()})


def page_edges(chunks: DataFrame, key: str) -> DataFrame:
    """Each chunk (key, chunk, first, last) with the first chunk that ends on the page before it and the first that starts on the page behind it."""
    c = chunks.alias("c")
    side = lambda name, on: (
        c.join(chunks.alias("o"), (F.col(f"c.{key}") == F.col(f"o.{key}")) & on).groupBy(F.col(f"c.{key}").alias(key), F.col("c.chunk").alias("chunk")).agg(F.min("o.chunk").alias(name))
    )
    before, after = side("before", F.col("o.last") == F.col("c.first") - 1), side("after", F.col("o.first") == F.col("c.last") + 1)
    return chunks.join(before, [key, "chunk"], "left").join(after, [key, "chunk"], "left")


def normalized_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, key): of every line of (doc_id, text) its lower-case letters, digits and hyphens, with one space for whatever else stands between them.

    In Python by byte tables, as the JVM's patterns take many times as long.
    """
    table, odd = LINE_BYTES, ODD_CAPITALS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                at, pos, keys = [], [], []
                for r, text in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    if text is None:
                        continue
                    for capital, small in odd:
                        if capital in text:
                            text = text.replace(capital, small)
                    lines = [b" ".join(x.split()) for x in text.translate(table).split(b"\n")]
                    at += [r] * len(lines)
                    pos += range(len(lines))
                    keys += lines
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(keys, pa.binary()).cast(pa.string())], names=["doc_id", "pos", "key"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, pos int, key string")


def display_spans(objects: DataFrame, kind: str, text: str) -> DataFrame:
    """(.., nth, span_start, span): sentences of paragraphs, lines of 10 characters or more of lists, the whole of anything else."""
    mark = F.lit("\u0001")
    parts = F.when(F.col(kind) == "paragraph", F.split(F.regexp_replace(text, r"([.!?]) ", F.concat(F.lit("$1 "), mark)), "\u0001")).when(F.col(kind) == "list", F.split(F.regexp_replace(text, r"\n", F.concat(F.lit("\n"), mark)), "\u0001")).otherwise(F.array(text))
    before = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, p: n + F.length(p))
    spans = F.transform(parts, lambda p, i: F.struct(i.alias("nth"), before(i).alias("span_start"), F.rtrim(F.regexp_replace(p, "\n", " ")).alias("span")))
    rows = objects.withColumn("s", F.explode(spans)).select("*", "s.*").drop("s")
    return rows.filter((F.col(kind) != "list") | (F.length("span") >= 10)).filter(F.length("span") > 0)


def rolled_up(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row a group of accepted hits: page range, best confidence, YES if any, ids in order, sources, the best span, distinct texts."""
    order = F.struct("page_start", "position", (-F.col("confidence")).alias("c"), "chunk_id", "text")
    held = F.array_sort(F.collect_list(order))
    best = F.max_by("match_span", F.struct(F.col("match_span").isNotNull(), "highlight_score", F.negative("chunk_id"), "match_span"))
    return hits.groupBy(*keys).agg(
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.round(F.max("confidence"), 3).alias("confidence"), F.when(F.max((F.col("verdict") == "YES").cast("int")) == 1, "YES").otherwise("MAYBE").alias("verdict"),
        F.array_join(F.transform(held, lambda x: x["chunk_id"].cast("string")), ",").alias("chunk_ids"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), best.alias("match_span"),
        F.array_join(F.array_distinct(F.transform(held, lambda x: x["text"])), "\n\n---\n\n").alias("text"),
    )


def carried_topics(rows: DataFrame, key: str, order: str, line: str, least: int = 3) -> DataFrame:
    """(.., topic): a table of ``least`` rows or more splits where its first column names a new topic; an empty one carries the last topic on."""
    first = F.trim(F.split(line, r"\|").getItem(0))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    topics = rows.withColumn("name", F.last(F.when(first != "", first), ignorenulls=True).over(w))
    changed = (~F.col("name").eqNullSafe(F.lag("name").over(Window.partitionBy(key).orderBy(order)))).cast("int")
    size = F.count("*").over(Window.partitionBy(key))
    return topics.withColumn("new", changed).withColumn("topic", F.when(size >= least, F.sum("new").over(w)).otherwise(1)).drop("name", "new")


def weakest_link(rows: DataFrame, key: str, order: str, likeness: Column, bound: float) -> DataFrame:
    """(key, split, likeness): where the least alike neighbours of a section meet, if below the bound; the first among equals."""
    pairs = rows.withColumn("likeness", likeness).filter("likeness is not null")
    return pairs.groupBy(key).agg(F.min_by(order, F.struct("likeness", order)).alias("split"), F.min("likeness").alias("likeness")).filter(F.col("likeness") < bound)


def span_score(exact: Column, squeezed: Column, terms: Column, share: Column) -> Column:
    """Best of the span scorers that apply: exact, equal without white space, ontology terms, shared tokens."""
    return F.when(exact, 0.90).when(squeezed, 0.89).otherwise(F.greatest(F.when(terms > 0, F.least(0.60 + 0.1 * (terms - 1), F.lit(0.80))).otherwise(0.0), F.least(0.39 * share, F.lit(0.39))))
