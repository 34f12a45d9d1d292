"""Layout and sectioning: blocks, running offsets, headings, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = r"<(h[1-6]|p|li)[^>]*>([^<]*)"


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, text) of headings, paragraphs and list items in order; blank ones go."""
    kinds, texts = (F.regexp_extract_all("html", F.lit(BLOCK), F.lit(k)) for k in (1, 2))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(kinds.alias("kind"), texts.alias("text"))).alias("pos", "b"))
    return rows.select("page_id", "pos", "b.kind", F.trim("b.text").alias("text")).filter("text <> ''")


def running_offsets(blocks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Start and end of each block if blocks are joined by one character."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))
    return blocks.withColumn("char_start", start).withColumn("char_end", start + F.length(text))


def first_of_equal(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """Of rows equal in the keys the first stays."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("nth = 1").drop("nth")


def stitched(lines: DataFrame, least_words: int = 8) -> DataFrame:
    """(doc_id, part, text): a line under ``least_words`` words joins the line before it unless that ends a sentence."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    words = F.size(F.filter(F.split("line", " "), lambda x: x != ""))
    joins = (words < least_words) & ~F.lag("line").over(w).rlike("[.!?:;]$")
    numbered = lines.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    numbered = numbered.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return numbered.groupBy("doc_id", "part").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(held, lambda x: x["line"]), " ").alias("text"))


def carried(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value that isn't null, this row's included."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def heading_paths(rows: DataFrame, key: str, order: str, level: str, title: str, depth: int) -> DataFrame:
    """The path of headings open at each row, 'a > b': a heading closes those of its level and deeper.

    Of each level the last heading counts, if no shallower or equal one came after it.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = {k: F.last(F.when(F.col(level) == k, F.struct(F.col(order).alias("o"), F.col(title).alias("t"))), ignorenulls=True).over(w) for k in range(1, depth + 1)}
    out = rows.withColumns({f"_{k}": c for k, c in at.items()})
    opened = []
    for k in range(1, depth + 1):
        later = [F.coalesce(F.col(f"_{j}.o"), F.lit(-1)) for j in range(1, k)]
        opened.append(F.when(F.col(f"_{k}.o") > F.greatest(F.lit(-1), F.lit(-1), *later), F.col(f"_{k}.t")))
    return out.withColumn("path", F.array_join(F.array_compact(F.array(*opened)), " > ")).drop(*[f"_{k}" for k in at])


def word_capped(lines: DataFrame, cap: int) -> DataFrame:
    """(doc_id, pos, chunk): a chunk ends before the line that would carry it over ``cap`` words.

    Each chunk's end depends on the one before it, so this is a fold over the lines of one document, inside the JVM.
    """
    words = F.size(F.filter(F.split("line", " "), lambda x: x != ""))
    held = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", words.alias("n")))).alias("rows"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("chunk"), F.array().cast("array<struct<pos:int,chunk:int>>").alias("out"))

    def step(state: Column, row: Column) -> Column:
        over = (state["sum"] > 0) & (state["sum"] + row["n"] > cap)
        chunk = state["chunk"] + F.when(over, 1).otherwise(0)
        total = F.when(over, row["n"]).otherwise(state["sum"] + row["n"])
        return F.struct(total.alias("sum"), chunk.alias("chunk"), F.concat(state["out"], F.array(F.struct(row["pos"].alias("pos"), chunk.alias("chunk")))).alias("out"))

    return held.select("doc_id", F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("r")).select("doc_id", "r.pos", "r.chunk")


def merged_small(chunks: DataFrame, least: int) -> DataFrame:
    """(doc_id, chunk, merged): a chunk under ``least`` words of the same category joins the chunk before it, as merged so far."""
    held = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "words", "category"))).alias("rows"))
    start = F.struct(F.lit(-1).alias("m"), F.lit(None).cast("string").alias("category"), F.array().cast("array<struct<chunk:int,merged:int>>").alias("out"))

    def step(state: Column, row: Column) -> Column:
        joins = (row["words"] < least) & state["category"].eqNullSafe(row["category"])
        m = state["m"] + F.when(joins, 0).otherwise(1)
        return F.struct(m.alias("m"), row["category"].alias("category"), F.concat(state["out"], F.array(F.struct(row["chunk"].alias("chunk"), m.alias("merged")))).alias("out"))

    return held.select("doc_id", F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("r")).select("doc_id", "r.chunk", "r.merged")


def adjacent(chunks: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return chunks.withColumns({"previous": F.lag(order).over(w), "next": F.lead(order).over(w)})


def first_rule(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule whose pattern occurs."""
    out = F.when(text.rlike(rules[0][1]), rules[0][0])
    for name, pattern in rules[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(other)
