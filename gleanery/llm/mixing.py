"""Mixing sources to target weights (operator 8), in DataFrame functions only.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share the words of all
documents; no target passes ``most`` times its source's words, and what is over goes to the others by
weight. Sorting by the ratio of cap to weight, a source is capped exactly if the rate that is left
once all before it are capped would carry it over its own cap.

Schedule: each source's words, documents in hashed order, are cut into blocks of equal length. A
target asks for so many blocks, in rounds over the source, the last one cut short. The slots of all
sources lie side by side on a line of 2^k points, and the van der Corput sequence visits the line
in bit-reversed order: every run of the schedule holds each source close to its share, and the whole
run holds it exactly. A slot's rank within its source names its block, and the blocks are joined to
the documents that they cover: what a row takes, and where in the schedule, is read off its slots. Ranks and positions are prefix sums
in two steps (sums of parts, then within a part), so no source, however large, is one task.

Nulls and empty texts have size 0 and are taken 0 times. Repeated rows are documents of their own, and which of several equal rows takes
what is left open. Rows without a doc_id, source or text are hashed like others. A very long text is one row with one number; its words fill several blocks. An
empty table gives an empty result. The same rows give the same result in any order. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import checkpointed, quoted

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 4096
#: Rows of one part of a source in the prefix sums, about, and the digits of its hash at most.
PART_ROWS, MOST_DIGITS = 1000, 4
CHUNK_BITS, PARTS_BITS = 14, 8


def content_hash(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Column:
    """A hash of a row's id, source and text, by which the documents of a source are shuffled."""
    parts = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in (id_col, source_col, text_col)]
    return F.md5(F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2]))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, source, size, hash): one row for each document, with the number of its words."""
    out = docs.select(
        F.col(quoted(id_col)).cast("long").alias("doc_id"),
        F.col(quoted(source_col)).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(quoted(text_col)).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        content_hash(id_col, text_col, source_col).alias("hash"),
    )
    return checkpointed(out.withColumn("row", F.monotonically_increasing_id()))


def targets(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, number, source_size, target) of every source; the sources' sums are all that one task sees."""
    every, by_name, by_ratio = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "number")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = lambda c: F.sum(c).over(every) - F.coalesce(F.sum(c).over(before), F.lit(0))
    return (
        documents.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("number", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") - 1) % len(weights) + 1))
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("rate", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left("weight"))
        .withColumn("capped", F.col("rate") > F.col("ratio"))
        .withColumn("fair", F.min_by(F.when(~F.col("capped"), F.col("rate")), F.struct("capped", "ratio", "number")).over(every))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("fair")))
        .select("source", "number", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))
    )


def before_in(value: Column, keys: list[str], order: list[Column]) -> Column:
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(number, block, slot, round, rank, words): every slot of the mix in the order of ``slot``."""
    every = Window.partitionBy()
    size, quota = F.col("source_size"), F.floor("target").cast("long")
    plan = (
        sources.filter(size > 0)
        .withColumn("rounds", F.expr(f"cast(floor(target) as bigint) div source_size"))
        .withColumn("rest", quota - F.col("rounds") * size)
        .withColumn("blocks", F.ceil(size / block).cast("long"))
        .withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
        .filter("slots > 0")
        .withColumn("low", before_in(F.col("slots"), [], [F.col("number")]))
        .withColumn("bits", F.length(F.bin(F.sum("slots").over(every))))
    )
    chunk = 1 << CHUNK_BITS
    points = (
        plan.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (slots - 1) div {chunk})")))
        .repartition("number", "chunk")
        .withColumn("point", F.explode(F.expr(f"sequence(low + chunk * {chunk}, low + least(slots, (chunk + 1) * {chunk}) - 1)")))
        .withColumn("slot", F.expr("cast(conv(reverse(lpad(bin(point), bits, '0')), 2, 10) as bigint)"))
        .withColumn("part", F.expr(f"shiftright(slot, greatest(bits - {PARTS_BITS}, 0))"))
    )
    parts = points.groupBy("number", "part").agg(F.count("*").alias("n")).withColumn("before", before_in(F.col("n"), ["number"], [F.col("part")])).drop("n")
    within = F.row_number().over(Window.partitionBy("number", "part").orderBy("slot")) - 1
    length = F.least(F.lit(block), size - F.col("block") * block)
    return (
        points.withColumn("within", within)
        .join(parts, ["number", "part"])
        .withColumn("rank", F.col("before") + F.col("within"))
        .withColumn("round", F.expr("rank div blocks"))
        .withColumn("block", F.expr("rank % blocks"))
        .withColumn("words", F.when(F.col("round") < F.col("rounds"), length).otherwise(F.least(length, F.col("rest") - F.col("block") * block)))
        .select("number", "block", "slot", "round", "rank", "words")
    )


def scheduled(docs: DataFrame, weights: tuple[int, ...], most: int, block: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``mix`` with each row's ``hash``."""
    documents = sized(docs, id_col, text_col, source_col)
    sources = checkpointed(targets(documents, weights, most))
    rows = documents.count()  # of the checkpoint; only the grain of the prefix sums follows from it
    digits = next((d for d in range(MOST_DIGITS) if rows <= PART_ROWS * 16**d), MOST_DIGITS)
    placed = documents.withColumn("part", F.substring("hash", 1, digits))
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("before", before_in(F.col("words"), ["source"], [F.col("part")])).drop("words")
    within = before_in(F.col("size"), ["source", "part"], [F.col("hash"), F.col("row")])
    placed = placed.withColumn("within", within).alias("d").join(parts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.part") == F.col("p.part")))
    placed = placed.select("d.row", "d.doc_id", "d.hash", "d.source", "d.size", (F.col("before") + F.col("within")).alias("start"))
    kept = [F.col(f"d.{c}") for c in ("row", "doc_id", "hash", "size", "start")] + [F.col(f"s.{c}") for c in ("number", "source_size", "target")]
    placed = placed.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(*kept)
    slots = F.sort_array(F.collect_list(F.struct("slot", "words"))).alias("slots")  # ``most`` and one more at most
    slots = schedule(sources, block).groupBy("number", "block").agg(slots)
    first, begin = F.col("block") * block, F.greatest(F.col("start"), F.col("block") * block)
    covered = (
        placed.withColumn("block", F.explode_outer(F.expr(f"case when size > 0 then sequence(start div {block}, (start + size - 1) div {block}) end")))
        .join(slots, ["number", "block"], "left")
        .withColumn("used", F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), first + s["words"]) - begin).alias("words"))))
        .withColumn("words", F.aggregate("used", F.lit(0).cast("long"), lambda n, u: n + u["words"]))
        .withColumn("first_slot", F.array_min(F.transform(F.filter("used", lambda u: u["words"] > 0), lambda u: u["slot"])))
        .withColumn("heads", F.when(F.col("start") >= first, F.transform(F.filter("slots", lambda s: first + s["words"] > F.col("start")), lambda s: s["slot"])))
    )
    none = F.array().cast("array<long>")
    return covered.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("hash", "doc_id", "size", "source_size", "target")],
        F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"), F.min("first_slot").alias("first_slot"), F.coalesce(F.max("heads"), none).alias("slots"),
    ).drop("row")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of (doc_id, size, source_size, target, taken, first_slot, slots), one for each input row.

    ``first_slot`` is the first place of the schedule that takes a word of the document, and ``slots`` are those that take its first word.
    """
    return scheduled(docs, weights, most, block, id_col, text_col, source_col).drop("hash")


def in_schedule_order(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents: rows of ``docs``, all columns, one for each slot that takes a document's first word, in the order of the slots.

    So a document comes ``most`` times at most, and each source's words differ from its target by less than its largest document.
    """
    found = scheduled(docs, weights, most, block, id_col, text_col, source_col)
    index = F.row_number().over(Window.partitionBy("mix_hash").orderBy(F.lit(0))).alias("mix_index")  # numbers equal rows
    slots = found.select(F.col("hash").alias("mix_hash"), "slots").select("mix_hash", index, "slots")
    rows = docs.select("*", content_hash(id_col, text_col, source_col).alias("mix_hash")).select("*", index)
    both = rows.join(slots, ["mix_hash", "mix_index"]).withColumn("mix_slot", F.explode("slots"))
    return both.orderBy("mix_slot").select(*[F.col(quoted(c)) for c in docs.columns])


ORACLE = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  md5(concat(coalesce(doc_id::varchar, ''), '|', coalesce(source, ''), '|', coalesce(text, ''))) as h from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as number from d group by source),
w as (select *, [5.0, 2.0, 1.0][(number - 1) % 3 + 1]::double as weight, (source_size * 3)::double as cap from s),
r as (select *, cap / weight as ratio from w),
l as (select *, (sum(source_size) over ()::double - coalesce(sum(cap) over o, 0)) / (sum(weight) over () - coalesce(sum(weight) over o, 0)) as rate
      from r window o as (order by ratio, number rows between unbounded preceding and 1 preceding)),
f as (select (select rate from l where not rate > ratio order by ratio, number limit 1) as fair),
t as (select source, number, source_size, case when rate > ratio then cap else weight * fair end as target from l, f),
q as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as rounds from t),
p as (select *, floor(target)::bigint - rounds * source_size as rest, (source_size + 4095) // 4096 as blocks from q),
n as (select *, rounds * blocks + (rest + 4095) // 4096 as slots from p),
b as (select *, coalesce(sum(slots) over (order by number rows between unbounded preceding and 1 preceding), 0)::bigint as low, length(bin(sum(slots) over ()::bigint))::int as bits from n where source_size > 0 and slots > 0),
v as (select number, source_size, rounds, rest, blocks, ('0b' || reverse(lpad(bin(low + i), bits, '0')))::bigint as slot from (select *, unnest(range(slots)) as i from b)),
k as (select *, row_number() over (partition by number order by slot) - 1 as rank from v),
c as (select number, slot, rank % blocks as block, least(4096, source_size - rank % blocks * 4096, case when rank // blocks < rounds then 4096 else rest - rank % blocks * 4096 end) as words from k),
e as (select d.*, p.number, p.source_size, p.target, coalesce(sum(size) over (partition by d.source order by h rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from d join p on d.source is not distinct from p.source),
x as (select doc_id, number, start, size, unnest(range(start // 4096, (start + size - 1) // 4096 + 1)) as block from e where size > 0),
y as (select doc_id, slot, least(start + size, block * 4096 + words) - greatest(start, block * 4096) as words from x join c using (number, block)),
z as (select doc_id, sum(words)::bigint as taken, min(slot) as first_slot from y where words > 0 group by doc_id)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, first_slot from e left join z using (doc_id)
"""
