"""Layout queries over pages, lines of documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators import layout as L
from gleanery.plans.registry import LINES, Tables, query

BLOCKS = r"""b0 as (select page_id, regexp_extract_all(html, '<(h[1-6]|p|li)[^>]*>([^<]*)', 1) as ks, regexp_extract_all(html, '<(h[1-6]|p|li)[^>]*>([^<]*)', 2) as xs from pages),
blocks as (select * from (select page_id, generate_subscripts(ks, 1)::int - 1 as pos, unnest(ks) as kind, trim(unnest(xs), ' ') as text from b0) where text <> '')"""
WORDS = "len(list_filter(string_split(line, ' '), lambda x: x <> ''))"


@query(f"with {BLOCKS} select * from blocks")
def html_blocks(t: Tables) -> DataFrame:
    return L.html_blocks(t.pages)


@query(f"with {BLOCKS} select page_id, count(*) as n, count_if(kind = 'li') as n_boilerplate, count_if(kind like 'h%') as n_titles, sum(case when kind = 'h1' then 3.0 when kind like 'h%' then 2.5 when kind = 'li' then 0.5 else 1.0 end)::double as boost from blocks group by page_id")
def html_boilerplate_flag(t: Tables) -> DataFrame:
    """Navigation lists are boilerplate; headings are boosted."""
    kind = F.col("kind")
    boost = F.when(kind == "h1", 3.0).when(kind.like("h%"), 2.5).when(kind == "li", 0.5).otherwise(1.0)
    return L.html_blocks(t.pages).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(kind == "li").alias("n_boilerplate"), F.count_if(kind.like("h%")).alias("n_titles"), F.sum(boost).alias("boost"))


@query(f"with {BLOCKS} select page_id, pos, coalesce(sum(length(text) + 1) over (partition by page_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as char_start, (coalesce(sum(length(text) + 1) over (partition by page_id order by pos rows between unbounded preceding and 1 preceding), 0) + length(text))::bigint as char_end from blocks")
def block_running_offsets(t: Tables) -> DataFrame:
    return L.running_offsets(L.html_blocks(t.pages), "page_id", "pos").select("page_id", "pos", "char_start", "char_end")


@query(f"with {LINES} select doc_id, count(*) as n, count(distinct lower(line)) as n_distinct from lines group by doc_id")
def exact_dup_objects(t: Tables) -> DataFrame:
    """Lines of a document, and those left once equal ones go."""
    rows = t.lines().withColumn("key", F.lower("line"))
    left = L.first_of_equal(rows, [F.col("doc_id"), F.col("key")], "pos").groupBy("doc_id").agg(F.count("*").alias("n_distinct"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(left, "doc_id")


@query(f"""with {LINES}, f as (select *, case when {WORDS} < 8 and not regexp_matches(lag(line) over w, '[.!?:;]$') then 0 else 1 end as new from lines window w as (partition by doc_id order by pos)),
p as (select *, sum(new) over (partition by doc_id order by pos rows unbounded preceding)::bigint as part from f)
select doc_id, part, count(*) as n_lines, string_agg(line, ' ' order by pos) as text from p group by doc_id, part""")
def fragment_stitch(t: Tables) -> DataFrame:
    return L.stitched(t.lines())


@query("""select conv_id, turn, role, last_value(case when role = 'system' then left(text, 40) end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as heading from conversations""")
def heading_fill(t: Tables) -> DataFrame:
    return L.carried(t.conversations, "conv_id", "turn", F.when(F.col("role") == "system", F.left("text", F.lit(40))), "heading").select("conv_id", "turn", "role", "heading")


@query("""with r as (select conv_id, turn, case role when 'system' then 1 when 'user' then 2 end as level, left(text, 10) as title from conversations),
o as (select *, last_value(case when level = 1 then turn end ignore nulls) over w as t1, last_value(case when level = 1 then title end ignore nulls) over w as h1, last_value(case when level = 2 then turn end ignore nulls) over w as t2, last_value(case when level = 2 then title end ignore nulls) over w as h2 from r window w as (partition by conv_id order by turn rows between unbounded preceding and current row))
select conv_id, turn, concat_ws(' > ', h1, case when t2 > coalesce(t1, -1) then h2 end) as path from o""")
def heading_stack(t: Tables) -> DataFrame:
    """System turns as first, user turns as second headings."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2)
    rows = t.conversations.select("conv_id", "turn", level.alias("level"), F.left("text", F.lit(10)).alias("title"))
    return L.heading_paths(rows, "conv_id", "turn", "level", "title", 2).select("conv_id", "turn", "path")


CAPPED = f"""n as (select doc_id, pos, {WORDS}::int as words from lines),
c as (select doc_id, pos, words as total, 0 as chunk from n where pos = 0 union all
      select n.doc_id, n.pos, case when total > 0 and total + words > 120 then words else total + words end, chunk + (total > 0 and total + words > 120)::int from c join n on n.doc_id = c.doc_id and n.pos = c.pos + 1)"""


@query(f"with recursive {LINES}, {CAPPED} select doc_id, pos::int as pos, chunk from c")
def chunk_wordcap(t: Tables) -> DataFrame:
    return L.word_capped(t.lines(), 120)


CATEGORY_RULES = [("LEGAL", "(?i)license|copyright"), ("CONTACT", "@|[0-9]{3}-[0-9]{4}"), ("NUMERIC", "[0-9]{2}"), ("TABLE", r"\|")]
CATEGORY_SQL = r"case when regexp_matches(line, '(?i)license|copyright') then 'LEGAL' when regexp_matches(line, '@|[0-9]{3}-[0-9]{4}') then 'CONTACT' when regexp_matches(line, '[0-9]{2}') then 'NUMERIC' when contains(line, '|') then 'TABLE' else 'OTHER' end"


@query(f"with {LINES} select doc_id, pos::int as pos, {CATEGORY_SQL} as category, case when {CATEGORY_SQL} = 'OTHER' then 0.3 else greatest(0.5, 0.9 - 0.15 * least(pos, 5)) end::double as confidence from lines")
def section_category(t: Tables) -> DataFrame:
    """First matching rule, less sure the deeper the line; 0.30 for no rule."""
    rows = t.lines().withColumn("category", L.first_rule(F.col("line"), CATEGORY_RULES, "OTHER"))
    return rows.select("doc_id", "pos", "category", F.when(F.col("category") == "OTHER", 0.3).otherwise(F.greatest(F.lit(0.5), 0.9 - 0.15 * F.least("pos", F.lit(5)))).alias("confidence"))


CHUNKS = f"k as (select doc_id, (pos // 3)::int as chunk, sum({WORDS})::int as words, min_by({CATEGORY_SQL}, pos) as category from lines group by doc_id, pos // 3)"


def chunks(t: Tables) -> DataFrame:
    words = F.size(F.filter(F.split("line", " "), lambda x: x != ""))
    rows = t.lines().withColumn("chunk", F.expr("cast(pos div 3 as int)")).withColumn("category", L.first_rule(F.col("line"), CATEGORY_RULES, "OTHER"))
    return rows.groupBy("doc_id", "chunk").agg(F.sum(words).cast("int").alias("words"), F.min_by("category", "pos").alias("category"))


@query(f"with {LINES}, {CHUNKS} select doc_id, chunk, lag(chunk) over w as previous, lead(chunk) over w as next, last_value(case when category <> 'OTHER' then chunk end ignore nulls) over (partition by doc_id order by chunk rows between unbounded preceding and 1 preceding) as parent from k window w as (partition by doc_id order by chunk)")
def chunk_adjacency(t: Tables) -> DataFrame:
    """Neighbours, and as parent the latest earlier chunk with a category."""
    w = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("category") != "OTHER", F.col("chunk")), ignorenulls=True).over(w)
    return L.adjacent(chunks(t), "doc_id", "chunk").withColumn("parent", parent).select("doc_id", "chunk", "previous", "next", "parent")


@query(f"""with recursive {LINES}, {CHUNKS}, m as (select doc_id, chunk, category, 0 as merged from k where chunk = 0 union all
select k.doc_id, k.chunk, k.category, m.merged + (not (k.words < 40 and k.category = m.category))::int from m join k on k.doc_id = m.doc_id and k.chunk = m.chunk + 1)
select doc_id, chunk, merged from m""")
def chunk_merge_small(t: Tables) -> DataFrame:
    return L.merged_small(chunks(t), 40)


@query(f"with {LINES}, s as (select doc_id, pos, min(pos) over (partition by doc_id) as lo, count(*) over (partition by doc_id) as total from lines) select doc_id, pos::int as pos, round((pos + 1) / total, 3)::double as position from s where pos between 2 and 6")
def page_range_scan(t: Tables) -> DataFrame:
    """A range of positions with the place of each in its document."""
    rows = t.lines().withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))
    return rows.filter(F.col("pos").between(2, 6)).select("doc_id", "pos", F.round((F.col("pos") + 1) / F.col("total"), 3).alias("position"))


@query(f"""with {LINES}, o as (select doc_id, pos, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as a from lines)
select item_id, o.doc_id, count(*) as n_lines, min(pos)::int as first_line from (select item_id, doc_id, position(b.text in d.text) - 1 as s, position(b.text in d.text) - 1 + length(b.text) as e from benchmark b, documents d where contains(d.text, b.text)) m
join o on o.doc_id = m.doc_id and o.a < m.e and o.a + length(o.line) > m.s group by item_id, o.doc_id""")
def span_line_overlap(t: Tables) -> DataFrame:
    """Lines that each verbatim match touches, by interval overlap within the document."""
    from gleanery.operators.retrieve import literal

    asked = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    spans = literal(asked, t.documents.select("doc_id", "text")).join(F.broadcast(asked), "query_id").select("query_id", "doc_id", (F.col("place") - 1).alias("s"), (F.col("place") - 1 + F.length("text")).alias("e"))
    rows = L.running_offsets(t.lines(), "doc_id", "pos", "line")
    hit = rows.join(spans, "doc_id").filter("char_start < e and char_end > s")
    return hit.groupBy(F.col("query_id").alias("item_id"), "doc_id").agg(F.count("*").alias("n_lines"), F.min("pos").alias("first_line"))
