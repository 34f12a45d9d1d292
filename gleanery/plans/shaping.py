"""Queries of lookups, shapes, spans, roll-ups, reports and plug-in fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import containment, jaccard, tokens
from gleanery.operators import plugins as P
from gleanery.operators import retrieve
from gleanery.operators import shaping as S
from gleanery.operators.pairs import Factor, digest
from gleanery.plans import clinical as CL
from gleanery.plans.layout import BLOCKS, CATEGORY_RULES, CATEGORY_SQL
from gleanery.plans.registry import LINES, Tables, query, tokens_sql


@query("""with a as (select distinct user_id * 3 as o_orderkey from events), f as (select o_orderkey, o_totalprice, 1 as tries from a join orders using (o_orderkey)),
m as (select o_orderkey, o_orderkey // 3 as again from a where o_orderkey not in (select o_orderkey from orders)) select * from f union all select m.o_orderkey, o_totalprice, 2 from m join orders o on o.o_orderkey = again""")
def multi_get(t: Tables) -> DataFrame:
    """Orders by key, with a second try for the misses."""
    asked = t.events.select((F.col("user_id") * 3).alias("o_orderkey")).distinct()
    return S.fetched(asked, t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", F.expr("o_orderkey div 3"))


@query("with a as (select distinct l_suppkey * 2 as s_suppkey from lineitem) select s_suppkey, coalesce(s_name, '?') as s_name, coalesce(nullif(s_nationkey % 3, 0), -1)::int as part from a join supplier using (s_suppkey)")
def ci_lookup(t: Tables) -> DataFrame:
    """Asked suppliers that exist, with defaults for missing fields."""
    asked = t.lineitem.select((F.col("l_suppkey") * 2).alias("s_suppkey")).distinct()
    held = t.supplier.select("s_suppkey", "s_name", F.nullif(F.col("s_nationkey") % 3, F.lit(0)).cast("int").alias("part"))
    return S.looked_up(asked, held, "s_suppkey", {"s_name": F.lit("?"), "part": F.lit(-1)})


PAGED = "pg as (select doc_id, chunk, min(page) as first, max(page) as last from (select doc_id, (pos // 3)::int as chunk, (pos // 5)::int as page from lines) group by 1, 2)"


@query(f"with {LINES}, {PAGED} select c.doc_id, c.chunk, c.first, c.last, (select min(o.chunk) from pg o where o.doc_id = c.doc_id and o.last = c.first - 1) as before, (select min(o.chunk) from pg o where o.doc_id = c.doc_id and o.first = c.last + 1) as after from pg c")
def page_edge_lookup(t: Tables) -> DataFrame:
    """Chunks of three lines on pages of five: the first neighbour on the page before and behind."""
    rows = t.lines().select("doc_id", F.expr("cast(pos div 3 as int)").alias("chunk"), F.expr("cast(pos div 5 as int)").alias("page"))
    return S.page_edges(rows.groupBy("doc_id", "chunk").agg(F.min("page").alias("first"), F.max("page").alias("last")), "doc_id")


@query("select conv_id, turn, right(lag(text) over w, 500) as before, left(lead(text) over w, 500) as after, last_value(case when role = 'system' then left(text, 500) end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as parent from conversations window w as (partition by conv_id order by turn)")
def neighbour_and_parent_text(t: Tables) -> DataFrame:
    """The text before, behind and of the parent, the last system turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    parent = F.last(F.when(F.col("role") == "system", F.left("text", F.lit(500))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return t.conversations.select("conv_id", "turn", F.right(F.lag("text").over(w), F.lit(500)).alias("before"), F.left(F.lead("text").over(w), F.lit(500)).alias("after"), parent.alias("parent"))


@query(f"with {LINES}, h as (select doc_id from documents where doc_id % 20 = 0) select doc_id, pos::int as pos from (select doc_id, pos, row_number() over (partition by doc_id order by pos) as r from lines join h using (doc_id)) where r <= 100")
def chunk_only_fallback(t: Tables) -> DataFrame:
    """Hits without a position get up to 100 objects of their chunk, the reference's own bound."""
    hits = t.documents.filter("doc_id % 20 = 0").select("doc_id")
    w = Window.partitionBy("doc_id").orderBy("pos")
    return t.lines().join(hits, "doc_id", "left_semi").withColumn("r", F.row_number().over(w)).filter("r <= 100").select("doc_id", "pos")


LANGS = "case item_id % 4 when 0 then 'en' when 1 then 'de' when 2 then 'fr' else 'es' end"


@query(f"""with q as (select item_id as query_id, text, {LANGS} as lang from benchmark), qt as (select distinct query_id, lang, unnest(list_slice({tokens_sql("text")}, 1, 50)) as term from q), tk as (select doc_id, lang, {tokens_sql("text")} as ts from documents),
st as (select count(*) as n, avg(len(ts)) as mean_length from tk), po as (select doc_id, lang, length, term, count(*) as tf from (select doc_id, lang, len(ts) as length, unnest(ts) as term from tk) where term in (select term from qt) group by all), df as (select term, count(*) as df from po group by term),
bm as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) as score from qt join df using (term) join po using (term, lang), st group by query_id, doc_id)
select query_id, doc_id, score from (select *, rank() over (partition by query_id order by score desc) as r from bm) where r <= 5""")
def bm25_document_filter(t: Tables) -> DataFrame:
    """BM25 where each query sees only documents of its own language."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), "text", F.expr(LANGS).alias("lang"))
    return retrieve.top_with_ties(retrieve.bm25(asked, t.documents.select("doc_id", "text", "lang"), "lang"), 5).drop("rank")


@query(f"with {LINES} select doc_id, pos::int as pos, trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9\\s-]', ' ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ') as key from lines")
def object_normalizer(t: Tables) -> DataFrame:
    return S.normalized_lines(t.documents)


OBJECTS = f"ob as (select doc_id, (pos // 4)::int as object, string_agg(line, chr(10) order by pos) as text, case when doc_id % 3 = 0 then 'paragraph' when doc_id % 3 = 1 then 'list' else 'table' end as kind from lines group by doc_id, pos // 4)"


def objects(t: Tables) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "paragraph").when(F.col("doc_id") % 3 == 1, "list").otherwise("table")
    held = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return t.lines().groupBy("doc_id", F.expr("cast(pos div 4 as int)").alias("object")).agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("text")).withColumn("kind", kind)


@query(rf"""with {LINES}, {OBJECTS}, p as (select *, case kind when 'paragraph' then string_split(regexp_replace(text, '([.!?]) ', '\1 ' || chr(1), 'g'), chr(1)) when 'list' then string_split(replace(text, chr(10), chr(10) || chr(1)), chr(1)) else [text] end as ps from ob),
s as (select doc_id, object, kind, ps, unnest(range(len(ps))) as i from p), u as (select doc_id, object, kind, i::int as nth, coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)::int as span_start, rtrim(replace(ps[i + 1], chr(10), ' '), ' ') as span from s)
select doc_id, object, nth, span_start, span from u where (kind <> 'list' or length(span) >= 10) and length(span) > 0""")
def display_spans(t: Tables) -> DataFrame:
    return S.display_spans(objects(t), "kind", "text").select("doc_id", "object", "nth", "span_start", "span")


@query(f"""with {BLOCKS}, h as (select page_id, pos, kind, text, last_value(case when kind = 'h1' then text end ignore nulls) over w as a, last_value(case when kind = 'h2' then text end ignore nulls) over w as b from blocks window w as (partition by page_id order by pos rows between unbounded preceding and current row))
select page_id, pos, concat_ws(chr(10) || chr(10), concat_ws(' > ', a, b), text) as embedding_text from h where kind = 'p'""")
def embedding_text(t: Tables) -> DataFrame:
    """Heading path and text joined by a blank line."""
    from gleanery.operators.layout import html_blocks

    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda k: F.last(F.when(F.col("kind") == k, F.col("text")), ignorenulls=True).over(w)
    rows = html_blocks(t.pages).withColumns({"a": at("h1"), "b": at("h2")}).filter("kind = 'p'")
    return rows.select("page_id", "pos", F.concat_ws("\n\n", F.concat_ws(" > ", "a", "b"), "text").alias("embedding_text"))


@query("""with l as (select page_id, regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1) as xs from pages), n as (select page_id, list_filter(list_transform(xs, lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'), ' ')), lambda x: x <> '') as ys from l)
select page_id, len(ys)::int as n_items, array_to_string(ys, ' | ') as row_text from n where len(ys) > 0""")
def list_to_pipe_text(t: Tables) -> DataFrame:
    """Items of a page's lists, tags inside them dropped, as one row of pipe text."""
    items = F.transform(F.regexp_extract_all("html", F.lit("<li[^>]*>(.*?)</li>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    rows = t.pages.select("page_id", F.filter(items, lambda x: x != "").alias("ys")).filter(F.size("ys") > 0)
    return rows.select("page_id", F.size("ys").alias("n_items"), F.array_join("ys", " | ").alias("row_text"))


@query(f"""with {LINES}, r as (select doc_id, pos, line, trim(string_split(line, '|')[1], ' ') as cell from lines where contains(line, '|')),
n as (select *, last_value(nullif(cell, '') ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row) as name, count(*) over (partition by doc_id) as size from r),
c as (select *, (name is distinct from lag(name) over (partition by doc_id order by pos) or lag(pos) over (partition by doc_id order by pos) is null and name is not null)::int as new from n)
select doc_id, pos::int as pos, case when size >= 3 then sum(new) over (partition by doc_id order by pos rows unbounded preceding) else 1 end::bigint as topic from c""")
def table_topic_split(t: Tables) -> DataFrame:
    """Rows of pipe text split by the first column."""
    rows = t.lines().filter(F.contains("line", F.lit("|")))
    return S.carried_topics(rows, "doc_id", "pos", "line").select("doc_id", "pos", "topic")


@query(f"""with {LINES}, w as (select doc_id, pos, list_distinct({tokens_sql("line")}) as x, lead(list_distinct({tokens_sql("line")})) over (partition by doc_id order by pos) as y from lines),
j as (select doc_id, pos, case when len(list_distinct(x || y)) > 0 then len(list_intersect(x, y)) / len(list_distinct(x || y)) else 0.0 end as likeness from w where y is not null)
select doc_id, min_by(pos, {{'a': likeness, 'b': pos}})::int as split, round(min(likeness), 6)::double as likeness from j group by doc_id having min(likeness) < 0.6""")
def similarity_split(t: Tables) -> DataFrame:
    """Where the least alike neighbouring lines of a document meet."""
    own = F.array_distinct(tokens(F.col("line")))
    near = jaccard(own, F.lead(own).over(Window.partitionBy("doc_id").orderBy("pos")))
    rows = t.lines().withColumn("next", F.lead("pos").over(Window.partitionBy("doc_id").orderBy("pos")))
    found = S.weakest_link(rows.withColumn("near", near).filter("next is not null"), "doc_id", "pos", F.col("near"), 0.6)
    return found.select("doc_id", "split", F.round("likeness", 6).alias("likeness"))


@query(f"""with {LINES}, c as (select doc_id, pos, {CATEGORY_SQL} as category from lines), n as (select *, (category is distinct from lag(category) over (partition by doc_id order by pos))::int as new from c)
select doc_id, string_agg(category, ' > ' order by pos) as path from n where new = 1 group by doc_id""")
def semantic_path(t: Tables) -> DataFrame:
    """The transitions of categories through a document."""
    from gleanery.operators.layout import first_rule

    rows = t.lines().select("doc_id", "pos", first_rule(F.col("line"), CATEGORY_RULES, "OTHER").alias("category"))
    new = ~F.col("category").eqNullSafe(F.lag("category").over(Window.partitionBy("doc_id").orderBy("pos")))
    held = F.array_sort(F.collect_list(F.struct("pos", "category")))
    return rows.withColumn("new", new).filter("new").groupBy("doc_id").agg(F.array_join(F.transform(held, lambda x: x["category"]), " > ").alias("path"))


@query(f"with {LINES}, o as (select doc_id, pos, line, {CATEGORY_SQL} as category from lines) select doc_id || '-' || pos as object_id, doc_id, category, length(line) as n_chars, case when category = 'CONTACT' then 0.5 else 1.0 end::double as boost from o where category <> 'LEGAL' and trim(line, ' ') <> ''")
def row_shapes(t: Tables) -> DataFrame:
    """Object rows for the index; those that are not to be indexed go."""
    from gleanery.operators.layout import first_rule

    rows = t.lines().withColumn("category", first_rule(F.col("line"), CATEGORY_RULES, "OTHER")).filter((F.col("category") != "LEGAL") & (F.trim("line") != ""))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("pos").cast("string")).alias("object_id"), "doc_id", "category", F.length("line").alias("n_chars"), F.when(F.col("category") == "CONTACT", 0.5).otherwise(1.0).alias("boost"))


@query("select l_orderkey, l_linenumber, 5.0::double as ce_score, 'MAYBE' as verdict, 0.5::double as confidence, 'RELATED' as evidence, 10.0::double as rerank_score from lineitem")
def plugin_fallbacks(t: Tables) -> DataFrame:
    """Scores and labels without any model: logit 0, MAYBE at 0.5, RELATED, the bypassed rerank score."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("text"))
    out = P.bypassed(P.classified(P.verified(P.cross_encoded(rows))))
    return out.select("l_orderkey", "l_linenumber", "ce_score", "verdict", "confidence", "evidence", "rerank_score")


@query("select l_orderkey, l_linenumber, case when l_quantity > 25 then 'YES' else 'MAYBE' end as verdict, round(10 / (1 + exp(-(l_discount * 10))), 6)::double as ce_score from lineitem")
def plugin_models(t: Tables) -> DataFrame:
    """The same points with models given: any function over pandas batches."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_discount").alias("x"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("text"))
    scored = P.cross_encoded(rows, lambda batch: batch["x"] * 10)
    out = P.verified(scored, lambda batch: batch["q"].gt(25).map({True: "YES", False: None}))
    return out.select("l_orderkey", "l_linenumber", "verdict", F.round("ce_score", 6).alias("ce_score"))


HITS_SQL = """h as (select l_suppkey as query_id, l_orderkey // 100 as page_start, l_orderkey // 100 + l_linenumber % 3 as page_end, l_linenumber as position, l_orderkey * 10 + l_linenumber as chunk_id, l_discount as confidence, case when l_quantity > 45 then 'YES' when l_quantity > 10 then 'MAYBE' else 'NO' end as verdict,
 case l_returnflag when 'A' then 'bm25' when 'N' then 'vector' else 'literal' end as source, case when l_tax > 0.02 then 'span ' || l_partkey end as match_span, l_tax as highlight_score, 'text ' || (l_partkey % 50) as text from lineitem)"""


def verdict_hits(t: Tables) -> DataFrame:
    page = F.expr("l_orderkey div 100")
    return t.lineitem.select(
        F.col("l_suppkey").alias("query_id"), page.alias("page_start"), (page + F.col("l_linenumber") % 3).alias("page_end"), F.col("l_linenumber").alias("position"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_discount").alias("confidence"),
        F.when(F.col("l_quantity") > 45, "YES").when(F.col("l_quantity") > 10, "MAYBE").otherwise("NO").alias("verdict"), F.when(F.col("l_returnflag") == "A", "bm25").when(F.col("l_returnflag") == "N", "vector").otherwise("literal").alias("source"),
        F.when(F.col("l_tax") > 0.02, F.concat(F.lit("span "), F.col("l_partkey").cast("string"))).alias("match_span"), F.col("l_tax").alias("highlight_score"), F.concat(F.lit("text "), (F.col("l_partkey") % 50).cast("string")).alias("text"),
    )


@query(f"with {HITS_SQL} select query_id, verdict, count(*) as n, max(confidence)::double as best from h where verdict in ('YES', 'MAYBE') group by 1, 2")
def accept_filter(t: Tables) -> DataFrame:
    """Only YES and MAYBE go on."""
    return verdict_hits(t).filter(F.col("verdict").isin("YES", "MAYBE")).groupBy("query_id", "verdict").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


@query(f"""with {HITS_SQL}, a as (select * from h where verdict <> 'NO'), o as (select *, row_number() over (partition by query_id, page_start order by position, confidence desc, chunk_id, text) as r from a),
x as (select query_id, page_start, text, min(r) as r from o group by 1, 2, 3), y as (select query_id, page_start, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by r) as text from x group by 1, 2),
s as (select query_id, page_start, match_span from (select *, row_number() over (partition by query_id, page_start order by (match_span is not null) desc, highlight_score desc, chunk_id, match_span desc) as k from o) where k = 1)
select query_id, page_start, max(page_end) as page_end, round(max(confidence), 3)::double as confidence, case when bool_or(verdict = 'YES') then 'YES' else 'MAYBE' end as verdict, string_agg(chunk_id::varchar, ',' order by r) as chunk_ids, string_agg(distinct source, ',' order by source) as sources, any_value(s.match_span) as match_span, any_value(y.text) as text
from o join y using (query_id, page_start) join s using (query_id, page_start) group by 1, 2""")
def group_rollup(t: Tables) -> DataFrame:
    """Accepted hits of one page as one: range, any YES, ordered ids, sources, the best span, distinct texts."""
    accepted = verdict_hits(t).filter("verdict <> 'NO'").withColumn("page", F.col("page_start"))
    return S.rolled_up(accepted, ["query_id", "page"]).drop("page")


MOST_ASKED_TEXTS = 2000


@query(f"""with {CL.FACTS_SQL}, p as (select a.note_id as query_id, b.note_id, lower(a.text) as x, lower(b.text) as y, len(list_intersect(a.drug, b.drug)) + len(list_intersect(a.endpoint, b.endpoint)) as terms, list_distinct({tokens_sql("a.text")}) as u, list_distinct({tokens_sql("b.text")}) as v from facts a join facts b on a.brand = b.brand and a.note_id % 20 = 0 and a.note_id <> b.note_id)
select query_id, note_id, round(case when contains(y, x) then 0.90 when contains(replace(y, ' ', ''), replace(x, ' ', '')) then 0.89 else greatest(case when terms > 0 then least(0.60 + 0.1 * (terms - 1), 0.80) else 0.0 end, least(0.39 * len(list_intersect(u, v)) / len(u), 0.39)) end, 6)::double as score from p""")
def span_scorers(t: Tables) -> DataFrame:
    """Best span score of each candidate: exact, without white space, shared terms, shared tokens."""
    squeeze = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    terms = F.size(F.array_intersect("a.drug", "b.drug")) + F.size(F.array_intersect("a.endpoint", "b.endpoint"))
    score = lambda low, tight, words: S.span_score(F.contains(low("b"), low("a")), F.contains(tight("b"), tight("a")), terms, containment(words("a"), words("b")))
    # What an asked note can't have in common with another one makes no difference: asked texts and tokens are the words to look for.
    texts = CL.notes(t).filter("note_id % 20 = 0").select(F.lower("text").alias("x")).distinct().limit(MOST_ASKED_TEXTS + 1)
    asked = [r["x"] for r in texts.collect() if r["x"] is not None]
    if len(asked) <= MOST_ASKED_TEXTS and not any("|" in x for x in asked):
        wanted = sorted({w for r in t.spark.createDataFrame([(x,) for x in asked], "x string").select(tokens(F.col("x")).alias("w")).collect() for w in r["w"]})
        low, words = F.lower("text"), F.array_distinct(tokens(F.col("text")))
        own = CL.fields("drug", "endpoint")
        a = own | {"low": low, "tight": squeeze(low), "words": words}
        b = own | {"low": digest(low, asked), "tight": digest(squeeze(low), sorted({x.replace(" ", "") for x in asked})), "words": F.array_sort(F.array_intersect(words, F.array(*map(F.lit, wanted)).cast("array<string>")))}
        of = lambda n: lambda s: F.col(f"{s}.{n}")
        held = CL.classes(t, Factor(a, b, [F.round(score(of("low"), of("tight"), of("words")), 6)]))
        if held.known:
            return held.pairs(lambda v: iter([{"score": v[0][0]}]), "score double")
    low = lambda s: F.lower(F.col(f"{s}.text"))
    out = score(low, lambda s: squeeze(low(s)), lambda s: F.array_distinct(tokens(F.col(f"{s}.text"))))
    return CL.pairs(t).select(F.col("a.note_id").alias("query_id"), F.col("b.note_id").alias("note_id"), F.round(out, 6).alias("score"))


@query(f"""with {LINES}, m as (select item_id, doc_id, list_distinct({tokens_sql("b.text")}) as u from benchmark b join documents d on contains(d.text, b.text)),
s as (select item_id, m.doc_id, pos, len(list_intersect(u, {tokens_sql("line")})) / len(u) as share from m join lines using (doc_id))
select item_id, doc_id, pos::int as pos, round(share, 6)::double as share from (select *, row_number() over (partition by item_id, doc_id order by share desc, pos) as r from s) where r = 1""")
def best_line_by_containment(t: Tables) -> DataFrame:
    """The legacy span: of a matching document the line that holds most of the item's tokens."""
    from gleanery.plans.retrieval import asked

    hits = retrieve.literal(asked(t), t.documents.select("doc_id", "text")).select("query_id", "doc_id")
    rows = hits.join(asked(t).select("query_id", F.array_distinct(tokens(F.col("text"))).alias("u")), "query_id").join(t.lines(), "doc_id")
    rows = rows.withColumn("share", containment(F.col("u"), tokens(F.col("line"))))
    best = F.max_by(F.struct("pos", "share"), F.struct("share", F.negative("pos")))
    return rows.groupBy(F.col("query_id").alias("item_id"), "doc_id").agg(best.alias("b")).select("item_id", "doc_id", "b.pos", F.round("b.share", 6).alias("share"))


@query("select count(distinct l_orderkey) as searched, count(*) as hits, count_if(l_discount >= 0.08) as direct, count_if(l_discount between 0.05 and 0.07) as same_study, count_if(l_discount < 0.02) as background, count_if(l_returnflag = 'R') as rejected from lineitem")
def run_summary(t: Tables) -> DataFrame:
    d = F.col("l_discount")
    return t.lineitem.agg(F.countDistinct("l_orderkey").alias("searched"), F.count("*").alias("hits"), F.count_if(d >= 0.08).alias("direct"), F.count_if(d.between(0.05, 0.07)).alias("same_study"), F.count_if(d < 0.02).alias("background"), F.count_if(F.col("l_returnflag") == "R").alias("rejected"))


@query("""with r as (select o_orderstatus as run, o_orderkey, o_totalprice as score, o_orderpriority as kind from orders), b as (select run, kind, count(*) as n, round(avg(score), 2)::double as mean_score, round(max(score), 2)::double as best from r group by 1, 2)
select run, kind, n, mean_score, best, round(100 * n / sum(n) over (partition by run), 4)::double as percent, rank() over (partition by run order by n desc, kind)::int as place from b""")
def run_report(t: Tables) -> DataFrame:
    """Metrics of each run by kind, ranked, with their share."""
    b = t.orders.groupBy(F.col("o_orderstatus").alias("run"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_score"), F.round(F.max("o_totalprice"), 2).alias("best"))
    run = Window.partitionBy("run")
    return b.select("run", "kind", "n", "mean_score", "best", F.round(100 * F.col("n") / F.sum("n").over(run), 4).alias("percent"), F.rank().over(run.orderBy(F.desc("n"), "kind")).alias("place"))


@query("""select query_id, note_id, drug_score, fact_score, place from (select a_note_id as query_id, b_note_id as note_id, round(d, 3)::double as drug_score, round(f, 3)::double as fact_score, row_number() over (partition by a_note_id order by d + f desc, b_note_id)::int as place from scored) where place <= 10""".join((f"with {CL.PAIRS_SQL}, {CL.SCORED_SQL} ", "")))
def ranked_score_table(t: Tables) -> DataFrame:
    """The ten best candidates of each query with their component scores."""
    s = CL.scores()
    held = CL.classes(t, Factor(*CL.score_fields(), [s["d"], s["f"]]))
    if held.known:
        rows = held.best(lambda v: v[0] + v[1], 10)
        return rows.select("query_id", "note_id", F.round(F.col("v")[0], 3).alias("drug_score"), F.round(F.col("v")[1], 3).alias("fact_score"), "place")
    rows = CL.scored(t).select(F.col("a.note_id").alias("query_id"), F.col("b.note_id").alias("note_id"), "d", "f")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.col("d") + F.col("f")), "note_id"))
    return rows.withColumn("place", place).filter("place <= 10").select("query_id", "note_id", F.round("d", 3).alias("drug_score"), F.round("f", 3).alias("fact_score"), "place")


STAGE_SQL = "st as (select o_orderkey, case when o_orderstatus = 'P' then 'MISS_RETRIEVAL' when o_totalprice < 50000 then 'MISS_RERANK' when o_orderpriority like '1%' then 'HIT_TOP1' when o_orderpriority like '2%' then 'HIT_TOP3' else 'HIT_ANY' end as stage, case o_orderkey % 5 when 0 then 'drug_mismatch (x)' when 1 then 'not_top1' when 2 then 'low_ce_score 3.1' when 3 then '' else 'odd' end as reason from orders)"
#: Categories of the reasons of a false positive.
FALSE_POSITIVES = {"drug_mismatch": "Wrong Drug", "endpoint_mismatch": "Wrong Endpoint", "phase_mismatch": "Wrong Study", "missing_relation": "Wrong Intent", "stmt_type_mismatch": "Wrong Intent", "section_mismatch": "Wrong Intent", "abbreviation_object": "Abbreviation / Definition", "missing_fact_slot": "Weak Semantic Match", "missing_section": "Wrong Intent", "missing_statement": "Wrong Intent", "low_ce_score": "Weak Semantic Match", "dropped_by_reranker": "Reranker Rejection", "not_in_candidates": "Retrieval Miss", "not_top1": "Ranked Below Top1", "ci_not_found": "Annotation Error"}
FP_SQL = "case when reason = '' then '' else coalesce(case string_split(trim(string_split(reason, '(')[1], ' '), ' ')[1] " + " ".join(f"when '{k}' then '{v}'" for k, v in FALSE_POSITIVES.items()) + " end, 'Other') end"


@query(f"with {STAGE_SQL} select stage, {FP_SQL} as category, count(*) as n from st group by all")
def stage_labels(t: Tables) -> DataFrame:
    """Where each query was lost or hit, and the category of the reason."""
    from gleanery.operators.compare import lookup

    p = F.col("o_orderpriority")
    stage = F.when(F.col("o_orderstatus") == "P", "MISS_RETRIEVAL").when(F.col("o_totalprice") < 50000, "MISS_RERANK").when(p.startswith("1"), "HIT_TOP1").when(p.startswith("2"), "HIT_TOP3").otherwise("HIT_ANY")
    k = F.col("o_orderkey") % 5
    reason = F.when(k == 0, "drug_mismatch (x)").when(k == 1, "not_top1").when(k == 2, "low_ce_score 3.1").when(k == 3, "").otherwise("odd")
    word = F.split(F.trim(F.split(reason, r"\(")[0]), " ")[0]
    category = F.when(reason == "", "").otherwise(F.coalesce(lookup(FALSE_POSITIVES, word), F.lit("Other")))
    return t.orders.groupBy(stage.alias("stage"), category.alias("category")).agg(F.count("*").alias("n"))


@query("select o_orderkey, min(place) as first_rank, min_by(priority, place) as priority from (select l_orderkey as o_orderkey, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey)::int as place, case when l_returnflag = 'A' then 1 when l_returnflag = 'N' then 2 end as priority from lineitem) where priority is not null group by 1")
def first_gold_priority(t: Tables) -> DataFrame:
    """Rank of the first gold hit; one that matches by its page only has priority 2."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), place.alias("place"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).alias("priority")).filter("priority is not null")
    return rows.groupBy("o_orderkey").agg(F.min("place").alias("first_rank"), F.min_by("priority", "place").alias("priority"))


@query("with b as (select *, (row_number() over (order by o_orderkey) - 1) // 50 as batch from orders where o_orderkey % 20 = 0) select batch, min(o_orderkey) as first_key, count(*) as n, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as keys from b group by batch")
def batches_in_order(t: Tables) -> DataFrame:
    """Asked keys in batches of 50 and back in their order; ranks by two-step prefix sums are not needed for a stated query set."""
    asked = t.orders.filter("o_orderkey % 20 = 0").select("o_orderkey")
    rows = asked.withColumn("batch", F.expr("(row_number() over (order by o_orderkey) - 1) div 50"))
    return rows.groupBy("batch").agg(F.min("o_orderkey").alias("first_key"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("keys"))


@query("select event_type, true as close from events group by event_type")
def approximate_distinct(t: Tables) -> DataFrame:
    """Approximate distinct users of each type, within 10 % of the exact count."""
    pairs = t.events.select("event_type", "user_id").distinct()  # a sketch beside a distinct count would be kept for every user
    rows = pairs.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("near"), F.count("user_id").alias("exact"))
    return rows.select("event_type", (F.abs(F.col("near") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


@query("with g(tenant, lang) as (values ('one', 'en'), ('one', 'de'), ('two', 'fr')) select tenant, source, count(*) as n, sum(n_chars)::bigint as n_chars from documents join g using (lang) group by all")
def tenant_filter(t: Tables) -> DataFrame:
    """Each tenant sees the languages that it is granted, and nothing else."""
    grants = t.spark.createDataFrame([("one", "en"), ("one", "de"), ("two", "fr")], "tenant string, lang string")
    return t.documents.join(F.broadcast(grants), "lang").groupBy("tenant", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query()
def compatibility_normalize(t: Tables) -> DataFrame:
    """Documents by Unicode compatibility composition, lower case and single spaces; the one text function without a built-in."""
    from gleanery.functions.text import nfkc, normalize

    t.spark.udf.register("nfkc", nfkc)
    return t.documents.selectExpr("doc_id", "nfkc(text) as text").select("doc_id", normalize(F.col("text")).alias("text"))


SYNONYMS = {"orr": ["overall response rate", "response rate"], "pfs": ["progression-free survival"], "sae": ["serious adverse event", "adverse event"], "hr": ["hazard ratio"]}
SYN_SQL = "sy(short, synonym) as (values " + ", ".join(f"('{k}', '{s}')" for k, v in SYNONYMS.items() for s in v) + ")"


@query(f"with {CL.NOTES_SQL}, {SYN_SQL}, x as (select note_id, short, synonym from notes join sy on contains(lower(text), synonym) or contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || short || ' ')) select note_id, string_agg(distinct term, '|' order by term) as terms from (select note_id, short as term from x union all select x.note_id, s.synonym from x join sy s using (short)) group by note_id")
def ontology_expansion(t: Tables) -> DataFrame:
    """Every synonym or abbreviation in a note brings all of its concept's names."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), F.lit(" "))
    hit = lambda k, names: sum((F.contains(F.lower("text"), F.lit(n)).cast("int") for n in names), F.contains(words, F.lit(f" {k} ")).cast("int")) > 0
    found = F.array_compact(F.array(*[F.when(hit(k, v), F.array(*map(F.lit, [k, *v]))) for k, v in SYNONYMS.items()]))
    rows = CL.notes(t).select("note_id", F.array_sort(F.array_distinct(F.flatten(found))).alias("terms")).filter(F.size("terms") > 0)
    return rows.select("note_id", F.array_join("terms", "|").alias("terms"))


@query(f"with {CL.NOTES_SQL}, {SYN_SQL}, x as (select note_id, synonym from notes join sy on contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || short || ' ')) select note_id, text || coalesce(' (' || (select string_agg(synonym, '; ' order by synonym) from x where x.note_id = n.note_id) || ')', '') as expanded from notes n")
def query_normalizer(t: Tables) -> DataFrame:
    """A query with the full forms of its abbreviations appended."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), F.lit(" "))
    full = F.array_sort(F.flatten(F.array_compact(F.array(*[F.when(F.contains(words, F.lit(f" {k} ")), F.array(*map(F.lit, v))) for k, v in SYNONYMS.items()]))))
    return CL.notes(t).select("note_id", F.when(F.size(full) > 0, F.concat("text", F.lit(" ("), F.array_join(full, "; "), F.lit(")"))).otherwise(F.col("text")).alias("expanded"))


@query("select p_type as canonical, count(distinct p_name) as n, min(p_name) as first_name from part where starts_with(p_type, 'S') or starts_with(p_type, 'E') group by 1")
def vocabulary_populate(t: Tables) -> DataFrame:
    """Names of the categories with a prefix, by canonical name."""
    rows = t.part.filter(F.col("p_type").startswith("S") | F.col("p_type").startswith("E"))
    return rows.groupBy(F.col("p_type").alias("canonical")).agg(F.countDistinct("p_name").alias("n"), F.min("p_name").alias("first_name"))


@query(f"with {CL.FACTS_SQL} select note_id, concat_ws('/', coalesce(primary_drug, '-'), coalesce(endpoint[1], '-'), coalesce(line, '-'), coalesce({CL.first_sql(CL.C.DISEASE_SHORT)}, '-')) as signature, case when len(population) = 0 and primary_drug is not null then 'multiple myeloma' else array_to_string(population, '|') end as population, case when primary_drug is not null and len(endpoint) > 0 then 0.5 end::double as relation_confidence from facts")
def ci_enrichment(t: Tables) -> DataFrame:
    """A query's signature, its disease from its drug where none is named, and an inferred relation at 0.5."""
    rows, none = CL.with_facts(t), F.lit("-")
    short = CL.C.first_match(F.col("text"), CL.C.DISEASE_SHORT)
    return rows.select(
        "note_id", F.concat_ws("/", F.coalesce("primary_drug", none), F.coalesce(F.get("endpoint", 0), none), F.coalesce("line", none), F.coalesce(short, none)).alias("signature"),
        F.when((F.size("population") == 0) & F.col("primary_drug").isNotNull(), "multiple myeloma").otherwise(F.array_join("population", "|")).alias("population"), F.when(F.col("primary_drug").isNotNull() & (F.size("endpoint") > 0), 0.5).alias("relation_confidence"),
    )


VERBS = ["given", "evaluate", "monitored", "selected", "used", "showed", "randomized"]
VERB = r"\b(" + "|".join(VERBS) + r")\b"


@query(f"""with {CL.NOTES_SQL}, s as (select note_id, unnest(string_split(regexp_replace(lower(text), '([.;]) ', '\\1' || chr(1), 'g'), chr(1))) as sentence from notes),
e as (select note_id, sentence, regexp_extract(sentence, '{CL.WORDS["drug"]}', 1) as subject, regexp_extract(sentence, '{VERB}', 1) as verb, coalesce(nullif(regexp_extract(sentence, '{CL.WORDS["endpoint"]}', 1), ''), nullif(regexp_extract(sentence, '{CL.WORDS["dose"]}', 1), ''), nullif(regexp_extract(sentence, '{CL.WORDS["study_arm"]}', 1), '')) as object from s)
select note_id, subject, verb, object, abs(len(string_split(left(sentence, position(subject in sentence) - 1), ' ')) - len(string_split(left(sentence, position(object in sentence) - 1), ' ')))::int as distance, case when abs(len(string_split(left(sentence, position(subject in sentence) - 1), ' ')) - len(string_split(left(sentence, position(object in sentence) - 1), ' '))) <= 5 then 0.40 else 0.25 end::double as confidence
from e where subject <> '' and verb <> '' and object is not null""")
def same_sentence_relations(t: Tables) -> DataFrame:
    """Drug and object of one sentence with its verb, surer the fewer words lie between; stands for the parser that is not there."""
    parts = F.split(F.regexp_replace(F.lower("text"), "([.;]) ", F.concat(F.lit("$1"), F.lit("\u0001"))), "\u0001")
    rows = CL.notes(t).select("note_id", F.explode(parts).alias("sentence"))
    first = lambda p: CL.C.first_match(F.col("sentence"), p)
    rows = rows.withColumns({"subject": first(CL.WORDS["drug"]), "verb": first(VERB), "object": F.coalesce(first(CL.WORDS["endpoint"]), first(CL.WORDS["dose"]), first(CL.WORDS["study_arm"]))}).dropna(subset=["subject", "verb", "object"])
    at = lambda c: F.size(F.split(F.expr(f"left(sentence, locate({c}, sentence) - 1)"), " "))
    rows = rows.withColumn("distance", F.abs(at("subject") - at("object")))
    return rows.select("note_id", "subject", "verb", "object", "distance", F.when(F.col("distance") <= 5, 0.40).otherwise(0.25).alias("confidence"))
