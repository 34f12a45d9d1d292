"""Text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.plans.registry import Tables, query, tokens_sql

STOPS = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"


@query(f"""with n as (select doc_id, trim(regexp_replace(lower(text), '[\\x00-\\x20\\x7f]+', ' ', 'g')) as t, {tokens_sql("text")} as ts from documents)
select doc_id, length(t)::int as n_chars, len(ts)::int as n_tokens, len(list_distinct(ts))::int as n_distinct, md5(t) as digest from n""")
def normalize_tokens(t: Tables) -> DataFrame:
    n = t.documents.select("doc_id", X.normalize(F.col("text")).alias("t"), X.tokens(F.col("text")).alias("ts"))
    return n.select("doc_id", F.length("t").alias("n_chars"), F.size("ts").alias("n_tokens"), F.size(F.array_distinct("ts")).alias("n_distinct"), F.md5("t").alias("digest"))


@query("""with s as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as ss from documents)
select doc_id, len(ss)::int as n_sentences, list_max(list_transform(ss, lambda x: length(x)))::int as longest, ss[1] as first from s""")
def sentence_split(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", X.sentences(F.col("text")).alias("ss"))
    return s.select("doc_id", F.size("ss").alias("n_sentences"), F.array_max(F.transform("ss", F.length)).alias("longest"), F.get("ss", F.lit(0)).alias("first"))


#: Short forms looked for as whole words, with what they stand for.
SHORT_FORMS = {"MIT": "license", "GNU": "license", "BY": "license", "CC": "license", "The": "article", "Der": "article", "Les": "article"}


@query("""with v(form, kind) as (values ('MIT', 'license'), ('GNU', 'license'), ('BY', 'license'), ('CC', 'license'), ('The', 'article'), ('Der', 'article'), ('Les', 'article')),
w as (select doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) as form from documents)
select form, kind, count(*) as n, count(distinct doc_id) as n_docs from w join v using (form) group by form, kind""")
def abbreviation_counts(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(sorted(SHORT_FORMS.items()), "form string, kind string")
    words = t.documents.select("doc_id", F.explode(F.split("text", "[^A-Za-z0-9]+")).alias("form"))
    return words.join(F.broadcast(table), "form").groupBy("form", "kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"""with k as (select item_id, {tokens_sql("text")} as ts from benchmark), f as (select item_id, ts, list_filter(ts, lambda x: length(x) > 1 and x not in {STOPS}) as fs from k),
u as (select item_id, unnest(case when len(fs) > 0 then fs else ts end) as term from f)
select item_id, term, round(count(*) / sum(count(*)) over (partition by item_id), 6)::double as weight from u group by item_id, term""")
def sparse_tf(t: Tables) -> DataFrame:
    terms = t.benchmark.select("item_id", F.explode(X.content_tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return terms.select("item_id", "term", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("item_id")), 6).alias("weight"))


@query("""select doc_id, left(text, 200) as snippet, case when position('@' in text) > 0 then substring(text, greatest(position('@' in text) - 80, 1), position('@' in text) + 80 - greatest(position('@' in text) - 80, 1) + 1) end as hit from documents""")
def snippet_window(t: Tables) -> DataFrame:
    place = F.expr("locate('@', text)")
    return t.documents.select("doc_id", F.left("text", F.lit(200)).alias("snippet"), F.when(place > 0, X.around(F.col("text"), place, 80)).alias("hit"))


@query(f"""with p as (select item_id, {tokens_sql("text")} as ts from benchmark), r as (select item_id, ts[3] as anchor, '(?i)' || array_to_string(ts[1:4], '[^a-zA-Z0-9]+') as pattern from p)
select item_id, doc_id from r, documents d where contains(lower(text), anchor) and regexp_matches(text, pattern)""")
def flexible_pattern_match(t: Tables) -> DataFrame:
    """Documents that match an item's first four tokens with any separators; joined on the third token first."""
    wanted = t.benchmark.select("item_id", F.element_at(X.tokens(F.col("text")), 3).alias("token"), X.flexible_pattern(F.col("text"), 4).alias("pattern"))
    held = t.documents.select("doc_id", "text", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))
    return held.join(F.broadcast(wanted), "token").filter(F.expr("text rlike pattern")).select("item_id", "doc_id")


SIGNALS = ["[0-9]", "[,;:]", r"\n", "[A-Z]{2}", r"[(\[]", "(?i)not|never|without", "(?i)than|versus", "[.!?].*[.!?]"]


@query(f"""with s as (select item_id, len({tokens_sql("text")}) as n, regexp_matches(text, '[0-9]')::int + regexp_matches(text, '[,;:]')::int + contains(text, chr(10))::int + regexp_matches(text, '[A-Z][A-Z]')::int + regexp_matches(text, '[(\\[]')::int
  + regexp_matches(text, '(?i)not|never|without')::int + regexp_matches(text, '(?i)than|versus')::int + regexp_matches(text, '[.!?].*[.!?]')::int as signals from benchmark),
k as (select item_id, signals + (n > 25)::int as score from s)
select item_id, score, case when score <= 1 then 'Easy' when score <= 3 then 'Medium' when score <= 5 then 'Hard' else 'Impossible' end as level from k""")
def difficulty_score(t: Tables) -> DataFrame:
    score = sum((F.col("text").rlike(p).cast("int") for p in SIGNALS), F.lit(0)) + (F.size(X.tokens(F.col("text"))) > 25).cast("int")
    rows = t.benchmark.select("item_id", score.alias("score"))
    return rows.withColumn("level", F.when(F.col("score") <= 1, "Easy").when(F.col("score") <= 3, "Medium").when(F.col("score") <= 5, "Hard").otherwise("Impossible"))


@query("select doc_id, length(regexp_replace(text, '^[0-9.]+[ \\t\\n\\f\\r]+', ''))::int as n, regexp_replace('c' || doc_id || '_obj_0001_s' || (doc_id % 7), '_s[0-9]+$', '') as base from documents")
def id_and_heading_strip(t: Tables) -> DataFrame:
    made = F.concat(F.lit("c"), F.col("doc_id"), F.lit("_obj_0001_s"), F.col("doc_id") % 7)
    return t.documents.select("doc_id", F.length(X.strip_heading_number(F.col("text"))).alias("n"), X.base_object_id(made).alias("base"))


@query("""select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 5) as cosine,
round(1 / (1 + exp(-3 * list_dot_product(a.embedding::double[], b.embedding::double[]))), 5) as chance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def vector_cosine(t: Tables) -> DataFrame:
    a, b = t.embeddings.select("vec_id", F.col("embedding").alias("x")), t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    both = a.join(b, "vec_id")
    return both.select("vec_id", F.round(X.cosine(F.col("x"), F.col("y")), 5).alias("cosine"), F.round(X.sigmoid(3 * X.dot(F.col("x"), F.col("y"))), 5).alias("chance"))


@query("""with b as (select l_orderkey, l_linenumber, l_quantity as x0, l_tax * 100 as y0, l_quantity + 10 as x1, l_tax * 100 + 5 as y1 from lineitem),
p as (select a.l_orderkey, a.l_linenumber as a, b.l_linenumber as b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as i from b a join b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber)
select l_orderkey, a, b, round(i / (100 - i), 6) as iou from p where i > 0""")
def box_iou(t: Tables) -> DataFrame:
    """Overlap of boxes on the same page: line items as boxes of an order."""
    corner = [F.col("l_quantity"), F.col("l_tax") * 100]
    box = F.struct(corner[0].alias("x0"), corner[1].alias("y0"), (corner[0] + 10).alias("x1"), (corner[1] + 5).alias("y1"))
    side = lambda n: t.lineitem.select("l_orderkey", F.col("l_linenumber").alias(n), box.alias(f"{n}_box"))
    of = lambda n: [F.col(f"{n}_box.{k}") for k in ("x0", "y0", "x1", "y1")]
    both = side("a").join(side("b"), "l_orderkey").filter("a < b").withColumn("iou", F.round(X.box_overlap(of("a"), of("b")), 6))
    return both.filter("iou > 0").select("l_orderkey", "a", "b", "iou")
