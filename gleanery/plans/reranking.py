"""Rerank, gate and merge queries. Candidates are lines of orders, their features numbers of those; text features come from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import gates as G
from gleanery.operators import rerank as K
from gleanery.plans import fusion
from gleanery.plans.registry import Tables, query

#: Weights of the features by type of query.
PROFILES = {"A": {"quantity": 0.5, "price": 0.3, "discount": 0.2}, "N": {"quantity": 0.2, "price": 0.6, "discount": 0.2}, "R": {"quantity": 0.3, "price": 0.3, "discount": 0.4}}
SCORE_SQL = """sc as (select l_orderkey as query_id, l_linenumber as doc_id, l_suppkey as supplier, l_partkey as part, l_returnflag as kind, l_discount as discount, l_tax as tax,
 round(greatest(0, least(case l_returnflag when 'A' then 0.5 when 'N' then 0.2 else 0.3 end * (l_quantity / 5) + case l_returnflag when 'N' then 0.6 else 0.3 end * (floor(l_extendedprice / 1000) / 10) + case l_returnflag when 'R' then 0.4 else 0.2 end * (l_discount * 100) + 0.5 * (l_linestatus = 'O')::int, 10)), 4) as score from lineitem)"""


def candidates(t: Tables) -> DataFrame:
    features = {"quantity": F.col("l_quantity") / 5, "price": F.floor(F.col("l_extendedprice") / 1000) / 10, "discount": F.col("l_discount") * 100}
    profiles = t.spark.createDataFrame([(k, *v.values()) for k, v in PROFILES.items()], "l_returnflag string, w_quantity double, w_price double, w_discount double")
    extra = 0.5 * (F.col("l_linestatus") == "O").cast("int")
    weighted = {n: F.col(f"w_{n}") * c for n, c in features.items()}
    score = K.composite(weighted, dict.fromkeys(features, 1.0), extra)
    rows = t.lineitem.join(F.broadcast(profiles), "l_returnflag")
    return rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("doc_id"), F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.round(score, 4).alias("score"))


@query(f"with {SCORE_SQL} select query_id, doc_id, score::double as score from sc")
def composite_score(t: Tables) -> DataFrame:
    return candidates(t).select("query_id", "doc_id", "score")


@query(f"with {SCORE_SQL} select kind, count(*) as n, round(avg(score), 4)::double as mean_score, max(score)::double as best from sc group by kind")
def profile_weights(t: Tables) -> DataFrame:
    return candidates(t).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.max("score").alias("best"))


@query("""with s as (select s_suppkey, s_nationkey as nation, n_regionkey as region from supplier join nation on n_nationkey = s_nationkey)
select a.s_suppkey as a, b.s_suppkey as b, case when a.s_suppkey = b.s_suppkey then 'EXACT' when a.nation = b.nation then 'SAME_FAMILY' when a.region = b.region then 'RELATED' else 'DIFFERENT' end as relation,
case when a.s_suppkey = b.s_suppkey then 0.0 when a.nation = b.nation then -0.18 when a.region = b.region then -0.25 else -0.35 end::double as weight from s a join s b on a.region = b.region and a.s_suppkey % 20 = 0""")
def drug_relation_graph(t: Tables) -> DataFrame:
    """Relation of asked names (ids divisible by 20) to all of their region in a family tree, closest first, and its weight; names of other regions are DIFFERENT."""
    s = t.supplier.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    a, b = s.filter("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("a"), F.col("nation").alias("na"), "region"), s.select(F.col("s_suppkey").alias("b"), F.col("nation").alias("nb"), "region")
    relation = F.when(F.col("a") == F.col("b"), "EXACT").when(F.col("na") == F.col("nb"), "SAME_FAMILY").otherwise("RELATED")
    from gleanery.operators.fuse import mapped

    return a.join(b, "region").select("a", "b", relation.alias("relation")).withColumn("weight", mapped(K.RELATION_WEIGHTS, F.col("relation"), 0.0))


@query(rf"""with {fusion.HITS_SQL}, p as (select distinct query_id, doc_id from hits),
a as (select query_id, doc_id, list_distinct(regexp_extract_all(b.text, '[0-9]+')) as x, list_distinct(regexp_extract_all(d.text, '[0-9]+')) as y from p join benchmark b on item_id = query_id join documents d using (doc_id))
select query_id, doc_id, round(case when len(x) = 0 then 5 when len(y) = 0 then 4 when len(list_intersect(x, y)) = 0 then 0 else 4 + 6 * len(list_intersect(x, y)) / len(x) end, 6)::double as score from a""")
def study_id_score(t: Tables) -> DataFrame:
    """Every item's fused candidates, by the identifiers that both texts have."""
    ids = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))
    rows = fusion.hits(t).select("query_id", "doc_id").distinct()
    rows = rows.join(t.benchmark.select(F.col("item_id").alias("query_id"), ids("text").alias("x")), "query_id").join(t.documents.select("doc_id", ids("text").alias("y")), "doc_id")
    return rows.select("query_id", "doc_id", F.round(K.study_score(F.col("x"), F.col("y")), 6).alias("score"))


@query("select l_orderkey, l_linenumber, round(greatest(0, 0.3 * (1 - greatest(0.2 - l_quantity / 50, l_quantity / 50 - 0.6, 0) / 0.3)), 6)::double as bonus from lineitem")
def position_bonus(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(K.position_bonus(F.col("l_quantity") / 50, 0.2, 0.6), 6).alias("bonus"))


KIND = "case event_type when 'click' then 'count' when 'view' then 'p' when 'error' then 'share' else 'ratio' end"


@query(f"""with e as (select event_id, user_id, {KIND} as kind, value, (props->>'$.k')::int as k from events)
select a.event_id as a, b.event_id as b, a.kind from e a join e b on a.user_id = b.user_id and a.kind = b.kind and a.k = b.k and a.event_id <> b.event_id and a.event_id % 20 = 0
where case a.kind when 'count' then abs(a.value - b.value) = 0 when 'p' then abs(a.value - b.value) <= 5e-5 when 'share' then abs(a.value - b.value) <= 0.5 else abs(a.value - b.value) <= 0.015 * abs(a.value) end""")
def tolerance_match(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "count").when(F.col("event_type") == "view", "p").when(F.col("event_type") == "error", "share").otherwise("ratio")
    e = t.events.select("event_id", "user_id", kind.alias("kind"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    a, b = e.select(F.col("event_id").alias("a"), "user_id", "kind", "k", F.col("value").alias("x")), e.select(F.col("event_id").alias("b"), "user_id", "kind", "k", F.col("value").alias("y"))
    return a.join(b, ["user_id", "kind", "k"]).filter("a % 20 = 0 and a <> b").filter(K.within(F.col("x"), F.col("y"), F.col("kind"))).select("a", "b", "kind")


OUTCOME_SQL = "oc as (select *, case when discount = 0 then 'UNKNOWN' when discount <= 0.02 then 'MATCH' when discount <= 0.04 then 'RELATED' when discount <= 0.06 then 'SPECIALIZATION' when discount <= 0.08 then 'GENERALIZATION' else 'CONFLICT' end as drug, case when tax >= 0.07 then 'CONFLICT' else 'MATCH' end as endpoint, case when part % 7 = 0 then 'CONFLICT' else 'MATCH' end as phase from sc)"


def compared(t: Tables) -> DataFrame:
    d = F.col("discount")
    drug = F.when(d == 0, "UNKNOWN").when(d <= 0.02, "MATCH").when(d <= 0.04, "RELATED").when(d <= 0.06, "SPECIALIZATION").when(d <= 0.08, "GENERALIZATION").otherwise("CONFLICT")
    return candidates(t).withColumns({"drug": drug, "endpoint": F.when(F.col("tax") >= 0.07, "CONFLICT").otherwise("MATCH"), "phase": F.when(F.col("part") % 7 == 0, "CONFLICT").otherwise("MATCH")})


@query(f"with {SCORE_SQL}, {OUTCOME_SQL} select drug, endpoint, phase, count(*) as n from oc group by all")
def comparator_outcomes(t: Tables) -> DataFrame:
    return compared(t).groupBy("drug", "endpoint", "phase").agg(F.count("*").alias("n"))


SEVERE_SQL = "sv as (select *, (drug = 'CONFLICT')::int + (endpoint = 'CONFLICT')::int + (phase = 'CONFLICT')::int as n, case when drug = 'CONFLICT' then 'HIGH' when endpoint = 'CONFLICT' then 'MEDIUM' when phase = 'CONFLICT' then 'LOW' else 'NONE' end as own from oc), se as (select *, case when drug = 'CONFLICT' and endpoint = 'CONFLICT' then 'FATAL' when n >= 3 then 'HIGH' when n = 2 and own <> 'HIGH' then 'MEDIUM' when n >= 1 then own else 'NONE' end as severity from sv)"


@query(f"with {SCORE_SQL}, {OUTCOME_SQL}, {SEVERE_SQL} select query_id, doc_id, severity, (case severity when 'FATAL' then least(score, 3.0) when 'HIGH' then least(score, 4.2) when 'MEDIUM' then least(score, 6.5) else score end)::double as score from se")
def severity_veto(t: Tables) -> DataFrame:
    bad = {c: (F.col(c) == "CONFLICT") for c in ("drug", "endpoint", "phase")}
    n = sum((b.cast("int") for b in bad.values()), F.lit(0))
    own = F.when(bad["drug"], "HIGH").when(bad["endpoint"], "MEDIUM").when(bad["phase"], "LOW").otherwise("NONE")
    rows = compared(t).withColumn("severity", K.severity_of(n, bad["drug"] & bad["endpoint"], own))
    return rows.select("query_id", "doc_id", "severity", K.capped(F.col("score"), F.col("severity")).alias("score"))


@query(f"with {SCORE_SQL}, r as (select query_id, doc_id, score::double as score, sum((score >= 8)::int) over (partition by query_id) as above, row_number() over (partition by query_id order by score desc, doc_id)::int as place from sc) select query_id, doc_id, score, place from r where case when above > 0 then score >= 8 and place <= 100 else place <= 3 end")
def rerank_cap(t: Tables) -> DataFrame:
    return K.kept(candidates(t), "query_id", "score", 8.0, 3).select("query_id", "doc_id", "score", "place")


@query(f"with {SCORE_SQL} select kind, " + ", ".join(f"count_if(score >= {m}) as ge_{m}" for m in K.MARGINS) + " from sc group by kind")
def score_histogram(t: Tables) -> DataFrame:
    return K.histogram(candidates(t), "score", ["kind"])


@query(rf"""with {fusion.HITS_SQL}, p as (select distinct query_id, doc_id from hits),
a as (select query_id, doc_id, regexp_extract(b.text, '[0-9]+', 0) as n, d.text from p join benchmark b on item_id = query_id join documents d using (doc_id))
select query_id, doc_id, n, n = '' or regexp_matches(text, '(^|[^0-9.])' || n || '([^0-9]|$)') as passes from a""")
def numeric_gate(t: Tables) -> DataFrame:
    """Fused candidates: one passes if its text has the item's number as a number of its own; items without one let all pass."""
    rows = fusion.hits(t).select("query_id", "doc_id").distinct()
    rows = rows.join(t.benchmark.select(F.col("item_id").alias("query_id"), F.regexp_extract("text", "[0-9]+", 0).alias("n")), "query_id").join(t.documents.select("doc_id", "text"), "doc_id")
    found = F.rlike("text", F.concat(F.lit("(^|[^0-9.])"), "n", F.lit("([^0-9]|$)")))
    return rows.select("query_id", "doc_id", "n", ((F.col("n") == "") | found).alias("passes"))


@query(f"with {SCORE_SQL} select query_id, supplier, doc_id, score::double as score from (select *, row_number() over (partition by query_id, supplier order by score desc, doc_id) as r from sc) where r = 1")
def best_per_chunk(t: Tables) -> DataFrame:
    return G.best_per(candidates(t), ["query_id", "supplier"], F.desc("score"), "doc_id").select("query_id", "supplier", "doc_id", "score")


CONFIDENCE_SQL = "cf as (select *, round(0.5 * least(greatest(2 * score / 20, 0), 1) + 0.3 * greatest(0, 1 + (case when tax = 0 then -0.4 else 0 end) / 0.4) + 0.2 * greatest(0, 1 + (case when discount = 0 then -0.25 else 0 end) / 0.25), 6)::double as confidence from sc)"


def confident(t: Tables) -> DataFrame:
    identity, enrichment = F.when(F.col("tax") == 0, -0.4).otherwise(0.0), F.when(F.col("discount") == 0, -0.25).otherwise(0.0)
    return candidates(t).withColumn("confidence", F.round(G.candidate_confidence(F.col("score") / 20, identity, enrichment), 6))


@query(f"with {SCORE_SQL}, {CONFIDENCE_SQL} select query_id, doc_id, confidence, case when confidence >= 0.2 then 'MAYBE' else 'NO' end as verdict from cf")
def confidence_gate(t: Tables) -> DataFrame:
    """Verification offline says MAYBE; gated candidates stay with NO."""
    return confident(t).select("query_id", "doc_id", "confidence", F.when(F.col("confidence") >= G.LEAST_CONFIDENCE, "MAYBE").otherwise("NO").alias("verdict"))


@query(f"""with {fusion.R.LITERAL_SQL}, o as (select query_id, doc_id, b.text as phrase, string_split(d.text, b.text) as ps, unnest(range(len(string_split(d.text, b.text)) - 1)) as i from lit join benchmark b on item_id = query_id join documents d using (doc_id)),
s as (select query_id as item_id, doc_id, (list_sum(list_transform(ps[1:i + 1], lambda x: length(x))) + i * length(phrase))::int as char_start, length(phrase) as n from o)
select item_id, doc_id, char_start, (char_start + n)::int as char_end, 1.0::double as score from s""")
def highlight_offsets(t: Tables) -> DataFrame:
    """Every verbatim place of an item's candidates, scored by the base of an exact match in the passage's own text."""
    rows = fusion.R.literal_offsets(t)
    return rows.select(F.col("query_id").alias("item_id"), "doc_id", "char_start", "char_end", G.highlight_score(F.lit(True), F.lit(True)).alias("score"))


@query("""with p as (select l_suppkey as query_id, l_orderkey as id, l_linenumber as line, l_orderkey // 100 as a, l_orderkey // 100 + l_linenumber % 3 as b, l_discount as c from lineitem),
f as (select *, case when a <= lag(b) over w + 1 then 0 else 1 end as new from p window w as (partition by query_id order by a, id, line)), g as (select *, sum(new) over (partition by query_id order by a, id, line rows unbounded preceding) as g from f)
select query_id, min(a) as page_start, max(b) as page_end, max(c) as confidence, count(*) as n, string_agg(distinct id::varchar, ',' order by id::varchar) as ids from g group by query_id, g""")
def page_gap_merge(t: Tables) -> DataFrame:
    """Page ranges that follow the previous row's end become one hit."""
    start = F.expr("l_orderkey div 100")
    rows = t.lineitem.select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), start.alias("page_start"), (start + F.col("l_linenumber") % 3).alias("page_end"), F.col("l_discount").alias("c"))
    merged = G.merge_pages(rows, ["query_id"], ["id", "line"]).groupBy("query_id", "group")
    return merged.agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.max("c").alias("confidence"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col("id").cast("string"))), ",").alias("ids")).drop("group")


@query(f"with {SCORE_SQL}, {CONFIDENCE_SQL} select query_id, doc_id, round(confidence * case when kind = 'R' then 0.25 when tax = 0 then 0.1 else tax / (tax + 0.05) end, 10)::double as confidence from cf")
def evidence_calibration(t: Tables) -> DataFrame:
    return confident(t).select("query_id", "doc_id", F.round(G.calibrated(F.col("confidence"), F.col("tax"), F.col("kind") == "R"), 10).alias("confidence"))


@query(f"with {SCORE_SQL}, {CONFIDENCE_SQL}, l as (select *, case when discount >= 0.08 then 'DIRECT' when discount >= 0.05 then 'SUPPORTING' when discount >= 0.02 then 'BACKGROUND' else 'UNRELATED' end as label from cf) select query_id, doc_id, label, row_number() over (partition by query_id order by case label when 'DIRECT' then 0 when 'SUPPORTING' then 1 when 'BACKGROUND' then 4 else 9 end, confidence desc, score desc, doc_id)::int as place from l")
def evidence_sort(t: Tables) -> DataFrame:
    """Final order: evidence label, confidence, score."""
    from pyspark.sql import Window

    from gleanery.operators.fuse import mapped

    d = F.col("discount")
    rows = confident(t).withColumn("label", F.when(d >= 0.08, "DIRECT").when(d >= 0.05, "SUPPORTING").when(d >= 0.02, "BACKGROUND").otherwise("UNRELATED"))
    w = Window.partitionBy("query_id").orderBy(mapped(G.EVIDENCE_RANK, F.col("label"), 9), F.desc("confidence"), F.desc("score"), "doc_id")
    return rows.select("query_id", "doc_id", "label", F.row_number().over(w).alias("place"))


@query(f"with {fusion.HITS_SQL} select query_id, doc_id, string_agg(distinct retriever, '+' order by retriever) || '/' || case when max(place) > 0 then 'span' else 'chunk' end as origin from hits group by query_id, doc_id")
def provenance_label(t: Tables) -> DataFrame:
    rows = fusion.hits(t).groupBy("query_id", "doc_id").agg(F.collect_set("retriever").alias("s"), F.max("place").alias("p"))
    return rows.select("query_id", "doc_id", G.provenance(F.col("p") > 0, F.col("s"), F.lit("span")).alias("origin"))
