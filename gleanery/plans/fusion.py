"""Fusion queries: BM25, literal and long-term hits of benchmark items, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import fuse, retrieve
from gleanery.operators.pairs import Classes, Factor
from gleanery.plans import retrieval as R
from gleanery.plans.registry import Tables, query, tokens_sql

HITS_SQL = f"""{R.BM25_SQL}, {R.LITERAL_SQL},
lt as (select distinct item_id as query_id, unnest({tokens_sql("text")}) as term from benchmark), dt as (select distinct doc_id, unnest({tokens_sql("text")}) as term from documents),
tn as (select query_id, doc_id, 2.0 * count(*) as score from lt join dt using (term) where length(term) >= 9 group by 1, 2 having count(*) >= 3),
hits as (select query_id, doc_id, 'bm25' as retriever, score::double as score, 0 as place from (select *, rank() over (partition by query_id order by score desc) as r from bm) where r <= 10
 union all select query_id, doc_id, 'literal', 30.0, place from lit union all select query_id, doc_id, 'ner', score, 0 from tn)"""
CAPPED_SQL = """case retriever when 'bm25' then 0.20 * least(score / 40, 1) when 'literal' then 0.25 * least(score / 30, 1) else 0.03 * least(score, 1) end"""


def hits(t: Tables) -> DataFrame:
    rows = lambda d, name, place: d.select("query_id", "doc_id", F.lit(name).alias("retriever"), F.col("score").cast("double").alias("score"), place.cast("int").alias("place"))
    bm25 = rows(retrieve.top_with_ties(R.bm25_hits(t), 10), "bm25", F.lit(0))
    exact = rows(R.literal_search(t).withColumn("score", F.lit(30.0)), "literal", F.col("place"))
    return bm25.unionByName(exact).unionByName(rows(R.term_or_search(t), "ner", F.lit(0)))


@query(f"with {HITS_SQL} select query_id, doc_id, string_agg(distinct retriever, '+' order by retriever) as sources, count(distinct retriever) as n_sources, max(place)::int as place from hits group by query_id, doc_id")
def hit_clusters(t: Tables) -> DataFrame:
    return fuse.clustered(hits(t)).drop("scores")


@query(f"with {HITS_SQL} select query_id, retriever, max(score)::double as best, count(*) as n from hits group by query_id, retriever")
def best_per_retriever(t: Tables) -> DataFrame:
    return hits(t).groupBy("query_id", "retriever").agg(F.max("score").alias("best"), F.count("*").alias("n"))


@query(f"with {HITS_SQL} select query_id, doc_id, round(sum({CAPPED_SQL}), 4)::double as score, count(*) as n_sources from hits group by query_id, doc_id")
def hybrid_score(t: Tables) -> DataFrame:
    return fuse.retriever_sum(hits(t)).withColumn("score", F.round("score", 4))


@query(f"with {R.FACTS_SQL}, n as (select distinct query_id, fa.doc_id from fq join fa using (slot, value) where slot = 'brand'), j as (select query_id, n.doc_id, case fq.slot when 'brand' then 4.0 when 'type' then 2.5 else 1.2 end * (fq.value = fa.value)::int as s from n join fq using (query_id) join fa on fa.doc_id = n.doc_id and fa.slot = fq.slot) select query_id, doc_id, round(sum(s) / 7.7, 6)::double as score from j group by query_id, doc_id")
def slot_weighted_jaccard(t: Tables) -> DataFrame:
    """Every part asked against all parts of its brand, itself among them."""
    rows, of = R.fact_slots(t), lambda s: {n: F.col(f"{s}.{n}") for n in R.SLOTS}
    score = fuse.weighted_overlap(of("a"), of("b"), R.SLOTS)
    fields = {n: F.col(n) for n in R.SLOTS}
    held = Classes(rows, "key", "doc_id", F.col("doc_id") % 20 == 0, [Factor(fields, fields, [score])])
    if held.known:
        return held.pairs(lambda v: iter([{"score": v[0][0]}]), "score double", itself=True).withColumnRenamed("note_id", "doc_id")
    side = lambda s, name: rows.select("key", F.col("doc_id").alias(name), F.struct(*R.SLOTS).alias(s))
    return side("a", "query_id").filter("query_id % 20 = 0").join(side("b", "doc_id"), "key").select("query_id", "doc_id", score.alias("score"))


@query(f"with {R.RELATION_SQL} select query_id, count(*) as n, round(avg(score), 10) as mean_score, max(score) as best from rs group by query_id")
def relation_score(t: Tables) -> DataFrame:
    return R.relation_hits(t).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 10).alias("mean_score"), F.max("score").alias("best"))


@query("""with b as (select p_partkey, p_brand as brand, string_split(p_name, ' ') as ws from part)
select a.p_partkey as a, b.p_partkey as b, round(len(list_intersect(list_distinct(a.ws), list_distinct(b.ws))) / greatest(len(list_distinct(a.ws)), len(list_distinct(b.ws))), 6) as overlap from b a join b on a.brand = b.brand and a.p_partkey % 20 = 0 and a.p_partkey <> b.p_partkey""")
def identity_overlap(t: Tables) -> DataFrame:
    """Shared words over the larger set, among parts of a brand."""
    held = t.part.select("p_partkey", F.col("p_brand").alias("brand"), F.array_distinct(F.split("p_name", " ")).alias("ws"))
    words, share = {"ws": F.array_sort("ws")}, lambda x, y: F.round(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)), 6)
    classes = Classes(held, "brand", "p_partkey", F.col("p_partkey") % 20 == 0, [Factor(words, words, [share("a.ws", "b.ws")])])
    if classes.known:
        return classes.pairs(lambda v: iter([{"overlap": v[0][0]}]), "overlap double").withColumnsRenamed({"query_id": "a", "note_id": "b"})
    a, b = held.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("a"), "brand", F.col("ws").alias("x")), held.select(F.col("p_partkey").alias("b"), "brand", F.col("ws").alias("y"))
    return a.join(b, "brand").filter("a <> b").select("a", "b", share("x", "y").alias("overlap"))


@query(f"""with {HITS_SQL}, c as (select query_id, doc_id, max((retriever = 'literal')::int) as exact, sum({CAPPED_SQL}) as raw from hits group by 1, 2)
select query_id, doc_id, round(raw + case when exact = 0 and d.text not like '%@%' then -0.4 else 0 end, 4)::double as score from c join documents d using (doc_id)""")
def zero_identity_penalty(t: Tables) -> DataFrame:
    """A candidate with neither a verbatim match nor an address loses 0.4."""
    scored = fuse.retriever_sum(hits(t)).drop("n_sources").join(R.literal_search(t), ["query_id", "doc_id"], "left")
    found = F.col("place").isNotNull() | F.contains("text", F.lit("@"))
    return scored.join(t.documents.select("doc_id", "text"), "doc_id").select("query_id", "doc_id", F.round(F.col("score") + fuse.absence_penalty(F.lit(True), found, -0.4), 4).alias("score"))


@query(f"""with {HITS_SQL}, c as (select query_id, doc_id, sum({CAPPED_SQL}) as raw from hits group by 1, 2)
select query_id, doc_id, round(raw * case when lang = 'en' then 1.25 else 1 end * case when doc_id % 3 = 1 then 0.7 when doc_id % 3 = 2 then 0.82 else 1 end, 4)::double as score from c join documents d using (doc_id)""")
def section_multiplier(t: Tables) -> DataFrame:
    """Section and context multipliers on the fused score."""
    kind = F.when(F.col("doc_id") % 3 == 1, "CITED").when(F.col("doc_id") % 3 == 2, "HISTORICAL").otherwise("CURRENT")
    rows = fuse.retriever_sum(hits(t)).join(t.documents.select("doc_id", "lang"), "doc_id")
    return rows.select("query_id", "doc_id", fuse.final_score(F.col("score"), F.when(F.col("lang") == "en", 1.25).otherwise(1.0), fuse.mapped(fuse.CONTEXT, kind, 1.0)).alias("score"))


@query(f"with {HITS_SQL} select retriever, (ceil(quantile_cont(score, 0.95) / 5) * 5)::double as cap, round(avg(score), 6)::double as mean_score from hits group by retriever")
def score_caps_p95(t: Tables) -> DataFrame:
    return hits(t).groupBy("retriever").agg(fuse.score_cap(F.col("score")).alias("cap"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("select l_orderkey, round(sum(case when l_returnflag = 'A' then -0.12 else 0 end + case when l_discount = 0 then -0.10 else 0 end + case when l_tax = 0 then -0.06 else 0 end + case l_linestatus when 'O' then 0.02 else 0.01 end), 6)::double as adjustment from lineitem group by l_orderkey")
def structural_penalties(t: Tables) -> DataFrame:
    """Penalties of missing parts and the bonus of small units, summed for each candidate."""
    cost = F.when(F.col("l_returnflag") == "A", -0.12).otherwise(0.0) + F.when(F.col("l_discount") == 0, -0.10).otherwise(0.0) + F.when(F.col("l_tax") == 0, -0.06).otherwise(0.0)
    unit = F.when(F.col("l_linestatus") == "O", "sentence").otherwise("paragraph")
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(cost + fuse.mapped(fuse.GRANULARITY, unit, 0.0)), 6).alias("adjustment"))
