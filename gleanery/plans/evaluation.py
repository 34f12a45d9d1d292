"""Evaluation queries: verbatim containment is the truth that BM25's ranking is measured against."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import wilson
from gleanery.operators import retrieve
from gleanery.plans import retrieval as R
from gleanery.plans.registry import Tables, query

RANKED_SQL = f"""{R.BM25_SQL}, {R.LITERAL_SQL}, gold as (select distinct query_id, doc_id from lit),
rk as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from bm),
fg as (select query_id, min(rank) as first_rank from gold left join rk using (query_id, doc_id) group by query_id)"""


def gold(t: Tables) -> DataFrame:
    return R.literal_search(t).select("query_id", "doc_id").distinct()


def first_ranks(t: Tables) -> DataFrame:
    """(query_id, first_rank) of every item with a true document; null if BM25 has none of them."""
    ranked = retrieve.top(R.bm25_hits(t), 1 << 30, "doc_id")
    return gold(t).join(ranked, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("first_rank"))


@query(f"with {RANKED_SQL} select k, round(count_if(first_rank <= k) / count(*), 6) as recall, count(*) as n from fg, (values (1), (5), (10)) v(k) group by k")
def stage_recall(t: Tables) -> DataFrame:
    """Share of items whose truth survives the first k."""
    ranks = first_ranks(t).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 5, 10)])))
    return ranks.groupBy("k").agg(F.round(F.count_if(F.col("first_rank") <= F.col("k")) / F.count("*"), 6).alias("recall"), F.count("*").alias("n"))


@query(f"with {RANKED_SQL} select query_id, first_rank from fg")
def first_gold_rank(t: Tables) -> DataFrame:
    return first_ranks(t)


@query(f"with {RANKED_SQL} select round(count_if(first_rank = 1) / count(*), 6) as precision_at_1, count(*) as n from fg")
def precision_at_1(t: Tables) -> DataFrame:
    return first_ranks(t).agg(F.round(F.count_if(F.col("first_rank") == 1) / F.count("*"), 6).alias("precision_at_1"), F.count("*").alias("n"))


@query(f"with {RANKED_SQL} select round(sum(coalesce(1 / first_rank, 0)) / count(*), 3)::double as mrr from fg")
def mrr(t: Tables) -> DataFrame:
    return first_ranks(t).agg(F.round(F.sum(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))) / F.count("*"), 3).alias("mrr"))


WILSON_SQL = "greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)) as low, least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)) as high"


@query(f"with s as (select l_returnflag as kind, count(*) as n, count_if(l_discount >= 0.05) / count(*) as p from lineitem group by 1), w as (select kind, n, {WILSON_SQL} from s) select kind, n, round(low, 6)::double as low, round(high, 6)::double as high from w")
def wilson_interval(t: Tables) -> DataFrame:
    low, high = wilson(F.count_if(F.col("l_discount") >= 0.05), F.count("*"))
    return t.lineitem.groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("select quality, toxic, count(*) as n, round(avg(n_chars), 4)::double as mean_chars from labels join documents using (doc_id) group by grouping sets ((quality), (toxic), ())")
def recall_rollup(t: Tables) -> DataFrame:
    """Breakdown by either label and over all, in one pass by grouping sets."""
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return rows.groupingSets([["quality"], ["toxic"], []], "quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query(f"""with s as (select o_orderpriority as kind, (o_orderkey % 2)::int as run, count(*) as n, count_if(o_totalprice > 200000) / count(*) as p from orders group by 1, 2), w as (select kind, run, p, {WILSON_SQL} from s)
select a.kind, round(b.p - a.p, 6)::double as delta, abs(b.p - a.p) > greatest((a.high - a.low) / 2, (b.high - b.low) / 2) as clear from w a join w b on a.kind = b.kind and a.run = 0 and b.run = 1""")
def run_delta(t: Tables) -> DataFrame:
    """Change between two runs, and whether it is more than either half-width."""
    good = F.count_if(F.col("o_totalprice") > 200000)
    low, high = wilson(good, F.count("*"))
    s = t.orders.groupBy(F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % 2).alias("run")).agg((good / F.count("*")).alias("p"), ((high - low) / 2).alias("half"))
    a, b = s.filter("run = 0").select("kind", F.col("p").alias("p0"), F.col("half").alias("h0")), s.filter("run = 1").select("kind", F.col("p").alias("p1"), F.col("half").alias("h1"))
    return a.join(b, "kind").select("kind", F.round(F.col("p1") - F.col("p0"), 6).alias("delta"), (F.abs(F.col("p1") - F.col("p0")) > F.greatest("h0", "h1")).alias("clear"))


@query("with s as (select lang, list_sort(list(n_chars)) as v from documents group by lang) select lang, round(list_avg(v), 4)::double as mean, round(list_median(v), 4)::double as median, v[len(v) // 4 + 1] as p25, v[3 * len(v) // 4 + 1] as p75 from s")
def score_distribution(t: Tables) -> DataFrame:
    """Mean, median and the values at floor(n / 4) and floor(3n / 4), from counts of equal values and their running sum."""
    counts = t.documents.groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    own = Window.partitionBy("lang")
    ranked = counts.withColumn("upto", F.sum("c").over(own.orderBy("n_chars"))).withColumn("n", F.sum("c").over(own))
    at = lambda k: F.min(F.when(F.col("upto") > F.floor(k * F.col("n") / 4), F.col("n_chars")))
    middle = (F.min(F.when(F.col("upto") >= F.ceil(F.col("n") / 2), F.col("n_chars"))) + F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("n_chars")))) / 2
    return ranked.groupBy("lang").agg(F.round(F.sum(F.col("n_chars") * F.col("c")) / F.sum("c"), 4).alias("mean"), F.round(middle, 4).alias("median"), at(1).alias("p25"), at(3).alias("p75"))
