"""Analytics queries: events as log lines of users, orders and line items as runs of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators import analytics as A
from gleanery.plans import fusion
from gleanery.plans.registry import Tables, query


@query("select l_linestatus as unit, count(*) as retrieved, count_if(l_returnflag = 'A') as yes, count_if(l_returnflag = 'R') as rejected, count_if(l_returnflag = 'N') as skipped from lineitem group by l_linestatus")
def type_verdict_counts(t: Tables) -> DataFrame:
    flag = lambda v, n: F.count_if(F.col("l_returnflag") == v).alias(n)
    return t.lineitem.groupBy(F.col("l_linestatus").alias("unit")).agg(F.count("*").alias("retrieved"), flag("A", "yes"), flag("R", "rejected"), flag("N", "skipped"))


@query("select event_type as stage, round(sum(value), 4)::double as total, round(sum(value) / count(distinct user_id), 4)::double as per_user, count(*) as n from events group by event_type")
def stage_timing(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.sum("value") / F.count_distinct("user_id"), 4).alias("per_user"), F.count("*").alias("n"))


@query("with c as (select l_orderkey, sum(case when l_quantity > 10 then l_quantity * 40 else 418 end) as tokens_in, count(*) * 85 as tokens_out from lineitem group by l_orderkey) select l_orderkey, tokens_in::double as tokens_in, tokens_out, round(tokens_in * 0.80e-6 + tokens_out * 4.00e-6, 8)::double as cost from c")
def cost_rollup(t: Tables) -> DataFrame:
    """Tokens as measured, else estimated, and what they cost."""
    used = F.when(F.col("l_quantity") > 10, F.col("l_quantity") * 40).otherwise(A.TOKENS_IN)
    c = t.lineitem.groupBy("l_orderkey").agg(F.sum(used).alias("tokens_in"), (F.count("*") * A.TOKENS_OUT).alias("tokens_out"))
    return c.withColumn("cost", F.round(F.col("tokens_in") * A.PRICE_IN + F.col("tokens_out") * A.PRICE_OUT, 8))


@query(f"with {fusion.HITS_SQL}, o as (select query_id, doc_id, string_agg(distinct retriever, '+' order by retriever) as origin from hits group by 1, 2) select origin, count(*) as n from o group by origin")
def origin_histogram(t: Tables) -> DataFrame:
    rows = fusion.hits(t).groupBy("query_id", "doc_id").agg(F.array_join(F.sort_array(F.collect_set("retriever")), "+").alias("origin"))
    return rows.groupBy("origin").agg(F.count("*").alias("n"))


@query("select user_id, count(*) as n, round(sum(value), 4)::double as total, max(value) as slowest, count_if(event_type = 'error') as n_errors, count_if(value > 50) as n_slow, epoch_us(max(ts)) - epoch_us(min(ts)) as span_us from events group by user_id")
def log_rollup(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("slowest"), F.count_if(F.col("event_type") == "error").alias("n_errors"),
        F.count_if(F.col("value") > 50).alias("n_slow"), (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("span_us"),
    )


@query("""with l as (select event_id, 'user=' || user_id || ' type=' || event_type || ' k=' || (props->>'$.k') || ' end' as line from events)
select event_id, regexp_extract(line, 'user=(\\S+)', 1)::bigint as user_id, regexp_extract(line, 'type=(\\S+)', 1) as type, try_cast(regexp_extract(line, 'k=(\\S+)', 1) as int) as k from l""")
def log_kv_parse(t: Tables) -> DataFrame:
    line = F.concat(F.lit("user="), "user_id", F.lit(" type="), "event_type", F.lit(" k="), F.get_json_object("props", "$.k"), F.lit(" end"))
    kv = t.events.select("event_id", A.key_values(line).alias("m"))
    return kv.select("event_id", F.col("m.user").cast("long").alias("user_id"), F.col("m.type").alias("type"), F.col("m.k").try_cast("int").alias("k"))


@query("select event_type, round(quantile_cont(value, 0.5), 6)::double as p50, round(quantile_cont(value, 0.95), 6)::double as p95, round(quantile_cont(value, 0.99), 6)::double as p99 from events group by event_type")
def linear_percentiles(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


@query("with s as (select user_id, list_sort(list(value)) as v from events group by user_id) select user_id, v[floor(0.5 * (len(v) - 1))::int + 1] as p50, v[floor(0.95 * (len(v) - 1))::int + 1] as p95 from s")
def floor_percentiles(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(A.floor_percentile(F.col("value"), 0.5).alias("p50"), A.floor_percentile(F.col("value"), 0.95).alias("p95"))


@query("with b as (select case when value >= 100 then 100.0 when value >= 50 then 50.0 when value >= 20 then 20.0 when value >= 10 then 10.0 when value >= 5 then 5.0 else 0.0 end::double as low from events where value >= 0) select low, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 2)::double as percent from b group by low")
def bucket_histogram(t: Tables) -> DataFrame:
    return A.bucketed(t.events, "value", [0.0, 5.0, 10.0, 20.0, 50.0, 100.0])


@query("with r as (select *, row_number() over (partition by user_id order by value desc, event_id) as p from events) select user_id, string_agg(event_id::varchar, ',' order by p) as slowest from r where p <= 10 group by user_id")
def slowest_topn(t: Tables) -> DataFrame:
    return A.slowest(t.events, "user_id", "value", "event_id", 10)


OLD_NEW = "old as (select o_custkey as k, o_orderdate::date as d, o_totalprice as score, o_orderkey as id from orders where o_orderkey % 3 <> 0), new as (select o_custkey as k, o_orderdate::date as d, o_totalprice as score, o_orderkey as id from orders where o_orderkey % 2 = 0)"


def old_and_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("id"))
    return rows.filter("id % 3 <> 0"), rows.filter("id % 2 = 0")


@query(f"""with {OLD_NEW}, o as (select k, year(d) as y, row_number() over (partition by k, year(d) order by score desc, id) as nth, score as old from old), n as (select k, year(d) as y, row_number() over (partition by k, year(d) order by score desc, id) as nth, score as new from new)
select k, y, nth::int as nth, old, new, case when old is null then 'NEW ONLY' when new is null then 'OLD ONLY' else 'BOTH' end as status from o full join n using (k, y, nth)""")
def run_comparison(t: Tables) -> DataFrame:
    old, new = (d.withColumn("y", F.year("d")) for d in old_and_new(t))
    return A.compared(old, new, ["k", "y"], "score", "id")


@query(f"with {OLD_NEW} select (select count(*) from (select distinct k from old intersect select distinct k from new)) as both, (select count(*) from (select distinct k from old except select distinct k from new)) as old_only, (select count(*) from (select distinct k from new except select distinct k from old)) as new_only")
def set_summary(t: Tables) -> DataFrame:
    old, new = (d.select("k").distinct() for d in old_and_new(t))
    sides = old.withColumn("o", F.lit(1)).join(new.withColumn("n", F.lit(1)), "k", "full_outer")
    return sides.agg(F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("both"), F.count_if(F.col("n").isNull()).alias("old_only"), F.count_if(F.col("o").isNull()).alias("new_only"))


@query("""with s as (select l_orderkey as k, l_linestatus as run, case l_returnflag when 'A' then 'FINAL' when 'R' then 'REJECTED' else 'SKIPPED' end as state, l_quantity as q, l_linenumber as n from lineitem),
b as (select * from (select *, row_number() over (partition by k, run order by case state when 'FINAL' then 0 when 'REJECTED' then 1 else 3 end, n) as r from s) where r = 1)
select x.state as with_rerank, y.state as without_rerank, count(*) as n from (select * from b where run = 'O') x full join (select * from b where run = 'F') y using (k) group by all""")
def ab_compare(t: Tables) -> DataFrame:
    """Each key's best state in two runs, counted as pairs."""
    state = F.when(F.col("l_returnflag") == "A", "FINAL").when(F.col("l_returnflag") == "R", "REJECTED").otherwise("SKIPPED")
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("run"), state.alias("state"), F.col("l_linenumber").alias("n"))
    best = A.best_state(rows, ["k", "run"], {"FINAL": 0, "REJECTED": 1, "BLOCKED": 2, "SKIPPED": 3}, "state", "n")
    side = lambda run, name: best.filter(F.col("run") == run).select("k", F.col("state").alias(name))
    return side("O", "with_rerank").join(side("F", "without_rerank"), "k", "full_outer").groupBy("with_rerank", "without_rerank").agg(F.count("*").alias("n"))


@query("""with c as (select unnest(list_filter([case when l_discount = 0 then 'NO_SCORE' end, case when l_tax > 0.06 then 'LOW_CONFIDENCE' end, case when l_quantity < 5 then 'FEW_TERMS' end, case when l_returnflag = 'R' then 'REJECTED' end], lambda x: x is not null)) as cause from lineitem) select cause, count(*) as n from c group by cause""")
def root_causes(t: Tables) -> DataFrame:
    rules = [("NO_SCORE", F.col("l_discount") == 0), ("LOW_CONFIDENCE", F.col("l_tax") > 0.06), ("FEW_TERMS", F.col("l_quantity") < 5), ("REJECTED", F.col("l_returnflag") == "R")]
    return t.lineitem.select(F.explode(A.causes(rules)).alias("cause")).groupBy("cause").agg(F.count("*").alias("n"))


@query("""select o_orderkey, coalesce(l_returnflag, 'NO_HIT') as kind, l_linenumber, case when l_linenumber is not null then row_number() over (partition by o_orderkey, l_returnflag order by l_quantity desc, l_linenumber, l_partkey, l_suppkey)::int end as place
from orders left join lineitem on l_orderkey = o_orderkey""")
def row_expansion(t: Tables) -> DataFrame:
    """A row for each candidate with its rank in its type, or one that says there is none."""
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    w = Window.partitionBy("o_orderkey", "l_returnflag").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey")
    place = F.when(F.col("l_linenumber").isNotNull(), F.row_number().over(w))
    return rows.select("o_orderkey", F.coalesce("l_returnflag", F.lit("NO_HIT")).alias("kind"), "l_linenumber", place.alias("place"))


@query("""with e as (select event_id, user_id, ts, event_type, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_signup from events)
select event_id, user_id, last_signup from e where event_type = 'error'""")
def error_carry_forward(t: Tables) -> DataFrame:
    """Errors with the last id that their stream had before them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return t.events.withColumn("last_signup", held).filter("event_type = 'error'").select("event_id", "user_id", "last_signup")


@query("select o_custkey, count(*) as n, count_if(o_orderstatus = 'F') as n_failed, case when count_if(o_orderstatus = 'F') = count(*) then 'FAILED' when count_if(o_orderstatus = 'F') > 0 then 'PARTIAL' else 'COMPLETED' end as status from orders group by o_custkey")
def run_status(t: Tables) -> DataFrame:
    failed = F.count_if(F.col("o_orderstatus") == "F")
    status = F.when(failed == F.count("*"), "FAILED").when(failed > 0, "PARTIAL").otherwise("COMPLETED")
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), failed.alias("n_failed"), status.alias("status"))


@query("select date_trunc('day', ts)::date as day, count(*) as n, round(count(*) / 24, 4)::double as per_hour, round(sum(count(*)) over (order by date_trunc('day', ts)) / (select count(*) from events), 6)::double as done from events group by date_trunc('day', ts)")
def progress_rate(t: Tables) -> DataFrame:
    """Events a day, their rate, and the share done by then; the days are all that one window sees."""
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return days.select("day", "n", F.round(F.col("n") / 24, 4).alias("per_hour"), F.round(F.sum("n").over(Window.orderBy("day")) / total, 6).alias("done"))


@query("select source, count(*) as n from documents group by source")
def counts_per_source(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n"))
