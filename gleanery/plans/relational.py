"""Plain relational queries: joins, grouping sets, set operations, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.plans.registry import Tables, query


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2)::double as revenue, round(avg(l_discount), 6)::double as mean_discount, count(*) as n from lineitem where l_shipdate <= timestamp '2001-09-02' group by all")
def tpch_pricing(t: Tables) -> DataFrame:
    rows = t.lineitem.filter("l_shipdate <= timestamp_ntz '2001-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


@query("select o_orderpriority, count(*) as n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by 1")
def join_semi(t: Tables) -> DataFrame:
    returned = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(returned, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("select c_mktsegment, count(*) as n from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000) group by 1")
def join_anti(t: Tables) -> DataFrame:
    large = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(large, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("""select event_id, o_orderkey from (select event_id, o_orderkey, row_number() over (partition by event_id order by o_orderdate desc, o_orderkey desc) as r from events join orders on o_custkey = user_id and o_orderdate <= ts - interval 23 year) where r = 1""")
def asof_orders(t: Tables) -> DataFrame:
    """The last order of the same customer before each event (moved back 23 years), by a running last value over both streams."""
    e = t.events.select(F.col("user_id").alias("k"), F.expr("ts - interval 23 year").alias("at"), "event_id", F.lit(None).cast("struct<d:timestamp_ntz,o:bigint>").alias("order"))
    o = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.lit(None).cast("long").alias("event_id"), F.struct(F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("o")).alias("order"))
    w = Window.partitionBy("k").orderBy("at", F.col("event_id").asc_nulls_first(), "order.o").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last("order", ignorenulls=True).over(w)
    return e.unionByName(o).withColumn("held", held).filter("event_id is not null and held is not null").select("event_id", F.col("held.o").alias("o_orderkey"))


@query("select p_partkey, l_orderkey, l_linenumber, l_suppkey from part join lineitem on l_partkey = p_partkey and l_quantity between p_size - 1 and p_size + 1")
def range_join(t: Tables) -> DataFrame:
    """Line items of a part whose quantity lies near its size."""
    both = t.part.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"))
    return both.filter(F.col("l_quantity").between(F.col("p_size") - 1, F.col("p_size") + 1)).select("p_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@query("select r_name, n_name, count(*) as n, round(sum(s_acctbal), 2)::double as balance from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by rollup (r_name, n_name)")
def rollup_region(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def cube_status(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""with a as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as k from orders where o_orderstatus = 'O')
select 'both' as part, count(*) as n from (select * from a intersect select * from b) union all select 'first', count(*) from (select * from a except select * from b) union all select 'either', count(*) from (select * from a union select * from b)""")
def union_intersect_except(t: Tables) -> DataFrame:
    a, b = (t.orders.filter(F.col("o_orderstatus") == s).select("o_custkey").distinct() for s in ("F", "O"))
    count = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "first")).unionByName(count(a.union(b).distinct(), "either"))


@query("select c_custkey, o_orderkey, ntile(4) over (partition by c_mktsegment order by o_totalprice, o_orderkey)::int as quarter, dense_rank() over (partition by c_custkey order by o_orderpriority)::int as dense from customer join orders on o_custkey = c_custkey")
def ranking_windows(t: Tables) -> DataFrame:
    rows = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    quarter, dense = F.ntile(4).over(Window.partitionBy("c_mktsegment").orderBy("o_totalprice", "o_orderkey")), F.dense_rank().over(Window.partitionBy("c_custkey").orderBy("o_orderpriority"))
    return rows.select("c_custkey", "o_orderkey", quarter.alias("quarter"), dense.alias("dense"))
