"""Streaming queries over ``events``, each run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.plans.registry import Tables, query
from gleanery.streaming import events as S


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def stream_upsert_dedup(t: Tables) -> DataFrame:
    return S.upserted(S.stream(t.spark, t.folder)).select("user_id", "event_id", "event_type", "value")


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4)::double as total from events group by 1, 2")
def event_tumbling_window(t: Tables) -> DataFrame:
    rows = S.finished(S.tumbling(S.stream(t.spark, t.folder)), "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with s as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hour then 1 else 0 end as new from events), g as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from s)
select user_id, min(ts) as start, count(*) as n from g group by user_id, g""")
def event_session_window(t: Tables) -> DataFrame:
    rows = S.finished(S.sessions(S.stream(t.spark, t.folder)), "complete")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("select event_type, count(*) as n from events group by event_type")
def stream_distinct(t: Tables) -> DataFrame:
    """Events with repeated ids dropped within the watermark, counted by type."""
    return S.finished(S.distinct_ids(S.stream(t.spark, t.folder)), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""with e as (select *, date_trunc('day', ts) as start, event_id % 3 as part from events), m as (select max(ts) filter (part = 0) - interval 2 hour as first_mark, max(ts) - interval 2 hour as last_mark from e),
k as (select e.*, start + interval 1 day <= first_mark as closed, start + interval 1 day <= last_mark as done from e, m)
select start, count(*) filter (not (closed and part = 2)) as n, (select count(*) from k where closed and part = 2) as n_late from k where done group by start""")
def late_data(t: Tables) -> DataFrame:
    """Daily counts in append mode over three batches: rows of the third that fall in days closed by the first one's watermark are dropped.

    Days that the last watermark has not closed are not given. The number of dropped rows stands beside each day.
    """
    parts = [t.events.filter(F.col("event_id") % 3 == k) for k in range(3)]
    counts = S.in_batches(parts).withColumn("at", S.at()).withWatermark("at", "2 hours").groupBy(F.window("at", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
    found = S.finished(counts, "append").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")
    whole = t.events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("every"))
    return found.crossJoin(F.broadcast(found.join(whole, "start").agg((F.sum("every") - F.sum("n")).alias("n_late"))))  # one row


@query("select user_id, count(*) as n, round(sum(value), 4)::double as total from events group by user_id")
def stateful_totals(t: Tables) -> DataFrame:
    """Running totals of each user, kept as state over three batches."""
    parts = [t.events.filter(F.col("event_id") % 3 == k).select("user_id", "value") for k in range(3)]
    return S.running_totals(S.in_batches(parts)).select("user_id", "n", F.round("total", 4).alias("total"))
