"""Context queries: verbatim hits in documents, turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import sentences
from gleanery.operators import context as C
from gleanery.plans.registry import LINES, Tables, query

CENTERS_SQL = "cen as (select conv_id, turn as center from conversations)"


def centers(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("center"))


def turns(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "role", "text")


@query(f"with {CENTERS_SQL} select c.conv_id as doc_id, center, turn as pos, abs(turn - center) as distance, round(abs(turn - center) / 3, 6) as ratio from cen c join conversations o on o.conv_id = c.conv_id and abs(turn - center) <= 3")
def neighbor_window3(t: Tables) -> DataFrame:
    rows = C.neighbours(centers(t), turns(t), 3)
    return rows.select("doc_id", "center", "pos", "distance", F.round(F.col("distance") / 3, 6).alias("ratio"))


@query("select conv_id, turn, right(lag(text) over w, 500) as before, left(lead(text) over w, 500) as after from conversations window w as (partition by conv_id order by turn)")
def prev_next_text(t: Tables) -> DataFrame:
    return C.previous_and_next(t.conversations, "conv_id", "turn", "text", 500).select("conv_id", "turn", "before", "after")


@query("""select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by contains(text, 'un')::int desc, case role when 'assistant' then 3 when 'user' then 2 else 1 end desc, turn) as r from conversations) where r = 1""")
def best_object_in_chunk(t: Tables) -> DataFrame:
    role = F.col("role")
    priority = F.when(role == "assistant", 3).when(role == "user", 2).otherwise(1)
    return C.best_object(t.conversations, ["conv_id"], F.contains("text", F.lit("un")), priority, "turn").select("conv_id", "turn", "role")


@query(f"with {CENTERS_SQL} select c.conv_id as doc_id, center, string_agg(turn::varchar, ',' order by (turn <> center)::int, case role when 'system' then 0 when 'user' then 1 else 2 end, abs(turn - center), turn) as turns from cen c join conversations o on o.conv_id = c.conv_id and abs(turn - center) <= 3 group by 1, 2")
def context_sort(t: Tables) -> DataFrame:
    """The hit first, then by type, then nearest."""
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    key = F.struct((F.col("pos") != F.col("center")).cast("int").alias("a"), rank.alias("b"), F.col("distance").alias("c"), F.col("pos").alias("pos"))
    held = C.neighbours(centers(t), turns(t), 3).groupBy("doc_id", "center").agg(F.array_sort(F.collect_list(key)).alias("k"))
    return held.select("doc_id", "center", F.array_join(F.transform("k", lambda x: x["pos"].cast("string")), ",").alias("turns"))


@query(f"""with {LINES}, s as (select doc_id, pos, unnest(ss) as sentence, generate_subscripts(ss, 1)::int - 1 as nth from (select doc_id, pos, list_filter(string_split(regexp_replace(line, '([.!?])[ \\t\\n\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as ss from lines))
select doc_id, pos::int as pos, nth, concat_ws(' ', lag(sentence) over w, sentence, lead(sentence) over w) as context from s window w as (partition by doc_id, pos order by nth)""")
def sentence_hierarchical(t: Tables) -> DataFrame:
    """Each sentence with the one before and the one after it in its line."""
    rows = t.lines().select("doc_id", "pos", F.posexplode(sentences(F.col("line"))).alias("nth", "sentence"))
    w = Window.partitionBy("doc_id", "pos").orderBy("nth")
    return rows.select("doc_id", "pos", "nth", F.concat_ws(" ", F.lag("sentence").over(w), "sentence", F.lead("sentence").over(w)).alias("context"))
