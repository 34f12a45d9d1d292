"""Extraction queries: lines as objects, conversations as sections, parts and nations as vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import extract as E
from gleanery.plans.registry import LINES, Tables, query


def case_sql(rules: list[tuple[str, str]], other: str, column: str = "line") -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '{p}') then '{n}'" for n, p in rules) + f" else '{other}' end"


@query(f"with {LINES} select doc_id, pos::int as pos, {case_sql(E.STATEMENT_RULES, 'GENERAL')} as statement_type from lines")
def statement_type(t: Tables) -> DataFrame:
    return t.lines().select("doc_id", "pos", E.rule(F.col("line"), E.STATEMENT_RULES, "GENERAL").alias("statement_type"))


@query(f"with {LINES} select doc_id, pos::int as pos, {case_sql(E.MODALITY_RULES, 'STATED')} as modality from lines")
def modality(t: Tables) -> DataFrame:
    return t.lines().select("doc_id", "pos", E.rule(F.col("line"), E.MODALITY_RULES, "STATED").alias("modality"))


@query(f"with {LINES} select doc_id, pos::int as pos, case when length(line) - length(replace(line, '|', '')) >= 3 then 'table' when regexp_matches(line, '(?i) (is|ist|est|es) ') then 'definition' when regexp_matches(line, '[0-9]{{3}}') then 'schedule' else 'general' end as object_subtype from lines")
def object_subtype(t: Tables) -> DataFrame:
    line = F.col("line")
    kind = F.when(F.regexp_count(line, F.lit(r"\|")) >= 3, "table").when(line.rlike("(?i) (is|ist|est|es) "), "definition").when(line.rlike("[0-9]{3}"), "schedule").otherwise("general")
    return t.lines().select("doc_id", "pos", kind.alias("object_subtype"))


@query(f"""with {LINES}, s as (select doc_id, pos, try_cast(nullif(regexp_extract(line, '([0-9]+(?:\\.[0-9]+)?) ?%', 1), '') as double) as share,
 try_cast(nullif(regexp_extract(line, '(?i)version ([0-9]+(?:\\.[0-9]+)?)', 1), '') as double) as version, try_cast(nullif(regexp_extract(line, '(?:^|[^0-9.])([0-9]+)(?:[^0-9.]|$)', 1), '') as double) as count from lines)
select doc_id, pos::int as pos, case when share is not null then 'share' when version is not null then 'version' when count is not null then 'count' end as type, share, version, count from s where share is not null or version is not null or count is not null""")
def stat_identity(t: Tables) -> DataFrame:
    return t.lines().select("doc_id", "pos", E.statistics(F.col("line")).alias("s")).filter("s.type is not null").select("doc_id", "pos", "s.*")


@query(f"""with {LINES}, p as (select *, position('License' in line) as place from lines) select doc_id, pos::int as pos, regexp_matches(substring(line, greatest(1, place - 80), least(80, place - 1)), '{E.NEGATION}') as negated from p where place > 0""")
def negated_slots(t: Tables) -> DataFrame:
    """Whether a negation stands within 80 characters before a term."""
    at = F.expr("locate('License', line)")
    before = F.substring(F.col("line"), F.greatest(F.lit(1), at - 80), F.least(F.lit(80), at - 1))
    return t.lines().filter(at > 0).select("doc_id", "pos", before.rlike(E.NEGATION).alias("negated"))


SLOTS_SQL = """own as (select conv_id, turn, role, nullif(regexp_extract(text, '([A-Z][a-z]{2,4}) ', 1), '') as topic, nullif(regexp_extract(text, '([a-z]+ung|[a-z]+tion)', 1), '') as act from conversations),
eff as (select conv_id, turn, topic as own_topic, act as own_act, last_value(case when role <> 'assistant' then topic end ignore nulls) over w as in_topic, last_value(case when role <> 'assistant' then act end ignore nulls) over w as in_act from own window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding))"""


def turns_with_facts(t: Tables) -> DataFrame:
    text = F.col("text")
    slots = {"topic": E.first_match(text, "([A-Z][a-z]{2,4}) "), "act": E.first_match(text, "([a-z]+ung|[a-z]+tion)")}
    return E.inherited(t.conversations, "conv_id", "turn", slots, F.col("role") != "assistant")


@query(f"with {SLOTS_SQL} select conv_id, turn, coalesce(own_topic, in_topic) as topic, coalesce(own_act, in_act) as act from eff")
def fact_inheritance(t: Tables) -> DataFrame:
    """Own facts win; else the running context of system and user turns."""
    return turns_with_facts(t).select("conv_id", "turn", "topic", "act")


@query(f"with {SLOTS_SQL}, p as (select case when own_topic is not null then 'own' when in_topic is not null then 'inherited' end as topic_from, case when own_act is not null then 'own' when in_act is not null then 'inherited' end as act_from from eff) select topic_from, act_from, count(*) as n from p group by all")
def slot_provenance(t: Tables) -> DataFrame:
    return turns_with_facts(t).groupBy("topic_from", "act_from").agg(F.count("*").alias("n"))


@query(f"with {LINES} select doc_id, coalesce(max(nullif(regexp_extract(line, '(?i)version ([0-9.]*[0-9])', 1), '')), 'none') as version, coalesce(min(case when contains(line, 'Licen') then pos end), -1)::int as first_license from lines group by doc_id")
def hierarchy_ids(t: Tables) -> DataFrame:
    """Facts first, then text: a document's version and the line of its first license."""
    rows = t.lines()
    return rows.groupBy("doc_id").agg(F.coalesce(F.max(E.first_match(F.col("line"), "(?i)version ([0-9.]*[0-9])")), F.lit("none")).alias("version"), F.coalesce(F.min(F.when(F.contains("line", F.lit("Licen")), F.col("pos"))), F.lit(-1)).alias("first_license"))


#: A small dictionary of terms with labels.
TERMS = {"MIT License": "LICENSE", "License": "TERM", "General Public License": "LICENSE", "Apache License": "LICENSE", "the": "WORD", "Version": "TERM", "GNU": "ORG"}


@query()
def dictionary_ner(t: Tables) -> DataFrame:
    return E.dictionary_entities(t.documents.select("doc_id", "text"), TERMS)


@query("""with a as (select doc_id, position('License' in text) - 1 as start, position('License' in text) + 6 as past from documents where contains(text, 'License')),
b as (select doc_id, position('MIT License' in text) - 1 as start, position('MIT License' in text) + 10 as past from documents where contains(text, 'MIT License') union all select doc_id, position('@' in text) - 1, position('@' in text) from documents where contains(text, '@'))
select doc_id, start::int as start, past::int as past from b where not exists (select 1 from a where a.doc_id = b.doc_id and b.start < a.past and b.past > a.start)""")
def ner_layer_merge(t: Tables) -> DataFrame:
    """Spans of a second layer where the first covers nothing: an anti join on overlap within a document."""

    def spans(term: str) -> DataFrame:
        at = F.expr(f"locate('{term}', text)")
        return t.documents.filter(at > 0).select("doc_id", (at - 1).alias("start"), (at - 1 + len(term)).alias("past"))

    return E.uncovered(spans("MIT License").unionByName(spans("@")), spans("License"))


FAMILIES = [("ECONOMY", "cheap"), ("STANDARD", "common"), ("PROMO", "offered"), ("STAND", "common"), ("MED", "middle")]


@query("""with f(name, family, nth) as (values ('ECONOMY', 'cheap', 0), ('STANDARD', 'common', 1), ('PROMO', 'offered', 2), ('STAND', 'common', 3), ('MED', 'middle', 4)), v as (select distinct p_type as value from part),
m as (select value, family, row_number() over (partition by value order by (name <> value)::int, nth) as o from v join f on name = value or contains(name, value) or contains(value, name))
select v.value, coalesce(family, v.value) as family from v left join m on m.value = v.value and o = 1""")
def endpoint_family(t: Tables) -> DataFrame:
    families = t.spark.createDataFrame([(n, f, k) for k, (n, f) in enumerate(FAMILIES)], "name string, family string, nth int")
    return E.first_family(t.part.select(F.col("p_type").alias("value")).distinct(), families)


@query("""with recursive e as (select r_name as parent, n_name as child from region join nation on n_regionkey = r_regionkey union all select n_name, s_name from nation join supplier on s_nationkey = n_nationkey),
s(node, depth) as (select 'AFRICA', 0 union all select child, depth + 1 from s join e on parent = node where depth < 2) select node, min(depth)::int as depth from s group by node""")
def concept_subtree(t: Tables) -> DataFrame:
    """What lies below a region, by a recursive query to depth two."""
    top = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    low = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("parent"), F.col("s_name").alias("child"))
    return E.subtree(t.spark, top.unionByName(low), ["AFRICA"], 2)


@query("""with p as (select p_brand, p_type, count(*) as n, string_agg(distinct p_name, '|' order by p_name) as names from part group by all) select * from p""")
def alias_graph(t: Tables) -> DataFrame:
    """Sorted distinct aliases of each node."""
    rows = t.part.groupBy("p_brand", "p_type")
    return rows.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("p_name")), "|").alias("names"))


@query("""with w as (select p_partkey, string_split(p_name, ' ') as ws from part), g(word, grp) as (values ('small', 1), ('tiny', 1), ('red', 2), ('crimson', 2), ('widget', 3), ('gadget', 3)),
e as (select distinct p_partkey, b.word from (select p_partkey, unnest(ws) as word from w) x join g a using (word) join g b on a.grp = b.grp) select p_partkey, string_agg(word, ' ' order by word) as terms from e group by p_partkey""")
def synonym_expansion(t: Tables) -> DataFrame:
    """Each word of a synonym group brings all words of the group, both ways."""
    groups = t.spark.createDataFrame([("small", 1), ("tiny", 1), ("red", 2), ("crimson", 2), ("widget", 3), ("gadget", 3)], "word string, grp int")
    pairs = groups.join(groups.withColumnRenamed("word", "other"), "grp")
    words = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return words.join(F.broadcast(pairs), "word").groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_set("other")), " ").alias("terms"))
