"""Clinical queries: notes are statements worded from the parts table, one a part, by the same SQL expression on both sides.

Asked notes are those whose id is divisible by 20; their candidates are all notes of the same brand.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators import clinical as C
from gleanery.operators import compare as K
from gleanery.operators.fuse import SLOT_WEIGHTS
from gleanery.operators.pairs import Classes, Factor, digest, filled, spread
from gleanery.plans.registry import Tables, query

K_ = "p_partkey"
DRUG = "(case {k} % 6 when 0 then 'teclistamab' when 1 then 'talquetamab' when 2 then 'daratumumab' when 3 then 'lenalidomide' when 4 then 'pomalidomide' else 'carfilzomib' end)"
STR = "cast({} as string)"
TENS = f"cast(floor({K_} / 10) as bigint)"


def text_sql() -> str:
    s = lambda e: STR.format(e)
    drug, other = DRUG.format(k=K_), DRUG.format(k=f"({K_} + 2)")
    dose, cycle, day, arm = s(f"p_size % 9 + 1"), s(f"{K_} % 6 + 1"), s(f"{K_} % 28 + 1"), f"(case when {K_} % 4 < 2 then 'Arm A' else 'Arm B' end)"
    first = [
        f"'In this study, ' || {drug} || ' was given at ' || {dose} || ' mg/kg on Cycle ' || {cycle} || ' Day ' || {day} || ' before randomization.'",
        f"'The primary objective is to evaluate overall response rate of ' || {drug} || ' per IMWG, investigator-assessed, with a partial response or better at 6 months.'",
        f"'Results from phase 2 data showed HR = 0.' || {s('p_size + 10')} || ' (95% CI: 0.40-0.95; p=0.00' || {cycle} || ') for progression-free survival.'",
        "'Patients with relapsed and refractory multiple myeloma who received at least three prior lines of therapy and ECOG PS of 0-1 were eligible.'",
        f"'Previously, DPd and VRd regimens with ' || {drug} || ' were used as first-line induction in newly diagnosed multiple myeloma.'",
        f"'A total of n = ' || {s(f'{K_} % 500 + 50')} || ' subjects were randomized to ' || {arm} || ' within ' || {day} || ' days.'",
        f"'Serious adverse event and cytokine release with ' || {drug} || ' were monitored during Week ' || {cycle} || ' until end of treatment.'",
        f"'The RP2D of ' || {drug} || ' was not selected; dose escalation continued in MMY' || {s(f'1000 + {K_} % 9000')} || '.'",
        "'Pharmacokinetic AUC and Cmax after first dose; BCMA expression was compared versus placebo.'",
        "p_name || ' has no clinical content.'",
    ]
    second = [
        "''",
        f"' Odds ratio 1.' || {s('p_size + 10')} || '; median of ' || {cycle} || ' months.'",
        "' R-CHOP second-line salvage for DLBCL, lenalidomide-refractory.'",
        "' HRQoL by EQ-5D at screening by independent review.'",
        f"' Maintenance with ' || {other} || ' at ' || {dose} || ' mg/kg, ' || {arm} || ', Cycle ' || {cycle} || '.'",
        f"' ORR was ' || {s('p_size + 20')} || '% of patients.'",
    ]
    pick = lambda by, parts: f"case {by} " + " ".join(f"when {k} then {p}" for k, p in enumerate(parts)) + " end"
    return f"({pick(f'{K_} % 10', first)}) || ({pick(f'{TENS} % 6', second)})"


SECTIONS = ["OBJECTIVES", "ENDPOINTS", "ELIGIBILITY", "BACKGROUND", "SAFETY", "TREATMENT", "PROCEDURES", "APPENDIX", "OTHER"]
KINDS = ["OBJECTIVE", "EFFICACY", "SAFETY", "DOSING", "POPULATION", "PHRASE", "PROTOCOL"]
STATEMENTS = ["OBJECTIVE", "GENERAL", "RESULT", "BACKGROUND"]
MODALITIES = ["OBJECTIVE", "RESULT", "DOSING", "GENERAL", "PROCEDURE"]
SUBTYPES = ["PARAGRAPH", "PARAGRAPH", "ABBREVIATION_TABLE", "DEFINITION", "SCHEDULE_MATRIX"]
ONE_OF = lambda values, by: f"case {by} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"
FIELDS = {
    "note_id": K_, "brand": "p_brand", "section": ONE_OF(SECTIONS, f"{K_} % {len(SECTIONS)}"), "kind": ONE_OF(KINDS, f"{TENS} % {len(KINDS)}"), "statement": ONE_OF(STATEMENTS, f"{TENS} % {len(STATEMENTS)}"),
    "modality": ONE_OF(MODALITIES, f"{TENS} % {len(MODALITIES)}"), "subtype": ONE_OF(SUBTYPES, f"{TENS} % {len(SUBTYPES)}"), "heading": f"case when {TENS} % 3 = 0 then 'Secondary endpoints' else 'Study conduct' end", "text": text_sql(),
}
NOTES_SQL = "notes as (select " + ", ".join(f"{e} as {n}" for n, e in FIELDS.items()) + " from part)"
#: The dictionary of the notes' words by slot, whole words in lower case.
WORDS = {
    "drug": r"\b(teclistamab|talquetamab|daratumumab|lenalidomide|pomalidomide|carfilzomib)\b", "endpoint": r"\b(overall response rate|progression-free survival|adverse event)\b", "dose": r"\b([0-9.]+ mg/kg)",
    "study_arm": r"\b(arm [a-z])\b", "population": r"\b(multiple myeloma|dlbcl|n)\b", "biomarker": r"\b(bcma|rp2d|orr|auc)\b", "phase": r"\b(phase [0-9]|induction|maintenance|salvage)\b",
}
NEGATED = r"\bnot selected\b"


def notes(t: Tables, part: DataFrame | None = None) -> DataFrame:
    return (part or t.part).select(*[F.expr(e).alias(n) for n, e in FIELDS.items()])


def first_sql(pattern: str, group: int = 1, column: str = "text") -> str:
    return f"nullif(regexp_extract({column}, '{pattern}', {group}), '')"


def rules_sql(rules: list[tuple[str, str]], column: str = "text") -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '{p}') then '{name}'" for p, name in rules) + " end"


def in_sql(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


TREATMENT_SQL = {"regimen": rules_sql(C.REGIMENS), "line": f"coalesce({rules_sql(C.LINES_OF_THERAPY)}, '>=' || {first_sql(C.MANY_LINES)} || 'L')", "phase": f"upper({first_sql(C.THERAPY_PHASE)}[1]) || lower({first_sql(C.THERAPY_PHASE)}[2:])", "rp2d": first_sql(C.RP2D)}
VISIT_SQL = [None, *[first_sql(C.VISIT, k) for k in range(1, 6)]]
TEMPORAL_SQL = {
    "anchor": f"lower({first_sql(C.ANCHOR)})", "cycle": f"'C' || coalesce({VISIT_SQL[1]}, {VISIT_SQL[3]})", "day": f"'D' || coalesce({VISIT_SQL[2]}, {VISIT_SQL[4]})", "week": f"'W' || {VISIT_SQL[5]}",
    "window": f"{first_sql(C.WINDOW, 1)} || ' ' || {first_sql(C.WINDOW, 2)}", "timepoint": f"lower({first_sql(C.TIMEPOINT)})",
}


def projected(columns: dict[str, str]) -> str:
    return ", ".join(f'{e} as "{n}"' for n, e in columns.items())


@query(f"with {NOTES_SQL} select note_id, {projected(TREATMENT_SQL)} from notes")
def treatment_identity(t: Tables) -> DataFrame:
    return notes(t).select("note_id", C.treatment(F.col("text")).alias("x")).select("note_id", "x.*")


@query(f"with {NOTES_SQL} select note_id, {projected(TEMPORAL_SQL)} from notes")
def temporal_context(t: Tables) -> DataFrame:
    return notes(t).select("note_id", C.temporal(F.col("text")).alias("x")).select("note_id", "x.*")


@query(f"""with {NOTES_SQL}, r as (select *, upper({first_sql(C.CRITERIA)}) as raw from notes)
select note_id, coalesce({rules_sql(C.ENDPOINT_KINDS)}, 'GENERAL') as kind, case when contains(raw, 'INTERNATIONAL MYELOMA') then 'IMWG' when contains(raw, 'RESPONSE EVALUATION') then 'RECIST' else trim(raw) end as criteria,
trim({first_sql(C.THRESHOLD)}) as threshold, lower({first_sql(C.ASSESSOR)}) as assessor, lower({first_sql(C.ENDPOINT_TIME)}) as timepoint from r""")
def endpoint_identity(t: Tables) -> DataFrame:
    return notes(t).select("note_id", C.endpoint(F.col("text")).alias("x")).select("note_id", "x.*")


COUNT_SQL = "case " + " ".join(f"when c = '{w}' then '{n}'" for w, n in C.COUNT_WORDS.items()) + " else c end"


@query(f"""with {NOTES_SQL}, r as (select *, lower({first_sql(C.DISEASE_LONG)}) as full_name, lower(coalesce({first_sql(C.PRIOR_LINES, 1)}, {first_sql(C.PRIOR_LINES, 2)})) as c from notes)
select note_id, coalesce({first_sql(C.DISEASE_SHORT)}, case when contains(full_name, 'relapsed') and contains(full_name, 'refractory') then 'RRMM' when contains(full_name, 'newly diagnosed') then 'NDMM' when contains(full_name, 'smoldering') then 'SMM' when contains(full_name, 'multiple myeloma') then 'MM' else full_name[1:40] end,
 case when regexp_matches(text, '{C.MYELOMA_CRITERIA}') then 'MM' end) as disease, regexp_matches(text, '(?i)\\brelapsed\\b') as relapsed, regexp_matches(text, '(?i)\\brefractory\\b') as refractory, '≥' || {COUNT_SQL} as prior_lines, trim({first_sql(C.ECOG)}) as ecog, lower({first_sql(C.REFRACTORY)}) as refractoriness from r""")
def population_identity(t: Tables) -> DataFrame:
    return notes(t).select("note_id", C.population(F.col("text")).alias("x")).select("note_id", "x.*")


@query(f"""with {NOTES_SQL} select note_id, case when section in {in_sql(C.CITED_SECTIONS)} then 'CITED' when section in {in_sql(C.CURRENT_SECTIONS)} then 'CURRENT'
 when regexp_matches(text, '{C.THIS_STUDY}') then 'CURRENT' when regexp_matches(text, '{C.CITED}') then 'CITED' when regexp_matches(text, '{C.HISTORICAL}') then 'HISTORICAL' else 'GENERAL' end as context from notes""")
def study_context(t: Tables) -> DataFrame:
    return notes(t).select("note_id", C.context(F.col("section"), F.col("text")).alias("context"))


def number_sql(pattern: str, *groups: int) -> str:
    return "try_cast(coalesce(" + ", ".join(first_sql(pattern, g) for g in groups) + ") as double)"


def unit_sql(pattern: str, *groups: int) -> str:
    raw = "lower(coalesce(" + ", ".join(first_sql(pattern, g) for g in groups) + "))"
    return f"case when {raw} in {in_sql(C.TIME_UNITS)} then {raw} end"


STATISTICS_SQL = {
    "confidence_level": number_sql(C.CI_BOUNDS, 1), "lower_ci": number_sql(C.CI_BOUNDS, 2), "upper_ci": number_sql(C.CI_BOUNDS, 3), "ci_unit": unit_sql(C.CI_BOUNDS, 4), "sample_size": number_sql(C.SAMPLE_SIZE, 1, 2), "p_value": number_sql(C.P_VALUE, 1),
    "hazard_ratio": number_sql(C.HAZARD_RATIO, 1, 2), "odds_ratio": number_sql(C.ODDS_RATIO, 1, 2), "median": number_sql(C.MEDIAN, 1, 3), "median_unit": unit_sql(C.MEDIAN, 2, 4),
    "percentage": f"case when {number_sql(C.CI_BOUNDS, 2)} is null and {number_sql(C.P_VALUE, 1)} is null then {number_sql(C.PERCENTAGE, 1)} end",
}


@query(f"with {NOTES_SQL} select note_id, {projected(STATISTICS_SQL)} from notes")
def statistical_identity(t: Tables) -> DataFrame:
    """Interval, sample size, p-value, ratios, median and percentage with their units."""
    return notes(t).select("note_id", C.statistics(F.col("text")).alias("x")).select("note_id", "x.*")


ROLE_SQL = " or ".join(f"contains(lower(x), '{r}')" for r in C.ROLES)
QUERY_KIND_SQL = f"""coalesce({rules_sql(C.NUMERIC_KINDS, "x")}, case when regexp_matches(x, '{C.IDENTIFIER}') then 'IDENTIFIER' when not wide and regexp_matches(x, '{C.PERSON}') then 'PERSON'
 when {ROLE_SQL} then 'CLINICAL_ROLE' when not wide and organization then 'ORGANIZATION' else 'PHRASE' end)"""
ASKED_SQL = f"""{NOTES_SQL}, texts as (select 'note' as source, note_id as id, text as x, false as organization from notes union all select 'supplier', s_suppkey, s_name, s_suppkey % 2 = 0 from supplier
 union all select 'customer', c_custkey, c_name, false from customer union all select 'item', item_id, text, false from benchmark),
kinds as (select source, id, {QUERY_KIND_SQL} as query_kind from (select *, length(x) > 80 or contains(x, chr(10)) or length(x) - length(replace(x, '.', '')) >= 2 as wide from texts))"""


def asked_texts(t: Tables) -> DataFrame:
    rows = lambda d, source, key, text, org: d.select(F.lit(source).alias("source"), F.col(key).cast("long").alias("id"), F.col(text).alias("x"), org.alias("organization"))
    no = F.lit(False)
    out = rows(notes(t), "note", "note_id", "text", no).unionByName(rows(t.supplier, "supplier", "s_suppkey", "s_name", F.col("s_suppkey") % 2 == 0))
    return out.unionByName(rows(t.customer, "customer", "c_custkey", "c_name", no)).unionByName(rows(t.benchmark, "item", "item_id", "text", no))


@query(f"with {ASKED_SQL} select source, id::bigint as id, query_kind from kinds")
def query_classifier(t: Tables) -> DataFrame:
    """Kind of every query text: numeric kinds, identifier, person, role, organisation, phrase."""
    return asked_texts(t).select("source", "id", C.query_kind(F.col("x"), F.col("organization")).alias("query_kind"))


@query(f"""with {ASKED_SQL}, s(query_kind, retriever) as (values {", ".join(f"('{k}', '{r}')" for k, v in C.STRATEGIES.items() for r in v)})
select source, query_kind, retriever, count(*) as n from kinds join s using (query_kind) group by all""")
def strategy_fanout(t: Tables) -> DataFrame:
    """Each query goes to the retrievers of its kind."""
    rows = asked_texts(t).withColumn("query_kind", C.query_kind(F.col("x"), F.col("organization")))
    return rows.withColumn("retriever", F.explode(C.strategies(F.col("query_kind")))).groupBy("source", "query_kind", "retriever").agg(F.count("*").alias("n"))


# Facts: values of each slot, sorted; the first drug in the text is the primary one.
RAW_SQL = ", ".join(f"list_sort(list_distinct(regexp_extract_all(low, '{p}', 1))) as r_{n}" for n, p in WORDS.items())
HOLDS_SQL = f"(regexp_matches(v, '{C.DOSE_TERMS}'))"
SHORT_SQL = f"(upper(v) in {in_sql(C.ENDPOINT_SHORT)})"
FACTS_SQL = f"""{NOTES_SQL}, raw as (select *, {RAW_SQL} from (select *, lower(text) as low from notes)),
facts as (select *, r_drug as drug, list_sort(list_distinct(r_endpoint || list_filter(r_biomarker, lambda v: not {HOLDS_SQL} and {SHORT_SQL}))) as endpoint, list_sort(list_distinct(r_dose || list_filter(r_biomarker, lambda v: {HOLDS_SQL}))) as dose, r_study_arm as study_arm,
 case when regexp_matches(text, '{C.SAMPLE_SIZE}') then list_filter(r_population, lambda v: v <> 'n') else r_population end as population, list_filter(r_biomarker, lambda v: not {HOLDS_SQL} and not {SHORT_SQL}) as biomarker, r_phase as phase,
 {first_sql(WORDS["drug"], 1, "low")} as primary_drug, case when regexp_matches(low, '{NEGATED}') then ['dose'] else [] end as negated, {TREATMENT_SQL["line"]} as line from raw)"""


def with_facts(t: Tables, part: DataFrame | None = None) -> DataFrame:
    """Notes with a sorted array of values for each slot, repaired, and the other parts of a context."""
    low = F.lower("text")
    raw = {n: F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(p), F.lit(1)))) for n, p in WORDS.items()}
    rows = notes(t, part).select("*", *[c.alias(f"r_{n}") for n, c in raw.items()])
    fixed = C.repaired({n: F.col(f"r_{n}") for n in WORDS}, F.col("text").rlike(C.SAMPLE_SIZE))
    treatment = C.treatment(F.col("text"))
    return rows.select(
        *FIELDS, *[F.array_sort(fixed[n]).alias(n) for n in WORDS], C.first_match(low, WORDS["drug"]).alias("primary_drug"), F.when(low.rlike(NEGATED), F.array(F.lit("dose"))).otherwise(F.array().cast("array<string>")).alias("negated"),
        treatment["line"].alias("line"), C.temporal(F.col("text")).alias("temporal"), C.statistics(F.col("text")).alias("stats"),
    )


JOINED_SQL = ", ".join(f"array_to_string({n}, '|') as {n}" for n in WORDS)


@query(f"with {FACTS_SQL} select note_id, {JOINED_SQL} from facts")
def slot_facts(t: Tables) -> DataFrame:
    """Entities by slot, with dose terms and endpoint abbreviations moved out of biomarkers and a bare n out of populations."""
    return with_facts(t).select("note_id", *[F.array_join(n, "|").alias(n) for n in WORDS])


LABELS = {"drug": "MEDICATION", "endpoint": "CLINICAL_ENDPOINT", "dose": "DOSAGE", "study_arm": "ANATOMY", "population": "STUDY_POPULATION", "biomarker": "BIOMARKER", "phase": "TREATMENT_PHASE"}
ENTITIES_SQL = f"{NOTES_SQL}, ents as (" + " union all ".join(f"select note_id, '{LABELS[n]}' as label, unnest(regexp_extract_all(lower(text), '{p}', 1)) as entity from notes" for n, p in WORDS.items()) + ")"
RELABEL_SQL = f"case when label = 'ANATOMY' and regexp_matches(entity, '{C.ARM}') then 'STUDY_ARM' when label in ('CLINICAL_RESPONSE', 'BIOMARKER') and upper(entity) in {in_sql(C.ENDPOINT_SHORT)} then 'CLINICAL_ENDPOINT' when label = 'BIOMARKER' and upper(entity) in {in_sql(C.DOSE_FINDING)} then 'DOSAGE' when label = 'MEDICATION' and regexp_matches(entity, '{C.REGIMEN_SHORT}') then 'TREATMENT_NAME' else label end"


@query(f"with {ENTITIES_SQL} select label, {RELABEL_SQL} as fixed, count(*) as n, count(distinct note_id) as n_notes from ents group by all")
def entity_reclassification(t: Tables) -> DataFrame:
    """Labels of all entities before and after the rules."""
    found = F.array(*[F.struct(F.lit(LABELS[n]).alias("label"), F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(1)).alias("v")) for n, p in WORDS.items()])
    ents = notes(t).select("note_id", F.explode(found).alias("e")).select("note_id", "e.label", F.explode("e.v").alias("entity"))
    return ents.groupBy("label", C.relabelled(F.col("label"), F.col("entity")).alias("fixed")).agg(F.count("*").alias("n"), F.countDistinct("note_id").alias("n_notes"))


PLACES_SQL = f"{NOTES_SQL}, words as (select unnest(['teclistamab', 'response rate', 'overall response rate', 'cycle 1', 'cycle']) as word), spots as (select note_id, word, (position(word in lower(text)) - 1)::int as start, length(word)::int as n, length(word) / 30.0 as score from notes, words where contains(lower(text), word))"


@query(f"""with {PLACES_SQL}, best as (select * from (select *, row_number() over (partition by note_id, word, start // 5 order by score desc, start) as r from spots) where r = 1)
select note_id, word, start from best a where not exists (select 1 from best b where b.note_id = a.note_id and b.n > a.n and b.start <= a.start and b.start + b.n >= a.start + a.n)""")
def entity_dedup(t: Tables) -> DataFrame:
    """One entity for each text and place, and none inside a longer one."""
    words = ["teclistamab", "response rate", "overall response rate", "cycle 1", "cycle"]
    spots = notes(t).select("note_id", F.explode(F.array(*[F.struct(F.lit(w).alias("word"), (F.expr(f"locate('{w}', lower(text))") - 1).alias("start"), F.lit(len(w)).alias("n")) for w in words])).alias("e")).select("note_id", "e.*").filter("start >= 0")
    best = spots.groupBy("note_id", "word", F.expr("start div 5").alias("near")).agg(F.min("start").alias("start"), F.max("n").alias("n"))
    a, b = best.alias("a"), best.alias("b")
    inside = (F.col("a.note_id") == F.col("b.note_id")) & (F.col("b.n") > F.col("a.n")) & (F.col("b.start") <= F.col("a.start")) & (F.col("b.start") + F.col("b.n") >= F.col("a.start") + F.col("a.n"))
    return a.join(b, inside, "left_anti").select("note_id", "word", "start")


@query("""with w as (select item_id, doc_id, d.text, b.text as word, unnest(range(len(string_split(d.text, b.text)) - 1)) as i, string_split(d.text, b.text) as ps from benchmark b join documents d on contains(d.text, b.text)),
p as (select item_id, doc_id, (list_sum(list_transform(ps[1:i + 1], lambda x: length(x))) + i * length(word))::int as place from w)
select item_id, doc_id, place from (select *, row_number() over (partition by item_id, doc_id order by abs(place - 200), place) as r from p) where r = 1""")
def nearest_occurrence(t: Tables) -> DataFrame:
    """Of an entity's occurrences in a document the one nearest to where its object starts, here character 200."""
    from gleanery.plans.retrieval import literal_offsets

    near = F.struct(F.abs(F.col("char_start") - 200), "char_start")
    return literal_offsets(t).groupBy(F.col("query_id").alias("item_id"), "doc_id").agg(F.min_by("char_start", near).alias("place"))


# Pairs of an asked note and all notes of its brand.
SIDE_SQL = lambda s: ", ".join(f"{s}.{n} as {s}_{n}" for n in (*FIELDS, *WORDS, "primary_drug", "negated", "line"))
STAT_SIDE_SQL = lambda s: ", ".join(f"{s}.{n} as {s}_{n}" for n in STATISTICS_SQL)
PAIRS_SQL = f"""{FACTS_SQL}, full_facts as (select facts.*, {projected({f"t_{n}": e for n, e in TEMPORAL_SQL.items()})}, {projected({f"s_{n}": e for n, e in STATISTICS_SQL.items()})} from facts),
pairs as (select {SIDE_SQL("a")}, {SIDE_SQL("b")}, {", ".join(f"{s}.t_{n} as {s}_t_{n}" for s in "ab" for n in TEMPORAL_SQL)}, {", ".join(f"{s}.s_{n} as {s}_s_{n}" for s in "ab" for n in STATISTICS_SQL)}
 from full_facts a join full_facts b on a.brand = b.brand and a.note_id % 20 = 0 and a.note_id <> b.note_id)"""


def pairs(t: Tables) -> DataFrame:
    rows = with_facts(t)
    a = rows.filter("note_id % 20 = 0").select(F.col("brand"), F.struct(*rows.columns).alias("a"))
    b = rows.select("brand", F.struct(*rows.columns).alias("b"))
    return a.join(b, "brand").filter("a.note_id <> b.note_id").select("a", "b")


def classes(t: Tables, *factors: Factor) -> Classes:
    """The same pairs by classes of notes; where there are too many, queries score ``pairs`` one by one."""
    return Classes(with_facts(t, spread(t.part)), "brand", "note_id", F.col("note_id") % 20 == 0, list(factors))


def scored_once(t: Tables, a: dict[str, Column], b: dict[str, Column], **values: Column) -> DataFrame:
    """(query_id, note_id, ..) with values that read the fields ``a`` of the asked and ``b`` of the other note, scored once for each pair of classes."""
    held, names = classes(t, Factor(a, b, list(values.values()))), list(values)
    if held.known:
        return held.pairs(lambda v: iter([dict(zip(names, v[0], strict=True))]), ", ".join(f"{n} double" for n in names))
    return pairs(t).select(F.col("a.note_id").alias("query_id"), F.col("b.note_id").alias("note_id"), *[c.alias(n) for n, c in values.items()])


def fields(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def filled_slots() -> dict[str, Column]:
    return {n: filled(F.col(n)) for n in WORDS}


def slots(side: str) -> dict[str, Column]:
    return {n: F.col(f"{side}.{n}") for n in WORDS}


FAMILIES = {"teclistamab": "bispecific", "talquetamab": "bispecific", "lenalidomide": "imid", "pomalidomide": "imid", "daratumumab": "antibody", "carfilzomib": "inhibitor"}


def drugs_of_text() -> dict[str, Column]:
    """Of a text no more is read than which of the drugs that notes can name it has."""
    return {"text": digest(F.lower("text"), list(FAMILIES))}


FAMILY_SQL = lambda c: "case " + " ".join(f"when {c} = '{d}' then '{f}'" for d, f in FAMILIES.items()) + " end"
RELATION_SQL = f"case when len(list_intersect(a_drug, b_drug)) > 0 then 'EXACT' when {FAMILY_SQL('a_primary_drug')} = {FAMILY_SQL('b_primary_drug')} then 'SAME_FAMILY' when a_primary_drug is not null and b_primary_drug is not null then 'RELATED' end"


def relation() -> Column:
    family = lambda c: K.lookup(FAMILIES, c)
    a, b = F.col("a.primary_drug"), F.col("b.primary_drug")
    return F.when(F.arrays_overlap("a.drug", "b.drug"), "EXACT").when(family(a) == family(b), "SAME_FAMILY").when(a.isNotNull() & b.isNotNull(), "RELATED")


def companions(side: str) -> Column:
    return F.filter(f"{side}.drug", lambda d: d != F.col(f"{side}.primary_drug"))


COMPARATORS = ["drug", "endpoint", "population", "phase", "biomarker", "study_arm", "modality", "regimen", "temporal", "negation", "statistical"]
OUTCOMES = ["UNKNOWN", "MATCH", "CONFLICT", "RELATED", "SPECIALIZATION", "GENERALIZATION"]


def comparators() -> list[Column]:
    a, b = F.col("a"), F.col("b")
    plain = [K.slot(n, a[n], b[n]) for n in ("endpoint", "population", "phase", "biomarker", "study_arm")]
    return [
        K.drug(a["drug"], b["drug"], a["primary_drug"], relation()), *plain, K.modality(a["modality"], b["modality"]), K.regimen(a["line"], b["line"], companions("a"), companions("b")),
        K.temporal(a["temporal"], b["temporal"]), K.negation(a["negated"], b["negated"], slots("a"), slots("b")), K.statistical(a["stats"], b["stats"]),
    ]


def comparator_factors(values: Callable[[Column], list[Column]]) -> list[Factor]:
    """Each comparator with the fields that it reads."""
    read = [fields("drug", "primary_drug"), *[fields(n) for n in ("endpoint", "population", "phase", "biomarker", "study_arm")], fields("modality"), fields("line", "drug", "primary_drug"), fields("temporal"), fields("negated") | filled_slots(), fields("stats")]
    return [Factor(x, x, values(c)) for x, c in zip(read, comparators(), strict=True)]


def touch_sql(x: str, y: str) -> str:
    return f"len(list_filter({x}, lambda u: len(list_filter({y}, lambda v: contains(u, v) or contains(v, u))) > 0)) > 0"


def outcome_sql(clash: str, match: str, weight: float, severity: str) -> str:
    return f"case when {clash} then 'CONFLICT' when {match} then 'MATCH' else 'UNKNOWN' end as outcome, case when {clash} then {weight} else 0.0 end::double as weight, case when {clash} then '{severity}' else 'NONE' end as severity"


def comparator_sql() -> str:
    empty = lambda n: f"(len(a_{n}) = 0 or len(b_{n}) = 0)"
    out = []
    for n in ("endpoint", "population", "phase", "biomarker", "study_arm"):
        clash = f"(not {empty(n)} and not ({touch_sql(f'a_{n}', f'b_{n}')}))"
        out.append((n, outcome_sql(clash, f"not {empty(n)}", *K.CONFLICTS[n])))
    absent = "(a_primary_drug is not null and len(list_filter(b_drug, lambda v: contains(a_primary_drug, v) or contains(v, a_primary_drug))) = 0)"
    rel = f"coalesce({RELATION_SQL}, case when {touch_sql('a_drug', 'b_drug')} then 'EXACT' else 'DIFFERENT' end)"
    guard = f"({rel} = 'EXACT' and {absent})"
    of = lambda k: "case " + " ".join(f"when {rel} = '{r}' then " + (f"'{v[k]}'" if k != 1 else str(v[k])) for r, v in K.DRUG_RELATIONS.items()) + " end"
    out.append(("drug", f"case when {empty('drug')} then 'UNKNOWN' when {guard} then 'RELATED' else {of(0)} end as outcome, case when {empty('drug')} then 0.0 when {guard} then -0.10 else {of(1)} end::double as weight, case when {empty('drug')} then 'NONE' when {guard} then 'LOW' else {of(2)} end as severity"))
    group = lambda c: "case " + " ".join(f"when {c} = '{m}' then '{g}'" for m, g in K.MODALITY_GROUPS.items()) + " end"
    x, y = group("a_modality"), group("b_modality")
    out.append(("modality", outcome_sql(f"(({x}) <> ({y})) is true", f"({x}) = ({y})", *K.CONFLICTS["modality"])))
    with_ = lambda s: f"list_filter({s}_drug, lambda d: d <> {s}_primary_drug)"
    clash = f"((lower(a_line) <> lower(b_line)) is true or (len({with_('a')}) > 0 and len({with_('b')}) > 0 and len(list_intersect({with_('a')}, {with_('b')})) = 0))"
    out.append(("regimen", outcome_sql(clash, f"a_line is not null or len({with_('a')}) > 0", *K.CONFLICTS["regimen"])))
    worst = lambda clashes, match: (
        "case when " + " or ".join(f"({c}) is true" for c, _, _ in clashes) + f" then 'CONFLICT' when {match} then 'MATCH' else 'UNKNOWN' end as outcome, case " + " ".join(f"when ({c}) is true then {w}" for c, w, _ in clashes) + " else 0.0 end::double as weight, case "
        + " ".join(f"when ({c}) is true then '{s}'" for c, _, s in clashes) + " else 'NONE' end as severity"
    )
    times = sorted([(f"lower(a_t_{f}) <> lower(b_t_{f})", w, s) for f, (s, w) in K.TEMPORAL_FIELDS.items()], key=lambda c: -K.RANKS[c[2]])
    out.append(("temporal", worst(times, "true")))
    no = " or ".join(f"((list_contains(a_negated, '{n}') and not list_contains(b_negated, '{n}') and len(b_{n}) > 0) or (list_contains(b_negated, '{n}') and not list_contains(a_negated, '{n}') and len(a_{n}) > 0))" for n in WORDS)
    out.append(("negation", outcome_sql(f"({no})", "false", *K.CONFLICTS["negation"])))
    near = lambda n, ab, re: f"(a_s_{n} = b_s_{n} or abs(a_s_{n} - b_s_{n}) <= {ab}" + (f" or abs(a_s_{n} - b_s_{n}) <= {re} * greatest(abs(a_s_{n}), abs(b_s_{n}))" if re else "") + ")"
    stats = [(f"not {near(n, ab, re)}", w, s) for n, (ab, re, w, s) in K.NUMBERS.items()] + [(f"a_s_{n} <> b_s_{n}", w, s) for n, (w, s) in K.UNITS.items()]
    same = " or ".join([f"{near(n, ab, re)} is true" for n, (ab, re, _, _) in K.NUMBERS.items()] + [f"(a_s_{n} = b_s_{n}) is true" for n in K.UNITS])
    out.append(("statistical", worst(sorted(stats, key=lambda c: -K.RANKS[c[2]]), same)))
    return " union all ".join(f"select a_note_id as query_id, b_note_id as note_id, '{n}' as comparator, {e} from pairs" for n, e in out)


@query(f"with {PAIRS_SQL} {comparator_sql()}")
def comparator_results(t: Tables) -> DataFrame:
    """All eleven comparators of every pair."""
    at = lambda names, x: F.array_position(F.array(*map(F.lit, names)), x) - 1
    held = classes(t, *comparator_factors(lambda c: [at(OUTCOMES, c["outcome"]), c["weight"], at(K.RANKS, c["severity"])]))
    if not held.known:
        rows = pairs(t).select(F.col("a.note_id").alias("query_id"), F.col("b.note_id").alias("note_id"), F.explode(F.array(*comparators())).alias("c"))
        return rows.select("query_id", "note_id", F.col("c.name").alias("comparator"), "c.outcome", "c.weight", "c.severity")
    results: list[tuple] = []  # what a pair of classes can give; rows travel with its number
    for k, name in enumerate(COMPARATORS):
        cells = np.stack([x.ravel() for x in held.tables[k]], axis=1)
        found, number = np.unique(cells, axis=0, return_inverse=True)
        held.tables[k] = [(number.reshape(-1) + len(results)).astype(np.int32).reshape(held.tables[k][0].shape)]
        results += [(name, OUTCOMES[int(o)], float(w), list(K.RANKS)[int(s)]) for o, w, s in found]
    rows = held.pairs(lambda v: ({"number": x[0]} for x in v), "number int")
    of = lambda i: F.array(*[F.lit(r[i]) for r in results] or [F.lit(None)])[F.col("number")]
    return rows.select("query_id", "note_id", *[of(i).alias(n) for i, n in enumerate(("comparator", "outcome", "weight", "severity"))])


@query(f"with {PAIRS_SQL}, c as ({comparator_sql()}) select query_id, note_id, round(sum(weight), 6)::double as penalty, count_if(outcome = 'CONFLICT') as n_conflicts, count_if(outcome = 'MATCH') as n_matches from c group by 1, 2")
def contradiction_penalty(t: Tables) -> DataFrame:
    """Sum of the comparators' weights of every pair."""
    is_ = lambda c, o: (c["outcome"] == o).cast("long")
    packed = lambda c: F.round(c["weight"] * 1e6).cast("long") * 65536 + is_(c, "CONFLICT") * 256 + is_(c, "MATCH")
    held = classes(t, *comparator_factors(lambda c: [packed(c)]))
    if held.known:

        def summed(v):
            total = sum(x[0] for x in v).astype(np.int64)  # whole numbers, so the sum is exact: millionths, conflicts, matches
            yield {"penalty": (total >> 16) / 1e6, "n_conflicts": (total >> 8) & 255, "n_matches": total & 255}

        return held.pairs(summed, "penalty double, n_conflicts long, n_matches long")
    found = F.array(*comparators())
    count = lambda o: F.size(F.filter("c", lambda x: x["outcome"] == o)).cast("long")
    rows = pairs(t).select(F.col("a.note_id").alias("query_id"), F.col("b.note_id").alias("note_id"), found.alias("c"))
    return rows.select("query_id", "note_id", F.round(F.aggregate("c", F.lit(0.0), lambda s, x: s + x["weight"]), 6).alias("penalty"), count("CONFLICT").alias("n_conflicts"), count("MATCH").alias("n_matches"))


MATCHED_SQL = "len(list_filter(a_drug, lambda x: len(list_filter(b_drug, lambda y: contains(x, y) or contains(y, x))) > 0))"
DRUG_SQL = f"""case when len(a_drug) = 0 then 5.0 when len(b_drug) = 0 then case when len(list_filter(a_drug, lambda x: contains(lower(b_text), x))) > 0 then 3.0 else 0.0 end when {MATCHED_SQL} = 0 then coalesce(case {RELATION_SQL} when 'COMBINATION' then 4.0 when 'SAME_FAMILY' then 2.0 when 'RELATED' then 1.5 end, 0.0)
 else 20.0 * ({MATCHED_SQL} / len(a_drug)) * ({MATCHED_SQL} / len(b_drug)) / ({MATCHED_SQL} / len(a_drug) + {MATCHED_SQL} / len(b_drug)) end"""


@query(f"with {PAIRS_SQL} select a_note_id as query_id, b_note_id as note_id, round({DRUG_SQL}, 3)::double as score from pairs")
def drug_identity_score(t: Tables) -> DataFrame:
    score = K.drug_score(F.col("a.drug"), F.col("b.drug"), F.col("b.text"), relation())
    return scored_once(t, fields("drug", "primary_drug"), fields("drug", "primary_drug") | drugs_of_text(), score=F.round(score, 3))


UNION_SQL = lambda n: f"len(list_distinct(a_{n} || b_{n}))"
FACT_PARTS = {n: SLOT_WEIGHTS[n] for n in WORDS if n in SLOT_WEIGHTS}
FACT_TOTAL_SQL = " + ".join(f"case when len(a_{n}) > 0 then {w} else 0 end" for n, w in FACT_PARTS.items())
FACT_SQL = f"""case when {" and ".join(f"len(a_{n}) = 0" for n in WORDS)} then 5.0 when {" and ".join(f"len(b_{n}) = 0" for n in WORDS)} then 3.0 when ({FACT_TOTAL_SQL}) = 0 then 5.0
 else 10 * ({" + ".join(f"case when len(a_{n}) = 0 or len(b_{n}) = 0 then 0 else {w} * len(list_intersect(a_{n}, b_{n})) / {UNION_SQL(n)} end" for n, w in FACT_PARTS.items())}) / ({FACT_TOTAL_SQL}) end"""


@query(f"with {PAIRS_SQL} select a_note_id as query_id, b_note_id as note_id, round({FACT_SQL}, 3)::double as score from pairs")
def fact_overlap_score(t: Tables) -> DataFrame:
    return scored_once(t, fields(*WORDS), fields(*WORDS), score=F.round(K.fact_score(slots("a"), slots("b"), SLOT_WEIGHTS), 3))


def intent_sql() -> str:
    strong = " ".join(f"when a_kind = '{k}' and b_section in {in_sql(v[0])} then 10.0" for k, v in K.SECTIONS_OF.items())
    weak = " ".join(f"when a_kind = '{k}' and b_section in {in_sql(v[1])} then 6.0" for k, v in K.SECTIONS_OF.items())
    unfit = " ".join(f"when a_kind = '{k}' and b_section in {in_sql(v)} then 2.0" for k, v in K.UNFIT.items())
    plain = f"case {strong} {weak} {unfit} else 3.5 end"
    assertive = "a_kind in ('OBJECTIVE', 'EFFICACY')"
    return f"case when b_section in ('APPENDIX', 'ADMINISTRATIVE', 'REFERENCE') then 1.5 when b_section = 'BACKGROUND' then case when {assertive} then 2.5 else 4.0 end when a_kind not in {in_sql(list(K.SECTIONS_OF))} then 5.0 when {assertive} and b_statement in ('GENERAL', 'PROTOCOL', 'BACKGROUND') then least({plain}, 2.5) else {plain} end"


#: Keywords of endpoint categories.
CONCEPTS = {"RESPONSE": ["overall response rate", " orr "], "SURVIVAL": ["progression-free survival", " pfs "], "SAFETY": ["adverse event", "cytokine release"], "EXPOSURE": ["pharmacokinetic", " auc "]}
CONCEPT_SQL = lambda c: (
    "list_filter([" + ", ".join("case when " + " or ".join(f"contains(' ' || lower({c}) || ' ', '{w}')" for w in ws) + f" then '{n}' end" for n, ws in CONCEPTS.items()) + "], lambda x: x is not null)"
)
SUB_SQL = lambda c: f"case when len({CONCEPT_SQL(c)}) = 1 then ({CONCEPT_SQL(c)})[1] end"


@query(f"with {NOTES_SQL} select note_id, {SUB_SQL('text')} as sub_intent from notes")
def endpoint_sub_intent(t: Tables) -> DataFrame:
    """The one endpoint category of a note; null for none or several."""
    return notes(t).select("note_id", K.sub_intent(F.col("text"), CONCEPTS).alias("sub_intent"))


@query(f"with {PAIRS_SQL} select a_note_id as query_id, b_note_id as note_id, ({intent_sql()})::double as score from pairs")
def intent_alignment_score(t: Tables) -> DataFrame:
    return scored_once(t, fields("kind"), fields("section", "statement"), score=K.intent_score(F.col("a.kind"), F.col("b.section"), F.col("b.statement")))


SAYS_SQL = lambda c, ws: "(" + " or ".join(f"contains(lower({c}), '{w}')" for w in ws) + ")"
EVALUATES = ("evaluate", "assess", "measure", "determine")
COMPARES = ("compare", "versus", " vs ", "superiority", "non-inferior", "combination", "all arms")


@query(f"""with {PAIRS_SQL}, i as (select *, ({intent_sql()})::double as s, {SUB_SQL("a_text")} as x, {SUB_SQL("b_text")} as y from pairs),
j as (select *, case when s >= 7 and a_kind in ('OBJECTIVE', 'EFFICACY') and {SAYS_SQL("a_text", ("evaluate", "assess", "measure", "determine"))} and not {SAYS_SQL("a_text", COMPARES)} and {SAYS_SQL("b_text", COMPARES)} then greatest(s - 3.5, 0) else s end as f from i)
select a_note_id as query_id, b_note_id as note_id, (case when a_kind in ('OBJECTIVE', 'EFFICACY') and f >= 2 and x = y then least(f + 2.0, 10.0) when a_kind in ('OBJECTIVE', 'EFFICACY') and f >= 2 and x <> y then greatest(f - 2.5, 0.0) else f end)::double as score from j""")
def sub_intent_refinement(t: Tables) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    score = K.intent_score(a["kind"], b["section"], b["statement"])
    low, sub = F.lower("text"), {"sub": K.sub_intent(F.col("text"), CONCEPTS)}
    held = classes(t, Factor(
        fields("kind") | sub | {"text": digest(low, [*EVALUATES, *COMPARES])}, fields("section", "statement") | sub | {"text": digest(low, list(COMPARES))},
        [K.refined_intent(score, a["kind"], a["text"], b["text"], a["sub"], b["sub"])],
    ))
    if held.known:
        return held.pairs(lambda v: iter([{"score": v[0][0]}]), "score double")
    out = K.refined_intent(score, a["kind"], a["text"], b["text"], K.sub_intent(a["text"], CONCEPTS), K.sub_intent(b["text"], CONCEPTS))
    return pairs(t).select(a["note_id"].alias("query_id"), b["note_id"].alias("note_id"), out.alias("score"))


FILLED_SQL = lambda s: "list_filter([" + ", ".join(f"case when len({s}_{n}) > 0 then '{n}' end" for n in WORDS) + "], lambda x: x is not null)"


@query(f"with {PAIRS_SQL}, f as (select a_note_id as query_id, b_note_id as note_id, {FILLED_SQL('a')} as x, {FILLED_SQL('b')} as y from pairs) select query_id, note_id, round(case when len(x) = 0 then 5.0 when len(y) = 0 then 0.0 else 10 * len(list_intersect(x, y)) / len(x) end, 3)::double as score from f")
def entity_family_recall(t: Tables) -> DataFrame:
    """Share of the query's families of entities that the candidate has too."""
    families = lambda s: F.filter(F.array(*[F.when(F.size(c) > 0, n) for n, c in slots(s).items()]), lambda x: x.isNotNull())
    return scored_once(t, filled_slots(), filled_slots(), score=F.round(K.family_recall(families("a"), families("b")), 3))


@query(f"with {FACTS_SQL} select note_id, (case section {' '.join(f"when '{s}' then {b}" for s, b in K.SECTION_BOOSTS.items())} else 1.0 end)::double as boost, least((note_id % 2 = 0)::int * 4.0 + (note_id % 3 = 0)::int * 3.0 + (note_id % 5 = 0)::int * 2.0 + (note_id % 7 = 0)::int * 1.0, 10.0)::double as points, (case when contains(lower(text), 'mmy') or len(drug) > 1 then 10.0 else 0.0 end)::double as asset from facts")
def section_and_source_points(t: Tables) -> DataFrame:
    """Boost of the section, points of the retrievers that found a note, and whether it names an asset."""
    i = F.col("note_id")
    sources = F.filter(F.array(*[F.when(i % n == 0, s) for n, s in ((2, "literal"), (3, "ontology"), (5, "bm25"), (7, "vector"))]), lambda x: x.isNotNull())
    asset = F.when(F.contains(F.lower("text"), F.lit("mmy")) | (F.size("drug") > 1), 10.0).otherwise(0.0)
    return with_facts(t).select("note_id", K.section_boost(F.col("section")).alias("boost"), K.source_points(sources).alias("points"), asset.alias("asset"))


STRUCTURED_SQL = "(len(a_drug) > 0 or len(a_endpoint) > 0 or len(a_dose) > 0)"
INTERACTION_SQL = f"case when d >= 6.5 and f >= 5.5 then 0.5 when d >= 4 and f >= 3.5 then 0.2 when d >= 5 and f <= 1 and {STRUCTURED_SQL} then -0.3 when d <= 1.5 and f <= 1 and {STRUCTURED_SQL} then -0.2 else 0.0 end"
HAS_SQL = lambda s: "(" + " or ".join(f"len({s}_{n}) > 0" for n in WORDS) + ")"
ASSERT_SQL = f"a_kind in {in_sql(K.ASSERTIONS)}"
STRUCT_SQL = f"""greatest(-3.0, case when {ASSERT_SQL} and b_subtype = 'ABBREVIATION_TABLE' then -2.0 when {ASSERT_SQL} and b_subtype = 'DEFINITION' then -1.0 when {ASSERT_SQL} and b_subtype = 'SCHEDULE_MATRIX' then -0.8 else 0.0 end
 + case when len(a_drug) > 0 and len(a_endpoint) > 0 and not (len(b_drug) > 0 and len(b_endpoint) > 0) then -0.6 else 0 end + case when a_kind in ('OBJECTIVE', 'EFFICACY', 'DOSING', 'SAFETY') and len(a_dose) > 0 and len(b_dose) = 0 then -0.4 else 0 end
 + case when a_kind in ('OBJECTIVE', 'EFFICACY', 'DOSING') and len(a_study_arm) > 0 and len(b_study_arm) = 0 then -0.4 else 0 end + case when {ASSERT_SQL} and b_statement in ('GENERAL', 'BACKGROUND') then -0.4 else 0 end
 + case when {HAS_SQL("b")} and ((a_kind in ('OBJECTIVE', 'EFFICACY') and len(b_endpoint) = 0) or (a_kind in ('DOSING', 'SAFETY') and len(b_dose) = 0)) then -0.25 else 0 end)"""


def structural() -> Column:
    both = lambda s: (F.size(f"{s}.drug") > 0) & (F.size(f"{s}.endpoint") > 0)
    return K.structural(F.col("a.kind"), F.col("b.subtype"), F.col("b.statement"), slots("a"), slots("b"), both("a"), both("b"))


@query(f"with {PAIRS_SQL} select a_note_id as query_id, b_note_id as note_id, round({STRUCT_SQL}, 3)::double as penalty from pairs")
def structural_issues(t: Tables) -> DataFrame:
    return scored_once(t, fields("kind") | filled_slots(), fields("subtype", "statement") | filled_slots(), penalty=F.round(structural(), 3))


SCORED_SQL = f"scored as (select *, {DRUG_SQL} as d, {FACT_SQL} as f, {STRUCT_SQL} as p from pairs)"


def scores() -> dict[str, Column]:
    return {"d": K.drug_score(F.col("a.drug"), F.col("b.drug"), F.col("b.text"), relation()), "f": K.fact_score(slots("a"), slots("b"), SLOT_WEIGHTS), "p": structural()}


def scored(t: Tables) -> DataFrame:
    return pairs(t).withColumns(scores())


def score_fields(a: tuple[str, ...] = (), b: tuple[str, ...] = ()) -> tuple[dict[str, Column], dict[str, Column]]:
    """What drug and fact scores read of both sides."""
    return fields("primary_drug", *WORDS, *a), fields("primary_drug", *WORDS, *b) | drugs_of_text()


def co_evidence(d: Column, f: Column) -> Column:
    return K.interaction(d, f, (F.size("a.drug") > 0) | (F.size("a.endpoint") > 0) | (F.size("a.dose") > 0))


@query(f"with {PAIRS_SQL}, {SCORED_SQL} select a_note_id as query_id, b_note_id as note_id, ({INTERACTION_SQL})::double as bonus from scored")
def interaction_bonus(t: Tables) -> DataFrame:
    s = scores()
    return scored_once(t, *score_fields(), bonus=co_evidence(s["d"], s["f"]))


@query(f"""with {PAIRS_SQL}, {SCORED_SQL}, l as (select *, {INTERACTION_SQL} as i from scored),
m as (select a_note_id as query_id, b_note_id as note_id, array_to_string(list_filter([case when d >= 6 then 'drug' end, case when f >= 5 then 'facts' end, case when i >= 0.4 then 'co-evidence' end], lambda x: x is not null), ', ') as good,
 array_to_string(list_filter([case when f <= 1 and {HAS_SQL("a")} then 'facts' end, case when p <= -1 then 'structure' end, case when i <= -0.2 then 'drug-fact gap' end], lambda x: x is not null), ', ') as bad from l)
select query_id, note_id, case when good = '' and bad = '' then 'Marginal: weak evidence across all signals' when good = '' then 'Rejected: ' || bad || ' conflict' when bad = '' then 'Accepted: ' || good || ' aligned' else 'Partial: matched [' || good || '] but conflicts [' || bad || ']' end as decision from m""")
def decision_explanation(t: Tables) -> DataFrame:
    asked = F.lit(False)
    for c in slots("a").values():
        asked = asked | (F.size(c) > 0)
    s = scores()
    i, f = co_evidence(s["d"], s["f"]), s["f"]
    good = {"drug": s["d"] >= 6, "facts": f >= 5, "co-evidence": i >= 0.4}
    bad = {"facts": (f <= 1) & asked, "structure": s["p"] <= -1, "drug-fact gap": i <= -0.2}
    held = [*good.values(), *bad.values()]
    rows = scored_once(t, *score_fields(("kind",), ("subtype", "statement")), flags=sum((F.when(c, float(1 << k)).otherwise(0.0) for k, c in enumerate(held)), F.lit(0.0)))
    flag = [F.col("id").bitwiseAND(1 << k) > 0 for k in range(len(held))]
    names = lambda kinds, flags: F.filter(F.array(*[F.when(x, n) for n, x in zip(kinds, flags, strict=True)]), lambda n: n.isNotNull())
    worded = t.spark.range(1 << len(held)).select("id", K.decision(names(good, flag[: len(good)]), names(bad, flag[len(good) :])).alias("decision")).collect()
    return rows.select("query_id", "note_id", F.array(*[F.lit(r["decision"]) for r in sorted(worded)])[F.col("flags").cast("int")].alias("decision"))


@query(f"""with {FACTS_SQL}, e as (select note_id, {" or ".join(f"len(r_{n}) > 0" for n in WORDS)} as entities, len(drug) + len(endpoint) + len(dose) > 0 as facts, len(drug) + len(endpoint) > 0 as effective, primary_drug is not null and line is not null as ids from facts)
select note_id, case when not entities and not facts and not effective then 'ner' when entities and not facts and not effective then 'fact_extractor' when not effective then 'effective_facts_propagator' when not ids then 'identity_builder' else 'complete' end as stage from e""")
def enrichment_diagnosis(t: Tables) -> DataFrame:
    rows = with_facts(t)
    some = lambda *names: F.coalesce(*[F.lit(None)]) if not names else sum((F.size(n) for n in names), F.lit(0)) > 0
    entities = F.lower("text").rlike("|".join(WORDS.values()))
    return rows.select("note_id", K.diagnosis(entities, some("drug", "endpoint", "dose"), some("drug", "endpoint"), F.col("primary_drug").isNotNull() & F.col("line").isNotNull()).alias("stage"))


# Fusion terms over the same pairs.
@query(f"with {PAIRS_SQL} select a_note_id as query_id, b_note_id as note_id, (case when a_kind in ('OBJECTIVE', 'EFFICACY') and contains(lower(b_heading), 'secondary') then -0.25 when a_kind in ('OBJECTIVE', 'EFFICACY') and b_section = 'ELIGIBILITY' then -0.20 when a_kind in ('OBJECTIVE', 'EFFICACY') and b_section in ('BACKGROUND', 'APPENDIX') then -0.15 else 0.0 end)::double as penalty from pairs")
def section_drift(t: Tables) -> DataFrame:
    return scored_once(t, fields("kind"), fields("heading", "section"), penalty=K.section_drift(F.col("a.kind"), F.col("b.heading"), F.col("b.section")))


ALL_SQL = lambda s: "list_distinct(" + " || ".join(f"{s}_{n}" for n in WORDS) + ")"
PROXY = [("drug", "endpoint"), ("drug", "dose"), ("drug", "study_arm")]
PROXY_SQL = lambda x, y: (f"(len(a_{x}) > 0 and len(a_{y}) > 0)", f"(len(a_{x}) > 0 and len(a_{y}) > 0 and len(b_{x}) > 0 and len(b_{y}) > 0 and (len(list_intersect(a_{x}, b_{x})) > 0 or len(list_intersect(a_{y}, b_{y})) > 0))")


@query(f"""with {PAIRS_SQL}, e as (select *, {ALL_SQL("a")} as x, {ALL_SQL("b")} as y, {" + ".join(f"{PROXY_SQL(*p)[0]}::int" for p in PROXY)} as checked, {" + ".join(f"{PROXY_SQL(*p)[1]}::int" for p in PROXY)} as matched from pairs)
select a_note_id as query_id, b_note_id as note_id, round(case when len(x) = 0 or len(y) = 0 then 0.0 else 0.10 * len(list_intersect(x, y)) / len(list_distinct(x || y)) end, 6)::double as entity_term, round(case when checked > 0 then matched / checked else 0.0 end, 6)::double as relation_proxy,
round(0.15 * (0.7 * case when len(a_drug) = 0 or len(b_drug) = 0 then 0 else len(list_intersect(a_drug, b_drug)) / greatest(len(a_drug), len(b_drug)) end + 0.3 * case when len(a_endpoint) = 0 or len(b_endpoint) = 0 then 0 else len(list_intersect(a_endpoint, b_endpoint)) / greatest(len(a_endpoint), len(b_endpoint)) end), 6)::double as identity_bonus,
(case when (len(a_drug) > 0 or len(a_endpoint) > 0) and len(b_drug) = 0 and len(b_endpoint) = 0 then -0.40 else 0.0 end)::double as zero_identity, (case when not {HAS_SQL("b")} then -0.25 else 0.0 end)::double as zero_enrichment from e""")
def fusion_terms(t: Tables) -> DataFrame:
    """Entity Jaccard, relation proxy, identity bonus and the two absence penalties of every pair."""
    every = lambda s: F.array_distinct(F.flatten(F.array(*slots(s).values())))
    share = lambda n: F.when(K.either_empty(F.col(f"a.{n}"), F.col(f"b.{n}")), 0.0).otherwise(F.size(F.array_intersect(f"a.{n}", f"b.{n}")) / F.greatest(F.size(f"a.{n}"), F.size(f"b.{n}")))
    x, y = every("a"), every("b")
    jaccard = F.when(K.either_empty(x, y), 0.0).otherwise(0.10 * F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    asked, found = (F.size("a.drug") > 0) | (F.size("a.endpoint") > 0), (F.size("b.drug") > 0) | (F.size("b.endpoint") > 0)
    return scored_once(
        t, fields(*WORDS), fields(*WORDS), entity_term=F.round(jaccard, 6), relation_proxy=F.round(K.pair_proxy(slots("a"), slots("b"), PROXY), 6),
        identity_bonus=F.round(0.15 * (0.7 * share("drug") + 0.3 * share("endpoint")), 6), zero_identity=F.when(asked & ~found, -0.40).otherwise(0.0), zero_enrichment=F.when(F.size(y) == 0, -0.25).otherwise(0.0),
    )
