"""Comparators between a query's and a candidate's clinical contexts, and the features of the composite score, as Column expressions.

A context is a struct: ``facts`` with an array of lower-case values for each slot, ``treatment``, ``temporal``, ``stats``,
``modality`` and ``negated``. A comparator gives a struct (name, outcome, weight, severity).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight and severity of a conflict in each dimension.
CONFLICTS = {
    "drug": (-0.35, "HIGH"), "endpoint": (-0.28, "MEDIUM"), "population": (-0.20, "LOW"), "phase": (-0.18, "LOW"), "biomarker": (-0.15, "LOW"), "study_arm": (-0.15, "LOW"), "modality": (-0.22, "MEDIUM"), "regimen": (-0.18, "MEDIUM"), "negation": (-0.28, "HIGH"),
}
#: Outcome, weight and severity by the relation of drugs.
DRUG_RELATIONS = {"EXACT": ("MATCH", 0.0, "NONE"), "COMBINATION": ("RELATED", -0.10, "LOW"), "SAME_FAMILY": ("SPECIALIZATION", -0.18, "LOW"), "RELATED": ("GENERALIZATION", -0.25, "LOW"), "DIFFERENT": ("CONFLICT", -0.35, "HIGH")}
MODALITY_GROUPS = {"OBJECTIVE": "assertion", "ENDPOINT": "assertion", "EFFICACY": "assertion", "PROCEDURE": "operational", "REQUIREMENT": "operational", "ELIGIBILITY": "operational", "DOSING": "operational", "OBSERVATION": "evidence", "RESULT": "evidence"}
TEMPORAL_FIELDS = {"cycle": ("MEDIUM", -0.15), "day": ("LOW", -0.08), "week": ("LOW", -0.08), "window": ("LOW", -0.05)}
#: Absolute and relative tolerance, weight and severity of each number.
NUMBERS = {
    "sample_size": (0.0, 0.0, -0.28, "MEDIUM"), "confidence_level": (0.0, 0.0, -0.10, "LOW"), "p_value": (5e-5, 0.0, -0.30, "HIGH"), "hazard_ratio": (0.0, 0.015, -0.35, "HIGH"), "odds_ratio": (0.0, 0.015, -0.35, "HIGH"),
    "lower_ci": (0.0, 0.015, -0.25, "MEDIUM"), "upper_ci": (0.0, 0.015, -0.25, "MEDIUM"), "median": (0.0, 0.015, -0.25, "MEDIUM"), "percentage": (0.5, 0.0, -0.22, "MEDIUM"),
}
UNITS = {"median_unit": (-0.15, "LOW"), "ci_unit": (-0.10, "LOW")}
RANKS = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "FATAL": 4}
#: Sections that fit a kind of query well and somewhat, and those that can't fit.
SECTIONS_OF = {
    "OBJECTIVE": (["OBJECTIVES", "ENDPOINTS", "SYNOPSIS"], ["EFFICACY", "DESIGN"]), "EFFICACY": (["EFFICACY", "ENDPOINTS", "OBJECTIVES"], ["RESULTS", "SYNOPSIS"]), "SAFETY": (["SAFETY", "ADVERSE_EVENTS", "TOLERABILITY"], ["BENEFIT_RISK", "ELIGIBILITY"]),
    "DOSING": (["TREATMENT", "PROCEDURES"], ["DESIGN", "PK"]), "POPULATION": (["ELIGIBILITY", "POPULATION"], ["DEMOGRAPHICS", "DESIGN"]), "PROTOCOL": (["DESIGN", "SYNOPSIS"], ["PROCEDURES", "OBJECTIVES"]),
}
UNFIT = {"OBJECTIVE": ["PROCEDURES", "MANUFACTURING", "CMC", "FORMULATION", "CHEMISTRY", "CHARACTERIZATION"], "EFFICACY": ["PROCEDURES", "MANUFACTURING", "CMC"], "DOSING": ["MANUFACTURING", "CMC", "CHARACTERIZATION"], "SAFETY": ["MANUFACTURING", "CMC"]}
SECTION_BOOSTS = {"OBJECTIVES": 1.50, "ENDPOINTS": 1.40, "SYNOPSIS": 1.35, "DESIGN": 1.25, "ELIGIBILITY": 1.15, "EFFICACY": 1.10, "BENEFIT_RISK": 1.05, "SAFETY": 1.00, "TREATMENT": 0.95, "POPULATION": 0.90, "PROCEDURES": 0.85, "STATISTICS": 0.85, "PK": 0.80, "BIOMARKER": 0.80, "BACKGROUND": 0.70, "APPENDIX": 0.60, "OTHER": 0.90}
ASSERTIONS = ["OBJECTIVE", "EFFICACY", "DOSING", "SAFETY", "PHARMACOKINETICS"]
REQUIRED = {"OBJECTIVE": ["dose", "study_arm"], "EFFICACY": ["dose", "study_arm"], "DOSING": ["dose", "study_arm"], "SAFETY": ["dose"]}
EXPECTED = {"OBJECTIVE": "endpoint", "EFFICACY": "endpoint", "DOSING": "dose", "SAFETY": "dose"}
SOURCE_POINTS = {"literal": 4.0, "ontology": 3.0, "bm25": 2.0, "vector": 1.0}


def result(name: str, outcome: Column, weight: Column, severity: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), outcome.alias("outcome"), weight.cast("double").alias("weight"), severity.alias("severity"))


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def touch(a: Column, b: Column) -> Column:
    """Whether a value of one array contains, or is contained in, one of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))


def either_empty(a: Column, b: Column) -> Column:
    return (F.size(a) == 0) | (F.size(b) == 0)


def slot(name: str, a: Column, b: Column) -> Column:
    """UNKNOWN if either side has no value, MATCH if any two touch, else CONFLICT."""
    weight, severity = CONFLICTS[name]
    clash = ~either_empty(a, b) & ~touch(a, b)
    return result(name, F.when(either_empty(a, b), "UNKNOWN").when(clash, "CONFLICT").otherwise("MATCH"), F.when(clash, weight).otherwise(0.0), F.when(clash, severity).otherwise("NONE"))


def drug(a: Column, b: Column, primary: Column, relation: Column) -> Column:
    """By the relation of the drugs, where there is one, else by shared values; a match without the query's primary drug is only RELATED."""
    absent = primary.isNotNull() & ~F.exists(b, lambda v: F.contains(primary, v) | F.contains(v, primary))
    of = lambda k: lookup({r: v[k] for r, v in DRUG_RELATIONS.items()}, F.coalesce(relation, F.when(touch(a, b), "EXACT").otherwise("DIFFERENT")))
    outcome = F.when(either_empty(a, b), "UNKNOWN").when((of(0) == "MATCH") & absent, "RELATED").otherwise(of(0))
    weight = F.when(either_empty(a, b), 0.0).when((of(0) == "MATCH") & absent, -0.10).otherwise(of(1))
    return result("drug", outcome, weight, F.when(either_empty(a, b), "NONE").when((of(0) == "MATCH") & absent, "LOW").otherwise(of(2)))


def modality(a: Column, b: Column) -> Column:
    """Groups of modalities must agree; a general or unknown one says nothing."""
    x, y = lookup(MODALITY_GROUPS, a), lookup(MODALITY_GROUPS, b)
    clash = F.coalesce(x != y, F.lit(False))
    return result("modality", F.when(x.isNull() | y.isNull(), "UNKNOWN").when(clash, "CONFLICT").otherwise("MATCH"), F.when(clash, CONFLICTS["modality"][0]).otherwise(0.0), F.when(clash, CONFLICTS["modality"][1]).otherwise("NONE"))


def regimen(line_a: Column, line_b: Column, with_a: Column, with_b: Column) -> Column:
    """Line of therapy and companion drugs must not disagree."""
    clash = F.coalesce(F.lower(line_a) != F.lower(line_b), F.lit(False)) | (~either_empty(with_a, with_b) & ~F.arrays_overlap(with_a, with_b))
    known = line_a.isNotNull() | (F.size(with_a) > 0)
    return result("regimen", F.when(clash, "CONFLICT").when(known, "MATCH").otherwise("UNKNOWN"), F.when(clash, CONFLICTS["regimen"][0]).otherwise(0.0), F.when(clash, CONFLICTS["regimen"][1]).otherwise("NONE"))


def worst(name: str, clashes: list[tuple[Column, float, str]], matched: Column) -> Column:
    """The first of the most severe clashes; else MATCH or UNKNOWN."""
    order = sorted(clashes, key=lambda c: -RANKS[c[2]])
    pick = lambda k, other: reduce(lambda rest, c: F.when(c[0], c[k]).otherwise(rest), order[::-1], F.lit(other))
    any_clash = reduce(lambda x, y: x | y, [c[0] for c in order])
    return result(name, F.when(any_clash, "CONFLICT").when(matched, "MATCH").otherwise("UNKNOWN"), pick(1, 0.0), pick(2, "NONE"))


def temporal(a: Column, b: Column) -> Column:
    """Only the most severe difference counts; contexts that don't differ match."""
    clashes = [(F.coalesce(F.lower(a[f]) != F.lower(b[f]), F.lit(False)), weight, severity) for f, (severity, weight) in TEMPORAL_FIELDS.items()]
    return worst("temporal", clashes, F.lit(True))


def agree(x: Column, y: Column, absolute: float, relative: float) -> Column:
    near = (x == y) | (F.abs(x - y) <= absolute)
    return near | (F.abs(x - y) <= relative * F.greatest(F.abs(x), F.abs(y))) if relative else near


def statistical(a: Column, b: Column) -> Column:
    """Numbers that both sides have must agree within their tolerance, units exactly; the most severe difference counts."""
    clashes, same = [], []
    for name, (absolute, relative, weight, severity) in NUMBERS.items():
        near = agree(a[name], b[name], absolute, relative)
        clashes.append((F.coalesce(~near, F.lit(False)), weight, severity))
        same.append(F.coalesce(near, F.lit(False)))
    for name, (weight, severity) in UNITS.items():
        clashes.append((F.coalesce(a[name] != b[name], F.lit(False)), weight, severity))
        same.append(F.coalesce(a[name] == b[name], F.lit(False)))
    return worst("statistical", clashes, reduce(lambda x, y: x | y, same))


def negation(no_a: Column, no_b: Column, facts_a: dict[str, Column], facts_b: dict[str, Column]) -> Column:
    """A slot that one side negates and the other affirms."""
    clash = F.lit(False)
    for name in facts_a:
        a, b = F.array_contains(no_a, name), F.array_contains(no_b, name)
        clash = clash | (a & ~b & (F.size(facts_b[name]) > 0)) | (b & ~a & (F.size(facts_a[name]) > 0))
    return result("negation", F.when(clash, "CONFLICT").otherwise("UNKNOWN"), F.when(clash, CONFLICTS["negation"][0]).otherwise(0.0), F.when(clash, CONFLICTS["negation"][1]).otherwise("NONE"))


def drug_score(a: Column, b: Column, text: Column, relation: Column) -> Column:
    """0 to 10: F1 of matching drugs, else by their relation, else 3 for a mention in the text; 5 if none is asked."""
    matched = F.size(F.filter(a, lambda x: F.when(F.length(x) <= 4, F.array_contains(b, x)).otherwise(F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))))
    recall, precision = matched / F.size(a), matched / F.size(b)
    by_relation = F.coalesce(lookup({"COMBINATION": 4.0, "SAME_FAMILY": 2.0, "RELATED": 1.5}, relation), F.lit(0.0))
    mention = F.exists(a, lambda x: F.when(F.length(x) > 4, F.contains(F.lower(text), x)).otherwise(F.contains(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), F.concat(F.lit(" "), x, F.lit(" ")))))
    return F.when(F.size(a) == 0, 5.0).when(F.size(b) == 0, F.when(mention, 3.0).otherwise(0.0)).when(matched == 0, by_relation).otherwise(10 * 2 * recall * precision / (recall + precision))


def intent_score(kind: Column, section: Column, statement: Column) -> Column:
    """0 to 10 by how well a section suits the kind of query."""
    assertive = kind.isin("OBJECTIVE", "EFFICACY")
    of = lambda k: F.coalesce(F.array_contains(F.try_element_at(F.create_map(*[x for t, v in SECTIONS_OF.items() for x in (F.lit(t), F.array(*map(F.lit, v[k])))]), kind), section), F.lit(False))
    unfit = F.coalesce(F.array_contains(F.try_element_at(F.create_map(*[x for t, v in UNFIT.items() for x in (F.lit(t), F.array(*map(F.lit, v)))]), kind), section), F.lit(False))
    plain = F.when(of(0), 10.0).when(of(1), 6.0).when(unfit, 2.0).otherwise(3.5)
    fitted = F.when(assertive & statement.isin("GENERAL", "PROTOCOL", "BACKGROUND"), F.least(plain, F.lit(2.5))).otherwise(plain)
    return (
        F.when(section.isin("APPENDIX", "ADMINISTRATIVE", "REFERENCE"), 1.5)
        .when(section == "BACKGROUND", F.when(assertive, 2.5).otherwise(4.0))
        .when(~kind.isin(*SECTIONS_OF), 5.0)
        .otherwise(fitted)
    )


def refined_intent(score: Column, kind: Column, asked: Column, text: Column, sub_a: Column, sub_b: Column) -> Column:
    """A query that evaluates loses by a candidate that compares; a shared endpoint gains, another one loses."""
    says = lambda t, words: reduce(lambda x, y: x | y, [F.contains(F.lower(t), F.lit(w)) for w in words])
    compares = ("compare", "versus", " vs ", "superiority", "non-inferior", "combination", "all arms")
    assertive = kind.isin("OBJECTIVE", "EFFICACY")
    crossed = (score >= 7) & assertive & says(asked, ("evaluate", "assess", "measure", "determine")) & ~says(asked, compares) & says(text, compares)
    first = F.when(crossed, F.greatest(score - 3.5, F.lit(0.0))).otherwise(score)
    both = assertive & (first >= 2) & sub_a.isNotNull() & sub_b.isNotNull()
    return F.when(both & (sub_a == sub_b), F.least(first + 2.0, F.lit(10.0))).when(both, F.greatest(first - 2.5, F.lit(0.0))).otherwise(first)


def sub_intent(text: Column, concepts: dict[str, list[str]]) -> Column:
    """The one category with a keyword in the text; null for none or several."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    hits = F.filter(F.array(*[F.when(reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in words]), name) for name, words in concepts.items()]), lambda c: c.isNotNull())
    return F.when(F.size(hits) == 1, F.element_at(hits, 1))


def fact_score(a: dict[str, Column], b: dict[str, Column], weights: dict[str, float]) -> Column:
    """0 to 10: Jaccard of the query's slots by weight; 5 without facts asked, 3 without facts found."""
    total, part, asked, found = F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(False)
    for name in a:
        weight = weights.get(name)
        asked, found = asked | (F.size(a[name]) > 0), found | (F.size(b[name]) > 0)
        if weight is None:
            continue
        total = total + F.when(F.size(a[name]) > 0, weight).otherwise(0.0)
        part = part + F.when(either_empty(a[name], b[name]), 0.0).otherwise(weight * F.size(F.array_intersect(a[name], b[name])) / F.size(F.array_union(a[name], b[name])))
    return F.when(~asked, 5.0).when(~found, 3.0).when(total == 0, 5.0).otherwise(10 * part / total)


def family_recall(a: Column, b: Column) -> Column:
    """0 to 10: share of the query's values among the candidate's; 5 if it has none."""
    return F.when(F.size(a) == 0, 5.0).when(F.size(b) == 0, 0.0).otherwise(10 * F.size(F.array_intersect(a, b)) / F.size(a))


def source_points(sources: Column) -> Column:
    return F.least(sum((F.when(F.array_contains(sources, s), p).otherwise(0.0) for s, p in SOURCE_POINTS.items()), F.lit(0.0)), F.lit(10.0))


def section_boost(section: Column) -> Column:
    return F.coalesce(lookup(SECTION_BOOSTS, section), F.lit(1.0))


def interaction(drug_norm: Column, fact_norm: Column, structured: Column) -> Column:
    """What drug and facts together add to the score."""
    return F.when((drug_norm >= 6.5) & (fact_norm >= 5.5), 0.5).when((drug_norm >= 4) & (fact_norm >= 3.5), 0.2).when((drug_norm >= 5) & (fact_norm <= 1) & structured, -0.3).when((drug_norm <= 1.5) & (fact_norm <= 1) & structured, -0.2).otherwise(0.0)


def structural(kind: Column, subtype: Column, statement: Column, a: dict[str, Column], b: dict[str, Column], relations_a: Column, relations_b: Column) -> Column:
    """Sum of the structural issues' weights, -3 at least."""
    assertive = kind.isin(*ASSERTIONS)
    found = reduce(lambda x, y: x | y, [F.size(c) > 0 for c in b.values()])
    table = assertive & (subtype == "ABBREVIATION_TABLE")
    cost = F.when(table, -2.0).when(assertive & (subtype == "DEFINITION"), -1.0).when(assertive & (subtype == "SCHEDULE_MATRIX"), -0.8).otherwise(0.0)
    cost = cost + F.when(relations_a & ~relations_b & (found | statement.isNotNull()), -0.6).otherwise(0.0)
    for name in ("dose", "study_arm"):
        kinds = [k for k, slots in REQUIRED.items() if name in slots]
        cost = cost + F.when(kind.isin(*kinds) & (F.size(a[name]) > 0) & (F.size(b[name]) == 0), -0.4).otherwise(0.0)
    cost = cost + F.when(assertive & statement.isin("GENERAL", "BACKGROUND"), -0.4).otherwise(0.0)
    lacks = F.lit(False)
    for k, name in EXPECTED.items():
        lacks = lacks | ((kind == k) & (F.size(b[name]) == 0))
    return F.greatest(cost + F.when(found & lacks, -0.25).otherwise(0.0), F.lit(-3.0))


def decision(matched: Column, conflicts: Column) -> Column:
    """Accepted, Rejected, Partial or Marginal, with what matched and what conflicts."""
    names = lambda c: F.array_join(c, ", ")
    return (
        F.when((F.size(matched) == 0) & (F.size(conflicts) == 0), "Marginal: weak evidence across all signals")
        .when(F.size(matched) == 0, F.concat(F.lit("Rejected: "), names(conflicts), F.lit(" conflict")))
        .when(F.size(conflicts) == 0, F.concat(F.lit("Accepted: "), names(matched), F.lit(" aligned")))
        .otherwise(F.concat(F.lit("Partial: matched ["), names(matched), F.lit("] but conflicts ["), names(conflicts), F.lit("]")))
    )


def diagnosis(entities: Column, facts: Column, effective: Column, identities: Column) -> Column:
    """The first stage of enrichment that is missing."""
    return F.when(~entities & ~facts & ~effective, "ner").when(entities & ~facts & ~effective, "fact_extractor").when(~effective, "effective_facts_propagator").when(~identities, "identity_builder").otherwise("complete")


def section_drift(kind: Column, heading: Column, section: Column) -> Column:
    """Penalty of a section that contradicts the kind of query."""
    assertive = kind.isin("OBJECTIVE", "EFFICACY")
    return F.when(assertive & F.contains(F.lower(heading), F.lit("secondary")), -0.25).when(assertive & section.isin("ELIGIBILITY"), -0.20).when(assertive & section.isin("BACKGROUND", "APPENDIX"), -0.15).otherwise(0.0)


def pair_proxy(a: dict[str, Column], b: dict[str, Column], pairs: list[tuple[str, str]]) -> Column:
    """Share of the query's pairs of slots that the candidate has too, with a value of either in common."""
    checked, matched = F.lit(0), F.lit(0)
    for x, y in pairs:
        mine = (F.size(a[x]) > 0) & (F.size(a[y]) > 0)
        theirs = (F.size(b[x]) > 0) & (F.size(b[y]) > 0) & (F.arrays_overlap(a[x], b[x]) | F.arrays_overlap(a[y], b[y]))
        checked, matched = checked + mine.cast("int"), matched + (mine & theirs).cast("int")
    return F.when(checked > 0, matched / checked).otherwise(0.0)
