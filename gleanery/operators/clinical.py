"""Clinical facts and identities of a text as Column expressions: rules in order, the first match counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.operators.extract import first_match, number

# Ordered patterns of regimens, lines of therapy, phases of therapy and dose terms.
REGIMENS = [
    (r"(?i)\bTal[-\s]?DP\b", "Tal-DP"), (r"(?i)\bTecVRd\b", "TecVRd"), (r"(?i)\bIsa[-\s]?Kd\b", "Isa-Kd"), (r"(?i)\bIsa[-\s]?Rd\b", "Isa-Rd"), (r"(?i)\bDara[-\s]?VRd\b", "Dara-VRd"), (r"(?i)\bDara[-\s]?Rd\b", "Dara-Rd"),
    (r"(?i)\bDVd\b", "DVd"), (r"(?i)\bDPd\b", "DPd"), (r"(?i)\bDRd\b", "DRd"), (r"(?i)\bKRd\b", "KRd"), (r"(?i)\bVRd\b", "VRd"), (r"(?i)\bVCd\b", "VCd"), (r"(?i)\bVMP\b", "VMP"), (r"(?i)\bMPT\b", "MPT"),
    (r"(?i)\bPd\b", "Pd"), (r"(?i)\bKd\b", "Kd"), (r"(?i)\bRd\b", "Rd"), (r"(?i)\bR[-\s]?CHOP\b", "R-CHOP"), (r"(?i)\bR[-\s]?CVP\b", "R-CVP"), (r"(?i)\bR[-\s]?EPOCH\b", "R-EPOCH"), (r"(?i)\bCHOP\b", "CHOP"), (r"(?i)\bmonotherapy\b", "monotherapy"),
]
LINES_OF_THERAPY = [
    (r"(?i)\b(1L|first[-\s]?line|1st[-\s]?line|frontline|front[-\s]?line|newly\s+diagnosed|treatment[-\s]?na[iï]ve|na[iï]ve)\b", "1L"),
    (r"(?i)\b(2L|second[-\s]?line|2nd[-\s]?line)\b", "2L"),
    (r"(?i)\b(3L|third[-\s]?line|3rd[-\s]?line)\b", "3L"),
    (r"(?i)\bRRMM\b|\bR[/\s]R(\s+MM)?\b|relapsed[\s\-]and[\s\-]refractory|relapsed[/]refractory", "R/R"),
]
MANY_LINES = r"(?i)[≥>=]\s*(\d+)\s+(?:prior\s+)?lines?"
THERAPY_PHASE = r"(?i)\b(induction|maintenance|consolidation|bridg(?:e|ing)|salvage|conditioning)\b"
RP2D = r"(?i)\b(RP2Ds?)\b"
DOSE_TERMS = r"(?i)\b(RP2D|MTD|MAD|MFD|OBD|PAD|recommended\s+phase\s*2\s+dose|maximum\s+tolerated\s+dose|maximum\s+administered\s+dose|maximum\s+feasible\s+dose)\b"
# Temporal patterns.
VISIT = r"\b(?:C(?:ycle)?\s*(\d+)\s*D(?:ay)?\s*(\d+)|[Cc]ycle\s+(\d+)|[Dd]ay\s+(\d+)|[Ww]eek\s+(\d+))\b"
WINDOW = r"(?i)\b(?:within|no\s+more\s+than|no\s+later\s+than)\s+(\d+)\s+(days?|weeks?|months?|hours?)\b"
ANCHOR = r"(?i)\b(before|after|during|within|prior\s+to|following|upon|at\s+(?:baseline|screening|randomization)|from\s+(?:baseline|start))\b"
TIMEPOINT = r"(?i)\b(baseline|screening|randomization|end\s+of\s+(?:treatment|study|induction|consolidation)|(?:first|last)\s+dose|best\s+response|progression|follow[-\s]up)\b"
# Kinds of endpoints in order, criteria, thresholds, assessors, times.
ENDPOINT_KINDS = [
    (r"(?i)\b(orr|overall\s+response(?:\s+rate)?|response\s+rate|pfs|progression[-\s]free\s+survival|dor|duration\s+of\s+response|os|overall\s+survival|(?:scr|stringent\s+complete|very\s+good\s+partial|partial|complete|minimal)\s+response|mrd(?:\s+negativity)?|minimal\s+residual|cbr|clinical\s+benefit\s+rate|dcr|disease\s+control\s+rate|ttnt|time\s+to\s+next\s+treatment|pfs2)\b", "EFFICACY"),
    (r"(?i)\b(adverse\s+event|ae|toxicity|tolerability|safety|serious\s+adverse|grade\s+[34]|dlt|dose[-\s]limiting|crs|cytokine\s+release|icans|neurotoxicity|irr|infusion[-\s]related)\b", "SAFETY"),
    (r"(?i)\b(rp2d|recommended\s+phase\s+2\s+dose|mtd|maximum\s+tolerated|dose\s+(?:escalation|expansion)|safety\s+and\s+tolerability|pharmacologically\s+active\s+dose)\b", "DOSE_FINDING"),
    (r"(?i)\b(pk|pharmacokinetic|auc|cmax|half[-\s]life|clearance|bioavailability|vd|volume\s+of\s+distribution|plasma\s+concentration)\b", "PK"),
    (r"(?i)\b(biomarker|ctdna|circulating\s+tumor\s+dna|bcma\s+expression|cd38\s+expression|minimal\s+residual\s+disease)\b", "BIOMARKER"),
    (r"(?i)\b(hrqol|health[-\s]related\s+quality\s+of\s+life|patient[-\s]reported|pro|eq[-\s]5d|eortc|facit|hru|mru)\b", "PRO"),
]
CRITERIA = r"(?i)\b(IMWG|International\s+Myeloma\s+Working\s+Group|RECIST\s*[\d.]*|CTCAE\s*[\d.]*|IWG|IWCLL|Lugano|Response\s+Evaluation\s+Criteria\s+in\s+Solid\s+Tumors)\b"
THRESHOLD = r"(?i)((?:\bat\s+least\s+a?\s*)?\b(?:stringent\s+complete|complete|very\s+good\s+partial|partial|minimal)\s+response\s*(?:\[(?:sCR|CR|VGPR|PR|MR)\])?(?:\s+or\s+better)?|MRD[-\s]negativ(?:e|ity)|(?:≥|>=)\s*\d+%\s*(?:reduction)?|\b(?:PR|CR|VGPR)\s+or\s+better\b)"
ASSESSOR = r"(?i)\b(investigator[-\s](?:assessed|reviewed|reported)|irc|independent\s+review(?:\s+committee)?|blinded\s+(?:central|independent|irc)|central\s+(?:lab(?:oratory)?|review)|sponsor[-\s]independent)\b"
ENDPOINT_TIME = r"(?i)\b(at\s+(?:\d+\s+(?:months?|weeks?|years?)|(?:week|month)\s+\d+|randomization)|\d+[-\s]month\s+(?:landmark|rate|estimate)|landmark\s+(?:at\s+)?\d+|within\s+\d+\s+(?:months?|weeks?))\b"
# Diseases, prior lines, performance status, refractoriness.
DISEASE_SHORT = r"\b(RRMM|NDMM|SMM|R/R\s+MM|NHL|DLBCL|CLL|AML|MDS|MCL|FL)\b"
DISEASE_LONG = r"(?i)\b((?:relapsed(?:\s+(?:and|or|and/or))?\s*(?:/\s*)?refractory\s+)?multiple\s+myeloma|newly\s+diagnosed\s+multiple\s+myeloma|smoldering\s+multiple\s+myeloma|diffuse\s+large\s+b[-\s]cell\s+lymphoma|chronic\s+lymphocytic\s+leukemia|mantle\s+cell\s+lymphoma|follicular\s+lymphoma)\b"
MYELOMA_CRITERIA = r"(?i)\b(imwg|international\s+myeloma\s+working\s+group)\b"
PRIOR_LINES = r"(?i)(?:received|had|with)\s+(?:at\s+least\s+)?([1-9]|one|two|three|four|five)\s+(?:or\s+more\s+)?(?:prior\s+)?lines?\s+of\s+(?:anti-?myeloma\s+)?therapy|[≥>=]\s*(\d+)\s+(?:prior\s+)?(?:lines?\s+of\s+)?(?:anti-?myeloma\s+)?(?:therapy|treatment|regimens?)\b"
COUNT_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5"}
ECOG = r"(?i)\bECOG\s+(?:PS|performance\s+status|score)\s*(?:of\s*)?([0-4](?:\s*[-–]\s*[0-4])?|≤\s*[0-4]|≥\s*[0-4])\b"
REFRACTORY = r"(?i)\b(triple[-\s]class\s+(?:exposed|refractory)|penta[-\s]refractory|lenalidomide[-\s]refractory|pi[-\s]refractory|proteasome\s+inhibitor[-\s]refractory|anti[-\s]cd38[-\s]refractory|daratumumab[-\s]refractory|bcma[-\s]refractory|double[-\s]class\s+refractory)\b"
# Sections and patterns of a statement's context.
CITED_SECTIONS = ["BACKGROUND", "RATIONALE", "APPENDIX", "REFERENCE", "ADMINISTRATIVE"]
CURRENT_SECTIONS = ["OBJECTIVES", "ENDPOINTS", "DESIGN", "SYNOPSIS", "TREATMENT", "PROCEDURES", "ELIGIBILITY", "STATISTICS", "DOSING"]
THIS_STUDY = r"(?i)\b(this\s+(?:study|trial|protocol|part)|the\s+(?:study|trial)|we\s+(?:will|aim|seek|intend|plan)|the\s+(?:primary|secondary|exploratory)\s+(?:objective|endpoint))\b"
CITED = r"(?i)\b(based\s+on\s+(?:phase|data|results?|findings?|the\s+\w+\s+data)|(?:data|results?|findings?)\s+(?:from|of)\s+(?:phase|study|studies|the|a)|(?:observed|reported|demonstrated|shown|noted)\s+in\s+(?:phase|prior|previous)|(?:as\s+)?(?:previously|previously\s+reported|reported\s+previously)|in\s+(?:the\s+)?(?:phase\s+[0-9]|prior|previous)\s+(?:study|data|cohort|arm|part))\b"
HISTORICAL = r"(?i)\b(previous(?:ly)?|prior\s+(?:study|studies|data)|preclinical|in\s+(?:vitro|vivo)|published\s+(?:data|study|studies)|earlier\s+(?:study|data))\b"
# Numbers of a statement, and the units of time.
CI_BOUNDS = r"(?i)(\d+(?:\.\d+)?)\s*%\s+CI\s*[:\s]\s*(\d+(?:\.\d+)?)\s*[–—-]\s*(\d+(?:\.\d+)?)(?:\s+(\w+))?"
SAMPLE_SIZE = r"(?i)\bn\s*=\s*(\d+)|(\d+)\s+(?:subjects?|patients?|participants?|individuals?|volunteers?)\b"
P_VALUE = r"(?i)\bp\s*[<>=≤≥]\s*(0\.\d+)\b"
HAZARD_RATIO = r"(?i)\bHR\s*=\s*([\d.]+)\b|\bhazard\s+ratio\s*=?\s*([\d.]+)\b"
ODDS_RATIO = r"(?i)\bOR\s*=\s*([\d.]+)\b|\bodds\s+ratio\s*=?\s*([\d.]+)\b"
MEDIAN = r"(?i)\bmedian\s+(?:of\s+)?(\d+(?:\.\d+)?)\s+(\w+)\b|\bmedian\s*[=:]\s*(\d+(?:\.\d+)?)\s*(\w+)?\b"
PERCENTAGE = r"(\d+(?:\.\d+)?)\s*%"
TIME_UNITS = ["day", "days", "week", "weeks", "month", "months", "year", "years", "hour", "hours"]
# Kinds of a numeric query in order, identifiers, roles, and the retrievers of each kind.
NUMERIC_KINDS = [
    (r"(?i)\b\d+\s*%\s+CI\b", "CONFIDENCE_INTERVAL"), (r"(?i)\bp\s*[<>=≤≥]\s*0\.\d+|\bp\s*-?\s*value\b", "P_VALUE"), (r"(?i)\bHR\s*=\s*[\d.]+|\bhazard\s+ratio\b", "HAZARD_RATIO"), (r"(?i)\bOR\s*=\s*[\d.]+|\bodds\s+ratio\b", "ODDS_RATIO"),
    (r"(?i)^\s*\d+(?:\.\d+)?%\s*$|\b\d+(?:\.\d+)?%\s+of\b|\bfrom\s+\d+(?:\.\d+)?%\s+to\s+\d+(?:\.\d+)?%|\bcompared\s+to\s+\d+(?:\.\d+)?%", "NUMERIC_PERCENTAGE"),
    (r"(?i)\bn\s*=\s*\d+|\b\d+\s+(?:subjects?|patients?|participants?|individuals?|volunteers?)\b|\(\d+\s+(?:subjects?|patients?)\s+in\b", "NUMERIC_SAMPLE_SIZE"),
]
IDENTIFIER = r"(?i)\bNCT\d{6,}\b|\b[A-Z]{2,}-\d{4,}\b|\b\d{5,}\b|\bProtocol\s+(?:Number|No\.?)\b|\b(?:IND|NDA|BLA)\s*[:\s]\s*\d+"
PERSON = r"^\s*Dr\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s*$|^\s*(?:Prof\.?|Mr\.?|Ms\.?|Mrs\.?)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s*$|^\s*[A-Z][a-z]+\s+[A-Z][a-z]+\s*$"
ROLES = ["investigator", "principal investigator", "sub-investigator", "sponsor", "monitor", "cra", "coordinator", "crc", "pi"]
STRATEGIES = {
    "PERSON": ["literal", "ner", "bm25", "vector"], "IDENTIFIER": ["regex", "bm25", "literal"], "CLINICAL_ROLE": ["ontology", "vector", "bm25"], "ORGANIZATION": ["literal", "ner", "vector"], "PHRASE": ["bm25", "vector", "ontology", "literal"],
    "NUMERIC_SAMPLE_SIZE": ["numeric", "literal"], "CONFIDENCE_INTERVAL": ["numeric", "literal"], "P_VALUE": ["numeric", "literal"], "HAZARD_RATIO": ["numeric", "literal"], "ODDS_RATIO": ["numeric", "literal"], "NUMERIC_PERCENTAGE": ["numeric", "literal"], "MEDIAN": ["numeric", "literal"],
}
# Endpoint abbreviations, which are no biomarkers, and labels of entities by the slot that they fill.
ENDPOINT_SHORT = ["PFS", "OS", "ORR", "DOR", "PFS2", "EFS", "DFS", "RFS", "TTP", "TTR", "TTNT", "MFS", "TFS", "DCR", "CBR", "BICR", "IRC", "AUC", "CMAX", "TMAX", "CL", "MRD"]
SLOT_OF_LABEL = {"MEDICATION": "drug", "CLINICAL_ENDPOINT": "endpoint", "DOSAGE": "dose", "STUDY_ARM": "study_arm", "PROTOCOL_ID": "study_id", "STUDY_POPULATION": "population", "ADVERSE_EVENT": "adverse_event", "BIOMARKER": "biomarker", "STATISTICAL_METHOD": "statistical_method", "TREATMENT_PHASE": "phase", "CLINICAL_RESPONSE": "response_criterion", "TREATMENT_NAME": "treatment_regimen", "QUESTIONNAIRE": "assessment"}
DOSE_FINDING = ["RP2D", "RP2DS", "MTD", "MAD", "PAD"]
REGIMEN_SHORT = r"^[A-Z]{2,5}[a-z]$|^[A-Za-z]{2,8}-[A-Z]{1,5}[a-z]?$|^[A-Z]-[A-Z]{2,5}[a-z]?$"
ARM = r"(?i)\b(Arm\s+[A-Z0-9]+|Treatment\s+Arm|Study\s+Arm|Control\s+Arm|Arm\s*[1-9]|[A-Z]+\s+Arm)\b|^\s*arm\s*$"


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Label of the first rule in order whose pattern occurs, null for none."""
    out = F.when(text.rlike(rules[0][0]), rules[0][1])
    for pattern, label in rules[1:]:
        out = out.when(text.rlike(pattern), label)
    return out


def prefixed(letter: str, value: Column) -> Column:
    return F.concat(F.lit(letter), value)


def treatment(text: Column) -> Column:
    """Regimen, line and phase of therapy, and a recommended dose."""
    many = F.concat(F.lit(">="), first_match(text, MANY_LINES), F.lit("L"))
    return F.struct(
        first_rule(text, REGIMENS).alias("regimen"), F.coalesce(first_rule(text, LINES_OF_THERAPY), many).alias("line"),
        F.initcap(first_match(text, THERAPY_PHASE)).alias("phase"), first_match(text, RP2D).alias("rp2d"),
    )


def temporal(text: Column) -> Column:
    """Anchor, cycle, day and week of the first visit, window and named timepoint."""
    g = lambda k: first_match(text, VISIT, k)
    return F.struct(
        F.lower(first_match(text, ANCHOR)).alias("anchor"), prefixed("C", F.coalesce(g(1), g(3))).alias("cycle"), prefixed("D", F.coalesce(g(2), g(4))).alias("day"), prefixed("W", g(5)).alias("week"),
        F.concat(first_match(text, WINDOW, 1), F.lit(" "), first_match(text, WINDOW, 2)).alias("window"), F.lower(first_match(text, TIMEPOINT)).alias("timepoint"),
    )


def endpoint(text: Column) -> Column:
    """Kind of endpoint, criteria, threshold, assessor and time."""
    raw = F.trim(F.upper(first_match(text, CRITERIA)))
    criteria = F.when(F.contains(raw, F.lit("INTERNATIONAL MYELOMA")), "IMWG").when(F.contains(raw, F.lit("RESPONSE EVALUATION")), "RECIST").otherwise(raw)
    return F.struct(
        F.coalesce(first_rule(text, ENDPOINT_KINDS), F.lit("GENERAL")).alias("kind"), criteria.alias("criteria"), F.trim(first_match(text, THRESHOLD)).alias("threshold"),
        F.lower(first_match(text, ASSESSOR)).alias("assessor"), F.lower(first_match(text, ENDPOINT_TIME)).alias("timepoint"),
    )


def population(text: Column) -> Column:
    """Disease, relapse, prior lines, performance status and refractoriness."""
    long = F.lower(first_match(text, DISEASE_LONG))
    has = lambda word: F.contains(long, F.lit(word))
    named = F.when(has("relapsed") & has("refractory"), "RRMM").when(has("newly diagnosed"), "NDMM").when(has("smoldering"), "SMM").when(has("multiple myeloma"), "MM").otherwise(F.substring(long, 1, 40))
    count = F.lower(F.coalesce(first_match(text, PRIOR_LINES, 1), first_match(text, PRIOR_LINES, 2)))
    words = F.create_map(*[F.lit(x) for pair in COUNT_WORDS.items() for x in pair])
    return F.struct(
        F.coalesce(first_match(text, DISEASE_SHORT), named, F.when(text.rlike(MYELOMA_CRITERIA), "MM")).alias("disease"), text.rlike(r"(?i)\brelapsed\b").alias("relapsed"), text.rlike(r"(?i)\brefractory\b").alias("refractory"),
        F.concat(F.lit("≥"), F.coalesce(F.try_element_at(words, count), count)).alias("prior_lines"), F.trim(first_match(text, ECOG)).alias("ecog"), F.lower(first_match(text, REFRACTORY)).alias("refractoriness"),
    )


def context(section: Column, text: Column) -> Column:
    """CURRENT, CITED, HISTORICAL or GENERAL: by section first, by wording then. The tense of verbs needs a parser and isn't read."""
    out = F.when(section.isin(CITED_SECTIONS), "CITED").when(section.isin(CURRENT_SECTIONS), "CURRENT")
    return out.when(text.rlike(THIS_STUDY), "CURRENT").when(text.rlike(CITED), "CITED").when(text.rlike(HISTORICAL), "HISTORICAL").otherwise("GENERAL")


def statistics(text: Column) -> Column:
    """Numbers of a statement by kind; a plain percentage only where there is neither an interval nor a p-value."""
    either = lambda pattern, a, b: F.coalesce(first_match(text, pattern, a), first_match(text, pattern, b))
    unit = lambda x: F.when(F.lower(x).isin(TIME_UNITS), F.lower(x))
    low, p = first_match(text, CI_BOUNDS, 2).try_cast("double"), number(text, P_VALUE)
    return F.struct(
        first_match(text, CI_BOUNDS, 1).try_cast("double").alias("confidence_level"), low.alias("lower_ci"), first_match(text, CI_BOUNDS, 3).try_cast("double").alias("upper_ci"), unit(first_match(text, CI_BOUNDS, 4)).alias("ci_unit"),
        either(SAMPLE_SIZE, 1, 2).try_cast("double").alias("sample_size"), p.alias("p_value"), either(HAZARD_RATIO, 1, 2).try_cast("double").alias("hazard_ratio"), either(ODDS_RATIO, 1, 2).try_cast("double").alias("odds_ratio"),
        either(MEDIAN, 1, 3).try_cast("double").alias("median"), unit(either(MEDIAN, 2, 4)).alias("median_unit"), F.when(low.isNull() & p.isNull(), number(text, PERCENTAGE)).alias("percentage"),
    )


def query_kind(text: Column, organization: Column) -> Column:
    """Kind of a query: numeric kinds first, then identifier, a person's name in a short text, a role, an organisation in a short text, else a phrase."""
    long = (F.length(text) > 80) | F.contains(text, F.lit("\n")) | (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) >= 2)
    role = F.lit(False)
    for word in ROLES:
        role = role | F.contains(F.lower(text), F.lit(word))
    plain = F.when(text.rlike(IDENTIFIER), "IDENTIFIER").when(~long & text.rlike(PERSON), "PERSON").when(role, "CLINICAL_ROLE").when(~long & organization, "ORGANIZATION").otherwise("PHRASE")
    return F.coalesce(first_rule(text, NUMERIC_KINDS), plain)


def strategies(kind: Column) -> Column:
    """Retrievers of a kind of query."""
    table = F.create_map(*[x for k, v in STRATEGIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, kind), F.array(*map(F.lit, STRATEGIES["PHRASE"])))


def relabelled(label: Column, text: Column) -> Column:
    """An entity's label by what its text is: arms are no anatomy, endpoints and doses no biomarkers, regimens no single drugs."""
    short = F.upper(text)
    return (
        F.when((label == "ANATOMY") & text.rlike(ARM), "STUDY_ARM")
        .when(label.isin("CLINICAL_RESPONSE", "BIOMARKER") & short.isin(ENDPOINT_SHORT), "CLINICAL_ENDPOINT")
        .when((label == "BIOMARKER") & short.isin(DOSE_FINDING), "DOSAGE")
        .when((label == "MEDICATION") & text.rlike(REGIMEN_SHORT), "TREATMENT_NAME")
        .otherwise(label)
    )


def repaired(facts: dict[str, Column], sample_size: Column) -> dict[str, Column]:
    """Slots (arrays of values) with dose terms and endpoint abbreviations moved out of biomarker, and a bare n out of population where it is a sample size."""
    dose = lambda v: v.rlike(DOSE_TERMS)
    short = lambda v: F.upper(F.trim(v)).isin(ENDPOINT_SHORT)
    markers = facts["biomarker"]
    return facts | {
        "biomarker": F.filter(markers, lambda v: ~dose(v) & ~short(v)),
        "dose": F.array_union(facts["dose"], F.filter(markers, dose)),
        "endpoint": F.array_union(facts["endpoint"], F.filter(markers, lambda v: ~dose(v) & short(v))),
        "population": F.when(sample_size, F.filter(facts["population"], lambda v: F.lower(v) != "n")).otherwise(facts["population"]),
    }
