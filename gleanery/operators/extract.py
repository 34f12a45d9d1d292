"""Extraction: facts, entities and identities from text by rules."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def number(text: Column, pattern: str) -> Column:
    return first_match(text, pattern).try_cast("double")


#: Ordered rules for the kind, tense and form of a statement.
STATEMENT_RULES = [("LEGAL", "(?i)licen[cs]e|copyright"), ("CONTACT", "(?i)@|mail|phone"), ("RESULT", "[0-9]+(\\.[0-9]+)? ?%"), ("DEFINITION", "(?i)(^|[^a-z])(is|are|ist|est|es) ")]
MODALITY_RULES = [("PROHIBITED", "(?i)must not|may not|shall not"), ("REQUIRED", "(?i)must|shall|required"), ("PERMITTED", "(?i)permitted|may |granted"), ("NEGATED", "(?i)(^|[^a-z])(not|no|nicht|pas|sin) ")]
NEGATION = "(?i)(^|[^a-z])(not|no|nicht|pas|without)([^a-z]|$)"


def rule(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    out = F.when(text.rlike(rules[0][1]), rules[0][0])
    for name, pattern in rules[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def statistics(text: Column) -> Column:
    """Numbers of a statement with the type of the most telling one: share, then phone, version, count."""
    share = number(text, r"([0-9]+(?:\.[0-9]+)?) ?%")
    version = number(text, r"(?i)version ([0-9]+(?:\.[0-9]+)?)")
    count = number(text, r"(?:^|[^0-9.])([0-9]+)(?:[^0-9.]|$)")
    kind = F.when(share.isNotNull(), "share").when(version.isNotNull(), "version").when(count.isNotNull(), "count")
    return F.struct(kind.alias("type"), share.alias("share"), version.alias("version"), count.alias("count"))


def inherited(rows: DataFrame, key: str, order: str, slots: dict[str, Column], contributes: Column) -> DataFrame:
    """For each slot its own value, else the last one that a contributing row before it had, and where it comes from.

    Only contributing rows hand values on; all rows read them.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows
    for name, own in slots.items():
        held = F.last(F.when(contributes, own), ignorenulls=True).over(w)
        out = out.withColumn(name, F.coalesce(own, held)).withColumn(f"{name}_from", F.when(own.isNotNull(), "own").when(held.isNotNull(), "inherited"))
    return out


def dictionary_entities(docs: DataFrame, terms: dict[str, str]) -> DataFrame:
    """(doc_id, start, past, term, label) of dictionary terms as whole words, longest first, none overlapping.

    The greedy choice depends on the spans before it, so a batch of texts is scanned in Python with one automaton.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, label in terms.items():
            found.add_word(term.lower(), (len(term), term, label))
        found.make_automaton()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"].fillna(""), strict=True):
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                edge = lambda k: k < 0 or k >= len(low) or not (low[k].isalnum() or low[k] == "-")  # noqa: E731, B023
                spans = [(-n, end - n + 1, end + 1, term, label) for end, (n, term, label) in found.iter(low) if edge(end - n) and edge(end + 1)]
                taken: list[tuple[int, int]] = []  # by start
                for _, start, past, term, label in sorted(spans):
                    k = bisect(taken, (start, past))
                    if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= past):
                        taken.insert(k, (start, past))
                        rows.append((doc_id, start, past, term, label))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "past", "term", "label"]) if rows else pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "start": pd.Series(dtype="int32"), "past": pd.Series(dtype="int32"), "term": pd.Series(dtype=str), "label": pd.Series(dtype=str)})

    return docs.select("doc_id", "text").mapInPandas(scan, "doc_id long, start int, past int, term string, label string")


def uncovered(more: DataFrame, accepted: DataFrame) -> DataFrame:
    """Spans of a second layer that touch no accepted span of their document."""
    a = accepted.select("doc_id", F.col("start").alias("a"), F.col("past").alias("b"))
    return more.join(a, (more["doc_id"] == a["doc_id"]) & (more["start"] < a["b"]) & (more["past"] > a["a"]), "left_anti")


def first_family(values: DataFrame, families: DataFrame) -> DataFrame:
    """(value, family): the exact family, else the first in table order that contains the value or is contained in it, else itself."""
    near = (F.col("name") == F.col("value")) | F.contains(F.col("name"), F.col("value")) | F.contains(F.col("value"), F.col("name"))
    both = values.join(F.broadcast(families), near, "left")
    order = F.struct((F.col("name") != F.col("value")).cast("int"), "nth")
    return both.groupBy("value").agg(F.coalesce(F.min_by("family", order), F.col("value")).alias("family"))


def subtree(spark, edges: DataFrame, roots: list[str], depth: int) -> DataFrame:
    """(node, depth) below the roots in (parent, child), breadth first to a depth."""
    start = spark.createDataFrame([(r,) for r in roots], "node string")
    return spark.sql(
        """with recursive t(node, depth) as (select node, 0 from {start}
        union all select child, depth + 1 from t join {edges} e on e.parent = node where depth < :depth) select node, min(depth) as depth from t group by node""",
        args={"depth": depth}, start=start, edges=edges,
    )
