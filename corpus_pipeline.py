"""The corpus pipeline: five stages over ``documents``, each applying an operator of ``gleanery.llm``.

Each stage takes all that its predecessor kept and, but for the last, returns the columns of documents; other columns are
dropped, so none clashes. Rows keep their doc_id; where a text changes, n_chars is counted anew. A row is judged by its own text, with or
without a doc_id. Null and empty texts stay as they are up to mixing, which takes documents with words only. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import merge_table, mixing, near_dup, substring, toxicity
from gleanery.llm.common import checkpointed, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go."""
    return toxicity.without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays; so do documents without words."""
    return near_dup.without_near_duplicates(docs.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 20 words or more that occur earlier go; texts without such words stay as they are."""
    return substring.without_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix's schedule, each once for every slot that takes its first word: 0 to 3 times."""
    return mixing.in_schedule_order(docs.select(*COLUMNS))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and whether they decode to its text again."""
    return merge_table.encode_rows(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode_documents),
]

#: Model scores, components of unbounded length and merges are beyond SQL; tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage kept is cut from its lineage before the next reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
