"""Pairs by classes against brute force, and queries that were mended for size."""

import itertools

import pytest
from pyspark.sql import functions as F

from gleanery.operators import pairs
from gleanery.operators.pairs import Classes, Factor

ROWS = [(i, k, f"w{i % 4}", i % 3) for k, n in (("x", 23), ("y", 9), ("z", 1)) for i in range(100 * ord(k), 100 * ord(k) + n)] + [(7, None, "w", 1)]


def held(spark):
    rows = spark.createDataFrame(ROWS, "id long, key string, word string, n int")
    score = F.when(F.col("a.word") == F.col("b.word"), 10.0).otherwise(0.0) + F.col("b.n")
    return Classes(rows, "key", "id", F.col("id") % 5 == 0, [Factor({"word": F.col("word")}, {"word": F.col("word"), "n": F.col("n")}, [score])])


def wanted(itself=False):
    return sorted((a[0], b[0], 10.0 * (a[2] == b[2]) + b[3]) for a, b in itertools.product(ROWS, ROWS) if a[0] % 5 == 0 and a[1] == b[1] and a[1] and (itself or a[0] != b[0]))


@pytest.mark.parametrize("blocks", [(4096, 2048, 1 << 16), (2, 3, 4)])
def test_all_pairs_whatever_the_blocks(spark, monkeypatch, blocks):
    for name, value in zip(("ASKED_BLOCK", "BLOCK", "ROWS"), blocks, strict=True):
        monkeypatch.setattr(pairs, name, value)
    made = lambda v: iter([{"score": v[0][0]}])
    assert sorted(map(tuple, held(spark).pairs(made, "score double").collect())) == wanted()
    assert sorted(map(tuple, held(spark).pairs(made, "score double", itself=True).collect())) == wanted(itself=True)


def test_best_and_ties_come_from_classes(spark):
    best = {}
    for q, d, s in sorted(wanted(), key=lambda r: (r[0], -r[2], r[1])):
        best.setdefault(q, []).append((q, d, s))
    assert sorted((r["query_id"], r["note_id"], r["v"][0]) for r in held(spark).best(lambda v: v[0], 4).collect()) == sorted(x for v in best.values() for x in v[:4])
    every = wanted(itself=True)
    ranks = [(q, d, s, 1 + sum(x[0] == q and x[2] > s for x in every)) for q, d, s in every]
    assert sorted(map(tuple, held(spark).top_with_ties(3).collect())) == sorted(r for r in ranks if r[3] <= 3)


def test_too_many_classes_are_no_classes(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_CELLS", 3)
    assert not held(spark).known
    monkeypatch.setattr(pairs, "MOST_CLASSES", 3)
    assert not held(spark).known


@pytest.mark.parametrize("name", ["contradiction_penalty", "comparator_results", "decision_explanation", "span_scorers", "ranked_score_table", "sub_intent_refinement", "fusion_terms", "slot_weighted_jaccard", "fact_anchor_search", "identity_overlap"])
def test_pairs_beyond_the_bound_are_scored_one_by_one(spark, monkeypatch, name):
    from gleanery.queries import ORACLE_SQL, QUERIES
    from tests.compare import spark_rows, sql_rows

    monkeypatch.setattr(pairs, "MOST_CELLS", 0)
    assert spark_rows(QUERIES[name](spark, "/root/testdata/sf0.001")) == sql_rows(ORACLE_SQL[name], "/root/testdata/sf0.001")


def test_sentences_of_empty_texts(spark, tmp_path):
    from gleanery.queries import QUERIES

    spark.createDataFrame([(1, ""), (2, None), (3, "A b. C")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["sentence_split"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, None, None), 2: (None, None, None), 3: (2, 4, "A b.")}


def test_sketches_are_kept_by_type_only(spark, tmp_path):
    from gleanery.queries import QUERIES

    spark.createDataFrame([("a", u % 50) for u in range(300)] + [("b", None), (None, 1)], "event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["approximate_distinct"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == [("a", True), ("b", True), (None, True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "DISTINCT" not in plan.upper().replace("APPROX_COUNT_DISTINCT", "")


@pytest.mark.parametrize("odd", [False, True])
def test_nearest_vectors_with_ties_and_copies(spark, odd):
    import numpy as np

    from gleanery.operators.retrieve import nearest

    held = np.random.default_rng(3).integers(-3, 4, (300, 8)).astype(np.float32) / 7
    held[50:60] = held[40] + np.float32(2e-7)  # equal after rounding only
    held[200:210] = held[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(held)] + [(7, [float(x) for x in held[8]])]  # an id twice
    if odd:
        rows[11] = (11, [0.5] * 7 + [float("inf")])
    docs = spark.createDataFrame(rows, "doc_id long, vector array<float>")
    asked = docs.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")

    def product(x, y):
        total = 0.0
        for a, b in zip(x, y, strict=True):
            total += a * b
        return total

    wanted = []
    for q, x in rows:
        if q % 20 == 0:
            scores = [(round(product(x, y), 6), d) for d, y in rows if d != q]
            wanted += [(q, d, s, 1 + sum(o > s for o, _ in scores)) for s, d in scores]
    assert sorted(map(tuple, nearest(asked, docs, 5).collect())) == sorted(r for r in wanted if r[3] <= 5)


def test_terms_and_lines_by_bytes_are_those_of_the_patterns(spark):
    from gleanery.functions.text import tokens
    from gleanery.operators.retrieve import with_terms
    from gleanery.operators.shaping import normalized_lines

    texts = ["A-b  c_D e\n\n\tÉcole 12.5% x\x0by\n", "", None, "Kelvin İstanbul straße", "漢字-abc", "a a A b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    counts = {(r["doc_id"], r["term"]): r["count"] for r in every.groupBy("doc_id", "term").count().collect()}
    assert {(r["doc_id"], r["term"]): r["tf"] for r in with_terms(docs, every.select("term")).collect()} == counts
    lengths = {r["doc_id"]: r["length"] for r in with_terms(docs, every.select("term"), every=True).filter("term = '\0'").collect()}
    assert lengths == {d: None if t is None else sum(n for (x, _), n in counts.items() if x == d) for d, t in enumerate(texts)}
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", F.trim(F.regexp_replace(F.lower("line"), "[^a-z0-9-]+", " ")))
    assert sorted(map(tuple, normalized_lines(docs).collect())) == sorted(map(tuple, lines.collect()))
