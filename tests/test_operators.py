"""Operators on small literal tables."""

from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.operators import analytics, extract, gates, layout, retrieve
from gleanery.sources import files


def test_context_is_inherited_and_own_values_win(spark):
    rows = [("c", 1, "heading", "teclistamab", None), ("c", 2, "paragraph", None, "ORR"), ("c", 3, "reader", "other", None), ("c", 4, "paragraph", None, None), ("d", 1, "reader", None, None)]
    df = spark.createDataFrame(rows, "chunk string, pos int, kind string, drug string, endpoint string")
    out = extract.inherited(df.withColumnsRenamed({"drug": "own_drug", "endpoint": "own_endpoint"}), "chunk", "pos", {"drug": F.col("own_drug"), "endpoint": F.col("own_endpoint")}, F.col("kind") != "reader")
    got = {(r["chunk"], r["pos"]): (r["drug"], r["drug_from"], r["endpoint"], r["endpoint_from"]) for r in out.collect()}
    assert got[("c", 1)] == ("teclistamab", "own", None, None)
    assert got[("c", 2)] == ("teclistamab", "inherited", "ORR", "own")
    assert got[("c", 3)] == ("other", "own", "ORR", "inherited")
    assert got[("c", 4)] == ("teclistamab", "inherited", "ORR", "inherited")
    assert got[("d", 1)] == (None, None, None, None)


def test_page_merge_compares_with_the_previous_row_only(spark):
    rows = [(1, 1, 1, 9), (1, 2, 2, 3), (1, 3, 5, 6), (1, 4, 7, 7), (2, 5, 1, 1)]
    df = spark.createDataFrame(rows, "q int, id int, page_start int, page_end int")
    got = {r["id"]: (r["q"], r["group"]) for r in gates.merge_pages(df, ["q"], ["id"]).collect()}
    assert got[1] == got[2] == (1, 1)
    assert got[3] == got[4] == (1, 2)  # 5 > 3 + 1, although row 1 reaches to 9
    assert got[5] == (2, 1)


def test_ties_with_the_last_place_are_kept(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([5.0, 4.0, 4.0, 3.0])], "query_id int, doc_id int, score double")
    assert retrieve.top_with_ties(df, 2).count() == 3
    assert retrieve.top(df, 2, "doc_id").count() == 2


def test_literal_finds_phrases_without_an_inner_token(spark):
    texts = ["the MIT License, Version 2", "漢字 and licenses", "cens", None, "MIT Lic", "x -- y"]
    phrases = ["License", "MIT Lic", "漢字", "cens", "he MIT License, Ver", "--", "absent", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(phrases)), "query_id long, text string")
    wanted = sorted((q, d, t.index(p) + 1) for q, p in enumerate(phrases) for d, t in enumerate(texts) if p and t and p in t)
    assert sorted(map(tuple, retrieve.literal(asked, docs).collect())) == wanted


def test_fallback_serves_only_queries_without_hits(spark):
    a, b = (spark.createDataFrame(x, "query_id int, doc_id int") for x in ([(1, 1)], [(1, 2), (2, 3)]))
    assert sorted(map(tuple, retrieve.with_fallback(a, b).collect())) == [(1, 1), (2, 3)]


def test_headings_close_deeper_ones(spark):
    rows = [("p", 1, 1, "A"), ("p", 2, 2, "B"), ("p", 3, None, "x"), ("p", 4, 1, "C"), ("p", 5, None, "y"), ("p", 6, 2, "D")]
    df = spark.createDataFrame(rows, "page string, pos int, level int, title string")
    got = [r["path"] for r in layout.heading_paths(df, "page", "pos", "level", "title", 2).orderBy("pos").collect()]
    assert got == ["A", "A > B", "A > B", "C", "C", "C > D"]


def test_word_cap_and_small_merge(spark):
    lines = spark.createDataFrame([(1, k, " ".join("w" * n)) for k, n in enumerate([3, 3, 9, 1, 1])], "doc_id int, pos int, line string")
    assert [r["chunk"] for r in layout.word_capped(lines, 6).orderBy("pos").collect()] == [0, 0, 1, 2, 2]
    chunks = spark.createDataFrame([(1, 0, 50, "A"), (1, 1, 5, "A"), (1, 2, 5, "B"), (1, 3, 5, "B")], "doc_id int, chunk int, words int, category string")
    assert [r["merged"] for r in layout.merged_small(chunks, 40).orderBy("chunk").collect()] == [0, 0, 1, 1]


def test_dictionary_takes_longest_whole_words(spark):
    docs = spark.createDataFrame([(1, "the MIT License, Licenses and a non-License"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r["start"], r["term"]) for r in extract.dictionary_entities(docs, {"MIT License": "L", "License": "T", "the": "W"}).orderBy("start").collect()]
    assert got == [(0, "the"), (4, "MIT License")]


def test_text_functions(spark):
    row = spark.createDataFrame([(" Ab\tc . D! e", [1.0, 0.0], [0.0, 0.0])], "t string, a array<double>, b array<double>").select(
        X.normalize(F.col("t")), X.tokens(F.col("t")), F.size(X.sentences(F.col("t"))), X.cosine(F.col("a"), F.col("b")), X.cosine(F.col("a"), F.col("a")), X.nfkc(F.lit("ﬁ")), X.jaccard(F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y")))
    ).first()
    assert row[1:] == (["ab", "c", "d", "e"], 3, 0.0, 1.0, "fi", 0.5)


def test_percentile_by_index_and_key_values(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "v double")
    assert df.agg(analytics.floor_percentile(F.col("v"), 0.5)).first()[0] == 2.0
    assert spark.range(1).select(analytics.key_values(F.lit("a=1 b=x,y end"))).first()[0] == {"a": "1", "b": "x,y"}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"start_page": 5, "chunk_index": 0, "pages": [{"number": 1, "blocks": [{"kind": "p", "text": "x"}, {"kind": "h1", "text": "y"}]}]}')
    assert [tuple(r) for r in files.read_layout(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == [(5, 0, "p", "x"), (5, 1, "h1", "y")]
    (tmp_path / "l.txt").write_text("doc=7 ms=12\nnothing\n")
    assert files.read_log(spark, str(tmp_path / "l.txt")).filter("fields['doc'] = '7'").count() == 1
    files.write_csv(spark.createDataFrame([(1, ["a"])], "k int, v array<string>"), str(tmp_path / "csv"), ["v", "k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["v", "k"]
    files.write_json(spark.range(3), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, version int, v string")
    b = spark.createDataFrame([(1, 2, "z")], "k int, version int, v string")
    once = files.upsert(a, b, "k", "version")
    assert sorted(map(tuple, files.upsert(once, b, "k", "version").collect())) == sorted(map(tuple, once.collect())) == [(1, 2, "z"), (2, 1, "y")]


def test_entry_imports_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= {"bm25_topk", "page_gap_merge"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_compatibility_normalization(spark):
    import unicodedata

    from gleanery.functions.text import nfkc

    texts = ["ﬁne ①", "e\u0301", "", None, "plain", "Å\u2003x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(nfkc("text")).collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_all_places_of_a_phrase(spark):
    from gleanery.operators.retrieve import starts

    rows = [("abcabcab", "abc"), ("x.y.z", "."), ("aaaa", "aa"), ("none", "q"), ("a\\Eb\\E", "\\E")]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(rows, "text string, phrase string").coalesce(1).select(starts(F.col("text"), F.col("phrase"))).collect()
    assert [r[0] for r in got] == [[0, 3], [1, 3], [0, 2], [], [1, 4]]


def test_literal_finds_every_kind_of_phrase(spark):
    from gleanery.operators.retrieve import literal

    texts = ["foo bar baz", "l'été dernier", "one", "a foo bard", "x.y"]
    phrases = ["one", "oo ba", "été", "foo bar baz", "x.y", "foo", "."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(phrases)), "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]) for r in literal(asked, docs).collect()}
    assert got == {(q, d) for q, p in enumerate(phrases) for d, t in enumerate(texts) if p in t}


def test_bm25_counts_lengths_of_all_documents(spark):
    import math

    from gleanery.operators.retrieve import bm25

    texts = {1: "b a, a", 2: "", 3: "!c", 4: "a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in bm25(spark.createDataFrame([(0, "a")], "query_id long, text string"), docs).collect()}
    mean = (3 + 0 + 1 + 1) / 4
    score = lambda tf, n: math.log(1 + 2.5 / 2.5) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    assert got == {1: round(score(2, 3), 6), 4: round(score(1, 1), 6)}
