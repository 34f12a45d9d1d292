"""Retrievers: each gives scored rows (query_id, doc_id, ..). Queries are a stated, small set; documents may be any number."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import ODD_CAPITALS, WORD_BYTES, dot, tokens
from gleanery.sources.stages import small, staged

K1, B = 1.2, 0.75
QUERY_TOKENS = 50


EVERY = "\0"  # stands for each document once among the postings


def with_terms(docs: DataFrame, wanted: DataFrame, every: bool = False, with_text: bool = False, some: int = 256) -> DataFrame:
    """Rows (.., length, term, tf) of documents (.., text) for each of the ``wanted`` terms, a query's few, among their tokens, each once; with ``every`` one more row a document.

    Tokens are those of ``tokens``. Texts are cut in Python, by byte tables, as the JVM's patterns take many times as long; rows of ``some`` documents go on at once,
    and a row has the text again only on demand.
    """
    terms = {r[0].encode(): r[0] for r in wanted.distinct().collect() if r[0] is not None}
    sent, mark = docs.sparkSession.sparkContext.broadcast(terms), EVERY
    table, odd = WORD_BYTES, ODD_CAPITALS
    columns = [n for n in docs.columns if with_text or n != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        for batch in (whole.slice(low, some) for whole in batches for low in range(0, whole.num_rows, some)):
            at, length, term, tf = [], [], [], []
            for r, text in enumerate(batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()):
                n, counts = None, {}
                if text is not None:
                    for capital, small_ in odd:
                        if capital in text:
                            text = text.replace(capital, small_)
                    words = text.translate(table).split()
                    n, counts = len(words), Counter(words)
                found = [(terms[w], counts[w]) for w in terms.keys() & counts.keys()]
                if every:
                    found.append((mark, 1))
                at += [r] * len(found)
                length += [n] * len(found)
                term += [w for w, _ in found]
                tf += [c for _, c in found]
            kept = [batch.column(batch.schema.get_field_index(n)).take(pa.array(at, pa.int64())) for n in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(length, pa.int32()), pa.array(term, pa.string()), pa.array(tf, pa.int64())], names=[*columns, "length", "term", "tf"])

    return docs.mapInArrow(scan, ", ".join([*(f"`{n}` {kind}" for n, kind in docs.dtypes if n in columns), "length int, term string, tf long"]))


def bm25(queries: DataFrame, docs: DataFrame, by: str | None = None) -> DataFrame:
    """(query_id, doc_id, score) of queries (query_id, text) and documents (doc_id, text) that share a token.

    Documents are read once: their tokens meet the query terms, a broadcast, right behind the scan, and what is left, with one entry
    for each document, is staged by document for frequencies, mean length and scores; the weighted query terms come to it by broadcast, so
    a document's scores are added up where its postings are and a frequent term is no task of its own. With ``by``, a column of both sides, a query sees only
    documents with its own value; frequencies still count all.
    """
    extra = [by] if by else []
    terms = queries.select("query_id", *extra, F.explode(F.array_distinct(F.slice(tokens(F.col("text")), 1, QUERY_TOKENS))).alias("term"))
    found = with_terms(docs.select("doc_id", *extra, "text"), terms.select("term"), every=True)
    postings = staged(found.repartition("doc_id").groupBy("doc_id", *extra, "length", "term").agg(F.sum("tf").alias("tf")))
    sizes = postings.filter(F.col("term") == EVERY).agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    postings = postings.filter(F.col("term") != EVERY)
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    weights = small(terms.join(frequency, "term").crossJoin(F.broadcast(sizes)))  # one row of totals
    scored = postings.join(weights, ["term", *extra]).groupBy("query_id", "doc_id").agg(F.sum(idf * gain).alias("score"))
    return scored.withColumn("score", F.round("score", 6))


def top_with_ties(hits: DataFrame, k: int, by: str = "query_id", score: str = "score") -> DataFrame:
    """The k best of each query and all that equal the k-th, with their rank."""
    return hits.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(F.desc(score)))).filter(F.col("rank") <= k)


def top(hits: DataFrame, k: int, *ties: str, by: str = "query_id", score: str = "score") -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), *ties))).filter(F.col("rank") <= k)


def decayed(hits: DataFrame, ratio: float, most: int) -> DataFrame:
    """Hits of at least ``ratio`` times their query's best score, ``most`` of them."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return top(hits.withColumn("best", best).filter(F.col("score") >= ratio * F.col("best")), most, "doc_id").drop("best")


def literal(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, place) of queries whose text occurs in a document.

    Candidates share the query's longest inner token, an equi-join; ``locate`` then verifies the whole phrase. The first and the last token may be
    parts of a document's word, so phrases of fewer than three tokens have no inner one and are looked for in every document.
    """
    inner = F.slice(tokens(F.col("text")), 2, F.greatest(F.size(tokens(F.col("text"))) - 2, F.lit(0)))
    anchor = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    phrases = queries.select("query_id", F.col("text").alias("phrase"), anchor.alias("token"))
    words = with_terms(docs.select("doc_id", "text"), phrases.select("token"), with_text=True).withColumnRenamed("term", "token")
    place = F.expr("locate(phrase, text)")
    anchored = words.join(small(phrases.filter("token is not null")), "token").select("query_id", "doc_id", place.alias("place")).filter("place > 0")
    short = docs.join(small(phrases.filter("token is null")), place > 0).select("query_id", "doc_id", place.alias("place"))
    return anchored.unionByName(short)


def starts(text: Column, phrase: Column) -> Column:
    """0-based starts of all occurrences of a phrase, from left to right, none overlapping."""
    parts = F.split(text, F.concat(F.lit("\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    before = lambda i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda n, p: n + F.length(p)) + i * F.length(phrase)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 2), before)).otherwise(F.array().cast("array<int>"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 100_000) -> DataFrame:
    """Exact nearest by dot product of stated queries (query_id, vector) against all (doc_id, vector), ties kept.

    Products of blocks by single-precision matrices leave out what can't be among the k best; the rest is multiplied in double precision in the order of the
    elements, rounded and ranked. A task holds ``block`` queries and its own k best of each. Vectors of different lengths, with nulls or without
    finite values go pair by pair.
    """
    odd = lambda v: F.coalesce(~F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 1e15)), F.lit(True))
    shape = lambda d: d.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.count_if(odd(F.col("vector"))).alias("odd"), F.count("*").alias("n")).first()
    mine, all_ = shape(queries), shape(vectors)
    even = not mine["odd"] and not all_["odd"] and {mine["low"], mine["high"], all_["low"], all_["high"]} == {mine["low"]} and mine["low"]
    blocks = max(1, -(-mine["n"] // (block if even else 2000)))
    products = mine["n"] * all_["n"] // blocks
    dealt = vectors.repartition(max(min(vectors.sparkSession.sparkContext.defaultParallelism, products // 10_000_000), products // 1_000_000_000, 1))
    asked = queries.select("query_id", F.col("vector").alias("asked"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("part"))
    best = []
    for part in range(blocks):
        own = asked.filter(F.col("part") == part)
        if even:
            pairs = _candidates(own, dealt, k, mine["low"])
        else:
            pairs = vectors.crossJoin(F.broadcast(own)).filter("query_id <> doc_id").select("query_id", "doc_id", dot(F.col("asked"), F.col("vector")).alias("score"))
        best.append(top_with_ties(pairs.withColumn("score", F.round("score", 6)), k))
    return reduce(DataFrame.unionByName, best)


def _candidates(asked: DataFrame, vectors: DataFrame, k: int, length: int) -> DataFrame:
    """(query_id, doc_id, score) of all pairs that may be among a query's k best or equal the k-th after rounding to 6 digits; scores are sums in the order of the elements."""
    flat = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    held = asked.select("query_id", "asked").toArrow()
    ids, exact = held["query_id"].to_numpy(), flat(held["asked"])
    sent = vectors.sparkSession.sparkContext.broadcast((ids, exact))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, exact = sent.value
        rough, norms = exact.astype(np.float32), np.sqrt((exact * exact).sum(axis=1))
        bound = np.full(len(ids), -np.inf)  # below it, nothing of this task counts
        norm = 0.0
        kept: list[list[np.ndarray]] = []
        tops = np.full((len(ids), k), -np.inf, np.float32)
        for batch in batches:
            docs = batch.column(0).to_numpy()
            all_ = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
            norm = np.sqrt((all_ * all_).sum(axis=1)).max(initial=norm)
            slack = 4e-6 + 4 * (length + 2) * 6e-8 * norms * norm + 1e-12 * norms * norm
            step = max(1, (1 << 23) // max(1, len(docs)))
            again = np.nonzero(np.isin(docs, ids))[0]
            for s in range(0, len(ids), step):
                part = slice(s, s + step)
                likes = rough[part] @ all_.astype(np.float32).T
                for j in again:
                    likes[ids[part] == docs[j], j] = -np.inf
                bound[part] = tops[part].min(axis=1) - slack[part]
                new = np.nonzero(likes.max(axis=1, initial=-np.inf) >= bound[part])[0]  # queries that this batch has something for
                better = likes[new]
                top = np.concatenate([tops[s + new], np.partition(better, max(0, better.shape[1] - k), axis=1)[:, -k:]], axis=1)
                tops[s + new] = np.partition(top, top.shape[1] - k, axis=1)[:, -k:]
                bound[part] = tops[part].min(axis=1) - slack[part]
                i, j = np.nonzero((likes >= bound[part, None]) & (likes > -np.inf))
                i = i + s
                total = np.zeros(len(i))
                for e in range(length):
                    total += exact[i, e] * all_[j, e]
                kept.append([i, docs[j], total])
            if sum(len(x[0]) for x in kept) > 4 * k * len(ids) + (1 << 20):  # what has fallen behind since goes
                i, d, total = (np.concatenate(x) for x in zip(*kept, strict=True))
                live = total >= bound[i]
                if live.mean() < 0.5:
                    kept = [[i[live], d[live], total[live]]]
                else:  # many ties: they go on as they are
                    yield pa.RecordBatch.from_pydict({"query_id": ids[i], "doc_id": d, "score": total})
                    kept = []
        for i, d, total in kept:
            live = total >= bound[i]
            if live.any():
                yield pa.RecordBatch.from_pydict({"query_id": ids[i[live]], "doc_id": d[live], "score": total[live]})

    return vectors.select("doc_id", "vector").mapInArrow(scan, "query_id long, doc_id long, score double")


def lanes(first: DataFrame, *others: tuple[DataFrame, float]) -> DataFrame:
    """Union of lanes with weights; of a document's lanes the best one stays, the earlier one among equals."""
    rows = first.withColumn("lane", F.lit(0))
    for k, (lane, weight) in enumerate(others, 1):
        rows = rows.unionByName(lane.withColumn("score", F.round(F.col("score") * weight, 4)).withColumn("lane", F.lit(k)))
    best = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "lane")
    return rows.withColumn("order", F.row_number().over(best)).filter("order = 1").drop("order")


def pattern_hits(docs: DataFrame, patterns: list[str], k: int) -> DataFrame:
    """The k documents in which most of the patterns occur."""
    hits = sum((F.col("text").rlike(p).cast("int") for p in patterns), F.lit(0))
    return docs.select("doc_id", hits.alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def facts_overlap(asked: DataFrame, held: DataFrame, weights: dict[str, float], anchors: list[str]) -> DataFrame:
    """Score of facts (slot, value) shared by queries and objects, where a query's first anchor slot must match."""
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    order = F.create_map(*[F.lit(x) for pair in zip(anchors, range(len(anchors)), strict=True) for x in pair])
    first = asked.groupBy("query_id").agg(F.min(F.try_element_at(order, F.col("slot"))).alias("anchor"))
    both = asked.join(held, ["slot", "value"]).join(first, "query_id")
    scored = both.groupBy("query_id", "doc_id").agg(F.sum(F.coalesce(F.try_element_at(weight, F.col("slot")), F.lit(0.0))).alias("score"), F.max((F.try_element_at(order, F.col("slot")) == F.col("anchor")).cast("int")).alias("anchored"))
    return scored.filter("anchored = 1").select("query_id", "doc_id", F.round("score", 6).alias("score"))


def best_and_second(hits: DataFrame, share: float = 0.3) -> DataFrame:
    """Per query and document: the best score plus a share of the second."""
    ranked = F.sort_array(F.collect_list("score"), asc=False)
    second = F.coalesce(F.try_element_at(ranked, F.lit(2)), F.lit(0.0))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.element_at(ranked, 1) + share * second, 6).alias("score"))


def adaptive_k(pages: Column) -> Column:
    return F.when(pages < 500, 10).when(pages < 3000, 25).when(pages < 10000, 50).otherwise(75)


def with_fallback(first: DataFrame, second: DataFrame, key: str = "query_id") -> DataFrame:
    """All of the first tier, and the second tier's rows of queries that the first has none for."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))
