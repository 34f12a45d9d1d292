"""Toxic passages by maximum-scoring segments (operator 7).

Tokens are lower-cased runs of letters. A token's features are the word and its first four and five
letters. Their log-odds between toxic and other labelled documents, by document counts with a Dirichlet prior
that draws rare features to the background, are learned from at most about ``MOST_TRAINED`` labelled documents, near copies counted once,
and drawn to 0 by 1.64 standard deviations. Every feature of ``LEAST_DOCS`` documents or more whose log-odds are then negative, or at least ``LEAST_ODDS``,
counts; there is no limit to their number. A token scores its best positive feature, else its word's negative log-odds, if any, less ``DRIFT``.

A linear scan (Ruzzo and Tompa) finds all maximal segments of a text's scores; it visits the positive tokens only, as prefix sums
hold what lies between. By extreme-value theory the best segment of n clean tokens exceeds s with
probability 1 - exp(-K n exp(-lambda s)): lambda solves E[exp(lambda x)] = 1 over clean tokens, K fits the
clean documents. A document's statistic adds lambda s - ln(K n) over its significant segments, or is that of
its best one. Isotonic regression makes it a score. All of this calibration uses log-odds learned without the document's own fold; near copies share a fold.

Null and empty texts have no token and get the score of the lowest statistic. A label counts as toxic if any
label row of its doc_id does. Without labels of both kinds every score is the share of toxic ones, or 0; without any label or document to learn from, 0.
Equal texts, so repeated rows, get equal scores; ties of statistics too. A very long text is a slice of its own, never cut. Rows without a doc_id are
scored like others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import checkpointed, id_and_text, map_texts, quoted, record, sliced
from gleanery.llm.langid import remainder, sample
from gleanery.llm.letters import letters
from gleanery.llm.merge_table import HashTable
from gleanery.llm.words import U, mixed, polynomials

MOST_TRAINED = 20_000
PRIOR, MARGIN, LEAST_ODDS, LEAST_DOCS, DRIFT = 10.0, 1.64, 1.0, 3, 0.05
PREFIXES = (4, 5)
FOLDS = 4
SIGNIFICANT = 0.05
LOWEST = -20.0
#: Token scores are counted in bins of this width from -HIGHEST to HIGHEST to find lambda.
BIN, HIGHEST = 0.01, 16.0


def token_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, begins): a row of feature keys for each token, -1 for a prefix that it lacks, and where each text's tokens begin."""
    code, begins = letters(texts)
    word = code != 0
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    ends = np.flatnonzero(~word[1:] & word[:-1]) + 1
    value = lambda low, high: mixed(code[low:high].astype(U))
    with np.errstate(over="ignore"):
        of = lambda stop, kind: (mixed(polynomials(value, len(code), starts, stop) + U(kind)) >> U(1)).astype(np.int64)
        keys = [of(ends, 0)] + [np.where(ends - starts > k, of(np.minimum(starts + k, ends), k), -1) for k in PREFIXES]
    return np.stack(keys, 1), np.searchsorted(starts, begins)


@dataclass
class Scorer:
    """The model: a row of log-odds for each feature key, learned without each of the folds and, last, from all."""

    keys: np.ndarray
    odds: np.ndarray
    rate: float = 1.0  # lambda
    size: float = 1.0  # K
    statistics: tuple[float, ...] = (LOWEST,)  # isotonic curve
    chances: tuple[float, ...] = (0.0,)

    def token_scores(self, keys: np.ndarray, fold: np.ndarray | int = FOLDS) -> np.ndarray:
        """Scores of tokens, each by the log-odds that were learned without its ``fold``; by default by those from all documents."""
        if not hasattr(self, "_table"):
            self._table = HashTable()
            self._table.put(self.keys, np.arange(len(self.keys), dtype=np.int32))
        fold = np.broadcast_to(fold, len(keys))
        best, word = np.zeros(len(keys)), np.zeros(len(keys))
        for k in range(keys.shape[1]):
            asked = np.flatnonzero(keys[:, k] >= 0)
            found = self._table.get(keys[asked, k])
            asked, found = asked[found >= 0], found[found >= 0]
            own = self.odds[found, fold[asked]]
            best[asked] = np.maximum(best[asked], own)
            if k == 0:
                word[asked] = np.minimum(own, 0)
        return np.where(best > 0, best, word - DRIFT)

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments (first, past, score) of one text's token scores."""
        at = np.flatnonzero(scores > 0)
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        stack: list[tuple] = []  # (first, past, sum before, sum through)
        for k, low, high in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
            own = (k, k + 1, low, high)
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= own[2]:
                    j -= 1
                if j < 0 or stack[j][3] >= own[3]:
                    stack.append(own)
                    break
                own = (stack[j][0], own[1], stack[j][2], own[3])
                del stack[j:]
        return [(f, p, high - low) for f, p, low, high in stack]

    def surprise(self, score: float, n: int) -> float:
        """-ln of the expected number of clean segments of that score in n tokens."""
        return self.rate * score - np.log(max(self.size * n, 1e-9))

    def statistic(self, found: list[tuple[int, int, float]], n: int) -> float:
        if not found:
            return LOWEST
        each = [self.surprise(s, n) for _, _, s in found]
        clear = [x for x in each if x > -np.log(SIGNIFICANT)]
        return max(LOWEST, sum(clear) if clear else max(each))

    def score(self, statistic: np.ndarray) -> np.ndarray:
        return np.interp(statistic, self.statistics, self.chances)


def least_hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Four least shingle hashes of each text, and its fold by the first: near copies share one of them in most cases."""
    from gleanery.llm.near_dup import FACTORS, shingles

    value, begins = shingles([(t or "").encode() for t in batch.column(1).to_pylist()])
    full = np.flatnonzero(np.diff(begins))
    out = np.zeros((batch.num_rows, 4), np.int64)
    with np.errstate(over="ignore"):
        for k in range(4):
            if len(full):
                out[full, k] = np.minimum.reduceat(value * FACTORS[k], begins[:-1][full]).view(np.int64)
    return record(doc_id=batch.column(0), fold=((out[:, 0] >> 20) % FOLDS).astype(np.int32), keys=pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * 4), pa.array(out.ravel())))


def with_folds(rows: DataFrame) -> DataFrame:
    """Rows of (doc_id, text, toxic) with ``fold``, and ``first``: whether none of a smaller doc_id shares a least hash."""
    keys = checkpointed(map_texts(rows.select("doc_id", "text"), least_hashes, "doc_id long, fold int, keys array<long>"))
    each = keys.select("doc_id", F.posexplode("keys").alias("kind", "key"))
    least = each.groupBy("kind", "key").agg(F.min("doc_id").alias("least"))
    first = each.join(least, ["kind", "key"]).groupBy("doc_id").agg(F.min(F.col("doc_id") == F.col("least")).alias("first"))
    return rows.join(keys.groupBy("doc_id").agg(F.min("fold").alias("fold")), "doc_id").join(first, "doc_id")


def feature_counts(rows: DataFrame) -> DataFrame:
    """(key, fold, toxic, other): documents with each feature, over rows of (toxic, fold, text); key -1 has all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                toxic = part.column(0).to_numpy(zero_copy_only=False).astype(bool)
                fold = part.column(1).to_numpy().astype(np.int64)
                keys, begins = token_features(part.column(2).fill_null("").to_pylist())
                text = np.repeat(np.repeat(np.arange(len(toxic)), np.diff(begins)), keys.shape[1])
                keys = keys.ravel()
                text, keys = text[keys >= 0], keys[keys >= 0]
                text, keys = np.concatenate([text, np.arange(len(toxic))]), np.concatenate([keys, np.full(len(toxic), -1)])
                order = np.lexsort((keys, text))
                text, keys = text[order], keys[order]
                new = np.concatenate([[True], (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])])
                text, keys = text[new], keys[new]
                each, which = np.unique(np.stack([keys, fold[text]]), axis=1, return_inverse=True)
                both = np.bincount(which, minlength=each.shape[1])
                bad = np.bincount(which[toxic[text]], minlength=each.shape[1])
                yield record(key=each[0], fold=each[1].astype(np.int32), toxic=bad, other=both - bad)

    found = rows.select("toxic", "fold", "text").mapInArrow(run, "key long, fold int, toxic long, other long")
    return found.groupBy("key", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit_odds(rows: DataFrame) -> Scorer | None:
    """Log-odds of all features that count, once for each fold without it and once from all; None without both labels in each."""
    own = lambda c, without: F.sum(F.when(F.col("fold") != without, F.col(c)).otherwise(0)).alias(f"{c}{without}")
    counts = checkpointed(feature_counts(rows).groupBy("key").agg(*[own(c, f) for c in ("toxic", "other") for f in range(FOLDS + 1)]))
    whole = counts.filter("key = -1").first()
    if whole is None or not all(whole[f"{c}{f}"] for c in ("toxic", "other") for f in range(FOLDS + 1)):
        return None

    def drawn(f: int):
        y1, y0, n1, n0 = F.col(f"toxic{f}"), F.col(f"other{f}"), float(whole[f"toxic{f}"]), float(whole[f"other{f}"])
        prior = PRIOR * (y1 + y0) / (n1 + n0)
        odds = lambda y, n: F.log((y + prior) / (n + PRIOR - y - prior))
        raw = odds(y1, n1) - odds(y0, n0)
        sure = F.signum(raw) * F.greatest(F.lit(0.0), F.abs(raw) - MARGIN * F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior)))
        counts_too = (y1 + y0 >= LEAST_DOCS) & ((sure < 0) | ((sure >= LEAST_ODDS) & (y1 >= LEAST_DOCS)))
        return F.when(counts_too, sure).otherwise(0.0).alias(f"odds{f}")

    names = [f"odds{f}" for f in range(FOLDS + 1)]
    found = counts.filter("key >= 0").select("key", *[drawn(f) for f in range(FOLDS + 1)]).filter(" or ".join(f"{c} <> 0" for c in names))
    found = found.orderBy("key").toPandas()  # features with clear odds in the bounded sample
    return Scorer(found["key"].to_numpy(np.int64), np.clip(found[names].to_numpy(float), -HIGHEST, HIGHEST))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The rising curve through labels y by x with the least squares, drawn a little to the mean: middles of its steps and their heights."""
    order, steps = np.lexsort((-y, x)), []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        steps.append([b, 1, a, a])
        while len(steps) > 1 and (steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1] or steps[-2][3] == steps[-1][2]):
            last = steps.pop()
            steps[-1] = [steps[-1][0] + last[0], steps[-1][1] + last[1], steps[-1][2], last[3]]
    height = np.maximum.accumulate([(s + 0.5 * y.mean()) / (n + 0.5) for s, n, _, _ in steps])
    return tuple((low + high) / 2 for _, _, low, high in steps), tuple(height.tolist())


def calibrate(scorer: Scorer, rows: DataFrame) -> Scorer:
    """Fit lambda and K to the clean documents of rows (toxic, fold, text), then the isotonic curve to all, each by the log-odds without its fold."""
    edges = int(2 * HIGHEST / BIN) + 1
    inputs = rows.select(F.col("toxic").cast("int").alias("toxic"), "text", "fold")

    def scores_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys, begins = token_features(batch.column(1).fill_null("").to_pylist())
        return scorer.token_scores(keys, np.repeat(batch.column(2).to_numpy(), np.diff(begins))), begins

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, begins = scores_of(batch)
        toxic, n = batch.column(0).to_numpy(), np.diff(begins)
        best = [max((s for *_, s in scorer.segments(scores[a:b])), default=0.0) for a, b in zip(begins[:-1], begins[1:], strict=True)]
        clean = scores[np.repeat(toxic == 0, n)]
        bins = np.bincount(np.clip(np.rint((clean + HIGHEST) / BIN), 0, edges - 1).astype(np.int64), minlength=edges)
        return record(toxic=batch.column(0), n=n.astype(np.int64), best=pa.array(best, pa.float64()), bins=pa.array([bins] + [None] * (len(n) - 1), pa.list_(pa.int64())))

    seen = map_texts(inputs, first, "toxic int, n long, best double, bins array<long>").toPandas()  # a row for each document of the bounded sample
    bins = np.sum([b for b in seen["bins"] if b is not None], axis=0) if len(seen) else np.zeros(edges)
    value, low, high = np.arange(edges) * BIN - HIGHEST, 1e-3, 5.0
    for _ in range(60):
        rate = (low + high) / 2
        low, high = (low, rate) if (bins * np.exp(rate * value)).sum() > max(bins.sum(), 1) else (rate, high)
    scorer.rate = max(low, 0.05)
    # P(no segment above s in n tokens) = exp(-K n exp(-lambda s)), so 1 / K is the mean of n exp(-lambda s)
    clean = seen[seen["toxic"] == 0]
    scorer.size = 1 / max(float(np.mean(clean["n"] * np.exp(-scorer.rate * clean["best"]))), 1e-9)

    def second(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, begins = scores_of(batch)
        found = [scorer.statistic(scorer.segments(scores[a:b]), b - a) for a, b in zip(begins[:-1], begins[1:], strict=True)]
        return record(toxic=batch.column(0), statistic=pa.array(found, pa.float64()))

    seen = map_texts(inputs, second, "toxic int, statistic double").toPandas()
    scorer.statistics, scorer.chances = isotonic(seen["statistic"].to_numpy(float), seen["toxic"].to_numpy(float))
    return scorer


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, most_trained: int = MOST_TRAINED) -> Scorer:
    """Learn from documents (doc_id, text) with a label (doc_id, toxic), but not from those held out."""
    labelled = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = sample(labelled.filter(remainder(F.col("doc_id"), modulus) != held), most_trained)  # so it may be broadcast
    rows = checkpointed(docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", (F.col("toxic") == 1).alias("toxic")))
    rows = checkpointed(with_folds(rows))
    scorer = fit_odds(rows.filter("first"))
    if scorer is None:
        share = rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
        return Scorer(np.zeros(0, np.int64), np.zeros((0, FOLDS + 1)), chances=(share,))
    return calibrate(scorer, rows)


def busy(scores: np.ndarray, begins: np.ndarray) -> list[int]:
    """The texts with a positive token."""
    return np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(scores > 0), begins))).tolist()


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score, segments) of rows of (doc_id, text); a segment has its words [first, past), score and p-value."""
    model = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = model.value
        keys, begins = token_features(batch.column(1).fill_null("").to_pylist())
        scores = own.token_scores(keys)
        statistic, clear = np.full(batch.num_rows, LOWEST), [[]] * batch.num_rows
        for k in busy(scores, begins):
            a, b = begins[k], begins[k + 1]
            found = own.segments(scores[a:b])
            statistic[k] = own.statistic(found, b - a)
            chances = [-np.expm1(-np.exp(-own.surprise(s, b - a))) for *_, s in found]
            clear[k] = [{"first": f, "past": p, "score": s, "p_value": c} for (f, p, s), c in zip(found, chances, strict=True) if c <= SIGNIFICANT]
        return record(doc_id=batch.column(0), score=own.score(statistic), segments=pa.array(clear, kind))

    return map_texts(docs.select("doc_id", "text"), kernel, "doc_id long, score double, segments array<struct<first:int,past:int,score:double,p_value:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Rows of (doc_id, held_out, score, predicted, segments), one for each input row."""
    docs = id_and_text(docs, id_col, text_col)
    labels = labels.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(label_col)).cast("int").alias("toxic"))
    out = scored(docs, fit(docs, labels, modulus, held))
    return out.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "segments")


def without_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted as toxic, each judged by its own text."""
    named = labels.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(label_col)).cast("int").alias("toxic"))
    model = docs.sparkSession.sparkContext.broadcast(fit(id_and_text(docs, id_col, text_col), named, modulus, held))

    def kept(part: pa.RecordBatch) -> pa.RecordBatch:
        own = model.value
        keys, begins = token_features(part.column(part.schema.get_field_index(text_col)).fill_null("").to_pylist())
        scores = own.token_scores(keys)
        statistic = np.full(part.num_rows, LOWEST)
        for k in busy(scores, begins):
            statistic[k] = own.statistic(own.segments(scores[begins[k] : begins[k + 1]]), begins[k + 1] - begins[k])
        return part.filter(pa.array(own.score(statistic) < 0.5))

    return map_texts(docs, kept, docs.schema, text_col)
