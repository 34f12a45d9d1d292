"""Language by multinomial naive Bayes over hashed character n-grams (operator 3).

Features are the 2-grams and 3-grams of lower-cased letters with a mark at word borders, hashed to
``BUCKETS``. Counts by language come from at most about ``MOST_TRAINED`` labelled documents, picked by a hash of
doc_id in equal proportion; that bound is a parameter. The matrix of log probabilities (languages x
BUCKETS floats) is broadcast, and whole texts are scored in numpy.

A null text or one without a letter gets ``und`` and score 0. Rows with a null language or text teach
nothing. Ties go to the language first by code point. With nothing to learn from, every
prediction is ``und``; an empty table gives an empty result. A very long text is scored whole. Repeated rows and extra columns make no difference to a row's prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_texts, quoted, record, sliced
from gleanery.llm.letters import letters, per_text

BUCKETS = 1 << 16
MOST_TRAINED = 20_000
SMOOTH = 0.5
UNKNOWN = "und"


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows at most, by a hash of doc_id; all of them if there are no more."""
    n = rows.count()
    share = min(1.0, most / max(n, 1))
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rows


def buckets(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(3-gram buckets, 2-gram buckets, begins) with one of each for every letter."""
    at = np.flatnonzero(codes)
    before, own, after = (codes[at + k].astype(np.uint64) for k in (-1, 0, 1))
    with np.errstate(over="ignore"):
        two = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (own * np.uint64(0xC2B2AE3D27D4EB4F))
        three = (two * np.uint64(0x165667B19E3779F9)) ^ (after * np.uint64(0xD6E8FEB86659FD93))
        two, three = ((x * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48) for x in (two, three))
    return three.astype(np.int64), two.astype(np.int64), np.searchsorted(at, begins)


def counted(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n, documents) over labelled texts; bucket -1 has the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in sliced(batch):
                langs = np.array(part.column(0).to_pylist(), object)
                three, two, begins = buckets(*letters(part.column(1).to_pylist()))
                of = np.repeat(np.arange(len(langs)), np.diff(begins))
                for lang in sorted(set(langs)):
                    own = (langs == lang)[of]
                    total = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    total[:-1] += np.bincount(three[own], minlength=BUCKETS) + np.bincount(two[own], minlength=BUCKETS)
                    total[-1] += (langs == lang).sum()
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield record(lang=[lang] * len(at), bucket=at.astype(np.int32), n=total[at])

    rows = labelled.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, most: int = MOST_TRAINED) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities, log priors) from rows of (doc_id, lang, text)."""
    rows = counted(sample(labelled, most)).toPandas()  # at most languages x (BUCKETS + 1) numbers
    langs = sorted(rows["lang"].unique().tolist(), key=lambda x: x.encode())
    counts = np.zeros((len(langs), BUCKETS + 1))
    counts[rows["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(float)
    documents, counts = counts[:, -1:], counts[:, :-1] + SMOOTH
    return langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32), np.log(documents[:, 0] / max(documents.sum(), 1))


def predict_languages(docs: DataFrame, modulus: int = 3, held: int = 1, most: int = MOST_TRAINED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of (doc_id, held_out, lang_pred, score), one for each input row.

    Rows whose crc32 of doc_id leaves ``held`` modulo ``modulus`` are held out of the learning.
    """
    docs = docs.select(*[F.col(quoted(c)).cast(t).alias(n) for c, t, n in ((id_col, "long", "doc_id"), (text_col, "string", "text"), (lang_col, "string", "lang"))])
    held_out = (remainder(F.col("doc_id"), modulus) == held).alias("held_out")
    langs, logs, priors = fit(docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()), most)
    model = docs.sparkSession.sparkContext.broadcast((langs, logs, priors))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, logs, priors = model.value
        three, two, begins = buckets(*letters(batch.column(1).fill_null("").to_pylist()))
        if langs:
            scores = np.stack([per_text(row.take(three) + row.take(two), begins) + p for row, p in zip(logs, priors, strict=True)])
            best = scores.argmax(0)
            chance = 1 / np.exp(scores - scores.max(0)).sum(0)
        else:
            best, chance = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
        known = (np.diff(begins) > 0) & bool(langs)
        names = [langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
        return record(doc_id=batch.column(0), held_out=batch.column(2), lang_pred=pa.array(names, pa.string()), score=np.where(known, chance, 0.0))

    return map_texts(docs.select("doc_id", "text", held_out), kernel, "doc_id long, held_out boolean, lang_pred string, score double")
