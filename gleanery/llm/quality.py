"""Quality rules by tokeniser fertility (operator 6).

Base counts come from words and lines of the whole text. Fertility comes from a public vocabulary: characters per
token, the share of tokens that are byte fallbacks, and the entropy of the token distribution over its
largest possible value. Each language has bands of these, by size class of the text as entropy depends on it: quartiles over all
documents, widened by ``SPREAD`` times the distance between them and by ``SLACK`` over the square root of the class's tokens (a few odd
words weigh more in a short text), more where few documents stand behind them. A document outside a band is rejected; so are those that fail the base rules.

Null texts have no words. A null language is a language of its own. Ties and repeated rows change nothing. An
empty table gives an empty result. A very long text is a slice of its own, never cut. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import checkpointed, map_texts, quoted, record
from gleanery.llm.merge_table import Codec, shared_model
from gleanery.llm.words import compact, hashes, run_hashes, window_starts

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
METRICS = ("chars_per_token", "byte_share", "entropy")
SPREAD = 4.0
SLACK = {"chars_per_token": 2.0, "byte_share": 0.8, "entropy": 0.5}
#: A class of few documents has wider bands: by 1 + FEW / sqrt(documents).
FEW = 2.0
DIGITS = 4


def repeated_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, characters in words, words in windows found twice or more) of each text."""
    data, starts, ends, begins = compact(texts)
    n = np.diff(begins)
    own = np.concatenate([[0], np.cumsum((data != 32) & ((data & 0xC0) != 0x80))])
    chars = np.concatenate([[0], np.cumsum(own[ends] - own[starts])])
    at = window_starts(begins, WINDOW)
    if not len(at):
        return n, chars[begins[1:]] - chars[begins[:-1]], np.zeros(len(n), np.int64)
    text = np.searchsorted(begins, at, side="right") - 1
    key = run_hashes(hashes(data, starts, ends), at, at + WINDOW)
    order = np.lexsort((key, text))
    equal = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    raw = data.tobytes()
    low, high = starts[at[order]], ends[at[order] + WINDOW - 1]
    for k in np.flatnonzero(equal).tolist():  # equal hashes are compared in full
        equal[k] = raw[low[k] : high[k]] == raw[low[k + 1] : high[k + 1]]
    found = np.zeros(len(at), bool)
    found[order[1:][equal]] = True
    found[order[:-1][equal]] = True
    edge = np.zeros(len(starts) + WINDOW + 1, np.int64)
    np.add.at(edge, at[found], 1)
    np.add.at(edge, at[found] + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge)[: len(starts)] > 0)])
    return n, chars[begins[1:]] - chars[begins[:-1]], inside[begins[1:]] - inside[begins[:-1]]


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def fertility(codec: Codec, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, characters per token, byte-fallback share, relative entropy) of each text."""
    ids = codec.encode(texts)
    n = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(ids)), n)
    chars = np.array([len(t) for t in texts], float)
    fallback = np.isin(flat, [i for b, i in codec.model.byte_ids.items() if b >= 0x20])  # not line ends and tabs
    share = np.bincount(of[fallback], minlength=len(ids)) / np.maximum(n, 1)
    key = np.sort((of << 32) | flat)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(key)]]))
    own = key[first] >> 32
    p = count / np.maximum(n, 1)[own]
    entropy = np.bincount(own, weights=-p * np.log2(p), minlength=len(ids))
    return n, chars / np.maximum(n, 1), share, np.where(n > 1, entropy / np.log2(np.maximum(n, 2)), 1.0)


def measured(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Base counts and fertility of rows of (doc_id, lang, text)."""
    shared = shared_model(docs.sparkSession, model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).fill_null("").to_pylist()
        raw = [t.encode() for t in texts]
        n_words, chars, repeated = repeated_words(raw)
        tokens, per_token, share, entropy = fertility(Codec(shared.value), texts)
        symbols = [int(SYMBOLS[np.frombuffer(t, np.uint8)].sum()) for t in raw]
        return record(
            doc_id=batch.column(0), lang=batch.column(1), n_words=n_words, word_chars=chars, n_symbols=pa.array(symbols, pa.int64()), n_dup_lines=pa.array([repeated_lines(t) for t in raw], pa.int64()),
            n_repeat_words=repeated, n_tokens=tokens, chars_per_token=per_token, byte_share=share, entropy=entropy,
        )

    return map_texts(docs, kernel, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double")


def quartiles_of(rows: DataFrame) -> DataFrame:
    """(lang, class, n, [lower, upper] quartile of each metric), exact: from counts of the values at ``DIGITS`` digits and their running sums."""
    each = rows.select("lang", "class", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, DIGITS).alias("value")) for m in METRICS])).alias("x")).select("lang", "class", "x.*")
    own = Window.partitionBy("lang", "class", "metric")
    counts = each.groupBy("lang", "class", "metric", "value").agg(F.count("*").alias("c"))  # a bounded number of values a class
    ranked = counts.withColumn("upto", F.sum("c").over(own.orderBy("value"))).withColumn("n", F.sum("c").over(own))
    at = lambda share: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * share), F.col("value")))
    found = ranked.groupBy("lang", "class", "metric").agg(F.max("n").alias("n"), F.array(at(0.25), at(0.75)).alias("q"))
    return found.groupBy("lang", "class").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("metric") == m, F.col("q"))).alias(m) for m in METRICS])


def bands(rows: DataFrame) -> DataFrame:
    """(lang, class, low and high of each metric) from all measured rows that pass the base rules."""
    quartiles = quartiles_of(rows.filter("not base_failed"))
    out = ["lang", "class"]
    for m in METRICS:
        width = (SPREAD * (F.col(m)[1] - F.col(m)[0]) + SLACK[m] / F.pow(F.lit(2.0), F.col("class"))) * (1 + FEW / F.sqrt("n"))
        out += [(F.col(m)[0] - width).alias(f"{m}_low"), (F.col(m)[1] + width).alias(f"{m}_high")]
    return quartiles.select(*out)


def quality(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_per_token, byte_share, entropy)."""
    docs = docs.select(*[F.col(quoted(c)).cast(t).alias(n) for c, t, n in ((id_col, "long", "doc_id"), (lang_col, "string", "lang"), (text_col, "string", "text"))])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    size_class = F.floor(F.log2(F.greatest("n_tokens", F.lit(1))) / 2).cast("int")  # at most 32 classes a language
    rows = checkpointed(measured(docs, model)).withColumn("base_failed", failed).withColumn("class", size_class)
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    held = bands(rows).withColumnsRenamed({"lang": "band_lang", "class": "band_class"})
    joined = rows.join(held, F.col("lang").eqNullSafe(F.col("band_lang")) & (F.col("class") == F.col("band_class")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"), *METRICS)


ORACLE_BASE = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
u as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
g as (select *, count(*) over f as n, string_agg(w, ' ') over f as g from u window f as (partition by doc_id order by i rows between current row and 7 following)),
r as (select doc_id, w, i, n = 8 and count(*) over (partition by doc_id, n = 8, g) > 1 as again from g),
c as (select *, max(again::int) over (partition by doc_id order by i rows between 7 preceding and current row) as inside from r),
k as (select doc_id, count(*) as n_words, sum(length(w)) as word_chars, sum(inside) as n_repeat_words from c group by doc_id),
l as (select doc_id, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
       coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_words, 0) < 20 or 100 * n_repeat_words > 30 * n_words as base_failed
from d left join k using (doc_id) left join l using (doc_id)
"""
