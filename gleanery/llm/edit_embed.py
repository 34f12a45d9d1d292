"""Document fingerprints by randomised edit embedding (operator 4).

A shared random walk reads a text: at step j it looks at character c and then moves on or stays by a
random bit of (j, c). All texts use the same bits, so walks over two texts with few edits fall back into
step after each, and edit distance becomes Hamming distance between what the walks see.

The fingerprint samples that sequence in ``SAMPLES`` places. Each sample is a random set of steps;
it keeps what the walk saw at the set's first step by a random order, among the steps of this walk. So
walks of different lengths sample the same step in proportion to their overlap. What is kept is a
hash of the four characters at the walk's place. The likeness of two fingerprints is the share of equal samples.

Walks run side by side in numpy. A longer text has further steps of the same walk: nothing is cut.

``edited_pairs`` needs each document's follower by doc_id. Documents are dealt by ranges of doc_id, the
first of each range goes to the range before as well, and each range is read in order. So no task
sees more than a range.

Null texts are empty; their samples are all blank. Among equal doc_ids the order is that of the texts. A null
doc_id comes first; rows without one are one range. A very long text is walked whole. Ties of samples count as equal. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import checkpointed, id_and_text, record, sliced
from gleanery.llm.components import components

SAMPLES = 128
CYCLE = 4096  # steps after which the random bits repeat
AHEAD, STRIDE, RUN = 4, 32, 1 << 16
#: Bytes of text walked side by side.
WALKED = 8 << 20
#: Bytes of a range of documents on average, and ranges at most: a bound and a first doc_id of each are collected.
RANGE_BYTES, MOST_RANGES = 32 << 20, 10_000
#: Chance that a pair of the least likeness shares a band, and rows of a block of a bucket.
RECALL, BLOCK = 0.95, 1000
_rng = np.random.default_rng(1905)
#: A random bit for each step of the cycle and each of 256 classes of characters.
MOVES = _rng.integers(0, 2, (CYCLE, 256))
NO_ID = np.iinfo(np.int64).min


class Steps:
    """(step, sample), by step: where a step comes before all earlier ones of its sample in the random order.

    Drawn in runs that each have a generator of their own, so that it can be carried on and is the same for every text.
    """

    def __init__(self) -> None:
        self.known, self.least = 0, np.full(SAMPLES, np.inf)
        self.steps, self.samples = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def upto(self, step: int) -> None:
        while self.known <= step:
            rng = np.random.default_rng([77, self.known])
            sample, rank = rng.integers(0, SAMPLES, RUN), rng.random(RUN)
            order = np.argsort(sample, kind="stable")
            found = []
            for own in np.split(order, np.searchsorted(sample[order], np.arange(1, SAMPLES))):
                if len(own):
                    k = sample[own[0]]
                    before = np.minimum.accumulate(np.concatenate([[self.least[k]], rank[own]]))
                    found.append(own[rank[own] < before[:-1]])
                    self.least[k] = before[-1]
            new = np.sort(np.concatenate(found))
            self.steps, self.samples = np.concatenate([self.steps, new + self.known]), np.concatenate([self.samples, sample[new]])
            self.known += RUN


@lru_cache(maxsize=1)
def steps() -> Steps:
    return Steps()


def kinds_and_views(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each character's class of 256, and a byte from 1 to 255 for the AHEAD characters from it on."""
    kind = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)
    ahead = np.zeros(len(code), np.uint32)
    for k in range(AHEAD):
        ahead *= np.uint32(0x01000193)
        ahead[: len(code) - k] += code[k:] * np.uint32(0x9E3779B1)
    ahead ^= ahead >> np.uint32(15)
    ahead *= np.uint32(0x85EBCA6B)
    ahead ^= ahead >> np.uint32(13)
    return kind, (ahead % np.uint32(255) + np.uint32(1)).astype(np.uint8)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of samples for each text; 0 is a blank sample."""
    out = np.zeros((len(texts), SAMPLES), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return out
    pad = "\0" * (AHEAD + STRIDE)  # a walk may pass its end by a stride before it is seen to have ended
    kind, seen = kinds_and_views(np.frombuffer("".join([texts[k] + pad for k in order]).encode("utf-32-le", "surrogatepass"), "<u4"))
    start = np.cumsum(lengths[order] + len(pad)) - lengths[order] - len(pad)
    place, stop, live, step, at, known = start.copy(), start + lengths[order], order, 0, 0, steps()
    while len(live):
        known.upto(step + STRIDE)
        coming = int(np.searchsorted(known.steps, step + STRIDE))
        due = {}
        for k in range(at, coming):
            due.setdefault(int(known.steps[k]), []).append(int(known.samples[k]))
        at = coming
        for here in range(step, step + STRIDE):
            if here in due:
                on = place < stop
                for sample in due[here]:
                    out[live[on], sample] = seen[place[on]]
            place += MOVES[here % CYCLE].take(kind.take(place))
        step += STRIDE
        going = place < stop
        if not going.all():
            live, place, stop = live[going], place[going], stop[going]
    return out


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal samples of two rows each, of the samples that either has; 1 for two empty texts."""
    used = ((left != 0) | (right != 0)).sum(1)
    same = ((left == right) & (left != 0)).sum(1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def as_text(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def edited(text: str, follower: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + follower[:k] if k else text


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, n_chars, fingerprint), one for each input row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).fill_null("").to_pylist()
        return record(doc_id=batch.column(0), n_chars=pa.array([len(t) for t in texts], pa.int64()), fingerprint=as_text(fingerprints(texts)))

    return id_and_text(docs, id_col, text_col).mapInArrow(lambda batches: (kernel(part) for b in batches for part in sliced(b, most=WALKED)), "doc_id long, n_chars long, fingerprint string")


def band_bits(least: float, recall: float = RECALL) -> int:
    """The most samples a band can have so that a pair of likeness ``least`` shares one of the bands with chance ``recall``."""
    return max([r for r in range(1, SAMPLES + 1) if 1 - (1 - least**r) ** (SAMPLES // r) >= recall], default=1)


def classes(prints: DataFrame) -> DataFrame:
    """Rows of (doc_id, class_id), one for each row of ``fingerprint``: the least doc_id with the same fingerprint; of an empty text its own."""
    first = F.min("doc_id").over(Window.partitionBy("fingerprint"))
    alone = prints.filter("n_chars = 0").select("doc_id", F.col("doc_id").alias("class_id"))
    return prints.filter("n_chars > 0").select("doc_id", first.alias("class_id")).unionByName(alone)


def similar_pairs(prints: DataFrame, least: float = 0.5, bits: int | None = None) -> DataFrame:
    """Links (a, b, near) between documents whose fingerprints' likeness is at least ``least``, from ``fingerprint``'s rows.

    Equal fingerprints are one document here, named by its least doc_id; ``classes`` has the members. Bands of ``bits`` neighbouring
    samples, by default as ``band_bits`` gives, name buckets; bands without any sample name none. Each bucket's members are paired with its least
    member first; then members that are not connected are compared in blocks of bounded size. So each pair that is alike and
    shares a bucket is a link or connected by links, and a bucket gives rows by member, not by pair.
    """
    bits = bits or band_bits(least)
    one = checkpointed(prints.filter("n_chars > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null"))
    width = 2 * bits
    part = f"substring(fingerprint, b * {width} + 1, {width})"
    bands = one.withColumn("key", F.explode(F.expr(f"transform(filter(sequence(0, {SAMPLES // bits - 1}), b -> {part} <> repeat('0', {width})), b -> xxhash64(b, {part}))")))
    heads = bands.groupBy("key").agg(F.min_by(F.struct("doc_id", "fingerprint"), "doc_id").alias("head"), F.count("*").alias("size")).filter("size > 1")
    members = checkpointed(bands.join(heads, "key"))
    pairs = members.filter("doc_id <> head.doc_id").select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("head.fingerprint").alias("x"), F.col("fingerprint").alias("y")).distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (samples(batch.column(k)) for k in (2, 3))
            near = likeness(x, y)
            keep = pa.array(near >= least)
            yield record(a=batch.column(0).filter(keep), b=batch.column(1).filter(keep), near=pa.array(near).filter(keep))

    links = checkpointed(pairs.mapInArrow(check, "a long, b long, near double"))
    label = F.coalesce("least", "doc_id")
    labelled = members.filter("size > 2").join(components(links.select("a", "b")), F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", "fingerprint", "size", label.alias("label"))
    unconnected = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    more = across(labelled.join(unconnected, "key", "left_semi"), least)
    return links.unionByName(more).groupBy("a", "b").agg(F.max("near").alias("near"))


def samples(column: pa.Array) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(column.to_pylist())), np.uint8).reshape(-1, SAMPLES)


def across(members: DataFrame, least: float) -> DataFrame:
    """Links (a, b, near) between members of one bucket with different labels; of each group only as many as join its labels.

    members: (key, doc_id, fingerprint, size, label). A bucket is cut into blocks by hash; each pair of blocks is a group.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.withColumn("own", F.pmod(F.xxhash64("doc_id", "fingerprint"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc_id", "label", "fingerprint")

    def joined(group: pa.Table) -> pa.Table:
        own, ids, labels = (group.column(c).to_numpy() for c in ("own", "doc_id", "label"))
        rows, root, found = samples(group.column("fingerprint")), {}, []

        def find(label: int) -> int:
            while root.get(label, label) != label:
                label = root[label]
            return label

        b_of = np.flatnonzero(own == group.column("y")[0].as_py())
        for k in np.flatnonzero(own == group.column("x")[0].as_py()).tolist():
            near = likeness(rows[k : k + 1], rows[b_of])
            for m in np.flatnonzero((near >= least) & (labels[b_of] != labels[k])).tolist():
                j = int(b_of[m])
                one, two = find(int(labels[k])), find(int(labels[j]))
                if one != two:
                    root[max(one, two)] = min(one, two)
                    found.append((*sorted((int(ids[k]), int(ids[j]))), float(near[m])))
        a, b, near = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "near": pa.array(near, pa.float64())})

    return placed.groupBy("key", "x", "y").applyInArrow(joined, "a long, b long, near double")


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, guest, doc_id, text): every document in its range of doc_ids, and the first of each range as a guest of the one before.

    The first range's is a guest of the last. A bound and a first doc_id for each range is all that is collected or broadcast.
    """
    key = F.coalesce("doc_id", F.lit(int(NO_ID)))
    bounds = docs.select(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else None
    splits = [-float("inf"), *sorted({float(b) for b in bounds or [0]}), float("inf")]
    numbered = Bucketizer(splits=splits, inputCol="key", outputCol="range").transform(docs.withColumn("key", key.cast("double")))
    dealt = numbered.select(F.col("range").cast("int").alias("range"), key.alias("key"), "doc_id", "text")
    firsts = dealt.groupBy("range").agg(F.min("key").alias("first")).orderBy("range").collect()
    guests = [(b["first"], a["range"]) for a, b in zip([*firsts[-1:], *firsts[:-1]], firsts, strict=True)]
    if not firsts:
        return dealt.select("range", F.lit(False).alias("guest"), "doc_id", "text")
    lookup = docs.sparkSession.createDataFrame(guests, "first long, before int")
    own, guest = F.struct("range", F.lit(False).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(True).alias("guest"))
    both = dealt.join(F.broadcast(lookup), F.col("key") == F.col("first"), "left")
    return both.select(F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("to"), "doc_id", "text").select("to.*", "doc_id", "text")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one for each input row.

    The edited text has its last quarter replaced by as many characters of the next document, after the last one the first.
    """
    docs = id_and_text(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES), MOST_RANGES)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # the last row seen, with its samples
        for batch in batches:
            for part in sliced(batch, most=WALKED):
                where, guest, ids = (part.column(k).to_pylist() for k in range(3))
                texts = part.column(3).fill_null("").to_pylist()
                rows += [[*x, None] for x in zip(where, guest, ids, texts, strict=True)]
                yield result(rows)
                rows = rows[-1:]

    def result(rows: list[list]) -> pa.RecordBatch:
        pairs = [k for k in range(len(rows) - 1) if not rows[k][1]]  # in a range, guests come last
        changed = [edited(rows[k][3], rows[k + 1][3]) for k in pairs]
        fresh = [k for k in range(len(rows)) if rows[k][4] is None]
        found = fingerprints([rows[k][3] for k in fresh] + changed)
        for k, samples in zip(fresh, found, strict=False):
            rows[k][4] = samples
        blank = np.zeros((0, SAMPLES), np.uint8)
        own, after = (np.array([rows[k + j][4] for k in pairs], np.uint8) if pairs else blank for j in (0, 1))
        other = found[len(fresh) :]
        return record(
            doc_id=pa.array([rows[k][2] for k in pairs], pa.int64()), n_chars=pa.array([len(rows[k][3]) for k in pairs], pa.int64()),
            edited_sha256=pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            fingerprint=pa.array(as_text(own), pa.string()), edited_fingerprint=pa.array(as_text(other), pa.string()), near_edited=likeness(own, other), near_next=likeness(own, after),
        )

    sorted_rows = in_ranges(docs, ranges).repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "guest", "doc_id", "text")
    return sorted_rows.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


ORACLE_EDITED = """
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select *, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as after, length(text) // 4 as k from d)
select doc_id, length(text) as n_chars, sha256(left(text, length(text) - k) || left(after, k)) as edited_sha256 from n
"""
