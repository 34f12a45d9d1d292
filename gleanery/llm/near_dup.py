"""Near-duplicate documents by SetSketch registers (operator 1).

A document's set holds its distinct 5-word shingles, A-Z lower-cased; with fewer words, the whole
sequence as one. Documents whose sets have a similarity of 0.75 or more are linked.

Sketch: ``REGISTERS`` minima of exponential hash values, each as its exponent to the base ``B``, cut to
a byte. Such registers merge by maximum, and two sets agree in one about as often as their
similarity. Texts of the same words, by SHA-256, are one class from here on. Bands of four registers name buckets; a pair of
similarity 0.75 shares none of the 32 once in 200,000 times, one of 0.8 once in 20 million.

Candidates: each bucket's members are first paired with its least member only, so a bucket of any size
costs a row a member. A pair passes if the joint likelihood of its registers, given both set sizes, does
not rule out 0.75. Passing pairs are verified on their full sets: a pivot's text travels once for each ``PART`` members, not with each pair, and the
members' texts stream past it. Then, in buckets whose members
are not yet of one component, the members are compared across components in blocks bounded in rows and in words:
by registers first, then on their shingle hashes in numpy, and each link that joins two components on the full sets. So every pair that shares a bucket is
tested, unless it is connected anyway, and no pass makes a row for each pair of a group.

Null, empty and blank texts have no set and are linked with nothing. doc_id names a document; rows of one doc_id are one document, linked by what any of
its texts links. Rows without a doc_id are named by a hash of their text beyond all doc_ids (which are below 2^62): they link
like others, but give a component its id, null, only where it has no other. Ties of registers count as equal registers. A very long text
is a slice or a block of its own, never cut. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import checkpointed, id_and_text, map_texts, quoted, record, sliced
from gleanery.llm.components import components
from gleanery.llm.words import BYTE_VALUES, LOWER, U, compact, hashes, mixed, run_hashes, window_starts

WIDTH = 5
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
B, LARGEST = 1.08, 20.0  # base of the registers; an exponential value above which a register is 0
#: Log-likelihood by which 0.75 may fall short of the best similarity before a pair is ruled out: over five standard deviations.
SLACK = 15.0
#: Rows and shingles of a block of a bucket, and members of a bucket that meet its pivot in one place.
BLOCK, BLOCK_SHINGLES, PART = 512, 150_000, 5000
UNNAMED = 1 << 62
_rng = np.random.default_rng(71)
FACTORS = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) | U(1)
SHIFTS = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64)
GRID = np.linspace(0.0, 1.0, 81)


def shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, begins): the distinct shingle hashes of each text, and where each text's begin."""
    data, starts, ends, begins = compact(texts)
    words = hashes(data, starts, ends, BYTE_VALUES[LOWER])
    n = np.diff(begins)
    at = window_starts(begins, width)
    short = np.flatnonzero((n > 0) & (n < width))
    value = np.concatenate([run_hashes(words, at, at + width), run_hashes(words, begins[short], begins[short + 1])])
    text = np.concatenate([np.searchsorted(begins, at, side="right") - 1, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def registers(value: np.ndarray, begins: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """A row of registers for each text; the texts must not be empty."""
    out = np.empty((len(begins) - 1, REGISTERS), np.uint8)
    at = 0
    while at < len(out):
        upto = max(at + 1, int(np.searchsorted(begins, begins[at] + block, side="right")) - 1)
        own, cuts = value[begins[at] : begins[upto]], begins[at:upto] - begins[at]
        least = np.empty((REGISTERS, upto - at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(REGISTERS):
                least[k] = np.minimum.reduceat(own * FACTORS[k] + SHIFTS[k], cuts)
        exponential = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64)
        level = np.floor(1 - np.log(np.maximum(exponential, 1e-30) / LARGEST) / np.log(B))
        out[at:upto] = np.clip(level, 0, 255).T.astype(np.uint8)
        at = upto
    return out


def named(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) with ``node``: the doc_id, or without one a number beyond all doc_ids by the text's hash."""
    return docs.withColumn("node", F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED))))


def sketched(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, doc_id, n_shingles, digest, registers) of rows (node, doc_id, text): set size, SHA-256 of the words and registers; nulls for no set."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        value, begins = shingles(texts, width)
        n = np.diff(begins)
        full = np.flatnonzero(n)
        rows = registers(value, np.concatenate([begins[full], [len(value)]])) if len(full) else np.zeros((0, REGISTERS), np.uint8)
        packed, digest = ([None] * len(n) for _ in range(2))
        for k, row in zip(full.tolist(), rows, strict=True):
            packed[k], digest[k] = row.tobytes(), hashlib.sha256(b" ".join(texts[k].lower().split())).digest()  # bytes.lower changes A-Z only
        return record(node=batch.column(0), doc_id=batch.column(1), n_shingles=n.astype(np.int64), digest=pa.array(digest, pa.binary()), registers=pa.array(packed, pa.binary()))

    return map_texts(docs.select("node", "doc_id", "text"), kernel, "node long, doc_id long, n_shingles long, digest binary, registers binary")


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row of registers."""
    parts = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    packed = np.zeros((len(rows), BANDS), np.uint64)
    for k in range(ROWS):
        packed = (packed << U(8)) | parts[:, :, k]
    return mixed(packed | (np.arange(BANDS, dtype=np.uint64) << U(8 * ROWS))).view(np.int64)


def may_reach(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Whether a similarity of ``percent`` isn't ruled out by the joint likelihood of two rows of registers and the set sizes."""
    more, fewer = (left > right).sum(1), (left < right).sum(1)
    same = left.shape[1] - more - fewer
    u, v = n_left / (n_left + n_right), n_right / (n_left + n_right)
    sizes_fit = 100 * np.minimum(n_left, n_right) >= percent * np.maximum(n_left, n_right)
    top = np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = chance(u - v * j), chance(v - u * j)
        tiny = 1e-12
        return more * np.log(np.maximum(p, tiny)) + fewer * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))

    best, enough = np.full(len(u), -np.inf), np.full(len(u), -np.inf)
    for share in GRID:
        best = np.maximum(best, likelihood(share * top))
    least = percent / 100
    for share in np.linspace(0, 1, 21):
        enough = np.maximum(enough, likelihood(np.minimum(top, least + share * np.maximum(top - least, 0))))
    return sizes_fit & (best - enough <= SLACK)


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def passing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, part, b), those that the registers do not rule out. A pivot ``a`` meets each part of its members in a place of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                x = batch.slice(at, 8192)
                n = [x.column(k).to_numpy().astype(np.float64) for k in (3, 4)]
                keep = pa.array(may_reach(matrix(x.column(5)), matrix(x.column(6)), *n, percent))
                yield record(**{c: x.column(k).filter(keep) for k, c in enumerate(("a", "part", "b"))})

    one = lambda side: sets.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("registers").alias(f"registers_{side}"))
    pivots = pairs.select("a", "part").distinct().join(one("a"), "a")
    both = pairs.join(one("b"), "b").join(pivots, ["a", "part"])
    return both.select("a", "part", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(run, "a long, part int, b long")


def shingle_set(text: str, width: int) -> set:
    words = text.encode().lower().split()
    return set(zip(*[words[k:] for k in range(width)], strict=False)) if len(words) >= width else {tuple(words)}


def alike(one: set, two: set, percent: int) -> bool:
    common = len(one & two)
    return 100 * common >= percent * (len(one) + len(two) - common)


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the distinct ``nodes`` (node)."""
    return docs.filter("text is not null").join(nodes, "node", "left_semi").select("node", "text")


def verified(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Of pairs (a, part, b), those whose full sets have a similarity of ``percent`` or more, as (a, b)."""
    pairs = checkpointed(pairs)
    pivots = pairs.select("a", "part").distinct()
    texts = checkpointed(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs))
    first = pivots.join(texts, pivots["a"] == texts["node"]).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    then = pairs.join(texts, pairs["b"] == texts["node"]).select("a", "part", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []  # the place, and the sets of its pivot, which comes before its members
        for batch in batches:
            for x in sliced(batch, "text"):
                found = []
                for a, part, b, text in zip(*(c.to_pylist() for c in x.columns), strict=True):
                    one = shingle_set(text, width)
                    if b is None:
                        at, own = (a, part), [*own, one] if at == (a, part) else [one]
                    elif any(alike(one, other, percent) for other in own):
                        found.append((a, b))
                a, b = zip(*found, strict=True) if found else ((), ())
                yield record(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    both = first.unionByName(then).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return checkpointed(both.mapInArrow(run, "a long, b long").distinct())


def across(members: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) between members of one bucket with different labels; of each group only as many as join its labels.

    members: (key, node, label, n_shingles, registers, size, shingles), the last two of the bucket. A bucket is cut into blocks by hash, and each pair of
    blocks is a group of at most about 2 * BLOCK rows and 2 * BLOCK_SHINGLES shingles, whatever the bucket's size. A first pass by registers
    keeps the members that have a pair not ruled out; a second one compares their full sets. Both give rows by member, not by pair.
    """
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.least(F.col("shingles") / BLOCK_SHINGLES, F.col("size")))).cast("int")
    placed = members.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "label", "n_shingles", "registers")
    share = percent / 100
    least_same = int(REGISTERS * share - 7 * np.sqrt(REGISTERS * share * (1 - share)))  # seven standard deviations below

    def likely(group: pa.Table) -> pa.Table:
        key = int(group.column("key")[0].as_py())
        own, ids, labels, n = (group.column(c).to_numpy() for c in ("own", "node", "label", "n_shingles"))
        rows = matrix(group.column("registers").combine_chunks())
        keys = band_keys(rows)
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        a_of, b_of = np.flatnonzero(own == x), np.flatnonzero(own == y)
        found = np.zeros(len(ids), bool)
        for at in range(0, len(a_of), 64):
            some = a_of[at : at + 64]
            same = (rows[some][:, None, :] == rows[b_of][None, :, :]).sum(2)
            a, b = np.nonzero(same >= least_same)
            a, b = some[a], b_of[b]
            fits = (labels[a] != labels[b]) & ((ids[b] > ids[a]) | (x != y)) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            a, b = a[fits], b[fits]
            fits = keys[b, (keys[a] == keys[b]).argmax(1)] == key  # else another bucket of both has the pair
            a, b = a[fits], b[fits]
            for k in range(0, len(a), 8192):
                i, j = a[k : k + 8192], b[k : k + 8192]
                fits = may_reach(rows[i], rows[j], n[i].astype(float), n[j].astype(float), percent)
                found[i[fits]] = found[j[fits]] = True
        return group.select(["key", "x", "y", "own", "node", "label"]).filter(pa.array(found))

    kind = "key long, x int, y int, own int, node long, label long"
    left = checkpointed(placed.groupBy("key", "x", "y").applyInArrow(likely, kind))
    texts = texts_of(left.select("node").distinct(), docs)

    def exact(group: pa.Table) -> pa.Table:
        own, ids, labels = (group.column(c).to_numpy() for c in ("own", "node", "label"))
        texts = group.column("text").to_pylist()
        value, begins = shingles([t.encode() for t in texts], width)
        _, value = np.unique(value, return_inverse=True)
        n, root = np.diff(begins), {}

        def find(label: int) -> int:
            while root.get(label, label) != label:
                label = root[label]
            return label

        found = []
        for k in np.flatnonzero(own == group.column("x")[0].as_py()).tolist():
            mark = np.zeros(len(value) + 1, bool)
            mark[value[begins[k] : begins[k + 1]]] = True
            hits = np.concatenate([[0], np.cumsum(mark[value])])
            common, full = hits[begins[1:]] - hits[begins[:-1]], None
            for j in np.flatnonzero((100 * common >= percent * (n + n[k] - common)) & (labels != labels[k]) & (common > 0)).tolist():
                one, two = find(int(labels[k])), find(int(labels[j]))
                if one == two:
                    continue
                full = full or shingle_set(texts[k], width)
                if alike(full, shingle_set(texts[j], width), percent):
                    root[max(one, two)] = min(one, two)
                    found.append((int(ids[k]), int(ids[j])))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.join(texts, "node").groupBy("key", "x", "y").applyInArrow(exact, "a long, b long").distinct()


def labelled(docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """Rows of (node, doc_id, n_shingles, least) for rows (node, doc_id, text): the least node of each one's component."""
    every = checkpointed(sketched(docs, width))
    least = F.min_by(F.struct("node", "n_shingles", "registers"), "node").alias("one")
    classes = checkpointed(every.filter("n_shingles > 0").groupBy("digest").agg(least).select("digest", "one.*"))
    sets = classes.select("node", "n_shingles", "registers")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(matrix(batch.column(2)))
            flat, offsets = pa.array(keys.ravel()), pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            yield record(node=batch.column(0), n=batch.column(1), keys=pa.ListArray.from_arrays(offsets, flat))

    bands = sets.mapInArrow(keyed, "node long, n long, keys array<long>").select("node", "n", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("size"), F.sum("n").alias("shingles")).filter("size > 1")
    members = checkpointed(bands.join(shared, "key").select("key", "node", "pivot", "size", "shingles"))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.max("size") / PART)).cast("int").alias("part")
    stars = members.filter("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(part).select("a", "part", "b")
    links = verified(passing(stars, sets, percent), docs, percent, width)
    found = checkpointed(components(links))
    label = F.coalesce("least", "m.node").alias("label")
    open_members = members.filter("size > 2").alias("m").join(found.alias("f"), F.col("m.node") == F.col("f.node"), "left").select("key", "m.node", label, "size", "shingles")
    open_keys = open_members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    open_members = open_members.join(open_keys, "key", "left_semi").join(sets, "node")
    more = checkpointed(across(open_members, docs, percent, width))
    if not more.isEmpty():
        found = checkpointed(components(links.unionByName(more)))
    roots = classes.alias("c").join(found.alias("f"), F.col("c.node") == F.col("f.node"), "left").select(F.col("digest").alias("own"), F.coalesce("least", "c.node").alias("least"))
    return every.join(roots, F.col("digest") == F.col("own"), "left").select("node", "doc_id", "n_shingles", F.coalesce("least", "node").alias("least"))


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, n_shingles, component_id, kept), one for each input row."""
    rows = labelled(named(id_and_text(docs, id_col, text_col)), percent, width)
    return rows.select("doc_id", "n_shingles", F.when(F.col("least") < UNNAMED, F.col("least")).alias("component_id"), (F.col("node") == F.col("least")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 75, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are the least of their component; rows without a set all stay."""
    rows = named(id_and_text(docs, id_col, text_col))
    kept = labelled(rows, percent, width).filter("node = least").select("node").distinct()
    text = F.col(quoted(text_col)).cast("string")
    own = F.coalesce(F.col(quoted(id_col)).cast("long"), F.xxhash64(text).bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED)))
    return docs.join(kept.withColumnRenamed("node", "kept_node"), own == F.col("kept_node"), "left_semi")


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
u as (select doc_id, len(ws) as n, unnest(ws) as w, generate_subscripts(ws, 1) as i from w),
g as (select doc_id, n, i, count(*) over f as c, string_agg(w, ' ') over f as g from u window f as (partition by doc_id order by i rows between current row and 4 following)),
s as (select distinct doc_id, g from g where c = 5 or (n < 5 and i = 1)),
z as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join z x on x.doc_id = a join z y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as o from documents union select r.doc_id, e.b from r join e on r.o = e.a)
select d.doc_id, coalesce(any_value(z.n), 0)::bigint as n_shingles, min(r.o) as component_id, d.doc_id = min(r.o) as kept
from documents d join r using (doc_id) left join z using (doc_id) group by d.doc_id
"""
