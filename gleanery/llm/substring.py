"""Substring dedup by super-k-mers (operator 9).

A window is ``width`` consecutive words of one document. A word goes if a window that covers it starts
earlier too: in a smaller doc_id, or in the same document further left. Windows are judged on the input.

The minimiser of a window is the least hash of its ``m``-word runs. Neighbouring windows that share
it form a super-k-mer, which travels as one packed string, its words joined by spaces, to the bucket
of its minimiser; so equal windows meet. There, windows are sorted by hash, equal hashes are compared
word for word, and all but the first occurrence are marked. Before that, each task drops copies of whole
super-k-mers that it has sent already, marking them at once: of a passage that a third of all
documents share, a task sends few copies.

Memory is bounded in bytes. The number of buckets follows the bytes of the input, for ``BUCKET_BYTES`` packed bytes in
each on average; a first pass over all documents adds up the loads of cells of minimisers, and the windows of cells ``HOT_BYTES`` beyond
the average travel one by one, dealt by the hash of the whole window, so equal ones still meet and no frequent minimiser is one task. A map task
sends what it holds every ``GATHER`` bytes. The list of hot cells has ``MOST_HOT`` entries at most, as the bound rises with the input.

The number of buckets follows the input, and what a task sends at a time does not. So buckets travel together, in ``PARTS`` parts at most: rows and their compression
stay the same at any size, where a row for each bucket gave rows with the square of the input. The receiving task takes a part apart into its buckets,
in a file without a name beyond ``HELD`` bytes, and looks at one bucket at a time.

A document is named by its doc_id. Null doc_ids come last: such a row is named and placed by the hash of its text. Rows of
the same name count as one document's windows: among equal starts none is earlier, and the marks of a name apply to all its rows, so exact copies
of a row all stay or lose the same words. Null and empty texts have no words. Texts under ``width`` words have no window. A very long
text is one slice of its own, never cut. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import checkpointed, id_and_text, record, sliced
from gleanery.llm.words import U, compact, hashes, mixed, run_hashes, sliding_min, spread, window_starts

WIDTH, MINIMISER = 20, 3
#: Bytes of texts and packed strings that a map task gathers before it sends its buckets, and super-k-mers that it knows as repeated.
GATHER, KNOWN = 24 << 20, 20_000
#: Parts in which buckets travel, at most; bytes of a part that the receiving task holds in memory, and of a batch of rows sent.
PARTS, HELD, SENT_BYTES = 512, 32 << 20, 1 << 20
#: Packed bytes of a bucket on average, those beyond which its windows are dealt anew, and such buckets at most.
BUCKET_BYTES, HOT_BYTES, MOST_HOT = 3 << 20, 6 << 20, 1 << 17
#: Cells of minimisers whose loads are added up, at least, and rows of them that a task holds.
CELLS, HELD_CELLS = 4096, 1 << 20
NO_ID, UNNAMED = np.iinfo(np.int64).max, 1 << 40


def super_kmers(texts: list[bytes], width: int, m: int) -> tuple[np.ndarray, ...]:
    """(data, starts, ends, word hashes, text, first, windows, key, content, at) with an entry of the last six for each super-k-mer."""
    data, starts, ends, begins = compact(texts)
    words = hashes(data, starts, ends)
    at = window_starts(begins, width)
    if not len(at):
        none = np.zeros(0, np.int64)
        return data, starts, ends, words, none, none, none, none.astype(U), none.astype(U), none
    runs = run_hashes(words, np.arange(len(words) - m + 1), np.arange(m, len(words) + 1))
    least = sliding_min(runs, width - m + 1)[at]
    text = np.searchsorted(begins, at, side="right") - 1
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    windows = np.diff(np.concatenate([first, [len(at)]]))
    content = run_hashes(words, at[first], at[first] + windows + width - 1)
    return data, starts, ends, words, text[first], at[first] - begins[text[first]], windows, least[first], content, at[first]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(key) % U(buckets)).astype(np.int64)


class Routes:
    """Where windows go: to the bucket of their minimiser, or, where its cell is hot, each by its own hash to one of ``more`` further ones."""

    def __init__(self, buckets: int, cells: int, hot: list[int], more: int) -> None:
        self.buckets, self.cells, self.hot, self.more = buckets, cells, np.array(sorted(hot), np.int64), more
        self.parts = min(PARTS, buckets + (more if hot else 0))

    def dealt(self, found: tuple[np.ndarray, ...], words: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """(text, first, windows, content, at, bucket): the super-k-mers, those of hot buckets as one entry for each window."""
        text, first, windows, key, content, at = found
        bucket = bucket_of(key, self.buckets)
        hot = np.isin(bucket_of(key, self.cells), self.hot)
        if not hot.any():
            return text, first, windows, content, at, bucket
        each = spread(np.zeros(int(hot.sum()), np.int64), windows[hot])  # 0, 1, .. within each of them
        of = np.repeat(np.flatnonzero(hot), windows[hot])
        own = at[of] + each
        one = run_hashes(words, own, own + width)
        parts = ((text, text[of]), (first, first[of] + each), (windows, np.ones(len(of), np.int64)), (content, one), (at, own), (bucket, self.buckets + bucket_of(one, self.more)))
        return tuple(np.concatenate([whole[~hot], new]) for whole, new in parts)


class Sender:
    """Gathers super-k-mers by bucket, and marks those that repeat one sent by this task."""

    def __init__(self, routes: Routes, width: int, m: int) -> None:
        self.routes, self.width, self.m = routes, width, m
        self.known: dict[bytes, tuple[np.uint64, int, int]] = {}
        self.press = zstandard.ZstdCompressor(level=3)
        self.empty()

    def empty(self) -> None:
        self.held, self.size = [], 0

    def take(self, ids: np.ndarray, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """Gather a slice of documents. (document, first, windows) of the super-k-mers known to start earlier elsewhere."""
        data, starts, ends, words, *found = super_kmers(texts, self.width, self.m)
        if not len(found[0]):
            return []
        text, first, windows, content, at, bucket = self.routes.dealt(tuple(found), words, self.width)
        raw, doc = data.tobytes(), ids[text]
        low, high = starts[at], ends[at + windows + self.width - 2]
        order = np.lexsort((first, doc, content))
        same = np.concatenate([[False], content[order][1:] == content[order][:-1]])
        keep, marks = np.ones(len(text), bool), []
        if same.any() or self.known:
            self.drop_copies(order, same, raw, low, high, doc, first, windows, content, keep, marks)
        if keep.any():
            self.held.append((bucket[keep], doc[keep], first[keep], windows[keep], low[keep], high[keep], raw))
            self.size += len(raw) + int((high - low)[keep].sum()) + 16 * int(keep.sum())
        return marks

    def drop_copies(self, order, same, raw, low, high, doc, first, windows, content, keep, marks) -> None:
        again = np.isin(content, np.array([x[0] for x in self.known.values()], np.uint64))
        group = np.cumsum(~same) - 1
        repeated = np.bincount(group, minlength=0)[group] > 1
        heads: dict[bytes, int] = {}
        for k in order[repeated | again[order]].tolist():  # by (doc_id, start) among equal contents
            packed = raw[low[k] : high[k]]
            here = (int(doc[k]), int(first[k]))
            known = self.known.get(packed)
            if packed in heads:
                keep[k] = False
                if here > (int(doc[heads[packed]]), int(first[heads[packed]])):
                    marks.append((*here, int(windows[k])))
                continue
            heads[packed] = k
            if known is not None and known[1:] <= here:
                keep[k] = False
                if known[1:] < here:
                    marks.append((*here, int(windows[k])))
            elif len(self.known) < KNOWN or known is not None:
                self.known[packed] = (content[k], *here)

    def send(self) -> Iterator[tuple[int, bytes]]:
        """(part, blob) of what is held. A blob has its number of buckets, then bucket, super-k-mers and bytes of each, then all their numbers and words."""
        if not self.held:
            return
        *columns, raws = zip(*self.held, strict=True)
        of = np.repeat(np.arange(len(raws)), [len(x) for x in columns[0]])
        bucket, doc, first, windows, low, high = (np.concatenate(x) for x in columns)
        self.empty()
        order = np.lexsort((bucket, bucket % self.routes.parts))
        of, bucket, doc, first, windows, low, high = (x[order] for x in (of, bucket, doc, first, windows, low, high))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket % self.routes.parts)) + 1, [len(bucket)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            packed = b" ".join([raws[i][x:y] for i, x, y in zip(of[a:b].tolist(), low[a:b].tolist(), high[a:b].tolist(), strict=True)])
            at = np.concatenate([[a], np.flatnonzero(np.diff(bucket[a:b])) + a + 1])
            heads = np.stack([bucket[at], np.diff(np.concatenate([at, [b]])), np.add.reduceat(high[a:b] - low[a:b] + 1, at - a)], 1)
            numbers = doc[a:b].tobytes(), first[a:b].astype("<i4").tobytes(), windows[a:b].astype("<i4").tobytes()
            yield int(bucket[a] % self.routes.parts), self.press.compress(b"".join([np.int64(len(at)).tobytes(), heads.astype("<i8").tobytes(), *numbers, packed]))


#: Of super-k-mers in one bucket: doc_ids, first windows and numbers of windows as bytes, and their words, joined by spaces.
Piece = tuple[bytes, bytes, bytes, bytes]


def pieces(blob: bytes) -> Iterator[tuple[int, Piece]]:
    """(bucket, piece) of each bucket in a blob."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    heads = np.frombuffer(raw, "<i8", 3 * k, 8).reshape(k, 3)
    n = int(heads[:, 1].sum())
    docs = 8 + 24 * k
    firsts, windows, packed = docs + 8 * n, docs + 12 * n, docs + 16 * n
    for bucket, own, size in heads.tolist():
        yield bucket, (raw[docs : docs + 8 * own], raw[firsts : firsts + 4 * own], raw[windows : windows + 4 * own], raw[packed : packed + size - 1])
        docs, firsts, windows, packed = docs + 8 * own, firsts + 4 * own, windows + 4 * own, packed + size


def joined(own: list[Piece]) -> Piece:
    doc, first, windows, packed = zip(*own, strict=True)
    return b"".join(doc), b"".join(first), b"".join(windows), b" ".join(packed)


def by_bucket(blobs: Iterable[bytes]) -> Iterator[list[Piece]]:
    """What a part's blobs hold, one bucket at a time. Beyond ``HELD`` bytes it waits in a file that goes with the task."""
    held, size = defaultdict(list), 0
    places: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    with tempfile.TemporaryFile() as file:
        for blob in blobs:
            for bucket, piece in pieces(blob):
                held[bucket].append(piece)
                size += sum(map(len, piece))
            if size > HELD:
                for bucket, own in held.items():
                    places[bucket].append((file.tell(), list(map(len, whole := joined(own)))))
                    file.writelines(whole)
                held, size = defaultdict(list), 0
        for bucket in sorted(held.keys() | places.keys()):
            found = held.pop(bucket, [])
            for place, lengths in places.pop(bucket, []):
                file.seek(place)
                found.append(tuple(map(file.read, lengths)))
            yield found


def repeats(own: list[Piece], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, low, high): word ranges of the windows in one bucket that start earlier elsewhere."""
    *numbers, raw = joined(own)
    doc, first, windows = (np.frombuffer(x, kind).astype(np.int64) for x, kind in zip(numbers, ("<i8", "<i4", "<i4"), strict=True))
    data = np.frombuffer(raw, np.uint8)
    space = data == 32
    starts = np.concatenate([[0], np.flatnonzero(space) + 1])
    ends = np.concatenate([starts[1:] - 1, [len(data)]])
    words = hashes(data, starts, ends)
    begin = np.cumsum(windows + width - 1) - (windows + width - 1)
    at = np.arange(windows.sum()) + np.repeat(begin - (np.cumsum(windows) - windows), windows)
    which = np.repeat(np.arange(len(windows)), windows)
    where = first[which] + at - begin[which]
    content = run_hashes(words, at, at + width)
    order = np.argsort(content, kind="stable")
    ranked = content[order]
    equal = ranked[1:] == ranked[:-1]
    shared = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
    order = order[shared]
    order = order[np.lexsort((where[order], doc[which[order]], content[order]))]
    late = np.zeros(len(at), bool)
    head, first_of = None, (0, 0)
    same = np.concatenate([np.zeros(min(1, len(order)), bool), content[order][1:] == content[order][:-1]])
    lows, highs = starts[at[order]].tolist(), ends[at[order] + width - 1].tolist()
    others: dict[bytes, tuple[int, int]] = {}
    docs, wheres = doc[which[order]].tolist(), where[order].tolist()
    for k, (low, high, again) in enumerate(zip(lows, highs, same.tolist(), strict=True)):
        text, here = raw[low:high], (docs[k], wheres[k])
        if not again:
            head, first_of, others = text, here, {}
        elif text == head:
            late[order[k]] = here > first_of
        else:  # another text of the same hash
            late[order[k]] = here > others.setdefault(text, here)
    found = np.flatnonzero(late)
    if not len(found):
        none = np.zeros(0, np.int64)
        return none, none, none
    new = np.concatenate([[True], (found[1:] != found[:-1] + 1) | (which[found[1:]] != which[found[:-1]])])
    head = found[new]
    length = np.diff(np.concatenate([np.flatnonzero(new), [len(found)]]))
    return doc[which[head]], where[head], where[head] + length + width - 1


def routes_of(docs: DataFrame, width: int, m: int) -> Routes:
    """Buckets by the input's bytes, and the hot cells of minimisers, from the loads of all documents."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = 1 + (width - 1) * 2 / (width - m + 2)  # words sent for each word, on average
    buckets = int(max(1, np.ceil(size * share / BUCKET_BYTES)))
    cells = max(CELLS, buckets // 4)

    def added(rows: np.ndarray) -> np.ndarray:
        cell, which = np.unique(rows[0], return_inverse=True)
        return np.stack([cell, np.bincount(which, weights=rows[1], minlength=len(cell)).astype(np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)
        for batch in batches:
            for part in sliced(batch):
                _, starts, ends, _, _, _, windows, key, content, at = super_kmers([t.encode() for t in part.column(0).fill_null("").to_pylist()], width, m)
                one = np.unique(content, return_index=True)[1]  # copies within a slice are dropped before they are sent
                held = added(np.concatenate([held, [bucket_of(key[one], cells), (ends[at + windows + width - 2] - starts[at])[one]]], 1))
                if held.shape[1] > HELD_CELLS:
                    yield record(cell=held[0], load=held[1])
                    held = held[:, :0]
        yield record(cell=held[0], load=held[1])

    loads = docs.select("text").mapInArrow(run, "cell long, load long").groupBy("cell").agg(F.sum("load").alias("load"))
    loads = checkpointed(loads)
    total = loads.agg(F.sum("load")).first()[0] or 0
    hot = loads.filter(F.col("load") > max(HOT_BYTES + total // cells, total // MOST_HOT)).collect()  # MOST_HOT rows at most
    return Routes(buckets, cells, [r["cell"] for r in hot], int(np.ceil(sum(r["load"] for r in hot) * width / share / BUCKET_BYTES)) or 1)


def removed_ranges(docs: DataFrame, width: int = WIDTH, m: int = MINIMISER) -> DataFrame:
    """Rows of (document, ranges) for rows of (document, text): word ranges [low, high) that go, which may overlap."""
    routes = docs.sparkSession.sparkContext.broadcast(routes_of(docs, width, m))
    parts = routes.value.parts

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(routes.value, width, m)
        for batch in batches:
            for part in sliced(batch):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                marks = sender.take(ids, [t.encode() for t in part.column(1).fill_null("").to_pylist()])
                if marks:
                    d, f, n = (np.array(x, np.int64) for x in zip(*marks, strict=True))
                    yield record(part=mark_part(d, f), blob=pa.nulls(len(d), pa.binary()), doc=d, low=f, high=f + n + width - 1)
                if sender.size > GATHER:
                    yield from sent(sender)
        yield from sent(sender)

    def mark_part(doc: np.ndarray, low: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return bucket_of(doc.astype(U) * U(0x9E3779B97F4A7C15) + low.astype(U), parts)

    def sent(sender: Sender) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in sender.send():
            rows.append(row)
            size += len(row[1])
            if size > SENT_BYTES:
                yield of(rows)
                rows, size = [], 0
        if rows:
            yield of(rows)

    def of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        part, blob = zip(*rows, strict=True)
        return record(part=pa.array(part, pa.int64()), blob=pa.array(blob, pa.binary()), **{c: pa.nulls(len(rows), pa.int64()) for c in ("doc", "low", "high")})

    def count(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = []

        def blobs() -> Iterator[bytes]:
            for batch in part:
                known = batch.filter(batch.column("doc").is_valid())
                if known.num_rows:
                    marked.append(ranges(*(known.column(c).to_numpy() for c in ("doc", "low", "high"))))
                for blob in batch.column("blob").drop_null():
                    yield blob.as_py()

        for own in by_bucket(blobs()):
            found = repeats(own, width)
            if len(found[0]):
                yield ranges(*found)
        yield from marked

    def ranges(*columns: np.ndarray) -> pa.RecordBatch:
        doc, low, high = np.unique(np.stack(columns, 1), axis=0).T
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        flat = np.stack([low, high], 1).ravel().astype(np.int32)
        offsets = pa.array(np.concatenate([2 * cuts, [2 * len(doc)]]).astype(np.int32))
        return record(document=pa.array(doc[cuts], pa.int64()), flat=pa.ListArray.from_arrays(offsets, pa.array(flat)))

    sent_rows = docs.mapInArrow(split, "part long, blob binary, doc long, low long, high long")
    found = sent_rows.groupBy("part").applyInArrow(count, "document long, flat array<int>")
    return found.groupBy("document").agg(F.flatten(F.collect_list("flat")).alias("ranges"))


def kept_words(text: bytes, ranges: list[int] | None) -> tuple[int, int, bytes]:
    words = text.split()
    if not ranges:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    pairs = np.array(ranges, np.int64).reshape(-1, 2)
    pairs = pairs[pairs[:, 1] <= len(words)]
    np.add.at(gone, pairs[:, 0], 1)
    np.add.at(gone, pairs[:, 1], -1)
    stay = np.cumsum(gone[:-1]) == 0
    return len(words), int(len(words) - stay.sum()), b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s])


def with_ranges(docs: DataFrame, width: int = WIDTH, m: int = MINIMISER) -> DataFrame:
    """``docs`` (doc_id, text, ..) with the column ``ranges``; the rows of a document all get its ranges."""
    name = F.coalesce("doc_id", F.lit(int(NO_ID)) - F.pmod(F.xxhash64("text"), F.lit(UNNAMED)))
    found = removed_ranges(docs.select(name.alias("document"), "text"), width, m)
    return docs.join(found, name == F.col("document"), "left").drop("document")


def dedup_substrings(docs: DataFrame, width: int = WIDTH, m: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Rows of (doc_id, n_words, n_removed, kept), the kept words joined by one space; with ``digest`` kept_sha256 instead."""
    last = "kept_sha256" if digest else "kept"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                rows = [kept_words((t or "").encode(), r) for t, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                n, gone, kept = zip(*rows, strict=True)
                out = [hashlib.sha256(k).hexdigest() if digest else k.decode() for k in kept]
                yield record(doc_id=part.column(0), n_words=pa.array(n, pa.int64()), n_removed=pa.array(gone, pa.int64()), **{last: pa.array(out, pa.string())})

    return with_ranges(id_and_text(docs, id_col, text_col), width, m).select("doc_id", "text", "ranges").mapInArrow(apply, f"doc_id long, n_words long, n_removed long, {last} string")


def without_repeats(docs: DataFrame, width: int = WIDTH, m: int = MINIMISER) -> DataFrame:
    """``docs`` with the removed words gone from ``text``; a text that loses none stays as it is, with its white space."""
    names = [c for c in docs.columns if c != "text"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                texts, ranges = part.column(0).to_pylist(), part.column(1).to_pylist()
                out = [kept_words((t or "").encode(), r)[2].decode() if r else t for t, r in zip(texts, ranges, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *part.columns[2:]], names=["text", *names])

    rows = with_ranges(docs, width, m).select("text", "ranges", *names)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    return rows.mapInArrow(apply, ", ".join(f"`{n}` {fields[n]}" for n in ["text", *names])).select(*docs.columns)


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
u as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
g as (select *, count(*) over f as n, string_agg(w, ' ') over f as g from u window f as (partition by doc_id order by i rows between current row and 19 following)),
s as (select doc_id, w, i, n = 20 and row_number() over (partition by n = 20, g order by doc_id, i) > 1 as late from g),
c as (select *, max(late::int) over (partition by doc_id order by i rows between 19 preceding and current row) as gone from s),
k as (select doc_id, count(*) as n_words, sum(gone)::bigint as n_removed, sha256(coalesce(string_agg(w, ' ' order by i) filter (gone = 0), '')) as kept_sha256 from c group by doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256 from d left join k using (doc_id)
"""
