"""Exact byte-pair token counts and ids by prefix tables: operators 5 and 10.

For merge-type vocabularies the encoding of every prefix of a text ends in one unique token. The
table of these last tokens is filled from left to right: an automaton, a trie stepped
from all starts at once, lists the pieces that end at a position, and a piece is the last token of the prefix exactly if the last token of what stands before
it and the piece form a compatible pair, that is, if merging their joined characters gives back the
two. The ids follow from the table backwards; with ``count[i] = count[i - length] + 1`` the same pass
holds the exact token count at every prefix.

No piece spans a character and a following space mark, which is checked when the model is loaded, so
merges never cross that border: a text is the chain of its space-led segments, and each distinct
segment of a slice is worked out once, all of them side by side. A model without that property has one segment a text.

Nulls are empty texts. A very long text is a slice of its own, never cut. Equal texts, so repeated rows, get equal ids; equal scores merge leftmost first,
as in the library. An empty table gives an empty result. Other columns are ignored. Begin and end ids are added in ``encode`` only.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.common import id_and_text, map_texts, record
from gleanery.llm.words import spread

SPACE_MARK = "▁"
#: Tested pairs that a worker keeps; beyond it they are tested anew.
MOST_PAIRS = 2_000_000
#: Distinct segments that a worker remembers, about 200 bytes each.
MOST_SEGMENTS = 400_000
TOKEN_LIMIT = 4096
#: Texts on which a model's ids must be the library's: white space, case, compatibility characters, combining marks, marks of its own.
PROBES = ["", " ", "a", "  two  spaces ", "The cat's 12,345 hats.\n\tEnd", "ﬁne ① Ａ", "e\u0301 é", "漢字 😀 x", "▁ a▁b", "\u200b\u00a0x", "straße İstanbul"]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class HashTable:
    """Open-addressed map from non-negative 64-bit keys to integers, looked up a whole array at a time."""

    def __init__(self, bits: int = 12) -> None:
        self.n, self.bits = 0, bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are distinct and not there yet."""
        self.n += len(keys)
        if 3 * self.n > len(self.keys):
            old, held = self.keys, self.values
            self.bits = max(self.bits, (4 * self.n).bit_length())
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
            self.place(old[old >= 0], held[old >= 0])
        self.place(keys, values)

    def place(self, keys: np.ndarray, values: np.ndarray) -> None:
        at, mask = self.slots(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it is not there."""
        at, mask = self.slots(keys), len(self.keys) - 1
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            found = self.keys[at[left]]
            same = found == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (found >= 0)]
        return out


class Model:
    """Pieces and scores of a merge-type SentencePiece model with an identity normaliser, built once on the driver and broadcast.

    Any other model, which would give other ids than the library, is an error: ``PROBES`` must come out alike.
    """

    def __init__(self, proto: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=proto)
        n = sp.vocab_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if i not in self.special and not sp.is_byte(i)]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score_of = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.bytes_of = [p.replace(SPACE_MARK, " ").encode() for p in self.pieces]
        for byte, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([byte])
        for i in self.special:
            self.bytes_of[i] = b""
        self.bytes_of[self.unk] = " ⁇ ".encode()
        self.byte_at = np.concatenate([[0], np.cumsum([len(x) for x in self.bytes_of])])
        self.byte_flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.split = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.id_of)
        self.spines: dict[int, tuple[list, list]] = {}
        self.pairs = HashTable()
        self.steps, self.token_at = self.trie()
        self.stores: dict[bool, Store] = {}
        for text in PROBES:
            if Codec(self).encode([text])[0].tolist() != sp.encode(text):
                raise ValueError("this model is not of the merge type with an identity normaliser: its ids differ on " + repr(text))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "stores": {}}

    def store(self, with_ids: bool) -> Store:
        return self.stores.setdefault(with_ids, Store(self, with_ids))

    def trie(self) -> tuple[HashTable, np.ndarray]:
        """Steps from (node, character) to a node, and the piece that ends at each node, or -1."""
        steps: dict[int, int] = {}
        ends = [-1]
        for piece, i in self.id_of.items():
            node = 0
            for c in piece:
                node = steps.setdefault((node << 21) | ord(c), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i if len(piece) == 1 or self.merged(piece)[0] == [piece] else -1
        table = HashTable()
        table.put(np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int32, len(steps)))
        return table, np.array(ends, np.int32)

    def merged(self, text: str) -> tuple[list[str], list[str], list[str]]:
        """Merge adjacent symbols of a short string, best score first and leftmost among equals.

        Also the first symbols and the last symbols that stood at its two ends, in order of time.
        """
        symbols, score = list(text), self.score_of
        firsts, lasts = symbols[:1], symbols[-1:]
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            if at == 0:
                firsts.append(symbols[0])
            if at == len(symbols) - 1:
                lasts.append(symbols[-1])
        return symbols, firsts, lasts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces gives back the two.

        It does unless, at some moment, the symbol then last in the left piece and the one then first in
        the right piece form a piece that outranks the next merge of either; the left one goes first among equals.
        """
        a, b = self.pieces[left], self.pieces[right]
        if a[-1] == b[0] == SPACE_MARK:
            return self.merged(a + b)[0] == [a, b]
        lasts, firsts = self.spine(left)[1], self.spine(right)[0]
        score, x, y = self.score_of, 0, 0
        while True:
            s = score.get(lasts[x][0] + firsts[y][0])
            ends_x, ends_y = lasts[x][1], firsts[y][1]
            if s is not None and s > ends_x and s >= ends_y:
                return False
            if x == len(lasts) - 1 and y == len(firsts) - 1:
                return True
            if y == len(firsts) - 1 or x < len(lasts) - 1 and ends_x >= ends_y:
                x += 1
            else:
                y += 1

    def spine(self, token: int) -> tuple[list, list]:
        """(symbol, score of the merge that ends it) for the first and for the last symbols of a piece in time."""
        known = self.spines.get(token)
        if known is None:
            _, firsts, lasts = self.merged(self.pieces[token])
            known = self.spines[token] = tuple([(s, self.score_of[t]) for s, t in zip(e, e[1:])] + [(e[-1], -np.inf)] for e in (firsts, lasts))
        return known

    def compatible_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        found = self.pairs.get(keys)
        if (found < 0).any():
            if self.pairs.n > MOST_PAIRS:
                self.pairs = HashTable()
                keys_new = np.unique(keys)
            else:
                keys_new = np.unique(keys[found < 0])
            self.pairs.put(keys_new, np.array([self.compatible(int(k >> 32), int(k & 0xFFFFFFFF)) for k in keys_new], np.int32))
            found = self.pairs.get(keys)
        return found == 1

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        return SEGMENT.findall(marked) if self.split else [marked]


class Tables:
    """Prefix tables of many segments, filled together: last token and exact count at every prefix.

    ``start[k]`` is where segment k begins; position ``start[k] + k + i`` stands for its prefix of i
    characters. Ids at or above ``len(pieces)`` are single characters outside the vocabulary.
    """

    def __init__(self, model: Model, segments: list[str]) -> None:
        self.model = model
        chars = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4").astype(np.int64)
        self.lengths = np.array([len(s) for s in segments], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.lengths)])
        n = len(segments)
        self.first = self.start[:-1] + np.arange(n)  # the empty prefix of each segment
        places = np.arange(len(chars)) + np.repeat(np.arange(n), self.lengths)  # of the prefix before each character
        size = len(chars) + n
        self.token, self.before, self.count = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        ends, tokens, froms = self.matches(chars, places)
        most = np.bincount(ends, minlength=size)
        at = np.cumsum(most) - most
        order = np.argsort(-self.lengths, kind="stable")
        sizes = self.lengths[order]
        for i in range(1, int(sizes[0]) + 1 if n else 0):
            live = order[: np.searchsorted(-sizes, -i, side="right")]
            self.fill(self.first[live] + i, at, most, tokens, froms)

    def matches(self, chars: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, piece, start) of every piece found, longest first for each end; one character always counts as one."""
        model, n_pieces = self.model, len(self.model.pieces)
        last = np.concatenate([places[1:] != places[:-1] + 1, [True]]) if len(chars) else np.zeros(0, bool)  # a segment ends
        node = model.steps.get(chars)
        here = np.where(node >= 0, model.token_at[node], -1)
        found = [(places + 1, np.where(here >= 0, here, n_pieces + chars), places)]
        at = np.flatnonzero((node >= 0) & ~last)
        node, length = node[at], 1
        while len(at):
            node = model.steps.get((node.astype(np.int64) << 21) | chars[at + length])
            alive = node >= 0
            at, node = at[alive], node[alive]
            length += 1
            hit = model.token_at[node] >= 0
            found.append((places[at[hit]] + length, model.token_at[node[hit]], places[at[hit]]))
            alive = ~last[at + length - 1]
            at, node = at[alive], node[alive]
        ends, tokens, froms = (np.concatenate(x[::-1]) for x in zip(*found, strict=True))
        order = np.argsort(ends, kind="stable")
        return ends[order], tokens[order], froms[order]

    def fill(self, end: np.ndarray, at: np.ndarray, most: np.ndarray, tokens: np.ndarray, froms: np.ndarray) -> None:
        n_pieces, k = len(self.model.pieces), at[end]
        stop = k + most[end] - 1
        while len(end):
            token, before = tokens[k], froms[k]
            left = self.token[before]
            fits = (left < 0) | (left >= n_pieces) | (token >= n_pieces)
            test = np.flatnonzero(~fits & (k < stop))
            fits[k >= stop] = True  # the single character is what is left
            if len(test):
                fits[test] = self.model.compatible_all(left[test], token[test])
            e, t, b = end[fits], token[fits], before[fits]
            self.token[e], self.before[e] = t, b
            self.count[e] = self.count[b] + self.width(t)
            end, k, stop = end[~fits], k[~fits] + 1, stop[~fits]

    def width(self, tokens: np.ndarray) -> np.ndarray:
        """Ids of each token: 1, or one for each byte of a character outside the vocabulary."""
        code = tokens - len(self.model.pieces)
        return np.where((code < 0x80) | (not self.model.byte_ids), 1, 2 + (code >= 0x800) + (code >= 0x10000))

    def totals(self) -> np.ndarray:
        return self.count[self.first + self.lengths]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments on end, recovered backwards, and where each segment's begin."""
        begins = np.concatenate([[0], np.cumsum(self.totals())])
        out = np.zeros(begins[-1], np.uint32)
        place, base, first = self.first + self.lengths, begins[:-1], self.first
        n_pieces = len(self.model.pieces)
        live = place > first
        place, base, first = place[live], base[live], first[live]
        while len(place):
            token, before = self.token[place], self.before[place]
            slot = base + self.count[before]
            known = token < n_pieces
            out[slot[known]] = token[known]
            for s, t in zip(slot[~known].tolist(), token[~known].tolist(), strict=True):
                raw = [self.model.byte_ids.get(b, self.model.unk) for b in chr(t - n_pieces).encode()] if self.model.byte_ids else [self.model.unk]
                out[s : s + len(raw)] = raw
            live = before > first
            place, base, first = before[live], base[live], first[live]
        return out, begins


SEGMENT = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.n, self.data = 0, np.zeros(1 << 16, kind)

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(self.n + 2 * len(values), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Store:
    """Totals and ids of the distinct segments that a worker has met; emptied once it holds MOST_SEGMENTS."""

    def __init__(self, model: Model, with_ids: bool) -> None:
        self.model, self.with_ids = model, with_ids
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict(lambda n=count(): next(n))
        self.done, self.totals, self.at, self.flat = 0, Grown(np.int32), Grown(np.int64), Grown(np.uint32)

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The segment numbers of all texts on end, and where each text's begin. New segments are worked out."""
        if self.done > MOST_SEGMENTS:
            self.clear()
        which, begins, of = [], [0], self.number.__getitem__
        for text in texts:
            which += map(of, self.model.segments(text or ""))
            begins.append(len(which))
        new = list(islice(reversed(self.number), len(self.number) - self.done))[::-1]
        if new:
            tables = Tables(self.model, new)
            self.totals.add(tables.totals())
            if self.with_ids:
                ids, begin = tables.ids()
                self.at.add(begin[:-1] + self.flat.n)
                self.flat.add(ids)
            self.done = len(self.number)
        return np.array(which, np.int64), np.array(begins, np.int64)


@lru_cache(maxsize=2)
def loaded(proto: bytes) -> Model:
    return Model(proto)


def one_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each_byte", one_byte)


class Codec:
    """Encoder, decoder and prefix counts for one model; what Spark tasks and plain callers use."""

    def __init__(self, model: Model | bytes) -> None:
        self.model = model if isinstance(model, Model) else loaded(model)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        store = self.model.store(False)
        which, begins = store.numbered(texts)
        sums = np.concatenate([[0], np.cumsum(store.totals.data[which], dtype=np.int64)])
        return sums[begins[1:]] - sums[begins[:-1]]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        store = self.model.store(True)
        which, begins = store.numbered(texts)
        lengths = store.totals.data[which].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = store.flat.data[spread(store.at.data[which], lengths)]
        return np.split(ids, ends[begins[1:-1]])

    def prefix_counts(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text, the exact tokens of ``text[:k]`` for k = 0 .. len(text), each as if that prefix were the whole text."""
        out = []
        for text in texts:
            segments = self.model.segments(text or "")
            tables = Tables(self.model, segments)
            base, found = 0, [np.zeros(1, np.int64)]
            for k, g in enumerate(range(len(segments))):
                inside = tables.count[tables.first[g] : tables.first[g] + tables.lengths[g] + 1]
                found.append(base + inside[2 if k == 0 else 1 :])
                base += inside[-1]
            out.append(np.concatenate(found))
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of ids as the library gives it: controls vanish, the first piece loses one leading space."""
        model, ids = self.model, np.asarray(ids, np.int64)
        at = 0
        while at < len(ids) and model.bytes_of[ids[at]] == b"":
            at += 1
        raw = model.byte_flat[spread(model.byte_at[ids], model.byte_at[ids + 1] - model.byte_at[ids])].tobytes()
        if at < len(ids) and model.pieces[ids[at]].startswith(SPACE_MARK):
            raw = raw[1:]
        return raw.decode("utf-8", "each_byte")


def proto_of(model: str | None) -> bytes:
    with open(model or default_model(), "rb") as f:
        return f.read()


def shared_model(spark: SparkSession, model: str | None) -> Broadcast[Model]:
    """The model of a file that the driver can read, with its automaton, for all tasks: some MB, as the vocabulary's size is fixed."""
    return spark.sparkContext.broadcast(loaded(proto_of(model)))


def token_counts(docs: DataFrame, model: str | None = None, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, n_bytes, n_tokens, over_limit), one for each input row. Null text: empty, 0 tokens."""
    shared = shared_model(docs.sparkSession, model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec(shared.value)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        counts = codec.counts(texts)
        return record(doc_id=batch.column(0), n_bytes=np.array([len(t.encode()) for t in texts], np.int64), n_tokens=counts, over_limit=counts > limit)

    return map_texts(id_and_text(docs, id_col, text_col), kernel, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def token_budget(docs: DataFrame, budget: int, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, n_tokens, cut_chars, prefix_counts): the longest prefix within a budget, and the count at each prefix."""
    shared = shared_model(docs.sparkSession, model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec(shared.value)
        counts = codec.prefix_counts(batch.column(1).to_pylist())
        cuts = [int(np.flatnonzero(x <= budget)[-1]) for x in counts]
        return record(doc_id=batch.column(0), n_tokens=pa.array([x[-1] for x in counts], pa.int64()), cut_chars=pa.array(cuts, pa.int64()), prefix_counts=pa.array(counts, pa.list_(pa.int32())))

    return map_texts(id_and_text(docs, id_col, text_col), kernel, "doc_id long, n_tokens long, cut_chars long, prefix_counts array<int>")


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, ids, decoded): ids with begin and end, and the text that they decode to."""
    shared = shared_model(docs.sparkSession, model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, decoded = zip(*encoded(Codec(shared.value), batch.column(1).to_pylist()), strict=True)
        return record(doc_id=batch.column(0), ids=pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), decoded=pa.array(decoded, pa.string()))

    return map_texts(id_and_text(docs, id_col, text_col), kernel, "doc_id long, ids array<int>, decoded string")


def encode_rows(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, n_tokens, ids, round_trip): the ids, and whether they decode to the text (they do unless it has a space mark of its own)."""
    shared = shared_model(docs.sparkSession, model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        ids, decoded = zip(*encoded(Codec(shared.value), texts), strict=True)
        arrays = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))
        same = [d == (t or "") for d, t in zip(decoded, texts, strict=True)]
        return record(doc_id=batch.column(0), n_tokens=np.diff(offsets).astype(np.int64), ids=listed, round_trip=pa.array(same))

    return map_texts(id_and_text(docs, id_col, text_col), kernel, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def encode_digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` in digests: (doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each input row."""
    shared = shared_model(docs.sparkSession, model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(len(i) // 4, sha256(i), sha256(t.encode())) for i, t in encoded(Codec(shared.value), batch.column(1).to_pylist())]
        n, ids, decoded = zip(*rows, strict=True)
        return record(doc_id=batch.column(0), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids), decoded_sha256=pa.array(decoded))

    return map_texts(id_and_text(docs, id_col, text_col), kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encoded(codec: Codec, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
    for inner in codec.encode(texts):
        ids = np.concatenate([[codec.model.bos], inner, [codec.model.eos]]).astype("<u4")
        yield ids.tobytes(), codec.decode(ids)
