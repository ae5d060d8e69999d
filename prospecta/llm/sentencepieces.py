"""SentencePiece encoding and decoding by suffix-array matching.

A worker splits normalised texts into units that no piece of the vocabulary can span (the vocabulary itself is
checked for that), and takes the distinct units of a block that it has not met before. Their concatenated
UTF-8 text is indexed by a suffix array; every piece is binary-searched for the range of its occurrences;
each occurrence is an edge from its first to its last position. The edges are sorted by position and relaxed:

* unigram models: the best path, edge by edge in order of position (Viterbi);
* BPE models: in all units at once, the adjacent pair whose joint edge has the best score (leftmost on ties)
  becomes one, until no joint edge is left. That is the order in which SentencePiece itself merges.

A character without a piece becomes the bytes of its UTF-8 form where the model has byte pieces, else <unk>.

Defined results: null and empty texts have no ids. Text whose white space is not a space is kept as it
is. The model's file is a parameter; its bytes go to the workers, a vocabulary is bounded by its model.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.textblocks import row_blocks, trimmed, UnitTable

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE, BLOCK, LONG_UNIT = "▁", 1 << 20, 1000
#: An edge is a position, a piece's size and its id in one whole number; the rest of its 63 bits are the position's.
SIZE_BITS, ID_BITS = 11, 24
_NONE = np.iinfo(np.int64).max


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = data[at]
            at, value, shift = at + 1, value | (c & 127) << shift, shift + 7
            if c < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, data: bytes) -> None:
        self.pieces, self.scores, self.kinds, self.type = [], [], [], UNIGRAM
        self.charsmap, self.prefix, self.squeeze = b"", True, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                self.charsmap, self.prefix, self.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=data) if self.charsmap or self.squeeze else None

    def normal(self, text: str) -> str:
        if self.processor is not None:
            return self.processor.normalize(text)
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)


def unit_pattern(pieces: list[str], fixed: list[str]) -> re.Pattern:
    """Units of normal text that no piece spans; one unit for all of a text if the pieces allow no split."""
    split_all = not any(re.search(r"[^▁]▁|[.,;:!?][▁\n]|.\n|\n.", p, re.S) for p in pieces)
    crossing = sorted({c for p in pieces for c in re.findall(r"([^\W\d_])(?=[.,;:!?])", p)})
    guard = f"(?<![{re.escape(''.join(crossing))}])" if crossing else ""
    # A word without a mark behind it goes on to the next space; nothing is gained by giving characters back.
    words = rf"▁?[^\W\d_]++(?:{guard}(?=[.,;:!?])|[^▁\n]*+)|[.,;:!?]++(?=[▁\n])|\n|▁*+[^▁\n]++|▁++" if split_all else r"(?s).+"
    if fixed:
        names = "|".join(re.escape(x) for x in sorted(fixed, key=len, reverse=True))
        return re.compile(rf"{names}|(?:(?!{names})[\s\S])+")
    return re.compile(words)


class Encoder:
    def __init__(self, data: bytes) -> None:
        m = self.model = Model(data)
        usable = [i for i, k in enumerate(m.kinds) if k in (NORMAL, USER_DEFINED, UNUSED)]
        self.fixed = {m.pieces[i]: i for i in usable if m.kinds[i] == USER_DEFINED}
        self.unknown = m.kinds.index(UNKNOWN)
        byte = {int(m.pieces[i][3:5], 16): i for i, k in enumerate(m.kinds) if k == BYTE}
        self.bytes = np.array([byte[b] for b in range(256)], np.int64) if len(byte) == 256 else None
        # Bytes are shifted by one, so that none is 0; 255 parts the units.
        coded = [(np.frombuffer(m.pieces[i].encode(), np.uint8) + 1).tobytes() for i in usable]
        order = sorted(range(len(usable)), key=coded.__getitem__)
        self.coded, self.ids = np.array([coded[k] for k in order] or [b"\x01"]), np.array([usable[k] for k in order], np.int64)
        self.width = -(-max(self.coded.dtype.itemsize, 1) // 8) * 8
        self.size = np.array([len(coded[k]) for k in order], np.int64)
        if len(m.pieces) >> ID_BITS or len(self.size) and int(self.size.max()) >> SIZE_BITS:
            raise ValueError(f"pieces of {1 << SIZE_BITS} bytes or more, or {1 << ID_BITS} pieces, are beyond this encoder")
        low = [coded[k][:8].ljust(8, b"\0") for k in order]
        self.low, self.high = (np.frombuffer(b"".join(x), ">u8").astype(np.uint64) for x in (low, [coded[k][:8].ljust(8, b"\xff") for k in order]))
        scores = np.array([m.scores[i] for i in range(len(m.pieces))])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.scores = scores
        self.pattern = unit_pattern([m.pieces[i] for i in usable], list(self.fixed))
        self.texts = [self._surface(i) for i in range(len(m.pieces))]
        self.table = UnitTable(self._units, np.int32, limit=150_000)

    def _surface(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == CONTROL:
            return b""
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        units, counts = [], []
        for text in texts:
            own = self.pattern.findall(self.model.normal(text))
            units += own
            counts.append(len(own))
        flat, sizes = self.table.expand(self.table.rows(units))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(np.array(counts, np.int64))]
        parts = np.split(flat, ends[:-1]) if texts else []
        return parts if self.bytes is not None else [p[~((p == self.unknown) & (np.append(-1, p[:-1]) == self.unknown))] for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if self.model.prefix and raw.startswith(" ") else raw

    def edges(self, data: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Sorted edges (start, size and piece id, packed) of every piece's occurrences that begin at ``heads``."""
        room = np.concatenate([data, np.full(self.width, 255, np.uint8)])
        column = lambda at, k: np.ndarray(len(data), ">u8", room, k, strides=(1,))[at].astype(np.uint64)
        first = column(heads, 0)
        order = np.argsort(first, kind="stable")
        first = first[order]
        tied = np.zeros(len(order), bool)
        tied[1:] = first[1:] == first[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if len(at) and self.width > 8:
            own = heads[order[at]]
            order[at] = order[at][np.lexsort([column(own, k) for k in range(self.width - 8, 0, -8)] + [first[at]])]
        suffixes = heads[order]
        left, right = np.searchsorted(first, self.low), np.searchsorted(first, self.high, side="right")
        far = np.flatnonzero((self.size > 8) & (left < right))
        if len(far):
            a, b = int(left[far].min()), int(right[far].max())
            windows = np.ndarray((len(data), self.width), np.uint8, room, strides=(1, 1))[suffixes[a:b]].view(f"S{self.width}").ravel()
            wanted = self.coded[far].astype(f"S{self.width}")
            left[far] = a + np.searchsorted(windows, wanted)
            filled = np.array([p.ljust(self.width, b"\xff") for p in wanted.tolist()], f"S{self.width}")
            right[far] = a + np.searchsorted(windows, filled, side="right")
        some = np.flatnonzero(left < right)
        n = (right - left)[some]
        where = suffixes[np.arange(int(n.sum())) + np.repeat(left[some] - (np.cumsum(n) - n), n)]
        return np.sort(where << SIZE_BITS + ID_BITS | np.repeat(self.size[some] << ID_BITS | self.ids[some], n))

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        coded = [u.encode() for u in units]
        data = np.frombuffer(b"\xfe".join(coded) + b"\xfe", np.uint8) + np.uint8(1)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
        if len(data) >> 63 - SIZE_BITS - ID_BITS:
            raise ValueError("a block of units is too long to index")
        begin = np.cumsum(sizes) - sizes
        # Heads of characters: neither continuation bytes nor the marks between units.
        heads = np.flatnonzero(((data - np.uint8(1)) & 0xC0 != 0x80) & (data != 255))
        edges = self.edges(data, heads)
        keys, ids = edges >> ID_BITS, edges & ((1 << ID_BITS) - 1)
        stops = np.append(heads[1:], len(data))
        last = np.searchsorted(heads, begin + sizes - 1) - 1
        stops[last] = begin + sizes - 1
        relax = self._best_paths if self.model.type == UNIGRAM else self._merges
        start, stop = relax(heads, stops, keys, ids, np.searchsorted(heads, begin), np.array([u in self.fixed for u in units]))
        found = np.searchsorted(keys, start << SIZE_BITS | (stop - start))
        found[found == len(keys)] = 0
        known = (keys[found] == start << SIZE_BITS | (stop - start)) & (stop - start < 1 << SIZE_BITS) if len(keys) else np.zeros(len(start), bool)
        whole = np.searchsorted(begin, start, side="right") - 1
        size = np.where(known | (self.bytes is None), 1, stop - start)
        ends = np.cumsum(size)
        flat = np.full(int(ends[-1]) if len(ends) else 0, self.unknown, np.int32)
        flat[(ends - size)[known]] = ids[found[known]] if len(keys) else 0
        if self.bytes is not None:
            odd = np.flatnonzero(~known)
            at = np.repeat(start[odd] - (np.cumsum(size[odd]) - size[odd]), size[odd]) + np.arange(int(size[odd].sum()))
            to = np.repeat((ends - size)[odd] - (np.cumsum(size[odd]) - size[odd]), size[odd]) + np.arange(int(size[odd].sum()))
            flat[to] = self.bytes[data[at].astype(np.int64) - 1]
        total = np.bincount(whole, weights=size, minlength=len(units)).astype(np.int64)
        return flat, np.cumsum(total) - total, total

    def _merges(self, start, stop, keys, ids, first, frozen):
        """BPE: the symbols that are left, as sorted starts and stops."""
        rank = self.rank[ids]
        count = np.diff(np.append(first, len(start)))

        def value(a, b):
            size = b - a
            at = np.searchsorted(keys, a << SIZE_BITS | np.minimum(size, (1 << SIZE_BITS) - 1))
            at[at == len(keys)] = 0
            hit = (size < 1 << SIZE_BITS) & (keys[at] == a << SIZE_BITS | np.minimum(size, (1 << SIZE_BITS) - 1)) if len(keys) else np.zeros(len(a), bool)
            return np.where(hit, rank[at] << 32 | a, _NONE) if len(keys) else np.full(len(a), _NONE)

        done = [(start[:0], stop[:0])]
        for u in np.flatnonzero(count > LONG_UNIT).tolist():
            done.append(self._merge_long(start[first[u] : first[u] + count[u]], stop[first[u] : first[u] + count[u]], value))
        alone = (count <= LONG_UNIT) & (count > 0)
        for u in np.flatnonzero(frozen & alone).tolist():
            done.append((start[first[u] : first[u] + 1], stop[first[u] + count[u] - 1 : first[u] + count[u]]))
        use = np.repeat(alone & ~frozen, count)
        start, stop, count = start[use], stop[use], count[alone & ~frozen]
        best = np.full(len(start), _NONE)
        inner = np.ones(len(start), bool)
        inner[np.cumsum(count) - 1] = False
        pair = np.flatnonzero(inner)
        best[pair] = value(start[pair], stop[pair + 1])
        while len(start):
            first = np.cumsum(count) - count
            low = np.minimum.reduceat(best, first)
            open_ = low != _NONE
            if not open_.all():
                keep = np.repeat(open_, count)
                done.append((start[~keep], stop[~keep]))
                start, stop, best, count, low = start[keep], stop[keep], best[keep], count[open_], low[open_]
                if not len(start):
                    break
                first = np.cumsum(count) - count
            at = np.searchsorted(start, low & 0xFFFFFFFF)
            stop[at] = stop[at + 1]
            keep = np.ones(len(start), bool)
            keep[at + 1] = False
            final = at + 1 == first + count - 1
            before = at > first
            start, stop, best = start[keep], stop[keep], best[keep]
            count = count - 1
            at = at - np.arange(len(at))
            best[at] = _NONE
            more = at[~final]
            best[more] = value(start[more], stop[more + 1])
            more = at[before] - 1
            best[more] = value(start[more], stop[more + 1])
        start, stop = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], stop[order]

    @staticmethod
    def _merge_long(start, stop, value):
        """The same for one long unit, with a heap of pairs."""
        ends, after, before = dict(zip(start.tolist(), stop.tolist(), strict=True)), dict(zip(start.tolist()[:-1], start.tolist()[1:], strict=True)), dict(zip(start.tolist()[1:], start.tolist()[:-1], strict=True))
        heap = [(v, a, int(b)) for v, a, b in zip(value(start[:-1], stop[1:]).tolist(), start.tolist(), stop[1:], strict=False) if v != _NONE]
        heapq.heapify(heap)
        while heap:
            _, a, b = heapq.heappop(heap)
            right = after.get(a)
            if a not in ends or right is None or ends[right] != b:
                continue
            ends[a] = b
            del ends[right]
            nxt = after.pop(right, None)
            before.pop(right)
            if nxt is None:
                after.pop(a)
            else:
                after[a], before[nxt] = nxt, a
            for x, y in ((a, nxt), (before.get(a), a)):
                if x is not None and y is not None:
                    v = int(value(np.array([x]), np.array([ends[y]]))[0])
                    if v != _NONE:
                        heapq.heappush(heap, (v, x, ends[y]))
        left = sorted(ends)
        return np.array(left, np.int64), np.array([ends[a] for a in left], np.int64)

    def _best_paths(self, start, stop, keys, ids, first, frozen):
        """Unigram: the best path of each unit, with edges relaxed by position; equal scores keep the earlier edge."""
        penalty = min(self.scores[i] for i, k in enumerate(self.model.kinds) if k == NORMAL) - 10
        units = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(start))))
        usable = np.isin(np.array(self.model.kinds)[ids], (NORMAL, USER_DEFINED))
        at = dict.fromkeys(start[first].tolist(), (0.0, -1))
        edges = list(zip((keys[usable] >> SIZE_BITS).tolist(), ((keys[usable] >> SIZE_BITS) + (keys[usable] & ((1 << SIZE_BITS) - 1))).tolist(), self.scores[ids[usable]].tolist(), strict=True))
        single = {(a, b) for a, b, _ in edges}
        edges += [(a, b, penalty) for a, b in zip(start.tolist(), stop.tolist(), strict=True) if (a, b) not in single]
        for a, b, score in sorted(edges, key=lambda e: (e[0], e[1])):
            if a in at and (b not in at or at[a][0] + score > at[b][0]):
                at[b] = (at[a][0] + score, a)
        spans, ends = [], np.append(np.flatnonzero(np.diff(units)), len(start) - 1)
        for u, e in zip(units[ends].tolist(), stop[ends].tolist(), strict=True):
            if frozen[u]:
                spans.append((int(start[first[u]]), e))
                continue
            while (a := at[e][1]) >= 0:
                spans.append((a, e))
                e = a
        spans.sort()
        return np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64)


_ENCODERS: dict[int, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    key = zlib.crc32(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def encode(docs: DataFrame, model_path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, ids, round_trip): the ids of each row's whole text; round_trip tells whether they decode to the text."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        own = encoder(shared.value)
        for batch in batches:
            for at, texts in row_blocks(batch.column(1), BLOCK):
                got = own.encode(texts)
                flat = np.concatenate(got or [np.empty(0, np.int32)]).astype(np.int32)
                ends = np.cumsum([0, *map(len, got)])
                same = [own.decode(ids) == text for ids, text in zip(got, texts, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids, pa.array(same)], ["id", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(trimmed(run), "id long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str, id_col="id", ids_col="ids") -> DataFrame:
    """(id, text) of rows of ids; null ids give a null text."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        own = encoder(shared.value)
        for batch in batches:
            texts = [None if ids is None else own.decode(np.array(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(trimmed(run), "id long, text string")
