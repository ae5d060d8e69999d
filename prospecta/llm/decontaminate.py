"""Benchmark decontamination by q-gram counting in diagonal bands and banded alignment.

Texts are compared without case and with every run of characters that are not letters or digits as one
space. A document is contaminated by an item of m characters if some region of it is within k = floor(EDIT_SHARE * m)
edits of the whole item. By the q-gram lemma such a region shares at least m - Q + 1 - k * Q q-grams with
the item, all on diagonals (document position less item position) that differ by at most k. Hits are
counted in bands of 2 (k + 1) diagonals that overlap by half, so that one band holds them all; bands that reach the bound are verified by an alignment
confined to their diagonals, whose end points give the region.

Of an item of more than WINDOW characters a part is enough: WINDOW consecutive characters of it within floor(EDIT_SHARE * WINDOW)
edits, found by the same count over every window's q-grams. A region of a part goes on to where its edits are farthest below
the share; it is left out where it overlaps a region of the same item that was found before. Its edits are those of the part.

The items go to the workers in shards of at most SHARD_CHARS characters, one pass over the documents for each shard.

Defined results: null and empty texts and items match nothing, nor do items of fewer than MIN_CHARS
characters, which are too short to be evidence. Null ids are kept. Repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.textblocks import row_blocks, trimmed

Q, EDIT_SHARE, MIN_CHARS, SHARD_CHARS = 8, 0.08, 24, 4_000_000
#: So many consecutive characters of a longer item are evidence.
WINDOW = 110
_BITS = 20
_FAR = 1 << 40


@functools.cache
def _folded() -> np.ndarray:
    """Code point -> its lower-case form for letters and digits, 32 for all else."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalnum():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all normal forms; where each text's begin, plus the end; original position of each).

    A normal form begins and ends with one space, so it has at least two characters.
    """
    raw = np.frombuffer(("\n" + "\n\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    begin = np.cumsum(size) - size
    points = _folded()[raw]
    space = points == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep[begin] = True
    at = np.flatnonzero(keep)
    place = np.searchsorted(at, np.append(begin, len(raw)))
    return points[at], place, at


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q = 8 characters from each position on, by doubling."""
    h, n = points.astype(np.uint64) + np.uint64(1), 1
    for multiplier in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        h = h[: len(h) - n] * np.uint64(multiplier) + h[n:] if len(h) > n else h[:0]
        h ^= h >> np.uint64(31)
        n *= 2
    return h


def bound(m, share: float = EDIT_SHARE):
    """(edit budget, q-grams that a region within it must share) for items of m characters."""
    k = np.floor(share * np.asarray(m)).astype(np.int64)
    return k, np.maximum(1, m - Q + 1 - k * Q)


class Items:
    """The q-gram index of a shard of items."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        points, place, _ = normal(texts)
        long = [i for i in range(len(ids)) if place[i + 1] - place[i] >= MIN_CHARS]
        self.ids = [ids[i] for i in long]
        self.points = [points[place[i] : place[i + 1]] for i in long]
        self.m = np.array([len(p) for p in self.points], np.int64)
        self.k, self.need = bound(self.m)
        self.part_k, self.part_bound = bound(WINDOW)
        self.part_need = np.where(self.m > WINDOW, self.part_bound, self.need)
        grams = [gram_hashes(p) for p in self.points]
        h = np.concatenate(grams or [np.empty(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.hashes, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.arange(len(long)), list(map(len, grams)))[order] if long else np.empty(0, np.int64)
        self.pos = np.concatenate([np.arange(len(g)) for g in grams] or [np.empty(0, np.int64)])[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, item position) of every shared q-gram."""
        h = gram_hashes(points)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        slot = np.searchsorted(self.hashes, h[at])
        slot[slot == len(self.hashes)] = 0
        same = self.hashes[slot] == h[at]
        at, slot = at[same], slot[same]
        n = self.count[slot]
        which = np.repeat(self.first[slot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(at, n), self.item[which], self.pos[which]

    def regions(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, stop, edits) of the contaminated regions, as offsets of the original texts."""
        if not len(self.hashes):
            return []
        points, place, origin = normal(texts)
        at, item, pos = self.hits(points)
        doc = np.searchsorted(place, at, side="right") - 1
        inside = at + Q <= place[doc + 1]
        at, item, pos, doc = (x[inside] for x in (at, item, pos, doc))
        pair = doc * len(self.ids) + item
        # An item's hits in a whole text are counted first; few pairs reach a bound even so.
        keys, back, counts = np.unique(pair, return_inverse=True, return_counts=True)
        enough = (counts >= np.minimum(self.need, self.part_need)[keys % len(self.ids)])[back]
        at, item, pos, doc = (x[enough] for x in (at, item, pos, doc))
        if not len(at):
            return []
        found = {}
        for d, i, low, high in self.bands(at - place[doc] - pos, item, doc, self.k):
            got = align(self.points[i], points[place[d] : place[d + 1]], low, high, int(self.k[i]))
            if got is not None:
                edits, start, stop = got
                span = (d, i, *self.original(texts[d], origin, place[d], start, stop))
                found[span] = min(edits, found.get(span, edits))
        parts = self.part_regions(at, item, pos, doc, points, place, texts, origin, found)
        return [(*span, edits) for span, edits in sorted((found | parts).items())]

    @staticmethod
    def original(text: str, origin: np.ndarray, begin: int, start: int, stop: int) -> tuple[int, int]:
        """Offsets in the original text of a stretch of its normal form."""
        base = origin[begin]
        return max(0, int(origin[begin + start] - base - 1)), min(len(text), int(origin[begin + stop - 1] - base))

    def bands(self, diagonal, item, doc, k, need=None):
        """(text, item, lowest, highest diagonal) of the bands with enough hits; of neighbouring bands two make one."""
        need = self.need if need is None else need
        band = (diagonal + self.m[item]) // (k[item] + 1)
        width = int(band.max()) + 2
        keys = np.concatenate([((doc * len(self.ids) + item) * width + band + one) for one in (0, 1)])
        keys, counts = np.unique(keys, return_counts=True)
        keys = keys[counts >= need[keys // width % len(self.ids)]]
        # Two neighbouring bands hold one region as a rule; they are aligned as one.
        first = np.ones(len(keys), bool)
        for j in range(1, len(keys)):
            first[j] = keys[j] != keys[j - 1] + 1 or not first[j - 1]
        twice = np.append(~first[1:], False)
        for key, more in zip(keys[first].tolist(), twice[first].tolist(), strict=True):
            pair, b = divmod(key, width)
            d, i = divmod(pair, len(self.ids))
            step = int(k[i]) + 1
            low = (b - 1) * step - int(self.m[i])
            yield d, i, low, low + (2 + more) * step - 1

    def part_regions(self, at, item, pos, doc, points, place, texts, origin, whole) -> dict:
        """Regions of parts of the long items, beside the ``whole`` ones."""
        long = self.m[item] > WINDOW
        at, item, pos, doc = (x[long] for x in (at, item, pos, doc))
        if not len(at):
            return {}
        diagonal, taken, found = at - place[doc] - pos, {}, {}
        for d, i, start, stop in whole:
            taken.setdefault((d, i), []).append((start, stop))
        pair = doc * len(self.ids) + item
        order = np.argsort(pair, kind="stable")
        pair, diagonal, pos = pair[order], diagonal[order], pos[order]
        k, need = int(self.part_k), int(self.part_bound)
        for d, i, low, high in self.bands(diagonal, pair % len(self.ids), pair // len(self.ids), np.full(len(self.ids), self.part_k), self.part_need):
            a, b = np.searchsorted(pair, [d * len(self.ids) + i, d * len(self.ids) + i + 1])
            own = np.sort(pos[a:b][(diagonal[a:b] >= low) & (diagonal[a:b] <= high)])
            m, reach = int(self.m[i]), WINDOW - Q
            # A window from s on holds the q-grams that begin at s to s + reach.
            s = np.arange(m - WINDOW + 1)
            full = np.flatnonzero(np.searchsorted(own, s + reach, side="right") - np.searchsorted(own, s) >= need)
            text, s = points[place[d] : place[d + 1]], 0
            while (j := np.searchsorted(full, s)) < len(full):
                s = int(full[j])
                edits, got = align_part(self.points[i][s:], text, low + s, high + s, k)
                if got is None:
                    # A window further on by one has at most one edit less.
                    s += edits - k
                    continue
                length, edits, start, stop = got
                s += length
                # Backwards from its end the region's beginning is found in the same way.
                _, back = align_part(self.points[i][:s][::-1], text[:stop][::-1], stop - s - high, stop - s - low, k)
                if back is not None:
                    edits, start, stop = back[1], stop - back[3], stop - back[2]
                span = self.original(texts[d], origin, place[d], start, stop)
                others = taken.setdefault((d, i), [])
                if all(span[1] <= x or y <= span[0] for x, y in others):
                    others.append(span)
                    found[d, i, *span] = edits
        return found


def align_part(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, tuple[int, int, int, int] | None]:
    """(edits of the item's first WINDOW characters, (length, edits, start, stop) of the beginning whose edits are farthest below the share).

    The second is None where those edits are more than ``k``. The alignment is that of align().
    """
    low, high = low - k, high + k
    width = high - low + 1
    steps = np.arange(width) * _FAR
    left, right = max(0, -low), max(0, high + len(item) - len(text))
    around = np.concatenate([np.full(left, 0xFFFFFFFF, np.uint32), text, np.full(right, 0xFFFFFFFF, np.uint32)])
    row = np.clip(np.arange(low, high + 1), 0, len(text))
    first, got, least = 0, None, 0.0
    for n, c in enumerate(item.tolist(), 1):
        drop = row + _FAR
        row = row + (around[left + low + n - 1 : left + low + n - 1 + width] != c) * _FAR
        np.minimum(row[:-1], drop[1:], out=row[:-1])
        row -= steps
        np.minimum.accumulate(row, out=row)
        row += steps
        if n >= WINDOW:
            best = int(row.argmin())
            edits, start = divmod(int(row[best]), _FAR)
            if n == WINDOW:
                first = edits
                if edits > k:
                    break
            stop = min(len(text), max(start, low + best + n))
            if EDIT_SHARE * n - edits >= least and start < stop:
                got, least = (n, edits, start, stop), EDIT_SHARE * n - edits
            elif edits > EDIT_SHARE * len(item):
                break
    return first, got


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """The best (edits, start, stop) of the whole item in the text on the diagonals low..high, or None beyond k edits.

    A cell holds edits * _FAR + start, so that one minimum carries both; insertions along a row are a running minimum.
    """
    low, high = low - k, high + k
    width = high - low + 1
    steps = np.arange(width) * _FAR
    # Characters outside the text match nothing; swapping one costs what dropping the item's character costs.
    left, right = max(0, -low), max(0, high + len(item) - len(text))
    around = np.concatenate([np.full(left, 0xFFFFFFFF, np.uint32), text, np.full(right, 0xFFFFFFFF, np.uint32)])
    row = np.clip(np.arange(low, high + 1), 0, len(text))
    for i, c in enumerate(item.tolist()):
        drop = row + _FAR
        row = row + (around[left + low + i : left + low + i + width] != c) * _FAR
        np.minimum(row[:-1], drop[1:], out=row[:-1])
        row -= steps
        np.minimum.accumulate(row, out=row)
        row += steps
        if i % 32 == 31 and row.min() >= (k + 1) * _FAR:
            return None
    best = int(row.argmin())
    edits, start = divmod(int(row[best]), _FAR)
    stop = min(len(text), max(start, low + best + len(item)))
    return (edits, start, stop) if edits <= k and start < stop else None


def find_regions(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """(id, item_id, start, stop, edits): every region of a document that an item contaminates."""
    spark, schema = docs.sparkSession, "id long, item_id long, start int, stop int, edits int"
    items = benchmark.where(F.length(item_text_col) > 0).select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = math.ceil(chars / SHARD_CHARS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    found = None
    for shard in range(shards):
        some = items.where(F.pmod(F.xxhash64("t"), F.lit(shards)) == shard).toArrow()
        shared = spark.sparkContext.broadcast(Items(some.column("i").to_pylist(), some.column("t").to_pylist()))

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), []
                for at, texts in row_blocks(batch.column(1)):
                    out += [(ids[at + d], index.ids[i], a, b, e) for d, i, a, b, e in index.regions(texts)]
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "item_id", "start", "stop", "edits"])

        one = rows.mapInArrow(trimmed(run), schema)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], schema) if found is None else found
