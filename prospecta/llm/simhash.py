"""SimHash fingerprints and their exact linking within a Hamming radius by pigeonring chains.

Fingerprints: words are runs of bytes outside space and 0x09-0x0D after A-Z is lower-cased; the shingles of
three words, repeats included and joined by single spaces, are hashed with XXH64 (seed 42); a bit is set
if it is set in over half of the hashes. All of it is vectorised over blocks of whole texts.

Linking: 64 bits make m = 4 segments on a ring with budget k = 3. If the distance is at most k, some
segment starts a chain whose first l segments differ by at most l * k / m for every l (the pigeonring
principle, Qin and Xiao 2018): 0, 1, 2 and 3 bits here. The first condition is an equal segment; the second
leaves at most one differing bit in the next segment, so one of its halves is equal: 24 key bits, 8 keys
a fingerprint. Only equal keys meet; the chain is tested in full before the Hamming distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.cluster import components, cut
from prospecta.llm.textblocks import row_blocks, trimmed

SHINGLE_WORDS, SEED, RADIUS, SEGMENTS = 3, 42, 3, 4
SEGMENT_BITS = 64 // SEGMENTS
#: Fingerprints of a bucket that are compared in one piece; larger buckets are dealt out as pairs of blocks.
BLOCK_ROWS = 2048

_U = np.uint64
# The five primes of XXH64.
P1, P2, P3, P4, P5 = map(
    _U, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(_U).ravel()


def _rot(x, by: int):
    return (x << _U(by)) | (x >> _U(64 - by))


def xxh64_slices(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of every ``data[start:start+size]``; slices of equal size are hashed together."""
    out = np.empty(len(start), _U)
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", room, strides=(1,))
    four = np.ndarray(len(data) + 1, "<u4", room, strides=(1,))
    order = np.argsort(size.astype(np.uint16) if len(size) and size.max() < 65536 else size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        at, n = start[group], int(size[group[0]])
        if len(group) < 4 or n >= 256:
            raw = data.tobytes() if n >= 256 and len(group) > 64 else None
            out[group] = [xxhash.xxh64_intdigest(raw[i : i + n] if raw else data[i : i + n].tobytes(), seed) for i in at.tolist()]
            continue
        p, s = 0, _U(seed)
        if n >= 32:
            lanes = [np.full(len(at), (seed + c) % 2**64, _U) for c in (int(P1) + int(P2), int(P2), 0, -int(P1))]
            while n - p >= 32:
                for k in range(4):
                    lanes[k] = _rot(lanes[k] + eight[at + (p + 8 * k)] * P2, 31) * P1
                p += 32
            h = _rot(lanes[0], 1) + _rot(lanes[1], 7) + _rot(lanes[2], 12) + _rot(lanes[3], 18)
            for lane in lanes:
                h = (h ^ (_rot(lane * P2, 31) * P1)) * P1 + P4
        else:
            h = np.full(len(at), s + P5, _U)
        h = h + _U(n)
        while n - p >= 8:
            h = _rot(h ^ (_rot(eight[at + p] * P2, 31) * P1), 27) * P1 + P4
            p += 8
        if n - p >= 4:
            h = _rot(h ^ (four[at + p].astype(_U) * P1), 23) * P2 + P3
            p += 4
        while p < n:
            h = _rot(h ^ (data[at + p].astype(_U) * P5), 11) * P1
            p += 1
        h = (h ^ (h >> _U(33))) * P2
        h = (h ^ (h >> _U(29))) * P3
        out[group] = h ^ (h >> _U(32))
    return out


def fingerprints(texts: list[str], words: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit integers; 0 where a text has no word."""
    raw = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    inside = ~_SPACE[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = inside
    keep[after] = True
    data[after] = 0x20
    place = np.cumsum(keep, dtype=np.int64) - 1
    data, first, after = data[keep], place[first], place[after]
    ends = place[np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1]
    held = np.searchsorted(first, ends, side="right")  # words up to the end of each text
    count = np.diff(held, prepend=0)
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    bounds = np.cumsum(shingles)
    lead = np.arange(int(bounds[-1]) if len(bounds) else 0) + np.repeat((held - count) - (bounds - shingles), shingles)
    last = np.minimum(lead + words - 1, np.repeat(held - 1, shingles))
    hashes = xxh64_slices(data, first[lead], after[last] - first[lead])
    return majority(hashes, shingles)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of ``sizes`` hashes, the bits set in over half of each run; eight byte-wide counters share a word."""
    out, some = np.zeros(len(sizes), _U), np.flatnonzero(sizes)
    if not len(some):
        return out
    runs = sizes[some]
    parts = -(-runs // 255)
    base = np.repeat(np.cumsum(runs) - runs, parts)
    within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    pieces = base + 255 * within
    owner = np.cumsum(parts) - parts
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.zeros((len(some), 64), bool)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[lanes[:, k]], pieces).view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits[:, 8 * k : 8 * k + 8] = 2 * np.add.reduceat(sums, owner, axis=0) > runs[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(_U).ravel()
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, text_hash): the fingerprint of each row's whole text as a signed long, and the text's XXH64. Null and empty texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            out = [fingerprints(texts) for _, texts in row_blocks(batch.column(1))]
            fp = np.concatenate(out or [np.empty(0, _U)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], ["id", "fp", "text_hash"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("h")).mapInArrow(trimmed(run), "id long, fp long, text_hash long")


def _keys(fp):
    """The eight 24-bit keys: an equal segment and an equal half of the next one, tagged by which."""
    mask, half = (1 << SEGMENT_BITS) - 1, SEGMENT_BITS // 2
    part = lambda i: F.shiftrightunsigned(fp, SEGMENT_BITS * (i % SEGMENTS)).bitwiseAND(F.lit(mask))
    out = []
    for i in range(SEGMENTS):
        for h in range(2):
            piece = F.shiftrightunsigned(part(i + 1), half * h).bitwiseAND(F.lit((1 << half) - 1))
            out.append(F.lit((2 * i + h) << (SEGMENT_BITS + half)) + F.shiftleft(part(i), half) + piece)
    return F.array(*out)


def chain_links(left: np.ndarray, right: np.ndarray, segment: int, radius: int = RADIUS) -> np.ndarray:
    """Index pairs (i, j) of left x right whose differences pass the chain from ``segment`` and the Hamming check."""
    differ = left[:, None] ^ right[None, :]
    i, j = np.nonzero(np.bitwise_count(_ring(differ, segment, 2)) <= 2 * radius // SEGMENTS)
    for length in range(3, SEGMENTS + 1):
        rest = left[i] ^ right[j]
        fits = np.bitwise_count(_ring(rest, segment, length)) <= length * radius // SEGMENTS
        i, j = i[fits], j[fits]
    return np.stack([i, j])


def _ring(x: np.ndarray, segment: int, length: int) -> np.ndarray:
    """The bits of ``length`` consecutive segments of the ring, from ``segment`` on."""
    turn = SEGMENT_BITS * segment % 64
    turned = _rot(x, 64 - turn) if turn else x
    return turned & _U((1 << SEGMENT_BITS * length) - 1)


def _forest(ids: np.ndarray, fps: np.ndarray, side: np.ndarray, key: int) -> tuple[list, list]:
    """Edges to the root of each linked part of one bucket, or of one pair of its blocks."""
    root = list(range(len(ids)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    segment = key >> (SEGMENT_BITS + SEGMENT_BITS // 2 + 1)
    rest = np.arange(len(ids))
    if (side == side[0]).all():
        hubs, others = rest, rest
    else:
        hubs, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for at in range(0, len(hubs), 256):
        some = hubs[at : at + 256]
        pair = chain_links(fps[some], fps[others], segment)
        for x, y in zip(some[pair[0]].tolist(), others[pair[1]].tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                root[max(p, q)] = min(p, q)
    tops = [top(x) for x in range(len(ids))]
    tied = [x for x, t in enumerate(tops) if t != x]
    return ids[tied].tolist(), ids[[tops[x] for x in tied]].tolist()


def _bucket_edges(batches):
    """Buckets arrive whole and in order; the last one of a batch may go on in the next batch."""
    held: list[np.ndarray] = []

    def emit(cols):
        key, a, b, side, ids, fps = cols
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        us, vs = [], []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if hi - lo > 1:
                u, v = _forest(ids[lo:hi], fps[lo:hi].view(_U), side[lo:hi], int(key[lo]))
                us += u
                vs += v
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
        stop = int(last[-1]) + 1 if len(last) else 0
        held = [c[stop:] for c in cols]
        if stop:
            yield emit([c[:stop] for c in cols])
    if held:
        yield emit(held)


def link(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the ids of (id, fp) rows exactly as all pairs within the radius would.

    ``fp`` is distinct here. A bucket yields a spanning forest of its links, not its pairs; a bucket of
    more than BLOCK_ROWS rows is dealt out as pairs of blocks, each a task's worth, so a hot one spreads.
    """
    keyed = fps.select("id", "fp", F.explode(_keys(F.col("fp"))).alias("key"))
    busy = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("long"))
    rows = keyed.join(busy, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("long").alias("side"), "id", "fp")
    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(trimmed(_bucket_edges), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id, text_hash, root) of every row.

    component_id is the smallest id reachable over links, root the fingerprint that names the component. Equal fingerprints collapse before linking, so
    groups of copies cost one row. Rows are linked by their texts alone: rows that share an id can be in several components, and rows
    without an id belong to components like any other; only a component without any id has a null component_id. An empty table gives no rows.
    """
    marked = cut(with_fingerprints(docs, id_col, text_col))
    firsts = cut(marked.groupBy("fp").agg(F.min("id").alias("id")))
    tied = components(link(firsts.select(F.col("fp").alias("id"), "fp")), "u", "v")
    rooted = firsts.join(tied, firsts.fp == tied.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = rooted.select("fp", "root").join(least, "root")
    return marked.join(classes, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root")
