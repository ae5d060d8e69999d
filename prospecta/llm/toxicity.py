"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window is a word, lower-cased, letters only, at most WINDOW letters long. Matches of a few bytes save
zstandard nothing in so short a text, so a window is spelled out: each byte becomes the CRC-32 of the word up to it,
four bytes. Words with a common beginning then share a long match. A window's distance is its
compressed length with the ordinary dictionary less that with the toxic one.

The ordinary dictionary is trained on words of ordinary documents; the toxic one on those
words of toxic documents that the ordinary one compresses worst. The thresholds of the distance are calibrated on
labelled documents that neither dictionary saw: the distances that given SHARES of the windows of ordinary ones stay below. How many windows of a text reach
each of them is weighed by a logistic fit on the same documents.

Defined results: null and empty texts are scored as texts without a window. Held-out rows, null ids and null
labels teach nothing; of several labels of a document the largest counts. Where a class has no
usable rows the score is the share of toxic labels (0 without labels). Repeated rows are scored alike.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.heldout import bounded_sample, held_out
from prospecta.llm.textblocks import UnitTable, row_blocks

#: Labelled documents of either class that are learned from, at most about.
TOXIC_DOCS, ORDINARY_DOCS = 3000, 4000
#: Words that a dictionary is trained on, at most; bytes of the dictionaries; the share of toxic words kept.
TOXIC_WORDS, ORDINARY_WORDS, TOXIC_BYTES, ORDINARY_BYTES, HARD_SHARE = 300_000, 400_000, 12 << 10, 512 << 10, 0.2
#: The thresholds are these quantiles of the distances in ordinary documents.
SHARES = (0.8, 0.9, 0.95, 0.98, 0.99, 0.998)
WINDOW = 64
_WORDS = re.compile(rf"[^\W\d_]{{1,{WINDOW}}}")


def windows(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def spelled(word: str) -> bytes:
    h, out = 0, bytearray()
    for c in (word + " ").encode():
        h = zlib.crc32(bytes((c,)), h)
        out += h.to_bytes(4, "little")
    return bytes(out)


def _compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    own = zstd.ZstdCompressionDict(dictionary)
    how = zstd.ZstdCompressionParameters(format=zstd.FORMAT_ZSTD1_MAGICLESS, compression_level=3, window_log=20, write_content_size=0, write_checksum=0, write_dict_id=0)
    own.precompute_compress(compression_params=how)
    return zstd.ZstdCompressor(dict_data=own, compression_params=how)


class Distances:
    """Distances of windows; each distinct one is compressed once per worker."""

    def __init__(self, toxic: bytes, ordinary: bytes, thresholds: tuple[float, ...] = ()) -> None:
        self.thresholds = thresholds
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.table = UnitTable(self._measure, np.int16)

    def _measure(self, words: list[str]):
        size = lambda w, s: len(self.ordinary.compress(s)) - len(self.toxic.compress(s))
        flat = np.fromiter((size(w, spelled(w)) for w in words), np.int16, len(words))
        return flat, np.arange(len(words)), np.ones(len(words), np.int64)

    def distances(self, words: list[str]) -> np.ndarray:
        rows = self.table.rows(words)
        return self.table.flat[self.table.start[rows]]

    def calibrate(self, texts: list[str]) -> None:
        """Set the thresholds by ordinary texts: above them by one at least, so that no threshold falls on the most frequent distance."""
        d = np.concatenate([self.distances(windows(t)) for t in texts] or [np.empty(0, np.int16)])
        self.thresholds = tuple(float(x) + 1 for x in np.quantile(d, SHARES)) if len(d) else (0.0,) * len(SHARES)

    def features(self, texts: list[str]) -> np.ndarray:
        """A row for each text: how many windows pass each threshold, as logarithm and as share, and the length."""
        listed = [windows(t) for t in texts]
        count = np.fromiter(map(len, listed), np.int64, len(listed))
        d = self.distances([w for one in listed for w in one])
        passed, some = np.zeros((len(texts), len(self.thresholds))), np.flatnonzero(count)
        if len(some):
            starts = (np.cumsum(count) - count)[some]
            for k, t in enumerate(self.thresholds):
                passed[some, k] = np.add.reduceat((d >= t).astype(np.int64), starts)
        n = count[:, None].astype(float)
        return np.hstack([np.log1p(passed), passed / (n + 10), np.log1p(n), np.ones_like(n)])


def _pick(words: list[str], bound: int) -> list[str]:
    """At most ``bound`` of the words, in an order that only they decide."""
    return [words[i] for i in np.random.default_rng(7).permutation(len(words))[:bound]]


def _dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    """A dictionary of at most ``size`` bytes, or as large as the samples allow."""
    size = min(size, max(512, sum(map(len, samples)) // 4))
    try:
        return zstd.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except zstd.ZstdError:  # too few samples to train on: their own bytes serve
        return b"".join(samples)[-size:].ljust(8, b" ")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ ((p - y) * weight) + 0.1 * b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b)), grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic"):
    """(share of toxic labels, (toxic dictionary, ordinary dictionary, thresholds, mean, deviation, weights) or None)."""
    said = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    n, share = said.agg(F.count("*"), F.avg("y")).first()
    chosen = {}
    for y, bound in ((1, TOXIC_DOCS), (0, ORDINARY_DOCS)):
        # About ``bound`` ids: they go to the texts.
        rows = texts.join(F.broadcast(bounded_sample(said.where(F.col("y") == y), bound, "i").select("i")), "i").select("t").distinct().toArrow()
        chosen[y] = sorted(rows.column("t").to_pylist(), key=lambda t: zlib.crc32(t.encode()))
    if not n or min(map(len, chosen.values())) < 4:
        return float(share or 0), None
    words = {y: [w for t in chosen[y][::2] for w in sorted(set(windows(t)))] for y in chosen}
    ordinary = _dictionary(ORDINARY_BYTES, [spelled(w) for w in _pick(words[0], ORDINARY_WORDS)], 32)
    samples, pack = [spelled(w) for w in _pick(words[1], TOXIC_WORDS)], _compressor(ordinary)
    cost = np.array([len(pack.compress(s)) / len(s) for s in samples] or [0.0])
    least = np.quantile(cost, 1 - HARD_SHARE)
    toxic = _dictionary(TOXIC_BYTES, [s for s, c in zip(samples, cost, strict=False) if c >= least], 24)
    measured = Distances(toxic, ordinary)
    measured.calibrate(chosen[0][1::2])
    x = {y: np.vstack([measured.features([t]) for t in chosen[y][1::2]]) for y in chosen}
    both, y = np.vstack([x[1], x[0]]), np.r_[np.ones(len(x[1])), np.zeros(len(x[0]))]
    mean, deviation = both.mean(axis=0), both.std(axis=0) + 1e-9
    mean[-1], deviation[-1] = 0, 1
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return float(share), (toxic, ordinary, measured.thresholds, mean, deviation, _logistic((both - mean) / deviation, y, weight))


_MEASURES: dict[int, Distances] = {}


def _measure(toxic: bytes, ordinary: bytes, thresholds: tuple[float, ...]) -> Distances:
    key = zlib.crc32(repr(thresholds).encode(), zlib.crc32(ordinary, zlib.crc32(toxic)))
    if key not in _MEASURES:
        _MEASURES.clear()
        _MEASURES[key] = Distances(toxic, ordinary, thresholds)
    return _MEASURES[key]


def score(docs: DataFrame, model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        share, fitted = shared.value
        for batch in batches:
            if fitted is None:
                out = np.full(batch.num_rows, share)
            else:
                toxic, ordinary, thresholds, mean, deviation, weights = fitted
                measured = _measure(toxic, ordinary, thresholds)
                parts = [measured.features(texts) for _, texts in row_blocks(batch.column(1))]
                z = ((np.vstack(parts) - mean) / deviation) @ weights if parts else np.empty(0)
                out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, score double")
