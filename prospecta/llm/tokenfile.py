"""Token-id files: a concatenated id array and Elias-Fano encoded document boundaries.

A file holds the ids of consecutive documents in ascending document id order. Boundaries (where each
document ends) and document ids are non-decreasing sequences; each is kept in Elias-Fano form: the low
bits packed, the high parts as set bits of a vector whose one-counts are sampled for select. That is
about 2 + log2(ids / documents) bits a document instead of 64. Ids take two bytes where the vocabulary
has at most 65,536 entries, four otherwise, little-endian.

Defined results: a null text counts as empty; every document ends with END_ID. Null document ids come
first. Repeated ids stay separate documents, in the order of a hash of their text. Empty tables write no file.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.llm.cluster import scratch
from prospecta.llm.storage import list_files, make_dir, open_input, qualified, write_whole
from prospecta.llm.textblocks import UnitTable, row_blocks

MAGIC, END_ID, FILE_IDS, SAMPLE = b"EFTOK\x00\x00\x01", 0, 16 << 20, 256
_HEAD = struct.Struct("<8sIIQQQq")
_PART = struct.Struct("<QQIQQQ")


class EliasFano:
    """A non-decreasing sequence of integers below ``universe``."""

    def __init__(self, n, universe, low_bits, low, high, samples) -> None:
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.zeros((n, bits), np.uint8)
        for k in range(bits):
            low[:, k] = (values >> np.uint64(k)) & np.uint64(1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(n + (universe >> bits) + 1, np.uint8)
        high[ones] = 1
        return cls(n, universe, bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample, scan the high bits for the i-th one, then add the low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, wanted, width = int(self.samples[i // SAMPLE]), i % SAMPLE, 64
        while True:
            first = at // 8
            found = np.flatnonzero(np.unpackbits(self.high[first : first + width], bitorder="little")[at - 8 * first :])
            if len(found) > wanted:
                break
            width *= 2
        value = at + int(found[wanted]) - i
        for k in range(self.low_bits - 1, -1, -1):
            bit = i * self.low_bits + k
            value = value << 1 | (int(self.low[bit >> 3]) >> (bit & 7) & 1)
        return value

    def blocks(self) -> Iterator[np.ndarray]:
        """All values, SAMPLE at a time: a batch select from each sample to the next. Nothing of the sequence's length is built."""
        weights = 1 << np.arange(self.low_bits, dtype=np.int64)
        for k, first in enumerate(self.samples.tolist()):
            i, n = k * SAMPLE, min(SAMPLE, self.n - k * SAMPLE)
            stop = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
            bits = np.unpackbits(self.high[first >> 3 : (stop + 7) >> 3], bitorder="little")
            ones = np.flatnonzero(bits[first & 7 :])[:n] + first
            at, end = i * self.low_bits, (i + n) * self.low_bits
            low = np.unpackbits(self.low[at >> 3 : (end + 7) >> 3], bitorder="little")[at & 7 :][: end - at]
            yield ((ones - np.arange(i, i + n)) << self.low_bits) + low.reshape(n, self.low_bits).astype(np.int64) @ weights

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return _PART.pack(self.n, self.universe, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, universe, bits, *sizes = _PART.unpack_from(data, at)
        at, got = at + _PART.size, []
        for size, kind in zip(sizes, ("u1", "u1", "<u4"), strict=True):
            got.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, universe, bits, *got), at


class TokenFile:
    """A file read back: ``ids``, ``doc_ids`` and the offsets of each document."""

    def __init__(self, data: bytes) -> None:
        magic, width, _, self.n_docs, self.n_ids, self.n_null, self.least = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends, at = EliasFano.read(data, _HEAD.size)
        self.own, at = EliasFano.read(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> Iterator[int | None]:
        yield from itertools.repeat(None, self.n_null)
        for block in self.own.blocks():
            yield from (block + self.least).tolist()


def file_bytes(doc_ids: list, sizes: list[int], ids: np.ndarray) -> list[bytes]:
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = EliasFano.of(np.cumsum(np.array(sizes, np.int64)), len(ids) + 1)
    own = EliasFano.of((known - least).astype(np.uint64), int(known[-1]) - least + 1 if len(known) else 1)
    head = _HEAD.pack(MAGIC, ids.dtype.itemsize, 0, len(doc_ids), len(ids), len(doc_ids) - len(known), least)
    return [head, ends.to_bytes(), own.to_bytes(), ids.tobytes()]


#: Units start where the tokenizer never joins text: at a run of spaces and line feeds, between a word and
#: the punctuation after it, and after that punctuation.
#: A word without punctuation after it goes on to the next space; nothing is gained by giving characters back.
_UNIT = re.compile(r"[ \n]?[^\W\d_]++(?:(?=[.,;:!?])|[^ \n]*+)|[.,;:!?]++(?=[ \n])|[ \n]*+[^ \n]++|[ \n]++")
#: With other white space, or with an added token of the tokenizer (<|endoftext|>), a whole text goes to the tokenizer at once.
# What either library may take for white space, but for the space and the line feed.
_OTHER_SPACE = [chr(c) for c in (0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]


class Encoder:
    """Ids of whole texts from a byte-level BPE file; a worker encodes each distinct unit once."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # Units of letters behind at most one space are one piece to the pre-tokenizer, so it can skip its
        # pattern; joined by a special token, which such a unit can't hold, they are encoded in one call.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.mark = Tokenizer.from_str(tokenizer_json), next((t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and not t.content.isalpha()), None)
        self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.mark_id = None if self.mark is None else self.tokenizer.token_to_id(self.mark)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.table = UnitTable(self._units, self.dtype)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = np.fromiter((self.mark is not None and (u[1:] if u[0] == " " else u).isalpha() for u in units), bool, len(units))
        start, size = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        others = self._encode([u for u, p in zip(units, plain, strict=True) if not p])
        size[~plain] = np.fromiter(map(len, others), np.int64, len(others))
        parts = [np.fromiter(itertools.chain.from_iterable(others), self.dtype, int(size[~plain].sum()))]
        start[~plain] = np.cumsum(size[~plain]) - size[~plain]
        if plain.any():
            joined = self.mark + self.mark.join(u for u, p in zip(units, plain, strict=True) if p)
            ids = np.array(self.pieces.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            marks = np.flatnonzero(ids == self.mark_id)
            start[plain] = marks + 1 + len(parts[0])
            size[plain] = np.diff(marks, append=len(ids)) - 1
            parts.append(ids)
        return np.concatenate(parts), start, size

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        units, counts, whole = [], [], {}
        for k, text in enumerate(texts):
            if any(c in text for c in _OTHER_SPACE) or any(c in text for c in self.added):
                whole[k] = np.array(self._encode([text])[0], self.dtype)
                counts.append(0)
            else:
                own = _UNIT.findall(text)
                units += own
                counts.append(len(own))
        flat, sizes = self.table.expand(self.table.rows(units))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)] if counts else []
        parts = np.split(flat, ends[:-1]) if len(counts) else []
        return [whole.get(k, part) for k, part in enumerate(parts)]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(tokenizer_json: str) -> Encoder:
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]


def write_tokens(docs: DataFrame, tokenizer_path: str, target: str | None = None, id_col="doc_id", text_col="text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the token files of ``docs`` below ``target``; their manifest: file, n_docs, n_ids, start.

    Documents are dealt by ranges of their id, so the files in name order hold ascending ids. The manifest
    has one row a file of ``file_ids`` ids, the only thing that comes to the driver.
    """
    spark = docs.sparkSession
    target = qualified(spark, target or scratch(spark, "tokens"))
    make_dir(target)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        encoder, part, seq = _encoder(shared.value), TaskContext.get().partitionId(), 0
        own, sizes, ids, held = [], [], [], 0

        def flush():
            name = f"{target}/part-{part:06d}-{seq:05d}.eft"
            write_whole(name, file_bytes(own, sizes, np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(own)]), pa.array([held])], ["file", "n_docs", "n_ids"])

        end = np.array([END_ID], encoder.dtype)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, texts in row_blocks(batch.column(1)):
                for k, got in enumerate(encoder(texts)):
                    own.append(doc_ids[at + k])
                    sizes.append(len(got) + 1)
                    ids += [got, end]
                    held += sizes[-1]
                if held >= file_ids:
                    yield flush()
                    own, sizes, ids, held, seq = [], [], [], 0, seq + 1
        if own:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("t"))
    files = rows.mapInArrow(run, "file string, n_docs long, n_ids long").toArrow().sort_by("file")
    n = np.asarray(files.column("n_ids"))
    files = files.append_column("start", pa.array(np.cumsum(n) - n))
    return spark.createDataFrame(files) if files.num_rows else spark.createDataFrame([], "file string, n_docs long, n_ids long, start long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the manifest's files, read back from them."""

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with open_input(name) as f:
                    held = TokenFile(f.read())
                own, start = held.doc_ids(), 0
                for ends in held.ends.blocks():
                    starts = np.concatenate([[start], ends[:-1]]).astype(np.int64)
                    start = int(ends[-1])
                    crc = [zlib.crc32(held.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    ids = list(itertools.islice(own, len(ends)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition("file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder of token files, from the files' headers."""
    rows, start = [], 0
    for name, _ in list_files(qualified(spark, folder), ".eft"):
        with open_input(name) as f:
            _, _, _, docs, ids, _, _ = _HEAD.unpack(f.read(_HEAD.size))
        rows.append((name, docs, ids, start))
        start += ids
    return spark.createDataFrame(rows, "file string, n_docs long, n_ids long, start long")
