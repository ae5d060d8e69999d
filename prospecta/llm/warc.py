"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. The reader deals out byte ranges of the files: a task scans its
range for the gzip magic, validates a candidate by decoding the WARC header behind it, owns the
records whose member starts inside the range, and reads past its end to finish the last one. From the
first valid member on it goes from member to member.

Written pages: a null payload is empty. Of equal payloads of at least REVISIT_BYTES bytes the one with the
smallest page id is the response (each of its repeated rows is), the others revisit it; smaller payloads
are all responses. Null ids and URLs are kept as such; a null id never wins over another id. Empty tables write no file.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.llm.cluster import scratch
from prospecta.llm.storage import list_files, make_dir, open_input, qualified, write_whole

REVISIT_BYTES, FILE_BYTES, SPLIT_BYTES, READ_BYTES, LEVEL = 100, 32 << 20, 16 << 20, 1 << 20, 6
MAGIC, VERSION, DATE = b"\x1f\x8b\x08", b"WARC/1.1\r\n", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADER = re.compile(rb"WARC/1\.[01]\r\n(?:[!#$%&'*+.^_`|~0-9A-Za-z-]+:[^\r\n]*\r\n)*\r\n")


def with_revisits(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the response's id for revisits, else null.

    Only ids and digests are grouped; the digests that occur more than once meet the pages again.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    shared = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A gzip member with one record."""
    lines = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id, url, payload: bytes, digest: str, refers_to, name: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", f"<urn:x-page:{name}>"), ("WARC-Date", DATE)]
    fields += [] if page_id is None else [("WARC-Page-ID", str(page_id))]
    fields += [] if url is None else [("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", str(refers_to))], http)


def write_warc(pages: DataFrame, target: str | None = None, id_col="page_id", url_col="url", payload_col="html", file_bytes: int = FILE_BYTES) -> str:
    """Write the archives of ``pages`` and return their folder."""
    spark = pages.sparkSession
    target = qualified(spark, target or scratch(spark, "warc"))
    make_dir(target)

    def run(batches):
        part, seq, held, size, count = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush():
            name = f"{target}/part-{part:06d}-{seq:05d}.warc.gz"
            info = record("warcinfo", [("WARC-Record-ID", f"<urn:x-file:{part}-{seq}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            write_whole(name, [info, *held])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], ["file", "n"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, payload, digest, refers_to = row
                held.append(page_record(page_id, url, payload.encode(), digest, refers_to, f"{part}-{seq}-{count}"))
                size, count = size + len(held[-1]), count + 1
                if size >= file_bytes:
                    yield flush()
                    held, size, count, seq = [], 0, 0, seq + 1
        if held:
            yield flush()

    with_revisits(pages, id_col, url_col, payload_col).mapInArrow(run, "file string, n long").agg(F.sum("n")).collect()
    return target


class _Window:
    """Bytes of a file from ``at`` on, read ahead in pieces; ``data[0]`` is at ``base``."""

    def __init__(self, file, at: int) -> None:
        self.file, self.base, self.data = file, at, b""
        self.size = file.size()

    def more(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.data += self.file.read_at(min(READ_BYTES, self.size - at), at)
        return True

    def drop(self, n: int) -> None:
        self.base, self.data = self.base + n, self.data[n:]


def _decoded(window: _Window, at: int, head_only: bool):
    """(bytes, length of the member) of the member at an offset of the window; None if it isn't a WARC record.

    With ``head_only`` decoding stops after the header.
    """
    inflate, out, used, whole = zlib.decompressobj(31), [], at, None
    try:
        while not inflate.eof:
            if used >= len(window.data) and not window.more():
                return None
            piece = window.data[used : used + READ_BYTES]
            out.append(inflate.decompress(piece))
            used += len(piece) - len(inflate.unused_data)
            if whole is None:
                start = b"".join(out)
                if not b"WARC/1.".startswith(start[:7]):
                    return None
                if b"\r\n\r\n" in start:
                    whole = _HEADER.match(start)
                    if whole is None:
                        return None
                    if head_only:
                        return start, 0
                out = [start]
    except zlib.error:
        return None
    return (b"".join(out), used - at) if whole else None


def records_of(file, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records whose gzip member starts in [start, stop)."""
    window, inside = _Window(file, start), False
    while window.base < stop:
        if not inside:
            while (at := window.data.find(MAGIC)) < 0:
                window.drop(max(0, len(window.data) - len(MAGIC) + 1))
                if window.base >= stop or not window.more():
                    return
            if window.base + at >= stop:
                return
            window.drop(at)
            if _decoded(window, 0, True) is None:
                window.drop(1)
                continue
        found = _decoded(window, 0, False)
        if found is None:
            if not inside or (not window.data and not window.more()):
                window.drop(1)
                inside = False
                continue
            raise ValueError(f"a gzip member at {window.base} is not a WARC record")
        raw, length = found
        head = _HEADER.match(raw)
        fields = dict(line.split(": ", 1) for line in head[0].decode().split("\r\n")[1:-2] if ": " in line)
        size = int(fields["Content-Length"])
        if len(raw) < head.end() + size:
            raise ValueError(f"the record at {window.base} is cut short")
        yield window.base, fields, raw[head.end() : head.end() + size]
        window.drop(length)
        inside = True
        if not window.data and not window.more():
            return


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit record of a folder's archives.

    Columns: file, offset, page_id, url, record_type, payload_bytes, payload_digest, refers_to, and payload
    (binary; null for revisits) with ``with_payload``. A response's length and digest are computed from what was
    read and must equal its header; a revisit's are those of the payload that it stands for.
    """
    files = list_files(qualified(spark, folder), ".warc.gz")
    schema = "file string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    splits = [(name, at, min(at + split_bytes, size)) for name, size in files for at in range(0, size, split_bytes)]
    if not splits:
        return spark.createDataFrame([], schema)

    def run(batches):
        arrow = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in schema.split(", "))])
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for name, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with open_input(name) as file:
                    for offset, fields, block in records_of(file, start, stop):
                        kind = fields.get("WARC-Type")
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response":
                            size, own = len(payload), hashlib.sha256(payload).hexdigest()
                            if own != digest:
                                raise ValueError(f"the payload at {name}:{offset} has another digest")
                        else:
                            size, payload = int(re.search(rb"(?i)content-length: *(\d+)", http)[1]), None
                        rows.append((name, offset, number(fields.get("WARC-Page-ID")), fields.get("WARC-Target-URI"), kind, size, digest, number(fields.get("WARC-Refers-To-Page-ID")), payload)[: len(arrow)])
                        held += len(payload or b"") * with_payload
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)

    dealt = spark.createDataFrame(splits, "file string, start long, stop long").repartition(min(len(splits), 4096), "file", "start")
    return dealt.mapInArrow(run, schema)
