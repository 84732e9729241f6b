"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

Method of the reader: records are read one after the other, each its own gzip member or, in plain files, from one version line
to the next. Where a check fails (compressed data, version line, header, length, payload digest) it looks for the next valid
member or version line, goes on from there, and logs the byte gap as quarantined. A damaged record costs itself only.

Of records with equal payloads the one with the smallest key is a response, the others are revisits that refer to it.
Payloads below ``least`` bytes are all responses. Files are written by tasks into the shared folder and named by their
attempt, so a lost executor's work is written anew.

Defined results: a null payload is empty. A null key's record has no place in the order: it is a response, and revisits never
refer to it. Rows that share a key and a payload are all responses if the key is the smallest. Null urls are written as
``about:blank`` and read as null. An empty table gives no archive and no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField

from nameshift.llm.buffers import as_binary
from nameshift.llm.frames import longs, map_text, small_batches
from nameshift.llm.shared_files import Part, new_folder, read_stream
from nameshift.session import stage

VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
NO_URL = "about:blank"
GZIP = b"\x1f\x8b\x08"
#: Bytes read at a time.
CHUNK = 1 << 20
#: Headers that every record has by the standard.
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT_RECORD = re.compile(rb"\r\n\r\n(?=WARC/1\.[01]\r\n)")
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", re.I)
_DIGEST = re.compile(rb"\r\nwarc-payload-digest:[ \t]*sha1:([A-Z2-7]+)[ \t]*\r\n", re.I)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    """A header value: line breaks and other controls, blanks and the per cent sign are escaped."""
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _plain(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record. A revisit has the digest and length of its payload, but no block."""
    block = b"" if refers_to is not None else payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if key is None else key}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {NO_URL if url is None else _safe(url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member; its header has no time, so equal records are equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(ValueError):
    pass


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record that ``data`` begins with. Raises ``Damaged`` if a check fails."""
    if not (m := _VERSION_LINE.match(data)):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise Damaged("no end of the header")
    headers: dict[str, str] = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if missing := MANDATORY - headers.keys():
        raise Damaged(f"no {min(missing)}")
    length = headers["content-length"]
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    start = end + 4
    stop = start + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where its length says")
    block = data[start:stop]
    claimed = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and claimed.startswith("sha1:") and claimed[5:] != digest(block):
        raise Damaged("the payload does not have its digest")
    return headers, block, stop + 4


@dataclass
class Window:
    """A stream with a buffer that grows only as far as one record needs."""

    stream: object
    data: bytearray = field(default_factory=bytearray)
    base: int = 0
    ended: bool = False

    def more(self) -> bool:
        got = b"" if self.ended else self.stream.read(max(CHUNK, len(self.data)))
        self.ended = self.ended or not got
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.base += n


@dataclass(frozen=True)
class Gap:
    """A quarantined stretch of a file."""

    start: int
    end: int
    reason: str


def _inflate(window: Window) -> tuple[bytes, int]:
    """The content of the member at the window's start and its compressed length; chunks are read as needed."""
    z = zlib.decompressobj(31)
    out, fed = [], 0
    while True:
        try:
            out.append(z.decompress(bytes(memoryview(window.data)[fed:])))
        except zlib.error as error:
            raise Damaged(f"compressed data: {error}") from None
        fed = len(window.data)
        if z.eof:
            return b"".join(out), fed - len(z.unused_data)
        if not window.more():
            raise Damaged("the file ends inside a member")


def _header_end(window: Window) -> int:
    """Where the header at the window's start ends: at a blank line, however far, but before the next version line."""
    looked = 0
    while True:
        end = window.data.find(b"\r\n\r\n", max(0, looked - 3))
        other = _VERSION_LINE.search(window.data, max(1, looked - len(VERSION)))
        if other and (end < 0 or other.start() < end):
            raise Damaged("no end of the header")
        if end >= 0:
            return end
        looked = len(window.data)
        if not window.more():
            raise Damaged("no end of the header")


def _plain_record(window: Window) -> tuple[dict[str, str], bytes, int]:
    """The record at the window's start; reads on until its header and block are there.

    Where a version line follows a blank line inside the block, the digest tells whether the block ends there, so that a damaged
    length does not pull in the rest of the file; without a digest the next record does.
    """
    while not _VERSION_LINE.match(window.data) and len(window.data) < len(VERSION) and window.more():
        pass
    if not _VERSION_LINE.match(window.data):
        raise Damaged("no version line")
    end = _header_end(window)
    header = bytes(window.data[: end + 2])
    if not (m := _LENGTH.search(header)):
        raise Damaged("no content length")
    stop = end + 8 + int(m[1])
    claimed = _DIGEST.search(header)
    sum_, summed = hashlib.sha1(), end + 4
    looked = end + 4
    while len(window.data) < stop:
        if not window.more():
            break
        limit = min(len(window.data), stop - 4)
        for other in _NEXT_RECORD.finditer(window.data, max(end + 4, looked - len(VERSION) - 4), min(len(window.data), stop)):
            if other.start() >= limit or other.start() < summed:
                continue
            sum_.update(memoryview(window.data)[summed : other.start()].tobytes())
            summed = other.start()
            if not claimed or base64.b32encode(sum_.digest()) == claimed[1].upper():
                raise Damaged("the block ends before its length")
        looked = len(window.data)
    return parse_record(bytes(memoryview(window.data)[:stop]))


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes] | Gap]:
    """Records and gaps of one archive, compressed or plain, in order. What lies between valid records is a gap."""
    window = Window(stream)
    bad: tuple[int, str] | None = None

    def gap(end: int) -> Iterator[Gap]:
        nonlocal bad
        if bad and bad[0] < end:
            yield Gap(bad[0], end, bad[1])
        bad = None

    while window.data or window.more():
        zipped = bytes(window.data[:3])
        try:
            if zipped == GZIP:
                content, used = _inflate(window)
                headers, block, length = parse_record(content)
                if length != len(content):
                    raise Damaged("a member holds more than a record")
            else:
                headers, block, used = _plain_record(window)
            yield from gap(window.base)
            yield headers, block
            window.drop(used)
        except Damaged as damage:
            bad = bad or (window.base, str(damage))
            window.drop(1)
            while True:  # the next member or version line
                at = [i for i in (window.data.find(GZIP), window.data.find(b"WARC/1.")) if i >= 0]
                if at:
                    window.drop(min(at))
                    break
                window.drop(max(0, len(window.data) - 6))
                if not window.more():
                    window.drop(len(window.data))
                    break
    yield from gap(window.base)


@dataclass
class Archives:
    """``files``: uri, records, bytes."""

    files: DataFrame


def payload_digests(pages: DataFrame) -> DataFrame:
    """``page_id``, ``n`` (payload bytes) and ``sha1`` of every row with a key."""

    def make():
        def function(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
            raw = memoryview(data.tobytes())
            sums = [base64.b32encode(hashlib.sha1(raw[a:b]).digest()).decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            return [longs(np.diff(offs)), pa.array(sums, pa.string())]

        return function

    return map_text(pages, "html", make, [StructField("n", LongType()), StructField("sha1", StringType())], ["page_id"])


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, compressed: bool = True, folder: str | None = None) -> Archives:
    """Writes a record for every row: a file for each task, in the order of the rows dealt to it."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    sums = stage(payload_digests(rows.where("page_id IS NOT NULL")).where(F.col("n") >= least), "payloads")
    first = sums.groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    revisits = stage(sums.join(first, ["sha1", "n"]).where("page_id > first").select("page_id", "sha1", "first").distinct(), "revisits")
    joined = rows.join(revisits.groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("sha1", "first"))).alias("refers")), "page_id", "left")
    schema = pa.schema([("uri", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for batch in batches:
            payloads = as_binary(batch.column(2))
            for i in range(batch.num_rows):
                out = out or Part(folder, TaskContext.get().partitionId(), ".warc.gz" if compressed else ".warc")
                page, payload = batch.column(0)[i].as_py(), payloads[i].as_py()
                refers = dict(batch.column(3)[i].as_py() or ())
                data = record(page, batch.column(1)[i].as_py(), payload, refers.get(digest(payload)) if refers else None)
                out.write(member(data) if compressed else data)
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [out.uri], "records": [n], "bytes": [out.size]}, schema=schema)

    files = small_batches(joined).select("page_id", "url", "html", "refers").mapInArrow(run, "uri string, records long, bytes long")
    return Archives(stage(files, "archives"))


FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, uri string, gap_start long, gap_end long, gap_reason string"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("uri", pa.string()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("gap_reason", pa.string())])


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the files in ``uri``, and a row for every quarantined gap (``gap_start`` is then not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                with read_stream(uri) as stream:
                    for item in read_archive(stream):
                        if isinstance(item, Gap):
                            rows.append({"uri": uri, "gap_start": item.start, "gap_end": item.end, "gap_reason": item.reason})
                            continue
                        headers, block = item
                        target = headers.get("warc-target-uri")
                        rows.append(
                            {
                                "page_id": _page(headers.get("warc-record-id")),
                                "url": None if target in (None, NO_URL) else _plain(target),
                                "record_type": headers.get("warc-type"),
                                "payload_bytes": int(headers.get("x-payload-length", len(block))),
                                "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:"),
                                "refers_to": _page(headers.get("warc-refers-to")),
                                "payload": block if payloads and headers.get("warc-type") != "revisit" else None,
                                "uri": uri,
                            }
                        )
                        held += len(block) if payloads else 0
                        if len(rows) >= 1000 or held > 4 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    n = max(1, files.count())
    return files.select("uri").repartition(n).mapInArrow(run, FIELDS)


def records(found: DataFrame) -> DataFrame:
    return found.where("gap_start IS NULL").drop("gap_start", "gap_end", "gap_reason")


def gaps(found: DataFrame) -> DataFrame:
    return found.where("gap_start IS NOT NULL").select("uri", "gap_start", "gap_end", "gap_reason")


def archive_files(spark: SparkSession, uris: list[str]) -> DataFrame:
    return spark.createDataFrame([(u,) for u in uris], "uri string")


#: The records of ``pages`` with ``least`` 0.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     f AS (SELECT h, min(page_id) AS first FROM p WHERE page_id IS NOT NULL GROUP BY h),
     x AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex, first FROM p LEFT JOIN f USING (h))
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, i // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1) for i in range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM x
"""
