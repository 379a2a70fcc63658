"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Archives are written by Spark's own text sink, so they can lie in any store it reaches. Each row is one
record as a gzip member; the sink's line separator is an empty gzip member, so every file is a valid
multi-member ``.warc.gz`` stream. The reader takes whole files, checks every member, record length and
payload digest, and after a failure searches on for the next member or version line that passes, in the file and
inside a member. Of a member that is cut or fails its check, the responses whose payloads match their digests are kept.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.shared import prepare

# Fixed values of the format.
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_STEP = 1 << 16
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


@dataclass(frozen=True)
class ArchiveSettings:
    revisit_bytes: int = 1000  # shorter payloads are always written in full
    date: str = "2024-01-01T00:00:00Z"  # of all records, so that reruns write the same bytes
    records_per_file: int = 2000
    bytes_per_file: int = 1 << 26  # and no more than one record beyond; a reader's task holds a file


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _header(value: str) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def digest_label(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record. A revisit keeps the HTTP headers, with the payload's length, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: {digest_label(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(settings: ArchiveSettings):
    """Records as members, with the number of the file of this task that they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = 0
        for batch in batches:
            out, parts, held = [], [], 0
            for page_id, url, html, refers_to, revisit in zip(
                batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["payload"],
                batch["refers_to"].to_pylist(), batch["revisit"].to_pylist(),
            ):
                record = make_record(page_id, url, html.as_py() or b"", refers_to, revisit, settings.date)
                out.append(gzip.compress(record, 6, mtime=0))
                parts.append(filled // settings.bytes_per_file)
                filled += len(out[-1])
                held += len(out[-1])
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(parts, pa.int64())], ["value", "part"])
                    out, parts, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(parts, pa.int64())], ["value", "part"])

    return run


def write_archives(pages: DataFrame, path: str, settings: ArchiveSettings = ArchiveSettings()) -> None:
    """One record per row of ``pages`` (page_id, url, html, anything else).

    Of rows with equal payloads of at least ``revisit_bytes``, those with the largest page_id become
    responses (more than one only if rows repeat) and the others revisits of it. A null page_id is
    smaller than any other. A null html is an empty payload, a null url leaves its header out.
    """
    spark = pages.sparkSession
    prepare(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    largest = (
        rows.where(F.octet_length("payload") >= settings.revisit_bytes)
        .groupBy(F.col("digest").alias("same"))
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    long = F.octet_length("payload") >= settings.revisit_bytes
    joined = rows.join(largest, (F.col("digest") == F.col("same")) & long, "left")
    revisit = F.coalesce(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False))
    members = joined.select("page_id", "url", "payload", "refers_to", revisit.alias("revisit")).mapInArrow(
        _members(settings), "value binary, part long"
    )
    (
        members.select(F.col("value").cast("string").alias("value"), "part")
        .write.partitionBy("part")
        .option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("maxRecordsPerFile", settings.records_per_file)
        .text(path)
    )


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in lines if b":" in line)
    return {name.strip().decode("latin-1").lower(): value.strip().decode("utf-8", "replace") for name, value in pairs}


class _Blank:
    """The next blank line in a text; one that was found serves every place before it."""

    def __init__(self, data: bytes):
        self.data, self.found = data, -1

    def after(self, at: int) -> int:
        if self.found is not None and self.found < at:
            place = self.data.find(b"\r\n\r\n", at)
            self.found = place if place >= 0 else None
        return -1 if self.found is None else self.found


def _parse(data: bytes, at: int, blank: _Blank) -> tuple[Record, int] | None:
    """The record that begins at ``at`` and where it ends, or None if any check fails."""
    if not data.startswith(VERSION, at):
        return None
    split = blank.after(at)
    if split < 0:
        return None
    headers = _fields(data[at:split].split(b"\r\n")[1:])
    if not headers.get("content-length", "").isdecimal():
        return None
    start, size = split + 4, int(headers["content-length"])
    if start + size > len(data) or data[start + size : start + size + 4] != b"\r\n\r\n":
        return None
    http, _, payload = data[start : start + size].partition(b"\r\n\r\n")
    record = Record(headers, _fields(http.split(b"\r\n")[1:]), payload)
    if headers.get("warc-type") == "response" and headers.get("warc-payload-digest") != digest_label(payload):
        return None
    return record, start + size + 4


def _inflate(data: memoryview, at: int) -> tuple[bytes, int | None]:
    """What can be unpacked of the gzip member at ``at``, and where it ends; None if it is cut or fails a check."""
    unpack, out, size = zlib.decompressobj(31), [], len(data)
    while at < size:
        piece, before = data[at : at + _STEP], unpack.copy()
        try:
            out.append(unpack.decompress(piece))
        except zlib.error:
            return b"".join([*out, *_up_to_the_failure(before, piece)]), None
        at += len(piece)
        if unpack.eof:
            return b"".join(out), at - len(unpack.unused_data)
    return b"".join(out), None


def _up_to_the_failure(unpack: zlib._Decompress, piece: memoryview) -> Iterator[bytes]:
    """A piece that fails gives nothing; its halves are tried until the failing byte is alone."""
    while len(piece) > 1:
        half, before = piece[: len(piece) // 2], unpack.copy()
        try:
            yield unpack.decompress(half)
            piece = piece[len(half) :]
        except zlib.error:
            unpack, piece = before, half


@dataclass(frozen=True)
class Gap:
    """Bytes that were left out: of the file, or, where ``inside`` is set, of the unpacked member at ``offset``."""

    offset: int
    size: int
    inside: int | None = None


_VERSION_LINE = re.compile(re.escape(VERSION))
_START = re.compile(re.escape(GZIP_MAGIC) + b"|" + re.escape(VERSION))


def _records(plain: bytes, sound: bool) -> Iterator[Record | tuple[int, int]]:
    """Records of an unpacked member, and (offset, length) of what is none; of an unsound one only proven responses."""
    blank, at, bad = _Blank(plain), 0, None
    while at < len(plain):
        found = _parse(plain, at, blank)
        if found is not None and (sound or found[0].headers.get("warc-type") == "response"):
            if bad is not None:
                yield bad, at - bad
                bad = None
            yield found[0]
            at = found[1]
            continue
        if bad is None:
            bad = at
        following = _VERSION_LINE.search(plain, at + 1)
        at = following.start() if following else len(plain)
    if bad is not None:
        yield bad, len(plain) - bad


def salvage(content: bytes) -> Iterator[Record | Gap]:
    """Records of an archive in order, and the gaps of bytes that had to be left out.

    A sound member is passed over whole, with gaps inside where a record is not. After anything else the search goes on
    at the next byte that could begin a member or a record.
    """
    data, blank, at, bad = memoryview(content), _Blank(content), 0, None
    while at < len(content):
        found: list[Record | Gap] = []
        end = None
        if content.startswith(GZIP_MAGIC, at):
            plain, end = _inflate(data, at)
            pieces = list(_records(plain, end is not None))
            saved = any(isinstance(piece, Record) for piece in pieces)
            if end is not None and (saved or not plain):
                found = [p if isinstance(p, Record) else Gap(at, p[1], p[0]) for p in pieces]
            else:
                end = None
                found = [piece for piece in pieces if isinstance(piece, Record)]
        else:
            record = _parse(content, at, blank)
            if record is not None:
                found, end = [record[0]], record[1]
        if bad is not None and (end is not None or found):
            if at > bad:
                yield Gap(bad, at - bad)
            bad = None
        yield from found
        if end is not None:
            at = end
            continue
        if bad is None:
            bad = at
        following = _START.search(content, at + 1)
        at = following.start() if following else len(content)
    if bad is not None:
        yield Gap(bad, len(content) - bad)


_COLUMNS = (
    "archive string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary, gap_offset long, gap_bytes long, gap_inside long"
)


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _row(archive: str, found: Record | Gap, payloads: bool) -> dict:
    if isinstance(found, Gap):
        return {"archive": archive, "gap_offset": found.offset, "gap_bytes": found.size, "gap_inside": found.inside}
    kind = found.headers.get("warc-type")
    row = {
        "archive": archive,
        "page_id": _number(found.headers.get("warc-record-id")),
        "url": found.headers.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _number(found.headers.get("warc-refers-to")),
    }
    if kind == "revisit":
        label = found.headers.get("warc-payload-digest", "").removeprefix("sha1:")
        size = found.http.get("content-length", "")
        return row | {
            "payload_bytes": int(size) if size.isdecimal() else None,
            "payload_digest": base64.b32decode(label).hex() if label else None,
        }
    return row | {
        "payload_bytes": len(found.payload),
        "payload_digest": hashlib.sha1(found.payload).hexdigest(),
        "payload": found.payload if payloads else None,
    }


def _read(payloads: bool):
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _COLUMNS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                rows, held = [], 0
                for found in salvage(content.as_py()):
                    rows.append(_row(path, found, payloads))
                    held += len(rows[-1].get("payload") or b"") + 200
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record, and one per quarantined byte range (``gap_bytes`` not null) of the files in ``path``.

    A gap lies in the file from ``gap_offset`` on, or, where ``gap_inside`` is not null, from there on in the unpacked
    member at ``gap_offset``. Records before the damage of a broken member are also rows, if their payloads match.
    A response's size and digest are those of the payload that was read; a revisit's are what its headers
    say of the payload it stands for. An empty folder gives no rows. One file is read by one task, which
    ``records_per_file`` and ``bytes_per_file`` of the writer bound.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(payloads), _COLUMNS)
