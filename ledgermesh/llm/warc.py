"""WARC archives: a writer with revisit records, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.llm.common import batches_of_rows, stage, text_of

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/\d\.\d+\r?\n")
_VERSION_LINE = re.compile(rb"(?<=\n)WARC/\d\.\d+\r?\n")
_MEMBER = b"\x1f\x8b\x08"
_INFLATED = 1 << 16  # compressed bytes taken at once
READ = (
    "path string, offset long, length long, kind string, reason string, warc_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary"
)
READ_ARROW = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("reason", pa.string()),
    ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, five hexadecimal digits to four letters at a time."""
    code = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(code, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2026-01-01T00:00:00Z", file_records: int = 2000,
    file_bytes: int = 1 << 27,
) -> None:
    """Writes one WARC/1.1 record per row of ``pages`` (page_id, url, html) to files under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the largest
    page_id becomes a response and the others revisit it; smaller payloads are all
    responses. Rows without page_id, or that repeat the largest one, are responses too.
    A null html is an empty payload and a null url an empty one; control characters and
    spaces in a url are dropped, so that it stays on its line. An empty table writes files
    without records. Other columns are ignored. Records are whole rows of a text sink whose
    line separator is the record separator, at most ``file_records`` to a file.
    """
    rows = pages.select(
        "page_id", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]+", "").alias("url"),
        text_of("html").alias("html"),
    ).withColumn("code", F.sha2("html", 256))
    large = F.octet_length("html") >= least_bytes
    kept = stage(
        rows.filter(large).groupBy("code").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1"), "payloads"
    ).select(F.col("code").alias("first_code"), "first_id")
    joined = rows.join(kept, F.col("code") == F.col("first_code"), "left")
    revisit = F.coalesce(large & (F.col("page_id") < F.col("first_id")), F.lit(False))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.octet_length("html").cast("string"), F.lit(END + END),
    )
    joined = joined.withColumn("revisit", revisit).withColumn(
        "body", F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    )
    name = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: "), name, F.lit(f"{END}WARC-Date: {date}{END}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{END}Content-Type: application/http;msgtype=response{END}WARC-Payload-Digest: sha1:"),
        base32_sha1(F.col("html").cast("binary")),
        F.lit(f"{END}WARC-Block-Digest: sha1:"), base32_sha1(F.col("body").cast("binary")),
        F.when(F.col("revisit"), F.concat(
            F.lit(f"{END}WARC-Profile: {PROFILE}{END}WARC-Refers-To: <urn:x-page:"), F.col("first_id").cast("string"), F.lit(">"),
        )).otherwise(F.lit("")),
        F.lit(f"{END}Content-Length: "), F.octet_length("body").cast("string"), F.lit(END + END), F.col("body"),
    )
    size = F.octet_length("html")
    short, longest = file_bytes // file_records, rows.agg(F.max(size)).first()[0] or 0
    parts = [(joined.filter(size <= short), file_records)]
    if longest > short:
        parts.append((joined.filter(size > short), max(1, file_bytes // longest)))
    for some, most in parts:
        written = some.select(record.alias("value")).write.mode("append").option("lineSep", END * 2)
        written.option("maxRecordsPerFile", most).text(path)


def _fields(head: bytes) -> dict[str, str]:
    """Fields of a header. Only line feeds end its lines: a value may hold other characters that Unicode counts as line ends or spaces."""
    found: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        name, mark, value = line.partition(":")
        if mark:
            found[name.strip(" \t\r").lower()] = value.strip(" \t\r")
    return found


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class _Places:
    """Next places of what the reader looks for, each byte searched once per pattern as the reader moves on."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.known: dict[object, int] = {}

    def after(self, pattern: bytes | re.Pattern, at: int) -> int:
        """First place from ``at`` on, the length of the data if there is none."""
        found = self.known.get(pattern, -1)
        if found < at:
            if isinstance(pattern, bytes):
                found = self.data.find(pattern, at)
            else:
                match = pattern.search(self.data, at)
                found = match.start() if match else -1
            self.known[pattern] = found = found if found >= 0 else len(self.data)
        return found


def _plain_record(places: _Places, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the record at ``at``; ValueError says which check failed."""
    data = places.data
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    end = places.after(b"\r\n\r\n", at)
    if end == len(data):
        raise ValueError("header without end")
    if places.after(_VERSION_LINE, at + 1) < end:
        raise ValueError("header of more than one record")
    fields = _fields(data[at:end])
    names = [line.partition(b":")[0].strip().lower() for line in data[at:end].split(b"\n")[1:] if line[:1] not in b" \t"]
    if len(names) != len(fields):  # a line without a colon, or a field told twice: the header runs into another
        raise ValueError("header of more than one record")
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    stop = end + 4 + int(length)
    if stop > len(data):
        raise ValueError("block longer than the file")
    if stop < len(data) and data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record separator missing")
    block = data[end + 4 : stop]
    told = fields.get("warc-block-digest", "")
    if told.lower().startswith("sha1:") and told[5:].upper() != _digest(block):
        raise ValueError("block digest differs")
    return fields, block, min(stop + 4, len(data))


def _record(places: _Places, at: int) -> tuple[dict[str, str], bytes, int]:
    data = places.data
    if data[at : at + 3] != _MEMBER:
        return _plain_record(places, at)
    member, parts, stop = zlib.decompressobj(31), [], at
    try:
        while not member.eof and stop < len(data):
            parts.append(member.decompress(data[stop : stop + _INFLATED]))
            stop += _INFLATED
    except zlib.error as error:
        raise ValueError(f"member: {error}") from None
    if not member.eof:
        raise ValueError("member without end")
    plain = b"".join(parts)
    fields, block, end = _plain_record(_Places(plain), 0)
    if end != len(plain):
        raise ValueError("member holds more than a record")
    return fields, block, min(stop, len(data)) - len(member.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, str, str, dict[str, str], bytes]]:
    """(offset, length, kind, reason, fields, block) of the records and gaps of an archive.

    Where a record fails its checks, the bytes from there are quarantined up to the next
    version line or compressed member at which a record passes them all; the gap tells
    the first failure. Every byte of the file lies in exactly one record or gap. Places to
    resume at are remembered, so damage costs no more than the bytes it spans.
    """
    at, gap, why, places = 0, -1, "", _Places(data)
    while at < len(data):
        try:
            fields, block, end = _record(places, at)
        except ValueError as error:
            if gap < 0:
                gap, why = at, str(error)
            at = min(places.after(_VERSION, at + 1), places.after(_MEMBER, at + 1))
            continue
        if gap >= 0:
            yield gap, at - gap, "gap", why, {}, b""
            gap = -1
        yield at, end - at, "record", "", fields, block
        at = end
    if gap >= 0:
        yield gap, len(data) - gap, "gap", why, {}, b""


def _row(path: str, offset: int, length: int, kind: str, reason: str, fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    if kind == "gap":
        return path, offset, length, kind, reason, None, None, None, None, None, None, None
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not fields.get("content-type", "").startswith("application/http") or not mark:
        head, payload = b"", block
    revisit = fields.get("warc-type") == "revisit"
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:").upper()
    size = int(n) if revisit and (n := _fields(head).get("content-length", "")).isdigit() else len(payload)
    return (
        path, offset, length, kind, None, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"),
        fields.get("warc-refers-to"), told if revisit else _digest(payload), size, payload if payloads else None,
    )


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``, plain or with one compressed member per record.

    Columns: path, offset, length, kind (record or gap), reason (of a gap), warc_type,
    record_id, target_uri, refers_to, payload_digest (of the payload as read; a revisit
    tells that of the payload it stands for), payload_bytes, payload. A file is read as a
    whole by one task, so archives should be cut to a size that memory holds. An empty file
    has no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                yield from batches_of_rows((_row(name, *found, payloads) for found in salvage(data)), READ_ARROW, 256)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter("length > 0").select("path", "content").mapInArrow(rows, READ)


def log_gaps(read: DataFrame, path: str) -> None:
    """Writes the quarantined byte ranges as JSON lines: path, offset, length, reason."""
    read.filter("kind = 'gap'").select("path", "offset", "length", "reason").write.json(path)


def page_of(name: str) -> Column:
    return F.regexp_extract(name, r"<urn:x-page:(-?\d+)>", 1).try_cast("long")
