"""Legacy web archives: ARC records in, WARC records out, and both read back.

``write_arc`` stores pages as ARC files, version 1 or 2, whose header line
ends in the declared length of the block after it. ``read_arc`` parses the
version line, takes the fields that it names and cuts blocks by declared
lengths alone, so a block may hold anything, header lines too. ``to_warc``
synthesises what ARC lacks: record ids (version 5 UUIDs of page and digest),
ISO timestamps, record types and base32 SHA-1 digests; among records of equal
payload of at least ``dedup_from`` bytes the one with the largest page id is
the response and the others are revisits that name it. ``read_warc`` cuts by
Content-Length and checks every digest.

Archives are written by Spark's text writer to any file system it knows, with
fast gzip over the whole file. A file closes once it holds ``FILE_BYTES``, and
readers inflate it as a stream, so memory depends on that and on the largest
page. Equal payloads are matched by digest and length through an aggregate,
never gathered. The first reading of the ARC files takes digests alone; which
records are revisits then travels as one small list a file (bounded, as files
are) to the second, which writes the WARC files, so payloads are never dealt
out by key.

Defined cases: a page may be as long as a Spark string; a null page is an empty payload; a null url is written as
``urn:page:<id>``, and blanks and line ends in a url are escaped; a null
page_id is kept apart (written as "-") and never refers nor is referred to;
rows with equal page_id and payload count as one response each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialise, new_path, release

#: Bytes of records, before compression, after which an archive file closes.
FILE_BYTES = 32 << 20
#: Compressed bytes inflated at a time, and rows given out together.
_STEP, _ROWS = 1 << 16, 1024
#: Pages without a capture time of their own carry this one.
CAPTURED = "20240101000000"
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_END = "\r\n\r\n"


class Inflated:
    """The bytes of a file, inflated as far as they are asked for: all gzip members, or the bytes themselves."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.have, self.start = memoryview(data), 0, bytearray(), 0
        self.zipped = bytes(self.data[:2]) == b"\x1f\x8b"
        self.member = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.start > _STEP:
            del self.have[: self.start]
            self.start = 0
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + _STEP]
        self.at += len(part)
        if not self.zipped:
            self.have += part
            return True
        self.have += self.member.decompress(part)
        while self.member.eof and (rest := self.member.unused_data):
            self.member = zlib.decompressobj(31)
            self.have += self.member.decompress(rest)
        if self.member.eof:
            self.member = zlib.decompressobj(31)
        return True

    def until(self, end: bytes) -> bytes | None:
        """What stands before the next ``end``, which is passed over; None if there is none."""
        seen = self.start
        while (found := self.have.find(end, seen)) < 0:
            seen = max(self.start, len(self.have) - len(end) + 1)
            moved = self.start
            if not self._more():
                return None
            seen -= moved - self.start
        out = bytes(self.have[self.start : found])
        self.start = found + len(end)
        return out

    def take(self, n: int) -> bytes:
        """The next n bytes; fewer at the end."""
        while len(self.have) - self.start < n and self._more():
            pass
        out = bytes(self.have[self.start : self.start + n])
        self.start += len(out)
        return out

    def skip(self, blanks: bytes) -> bool:
        """Passes over such bytes; whether anything follows."""
        while True:
            while self.start < len(self.have):
                if self.have[self.start] not in blanks:
                    return True
                self.start += 1
            if not self._more():
                return False


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_header(version: int = 1) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 loglathe\n{V1_FIELDS if version == 1 else V2_FIELDS}\n".encode()
    middle = "text/plain" if version == 1 else "text/plain 200 - - 0 pages.arc"
    return f"filedesc://pages.arc 0.0.0.0 {CAPTURED} {middle} {len(body)}\n".encode() + body


def arc_record(url: str, payload: bytes, version: int = 1, captured: str = CAPTURED) -> bytes:
    middle = "text/html" if version == 1 else f"text/html 200 {sha1_base32(payload)} - 0 pages.arc"
    return f"{url} 0.0.0.0 {captured} {middle} {len(payload)}\n".encode() + payload


def parse_arc(data: bytes | Inflated) -> Iterator[dict]:
    """Records of an ARC file, or of several end to end: the fields that the last version block names, and ``payload``.

    Blank lines between records are passed over.
    """
    names, version = None, 1
    file = data if isinstance(data, Inflated) else Inflated(data)
    while file.skip(b"\r\n"):
        line = file.until(b"\n")
        if line is None:
            raise ValueError("the last ARC header line has no end")
        fields = line.decode("utf-8").rstrip("\r").split(" ")
        length = int(fields[-1])
        block = file.take(length)
        if len(block) < length:
            raise ValueError(f"the last ARC block is cut short: {len(block)} of {length} bytes")
        if names is None or fields[0].startswith("filedesc://"):
            first, second = block.split(b"\n")[:2]
            version = int(first.split(b" ")[0])
            names = second.decode().rstrip("\r").split(" ")
            continue
        if len(fields) != len(names):
            raise ValueError(f"ARC header has {len(fields)} fields, version {version} names {len(names)}")
        yield dict(zip(names, fields, strict=True)) | {"payload": block}


def warc_date(stamp: str) -> str:
    """An ARC timestamp of 14 digits (or fewer, then the earliest such time) as WARC wants it."""
    full = stamp + "00000101000000"[len(stamp) :]
    return datetime.strptime(full, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def warc_record(url: str, date: str, page: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One record without the two line ends that close it. A revisit has no block; its payload's length is kept in a field."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {page}"]
    block = payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {len(payload)}"]
        block = b""
    else:
        head.append("Content-Type: text/html")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes | Inflated) -> Iterator[dict]:
    """Records of a WARC file: header fields in lower case and ``block``."""
    file = data if isinstance(data, Inflated) else Inflated(data)
    while file.skip(b"\r\n"):
        head = file.until(b"\r\n\r\n")
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError("what follows the last WARC record is none")
        fields = {}
        for line in head.decode("utf-8").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = file.take(length)
        if len(block) < length:
            raise ValueError(f"WARC block of {fields.get('warc-record-id')} is cut short: {len(block)} of {length} bytes")
        yield fields | {"block": block}


def _row(records: list[bytes], between: str) -> pa.RecordBatch:
    """One row of text that becomes one file; bytes as they are."""
    return pa.RecordBatch.from_arrays([pa.array([between.encode().join(records)], pa.binary()).view(pa.string())], ["value"])


def _filled(records: Iterable[bytes], between: str, most: int, head: bytes | None = None) -> Iterator[pa.RecordBatch]:
    """Records as rows of ``most`` bytes or as little more as the last record takes; ``head`` opens each."""
    held, size = [], 0
    for r in records:
        if head and not held:
            held.append(head)
        held.append(r)
        size += len(r)
        if size >= most:
            yield _row(held, between)
            held, size = [], 0
    if held:
        yield _row(held, between)


def _write(rows: DataFrame, path: str, end: str) -> None:
    """A file for each row; Spark's writer adds ``end`` and compresses."""
    rows.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def _files(spark, path: str) -> DataFrame:
    """file (its name) and content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= _ROWS or size >= FILE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def page_key(page_id: Column) -> Column:
    return F.coalesce(page_id.cast("string"), F.lit("-"))


def write_arc(pages: DataFrame, path: str, version: int = 1, file_bytes: int = FILE_BYTES) -> None:
    """Pages as ARC files, each opened by its version block."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for part in parts:
                for page, url, html in zip(*(part.column(i) for i in range(3)), strict=True):
                    page, url = page.as_py(), url.as_py()
                    where = quote(url if url is not None else f"urn:page:{page}", safe="".join(map(chr, range(33, 127)))) + f"#page={page}"
                    yield arc_record(where, html.as_py() or b"", version)

        return _filled(records(), "\n", file_bytes, arc_header(version))

    _write(pages.select(page_key(F.col("page_id")).alias("page"), "url", F.col("html").cast("binary").alias("html")).mapInArrow(rows, "value string"), path, "\n")


def _place(record: dict) -> tuple[str, str]:
    """url, page"""
    url, _, page = record["URL"].rpartition("#page=")
    return url, page


def read_arc(spark, path: str, payloads: bool = True) -> DataFrame:
    """file, k (place there), page (text), url, date, digest, n (bytes) and, if asked for, payload of every record of the ARC files in a folder."""
    fields = [("file", pa.string()), ("k", pa.int64()), ("page", pa.string()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("n", pa.int64())]
    schema = pa.schema([*fields, *([("payload", pa.binary())] if payloads else [])])

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                for name, data in zip(*part.columns, strict=True):
                    for k, r in enumerate(parse_arc(Inflated(data.as_buffer()))):
                        url, page = _place(r)
                        payload = r["payload"]
                        row = (name.as_py(), k, page, url, warc_date(r["Archive-date"]), sha1_base32(payload), len(payload))
                        yield (*row, payload) if payloads else row

        return _batches(rows(), schema)

    out = "file string, k long, page string, url string, date string, digest string, n long"
    return _files(spark, path).mapInArrow(parse, out + ", payload binary" if payloads else out)


def revisits(records: DataFrame, dedup_from: int = 0) -> DataFrame:
    """file, of: for each file with any the records (k) that revisit, and the page they refer to."""
    known = records.where((F.col("n") >= dedup_from) & (F.col("page") != "-")).select("file", "k", "digest", "n", F.col("page").cast("decimal(38,0)").alias("page_no"))
    largest = known.groupBy("digest", "n").agg(F.max("page_no").alias("best"), F.count(F.lit(1)).alias("copies"))
    largest = largest.where(F.col("copies") > 1).select("digest", "n", "best")
    found = known.join(largest, ["digest", "n"]).where(F.col("page_no") < F.col("best"))
    # A file holds a bounded number of records.
    return found.groupBy("file").agg(F.collect_list(F.struct("k", F.col("best").cast("string").alias("best"))).alias("of"))


def to_warc(spark, arc: str, path: str, dedup_from: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """The ARC files of a folder as WARC files, revisits told from responses."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for part in parts:
                for data, of in zip(*part.columns, strict=True):
                    refers = {r["k"]: r["best"] for r in of.as_py() or ()}
                    for k, r in enumerate(parse_arc(Inflated(data.as_buffer()))):
                        url, page = _place(r)
                        payload = r["payload"]
                        yield warc_record(url, warc_date(r["Archive-date"]), page, payload, sha1_base32(payload), refers.get(k))

        return _filled(records(), _END, file_bytes)

    seen = materialise(read_arc(spark, arc, False), "arc-records")
    again = materialise(revisits(seen, dedup_from), "revisits")
    files = _files(spark, arc).join(again, "file", "left").select("content", "of")
    _write(files.mapInArrow(rows, "value string"), path, _END)
    release(seen, again)


def read_warc(spark, path: str) -> DataFrame:
    """page, payload_bytes, payload_digest, record_type, refers_to, record_id, date of every record; a block that its digest belies is an error."""
    text, number = pa.string(), pa.int64()
    schema = pa.schema([("page", text), ("payload_bytes", number), ("payload_digest", text), ("record_type", text), ("refers_to", text), ("record_id", text), ("date", text)])

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                for data in part.column(0):
                    for r in parse_warc(Inflated(data.as_buffer())):
                        digest, kind = r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"]
                        if kind == "response" and sha1_base32(r["block"]) != digest:
                            raise ValueError(f"record {r['warc-record-id']} does not match its digest")
                        n = len(r["block"]) if kind == "response" else int(r["x-payload-length"])
                        yield r["x-page-id"], n, digest, kind, r.get("x-refers-to-page"), r["warc-record-id"], r["warc-date"]

        return _batches(rows(), schema)

    return _files(spark, path).select("content").mapInArrow(parse, "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, date string")


def convert(pages: DataFrame, version: int = 1, dedup_from: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC files say of each page."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages.select("page_id", "url", "html"), arc, version, file_bytes)
    to_warc(spark, arc, warc, dedup_from, file_bytes)
    drop_path(spark, arc)
    back = read_warc(spark, warc)
    kind = pages.schema["page_id"].dataType
    return back.select(F.when(F.col("page") != "-", F.col("page")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
