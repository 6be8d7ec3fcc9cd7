"""WARC archives: a writer with revisit records and a salvage reader.

``write`` stores one record per page. Pages with equal payloads of at least
``min_bytes`` share one ``response``, that of the largest page id; the others
are ``revisit`` records that name it and keep only the HTTP header. Records
are written by Spark's text writer, whose line end is the blank line that
ends a record, so archives land in any shared file system with the usual
commit protocol; files are bounded by records and by bytes.

``read`` takes archives (plain, or gzip with one member per record) as rows
of bytes and checks every record: version line, header, Content-Length,
record end, payload digest and gzip check sums. After a failed check it
searches for the next place where a whole record or member can begin (for
plain archives a version line at a line start, for gzip a member that can be
unpacked and holds a version line), goes on there, and logs the bytes between
as a quarantined gap with the reason. A record whose bytes agree with neither
its length nor its digest is quarantined, not returned.

Defined results: null html is an empty payload; a null page_id is written
without an id and read as null; of rows that share payload and largest id
all are responses; line ends inside a url become spaces, a null url is left
out; empty tables write no record and give an empty result; an empty file
has no record and no gap; other input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookrisk.llm.common import durable

VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_NEXT = re.compile(rb"(?:(?<=\n)|\A)WARC/1\.[01]\r?\n")
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Up to so many repeated payloads (some 16 MB of digests) are sent to every task; above it pages and digests are shuffled.
BROADCAST_DIGESTS = 200_000
RECORD = ("file string, offset long, length long, kind string, reason string, page_id long, uri string, record_type string, "
          "payload_bytes long, payload_digest string, refers_to long, payload binary")


# ------------------------------------------------------------------- writer
def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 (160 bits are 4 times 8 base32 digits)."""
    digest = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, record): the text of a WARC record without its last blank line."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.col(url_col).cast("string"), r"[\r\n]+", " ").alias("url"),
                     F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    p = p.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": sha1_base32(F.col("payload").cast("binary"))})
    # payloads that occur more than once, with the page that keeps them
    shared = durable(p.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("origin"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1").select(F.col("digest").alias("s_digest"), "origin"))
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared
    p = p.join(shared, F.col("digest") == F.col("s_digest"), "left")
    p = p.withColumn("origin", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("origin")), F.col("origin")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("origin").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", urn),
        line("WARC-Target-URI", F.col("url")), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Profile", F.when(revisit, PROFILE)), line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("origin").cast("string"), F.lit(">")))),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return p.select("page_id", F.concat(head, block).alias("record"))


def write(pages: DataFrame, path: str, records_per_file: int = 2000, bytes_per_file: int = 1 << 26, **how) -> None:
    """Write archives of ``pages`` into the folder ``path``. A file holds at
    most ``records_per_file`` records and, but for a single larger record,
    about ``bytes_per_file`` bytes: records go to files by their size, small
    ones ``records_per_file`` at a time, those above ``bytes_per_file`` over
    that number fewer at a time, 64 times larger ones fewer again."""
    rows = records(pages, **how).select("record", F.octet_length("record").alias("bytes"))
    html, url = (F.octet_length(F.col(how.get(c, d)).cast("string")) for c, d in (("html_col", "html"), ("url_col", "url")))
    largest = (pages.agg(F.max(F.coalesce(html, F.lit(0)) + F.coalesce(url, F.lit(0)))).first()[0] or 0) + 4096
    least, number = -1, records_per_file
    while True:
        most = bytes_per_file // number
        one = number == 1
        part = rows.where((F.col("bytes") > least) & (F.lit(one) | (F.col("bytes") <= most)))
        part.select("record").write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", number).text(path)
        if one or largest <= most:
            return
        least, number = most, max(1, number // 64)


# ------------------------------------------------------------------- reader
@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Damaged(ValueError):
    """A check of a record failed."""


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header without end")
    out: dict[str, str] = {}
    for row in data[at:end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            raise Damaged("broken header line")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out, end + 4


def parse_record(data: bytes, at: int) -> tuple[Record, int]:
    """The record that begins at ``at`` and where the next one begins."""
    m = VERSION.match(data, at)
    if not m:
        raise Damaged("no version line")
    headers, body = _headers(data, m.end())
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise Damaged("no content length")
    end = body + int(size)
    if end > len(data):
        raise Damaged("record cut off")
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("length does not meet the record end")
    block = data[body:end]
    record = Record(at, end + 4 - at, headers, block)
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha1:") and base32_sha1(payload_of(record)) != digest[5:].upper():
        raise Damaged("payload digest differs")
    return record, end + 4


def payload_of(record: Record) -> bytes:
    """The block after its HTTP header."""
    _, found, payload = record.block.partition(b"\r\n\r\n")
    return payload if found else b""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes, at: int, chunk: int = 1 << 16) -> tuple[bytes, int]:
    """The unpacked gzip member that begins at ``at`` and where it ends."""
    z, out = zlib.decompressobj(31), []
    while not z.eof:
        if at >= len(data):
            raise Damaged("gzip member cut off")
        try:
            out.append(z.decompress(data[at:at + chunk]))
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        at += chunk
    return b"".join(out), min(at, len(data)) - len(z.unused_data)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records that pass the checks, and the gaps between them."""
    zipped = data[:2] == MEMBER[:2] or (not _NEXT.search(data) and MEMBER in data)
    at, bad, reason = 0, None, ""
    while at < len(data):
        try:
            if zipped:
                if data[at:at + 3] != MEMBER:
                    raise Damaged("no gzip member")
                plain, after = _member(data, at)
                record, used = parse_record(plain, 0)
                if used != len(plain):
                    raise Damaged("bytes after the record in its member")
                record = Record(at, after - at, record.headers, record.block)
            else:
                record, after = parse_record(data, at)
        except Damaged as e:
            if bad is None:
                bad, reason = at, str(e)
            if zipped:
                following = data.find(MEMBER, at + 1)
            else:
                m = _NEXT.search(data, at + 1)
                following = m.start() if m else -1
            at = following if following >= 0 else len(data)
            continue
        if bad is not None:
            yield Gap(bad, at - bad, reason)
            bad = None
        yield record
        at = after
    if bad is not None:
        yield Gap(bad, len(data) - bad, reason)


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _row(file: str, x: Record | Gap, keep_payload: bool) -> tuple:
    if isinstance(x, Gap):
        return (file, x.offset, x.length, "gap", x.reason, *[None] * 7)
    h = x.headers
    payload = payload_of(x)
    if h.get("warc-type") == "revisit":  # its HTTP header still has the size of the payload
        size = re.search(rb"(?mi)^content-length:\s*(\d+)\s*$", x.block)
        n, digest = int(size[1]) if size else None, h.get("warc-payload-digest", "").removeprefix("sha1:").upper() or None
    else:
        n, digest = len(payload), base32_sha1(payload)
    return (file, x.offset, x.length, "record", None, _page(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"),
            n, digest, _page(h.get("warc-refers-to")), payload if keep_payload else None)


def read(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` (see RECORD) of all archives below ``path``."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                file = b.column(0)[i].as_py()
                for x in salvage(b.column(1)[i].as_py()):
                    rows.append(_row(file, x, keep_payload))
                    if len(rows) == 1000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, RECORD)
