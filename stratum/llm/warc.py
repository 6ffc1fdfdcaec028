"""WARC archives: a writer through Spark's own file commit, and a splittable reader.

Writer. Pages with equal payloads of at least MIN_REVISIT bytes are stored once: that of the largest page_id is a
response, the others revisit it. Each record is a gzip member (members of at most MEMBER bytes: a longer record takes several),
so its last byte, the top byte of the member's length, is zero. Spark's text writer puts its line separator after every row;
with a NUL separator it writes exactly the members, to any Hadoop file system, and commits files only of tasks that succeeded.

Reader. Files are cut into byte ranges. A task scans its range for the gzip magic, takes a candidate for a record
only if it inflates to a WARC version line and header, and owns the records that start inside its range, reading past the end for
the last one. Archives are opened with pyarrow's file systems; no file is read whole.

Defined results: a null html is an empty payload; a null url is stored as about:blank; rows repeating the
response's page_id are responses too; a null page_id comes back null (and revisits like any other page); an empty
table gives no records; extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, slices

MIN_REVISIT = 1000
MEMBER = 8 << 20
SPLIT = 4 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
HEADER_LIMIT = 1 << 20


def record(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC record; payload None: a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    block = http if payload is None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        lines[5:5] = [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes, level: int = LEVEL, size: int = MEMBER) -> bytes:
    out = []
    for at in range(0, len(data), size):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out.append(z.compress(data[at : at + size]) + z.flush())
    return b"".join(out)


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, level: int = LEVEL) -> None:
    """Writes a directory of archives. The join by digest is an ordinary one, so Spark splits a digest that many pages share."""
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    shared = rows.filter(F.col("n") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("ref"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    rows = rows.join(shared.drop("times"), "digest", "left")
    revisit = F.col("ref").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("ref"))
    rows = rows.select("page_id", "url", F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"), "n", "digest", "ref")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratum.llm.warc import members, record

        for batch in batches:
            for a, b in slices(batch.column(3).to_pylist(), 4 << 20):
                part = batch.slice(a, b - a)
                out = [members(record(*row), level) for row in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], ["member"])

    packed = rows.mapInArrow(pack, "member binary")
    packed.select(F.col("member").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


class Ranged:
    """Buffered reads at any offset of one file."""

    def __init__(self, handle, length: int, block: int = 1 << 18):
        self.handle, self.length, self.block = handle, length, block
        self.at, self.data = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.handle.seek(at)
            self.at, self.data = at, self.handle.read(max(n, self.block))
        return self.data[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int, end: int) -> int:
        """First offset of what that starts in at..end-1, or -1."""
        while at < end:
            chunk = self.read(at, min(self.block, end - at + len(what) - 1))
            if len(chunk) < len(what):
                return -1
            k = chunk.find(what)
            if k >= 0:
                return at + k if at + k < end else -1
            at += len(chunk) - len(what) + 1
        return -1


def _inflate(f: Ranged, at: int, enough: int | None) -> tuple[bytes, int] | None:
    """One gzip member from at: (bytes, offset after it), or its first ``enough`` bytes; None if it is no member."""
    z, out, total = zlib.decompressobj(31), [], 0
    step = 1 << 16
    try:
        while not z.eof:
            chunk = f.read(at, min(step, f.length - at))
            if not chunk:
                return None
            if enough is not None:
                out.append(z.decompress(chunk, max(1, enough - total)))
            else:
                out.append(z.decompress(chunk))
            total += len(out[-1])
            at += len(chunk)
            if enough is not None and total >= enough:
                return b"".join(out), at
    except zlib.error:
        return None
    return b"".join(out), at - len(z.unused_data)


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in data[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.lower()] = value.strip()
    if not {"warc-type", "warc-record-id", "content-length"} <= fields.keys() or not fields["content-length"].isdigit():
        return None
    return fields, end + 4


def records(f: Ranged, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of the records that start in start..end-1."""
    at = start
    while (at := f.find(MAGIC, at, end)) >= 0:
        peek = _inflate(f, at, 7)
        if peek is None or not peek[0].startswith(b"WARC/1."):
            at += 1
            continue
        first = _inflate(f, at, None)
        head = first and _header(first[0])
        if not head:
            at += 1
            continue
        data, after = first
        fields, skip = head
        need = skip + int(fields["content-length"])
        parts, have = [data], len(data)
        while have < need:  # a long record goes on in the members that follow
            more = _inflate(f, after, None)
            if more is None:
                raise ValueError(f"the record at byte {at} is cut short")
            parts.append(more[0])
            have, after = have + len(more[0]), more[1]
        yield fields, b"".join(parts)[skip:need]
        at = after


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(name)


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, path: str, split: int = SPLIT, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to and, if asked for, payload (null for revisits).

    Payload digests of responses are computed again; a difference from the header fails the job.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))
    n = max(1, ranges.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stratum.llm.warc import Ranged, _open, _page, records

        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + ([pa.binary()] if payloads else [])
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + (["payload"] if payloads else [])

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for file, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with _open(file) as handle:
                    for fields, block in records(Ranged(handle, length), start, min(start + split, length)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        kind = fields["warc-type"]
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{fields['warc-record-id']}: the payload does not fit its digest")
                        size = len(payload) if kind == "response" else int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                        row = [_page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, _page(fields.get("warc-refers-to"))]
                        if payloads:
                            row.append(payload if kind == "response" else None)
                            held += len(payload)
                        rows.append(row)
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    return ranges.repartition(min(n, 20_000)).mapInArrow(scan, schema)
