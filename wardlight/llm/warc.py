"""WARC records in ZIP packages: written by partition, read by range.

A package stores ``archive/data.warc.gz`` (one gzip member a record) and
``indexes/index.cdx`` (place, length and id of each record). The reader parses the
end record, the ZIP64 records if they are there, and the central directory, takes the
place of stored members from their local headers, reads the index, and then range-reads
records; nothing is extracted. Records of a package are read in runs of at most
``RUN`` bytes, each a task's work of its own, so a large package is no large task.

Rows without page_id take no part. A null html is an empty payload, a null url leaves
its header out. Of equal payloads of at least ``least`` bytes the record with the
largest page_id holds the payload and the others revisit it; rows that repeat that
page_id are all responses. Only page_id, url and html are read; an empty table gives
no rows.
"""

import base64
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .columns import lookup
from .files import create, new_folder, one_task_each, open_range

LEAST = 1000
RUN = 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Fixed value: the profile of revisits whose payload digest equals the other record's.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Member(NamedTuple):
    name: str
    method: int
    header: int
    size: int


def directory(source) -> list[Member]:
    """Members of a ZIP package from its central directory."""
    size = source.size()
    tail_at = max(0, size - 65557)
    source.seek(tail_at)
    tail = source.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record: not a ZIP package")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20:end - 16] == b"PK\x06\x07":
        source.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        record = source.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where the locator says")
        count, length, at = struct.unpack_from("<QQQ", record, 32)
    source.seek(at)
    data, found, k = source.read(length), [], 0
    for _ in range(count):
        if data[k:k + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", data, k + 10)
        _, whole, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, k + 20)
        header, = struct.unpack_from("<I", data, k + 42)
        name = data[k + 46:k + 46 + n_name].decode()
        if 0xFFFFFFFF in (whole, header):
            whole, header = _large(data[k + 46 + n_name:k + 46 + n_name + n_extra], whole, data[k + 20:k + 24] == b"\xff" * 4, header)
        found.append(Member(name, method, header, whole))
        k += 46 + n_name + n_extra + n_note
    return found


def _large(extra: bytes, whole: int, packed: bool, header: int) -> tuple[int, int]:
    """Size and header place from the ZIP64 field, which holds only the values that did not fit, in order."""
    k = 0
    while k + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, k)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
            whole = next(values) if whole == 0xFFFFFFFF else whole
            if packed:
                next(values)
            return whole, next(values) if header == 0xFFFFFFFF else header
        k += 4 + n
    raise ValueError("no ZIP64 field")


def stored_range(source, member: Member) -> tuple[int, int]:
    """First and end byte of a stored member's data."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    source.seek(member.header)
    header = source.read(30)
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    start = member.header + 30 + n_name + n_extra
    return start, start + member.size


def _header(text: str) -> bytes:
    """One header value; control characters and blanks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text).encode("utf-8", "surrogatepass")


def record(page_id: int, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit that keeps only the HTTP headers."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%d>" % page_id,
             b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha1:" + base64.b32encode(digest)]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _header(url))
    if refers_to is not None:
        lines += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + PROFILE.encode()]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; payload is empty for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    block = rest[:int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields[b"warc-type"].decode()
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != base64.b32decode(fields[b"warc-payload-digest"].removeprefix(b"sha1:"))):
        raise ValueError("payload does not match its record")
    number = lambda name: int(fields[name].rsplit(b":", 1)[1].rstrip(b">")) if name in fields else None
    return {"page_id": number(b"warc-record-id"), "url": fields[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in fields else None,
            "payload_bytes": length, "payload_digest": base64.b32decode(fields[b"warc-payload-digest"].removeprefix(b"sha1:")).hex(),
            "record_type": kind, "refers_to": number(b"warc-refers-to"), "payload": payload if kind == "response" else None}


def write_packages(pages: DataFrame, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one package a partition; the table of committed packages (uri, records)."""
    folder = new_folder(pages.sparkSession, "packages")
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).where("page_id IS NOT NULL")
    rows = rows.withColumn("digest", F.sha1("payload"))
    keepers = stored(rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
                     .where("n > 1").select("digest", "keeper"))
    rows = lookup(rows, keepers, ["digest"], "left", F.col("page_id")).select(
        "page_id", "url", "payload", "digest", F.when((F.length("payload") >= least) & (F.col("page_id") < F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: list[str] = []
        uri, out, package, member, place = f"{folder}/{uuid.uuid4().hex}.wacz", None, None, None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = create(uri)
                    package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                page_id, url, payload, digest, refers_to = row
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = pack.compress(record(page_id, url, payload, bytes.fromhex(digest), refers_to, date)) + pack.flush()
                member.write(data)
                index.append(f"{place} {len(data)} {page_id}\n")
                place += len(data)
        if out is not None:
            member.close()
            package.writestr(zipfile.ZipInfo(INDEX), "".join(index))
            package.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([len(index)], pa.int64())})

    return stored(rows.mapInArrow(write, "uri string, records long"))


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the packages named in column uri; ``payloads`` says whether to return them."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_range(uri) as source:
                    members = {m.name: m for m in directory(source)}
                    base, _ = stored_range(source, members[DATA])
                    start, end = stored_range(source, members[INDEX])
                    source.seek(start)
                    lengths: list[int] = []
                    begin = place = 0
                    for line in source.read(end - start).splitlines():
                        n = int(line.split(b" ")[1])
                        if lengths and place + n - begin > RUN:
                            yield _run(uri, base + begin, lengths)
                            begin, lengths = place, []
                        lengths.append(n)
                        place += n
                    if lengths:
                        yield _run(uri, base + begin, lengths)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_range(row["uri"]) as source:
                    source.seek(row["start"])
                    data = memoryview(source.read(sum(row["lengths"])))
                found, place = [], 0
                for n in row["lengths"]:
                    fields = parse(zlib.decompress(data[place:place + n], 31))
                    found.append(fields if payloads else fields | {"payload": None})
                    place += n
                yield pa.RecordBatch.from_pylist(found, _SCHEMA)

    table = stored(one_task_each(packages.select("uri")).mapInArrow(runs, "uri string, start long, lengths array<long>"))
    return one_task_each(table).mapInArrow(read, RECORD)


def _run(uri: str, start: int, lengths: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"uri": [uri], "start": pa.array([start], pa.int64()), "lengths": pa.array([lengths], pa.list_(pa.int64()))})


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper > page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (d)"""
