"""WARC records in ZIP packages: a writer, and a reader that ranges over stored members without extracting them.

A package is a ZIP file in the folder that driver and executors share. It holds archive/data.warc.gz (records one after
another, each a gzip member of its own; stored) and indexes/index.cdx (a line a record: offset, length, page id;
stored). The reader opens packages through the file system and asks for ranges only: the end of the file, the central
directory (and the ZIP64 end record where sizes or counts need it), local headers, the index piece by piece, and each
record; nothing is extracted.

Writers stream records into their packages, each bounded by PACKAGE_BYTES and PACKAGE_RECORDS, plus one record. A
package's path is new for each attempt of a task, and a table of paths that Spark commits names those that count, so
what a lost executor had begun is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import tables_dir

from .common import materialize, table, utf8

PACKAGE_BYTES, PACKAGE_RECORDS = 16 << 20, 4096
#: Bytes of an index that are read at once.
INDEX_BYTES = 1 << 16
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Compression of a record.
LEVEL = 4
#: Fixed values of the ZIP format: signatures, sizes of fixed parts, the tag of the ZIP64 extra field, the "see ZIP64" marks.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR64_SIZE, END64_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
TAG64, FULL16, FULL32 = 1, 0xFFFF, 0xFFFFFFFF

#: read(offset, length) of a package, and its length
ReadAt = Callable[[int, int], bytes]


class Member(NamedTuple):
    name: str
    method: int
    size: int
    packed: int
    header: int


def members(read: ReadAt, length: int) -> dict[str, Member]:
    """The central directory's entries by name; ValueError if there is none."""
    tail_at = max(0, length - END_SIZE - FULL16)
    tail = read(tail_at, length - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    end_at = tail_at + at
    if FULL16 == count or FULL32 in (size, offset):
        where = read(end_at - LOCATOR64_SIZE, LOCATOR64_SIZE) if end_at >= LOCATOR64_SIZE else b""
        if where[:4] == LOCATOR64:
            record = read(struct.unpack_from("<Q", where, 8)[0], END64_SIZE)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, size, offset = struct.unpack_from("<QQQ", record, 32)
    directory, found, at = read(offset, size), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, end = at + CENTRAL_SIZE + n_name, at + CENTRAL_SIZE + n_name + n_extra
        while extra + 4 <= end:
            tag, n = struct.unpack_from("<HH", directory, extra)
            if tag == TAG64:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", directory, extra + 4))
                full, packed, header = (next(wide) if x == FULL32 else x for x in (full, packed, header))
            extra += 4 + n
        found[name] = Member(name, method, full, packed, header)
        at = end + n_comment
    return found


def data_offset(read: ReadAt, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method != zipfile.ZIP_STORED:
        raise ValueError(f"{m.name} is compressed; only stored members can be range-read")
    head = read(m.header, LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {m.name}")
    return m.header + LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26))


def write_record(record_type: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A WARC/1.1 record and its payload digest. A revisit holds no payload; its length stays in an extension field."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = payload if record_type == "response" else b""
    url = "".join(c for c in url or "" if c >= " ")
    fields = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html", f"Content-Length: {len(body)}",
    ]
    if record_type == "revisit":
        fields[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", digest


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields (names in lower case) and body. ValueError if a length or digest doesn't hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't hold")
    return fields, rest[:n]


class PackageWriter:
    """Streams records into a package; out is a binary file object, which need not be seekable."""

    def __init__(self, out, wide: bool = False) -> None:
        """wide: with ZIP64 fields even where they aren't needed."""
        self.out, self.wide, self.index, self.n, self.at = out, wide, [], 0, 0
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
        self.warc = self.zip.open(zipfile.ZipInfo(WARC), "w", force_zip64=wide)

    def add(self, record: bytes, page_id: int | None) -> None:
        packed = gzip.compress(record, LEVEL, mtime=0)
        self.index.append(f"{self.at} {len(packed)} {'-' if page_id is None else page_id}\n")
        self.warc.write(packed)
        self.n += 1
        self.at += len(packed)

    @property
    def full(self) -> bool:
        return self.n >= PACKAGE_RECORDS or self.at >= PACKAGE_BYTES

    def close(self) -> None:
        self.warc.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=self.wide) as f:
            f.write("".join(self.index).encode())
        self.zip.close()


def lines(read: ReadAt, at: int, size: int) -> Iterator[str]:
    """The lines of a range, read piece by piece."""
    held = b""
    for begin in range(at, at + size, INDEX_BYTES):
        *whole, held = (held + read(begin, min(INDEX_BYTES, at + size - begin))).split(b"\n")
        yield from (x.decode() for x in whole)
    if held:
        yield held.decode()


def records(read: ReadAt, length: int) -> Iterator[bytes]:
    """A package's records, range by range, as its index has them."""
    found = members(read, length)
    index, warc = found[INDEX], found[WARC]
    at, base = data_offset(read, index), data_offset(read, warc)
    for line in lines(read, at, index.size):
        offset, n, _ = line.split(" ", 2)
        if int(offset) + int(n) > warc.size:
            raise ValueError("the index points outside the archive")
        yield gzip.decompress(read(base + int(offset), int(n)))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI as Hadoop writes it: file:/x, file:///x, hdfs://, s3a://, or a plain path."""
    scheme, _, rest = uri.partition(":") if ":" in uri else ("file", "", uri)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{rest}")


PACKAGES = "path string, bytes long, records long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (page_id, url, payload, record_type, refers_to) to rows of PACKAGES."""
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        w, name = None, ""

        def done() -> pa.RecordBatch:
            w.close()
            w.out.close()
            size = store.get_file_info(f"{root}/{name}").size
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([w.n], pa.int64())], names=["path", "bytes", "records"])

        for b in batches:
            for page_id, url, payload, kind, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if w is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    w = PackageWriter(store.open_output_stream(f"{root}/{name}"))
                w.add(write_record(kind, page_id, url, payload, refers_to)[0], page_id)
                if w.full:
                    yield done()
                    w = None
        if w is not None:
            yield done()

    return run


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, body binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(x: str | None) -> int | None:
        x = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        for path in b.column(0).to_pylist():
            store, at = opened(path)
            rows, size = [], 0
            with store.open_input_file(at) as f:
                for raw in records(lambda at, n, f=f: f.read_at(n, at), f.size()):
                    fields, body = parse_record(raw)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError("a payload's digest doesn't hold")
                    page_id, refers_to = number(fields["warc-record-id"]), number(fields.get("warc-refers-to"))
                    rows.append((page_id, fields["warc-target-uri"], fields["warc-type"], refers_to, int(fields["x-payload-length"]), digest, body))
                    size += len(body)
                    if len(rows) == 512 or size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, html) as packages: a table with the path, bytes and records of each.

    Of records with equal payloads of at least min_bytes, that with the largest page_id is a response and the others
    are revisits of it; rows that repeat that page_id are responses too. A null html is an empty payload; pages of any
    length are whole records. Where no row of a payload has a page_id all are responses. Other columns have no
    influence. An empty table gives no packages.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", utf8(F.col("html")).alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    # an aggregate with one row a digest and task, then a join that can split a digest's rows
    long_enough = keyed.where(F.octet_length("payload") >= min_bytes)
    last = long_enough.groupBy(F.col("digest").alias("last_digest")).agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = keyed.join(last, F.col("digest") == F.col("last_digest"), "left")
    revisit = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    kind = F.when(revisit, "revisit").otherwise("response").alias("record_type")
    judged = joined.select("page_id", "url", "payload", kind, F.when(revisit, F.col("last_id")).alias("refers_to"))
    folder = f"{tables_dir(spark)}/warc-{uuid.uuid4().hex}"
    return materialize(judged.mapInArrow(_write(folder), PACKAGES), "packages")


def read_archive(packages: DataFrame) -> DataFrame:
    """The records of packages (their paths in column path) with their bodies; a task reads some packages one after another."""
    spark = packages.sparkSession
    tasks = min(max(1, packages.count()), 16 * spark.sparkContext.defaultParallelism)
    return packages.select("path").repartition(tasks).mapInArrow(_read, READ)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    packages = archive(table(spark, sf_dir, "pages"))
    return read_archive(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY sha1(b)) AS last_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM d
"""
