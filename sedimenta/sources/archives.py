"""ZIP archives as a partitioned source and sink (S3, S13, W12, K4): members are read by byte ranges, never extracted or held whole.

The driver reads each archive's directory at its end (ZIP64 included) by offset. Stored members are cut into ranges of
bytes, and each range gives the lines that begin in it; deflated ones can't be cut and stream through one task each.
Files are opened through Arrow's file systems.
"""

from __future__ import annotations

import csv
import fnmatch
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath
from uuid import uuid4
from zipfile import ZIP_STORED, ZipFile, ZipInfo

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from sedimenta.operators.ordering import placed

CHUNK, ROWS = 1 << 20, 8192
#: Signatures and lengths of a ZIP archive's parts.
END, END64_AT, END64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
END_LENGTH, LONGEST_NOTE, ENTRY_LENGTH, LOCAL_LENGTH, WIDE = 22, 0xFFFF, 46, 30, 0xFFFFFFFF
STORED, DEFLATED = 0, 8


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is local."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a member's data; its data follow the header at `header`."""

    archive: str
    member: str
    method: int
    header: int
    size: int
    start: int
    end: int


def safe_member(name: str) -> bool:
    """A relative path that stays inside the archive."""
    p = PurePosixPath(name)
    return not p.is_absolute() and ".." not in p.parts and "\\" not in name


def members(read, size: int) -> Iterator[tuple[str, int, int, int]]:  # noqa: ANN001
    """(name, method, header's offset, stored size) of each member; read(n, at) gives bytes. ValueError for what is no archive.

    A member that would leave the archive's folder, is encrypted or packed in another way is an error.
    """
    tail_at = max(0, size - END_LENGTH - LONGEST_NOTE)
    tail = read(size - tail_at, tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no ZIP archive")
    length, begin = struct.unpack_from("<II", tail, at + 12)
    if tail[max(0, at - 20) : at].startswith(END64_AT):
        (end64,) = struct.unpack_from("<Q", tail, at - 12)
        record = read(56, end64)
        if not record.startswith(END64):
            raise ValueError("broken ZIP64 record")
        length, begin = struct.unpack_from("<QQ", record, 40)
    directory, at = read(length, begin), 0
    while at < len(directory):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("broken directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + ENTRY_LENGTH : at + ENTRY_LENGTH + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + ENTRY_LENGTH + n_name : at + ENTRY_LENGTH + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # the wide values, those only whose narrow one is full
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == WIDE else plain
                packed = wide.pop(0) if packed == WIDE else packed
                header = wide.pop(0) if header == WIDE else header
            extra = extra[4 + n :]
        if not safe_member(name) or flags & 1 or method not in (STORED, DEFLATED):
            raise ValueError(f"member {name!r} can't be read")
        yield name, method, header, packed
        at += ENTRY_LENGTH + n_name + n_extra + n_note


def lines_of(read, part: Range) -> Iterator[tuple[int, bytes]]:  # noqa: ANN001
    """(offset in the member, line without its end) of the lines that begin in a range. read(n, at) is never asked for more than CHUNK."""
    head = read(LOCAL_LENGTH, part.header)
    if not head.startswith(LOCAL):
        raise ValueError(f"broken header of {part.member!r}")
    data = part.header + LOCAL_LENGTH + sum(struct.unpack_from("<HH", head, 26))
    if part.method == DEFLATED:
        unpack = zlib.decompressobj(-15)

        def pieces() -> Iterator[bytes]:
            for k in range(0, part.size, CHUNK):
                packed = read(min(CHUNK, part.size - k), data + k)
                while packed:
                    yield unpack.decompress(packed, CHUNK)
                    packed = unpack.unconsumed_tail
            yield unpack.flush()

        at, rest, source = 0, b"", pieces()
    else:
        # from the byte before: a line begins in a range if its newline before does
        at, rest = max(0, part.start - 1), b""
        source = (read(min(CHUNK, part.size - k), data + k) for k in range(at, part.size, CHUNK))
    skip = part.method == STORED and part.start > 0
    for piece in source:
        found = (rest + piece).split(b"\n")
        for line in found[:-1]:
            if not skip:
                if part.method == STORED and at >= part.end:
                    return
                yield at, line.removesuffix(b"\r")
            skip = False
            at += len(line) + 1
        rest = found[-1]
        if part.method == STORED and at >= part.end and not skip:
            return
    if rest and not skip and (part.method == DEFLATED or at < part.end):
        yield at, rest.removesuffix(b"\r")


class ZipReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.pattern = options["path"], options.get("member", "*.csv")
        self.bytes = int(options.get("rangebytes", 32 << 20))
        self.columns = schema.names
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality with an archive or member leaves out partitions; Spark keeps the others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("archive",), ("member",)):
                here = self.wanted.setdefault(f.attribute[0], {f.value})
                here &= {f.value}
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, at = store_of(self.path)
        info = store.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        out = []
        for file in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(".zip")), key=lambda f: f.path):
            if file.path not in self.wanted.get("archive", {file.path}):
                continue
            with store.open_input_file(file.path) as f:
                for name, method, header, size in members(lambda n, k, f=f: f.read_at(n, k), file.size):
                    if fnmatch.fnmatch(name, self.pattern) and name in self.wanted.get("member", {name}):
                        step = self.bytes if method == STORED else max(size, 1)
                        out += [Range(file.path, name, method, header, size, k, min(k + step, size)) for k in range(0, size, step)]
        return out or [Range("", "", STORED, 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        store, _ = store_of(self.path)
        kinds = {"byte_offset": pa.int64()}
        with store.open_input_file(part.archive) as f:
            read = lambda n, at: f.read_at(n, at)
            lines = lines_of(read, part)
            first = Range(part.archive, part.member, part.method, part.header, part.size, 0, 1)
            _, header = next(lines_of(read, first), (0, b""))
            names = next(csv.reader([header.decode("utf-8-sig")]), [])
            own = {"archive": part.archive, "member": part.member}
            at = [names.index(c) if c not in (*own, "byte_offset") else None for c in self.columns]
            rows: list[tuple] = []

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(c, pa.string())) for i, c in enumerate(self.columns)], names=self.columns)

            for offset, line in lines:
                if offset == 0 or not line:
                    continue
                cells = next(csv.reader([line.decode()]))
                rows.append(tuple((cells[i] or None) if i is not None else own.get(c, offset) for c, i in zip(self.columns, at, strict=True)))
                if len(rows) == ROWS:
                    yield batch()
                    rows.clear()
            if rows:
                yield batch()


class ZipSource(DataSource):
    """Format zipcsv: the lines of CSV members with a header, as the columns that the schema names, all strings.

    archive, member and byte_offset may be among them. A value holds no line end, empty ones are null, a column that the
    header doesn't have is an error. Options: path, member (a pattern), rangebytes.
    """

    @classmethod
    def name(cls) -> str:
        return "zipcsv"

    def schema(self) -> str:
        return "archive string, member string, byte_offset bigint"

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader({k.lower(): v for k, v in self.options.items()}, schema)


def read_zip_ranges(spark: SparkSession, path: str, columns: list[str], member: str = "*.csv", range_bytes: int = 32 << 20) -> DataFrame:
    """archive, member, byte_offset and columns (strings) of all lines; only these columns leave the source."""
    spark.dataSource.register(ZipSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = "archive string, member string, byte_offset bigint, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("zipcsv").schema(schema.removesuffix(", ")).option("path", path).option("member", member).option("rangebytes", range_bytes).load()


def numbered(lines: DataFrame) -> DataFrame:
    """lines of read_zip_ranges() with row_number, from 1 in each member."""
    from pyspark.sql import functions as F

    rows = placed(lines, ["archive", "member", "byte_offset"], "__place")
    first = rows.groupBy("archive", "member").agg((F.min("__place") - 1).alias("__before"))
    return rows.join(first, ["archive", "member"]).withColumn("row_number", F.col("__place") - F.col("__before")).drop("__place", "__before")


def write_zip_csv(df: DataFrame, path: str, member: str = "part.csv") -> int:
    """A stored ZIP archive for each partition that has rows, with one CSV member, by the tasks themselves; how many there are.

    An archive gets its name when it is whole, so an attempt that is repeated leaves none or the same.
    """
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = store_of(path)
        n = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        first = next(rows, None)
        if first is None:
            return
        store.create_dir(at, recursive=True)
        attempt, done = f"{at}/.{uuid4().hex}", f"{at}/part-{n:05d}.zip"
        with store.open_output_stream(attempt) as out, ZipFile(out, "w", ZIP_STORED) as z, z.open(ZipInfo(member), "w", force_zip64=True) as to:
            quoted = lambda x: '"' + ("" if x is None else str(x)).replace('"', '""') + '"'
            to.write((",".join(names) + "\n").encode())
            for row in (r for some in ([first], rows) for r in some):
                to.write((",".join(map(quoted, row)) + "\n").encode())
        store.move(attempt, done)
        yield pa.RecordBatch.from_arrays([pa.array([done])], names=["archive"])

    return df.mapInArrow(write, "archive string").count()
