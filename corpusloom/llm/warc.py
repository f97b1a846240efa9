"""WARC archives as a Python data source of Spark, for reading and writing.

``spark.read.format("warc").load(folder)`` plans one partition per group of files.  Every record's
header is parsed first; predicates on record type and header columns that Spark pushes down are
judged on it, and the payload of a record that fails is skipped without inflating it where the
member tells its length, and without decoding it anywhere.  A schema without ``payload`` skips all.

``df.write.format("warc").save(folder)`` writes one file per task under a name of its own; the
driver lists the files of the successful attempts in a manifest when it commits, and readers of a
folder with a manifest read those alone, so attempts of lost executors leave nothing behind.

Files are reached through pyarrow's file systems: local paths and object stores by their URI.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from corpusloom.llm.common import attach
from corpusloom.operators.scratch import new_path, settle

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, "
    "refers_to string, content_length long, headers map<string,string>, file string, position long, payload binary"
)
#: Column and the header that it holds.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
MANIFEST = "_manifest.json"
GROUP_BYTES = 64 << 20
CHUNK = 1 << 16
MAX_HEADER = 1 << 20
LEVEL = 3


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; paths without a scheme are local."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class FileGroup(InputPartition):
    files: list[str]


class _Bytes:
    """A file read forward, by line and by count, with an own buffer."""

    def __init__(self, raw):
        self.raw, self.buffer, self.start = raw, b"", 0

    def fill(self) -> bool:
        more = self.raw.read(CHUNK)
        self.buffer += more
        return bool(more)

    def take(self, n: int) -> bytes:
        out = [self.buffer[:n]]
        self.buffer = self.buffer[n:]
        n -= len(out[0])
        while n > 0 and (more := self.raw.read(min(n, 1 << 24))):
            out.append(more)
            n -= len(more)
        if n > 0:
            raise ValueError("the archive ends inside a record")
        return b"".join(out)

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            n -= len(self.buffer)
            self.buffer = b""
            self.raw.seek(self.raw.tell() + n)

    def tell(self) -> int:
        return self.raw.tell() - len(self.buffer)


class _Member:
    """The inflated bytes of one gzip member, as much as asked for."""

    def __init__(self, source: _Bytes):
        self.source, self.inflate, self.held = source, zlib.decompressobj(31), b""

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        if not self.source.buffer and not self.source.fill():
            raise ValueError("the archive ends inside a record")
        self.held += self.inflate.decompress(self.source.buffer, CHUNK * 16)
        self.source.buffer = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def drain(self) -> None:
        while self.more():
            self.held = b""


def parse_header(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name; lines that begin with a blank go on the line before."""
    lines = block.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _split(data: bytes) -> int:
    """Length of the header with the empty line behind it, or -1."""
    found = [at + len(end) for end in (b"\r\n\r\n", b"\n\n") if (at := data.find(end)) >= 0]
    return min(found, default=-1)


def records(raw, wants, with_payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """(position, header, payload) of the records that ``wants(header)``; the payload of others is skipped."""
    source = _Bytes(raw)
    while True:
        while len(source.buffer) < 32 and source.fill():
            pass
        if source.buffer[:2] != b"\x1f\x8b":
            stripped = source.buffer.lstrip(b"\r\n")
            source.buffer = stripped
            if not stripped:
                if source.fill():
                    continue
                return
            if stripped[:2] != b"\x1f\x8b":
                yield from _plain(source, wants, with_payload)
                continue
        yield from _zipped(source, wants, with_payload)


def _plain(source: _Bytes, wants, with_payload: bool):
    at = source.tell()
    while (n := _split(source.buffer)) < 0:
        if len(source.buffer) > MAX_HEADER or not source.fill():
            raise ValueError(f"no end of the header at {at}")
    header = parse_header(source.take(n))
    length = int(header["content-length"])
    if wants(header):
        if with_payload:
            yield at, header, source.take(length)
        else:
            source.skip(length)
            yield at, header, None
    else:
        source.skip(length)


def _zipped(source: _Bytes, wants, with_payload: bool):
    at = source.tell()
    size = _member_size(source.buffer)
    member = _Member(source)
    while (n := _split(member.held)) < 0:
        if len(member.held) > MAX_HEADER or not member.more():
            raise ValueError(f"no end of the header at {at}")
    header = parse_header(member.held[:n])
    length = int(header["content-length"])
    if with_payload and wants(header):
        pieces, have = [member.held[n:]], len(member.held) - n
        member.held = b""
        while have < length and member.more():
            pieces.append(member.held)
            have += len(member.held)
            member.held = b""
        if have < length:
            raise ValueError(f"the archive ends inside the record at {at}")
        payload = b"".join(pieces)[:length]
        member.drain()
        yield at, header, payload
        return
    if size:  # go on behind the member without inflating it
        source.buffer = b""
        source.raw.seek(at + size)
    else:
        member.drain()
    if wants(header):
        yield at, header, None


def _member_size(head: bytes) -> int:
    """Bytes of a gzip member that carries its length in an extra field, else 0."""
    if len(head) >= 24 and head[3] & 4 and head[12:14] == b"sl":
        return struct.unpack("<I", head[16:20])[0]
    return 0


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member with both lengths in an extra field ``sl``, so that readers can jump over it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if total >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


#: Header names as the format spells them.
NAMES = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI",
    "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}


def record(fields: dict[str, str | None], payload: bytes, extra: dict[str, str] | None = None) -> bytes:
    """A whole record; line ends inside values become blanks, as they would end the field."""
    lines = ["WARC/1.1"]
    named = [(NAMES[k], v) for k, v in fields.items() if v is not None] + list((extra or {}).items())
    lines += [f"{k}: {' '.join(str(v).split())}" for k, v in named if v is not None]
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _holds(f: Filter, get) -> bool | None:
    """Truth of a pushed filter under SQL's rules; None for unknown."""
    if isinstance(f, Not):
        inner = _holds(f.child, get)
        return None if inner is None else not inner
    x = get(f.attribute[0])
    if isinstance(f, IsNull):
        return x is None
    if isinstance(f, IsNotNull):
        return x is not None
    if isinstance(f, EqualNullSafe):
        return x == f.value
    if x is None:
        return None
    if isinstance(f, In):
        return True if x in f.value else None if None in f.value else False
    if f.value is None:
        return None
    if isinstance(f, EqualTo):
        return x == f.value
    if isinstance(f, GreaterThan):
        return x > f.value
    if isinstance(f, GreaterThanOrEqual):
        return x >= f.value
    if isinstance(f, LessThan):
        return x < f.value
    if isinstance(f, LessThanOrEqual):
        return x <= f.value
    if isinstance(f, StringStartsWith):
        return x.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return x.endswith(f.value)
    return f.value in x  # StringContains


KNOWN = (
    EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, IsNull, LessThan, LessThanOrEqual,
    StringContains, StringEndsWith, StringStartsWith,
)


def _can(f: Filter) -> bool:
    if isinstance(f, Not):
        return _can(f.child)
    return isinstance(f, KNOWN) and len(f.attribute) == 1 and (f.attribute[0] in HEADERS or f.attribute[0] == "content_length")


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        unknown = set(self.names) - {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.path = options["path"]
        self.group = int(options.get("groupbytes", GROUP_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if _can(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[FileGroup]:
        """Files, the largest first, put into groups of about the same number of bytes."""
        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [FileGroup([path])]
        found = {
            x.base_name: x
            for x in store.get_file_info(fs.FileSelector(path, recursive=False))
            if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))
        }
        if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{path}/{MANIFEST}") as f:
                found = {n: found[n] for n in json.loads(f.read())}
        groups, held = [], 0
        for x in sorted(found.values(), key=lambda x: (-x.size, x.path)):
            if not groups or held + x.size > self.group:
                groups.append(FileGroup([]))
                held = 0
            groups[-1].files.append(x.path)
            held += x.size
        return groups or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        store, _ = _store(self.path)
        filters = self.filters

        def wants(header: dict) -> bool:
            def get(column: str):
                if column == "content_length":
                    return int(header["content-length"])
                return header.get(HEADERS[column])

            return all(_holds(f, get) is True for f in filters)

        for file in partition.files:
            with store.open_input_file(file) as raw:
                for position, header, payload in records(raw, wants, "payload" in self.names):
                    row = {"file": file, "position": position, "payload": payload, "headers": header}
                    row["content_length"] = int(header["content-length"])
                    yield tuple(row[n] if n in row else header.get(HEADERS[n]) for n in self.names)


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.path = options["path"]
        self.zip = options.get("compression", "gzip") == "gzip"
        self.overwrite = overwrite
        self.names = schema.fieldNames()

    def write(self, iterator) -> Written:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        name = f"records-{uuid.uuid4().hex}.warc" + ".gz" * self.zip
        some = False
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            for row in iterator:
                some = True
                r = row.asDict()
                whole = record({k: r.get(k) for k in NAMES}, bytes(r.get("payload") or b""), r.get("headers"))
                out.write(member(whole) if self.zip else whole)
        return Written(name if some else "")

    def commit(self, messages: list) -> None:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        names = [m.name for m in messages if m and m.name]
        at = f"{path}/{MANIFEST}"
        if not self.overwrite and store.get_file_info(at).type == fs.FileType.File:
            with store.open_input_stream(at) as f:
                names = json.loads(f.read()) + names
        with store.open_output_stream(at, compression=None) as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        store, path = _store(self.path)
        for m in messages:
            if m and m.name and store.get_file_info(f"{path}/{m.name}").type == fs.FileType.File:
                store.delete_file(f"{path}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


PREFIX = "urn:page:"
SMALLEST = 100
DATE = "1970-01-01T00:00:00Z"
#: Not part of the format, which leaves names beginning so to their users.
LENGTH_HEADER = "x-payload-length"


def to_records(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """Rows for the writer: of equal payloads of ``smallest`` bytes or more the one with the smallest
    page_id is a response, the others revisit it with an empty payload.  A null html is empty; a page
    without an id is a response of its own, and so are further rows that repeat the first page's id.
    """
    html = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    narrow = settle(
        pages.select("page_id", F.sha2(html, 256).alias("_digest"), F.length(html).cast("long").alias("_bytes")), "payloads"
    )
    copies = narrow.where((F.col("_bytes") >= smallest) & F.col("page_id").isNotNull())
    firsts = copies.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("n"))
    firsts = settle(firsts.where("n > 1"), "firsts")
    rows = pages.select(
        "page_id", F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"),
        html.alias("payload"), F.sha2(html, 256).alias("_digest"),
    )
    found = attach(rows, firsts.select("_digest", "_first"), "_digest", firsts.select("_digest", "n"))
    again = F.col("_first").isNotNull() & (F.col("page_id") != F.col("_first"))
    return found.select(
        F.concat(F.lit(f"<{PREFIX}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")).alias("record_id"),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"),
        F.lit("text/html").alias("content_type"),
        F.concat(F.lit("sha256:"), F.col("_digest")).alias("payload_digest"),
        F.when(again, F.concat(F.lit(f"<{PREFIX}"), F.col("_first").cast("string"), F.lit(">"))).alias("refers_to"),
        F.create_map(F.lit(LENGTH_HEADER), F.length("payload").cast("string")).alias("headers"),
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    to_records(pages).write.format("warc").mode("append").save(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read from archives.

    Responses are measured by their payload; of revisits, which hold none, only headers are read.
    """
    register(spark)
    narrow = "record_id string, record_type string, payload_digest string, refers_to string, headers map<string,string>"
    responses = spark.read.format("warc").schema(f"{narrow}, payload binary").load(path).where("record_type = 'response'")
    revisits = spark.read.format("warc").schema(narrow).load(path).where("record_type = 'revisit'")
    number = lambda c: F.regexp_extract(c, f"^<{PREFIX}(-?[0-9]+)>$", 1)
    page = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return responses.select(
        page("record_id").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(
        revisits.select(
            page("record_id").alias("page_id"),
            F.element_at("headers", LENGTH_HEADER).cast("long").alias("payload_bytes"),
            F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
            "record_type",
            page("refers_to").alias("refers_to"),
        )
    )


def round_trip(pages: DataFrame, label: str = "warc") -> DataFrame:
    """Pages written to archives in the session's shared folder and read back."""
    path = new_path(pages.sparkSession, label)
    archive(pages, path)
    return page_records(pages.sparkSession, path)


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {SMALLEST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {SMALLEST} AND page_id <> first THEN first END AS refers_to
FROM f
"""
