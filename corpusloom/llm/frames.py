"""Token ids in files of independent zstandard frames that end in a seek table.

A file holds the ids of its documents, in their order, as little-endian unsigned 32-bit integers:

    data frames      zstandard frames, each compressed on its own
    document index   a skippable frame: for every document its id and number of ids, as a zstandard frame
    seek table       the skippable frame of the public seekable format: for every data frame its size, the
                     size of what it holds, and the low half of that's XXH64; then a footer

so ``zstd -d`` gives the plain ids, and a reader that knows which documents it wants decompresses only the
frames these lie in, and compares their checksums.

``df.write.format("tokenframes").save(folder)`` writes one file per task, in the order of the task's rows;
``_manifest.json``, written when the driver commits, lists the files of the successful attempts in the order
of tasks with their counts, so what lost executors leave behind is never read.  Reading plans slices of files
and leaves out files whose ids a pushed filter excludes.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, Not, WriterCommitMessage
from pyspark.sql.types import StructType

from corpusloom.functions.text import quoted
from corpusloom.llm.common import parts
from corpusloom.llm.encoding import encoder
from corpusloom.llm.warc import KNOWN, _holds, _store
from corpusloom.operators.scratch import new_path

#: Ids are little-endian unsigned 32-bit integers.
ID_BYTES = 4
#: A frame is closed with the document that brings it to FRAME bytes; longer documents are cut at such sizes.
FRAME = 1 << 18
LEVEL = 3
#: Bytes of ids that are passed on at a time.
BATCH = 1 << 23
#: Bytes of a file that one task reads at least, where files are larger.
SLICE = 64 << 20
MANIFEST = "_manifest.json"

# The public seekable format of zstandard.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")
HEAD = struct.Struct("<II")

SCHEMA = "doc_id long, start long, n_tokens long, ids binary, file string"
INDEX = np.dtype([("id", "<i8"), ("n", "<i8"), ("null", "?")])


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Documents appended to an open file; what is held back is a frame at most, and the index."""

    def __init__(self, out, frame: int = FRAME, level: int = LEVEL):
        self.out, self.frame = out, frame
        self.packer = zstandard.ZstdCompressor(level=level)
        self.held = bytearray()
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, bool]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((doc_id or 0, len(ids) // ID_BYTES, doc_id is None))
        for at in range(0, len(ids), self.frame):
            self.held += ids[at : at + self.frame]
            if len(self.held) >= self.frame:
                self._flush()

    def _flush(self) -> None:
        data = bytes(self.held)
        packed = self.packer.compress(data)
        self.table.append((len(packed), len(data), checksum(data)))
        self.out.write(packed)
        self.held.clear()

    def close(self) -> None:
        if self.held:
            self._flush()
        index = self.packer.compress(np.array(self.index, INDEX).tobytes())
        # the index comes with its own checksum and the place where it begins is told by the footer's size
        body = struct.pack("<I", checksum(index)) + index
        self.out.write(HEAD.pack(SKIPPABLE_INDEX, len(body)) + body)
        table = b"".join(ENTRY.pack(*x) for x in self.table) + FOOTER.pack(len(self.table), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(HEAD.pack(SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Random access to the documents of an open file."""

    def __init__(self, raw, size: int):
        self.raw, self.unpacker, self.frames_read = raw, zstandard.ZstdDecompressor(), 0
        count, kind, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or not kind & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        begin = size - FOOTER.size - count * ENTRY.size - HEAD.size
        table = self._at(begin, HEAD.size + count * ENTRY.size)
        if HEAD.unpack(table[: HEAD.size]) != (SKIPPABLE_SEEK, count * ENTRY.size + FOOTER.size):
            raise ValueError("broken seek table")
        self.table = np.frombuffer(table, "<u4", offset=HEAD.size).reshape(-1, 3).astype(np.int64)
        self.packed = np.append(0, np.cumsum(self.table[:, 0]))
        self.plain = np.append(0, np.cumsum(self.table[:, 1]))
        head = self._at(int(self.packed[-1]), HEAD.size)
        kind, length = HEAD.unpack(head)
        body = self._at(int(self.packed[-1]) + HEAD.size, length)
        if kind != SKIPPABLE_INDEX or struct.unpack("<I", body[:4])[0] != checksum(body[4:]):
            raise ValueError("broken index of documents")
        self.index = np.frombuffer(self.unpacker.decompress(body[4:]), INDEX)
        #: ids before each document of the file
        self.starts = np.cumsum(self.index["n"]) - self.index["n"]
        self.last = (-1, b"")

    def _at(self, at: int, n: int) -> bytes:
        self.raw.seek(at)
        return self.raw.read(n)

    def _frame(self, k: int) -> bytes:
        if self.last[0] != k:
            data = self.unpacker.decompress(self._at(int(self.packed[k]), int(self.table[k, 0])))
            if len(data) != self.table[k, 1] or checksum(data) != self.table[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.frames_read += 1
            self.last = (k, data)
        return self.last[1]

    def ids(self, position: int) -> bytes:
        """The ids of the document at a position; decompresses the frames that it lies in."""
        low = int(self.starts[position]) * ID_BYTES
        high = low + int(self.index["n"][position]) * ID_BYTES
        out, k = [], int(np.searchsorted(self.plain, low, "right")) - 1
        while low < high:
            end = min(high, int(self.plain[k + 1]))
            out.append(self._frame(k)[low - int(self.plain[k]) : end - int(self.plain[k])])
            low, k = end, k + 1
        return b"".join(out)


@dataclass
class Written(WriterCommitMessage):
    name: str
    task: int
    bytes: int
    documents: int
    tokens: int
    #: least and greatest doc_id; None where no row has one
    least: int | None
    greatest: int | None
    nulls: bool


class FramesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.frame = options["path"], int(options.get("framebytes", FRAME))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        name, task = f"ids-{uuid.uuid4().hex}.zst", TaskContext.get().partitionId()
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            writer = FrameWriter(out, self.frame)
            for batch in iterator:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                    writer.add(doc_id, ids.as_py() or b"")
            writer.close()
            size = out.tell()
        index = np.array(writer.index, INDEX)
        some = index["id"][~index["null"]]
        ends = (int(some.min()), int(some.max())) if len(some) else (None, None)
        return Written(name, task, size, len(index), int(index["n"].sum()), *ends, bool(index["null"].any()))

    def commit(self, messages: list) -> None:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        files = sorted((asdict(m) for m in messages if m and m.documents), key=lambda m: m["task"])
        with store.open_output_stream(f"{path}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        store, path = _store(self.path)
        for m in messages:
            if m and store.get_file_info(f"{path}/{m.name}").type == fs.FileType.File:
                store.delete_file(f"{path}/{m.name}")


@dataclass
class Slice(InputPartition):
    #: file, ids in the files before it, and which part of how many of its documents; None: nothing
    file: str | None
    size: int
    before: int
    part: int
    parts: int


def _on_ids(f: Filter) -> bool:
    return _on_ids(f.child) if isinstance(f, Not) else isinstance(f, KNOWN) and f.attribute == ("doc_id",)


class FramesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        unknown = set(self.names) - {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.path, self.slice = options["path"], int(options.get("slicebytes", SLICE))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _on_ids(f):
                self.filters.append(f)
            else:
                yield f

    def _may_hold(self, file: dict) -> bool:
        """False where the least and greatest id of a file show that no document passes."""
        return file["nulls"] or all(_in_range(f, file["least"], file["greatest"]) for f in self.filters)

    def partitions(self) -> list[Slice]:
        store, path = _store(self.path)
        with store.open_input_stream(f"{path}/{MANIFEST}") as f:
            files = json.loads(f.read())
        out, before = [], 0
        for file in files:
            if self._may_hold(file):
                parts = max(1, min(file["documents"], file["bytes"] // self.slice))
                out += [Slice(f"{path}/{file['name']}", file["bytes"], before, i, parts) for i in range(parts)]
            before += file["tokens"]
        return out or [Slice(None, 0, 0, 0, 1)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition.file is None:
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as raw:
            reader = FrameReader(raw, partition.size)
            n = len(reader.index)
            low, high = n * partition.part // partition.parts, n * (partition.part + 1) // partition.parts
            rows, held = [], 0
            for position in range(low, high):
                doc_id, tokens, null = reader.index[position].item()
                doc_id = None if null else doc_id
                if not all(_holds(f, lambda _, x=doc_id: x) is True for f in self.filters):
                    continue
                ids = reader.ids(position) if "ids" in self.names else b""
                rows.append((doc_id, partition.before + int(reader.starts[position]), tokens, ids, partition.file))
                held += len(ids)
                if held >= 1 << 24 or len(rows) >= 10_000:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary(), "file": pa.string()}
        columns = dict(zip(kinds, zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[n]) for n in self.names], names=self.names)


def _in_range(f: Filter, least: int | None, greatest: int | None) -> bool:
    """Whether some id from least to greatest may pass; true where the bounds cannot tell."""
    if least is None:
        return True
    kind = type(f).__name__
    if kind in ("EqualTo", "EqualNullSafe") and f.value is not None:
        return least <= f.value <= greatest
    if kind == "In":
        return any(v is not None and least <= v <= greatest for v in f.value)
    if kind in ("LessThan", "LessThanOrEqual") and f.value is not None:
        return least < f.value or (kind == "LessThanOrEqual" and least == f.value)
    if kind in ("GreaterThan", "GreaterThanOrEqual") and f.value is not None:
        return greatest > f.value or (kind == "GreaterThanOrEqual" and greatest == f.value)
    return True


class FramesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokenframes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FramesReader:
        return FramesReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FramesWriter:
        return FramesWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FramesSource)


def encoded(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary) in ascending order of doc_id over the partitions, ``end`` behind each document's ids.

    Null ids come last; rows that repeat an id follow each other by a hash of their text, so that an id with
    very many rows is dealt over several ranges.  A null text is empty.  Texts are moved once, to their ranges.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        last = struct.pack("<I", end)
        for batch in it:
            names, ids, held = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                names.append(doc_id)
                ids.append(encode(text.as_py()) + last)
                held += len(ids[-1])
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.binary())], schema=schema)
                    names, ids, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    text = F.coalesce(quoted(text_col), F.lit(""))
    narrow = docs.select(quoted(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_h"))
    order = [F.asc_nulls_last("doc_id"), F.asc("_h")]
    # a set number of ranges: put together by size, they would leave cores idle while texts are encoded
    ranged = narrow.repartitionByRange(parts(docs), *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return ranged.mapInArrow(run, "doc_id long, ids binary")


def write(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Write the ids of all documents to files in a new folder."""
    register(docs.sparkSession)
    encoded(docs, tokenizer, end).write.format("tokenframes").mode("append").save(path)


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Documents of a folder; without ``ids`` in the schema no frame is decompressed."""
    register(spark)
    return spark.read.format("tokenframes").schema(schema).load(path)


def round_trip(docs: DataFrame, tokenizer: str, end: int, label: str = "ids") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents written to the session's shared folder and read back."""
    path = new_path(docs.sparkSession, label)
    write(docs, path, tokenizer, end)
    found = read(docs.sparkSession, path, "doc_id long, start long, n_tokens long, ids binary")
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
