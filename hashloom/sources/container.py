"""Packed containers with byte-range reads, as a Python data source.

A file holds a header, a block table, a document table, a chunk table and a pool. A block is the stored bytes of some
consecutive chunks of one document, compressed together; a chunk is a pointer to a codeword with a delta, or its bytes.
Tables have entries of fixed size, so a reader that wants a range of bytes opens the header, the documents' entries,
and of the rest only what belongs to the blocks that the range touches. A manifest names the files that a finished
write has made, with the documents and the bytes they hold; files that hold nothing of a range are not opened.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from hashloom.operators import chunks, codebook

from .files import open_fs

NAME, MAGIC, MANIFEST = "hashloom_container", b"HLC1", "manifest.json"
#: Magic, bytes of a chunk, chunks of a block, documents, chunks, blocks.
HEADER = struct.Struct("<4sIIQQQ28x")
#: Place in the pool, bytes there, bytes unpacked, first chunk of the file.
BLOCK = struct.Struct("<QIIQ")
#: Key, whether it is known, bytes in this file, number of the first chunk in the document, first chunk and first block in the file.
DOCUMENT = struct.Struct("<qQQQQQ")
#: Codeword (-1: none), place in the unpacked block, stored bytes, bytes of the chunk.
CHUNK = struct.Struct("<qIII4x")

#: Bytes of a file's pool about, documents that one task reads, and rows of a batch.
FILE_BYTES, TASK_DOCUMENTS, ROWS = 64 << 20, 50_000, 10_000

_READ = "doc long, chunk_no long, id long, data binary, block long"


def _book(path: str) -> dict[int, bytes]:
    """The container's codewords; a codebook is bounded."""
    from pyarrow import parquet

    fs, root = open_fs(path)
    table = parquet.read_table(f"{root}/book", filesystem=fs, columns=["id", "data"])
    return dict(zip(table["id"].to_pylist(), table["data"].to_pylist(), strict=True))


def _xor(data: bytes, word: bytes) -> bytes:
    """Delta of bytes and a codeword of their length, and back."""
    return (int.from_bytes(data, "little") ^ int.from_bytes(word, "little")).to_bytes(len(data), "little")


@dataclass
class _Files(WriterCommitMessage):
    files: list


class _File:
    """Builds one file; its pool is bounded, so it is held until its tables are known."""

    def __init__(self, chunk: int, per_block: int):
        self.chunk, self.per_block = chunk, per_block
        self.blocks, self.documents, self.chunks, self.pool, self.size = [], [], [], [], 0
        self.held, self.first, self.doc, self.ends = [], 0, (None, -2), []

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            data = pa.compress(raw, codec="zstd", asbytes=True)
            self.blocks.append(BLOCK.pack(self.size, len(data), len(raw), self.first))
            self.pool.append(data)
            self.size, self.held, self.first = self.size + len(data), [], len(self.chunks)

    def add(self, doc, no: int, word, stored: bytes) -> None:
        size = len(stored)
        if (doc, no) != self.doc:  # another document, or a gap
            self.flush()
            self.documents.append([doc, 0, no, len(self.chunks), len(self.blocks)])
        elif no % self.per_block == 0:
            self.flush()
        self.chunks.append(CHUNK.pack(-1 if word is None else word, sum(map(len, self.held)), len(stored), size))
        self.held.append(stored)
        self.documents[-1][1] += size
        self.ends.append(no * self.chunk + size)
        self.doc = (doc, no + 1)

    def bytes(self) -> Iterator[bytes]:
        self.flush()
        yield HEADER.pack(MAGIC, self.chunk, self.per_block, len(self.documents), len(self.chunks), len(self.blocks))
        yield from self.blocks
        for doc, *more in self.documents:
            yield DOCUMENT.pack(doc or 0, doc is not None, *more)
        yield from self.chunks
        yield from self.pool

    def told(self, name: str) -> dict:
        known = [d[0] for d in self.documents if d[0] is not None]
        return {"file": name, "documents": len(self.documents), "first": min(known, default=None), "last": max(known, default=None), "nulls": any(d[0] is None for d in self.documents), "low": min(d[2] for d in self.documents) * self.chunk, "high": max(self.ends)}


class ContainerWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.chunk, self.per_block = options["path"], int(options["chunk"]), int(options["perBlock"])
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator):
        fs, root = open_fs(self.path)
        files, now, book = [], _File(self.chunk, self.per_block), _book(self.path)

        def close():
            if now.documents:
                name = f"{uuid.uuid4().hex}.hlc"  # a task that runs again makes other files; the manifest names those that count
                with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                    for part in now.bytes():
                        f.write(part)
                files.append(now.told(name))

        for batch in iterator:
            for doc, no, word, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now.size >= self.file_bytes and no % self.per_block == 0:
                    close()
                    now = _File(self.chunk, self.per_block)
                now.add(doc, no, word, data if word is None else _xor(data, book[word]))
        close()
        return _Files(files)

    def commit(self, messages) -> None:
        fs, root = open_fs(self.path)
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write("\n".join(json.dumps(x) for m in messages if m for x in m.files).encode())

    def abort(self, messages) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            for x in m.files if m else []:
                fs.delete_file(f"{root}/{x['file']}")


@dataclass
class _Part(InputPartition):
    file: str
    start: int
    stop: int


class ContainerReader(DataSourceReader):
    """Options: path; start and end, bytes within each document (default: all); firstDoc and lastDoc, keys (default: all, null ones too)."""

    def __init__(self, options):
        self.path = options["path"]
        whole = lambda name: int(options[name]) if options.get(name) is not None else None
        self.start, self.end, self.first, self.last = whole("start") or 0, whole("end"), whole("firstDoc"), whole("lastDoc")

    def wanted(self, x: dict) -> bool:
        """Whether a file of the manifest may hold some of the range."""
        if x["high"] <= self.start or (self.end is not None and x["low"] >= self.end):
            return False
        if self.first is None and self.last is None:
            return True
        return x["first"] is not None and (self.first is None or x["last"] >= self.first) and (self.last is None or x["first"] <= self.last)

    def partitions(self):
        fs, root = open_fs(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
            files = [json.loads(line) for line in f.read().decode().splitlines()]
        return [_Part(x["file"], i, min(i + TASK_DOCUMENTS, x["documents"])) for x in files if self.wanted(x) for i in range(0, x["documents"], TASK_DOCUMENTS)] or [_Part("", 0, 0)]

    def read(self, partition):
        if not partition.file:
            return
        fs, root = open_fs(self.path)
        rows: list[tuple] = []
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            for row in self._rows(f, partition, _book(self.path)):
                rows.append(row)
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def _rows(self, f, partition, book):
        magic, chunk, per_block, n_documents, n_chunks, n_blocks = HEADER.unpack(f.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError("not a container")
        documents = HEADER.size + n_blocks * BLOCK.size
        chunk_table = documents + n_documents * DOCUMENT.size
        pool = chunk_table + n_chunks * CHUNK.size
        entries = f.read_at((partition.stop - partition.start) * DOCUMENT.size, documents + partition.start * DOCUMENT.size)
        for doc, known, size, no, first, block in DOCUMENT.iter_unpack(entries):
            doc = doc if known else None
            if not self._asked(doc):
                continue
            low, high = max(self.start, no * chunk), min(no * chunk + size, size + no * chunk if self.end is None else self.end)
            if low >= high:
                continue
            # blocks of this document that the range touches; a document's first block here may begin inside a block's span
            span = per_block * chunk
            a, b = low // span - no // per_block, -(-high // span) - no // per_block
            some = list(BLOCK.iter_unpack(f.read_at((b - a) * BLOCK.size, HEADER.size + (block + a) * BLOCK.size)))
            packed = f.read_at(some[-1][0] + some[-1][1] - some[0][0], pool + some[0][0])
            last = first + -(-size // chunk)
            for i, (at, stored, raw, start) in enumerate(some):
                data = pa.decompress(packed[at - some[0][0] : at - some[0][0] + stored], raw, codec="zstd", asbytes=True) if raw else b""
                stop = min(some[i + 1][3] if i + 1 < len(some) else start + per_block - (no + start - first) % per_block, last)
                words = CHUNK.iter_unpack(f.read_at((stop - start) * CHUNK.size, chunk_table + start * CHUNK.size))
                for k, (word, place, length, _) in enumerate(words):
                    number, own = no + start - first + k, data[place : place + length]
                    yield doc, number, None if word < 0 else word, own if word < 0 else _xor(own, book[word]), number // per_block

    def _asked(self, doc) -> bool:
        if self.first is None and self.last is None:
            return True
        return doc is not None and (self.first is None or doc >= self.first) and (self.last is None or doc <= self.last)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc", "chunk_no", "id", "data", "block"])


class Container(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return _READ

    def reader(self, schema):
        return ContainerReader(self.options)

    def writer(self, schema, overwrite):
        return ContainerWriter(self.options)


def pack(docs: DataFrame, key: str, text: str, path: str, book: DataFrame, chunk: int = 128, per_block: int = 16, file_bytes: int = FILE_BYTES) -> None:
    """Write docs' texts as a container in path, a new folder. Keys (longs) are distinct; one may be null. Null and empty texts have no chunks.

    Whole chunks are pointers to book (id, data: a bounded codebook of words of `chunk` bytes, written beside) where one is
    near enough; the last, shorter ones are stored as they are. Files are dealt by ranges of key and chunk, so that a
    long document is written by several tasks.
    """
    spark = docs.sparkSession
    spark.dataSource.register(Container)
    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)
    book.select("id", "data").write.parquet(f"{path}/book")
    rows = chunks.fixed(docs.select(F.col(key).cast("long").alias("doc"), text), "doc", text, chunk).select("doc", "chunk_no", "data")
    whole = codebook.packed(rows.filter(F.length("data") == chunk), spark.read.parquet(f"{path}/book"), ["doc", "chunk_no"])
    short = rows.filter(F.length("data") < chunk).select("doc", "chunk_no", F.lit(None).cast("long").alias("id"), "data")
    every = whole.select(*short.columns).unionByName(short)
    every.write.parquet(f"{path}/rows")  # the search is not done again to find the ranges
    # chunks of one block go together: the range is over its number, not the chunk's
    dealt = spark.read.schema(every.schema).parquet(f"{path}/rows").repartitionByRange("doc", F.floor(F.col("chunk_no") / per_block)).sortWithinPartitions("doc", "chunk_no")
    dealt.write.format(NAME).option("path", path).option("chunk", chunk).option("perBlock", per_block).option("fileBytes", file_bytes).mode("append").save()
    fs.delete_dir(f"{root}/rows")


def read(spark: SparkSession, path: str, **asked: int | None) -> DataFrame:
    """(doc, chunk_no, id, data, block) of the chunks in blocks that a range touches: start, end, firstDoc, lastDoc."""
    spark.dataSource.register(Container)
    reader = spark.read.format(NAME).option("path", path)
    for name, value in asked.items():
        if value is not None:
            reader = reader.option(name, value)
    return reader.load()


def unpacked(spark: SparkSession, path: str, chunk: int = 128, start: int = 0, end: int | None = None, **asked) -> DataFrame:
    """(doc, data, blocks): bytes start to end of each document that has some, from its pointers, the codebook and the pool; blocks counts those opened."""
    rows = read(spark, path, start=start, end=end, **asked)
    at = F.col("chunk_no") * chunk
    stop = at + F.length("data") if end is None else F.least(at + F.length("data"), F.lit(end))
    low = F.greatest(at, F.lit(start))
    cut = F.substring("data", (low - at + 1).cast("int"), F.greatest(stop - low, F.lit(0)).cast("int"))
    parts = rows.select("doc", "chunk_no", "block", F.hex(cut).alias("hex"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "hex"))), lambda x: x["hex"]), "")
    return parts.groupBy("doc").agg(F.unhex(joined).alias("data"), F.count_distinct("block").alias("blocks"))
