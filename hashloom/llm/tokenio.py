"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A block holds a header, its documents' ids and lengths, one control byte for every four values, then the values' own
bytes (one to four each, little end first). Values are ranks: the most frequent id of the corpus is 0. One table,
ranks.bin, names the id of each rank.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, open_fs, shared_dir, texts_of
from .pieces import worker_encoder

MAGIC = b"RVB1"
#: Values of a block at most, unless one document alone has more.
BLOCK_VALUES = 1 << 19
#: Values of a file about: there are as many files as shuffle partitions, or more.
FILE_VALUES = 1 << 28

#: Of each control byte, the lengths of its four values.
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    used = np.arange(4, dtype=np.uint8)[None, :] <= code[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values back: lengths by table lookup, places by a running sum, bytes by gathering."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(ids: list, counts: list[int], values: np.ndarray) -> bytes:
    control, data = encode_values(values)
    known = np.array([x is not None for x in ids], np.uint8).tobytes()
    docs = np.array([0 if x is None else x for x in ids], "<i8").tobytes() + np.array(counts, "<u8").tobytes() + known
    return MAGIC + struct.pack("<IQQQ", len(ids), len(values), len(control), len(data)) + docs + control + data


def read_blocks(stream):
    """(doc ids, counts, values) of each block of an open file; only one block is held."""
    while head := stream.read(32):
        if head[:4] != MAGIC:
            raise ValueError("not a token file, or it is cut off")
        n, total, c, d = struct.unpack("<IQQQ", head[4:])
        body = stream.read(17 * n + c + d)
        if len(body) != 17 * n + c + d:
            raise ValueError("a block is cut off")
        known = np.frombuffer(body, np.uint8, n, 16 * n)
        ids = [x if k else None for x, k in zip(np.frombuffer(body, "<i8", n).tolist(), known.tolist(), strict=True)]
        counts = np.frombuffer(body, "<u8", n, 8 * n).astype(np.int64)
        yield ids, counts, decode_values(body[17 * n : 17 * n + c], body[17 * n + c :], total)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids): each text's ids and the end id, packed in 16 bits where all are smaller, else in 32 with a flag."""
    end = np.array([end_id], "<u4").tobytes()

    def tasks(batches):
        encoder = worker_encoder(tokenizer)
        for b in batches:
            wide, out = [], []
            for data in encoder.encode(b.column(1).to_pylist()):
                ids = np.frombuffer(data + end, "<u4")
                wide.append(bool(ids.max() > 0xFFFF))
                out.append(ids.tobytes() if wide[-1] else ids.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(wide)], names=["doc_id", "ids", "wide"])

    return map_batches(texts_of(docs), tasks, "doc_id long, ids binary, wide boolean")


def _unpack(data: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(data, "<u4" if wide else "<u2").astype(np.uint32)


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents: tasks count their own ids first, so a task sends each id once."""

    def tasks(batches):
        counts = np.zeros(1 << 16, np.int64)
        for b in filter(len, batches):
            # all rows of a slice at once: a count has as many places as the largest id
            own = np.bincount(np.concatenate([_unpack(data, wide) for data, wide in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]))
            if len(own) > len(counts):
                counts = np.pad(counts, (0, len(own) - len(counts)))
            counts[: len(own)] += own
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts[ids])], names=["id", "n"])

    return map_batches(tokens.select("doc_id", "ids", "wide"), tasks, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(docs: DataFrame, tokenizer: str, end_id: int, files: int | None = None) -> tuple[str, DataFrame]:
    """Writes the token files in ascending doc_id order (null first); returns their folder and one row per file: file, path, docs, ids.

    A file is renamed into place when whole, so a task that is run again, or twice at once, leaves the same file.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer, end_id), "tokens")
    # as many rows as the vocabulary has ids, at most
    counted = id_counts(tokens).orderBy(F.desc("n"), "id").collect()
    ranked, total = [r["id"] for r in counted], sum(r["n"] for r in counted)
    folder = shared_dir(spark, "files")
    rank = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks.bin", compression=None) as f:
        f.write(np.array(ranked, "<u4").tobytes())
    table = spark.sparkContext.broadcast(rank)
    parts = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_VALUES))

    def tasks(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = open_fs(folder)
        path, part = f"{root}/part-{task.partitionId():06d}.rvb", f"{root}/.part-{task.taskAttemptId()}"
        n_docs = n_ids = 0
        with fs.open_output_stream(part, compression=None) as f:
            ids, values, size = [], [], 0

            def flush():
                if ids:
                    f.write(write_block(ids, [len(v) for v in values], table.value[np.concatenate(values)]))

            for b in batches:
                for doc, data, wide in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                    v = _unpack(data, wide)
                    if size and size + len(v) > BLOCK_VALUES:
                        flush()
                        ids, values, size = [], [], 0
                    ids.append(doc)
                    values.append(v)
                    size, n_docs, n_ids = size + len(v), n_docs + 1, n_ids + len(v)
            flush()
        fs.move(part, path)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["file", "path", "docs", "ids"])

    # rows of one doc_id (null, repeated) go on by their ids and as they were read, so that a hot one fills several files
    place = tokens.withColumns({"_ids": F.xxhash64("ids"), "_at": F.monotonically_increasing_id()})
    ordered = place.repartitionByRange(parts, "doc_id", "_ids", "_at").sortWithinPartitions("doc_id", "_ids", "_at")
    return folder, materialize(map_batches(ordered.select("doc_id", "ids", "wide"), tasks, "file int, path string, docs long, ids long"), "manifest")


def read_files(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids."""
    # one row per file
    first = F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    work = materialize(manifest.select("file", "path", "docs", first.alias("first")), "starts").filter("docs > 0")
    work = work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")

    def tasks(batches):
        fs, root = open_fs(folder)
        with fs.open_input_stream(f"{root}/ranks.bin", compression=None) as f:
            ids_of = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for path, start in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                with fs.open_input_stream(path, compression=None) as f:
                    for docs, counts, values in read_blocks(f):
                        ids = ids_of[values]
                        ends = np.cumsum(counts)
                        own = [ids[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                        out = [pa.array(docs, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                        if with_ids:
                            out.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                        start += int(ends[-1])
                        yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return map_batches(work, tasks, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Encode, write and read back. Null and empty texts are the end id alone; repeated rows are written as often as they occur; no documents give no rows."""
    folder, manifest = write_files(docs, tokenizer, end_id)
    return read_files(docs.sparkSession, folder, manifest, with_ids)
