"""Media columns: payloads as ISO base media files, and what their boxes say without touching the payload.

A file is ftyp, mdat, moov. The payload is one track of raw 8-bit samples, 64 to a sample table entry, in chunks of
a fixed number of entries; every KEY-th entry is listed as a sync sample. Reading walks the nested boxes, expands the
sample tables to byte ranges, and only then, for a check of the bytes, reads the ranges.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, texts_of

#: Bytes of an entry, entries of a chunk, entries from one sync sample to the next, samples a second.
FRAME, PER_CHUNK, KEY, RATE = 64, 32, 16, 8000

#: Boxes that hold boxes.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"})


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def payload_of(text: str) -> bytes:
    """The text in UTF-8, filled up with zero bytes to a positive multiple of FRAME."""
    data = text.encode()
    return data + bytes(-len(data) % FRAME or (0 if data else FRAME))


def media_file(payload: bytes) -> bytes:
    """One raw audio track with the payload's bytes as its samples."""
    n = len(payload) // FRAME
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    wide = len(payload) + 8 >= 1 << 32
    start = len(ftyp) + (16 if wide else 8)
    chunks = -(-n // PER_CHUNK)
    offsets = start + np.arange(chunks, dtype=np.int64) * (FRAME * PER_CHUNK)
    last = n - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (last != PER_CHUNK or chunks == 1)
    sync = np.arange(1, n + 1, KEY)
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    places = full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, FRAME)),
        full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, n)),
        places,
    )
    duration = n * FRAME
    unit = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    mvhd = full(b"mvhd", struct.pack(">QQIQIHHQ", 0, 0, RATE, duration, 0x10000, 0x0100, 0, 0), unit, bytes(24), struct.pack(">I", 2), version=1)
    tkhd = full(b"tkhd", struct.pack(">QQIIQQHHHH", 0, 0, 1, 0, duration, 0, 0, 0, 0x0100, 0), unit, bytes(8), version=1, flags=7)
    mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0), version=1)
    hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0")
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
    moov = box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))
    return b"".join((ftyp, box(b"mdat", payload), moov))


def boxes(data, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, body start, body end) of every box, containers opened, payloads passed over."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} does not fit in what holds it")
        here = (*path, kind)
        yield here, start + head, start + size
        if kind in CONTAINERS:
            yield from boxes(data, start + head, start + size, here)
        start += size


def describe(data) -> dict:
    """Of the file's first track: codec, timescale, duration, and byte ranges of all samples and of the sync samples."""
    at = {}
    for path, a, b in boxes(data):
        at.setdefault(path[-1], (a, b))

    def numbers(kind: bytes, skip: int, dtype: str) -> np.ndarray:
        a, _ = at[kind]
        n = struct.unpack_from(">I", data, a + skip)[0]
        return np.frombuffer(data, dtype, n, a + skip + 4)

    a, _ = at[b"mdhd"]
    scale, duration = struct.unpack_from(">IQ" if data[a] == 1 else ">II", data, a + (20 if data[a] == 1 else 12))
    codec = bytes(data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1")
    times = numbers(b"stts", 4, ">u4,>u4")
    a, _ = at[b"stsz"]
    size, n = struct.unpack_from(">II", data, a + 4)
    sizes = np.full(n, size, np.int64) if size else np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)
    places = numbers(b"co64", 4, ">u8") if b"co64" in at else numbers(b"stco", 4, ">u4")
    runs = numbers(b"stsc", 4, ">u4,>u4,>u4")
    until = np.append(runs["f0"][1:], len(places) + 1).astype(np.int64)
    per = np.repeat(runs["f1"].astype(np.int64), until - runs["f0"])
    if per.sum() != n or times["f0"].astype(np.int64).sum() != n:
        raise ValueError("the sample tables do not agree")
    chunk = np.repeat(np.arange(len(per)), per)
    before = np.cumsum(sizes) - sizes
    lead = before[(np.cumsum(per) - per)[per > 0]] if n else before
    first = np.zeros(len(per), np.int64)
    first[per > 0] = lead
    offsets = places.astype(np.int64)[chunk] + before - first[chunk]
    sync = numbers(b"stss", 4, ">u4").astype(np.int64) - 1 if b"stss" in at else np.arange(n)
    return {"codec": codec, "timescale": scale, "duration": duration, "offsets": offsets, "sizes": sizes, "sync": sync}


def ranges(offsets: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Adjoining byte ranges put together, as (start, end)."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts, ends = offsets[np.append(0, cut)], (offsets + sizes)[np.append(cut - 1, len(offsets) - 1)]
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a media file. Null is empty; an empty text is one frame of zero bytes."""

    def tasks(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            media = [media_file(payload_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_batches(texts_of(docs), tasks, "doc_id long, n_bytes long, media binary")


def probe(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> codec, timescale, duration, n_samples, keyframes (byte ranges), and checks of the bytes the tables point at."""
    keyframe = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def tasks(batches):
        for b in batches:
            rows = []
            for cell in b.column(2):
                data = memoryview(cell.as_buffer())
                d = describe(data)
                whole = ranges(d["offsets"], d["sizes"])
                sha, crc_of, size = hashlib.sha256(), b"", 0
                for s, e in whole:
                    sha.update(data[s:e])
                    crc_of, size = (crc_of + bytes(data[max(s, e - 64) : e]))[-64:], size + e - s
                keys = [{"start": s, "end": s + n} for s, n in zip(d["offsets"][d["sync"]].tolist(), d["sizes"][d["sync"]].tolist(), strict=True)]
                rows.append((size, sha.hexdigest(), zlib.crc32(crc_of), len(data), hashlib.sha256(data).hexdigest(), d["codec"], d["timescale"], d["duration"], len(d["sizes"]), keys))
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), keyframe]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "timescale", "duration", "n_samples", "keyframes"]
    return map_batches(media.select("doc_id", "n_bytes", "media"), tasks, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, timescale long, duration long, n_samples long, keyframes array<struct<start:long,end:long>>")


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text as a media column, reads the column back and probes it. Repeated rows give repeated rows; no documents, none."""
    return probe(materialize(store(docs), "media"))


def feature(media: DataFrame):
    """One string of what the boxes say: codec, timescale, duration, samples, keyframes, and a checksum of their byte ranges."""
    spans = F.sha1(F.concat_ws(",", F.transform("keyframes", lambda k: F.concat_ws("-", k["start"].cast("string"), k["end"].cast("string")))))
    return F.concat_ws(";", F.trim("codec"), F.col("timescale").cast("string"), F.col("duration").cast("string"), F.col("n_samples").cast("string"), F.size("keyframes").cast("string"), spans)
