"""WARC archives: writing with revisits and segments, and reading back with segments put together again.

A response longer than a segment goes into one `response` record, number 1, and `continuation` records that name
the first one's id; they land in different archives. Reading brings the segments of one origin together, in order,
checks the total length, and takes the chunked transfer framing off.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, open_fs, shared_dir

#: Bytes of a record's block before it is cut into segments, and of a chunk of the transfer framing.
SEGMENT, CHUNK = 16 << 10, 4 << 10

_DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, chunk: int) -> bytes:
    """Payload in chunked transfer framing, with the closing chunk."""
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for i in range(0, len(payload), chunk) if (p := payload[i : i + chunk])]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are passed over, a framing that does not add up is an error."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size line is cut off")
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n
        if len(out[-1]) != n or body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        at += 2


def record_id(page_id, digest: str, part: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{part}')}>"


def record(kind: str, headers: dict, block: bytes) -> bytes:
    """One record as its own gzip member."""
    lines = {"WARC-Type": kind, "WARC-Date": _DATE, **headers, "Content-Length": len(block)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_records(page_id, url: str, payload: bytes, first_id, digest: str, segment: int, chunk: int):
    """(segment number, record) of a page: a revisit if first_id names another page, else a response and its continuations."""
    clean = "".join(url.split()) or "about:blank"
    common = {"WARC-Target-URI": clean, "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": page_id}
    own = record_id(page_id, digest, 1)
    if first_id is not None and first_id != page_id:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield 1, record("revisit", common | {"WARC-Record-ID": own, "WARC-Profile": profile, "WARC-Refers-To": record_id(first_id, digest, 1), "X-Refers-To-Page": first_id}, block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    if len(block) <= segment:
        yield 1, record("response", common | {"WARC-Record-ID": own}, block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield 1, record("response", common | {"WARC-Record-ID": own, "WARC-Segment-Number": 1}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = {"WARC-Segment-Total-Length": len(block)} if k == len(parts) else {}
        yield k, record("continuation", {"WARC-Target-URI": clean, "WARC-Record-ID": record_id(page_id, digest, k), "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k} | total, part)


def read_records(stream):
    """(headers, block) of each record of an open archive; only one record is held."""
    z, held, tail = zlib.decompressobj(31), [], b""
    while data := tail or stream.read(1 << 18):
        held.append(z.decompress(data))
        tail = z.unused_data
        if z.eof:
            whole = b"".join(held)
            head, _, rest = whole.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines)
            n = int(headers["Content-Length"])
            if not version.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
                raise ValueError("a record's length is wrong")
            yield headers, rest[:n]
            z, held = zlib.decompressobj(31), []
    if held:
        raise ValueError("the archive is cut off")


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, digest, first_id) of the pages whose payload, of at least `least` bytes, a smaller page_id has too.

    Works on digests only; the table of repeated digests is aggregated before it moves.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    slim = materialize(pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha2(payload, 256)).alias("digest"), F.length(payload).alias("n")), "digests")
    repeated = slim.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    return slim.join(materialize(repeated, "repeated"), "digest").filter("page_id <> first_id").select("page_id", "digest", "first_id").distinct()


def write_archives(pages: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK, least: int = 0, archives: int | None = None) -> tuple[str, DataFrame]:
    """Writes one record per page (and continuations) into gzipped archives in the shared folder; returns folder and manifest (path, records)."""
    spark = pages.sparkSession
    parts = archives or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.unhex(F.sha2(F.encode("html", "UTF-8"), 256)))
    known = materialize(revisits(pages, least), "revisits")
    rows = own.join(known, ["page_id", "digest"], "left").select("page_id", "url", "html", "first_id")
    folder = shared_dir(spark, "warc")
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)

    def tasks(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = open_fs(folder)
        path, tail = f"{root}/part-{task.partitionId():06d}.warc.gz", f"{root}/part-{task.partitionId():06d}-continued.warc.gz"
        temps = [f"{root}/.{task.taskAttemptId()}-{k}" for k in (0, 1)]
        n = [0, 0]
        with fs.open_output_stream(temps[0], compression=None) as first, fs.open_output_stream(temps[1], compression=None) as more:
            for b in batches:
                for page_id, url, html, first_id in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
                    payload = html.encode()
                    for k, data in page_records(page_id, url, payload, first_id, digest32(payload), segment, chunk):
                        (more if k % 2 == 0 else first).write(data)  # neighbouring segments go to different archives
                        n[k % 2 == 0] += 1
        fs.move(temps[0], path)
        fs.move(temps[1], tail)
        yield pa.RecordBatch.from_arrays([pa.array([path, tail]), pa.array(n, pa.int64())], names=["path", "records"])

    return folder, materialize(map_batches(rows, tasks, "path string, records long"), "manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit record: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked, payload.

    Records in one piece are decoded where they are read. Segments are dealt by origin and sorted by number; a task
    holds one origin at a time. A missing segment, a wrong total, a framing or a digest that does not hold is an error.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def number(x):
        return None if x in (None, "None") else int(x)

    def decoded(headers: dict, block: bytes):
        http, _, body = block.partition(b"\r\n\r\n")
        stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        page, url, kind = number(headers["X-Page-Id"]), headers["WARC-Target-URI"], headers["WARC-Type"]
        if kind == "revisit":
            size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            return (page, url, size, stated, kind, number(headers.get("X-Refers-To-Page")), *[None] * with_payload)
        payload = dechunked(body) if b"transfer-encoding: chunked" in http.lower() else body
        if digest32(payload) != stated:
            raise ValueError(f"the payload of page {page} does not have its digest")
        return (page, url, len(payload), stated, kind, None, *[payload] * with_payload)

    def table(rows, kinds, cols):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=cols)

    def limited(rows, kinds, cols, weight):
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += 1 + weight(r)
            if len(held) >= 1000 or size >= 8 << 20:
                yield table(held, kinds, cols)
                held, size = [], 0
        yield table(held, kinds, cols)

    raw = ["origin", "number", "total", "headers", "block", *cols]
    raw_kinds = [pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), *kinds]

    def scan(batches):
        def rows():
            fs, _ = open_fs(folder)
            for b in batches:
                for path in b.column(0).to_pylist():
                    with fs.open_input_stream(path, compression=None) as f:
                        for headers, block in read_records(f):
                            if "WARC-Segment-Number" not in headers:
                                yield (None, None, None, None, None, *decoded(headers, block))
                            else:
                                origin = headers.get("WARC-Segment-Origin-ID", headers["WARC-Record-ID"])
                                total = headers.get("WARC-Segment-Total-Length")
                                yield (origin, int(headers["WARC-Segment-Number"]), total and int(total), list(headers.items()), block, *[None] * len(cols))

        yield from limited(rows(), raw_kinds, raw, lambda r: len(r[4] or b"") + (len(r[-1] or b"") if with_payload else 0))

    def join(batches):
        def whole(parts):
            headers, total = dict(parts[0][3]), parts[-1][2]
            block = b"".join(p[4] for p in parts)
            if [p[1] for p in parts] != list(range(1, len(parts) + 1)) or total != len(block):
                raise ValueError(f"segments of {parts[0][0]} are missing")
            return decoded(headers, block)

        def rows():
            parts = []
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True):
                    if parts and (r[0] != parts[0][0] or r[1] == parts[-1][1]):
                        if r[0] == parts[0][0]:
                            if r[4] != parts[-1][4]:
                                raise ValueError(f"two segments of {r[0]} have one number")
                            twice.append(r[0])
                            continue
                        yield from emit(parts)
                        parts = []
                    parts.append(r)
            if parts:
                yield from emit(parts)

        twice: list[str] = []

        def emit(parts):
            """A page written twice has every segment twice: one row for each."""
            row = whole(parts)
            times = 1 + len(twice) // len(parts)
            twice.clear()
            return [row] * times

        yield from limited(rows(), kinds, cols, lambda r: len(r[-1] or b"") if with_payload else 0)

    raw_schema = "origin string, number long, total long, headers map<string,string>, block binary, " + schema
    files = manifest.filter("records > 0").select("path").repartition(parts, "path")
    records = materialize(map_batches(files, scan, raw_schema), "records")
    segments = records.filter("origin IS NOT NULL").select("origin", "number", "total", "headers", "block")
    joined = map_batches(segments.repartition(parts, "origin").sortWithinPartitions("origin", "number"), join, schema)
    return records.filter("origin IS NULL").select(*cols).unionByName(joined)


def archive_and_read(pages: DataFrame, least: int = 0, with_payload: bool = False, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """Writes the pages' records and reads them back. Null html is empty, null url is about:blank; empty payloads are
    equal to each other; a null page_id is never named by a revisit; a row that repeats another's page_id and html is
    written again as the same record. No pages: no rows."""
    folder, manifest = write_archives(pages, segment, chunk, least)
    return read_archives(pages.sparkSession, folder, manifest, with_payload)
