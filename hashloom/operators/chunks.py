"""Chunks of texts' bytes, codebooks of frequent chunks, deltas and integrity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import binary, rows_of

#: Kinds of content that have no lines.
BINARY = ("UNKNOWN", "ELF", "ZIP", "PNG")


def latin(text: Column) -> Column:
    """A text's UTF-8 bytes, a character each: one pattern can then cut them in one pass, and no row carries a whole text for each of its slices."""
    return F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1")


def slices(raw: Column, size: int) -> Column:
    return F.regexp_extract_all(raw, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def fixed(docs: DataFrame, key: str, text: str, size: int = 128) -> DataFrame:
    """(key, chunk_no, off, data): slices of the UTF-8 bytes, the last may be short; an empty text has none."""
    rows = docs.select(key, F.posexplode(slices(latin(F.col(text)), size)).alias("chunk_no", "_c"))
    no = F.col("chunk_no").cast("long")
    return rows.select(key, no.alias("chunk_no"), (no * size).alias("off"), F.encode("_c", "ISO-8859-1").alias("data"))


#: Pairs of chunks that a task sends on at once about.
PAIRS = 1 << 15


def _beside(key: pa.Array, column: pa.Array, size: int):
    """Batches (key, chunk_no, data, pattern) of a batch of texts' bytes."""
    held, n, row = [], 0, 0

    def sent():
        keys, at, data, pattern, ends = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([key.take(pa.array(keys)), pa.array(at), binary(np.arange(len(at) + 1) * size, data), binary(np.r_[0, np.cumsum(ends)], pattern)], names=["key", "chunk_no", "data", "pattern"])

    for values, ends in rows_of(column):
        for start, stop in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            for first in range(0, (stop - start - 1) // size, PAIRS):
                at = np.arange(first, min((stop - start - 1) // size, first + PAIRS))
                here, there = start + int(at[0]) * size, start + (int(at[-1]) + 1) * size
                held.append((np.full(len(at), row), at, values[here:there], values[here + size : min(there + size, stop)], np.minimum(size, stop - start - (at + 1) * size)))
                n += len(at)
                if n >= PAIRS:
                    yield sent()
                    held, n = [], 0
            row += 1
    if held:
        yield sent()


def beside(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, chunk_no, data, pattern): each chunk of fixed() that another one follows, and that one as its pattern.

    Chunks of a key that one row has are cut side by side, and nothing is shuffled for them but the keys; those of a key
    that several rows have are joined, each row's with each row's. A null key has none.
    """
    docs = docs.select(key, text).filter(F.col(key).isNotNull())
    repeated = docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    many = repeated.limit(1).count() > 0
    alone = docs.join(repeated, key, "left_anti") if many else docs
    raw = alone.select(F.col(key).alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))
    kind = docs.schema[key].dataType.simpleString()
    rows = raw.mapInArrow(lambda batches: (x for b in batches for x in _beside(b.column(0), b.column(1), size)), f"key {kind}, chunk_no long, data binary, pattern binary").withColumnRenamed("key", key)
    if not many:
        return rows
    c = fixed(docs.join(repeated, key, "left_semi"), key, text, size).drop("off")
    after = c.select(key, (F.col("chunk_no") - 1).alias("chunk_no"), F.col("data").alias("pattern"))
    return rows.unionByName(c.join(after, [key, "chunk_no"]))


def delimited(docs: DataFrame, key: str, text: str, most: int = 1024) -> DataFrame:
    """Chunks that end after a line feed, or at `most` bytes."""
    lines = docs.select(key, F.posexplode(F.split(latin(F.col(text)), "(?<=\n)")).alias("line", "_t"))
    rows = lines.select(key, F.col("line").cast("long").alias("line"), F.posexplode(slices(F.col("_t"), most)).alias("part", "_c"))
    return rows.select(key, "line", F.col("part").cast("long").alias("part"), F.encode("_c", "ISO-8859-1").alias("data"))


def contextual(docs: DataFrame, key: str, text: str, kind: str, most: int = 1024, least: int = 32) -> DataFrame:
    """(key, chunk_no, data): chunks of `least` bytes, on to the next } or , of JSON or line feed of other text, `most` bytes in all; binary kinds are cut at `most`."""
    cut = lambda ends: f"(?s).{{{least}}}[^{ends}]{{0,{most - least - 1}}}[{ends}]|.{{1,{most}}}"
    every = lambda pattern: F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))
    parts = F.when(F.col("_k") == "JSON", every(cut("},"))).when(F.col("_k").isin(*BINARY), slices(F.col("_t"), most)).otherwise(every(cut("\\n")))
    rows = docs.select(key, F.coalesce(F.col(kind), F.lit("UNKNOWN")).alias("_k"), latin(F.col(text)).alias("_t"))
    return rows.select(key, F.posexplode(parts).alias("chunk_no", "_c")).select(key, F.col("chunk_no").cast("long").alias("chunk_no"), F.encode("_c", "ISO-8859-1").alias("data"))


def polynomial(data: Column) -> Column:
    """Seed a + 256 b + 65536 c of bytes that are a x^2 + b x + c mod 256 at every place x, with the smallest a; null where none is.

    c is the first byte, a + b the second less c; the third then gives 2a, and x^2 - x is even, so a below 128 decides.
    """
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    byte = lambda x: F.ascii(F.substr(F.decode(data, "ISO-8859-1"), x + 1, F.lit(1)))

    def seed(d: Column) -> Column:
        c = F.get(d, F.lit(0))
        s = F.coalesce(F.get(d, F.lit(1)) - c, F.lit(0))
        twice = F.coalesce(F.pmod(F.get(d, F.lit(2)) - c - 2 * s, F.lit(256)), F.lit(0))
        return F.when(twice % 2 == 0, let(F.floor(twice / 2).cast("int"), lambda a: let(F.pmod(s - a, F.lit(256)), lambda b: checked(d, a, b, c))))

    def checked(d: Column, a: Column, b: Column, c: Column) -> Column:
        whole = F.forall(F.transform(d, lambda y, x: F.pmod((a * x + b) * x + c - y, F.lit(256))), lambda r: r == 0)
        return F.when(whole, (a + 256 * b + 65536 * c).cast("long"))

    return F.when(F.length(data) > 0, let(F.transform(F.sequence(F.lit(0), F.length(data) - 1), byte), seed))


def frequency(chunks: DataFrame) -> DataFrame:
    """(data, n): partial counts are made before the shuffle."""
    return chunks.groupBy("data").agg(F.count(F.lit(1)).alias("n"))


def bucket16(data: Column) -> Column:
    """First byte plus 256 times the second; 0 for less than two bytes."""
    hexed = F.hex(data)
    low, high = F.conv(F.substring(hexed, 1, 2), 16, 10), F.conv(F.substring(hexed, 3, 2), 16, 10)
    return F.when(F.length(data) < 2, F.lit(0)).otherwise((low.cast("int") + 256 * high.cast("int"))).cast("long")


def elite(counts: DataFrame, per_bucket: int, most: int) -> DataFrame:
    """Codewords: the most frequent of each 16-bit bucket, then the most frequent of all; by bytes among equals.

    The first cut is a grouping that Spark turns into partial top-k's, the second a top-k.
    """
    w = Window.partitionBy("bucket").orderBy(F.desc("n"), "data")
    cut = counts.withColumn("bucket", bucket16(F.col("data"))).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_bucket)
    top = cut.orderBy(F.desc("n"), "data").limit(most)
    return top.select((F.row_number().over(Window.orderBy("bucket", F.desc("n"), "data")) - 1).cast("long").alias("id"), "bucket", "n", "data")


def augmented(counts: DataFrame) -> DataFrame:
    """Counts with each repeated chunk's shifts left and right by a byte and its rotation, at half its count (1 at least)."""
    n = F.length("data")
    variants = F.array(F.concat(F.substring(F.col("data"), F.lit(2), n), F.unhex(F.lit("00"))), F.concat(F.unhex(F.lit("00")), F.substring(F.col("data"), F.lit(1), n - 1)), F.concat(F.substring(F.col("data"), F.lit(2), n), F.substring(F.col("data"), 1, 1)))
    more = counts.filter("n > 1").select(F.explode(variants).alias("data"), F.greatest(F.floor(F.col("n") / 2), F.lit(1)).cast("long").alias("n"))
    return counts.select("data", "n").unionByName(more).groupBy("data").agg(F.sum("n").alias("n"))


def xor(a: Column, b: Column) -> Column:
    """Bytes of a, each XORed with b's at its place; bytes beyond b stay. In hex, byte by byte."""
    ha, hb = F.hex(a), F.hex(b)
    one = lambda i: F.lpad(F.hex(F.conv(F.substr(ha, 2 * i + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.when(i < F.length(b), F.conv(F.substr(hb, 2 * i + 1, F.lit(2)), 16, 10).cast("int")).otherwise(F.lit(0)))), 2, "0")
    return F.when(F.length(a) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.length(a) - 1), one), "")).otherwise(F.lit(""))


def leaf_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, idx) of leaves (key, idx, hash) that differ; every leaf of either side where their numbers of leaves differ."""
    both = a.select(key, "idx", F.col("hash").alias("_a")).join(b.select(key, "idx", F.col("hash").alias("_b")), [key, "idx"], "full")
    # a leaf that one side lacks tells that the numbers differ
    uneven = both.filter("_a IS NULL OR _b IS NULL").select(key).distinct().withColumn("_all", F.lit(True))
    return both.join(uneven, key, "left").filter("_all OR NOT _a <=> _b").select(key, "idx")


def merkle_root(leaves: DataFrame, key: str) -> DataFrame:
    """(key, root, leaves): SHA-256 of pairs, level by level; an odd last node pairs with itself. leaves: (key, idx, hash hex).

    One pass over the levels of the largest key; all keys go up together, each until one node is left.
    """
    now = leaves
    total = leaves.groupBy(key).agg(F.count(F.lit(1)).alias("n_leaves"))
    most = total.agg(F.max("n_leaves")).first()[0] or 0
    while most > 1:
        pair = now.groupBy(key, F.floor(F.col("idx") / 2).cast("long").alias("idx")).agg(F.min_by("hash", "idx").alias("l"), F.max_by("hash", "idx").alias("r"), F.count(F.lit(1)).alias("c"), F.min("last").alias("last"))
        node = F.when((F.col("last") == 0), F.col("l")).otherwise(F.sha2(F.unhex(F.concat("l", "r")), 256))
        now = pair.select(key, "idx", node.alias("hash"), F.floor(F.col("last") / 2).cast("long").alias("last"))
        most = -(-most // 2)
    return now.select(key, F.col("hash").alias("root")).join(total, key)
