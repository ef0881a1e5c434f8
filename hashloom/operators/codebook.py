"""Nearest codewords, tiers of codebooks, routing to a codebook, and encryption under which equal chunks stay equal.

A codebook is (id, data) of a bounded number of codewords of one length, as chunks.elite() gives it; it is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from .chunks import bucket16
from .pairs import binary, rows_of

#: Byte strings that are compared with a codebook at once.
STRIP = 8


def words(data: Column) -> Column:
    """Bytes as 32-bit unsigned numbers, the last one filled with zero bytes. None: an empty array."""
    hexed, n = F.hex(data), F.length(data)
    one = lambda i: F.conv(F.rpad(F.substr(hexed, 8 * i + 1, F.lit(8)), 8, "0"), 16, 10).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")), one)).otherwise(F.array().cast("array<long>"))


def words_distance(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def byte_distance(a: Column, b: Column) -> Column:
    """Differing bits of two byte strings; each byte that only one of them has counts 8."""
    common = F.least(F.length(a), F.length(b))
    return words_distance(words(F.substring(a, F.lit(1), common)), words(F.substring(b, F.lit(1), common))) + 8 * F.abs(F.length(a) - F.length(b))


def _number(data) -> int:
    return int.from_bytes(data, "little")


@F.pandas_udf(LongType())
def far(a: pd.Series, b: pd.Series) -> pd.Series:
    """byte_distance() of two byte strings, a batch at a time; null where one is null."""

    def one(x, y):
        n = min(len(x), len(y))
        return (_number(x[:n]) ^ _number(y[:n])).bit_count() + 8 * (len(x) + len(y) - 2 * n)

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def _lengths(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes, and how many each row has; null: none."""
    parts = [*rows_of(column, 1 << 62)]
    return (parts[0][0], np.diff(np.r_[0, parts[0][1]])) if parts else (np.zeros(0, np.uint8), np.zeros(0, np.int64))


def xored_bytes(a: pa.Array, b: pa.Array) -> pa.Array:
    """xored() of binary columns: rows are filled up to the longest, but for batches that this would make much larger."""
    (x, nx), (y, ny) = _lengths(a), _lengths(b)
    width = int(nx.max(initial=0))
    if len(nx) * width > 4 * len(x) + (1 << 20):
        one = lambda p, q: None if p is None or q is None else (_number(p) ^ _number(q[: len(p)])).to_bytes(len(p), "little")
        return pa.array([one(p, q) for p, q in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.binary())
    place, common = np.arange(width), np.minimum(nx, ny)[:, None]
    left, right = np.zeros((len(nx), width), np.uint8), np.zeros((len(nx), width), np.uint8)
    own = place < nx[:, None]
    left[own] = x
    # bytes of y at the places that x has too
    skip = np.arange(len(y)) - np.repeat(np.cumsum(ny) - ny, ny) < np.repeat(nx, ny)
    right[place < common] = y[skip]
    out = binary(np.r_[0, np.cumsum(nx)], (left ^ right)[own])
    return pc.if_else(pc.and_(a.is_valid(), b.is_valid()), out, pa.scalar(None, pa.binary()))


@F.arrow_udf(BinaryType())
def xored(a: pa.Array, b: pa.Array) -> pa.Array:
    """chunks.xor() of two byte strings as bytes, a batch at a time: a's bytes, each XORed with b's at its place; null where one is null."""
    return xored_bytes(a, b)


def similarity(distance: Column, bits: Column) -> Column:
    return F.when(bits == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - distance / bits))


def _best(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.min(F.struct(words_distance(F.col("_w"), F.col("_b")).alias("distance"), "id")).alias("m")).select(*keys, "m.id", "m.distance")


def nearest_linear(queries: DataFrame, book: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, distance): of each query (keys, data) the nearest codeword, the smallest id of equals.

    Equal data are searched once, and their codeword is joined back. Minima are partial before the shuffle.
    """
    q = queries.select("data").distinct().select("data", words(F.col("data")).alias("_w"))
    found = _best(q.crossJoin(F.broadcast(book.select("id", words(F.col("data")).alias("_b")))), ["data"])
    return queries.select(*keys, "data").join(found, "data").select(*keys, "id", "distance")


def nearest_bucketed(queries: DataFrame, book: DataFrame, keys: list[str]) -> DataFrame:
    """As nearest_linear, among the codewords of a query's 16-bit bucket; all codewords where the bucket has none."""
    q = queries.withColumn("_bucket", bucket16(F.col("data")))
    b = book.withColumn("_bucket", bucket16(F.col("data")))
    pairs = q.select(*keys, "_bucket", words(F.col("data")).alias("_w")).join(F.broadcast(b.select("_bucket", "id", words(F.col("data")).alias("_b"))), "_bucket")
    alone = q.join(F.broadcast(b.select("_bucket").distinct()), "_bucket", "left_anti")
    return _best(pairs, keys).unionByName(nearest_linear(alone, book, keys))


def _matrix(data: list[bytes], width: int) -> np.ndarray:
    """Byte strings as rows of 64-bit words, filled with zero bytes."""
    return np.frombuffer(b"".join(bytes(x).ljust(8 * width, b"\0") for x in data), np.uint64).reshape(len(data), width)


def nearest_tiered(queries: DataFrame, tiers: list[DataFrame], keys: list[str], bits: int) -> DataFrame:
    """(keys, tier, id, distance) from the first codebook whose nearest codeword is within half the bits; if none is, the nearest of all.

    The codebooks, which are bounded, come to the driver and go to the tasks; equal data are searched once, STRIP at a time.
    """
    books = [[(r["id"], bytes(r["data"])) for r in t.select("id", "data").orderBy("id").collect()] for t in tiers]
    width = max((-(-len(d) // 8) for book in books for _, d in book), default=0)
    books = [(k, np.array([i for i, _ in book], np.int64), np.ascontiguousarray(_matrix([d for _, d in book], width).T)) for k, book in enumerate(books) if book]

    def nearest(asked: np.ndarray, ids: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distance, at = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        for i in range(0, len(asked), STRIP):
            far = np.zeros((len(asked[i : i + STRIP]), len(ids)), np.uint32)
            for w in range(width):
                far += np.bitwise_count(asked[i : i + STRIP, w, None] ^ words[None, w])
            first = far.argmin(axis=1)  # the smallest id of equals
            at[i : i + STRIP], distance[i : i + STRIP] = ids[first], far[np.arange(len(first)), first]
        return distance, at

    def run(batches):
        for b in batches:
            data = b.column(0).to_pylist()
            if not books or not data:
                continue
            asked = _matrix(data, max(width, max(-(-len(d) // 8) for d in data)))
            best = None
            for k, ids, words in books:
                distance, at = nearest(asked, ids, words)
                now = np.stack([np.full(len(at), k), at, distance])
                # what is near enough stays; else the nearer, the tier before of equals
                best = now if best is None else np.where((best[2] * 2 <= bits) | (now[2] * 2 > bits) & (best[2] <= now[2]), best, now)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in best)], names=["data", "tier", "id", "distance"])

    told = queries.select("data").distinct().mapInArrow(run, "data binary, tier long, id long, distance long")
    return queries.select(*keys, "data").join(told, "data").select(*keys, "tier", "id", "distance")


def packed(rows: DataFrame, book: DataFrame, keys: list[str], worth: float = 0.2, sure: float = 0.95) -> DataFrame:
    """rows (keys, data) with decision, id, distance and stored: against the nearest codeword of a chunk's 16-bit bucket a chunk
    is a `hit` above the similarity `sure`, a `delta` (its XOR with the codeword) above `worth`, else a `literal`, stored as it is.

    A chunk that repeats is searched once. A codebook has few codewords in a bucket, so no chunk meets many.
    """
    distinct = rows.groupBy("data").agg(F.count(F.lit(1)).alias("_n")).select("data", bucket16(F.col("data")).alias("_bucket"))
    b = F.broadcast(book.select(bucket16(F.col("data")).alias("_bucket"), "id", F.col("data").alias("_pattern")))
    pairs = distinct.join(b, "_bucket", "left").withColumn("distance", far("data", "_pattern"))
    near = pairs.groupBy("data").agg(F.min(F.struct("distance", "id", "_pattern")).alias("m"))
    alike = similarity(F.col("m.distance"), 8 * F.length("data"))
    decision = F.when(F.col("m.id").isNull() | (alike <= worth), "literal").when(alike > sure, "hit").otherwise("delta")
    told = near.select("data", decision.alias("decision"), "m.id", "m.distance", F.col("m._pattern").alias("_pattern"))
    stored = F.when(F.col("decision") == "literal", F.col("data")).otherwise(xored("data", "_pattern"))
    told = told.select("data", "decision", F.when(F.col("decision") != "literal", F.col("id")).alias("id"), "distance", stored.alias("stored"))
    return rows.join(told, "data").select(*keys, "data", "decision", "id", "distance", "stored")


def rebuilt(stored: DataFrame, book: DataFrame) -> DataFrame:
    """stored (.., decision, id, stored) with the data again, from the stored bytes and the codebook."""
    b = F.broadcast(book.select("id", F.col("data").alias("_pattern")))
    data = F.when(F.col("decision") == "literal", F.col("stored")).otherwise(xored("stored", "_pattern"))
    return stored.join(b, "id", "left").withColumn("data", data).drop("_pattern")


def priority_merge(old: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """(place, old, n, data): the patterns of old by falling count, then those of new that old lacks, `most` in all (a codebook's size)."""
    both = old.select("data", "n", F.lit(True).alias("old")).unionByName(new.join(old.select("data"), "data", "left_anti").select("data", "n", F.lit(False).alias("old")))
    top = both.orderBy(F.desc("old"), F.desc("n"), "data").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("old"), F.desc("n"), "data")) - 1
    return top.select(place.cast("long").alias("place"), "old", "n", "data")


def tier_id(tier: Column, id_col: Column) -> Column:
    """A codeword's id with its tier in the top two bits."""
    return F.call_function("shiftleft", tier, F.lit(62)).bitwiseOR(id_col)


def route(rows: DataFrame, books: DataFrame, universal: str = "universal") -> DataFrame:
    """rows (category, hint, size) with `book`: the first codebook (book, category, hint, size) of the category, else of the
    hint, else the universal one, else any of the size; null if there is none. books is a registry of few rows.
    """

    def first(column: str | None, name: str, where: Column | None = None) -> DataFrame:
        kept = books if where is None else books.filter(where)
        by = ["size"] if column is None else ["size", column]
        return F.broadcast(kept.groupBy(*by).agg(F.min("book").alias(name)))

    out = rows.join(first("category", "_c"), ["size", "category"], "left").join(first("hint", "_h"), ["size", "hint"], "left")
    out = out.join(first(None, "_u", F.col("category") == universal), "size", "left").join(first(None, "_a"), "size", "left")
    return out.withColumn("book", F.coalesce("_c", "_h", "_u", "_a")).drop("_c", "_h", "_u", "_a")


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC with a secret known to the driver: its two pads are literals, the digests run in Spark."""
    key = (secret if len(secret) <= 64 else hashlib.sha256(secret).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256))


def seal(data: Column, secret: bytes) -> Column:
    """AES-256-GCM under a key and nonce that follow from the data: equal data give equal results, and dedupe."""
    digest = F.unhex(F.sha2(data, 256))
    return F.aes_encrypt(data, hmac_sha256(secret, digest), F.lit("GCM"), F.lit("DEFAULT"), F.substring(digest, 1, 12))


def unseal(sealed: Column, digest: Column, secret: bytes) -> Column:
    """The data of seal(), given their SHA-256."""
    return F.aes_decrypt(sealed, hmac_sha256(secret, digest), F.lit("GCM"))


#: Fixed value: rounds that stretch a password into a key.
ROUNDS = 100_000


def stretched(password: bytes, salt: bytes) -> bytes:
    """A 256-bit key of a password: PBKDF2 with SHA-256, once on the driver; a salt is 16 random bytes kept beside the result."""
    return hashlib.pbkdf2_hmac("sha256", password, salt, ROUNDS, 32)


def lock(data: Column, key: bytes) -> Column:
    """AES-256-GCM under one key: a random nonce, then the data and their tag; equal data differ. Null stays null."""
    return F.aes_encrypt(data, F.lit(key), F.lit("GCM"))


def unlock(locked: Column, key: bytes) -> Column:
    """The data of lock(); null where the key is another or the bytes were changed."""
    return F.try_aes_decrypt(locked, F.lit(key), F.lit("GCM"))
