"""Byte work that SQL functions cannot say well: entropy, content-defined chunks, merges."""

from __future__ import annotations

import functools
import hashlib
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .pairs import GAP, column_of, learn, rows_of, spaced
from .pairs import merged as paired

#: Bytes that the rolling hash sees: its low bits depend on no more.
WINDOW = 16
#: Bytes of a text that are hashed at once, and chunks that a task sends on at once.
PART, ROWS = 1 << 22, 10_000


def byte_entropy(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_bytes, entropy): Shannon bits per byte of each text; empty texts 0."""

    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return docs.select(key, F.octet_length(data).cast("long").alias("n_bytes"), entropy(data).alias("entropy"))


@F.pandas_udf(DoubleType())
def _entropy(data: pd.Series) -> pd.Series:
    out = []
    for x in data:
        c = np.bincount(np.frombuffer(x or b"", np.uint8), minlength=1)
        p = c[c > 0] / max(1, c.sum())
        out.append(float(-(p * np.log2(p)).sum()))
    return pd.Series(out, dtype="float64")


def entropy(data: Column) -> Column:
    """Shannon bits per byte; empty and null: 0."""
    return _entropy(data)


@functools.cache
def gear() -> np.ndarray:
    """256 mixed 64-bit constants, from a multiplicative rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _parts(data: bytes, before: int, behind: int):
    """(first place, place in the part, bytes) of a text's parts of PART bytes, with some bytes of what lies around."""
    for at in range(0, len(data), PART):
        first = max(0, at - before)
        yield first, at - first, np.frombuffer(data, np.uint8, min(at + PART + behind, len(data)) - first, first)


def cut_points(data: bytes, target: int) -> list[int]:
    """Ends of chunks: candidates are where the shifted sum of the last gears has its low bits clear; quarter to four times the target long."""
    places = []
    for first, own, part in _parts(data, WINDOW, 0):
        b = gear()[part]
        h = b.copy()
        for k in range(1, min(WINDOW, int(target).bit_length())):
            h[k:] += b[:-k] << np.uint64(k)
        places += (np.flatnonzero((h[own:] & np.uint64(target - 1)) == 0) + first + own + 1).tolist()
    ends, start, n = [], 0, len(data)
    for p in [*places, n]:
        while p - start > 4 * target:
            start += 4 * target
            ends.append(start)
        if p - start >= target // 4 or p == n and p > start:
            ends.append(p)
            start = p
    return ends


#: The multiplier of the polynomial hash and the bytes it covers.
BASE, COVERED = 1099511628211, 8


def rabin_cuts(data: bytes, target: int) -> list[int]:
    """Ends of chunks: where the polynomial hash of the last eight bytes is a multiple of target; a quarter to twice the target long.

    The hash covers bytes of the chunk at hand only, and is looked at once a chunk has a quarter of the target and
    eight bytes. A text of a quarter or less is one chunk.
    """
    n, least, most = len(data), target // 4, 2 * target
    if n <= least:
        return [n] if n else []
    places = [np.zeros(0, np.int64)]
    for first, _, part in _parts(data, 0, COVERED - 1):
        h = np.zeros(max(0, len(part) - COVERED + 1), np.uint64)  # of the bytes from i on
        for k in range(COVERED if len(h) else 0):
            h = h * np.uint64(BASE) + part[k : k + len(h)]
        places.append(np.flatnonzero(h % np.uint64(target) == 0) + first + COVERED - 1)  # of the last byte
    places = np.concatenate(places)
    ends, start = [], 0
    while start < n:
        # the hash of a whole window is the same wherever the chunk began, once the window lies inside it
        k = np.searchsorted(places, start + max(least, COVERED))
        at = int(places[k]) if k < len(places) else n
        end = min(at + 1 if at - start < most else start + most, n)
        ends.append(end)
        start = end
    return ends


def content_chunks(docs: DataFrame, key: str, text: str, target: int, cuts=cut_points) -> DataFrame:
    """(key, chunk_no, off, size, digest): chunks that an insertion moves but does not change, but for those around it.

    A text is cut and its chunks are digested where it lies: no row carries it, and tasks send ROWS chunks on at once.
    """
    if target & (target - 1):
        raise ValueError("target must be a power of two")

    def run(batches):
        for b in batches:
            held, n = [], 0
            for at in range(b.num_rows):
                data = b.column(1)[at].as_py()
                ends = cuts(data, target)
                held += [(at, k, a, z - a, hashlib.sha256(data[a:z]).hexdigest()) for k, (a, z) in enumerate(pairwise([0, *ends]))]
                n += len(data)
                if n >= PART or len(held) >= ROWS or at == b.num_rows - 1:
                    for i in range(0, len(held), ROWS):
                        rows, *more = zip(*held[i : i + ROWS], strict=True)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *map(pa.array, more)], names=["key", "chunk_no", "off", "size", "digest"])
                    held, n = [], 0

    raw = docs.select(F.col(key).alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))
    return raw.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, chunk_no long, off long, size long, digest string").withColumnRenamed("key", key)


#: The number of the word end as a symbol, above all characters; symbols that merges make follow it.
END = 0x110000


def _numbered(merges: list[tuple[int, str, str, int]]) -> dict[str, int]:
    """Numbers of the word end and of what merges make; a character's number is its code point."""
    out = {"</w>": END}
    for _, left, right, _ in merges:
        out.setdefault(left + right, END + len(out))
    return out


def _split(values: np.ndarray, ends: np.ndarray, empty: bool) -> np.ndarray:
    """Words' characters and word ends as numbers, with a GAP behind each word; without `empty`, an empty word has no word end."""
    letters = np.frombuffer(values.tobytes().decode().encode("utf-32-le"), "<i4")
    stops = np.r_[0, np.cumsum(values & 0xC0 != 0x80)][ends]
    ended = np.ones(len(ends), bool) if empty else np.diff(np.r_[0, ends]) > 0
    return spaced(np.insert(letters, stops[ended], END), stops + np.cumsum(ended))


def train(words: DataFrame, merges: int, every: int = 10) -> list[tuple[int, str, str, int]]:
    """Word-level merges (rank, left, right, count) from all of (word, n), whatever their number; ties by pair.

    The words stay in Spark, split as far as the merges are learnt; a job counts their pairs, and the counts of the
    commonest tell as many merges as are sure without another one. The split words are kept anew every few merges.
    """

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([column_of([_split(*x, True) for x in rows_of(b.column(0))]), b.column(1)], names=["ids", "n"])

    numbers = _numbered([])
    names = ["</w>"]

    def make(left: str, right: str) -> tuple[str, bool]:
        made = left + right
        unknown = made not in numbers
        if unknown:
            numbers[made] = END + len(names)
            names.append(made)
        return made, unknown

    split = words.filter("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")).mapInArrow(run, "ids binary, n long")
    out, _ = learn(split, merges, lambda k: chr(k) if k < END else names[k - END], lambda x: ord(x) if len(x) == 1 else numbers[x], make, every=every)
    return [(rank, *x) for rank, x in enumerate(out)]


def merged(word: tuple, left: str, right: str) -> tuple:
    parts, i = [], 0
    while i < len(word):
        if i + 1 < len(word) and word[i] == left and word[i + 1] == right:
            parts.append(left + right)
            i += 2
        else:
            parts.append(word[i])
            i += 1
    return tuple(parts)


def symbols(words: DataFrame, merges: list[tuple[int, str, str, int]]) -> list[str]:
    """Symbols by id: the mask, the single characters and word end in order, then what each merge makes."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()
    return list(dict.fromkeys(["[MASK]", *sorted({r["c"] for r in letters} | {"</w>"}), *(left + right for _, left, right, _ in merges)]))


def encode(words: DataFrame, merges: list[tuple[int, str, str, int]], table: list[str]) -> DataFrame:
    """Adds ids to distinct words: all merges in the order they were learnt; symbols not in the table are the mask. A null word has none."""
    place, numbers = {x: i for i, x in enumerate(table)}, _numbered(merges)
    number = lambda x: ord(x) if len(x) == 1 else numbers.get(x, GAP - 1)
    new = [(number(left), number(right), numbers[left + right]) for _, left, right, _ in merges]
    made = np.array([place.get(x, 0) for x in numbers], np.int32)

    @F.arrow_udf("array<int>")
    def ids(word: pa.Array) -> pa.Array:
        sizes, parts = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
        for values, ends in rows_of(word):
            flat = paired(_split(values, ends, False), new)
            gaps = np.flatnonzero(flat == GAP)
            sizes.append(np.diff(np.r_[-1, gaps]) - 1)
            told, at = np.unique(flat[flat != GAP], return_inverse=True)
            parts.append(np.array([place.get(chr(k), 0) if k < END else made[k - END] for k in told.tolist()], np.int32)[at])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(parts)))

    return words.withColumn("ids", ids("word"))


def decode(ids, table: list[str]):
    """Text of ids: symbols joined, word ends as spaces; masks stay visible."""
    names = F.array(*(F.lit(x) for x in table))
    return F.trim(F.replace(F.array_join(F.transform(ids, lambda i: F.get(names, i)), ""), F.lit("</w>"), F.lit(" ")))
