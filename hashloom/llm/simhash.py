"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of a fingerprint gets a non-zero vector of r+1 bits; each non-zero v of r+1 bits gives one mask, of the bits
whose vector has an odd product with v. For any r differing bits some v is orthogonal to all their vectors, so two
fingerprints at distance r or less agree on one whole mask: the tables miss no pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, texts_of, with_row_key, without
from .components import components

#: Buckets of more distinct fingerprints than this are linked by shared neighbours at one bit, not by pairs.
PAIRWISE = 48


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles: a bit is set where over half of the shingles' XXH64 have it; no words: 0."""
    words = data.lower().split()  # of bytes: A-Z only, and the white space 9-13 and 32 only
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hash64(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    hashes = np.fromiter([hash64(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        counts += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp), and the long columns named by more: fp is the unsigned fingerprint's 64 bits as a signed long. Null and empty texts: 0."""

    def tasks(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *more])

    return map_batches(texts_of(docs, *more), tasks, ", ".join(f"{c} long" for c in ["doc_id", "fp", *more]))


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1)-1 masks over 64 bits, as signed longs."""
    vectors = (1 << (radius + 1)) - 1
    phi = [1 + i * 5 % vectors for i in range(64)]
    masks = [sum(1 << i for i in range(64) if (phi[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) whose transitive closure is that of all pairs within radius.

    Small buckets are compared pair by pair. In a larger one (exact for radius 1 and 2), each fingerprint names itself
    and its one-bit neighbours outside the mask: two that share such a name are within 2 bits, and two within 2 bits
    share one. A name has at most 65 owners, so nothing grows with the square of a bucket.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(covering_masks(radius))))
    rows = materialize(distinct.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.mask", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key")), "tables")
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    busy = materialize(rows.join(materialize(sizes, "buckets"), ["t", "key"]), "buckets")
    small = busy.filter(F.col("size") <= pairwise).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = F.expr(f"flatten(transform(fps, (a, i) -> transform(filter(slice(fps, i + 2, size(fps)), b -> bit_count(a ^ b) <= {radius}), b -> struct(a AS u, b AS v))))")
    pairs = small.select(F.explode(near).alias("e")).select("e.u", "e.v")
    flips = F.expr("concat(array(fp), transform(filter(sequence(0, 63), i -> (shiftright(mask, i) & 1) = 0), i -> fp ^ shiftleft(1L, i)))" if radius == 2 else "array(fp)")
    if radius == 2:
        named = busy.filter(F.col("size") > pairwise).select("fp", "t", F.explode(flips).alias("name"))
        stars = named.groupBy("t", "name").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    else:  # one bit apart: the one with the bit clear names the pair
        named = busy.filter(F.col("size") > pairwise).select("fp", F.explode(F.expr("transform(filter(sequence(0, 63), i -> (shiftright(mask, i) & 1) = 0), i -> struct(i AS bit, fp & ~shiftleft(1L, i) AS name))")).alias("x"))
        stars = named.groupBy("x.bit", "x.name").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    hub = stars.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u <> v")
    return pairs.unionByName(hub)


def grouped(docs: DataFrame, radius: int = 2, width: int = 3, pairwise: int = PAIRWISE, more: tuple[str, ...] = ()) -> DataFrame:
    """What near_duplicates() gives, with the component's root (a fingerprint) and the long columns named by more."""
    fps = materialize(fingerprints(docs, width, more), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, radius, pairwise))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "placed")
    least = materialize(placed.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = materialize(placed.join(least, "root").select("fp", "component_id", "root"), "named")
    return fps.join(named, "fp", "left")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, pairwise: int = PAIRWISE) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (smallest doc_id reachable over links, itself included).

    Null, empty and blank texts have fingerprint 0 and link like any other. Equal fingerprints link. A null doc_id
    takes part, but names a component only if the component has no other. No documents: no rows.
    """
    return grouped(docs, radius, width, pairwise).select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, **how) -> DataFrame:
    """docs without those that are not the smallest doc_id of their component; rows are chosen by their row key, not by doc_id.

    Null doc_ids name no document: of a component that only such rows make up, the first row stays. Repeated rows of
    the smallest doc_id all stay. Only rows that may go are shuffled with their text.
    """
    rows, key = with_row_key(docs)
    found = materialize(grouped(rows, more=(key,), **how), "grouped")
    others = found.filter("component_id IS NOT NULL AND NOT doc_id <=> component_id").select(key)
    nameless = found.filter("component_id IS NULL")
    first = nameless.groupBy("root").agg(F.min(key).alias("_first"))
    again = nameless.join(first.hint("merge"), "root").filter(F.col(key) > F.col("_first")).select(key)
    return without(rows, [key], materialize(others.unionByName(again), "others")).drop(key)
