"""An index for Hamming searches with a stated recall: tables keyed by sampled bits, probed with a few bits flipped.

Two hashes within the radius agree on a table's sampled bits, but for `flips` of them, with a chance that is known; the
number of tables follows from it and from the recall asked for. Candidates meet by equality of keys and are verified,
and each pair counts in the first table alone in which it meets, so that no pairs are gathered to be made distinct.
Links between all rows are counted in blocks of distinct hashes: no pair is lost and none is found twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions.bits import hamming
from hashloom.sources.files import kept

from .search import class_links

WIDTH = 64
#: Tables, and keys of all tables that a row probes, at most.
TABLES, PROBES = 4096, 100_000
#: Distinct hashes of a block about.
CELL = 16_384
#: What moving a row once costs, in comparisons of pairs.
MOVE = 100


def meets(radius: int, bits: int, flips: int) -> float:
    """The chance that two hashes `radius` apart differ in at most `flips` of `bits` sampled places."""
    return sum(comb(radius, j) * comb(WIDTH - radius, bits - j) for j in range(min(flips, bits, radius) + 1)) / comb(WIDTH, bits)


def _signed(x: int) -> int:
    return x - (1 << WIDTH) if x >> (WIDTH - 1) else x


@dataclass(frozen=True)
class Tables:
    """Masks of sampled bits, as signed longs, and how many of them a probe may flip."""

    radius: int
    bits: int
    flips: int
    masks: tuple[int, ...]

    def patterns(self, mask: int) -> list[int]:
        """What a probe of a table XORs its key with: nothing, and each choice of up to `flips` of the mask's bits."""
        places = [i for i in range(WIDTH) if mask >> i & 1]
        return [_signed(sum(1 << i for i in some)) for n in range(self.flips + 1) for some in combinations(places, n)]


def tables(radius: int, bits: int, flips: int, recall: float, seed: int = 7) -> Tables:
    """As many tables as pairs at the radius need to meet with a chance of `recall`; nearer pairs meet more often."""
    chance = meets(radius, bits, flips)
    n = 1 if chance >= 1 else ceil(log(1 - recall) / log(1 - chance))
    rng = np.random.default_rng(seed)
    return Tables(radius, bits, flips, tuple(_signed(sum(1 << int(i) for i in rng.permutation(WIDTH)[:bits])) for _ in range(n)))


def sized(rows: int, radius: int, recall: float, seed: int = 7) -> Tables:
    """The tables that cost least for about so many rows: rows to move against pairs of unlike hashes that meet by chance."""
    best = None
    for bits in range(1, 33):
        for flips in range(min(4, bits)):
            chance = meets(radius, bits, flips)
            n = 1 if chance >= 1 else ceil(log(1 - recall) / log(1 - chance)) if chance > 1e-6 else TABLES + 1
            probes = sum(comb(bits, j) for j in range(flips + 1))
            if n > TABLES or n * probes > PROBES:
                continue
            cost = n * (1 + probes) * MOVE + n * probes / 2**bits * rows / 2
            if best is None or cost < best[0]:
                best = cost, bits, flips
    return tables(radius, best[1], best[2], recall, seed)


def _small(like: DataFrame, index: Tables) -> DataFrame:
    """One row per table (PROBES patterns in all at most): t, mask, patterns."""
    return F.broadcast(like.sparkSession.createDataFrame([(t, m, index.patterns(m)) for t, m in enumerate(index.masks)], "t int, mask long, patterns array<long>"))


def stored(rows: DataFrame, index: Tables) -> DataFrame:
    """rows (hash, ..), once for each table, with its number t and key."""
    return rows.crossJoin(_small(rows, index).select("t", "mask")).withColumn("key", F.col("hash").bitwiseAND(F.col("mask"))).drop("mask")


def probing(rows: DataFrame, index: Tables) -> DataFrame:
    """rows (hash, ..), once for each key that they ask for."""
    each = rows.crossJoin(_small(rows, index)).select(*rows.columns, "t", "mask", F.explode("patterns").alias("_x"))
    return each.withColumn("key", F.col("hash").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("_x"))).drop("mask", "_x")


def first_meeting(a: Column, b: Column, t: Column, index: Tables) -> Column:
    """Whether no table before t brings the two hashes together."""
    before = F.slice(F.array(*(F.lit(m).cast("long") for m in index.masks)), F.lit(1), t)
    return ~F.exists(before, lambda m: F.bit_count(a.bitwiseXOR(b).bitwiseAND(m)) <= index.flips)


def meeting(index: Tables) -> Callable[[np.ndarray], np.ndarray]:
    """A function of differing bits that tells whether some table brings two such hashes together."""

    def met(differ: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(differ), bool), np.arange(len(differ))
        for m in np.array(index.masks, np.int64).view(np.uint64):
            hit = np.bitwise_count(differ[left] & m) <= index.flips
            out[left[hit]] = True
            left = left[~hit]
        return out

    return met


def links(rows: DataFrame, index: Tables, cell: int = CELL) -> DataFrame:
    """(id, n_links) of rows (id, hash): how many others within the radius the index finds; equal hashes are one class and always found.

    For all rows against all, comparing blocks of distinct hashes is cheaper than moving each row to each table; pairs
    within the radius count if a table has them together. A null hash has no links. No rows: no rows.
    """
    classes = kept(rows.filter("hash IS NOT NULL").groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "classes")
    counted = class_links(classes, index.radius, max(cell, 16), meeting(index))
    return rows.join(counted, "hash", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def found(queries: DataFrame, rows: DataFrame, index: Tables) -> DataFrame:
    """(query, id, distance): rows (id, hash) within the radius of queries (query, qhash) that the index finds, each once; not the query itself."""
    asking = probing(queries.withColumn("hash", F.col("qhash")), index).drop("hash")
    met = asking.join(stored(rows, index), ["t", "key"]).withColumn("distance", hamming(F.col("hash"), F.col("qhash")))
    near = met.filter((F.col("id") != F.col("query")) & (F.col("distance") <= index.radius))
    return near.filter(first_meeting(F.col("hash"), F.col("qhash"), F.col("t"), index)).select("query", "id", "distance")


def first_found(queries: DataFrame, rows: DataFrame, index: Tables) -> DataFrame:
    """(query, id, distance): of what found() gives, the first in id order of each query."""
    return found(queries, rows, index).groupBy("query").agg(F.min(F.struct("id", "distance")).alias("m")).select("query", "m.id", "m.distance")
