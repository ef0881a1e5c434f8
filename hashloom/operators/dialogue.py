"""Conversations in order: caches of hashes, contexts that reset or decay, centroids of greetings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions.bits import hamming
from hashloom.streaming.state import cache_step

_MASK = (1 << 64) - 1


class Held:
    """Hashes in the order they came, in one growing array."""

    def __init__(self):
        self.n, self.hashes, self.turns = 0, np.zeros(16, np.uint64), []

    def add(self, h: int, turn: int) -> None:
        if self.n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(self.n, np.uint64)])
        self.hashes[self.n] = h
        self.turns.append(turn)
        self.n += 1

    def first(self, h: int, limit: int) -> tuple[int, int] | None:
        """(turn, distance) of the first hash within limit."""
        d = np.bitwise_count(self.hashes[: self.n] ^ np.uint64(h))
        near = d <= limit
        if not near.any():
            return None
        at = int(near.argmax())
        return self.turns[at], int(d[at])


def _in_order(firsts: DataFrame, step, schema: str) -> DataFrame:
    """Rows (conv_id, turn, ...) of each conversation in the order of turns through step(held, row): a task reads rows one
    after another and holds only the hashes of the conversation at hand, never its rows."""

    def tasks(batches):
        conv, held, fresh = None, Held(), True
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            out = []
            for row in rows:
                if fresh or row[0] != conv:
                    conv, held, fresh = row[0], Held(), False
                out.append((*row, *step(held, row)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]
    return firsts.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(tasks, schema)


def cache_fold(turns: DataFrame, limit: int = 20) -> DataFrame:
    """(conv_id, turn, hash) -> conv_id, turn, action, match_turn, distance: each turn reuses the first stored hash within
    limit (`hit`), or stores its own (`insert`; match_turn and distance null).

    A hash that comes again gets what its first coming got, or finds itself, so only distinct hashes of a conversation
    are taken in order. That order is the operator: one conversation's distinct hashes go through one task, one by one.
    """
    firsts = turns.groupBy("conv_id", "hash").agg(F.min("turn").alias("turn")).select("conv_id", "turn", "hash")

    def step(held, row):
        h = row[2] & _MASK
        found = held.first(h, limit)
        if found is None:
            held.add(h, row[1])
            return row[1], 0
        return found

    schema = "conv_id long, turn long, hash long, match_turn long, distance long"
    known = _in_order(firsts, step, schema).drop("turn")
    own = F.col("turn") == F.col("match_turn")
    joined = turns.join(known.hint("merge"), ["conv_id", "hash"])
    return joined.select("conv_id", "turn", F.when(own, "insert").otherwise("hit").alias("action"), *(F.when(~own, F.col(c)).alias(c) for c in ("match_turn", "distance")))


def reset_fold(turns: DataFrame, limit: int = 20, middle: float = 12.0) -> DataFrame:
    """(conv_id, turn, raw, mixed) -> conv_id, turn, action, distance: the batch form of the streaming semantic cache.

    mixed is the raw hash with the context of the turn before. A near and sure match is a `hit`; a near, unsure one
    stores the raw hash (`reset`); without one the mixed hash is stored (`insert`). Only distinct pairs are in order.
    """
    firsts = turns.groupBy("conv_id", "mixed", "raw").agg(F.min("turn").alias("turn")).select("conv_id", "turn", "mixed", "raw")

    def step(held, row):
        mixed, raw = row[2] & _MASK, row[3] & _MASK
        action, distance, h = cache_step(mixed, held.hashes[: held.n], raw, limit, middle, mixed=mixed)
        if action != "hit":
            held.add(h, row[1])
        return action, distance

    schema = "conv_id long, first long, mixed long, raw long, act string, far long"
    known = _in_order(firsts, step, schema.replace("first", "turn")).withColumnRenamed("turn", "first")
    joined = turns.join(known.hint("merge"), ["conv_id", "mixed", "raw"])
    again = (F.col("act") == "insert") & (F.col("turn") > F.col("first"))
    return joined.select("conv_id", "turn", F.when(again, "hit").otherwise(F.col("act")).alias("action"), F.when(again, 0).otherwise(F.col("far")).cast("long").alias("distance"))


def anchored(turns: DataFrame, centre: DataFrame, words: Column, most_words: int, limit: int) -> DataFrame:
    """turns (.., hash) with distance to the one hash of centre, and whether a short turn is near enough for the stock answer."""
    d = hamming(F.col("hash"), F.col("_centre"))
    near = turns.crossJoin(F.broadcast(centre.select(F.col("hash").alias("_centre"))))  # one row
    return near.withColumn("distance", d).withColumn("anchored", (words <= most_words) & (F.col("distance") <= limit)).drop("_centre")
