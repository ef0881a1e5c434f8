"""A codebook carried over to another corpus, and chunks given up to their codewords within a budget of changed bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks


def transferred(base: DataFrame, counts: DataFrame, most: int, per_bucket: int = 8) -> DataFrame:
    """(place, origin, n, data): a codebook for the corpus of counts (data, n), begun with the words of base (id, data).

    Base words weigh what the new corpus hits them, not what they once weighed. Those it hits come first (`base`), then the
    new corpus's own elite that base lacks (`new`), then, where places are left, base words without a hit (`idle`). Among
    equals the bytes decide. Both codebooks and `most` are bounded.
    """
    weighed = base.select("id", "data").join(counts, "data", "left").select("data", F.coalesce("n", F.lit(0)).alias("n"))
    old = weighed.withColumn("origin", F.when(F.col("n") > 0, "base").otherwise("idle"))
    fresh = chunks.elite(counts, per_bucket, most).select("data", "n").join(base.select("data"), "data", "left_anti").withColumn("origin", F.lit("new"))
    rank = F.when(F.col("origin") == "base", 0).when(F.col("origin") == "new", 1).otherwise(2)
    order = [rank, F.desc("n"), F.col("data")]
    top = old.unionByName(fresh.select(*old.columns)).orderBy(*order).limit(most)
    return top.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("place"), "origin", "n", "data")


def coverage(book: DataFrame, own: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: words of a codebook (data), how many the corpus's own codebook shares, and how many of its chunks are among them."""
    words = book.select("data", F.lit(1).alias("_w"))
    met = words.join(own.select("data", F.lit(1).alias("_o")), "data", "left").join(counts, "data", "left")
    return met.agg(F.count("_w").alias("words"), F.count("_o").alias("shared"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("covered"))


def given_up(rows: DataFrame, doc: str, share: float) -> DataFrame:
    """rows (doc, chunk_no, distance, bits) with lossy: whether a chunk is its codeword alone, its residual dropped.

    A residual costs the same whatever its distance, so the most bytes for a budget are saved by the nearest chunks: of each
    document those of least distance, then lowest number, as long as the bits changed are at most `share` of its bits.
    Chunks without a codeword (distance null) keep their bytes. Distances are few, so a document's budget is found from
    its counts by distance, and its chunks are never ordered beyond those at the edge.
    """
    budget = rows.groupBy(doc).agg((F.sum("bits") * share).alias("_budget"))
    near = rows.filter("distance IS NOT NULL")
    steps = near.groupBy(doc, "distance").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(doc).orderBy("distance")
    spent = steps.withColumn("_before", F.coalesce(F.sum(F.col("distance") * F.col("_n")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    room = spent.join(budget, doc).withColumn("_room", F.floor((F.col("_budget") - F.col("_before")) / F.greatest("distance", F.lit(1))))
    taken = room.select(doc, "distance", F.when(F.col("_before") > F.col("_budget"), 0).when(F.col("distance") == 0, F.col("_n")).otherwise(F.least("_n", F.greatest("_room", F.lit(0)))).alias("_take"), "_n")
    whole = taken.filter("_take = _n").select(doc, "distance", F.lit(True).alias("_all"))
    edge = taken.filter("_take > 0 AND _take < _n").select(doc, "distance", "_take")
    at_edge = near.join(edge, [doc, "distance"]).withColumn("_at", F.row_number().over(Window.partitionBy(doc, "distance").orderBy("chunk_no")))
    some = at_edge.filter("_at <= _take").select(doc, "chunk_no", F.lit(True).alias("_some"))
    told = rows.join(whole, [doc, "distance"], "left").join(some, [doc, "chunk_no"], "left")
    return told.select(*rows.columns, F.coalesce("_all", "_some", F.lit(False)).alias("lossy"))
