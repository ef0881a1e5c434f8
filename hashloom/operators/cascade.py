"""Deciding what a chunk is worth before codewords are searched: first bytes, local entropy, then the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions.content import detected, packed_already

from . import codebook
from .bpe import entropy


def decided(rows: DataFrame, book: DataFrame, keys: list[str], noisy: float = 7.5, worth: float = 0.2, sure: float = 0.95) -> DataFrame:
    """rows (keys, head, data) with decision, id, distance and stored.

    `packed`: content whose first bytes (head) say that it is compressed already; `noise`: a chunk of more than `noisy` bits a
    byte. Both are stored as they are and never meet a codeword. The rest is searched: `hit`, `delta` or `literal`, as
    codebook.packed() has them. An empty or null chunk is searched and is a `literal`. A codebook is bounded.
    """
    data = F.coalesce(F.col("data"), F.lit(b""))
    told = rows.select(*keys, "head", data.alias("data")).withColumn("_gate", F.when(packed_already(F.col("head")), "packed"))
    # the entropy is worked out for chunks alone that the first gate lets pass, and once for each
    open_ = told.filter("_gate IS NULL").withColumn("_e", entropy(F.col("data")))
    nothing = lambda f, decision: f.select(*keys, "data", decision.alias("decision"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("distance"), F.col("data").alias("stored"))
    skipped = nothing(told.filter("_gate IS NOT NULL"), F.col("_gate")).unionByName(nothing(open_.filter(F.col("_e") > noisy), F.lit("noise")))
    searched = codebook.packed(open_.filter(F.col("_e") <= noisy).select(*keys, "data"), book, keys, worth, sure)
    return skipped.unionByName(searched.select(*skipped.columns))


def routed(rows: DataFrame, books: DataFrame, data: str = "data", trusted: float = 0.5) -> DataFrame:
    """rows with size, and a data column, with category, hint and confidence of what the data look like, and the book they are packed with.

    A category below the confidence `trusted` is not followed: the hint decides, then the universal codebook, then any of the size.
    """
    kind = rows.withColumn("_k", detected(F.col(data)))
    sure: Column = F.col("_k.confidence") >= trusted
    asked = kind.select(*rows.columns, F.col("_k.category").alias("_said"), F.when(sure, F.col("_k.category")).alias("category"), F.col("_k.hint").alias("hint"), F.col("_k.confidence").alias("confidence"))
    return codebook.route(asked, books).withColumn("category", F.col("_said")).drop("_said")
