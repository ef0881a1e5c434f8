"""Queries over the index of sampled bits, with its recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.operators import bitsample, search

from .sqltext import HASHES, PAIRS, dist
from .vectors import asked, hashed

QUERIES, SQL = {}, {}

#: Within 20 of 64 bits, with a recall of 0.95, sized for a million rows.
INDEX = bitsample.sized(1_000_000, 20, 0.95)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _met(a: str, b: str) -> str:
    """Whether some table brings two hashes together."""
    return f"len(list_filter([{', '.join(f'({m})::BIGINT' for m in INDEX.masks)}], lambda m: bit_count(xor({a}, {b}) & m) <= {INDEX.flips})) > 0"


_FOUND = f"{HASHES}, {PAIRS}, close AS (SELECT query, id, distance, {_met('h', 'qh')} AS met FROM pairs WHERE distance <= 20)"


@query(f"WITH {HASHES}, near AS (SELECT a.vec_id AS id, a.h, b.h AS other FROM one a JOIN one b ON a.vec_id <> b.vec_id AND {dist('a.h', 'b.h')} <= 20), met AS (SELECT id, count(*) AS n FROM near WHERE {_met('h', 'other')} GROUP BY id) SELECT vec_id AS id, coalesce(n, 0) AS n_links FROM one LEFT JOIN met ON vec_id = id")
def indexed_self_join(spark, sf_dir):
    """Links within 20 bits that the index finds, of each row."""
    return bitsample.links(hashed(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("h").alias("hash")), INDEX)


@query(f"WITH {_FOUND} SELECT query, id, distance FROM close WHERE met")
def indexed_matches(spark, sf_dir):
    """Rows within 20 bits of the stated queries that the index finds."""
    return bitsample.found(*asked(spark, sf_dir), INDEX)


@query(f"WITH {_FOUND} SELECT query, min(id) AS id, arg_min(distance, id) AS distance FROM close WHERE met GROUP BY query")
def indexed_first_match(spark, sf_dir):
    return bitsample.first_found(*asked(spark, sf_dir), INDEX)


@query(f"WITH {_FOUND} SELECT distance, count(*) AS links, count(*) FILTER (met) AS found FROM close GROUP BY distance")
def index_recall(spark, sf_dir):
    """Of all links of the stated queries, how many the index finds, by distance: its recall against brute force."""
    queries, rows = asked(spark, sf_dir)
    every = search.against_all(queries, rows).filter("id <> query").select("query", "id", bitsample.hamming(F.col("hash"), F.col("qhash")).alias("distance")).filter("distance <= 20")
    met = bitsample.found(queries, rows, INDEX).select("query", "id", F.lit(1).alias("_met"))
    return every.join(met, ["query", "id"], "left").groupBy("distance").agg(F.count(F.lit(1)).alias("links"), F.count("_met").alias("found"))
