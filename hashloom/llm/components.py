"""Connected components by alternating large-star and small-star steps, each a few joins on slim rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _with_min(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with m, the smallest of u and its neighbours."""
    least = arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return arcs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    with_min = _with_min(down)
    inner = with_min.select(F.col("v").alias("u"), F.col("m").alias("v"))
    hub = with_min.select("u", F.col("m").alias("v"))
    return inner.unionByName(hub).filter("u > v").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs -> (node, root): root is the smallest node of node's component; roots are left out.

    Loops and repeated edges change nothing; no edges give no rows. Each round is written to the shared folder, and
    stops when a round changes nothing, whatever the shape of the graph.
    """
    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
