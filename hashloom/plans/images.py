"""Queries over layouts of images: sixteen consecutive vectors are an image of 4 by 4 patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.functions import bits
from hashloom.operators import layouts, search
from hashloom.operators.hashing import simhash

from .sqltext import HASHES, dist
from .vectors import hashed

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _digit(kind: str, place: int) -> str:
    return f"(instr('0123456789abcdef', substr(md5(image || ':{kind}'), {place}, 1)) - 1)"


_GRAIN = "substr(md5(image || ':' || patch || ':' || (i - 1)), 1, 1)"
_LAYOUTS = f"""{HASHES}, p AS (SELECT vec_id // 16 AS image, vec_id % 16 AS patch, (vec_id % 16) // 4 AS r, vec_id % 4 AS c, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT image, 'centre' AS layout, patch, v FROM p
UNION ALL SELECT image, 'shift', ((r + {_digit('shift', 2)} % 4) % 4) * 4 + (c + 1 + {_digit('shift', 1)} % 3) % 4, v FROM p
UNION ALL SELECT image, 'rotation', CASE 1 + {_digit('rotation', 1)} % 3 WHEN 1 THEN c * 4 + 3 - r WHEN 2 THEN (3 - r) * 4 + 3 - c ELSE (3 - c) * 4 + r END, v FROM p
UNION ALL SELECT image, 'occlusion', patch, CASE WHEN r - {_digit('occlusion', 1)} % 3 BETWEEN 0 AND 1 AND c - {_digit('occlusion', 2)} % 3 BETWEEN 0 AND 1 THEN list_transform(v, lambda x: 0.0::DOUBLE) ELSE v END FROM p
UNION ALL SELECT image, 'grain', patch, list_transform(range(1, len(v) + 1), lambda i: CASE {_GRAIN} WHEN '0' THEN 1.0 WHEN 'f' THEN -1.0 ELSE v[i] END) FROM p),
lh AS (SELECT image, layout, patch, CASE WHEN patch IN (5, 6, 9, 10) THEN 1.5 ELSE 0.8 END AS weight, sum(CASE WHEN list_inner_product(v, w) > 0 THEN 1::HUGEINT << i::INT ELSE 0 END) AS u FROM l, planes WHERE f = 0 GROUP BY ALL),
laid AS (SELECT image, layout, patch, weight, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS hash FROM lh)"""


def laid(spark, sf_dir, where="true"):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(where)
    grid = rows.select(F.expr("vec_id DIV 16").alias("image"), (F.col("vec_id") % 16).alias("patch"), F.col("embedding").cast("array<double>").alias("vector"))
    return layouts.layouts(grid).select("image", "layout", "patch", "weight", simhash(F.col("vector")).alias("hash"))


@query(f"WITH {_LAYOUTS} SELECT image, layout, patch::BIGINT AS patch, weight::DOUBLE AS weight, hash FROM laid")
def image_layouts(spark, sf_dir):
    """Every image in five layouts, with the hashes of its patches where they then are."""
    return laid(spark, sf_dir)


@query(f"""WITH {_LAYOUTS}, n AS (SELECT q.image, q.layout, q.patch, q.weight, r.label, min({dist('q.hash', 'r.h')}) AS distance FROM laid q, one r WHERE q.image % 100 = 0 AND q.image <> r.vec_id // 16 GROUP BY ALL)
SELECT layout, image, label, round(100.0 * count(*) FILTER (distance <= 22) / count(*), 6) AS percent, round((100 * sum(CASE WHEN distance <= 22 THEN weight ELSE 0 END) / sum(weight))::DOUBLE, 6) AS foveal FROM n GROUP BY layout, image, label""")
def layout_class_match(spark, sf_dir):
    """Patches of every hundredth image in each layout beside all rows of other images: per class the share of hits, plain and weighted by the centre."""
    q = laid(spark, sf_dir, "(vec_id DIV 16) % 100 = 0").select(F.concat_ws(":", F.col("image").cast("string"), "layout", F.col("patch").cast("string")).alias("query"), "image", "layout", "weight", F.col("hash").alias("qhash"))
    rows = hashed(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", F.col("h").alias("hash"))
    near = search.against_all(q, rows).filter(F.col("image") != F.expr("id DIV 16"))
    least = near.groupBy("query", "image", "layout", "weight", "label").agg(F.min(bits.hamming(F.col("hash"), F.col("qhash"))).alias("distance"))
    hit = F.col("distance") <= 22
    foveal = 100 * F.sum(F.when(hit, F.col("weight")).otherwise(0.0)) / F.sum("weight")
    return least.groupBy("layout", "image", "label").agg(F.round(100 * F.count_if(hit) / F.count(F.lit(1)), 6).alias("percent"), F.round(foveal, 6).alias("foveal"))
