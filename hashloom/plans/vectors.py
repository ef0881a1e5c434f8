"""Queries over vectors: hashes, searches, calibration, vision, memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.functions import bits, calibration
from hashloom.operators import search
from hashloom.operators.hashing import simhash

from .sqltext import HASHES, NEAREST, PAIRS, dist, mask, prefix

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def hashed(spark, sf_dir, families=1):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = ("h", "c", "v")[:families]
    return rows.select("vec_id", "label", *(simhash(F.col("embedding"), k).alias(n) for k, n in enumerate(names)))


def asked(spark, sf_dir):
    """The stated query set: every hundredth id; and all rows."""
    h = hashed(spark, sf_dir)
    return h.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("h").alias("qhash")), h.select(F.col("vec_id").alias("id"), F.col("h").alias("hash"))


@query(f"WITH {HASHES} SELECT vec_id, h AS hash FROM one")
def simhash_embeddings(spark, sf_dir):
    return hashed(spark, sf_dir).select("vec_id", F.col("h").alias("hash"))


@query(f"WITH {HASHES} SELECT vec_id, e AS entity, c AS context, v AS visual FROM three")
def multihead_hash(spark, sf_dir):
    return hashed(spark, sf_dir, 3).select("vec_id", F.col("h").alias("entity"), F.col("c").alias("context"), F.col("v").alias("visual"))


@query(f"WITH {HASHES}, {PAIRS}, {NEAREST} SELECT query, id, distance, round(100 / (1 + exp(1.5 * (distance - 16))), 6) AS confidence, 100 / (1 + exp(1.5 * (distance - 16))) >= 50 AS accepted FROM near")
def knn_semantic_top1(spark, sf_dir):
    found = search.nearest(*asked(spark, sf_dir))
    score = calibration.confidence(F.col("distance"), 16.0)
    return found.select("query", "id", "distance", F.round(score, 6).alias("confidence"), (score >= 50).alias("accepted"))


@query(f"WITH {HASHES}, {PAIRS} SELECT query, id, distance FROM pairs WHERE distance <= 20")
def near_dup_threshold(spark, sf_dir):
    q, r = asked(spark, sf_dir)
    pairs = search.against_all(q, r).filter((F.col("id") != F.col("query")) & bits.within(F.col("hash"), F.col("qhash"), 20))
    return pairs.select("query", "id", bits.hamming(F.col("hash"), F.col("qhash")).alias("distance"))


@query(f"WITH {HASHES}, {PAIRS} SELECT distance, count(*) AS pairs FROM pairs GROUP BY distance")
def hamming_pairs_histogram(spark, sf_dir):
    q, r = asked(spark, sf_dir)
    return search.against_all(q, r).filter("id <> query").groupBy(bits.hamming(F.col("hash"), F.col("qhash")).alias("distance")).agg(F.count(F.lit(1)).alias("pairs"))


@query(f"WITH {HASHES} SELECT {prefix('h', 8)}::BIGINT AS bucket, count(*) AS n FROM one GROUP BY 1")
def prefix_bucket_density(spark, sf_dir):
    return hashed(spark, sf_dir).groupBy(bits.prefix(F.col("h"), 8).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {HASHES}, {PAIRS} SELECT query, min(id) AS id, arg_min(distance, id) AS distance FROM pairs WHERE distance <= 25 AND {prefix('h', 8)} = {prefix('qh', 8)} GROUP BY query")
def prefix_bucket_first_match(spark, sf_dir):
    return search.prefix_first(*asked(spark, sf_dir), 8, 25)


_BANDS = "shared AS (SELECT query, id, distance, min(b) AS band FROM pairs, range(4) t(b) WHERE ((h >> (48 - 16 * b)::INT) & 65535) = ((qh >> (48 - 16 * b)::INT) & 65535) GROUP BY ALL)"


@query(f"WITH {HASHES}, {PAIRS}, {_BANDS} SELECT query, id, band, distance FROM shared")
def mih_candidates(spark, sf_dir):
    return search.band_candidates(*asked(spark, sf_dir)).select("query", "id", "band", "distance")


@query(f"WITH {HASHES}, {PAIRS}, {_BANDS} SELECT query, arg_min(id, (band, id)) AS id, arg_min(distance, (band, id)) AS distance, min(band) AS band FROM shared WHERE distance <= 20 GROUP BY query")
def mih_first_match(spark, sf_dir):
    return search.band_first(*asked(spark, sf_dir), 20)


@query(f"""WITH {HASHES}, linked AS (SELECT DISTINCT a.vec_id AS id, b.vec_id AS other FROM one a, one b, range(4) t(k) WHERE a.vec_id <> b.vec_id
AND ((a.h >> (48 - 16 * k)::INT) & 65535) = ((b.h >> (48 - 16 * k)::INT) & 65535) AND {dist('a.h', 'b.h')} <= 20)
SELECT vec_id AS id, count(other) AS n_links FROM one LEFT JOIN linked ON vec_id = id GROUP BY vec_id""")
def mih_self_join(spark, sf_dir):
    h = hashed(spark, sf_dir)
    return search.band_links(h.select(F.col("vec_id").alias("id"), F.col("h").alias("hash")), 20)


@query(f"WITH {HASHES}, {PAIRS} SELECT query, min(id) AS id, arg_min(distance, id) AS distance FROM pairs WHERE distance <= 20 GROUP BY query")
def exact_first_match(spark, sf_dir):
    """The first row within 20 bits of each stated query: what mih_first_match gives only of rows that share a band."""
    return search.first_within(*asked(spark, sf_dir), 20)


@query(f"WITH {HASHES} SELECT a.vec_id AS id, count(b.vec_id) AS n_links FROM one a LEFT JOIN one b ON a.vec_id <> b.vec_id AND {dist('a.h', 'b.h')} <= 20 GROUP BY a.vec_id")
def exact_self_join(spark, sf_dir):
    """All links within 20 bits: what mih_self_join counts only of pairs that share a band."""
    h = hashed(spark, sf_dir)
    return search.all_links(h.select(F.col("vec_id").alias("id"), F.col("h").alias("hash")), 20)


@query(f"WITH {HASHES}, {PAIRS} SELECT distance, count(*) AS pairs, round(100 / (1 + exp(1.5 * (distance - 4))), 6) AS confidence, CASE WHEN distance > 14 THEN 0 ELSE round(100 / (1 + exp(1.5 * (distance - 4))), 6) END AS gated, round(greatest(0, 100 - 2.0 * distance), 6) AS linear FROM pairs GROUP BY distance")
def sigmoid_curve(spark, sf_dir):
    """The curves of confidence at the distances that pairs of the stated queries have."""
    d = F.col("distance")
    return hamming_pairs_histogram(spark, sf_dir).select(d, "pairs", F.round(calibration.confidence(d, 4.0), 6).alias("confidence"), F.round(calibration.hard_negative(d, 14), 6).alias("gated"), F.round(calibration.consensus(d), 6).alias("linear"))


@query(f"WITH {HASHES}, {PAIRS}, {NEAREST} SELECT query, CASE WHEN distance > 14 THEN 0.0 ELSE round(100 / (1 + exp(1.5 * (distance - 4))), 6) END AS score FROM near")
def hard_negative_score(spark, sf_dir):
    return search.nearest(*asked(spark, sf_dir)).select("query", F.round(calibration.hard_negative(F.col("distance"), 14), 6).alias("score"))


@query(f"WITH {HASHES} SELECT vec_id, ((e & -4294967296) | (c & 4294967295)) AS fused, bit_count(xor(e, ((e & -4294967296) | (c & 4294967295))))::BIGINT AS moved FROM three")
def multimodal_fusion(spark, sf_dir):
    fused = bits.fuse(F.col("h"), F.col("c"))
    return hashed(spark, sf_dir, 2).select("vec_id", fused.alias("fused"), bits.hamming(F.col("h"), fused).alias("moved"))


@query(f"WITH {HASHES} SELECT vec_id, h & ~{mask('vec_id::VARCHAR', '3')} AS decayed, xor(h, {mask('vec_id::VARCHAR', '3')}) AS corrupted, xor(h, {mask('vec_id::VARCHAR', '3')} & ~(h & -4294967296)) AS anchored FROM one")
def bit_decay(spark, sf_dir):
    h, m = F.col("h"), F.col("m")
    rows = hashed(spark, sf_dir).withColumn("m", bits.bernoulli_mask(F.col("vec_id").cast("string"), F.lit(3)))
    return rows.select("vec_id", bits.cleared(h, m).alias("decayed"), bits.flipped(h, m).alias("corrupted"), bits.flipped(h, m, h.bitwiseAND(F.lit(bits.HIGH))).alias("anchored"))


@query(f"WITH {HASHES} SELECT vec_id, xor(e, {mask('vec_id::VARCHAR', '2')} & ~(e & -4294967296)) AS entity, xor(c, {mask('vec_id::VARCHAR', '6')}) AS context, xor(v, {mask('vec_id::VARCHAR', '8')}) AS visual FROM three")
def selective_decay(spark, sf_dir):
    """A rate of 4 sixteenths: halved by relevance and anchored for the entity head, 1.5 and 2 times for the others."""
    key, h = F.col("vec_id").cast("string"), F.col("h")
    return hashed(spark, sf_dir, 3).select("vec_id", bits.flipped(h, bits.bernoulli_mask(key, F.lit(2)), h.bitwiseAND(F.lit(bits.HIGH))).alias("entity"), bits.flipped(F.col("c"), bits.bernoulli_mask(key, F.lit(6))).alias("context"), bits.flipped(F.col("v"), bits.bernoulli_mask(key, F.lit(8))).alias("visual"))


def heads(spark, sf_dir):
    """Distances of three heads between the stated queries and all rows, a block of queries at a time."""
    h = hashed(spark, sf_dir, 3)
    q = h.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("h").alias("qh"), F.col("c").alias("qc"), F.col("v").alias("qv"))
    pairs = search.against_all(q, h.withColumnRenamed("vec_id", "id")).filter("id <> query")
    return pairs.select("query", "id", *(bits.hamming(F.col(a), F.col(b)).alias(n) for a, b, n in (("h", "qh", "de"), ("c", "qc", "dc"), ("v", "qv", "dv"))))


_HEADS = f"heads AS (SELECT q.vec_id AS query, r.vec_id AS id, {dist('q.e', 'r.e')} AS de, {dist('q.c', 'r.c')} AS dc, {dist('q.v', 'r.v')} AS dv FROM three q, three r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)"


@query(f"WITH {HASHES}, {_HEADS} SELECT query, id, round(greatest(0, 100 - (de + dc)), 6) AS confidence FROM heads WHERE de <= 22")
def multihead_consensus(spark, sf_dir):
    """The entity head gates; those that pass get the mean of entity and context."""
    near = heads(spark, sf_dir).filter("de <= 22")
    return near.select("query", "id", F.round(calibration.consensus(F.col("de"), F.col("dc")), 6).alias("confidence"))


_ADAPT = "(de + dc * (CASE WHEN de <= 2 AND dc > 10 THEN 0.4 ELSE 1.0 END) + dv * (CASE WHEN dv < 5 THEN 1.2 ELSE 0.5 END)) / (1.0 + (CASE WHEN de <= 2 AND dc > 10 THEN 0.4 ELSE 1.0 END) + (CASE WHEN dv < 5 THEN 1.2 ELSE 0.5 END))"


@query(f"WITH {HASHES}, {_HEADS}, w AS (SELECT query, id, trunc(({_ADAPT})::DOUBLE)::BIGINT AS distance FROM heads), b AS (SELECT query, arg_min(id, (distance, id)) AS id, min(distance) AS distance FROM w GROUP BY query) SELECT query, id, distance, round(100 / (1 + exp(distance - 15)), 6) AS confidence FROM b")
def adaptive_consensus(spark, sf_dir):
    """Head weights that depend on the distances; the best row of each query."""
    wc = F.when((F.col("de") <= 2) & (F.col("dc") > 10), F.lit(0.4)).otherwise(F.lit(1.0))
    wv = F.when(F.col("dv") < 5, F.lit(1.2)).otherwise(F.lit(0.5))
    mean = ((F.col("de") + F.col("dc") * wc + F.col("dv") * wv) / (1 + wc + wv)).cast("long")
    best = heads(spark, sf_dir).withColumn("distance", mean).groupBy("query").agg(F.min(F.struct("distance", "id")).alias("m"))
    return best.select("query", "m.id", "m.distance", F.round(calibration.confidence(F.col("m.distance"), 15.0, 1.0), 6).alias("confidence"))


def patches(spark, sf_dir):
    """(image, patch, weight, label, distance): patches of every hundredth image (16 vectors each, in a 4 x 4 grid) beside all rows: per class the nearest."""
    h = hashed(spark, sf_dir)
    q = h.filter("(vec_id DIV 16) % 100 = 0").select(F.col("vec_id").alias("query"), F.col("h").alias("qhash"))
    near = search.against_all(q, h.select(F.col("vec_id").alias("id"), "label", F.col("h").alias("hash"))).filter("id <> query")
    least = near.groupBy("query", "label").agg(F.min(bits.hamming(F.col("hash"), F.col("qhash"))).alias("distance"))
    cell = F.col("query") % 16
    return least.select(F.expr("query DIV 16").alias("image"), F.when(cell.isin(5, 6, 9, 10), F.lit(1.5)).otherwise(F.lit(0.8)).alias("weight"), "label", "distance")


_PATCHES = f"""p AS (SELECT q.vec_id // 16 AS image, CASE WHEN q.vec_id % 16 IN (5, 6, 9, 10) THEN 1.5 ELSE 0.8 END AS weight, r.label, min({dist('q.h', 'r.h')}) AS distance
FROM one q, one r WHERE (q.vec_id // 16) % 100 = 0 AND q.vec_id <> r.vec_id GROUP BY q.vec_id, r.label)"""


@query(f"WITH {HASHES}, {_PATCHES} SELECT image, label, round(100.0 * count(*) FILTER (distance <= 22) / count(*), 6) AS percent FROM p GROUP BY image, label HAVING count(*) FILTER (distance <= 22) > 0")
def patch_class_match(spark, sf_dir):
    hit = F.count_if(F.col("distance") <= 22)
    return patches(spark, sf_dir).groupBy("image", "label").agg(F.round(100 * hit / F.count(F.lit(1)), 6).alias("percent")).filter("percent > 0")


@query(f"WITH {HASHES}, {_PATCHES} SELECT image, label, round((sum(CASE WHEN distance <= 22 THEN weight ELSE 0 END) / sum(weight) * 100)::DOUBLE, 6) AS percent FROM p GROUP BY image, label HAVING sum(CASE WHEN distance <= 22 THEN weight ELSE 0 END) > 0")
def foveal_density(spark, sf_dir):
    hit = F.sum(F.when(F.col("distance") <= 22, F.col("weight")).otherwise(0.0))
    return patches(spark, sf_dir).groupBy("image", "label").agg(F.round(hit / F.sum("weight") * 100, 6).alias("percent")).filter("percent > 0")


@query(f"WITH {HASHES}, {_PATCHES} SELECT image, label, least(64, min(distance)) AS distance, round(100 / (1 + exp(1.2 * (least(64, min(distance)) - 6))), 6) AS confidence FROM p GROUP BY image, label")
def maxpool_confidence(spark, sf_dir):
    near = patches(spark, sf_dir).groupBy("image", "label").agg(F.least(F.lit(64), F.min("distance")).cast("long").alias("distance"))
    return near.withColumn("confidence", F.round(calibration.confidence(F.col("distance"), 6.0, 1.2), 6))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, round(greatest(1, 4 * power(0.85, count(*) FILTER (event_type = 'error'))), 6) AS middle FROM events GROUP BY user_id")
def feedback_midpoint(spark, sf_dir):
    n = F.count_if(F.col("event_type") == "error")
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(n.alias("failures"), F.round(calibration.punished(n), 6).alias("middle"))


@query("WITH t AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events) SELECT user_id, last >= now - INTERVAL 1 HOUR AS alive FROM t, m")
def ttl_decay(spark, sf_dir):
    """Entries idle for over an hour at the end of the table are evicted."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = e.agg(F.max("ts").alias("now"))
    return e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(now)).select("user_id", (F.col("last") >= F.col("now") - F.expr("INTERVAL 1 HOUR")).alias("alive"))


@query("SELECT conv_id, turn, round(0.05 * (0.1 + 0.45 * (1 + cos(pi() * turn / (SELECT max(turn) + 1 FROM conversations)))), 6) AS rate FROM conversations")
def cosine_lr(spark, sf_dir):
    """The learning rate at each turn where one conversation's turns are the steps of a round."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    steps = t.agg((F.max("turn") + 1).alias("steps"))  # one row
    return t.crossJoin(F.broadcast(steps)).select("conv_id", "turn", F.round(calibration.cosine_rate(0.05, F.col("turn"), F.col("steps")), 6).alias("rate"))
