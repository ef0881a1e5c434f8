import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.functions import bits
from hashloom.operators import bpe, chunks
from hashloom.operators.hashing import planes
from hashloom.plans import texts, vectors
from hashloom.sources import tables
from hashloom.streaming import state


@pytest.mark.parametrize("a, b, d", [(42, 42, 0), (42, 43, 1), (-1, 0, 64), (0b11110000, 0b1111, 8)])
def test_hamming(spark, a, b, d):
    assert spark.range(1).select(bits.hamming(F.lit(a).cast("long"), F.lit(b).cast("long"))).first()[0] == d


def test_bands_find_every_pair_within_three_bits(spark, sf):
    h = vectors.hashed(spark, sf).select("vec_id", "h").limit(200)
    rng = random.Random(3)
    pairs = []
    for r in h.collect():
        x = r.h
        for b in rng.sample(range(63), 3):
            x ^= 1 << b
        pairs.append((r.h, x))
    df = spark.createDataFrame(pairs, "a long, b long").select(F.exists(F.arrays_zip(bits.bands(F.col("a")).alias("x"), bits.bands(F.col("b")).alias("y")), lambda z: z["x"] == z["y"]).alias("met"))
    assert df.filter("NOT met").count() == 0


def test_planes_are_spread():
    x = np.random.default_rng(0).normal(size=(100, 64))
    h = x @ planes().T > 0
    d = (h[:, None, :] != h[None]).sum(axis=2)[np.triu_indices(100, 1)]
    assert 28 < d.mean() < 36


def test_cuts_survive_an_insertion():
    rng = random.Random(1)
    data = rng.randbytes(60_000)

    def digests(d):
        ends = bpe.cut_points(d, 256)
        return [hashlib.sha256(d[a:b]).digest() for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    a, b = digests(data), digests(data[:500] + b"x" + data[500:])
    assert len(set(a) & set(b)) > 0.95 * len(a)
    assert bpe.cut_points(b"", 256) == [] and bpe.cut_points(b"q", 256) == [1]
    sizes = np.diff([0, *bpe.cut_points(bytes(5000), 256)])
    assert sizes.max() <= 1024


def test_merkle_root(spark):
    def root(hashes):
        while len(hashes) > 1:
            hashes = [hashlib.sha256(hashes[i] + hashes[min(i + 1, len(hashes) - 1)]).digest() for i in range(0, len(hashes), 2)]
        return hashes[0].hex()

    data = [(k, i, hashlib.sha256(f"{k}-{i}".encode()).digest()) for k in range(1, 8) for i in range(k)]
    leaves = spark.createDataFrame([(k, i, h.hex(), k - 1) for k, i, h in data], "doc long, idx long, hash string, last long")
    got = {r.doc: r.root for r in chunks.merkle_root(leaves, "doc").collect()}
    assert got == {k: root([h for d, _, h in data if d == k]) for k in range(1, 8)}


def test_merges():
    assert bpe.merged(("a", "b", "a", "b"), "a", "b") == ("ab", "ab")


def test_cache_steps():
    near = (1 << 63) | 5
    assert state.cache_step(0, [], 7, 20, 12) == ("insert", -1, 7)
    assert state.cache_step(0, [near ^ 1], near, 20, 12) == ("hit", 1, near ^ 1)
    assert state.cache_step(0, [near ^ 0xFFFF], near, 20, 12)[0] == "reset"


def test_semantic_cache_stream(spark, sf, tmp_path):
    rows = texts.turn_hashes(spark, sf).select(F.expr("msg DIV 1000").alias("conv_id"), (F.col("msg") % 1000).alias("turn"), "hash")
    rows.write.parquet(str(tmp_path / "in"))
    stream = state.semantic_cache(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("cache").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = spark.table("cache").collect()
    assert len(got) == rows.count() and {r.action for r in got} <= {"hit", "reset", "insert"}
    assert all(r.action == "insert" for r in got if r.turn == min(x.turn for x in got if x.conv_id == r.conv_id))


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"chat": [{"id": "1", "texto": "oi", "embedding": [1.0]}], "visao": [{"id": "v", "descricao": "d", "blocos": [{"indice": 5, "peso": 1.5, "embedding": [2.0]}]}]}))
    d = tables.read_json(spark, str(tmp_path / "a.json"), tables.WEIGHTED)
    assert tables.texts(d, "chat").first().texto == "oi" and tables.patches(d).first().weight == 1.5
    (tmp_path / "q.json").write_text(json.dumps({"data": [{"paragraphs": [{"context": "c" * 300, "qas": [{"question": "q", "answers": [{"text": "a"}]}, {"question": "r", "answers": []}]}]}]}))
    got = tables.questions(spark, str(tmp_path / "q.json")).collect()
    assert [(r.intent, r.answer, len(r.context)) for r in got] == [("q", "a", 200)]
    (tmp_path / "v.json").write_text(json.dumps({"oi": {"indice": 0, "idf": 1.5}, "a_b": {"indice": 1, "idf": 2.0}}))
    assert {r.token: r.unigram for r in tables.vocabulary(spark, str(tmp_path / "v.json")).collect()} == {"oi": True, "a_b": False}
    assert spark.sql("select '18446744073709551615' x").select(tables.unsigned(F.col("x"))).first()[0] == -1
