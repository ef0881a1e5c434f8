"""Chunkers, searches in blocks, folds, training and streams against plain versions of the same."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.functions import content
from hashloom.operators import bpe, chunks, codebook, denoise, dialogue, search
from hashloom.sources import tables
from hashloom.streaming import state


def plain_rabin(data, target):
    """One byte after another: the hash of the last eight bytes of the chunk at hand."""
    least, most, ends, start, i = target // 4, 2 * target, [], 0, 0
    if len(data) <= least:
        return [len(data)] if data else []
    while i < len(data):
        if i - start >= most:
            ends.append(i)
            start = i
            continue
        h = 0
        for b in data[max(start, i - 7) : i + 1]:
            h = (h * bpe.BASE + b) % (1 << 64)
        if i - start >= max(least, 8) and h % target == 0:
            ends.append(i + 1)
            start = i + 1
        i += 1
    return ends + [len(data)] * (start < len(data))


def test_rabin_cuts():
    rng = random.Random(2)
    for n in (0, 1, 7, 8, 16, 17, 500, 3000):
        for target in (8, 64, 128):
            for data in (rng.randbytes(n), bytes(n), bytes(rng.choices(b"ab", k=n))):
                assert bpe.rabin_cuts(data, target) == plain_rabin(data, target)
    data = rng.randbytes(20_000)
    cuts = lambda d: {d[a:b] for a, b in zip([0, *bpe.rabin_cuts(d, 256)[:-1]], bpe.rabin_cuts(d, 256), strict=True)}
    assert len(cuts(data) & cuts(b"x" + data)) > 0.8 * len(cuts(data))


def test_queries_in_blocks(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, rng.getrandbits(63)) for i in range(90)], "id long, hash long")
    q = rows.filter("id % 3 = 0").select(F.col("id").alias("query"), F.col("hash").alias("qhash"))
    pairs = lambda size: sorted(map(tuple, search.against_all(q, rows, size).select("query", "id", "qhash", "hash").collect()))
    assert pairs(2048) == pairs(7) and len(pairs(7)) == 30 * 90


@pytest.mark.parametrize("limit", [6, 20])
def test_folds_take_turns_in_order(spark, limit):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    data = [(c, t, rng.choice(base) ^ (1 << rng.randrange(64)) * rng.randrange(2) ^ rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) * rng.randrange(2)) for c in (1, 2) for t in range(1200 if c == 1 else 30)]
    expected, resets = {}, {}
    for c in (1, 2):
        held, cached, context = [], [], 0
        for _, t, h in (r for r in data if r[0] == c):
            first = next(((u, (x ^ h).bit_count()) for u, x in held if (x ^ h).bit_count() <= limit), None)
            expected[c, t] = ("insert", None, None) if first is None else ("hit", *first)
            if first is None:
                held.append((t, h))
            action, distance, kept = state.cache_step(context, cached, h, limit, 12.0)
            resets[c, t] = (action, distance)
            if action != "hit":
                cached.append(kept)
            context = h
    turns = spark.createDataFrame([(c, t, signed(h)) for c, t, h in data], "conv_id long, turn long, hash long").repartition(5)
    assert {(r.conv_id, r.turn): (r.action, r.match_turn, r.distance) for r in dialogue.cache_fold(turns, limit).collect()} == expected
    of = {(c, t): h for c, t, h in data}
    mixed = [(c, t, signed(h), signed(h if not of.get((c, t - 1)) else of[c, t - 1] & 0xFFFFFFFF00000000 | h & 0xFFFFFFFF)) for c, t, h in data]
    rows = spark.createDataFrame(mixed, "conv_id long, turn long, raw long, mixed long")
    assert {(r.conv_id, r.turn): (r.action, r.distance) for r in dialogue.reset_fold(rows, limit).collect()} == resets
    assert dialogue.cache_fold(turns.limit(0)).collect() == []


def test_leaves_of_uneven_sides(spark):
    side = lambda leaves: spark.createDataFrame([(d, i, x) for d, xs in leaves.items() for i, x in enumerate(xs)], "doc long, idx long, hash string")
    a, b = side({1: "ABCD", 2: "ABCD", 3: "AB", 4: "A"}), side({1: "AZCD", 2: "ZBXY", 3: "ABC", 5: "Q"})
    assert {(r.doc, r.idx) for r in chunks.leaf_diff(a, b, "doc").collect()} == {(1, 1), (2, 0), (2, 2), (2, 3), (3, 0), (3, 1), (3, 2), (4, 0), (5, 0)}


def test_packed_chunks_are_rebuilt(spark):
    rng = random.Random(5)
    book = spark.createDataFrame([(i, bytearray(b"kk" + rng.randbytes(30))) for i in range(5)], "id long, data binary")
    words = [bytes(r.data) for r in book.collect()]
    data = [*words, words[0][:20] + rng.randbytes(12), bytes([words[1][0], words[1][1], *(255 - x for x in words[1][2:])]), b"zz" + bytes(30), words[2]]
    rows = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "k long, data binary")
    told = codebook.packed(rows, book, ["k"])
    back = {r.k: bytes(r.data) for r in codebook.rebuilt(told.select("k", "decision", "id", "stored"), book).collect()}
    assert back == dict(enumerate(data))
    found = {r.k: r.decision for r in told.collect()}
    assert [found[i] for i in range(5)] == ["hit"] * 5 and found[7] == "literal" and found[8] == "hit"


def test_training_is_the_same_whatever_the_batches(spark):
    docs = spark.createDataFrame([(f"the cat {w} sat on the mat. a dog {w} ran to the red house.",) for w in "abcdefghij" * 30], "text string")
    rows = denoise.corpus(docs, "text")
    words, conf = denoise.vocabulary(rows, 32), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, told = spark.conf.get(conf), []
    try:
        for n in ("10000", "37"):
            spark.conf.set(conf, n)
            told.append(denoise.train(rows, words, 2)[1])
    finally:
        spark.conf.set(conf, before)
    assert told[0] == told[1] and told[0][0][2] > 0


def test_content(spark):
    data = [b"", None, b"\x89PNG\r\n", b"PK\x03\x04", b'  {"a": 1}\n{"b": 2}', b"[1]", b"a\n" * 8, b"\x00\x01\n\n\n\n\n\n\n", b"BM\x00", b"select * from t", b"x = SELECT a", b"def f():", "éàü".encode() * 9, b"<svg>"]
    rows = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(data)], "k long, d binary")
    got = {r.k: (r.x, r.d.category, r.d.hint) for r in rows.select("k", content.extension(F.col("d")).alias("x"), content.detected(F.col("d")).alias("d")).collect()}
    assert [got[i][0] for i in range(8)] == ["UNKNOWN", "UNKNOWN", "PNG", "ZIP", "JSONL", "JSON", "LINES", "UNKNOWN"]
    assert [got[i][2] for i in range(14)] == ["none", "none", "png", "zip", "text", "text", "text", "unknown", "bmp", "sql", "sql", "code", "unknown", "svg"]


def stream(spark, rows, schema, tmp_path, query, mode, batches=2):
    """The rows a streaming query gives for parts of `rows`, one part a batch."""
    folder = tmp_path / "in"
    for k in range(batches):
        spark.createDataFrame(rows[k::batches] if batches > 1 else rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = "s" + "".join(random.choices("abcdefgh", k=8))
    q = query(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 60  # a stream with timeouts never says that all is processed
        while sum(p["numInputRows"] for p in q.recentProgress) < len(rows) and time.time() < until:
            time.sleep(0.2)
        return spark.table(name).collect()
    finally:
        q.stop()


def test_stream_thresholds(spark, tmp_path):
    rows = [("a", True)] * 3 + [("a", False)] + [("b", True)] * 40
    got = stream(spark, rows, "bucket string, failed boolean", tmp_path, state.thresholds, "update")
    least = {b: min(r.middle for r in got if r.bucket == b) for b in "ab"}
    assert least["a"] == pytest.approx(4 * 0.85**3) and least["b"] == 1.0


def test_stream_of_entries(spark, tmp_path):
    got = stream(spark, [(1,), (2,), (1,), (3,)], "id long", tmp_path, lambda s: state.live_entries(s, 600_000), "append")
    assert {(r.id, r.event) for r in got} == {(1, "touched"), (2, "touched"), (3, "touched")}


def test_stream_meets_a_table(spark, tmp_path):
    """Questions of a stream looked up in a static table, the answer with the hit."""
    kb = spark.createDataFrame([(10, 0b1111, "four"), (11, -1, "all")], "id long, hash long, answer string")
    got = stream(spark, [(1, 0b1110), (2, -2), (3, 1 << 40)], "query long, qhash long", tmp_path, lambda s: state.answered(s, kb, 2), "append")
    assert {(r.query, r.id, r.answer, r.distance) for r in got} == {(1, 10, "four", 1), (2, 11, "all", 1), (3, None, None, None)}


def test_json_files(spark, tmp_path):
    point = {"id": "a", "texto": "x", "embedding": [0.5, 1.0]}
    (tmp_path / "records.json").write_text(json.dumps([point, point | {"id": "b"}]))
    assert [r.id for r in tables.read_json(spark, str(tmp_path / "records.json"), tables.RECORD).collect()] == ["a", "b"]
    (tmp_path / "set.json").write_text(json.dumps({"textos": [point], "imagens": [{"id": "i", "descricao": "d", "patches": [[1.0, 2.0], [3.0, 4.0]]}]}))
    dataset = tables.read_json(spark, str(tmp_path / "set.json"), tables.DATASET)
    assert tables.texts(dataset).count() == 1
    assert [(r.patch, r.weight, r.embedding) for r in tables.patches(dataset).collect()] == [(0, 1.0, [1.0, 2.0]), (1, 1.0, [3.0, 4.0])]
    (tmp_path / "pca.json").write_text(json.dumps({"metadados": {"algoritmo": "p", "dimensao_entrada": 2, "dimensao_saida": 1}, "centroide": [0.25, 0.5], "heads": {"entidade": [[1.0, 2.0]]}}))
    model = tables.read_json(spark, str(tmp_path / "pca.json"), tables.MODEL)
    assert [(r.head, r.bit, r.dim, r.weight) for r in tables.components(model).collect()] == [("entidade", 0, 0, 1.0), ("entidade", 0, 1, 2.0)]
    assert tables.centre(model) == [0.25, 0.5] and tables.centre(model.withColumn("centroide", F.lit(None).cast("array<double>"))) is None


def test_optional_and_written_files(spark, tmp_path):
    assert tables.read_optional(spark, str(tmp_path / "none.json"), "intent string, answer string").collect() == []
    rows = spark.createDataFrame([("b1", 3.4), ("b2", 4.0)], "bucket string, middle double")
    tables.write_json(rows, str(tmp_path / "state"))
    again = tables.read_optional(spark, str(tmp_path / "state"), "bucket string, middle double")
    assert sorted(map(tuple, again.collect())) == [("b1", 3.4), ("b2", 4.0)]
    report = spark.createDataFrame([("T1", "texto", "x, \"y\"", 3, 99.5, "ok", 120)], "id string, kind string, description string, distance int, confidence double, status string, ns long")
    tables.write_gauntlet(report, str(tmp_path / "report"))
    back = spark.read.option("header", True).csv(str(tmp_path / "report"))
    assert back.columns == tables.GAUNTLET and back.first().Descricao == 'x, "y"'


def test_codebook_files(spark, tmp_path):
    words = [bytes([i]) * 8 for i in range(5)]
    (tmp_path / "a.bin").write_bytes(tables.codebook_bytes(words))
    got = tables.read_codebook(spark, str(tmp_path / "a.bin")).collect()
    assert [bytes(r.data) for r in sorted(got, key=lambda r: r.id)] == words
    (tmp_path / "b.bin").write_bytes(tables.codebook_bytes(words)[:-3])
    (tmp_path / "c.bin").write_bytes(b"nothing" * 90)
    for name in ("b.bin", "c.bin"):
        with pytest.raises(Exception, match="codebook"):
            tables.read_codebook(spark, str(tmp_path / name)).collect()


def test_fnv_of_many_lengths(spark):
    """More texts than go on together, some far longer than the others."""
    texts = ["", None, "é"] + ["x" * i + "y" for i in range(40)] + ["long " * 20_000, "z" * 50_000]

    def plain(t):
        h = content.BASIS
        for b in (t or "").encode():
            h = (h ^ b) * content.PRIME % (1 << 64)
        return str(h)

    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    got = {r.i: r.d for r in rows.select("i", content.fnv1a(F.col("t")).alias("d")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_fnv(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "t string")
    got = [r.d for r in rows.select(content.fnv1a(F.col("t")).alias("d")).collect()]
    assert got == [str(x) for x in (0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8, 0xCBF29CE484222325)]
    assert np.uint64(content.PRIME) == 0x100000001B3
