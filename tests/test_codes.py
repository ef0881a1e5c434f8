import hashlib
import hmac
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.operators import bpe, chunks, codebook, denoise, edits, projection
from hashloom.sources import tensors


@pytest.mark.parametrize("a, b, d", [([1, 2, 3], [1, 2, 3], 0), ([1, 2, 3], [1, 2, 4], 3), ([1, 2, 3], [4, 5, 6], 7), ([1, 2], [1, 2, 3, 4], 16), ([], [1], 8), ([], [], 0), ([255] * 9, [0] * 9, 72)])
def test_byte_distance(spark, a, b, d):
    assert spark.range(1).select(codebook.byte_distance(F.lit(bytes(a)), F.lit(bytes(b)))).first()[0] == d


def frame(spark, data, names="id long, data binary"):
    return spark.createDataFrame(list(enumerate(map(bytearray, data))), names)


def brute(query, book, allowed=None):
    near = [(sum((x ^ y).bit_count() for x, y in zip(query, b, strict=True)), k) for k, b in enumerate(book) if allowed is None or k in allowed]
    return min(near)


def test_nearest_codewords(spark):
    rng = random.Random(5)
    book = [bytes(rng.choices(range(3), k=8)) for _ in range(60)]
    asked = [bytes(rng.choices(range(4), k=8)) for _ in range(40)] + book[:5]
    q, b = frame(spark, asked, "k long, data binary"), frame(spark, book)
    linear = {r.k: (r.distance, r.id) for r in codebook.nearest_linear(q, b, ["k"]).collect()}
    assert linear == {k: brute(x, book) for k, x in enumerate(asked)}
    bucketed = {r.k: (r.distance, r.id) for r in codebook.nearest_bucketed(q, b, ["k"]).collect()}
    assert bucketed == {k: brute(x, book, {i for i, y in enumerate(book) if y[:2] == x[:2]} or None) for k, x in enumerate(asked)}
    assert codebook.nearest_bucketed(q.limit(0), b, ["k"]).count() == 0


def test_tiers(spark):
    tiers = [frame(spark, [b"\xff\xff"]), frame(spark, [b"\x0f\x00", b"\x00\x01"])]
    q = frame(spark, [b"\xff\xfe", b"\x00\x00", b"\x00\xff"], "k long, data binary")
    found = {r.k: (r.tier, r.id, r.distance) for r in codebook.nearest_tiered(q, tiers, ["k"], 16).collect()}
    assert found == {0: (0, 0, 1), 1: (1, 1, 1), 2: (0, 0, 8)}
    assert spark.range(1).select(codebook.tier_id(F.lit(1).cast("long"), F.lit(5).cast("long"))).first()[0] == 1 << 62 | 5


def test_route(spark):
    books = spark.createDataFrame([("a", "log", "x", 8), ("b", "sql", "y", 8), ("u", "universal", "", 8), ("z", "code", "w", 16)], "book string, category string, hint string, size long")
    rows = spark.createDataFrame([(0, "log", "y", 8), (1, "none", "y", 8), (2, "none", "none", 8), (3, "none", "none", 16), (4, "log", "x", 4)], "k long, category string, hint string, size long")
    assert {r.k: r.book for r in codebook.route(rows, books).collect()} == {0: "a", 1: "b", 2: "u", 3: "z", 4: None}


def test_sealed_chunks(spark):
    secret = b"k" * 70
    df = frame(spark, [b"one", b"one", b"two"])
    row = df.select("data", codebook.hmac_sha256(secret, F.col("data")).alias("mac"), codebook.seal(F.col("data"), secret).alias("s")).collect()
    assert row[0].s == row[1].s != row[2].s
    assert bytes(row[2].mac) == hmac.new(secret, b"two", hashlib.sha256).digest()
    back = df.select(codebook.unseal(codebook.seal(F.col("data"), secret), F.unhex(F.sha2("data", 256)), secret).alias("b"))
    assert [bytes(r.b) for r in back.collect()] == [b"one", b"one", b"two"]


def test_edit_scripts():
    rng = random.Random(2)
    pairs = [(bytes(rng.choices(b"abc", k=rng.choice((0, 1, 5, 30)))), bytes(rng.choices(b"abc", k=rng.choice((0, 1, 5, 30))))) for _ in range(200)] + [(b"", bytes(600)), (bytes(600), b""), (b"abcdef", b"abXdef")]
    scripts = edits.diff_all([p for p, _ in pairs], [c for _, c in pairs], rows=7)
    for (p, c), s in zip(pairs, scripts, strict=True):
        assert edits.apply_script(p, s) == c
    assert scripts[-1] == bytes([edits.KEEP, 2, edits.DELETE, 1, edits.INSERT, 1]) + b"X" + bytes([edits.KEEP, 3])


def test_components_are_the_largest(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = np.stack(rows.toPandas()["embedding"]).astype(float)
    n, mean, covariance = projection.moments(rows.repartition(3), "embedding", 64)
    assert n == len(x) and np.allclose(mean, x.mean(axis=0)) and np.allclose(covariance, np.cov(x.T, bias=True))
    values, vectors = projection.principal(covariance, 64)
    assert np.allclose(vectors @ vectors.T, np.eye(64), atol=1e-6)
    assert np.allclose(np.sort(values)[::-1], np.linalg.eigvalsh(covariance)[::-1], rtol=1e-2)
    assert projection.moments(rows.limit(0), "embedding", 64)[0] == 0


def walked(data, ends, most, least=32):
    out, left = [], 0
    while left < len(data):
        window = data[left + least : left + most]
        stop = next((left + least + i + 1 for i, b in enumerate(window) if b in ends), min(left + most, len(data)))
        out.append(data[left:stop])
        left = stop
    return out


def test_contextual_chunks(spark):
    rng = random.Random(3)
    texts = ["", None, "a", "x" * 32, "x" * 32 + "\n", "é," * 100, "\n" * 70] + ["".join(rng.choices("ab,}\né ", weights=[30, 30, 1, 1, 1, 3, 3], k=400)) for _ in range(12)]
    kinds = ["JSON", "LINES", "ZIP", None]
    rows = [(i, t, kinds[i % 4]) for i, t in enumerate(texts * 4)]
    got = {}
    for r in chunks.contextual(spark.createDataFrame(rows, "k long, t string, kind string"), "k", "t", "kind", 64).orderBy("k", "chunk_no").collect():
        got.setdefault(r.k, []).append(bytes(r.data))
    for k, t, kind in rows:
        data = (t or "").encode()
        want = walked(data, {"JSON": b"},", "LINES": b"\n"}[kind], 64) if kind in ("JSON", "LINES") else [data[i : i + 64] for i in range(0, len(data), 64)]
        assert got.get(k, []) == want


def test_polynomials(spark):
    rng = random.Random(4)

    def bytes_of(a, b, c, n):
        return bytes((a * x * x + b * x + c) % 256 for x in range(n))

    def brute_fit(d):
        return next((a + 256 * b + 65536 * d[0] for a in range(256) for b in [(d[1] - d[0] - a) % 256 if len(d) > 1 else 0] if bytes_of(a, b, d[0], len(d)) == d), None) if d else None

    data = [b"", b"\x00", b"\xff", b"\x01\xfe"] + [bytes_of(*rng.choices(range(256), k=3), rng.choice((2, 3, 4, 9, 300))) for _ in range(20)] + [bytes(rng.choices(range(256), k=rng.choice((3, 4)))) for _ in range(20)]
    got = {r.id: r.s for r in frame(spark, data).select("id", chunks.polynomial(F.col("data")).alias("s")).collect()}
    assert got == {i: brute_fit(d) for i, d in enumerate(data)}


def test_tensor_containers(spark, tmp_path):
    rows = [("f", "b", [2, 3], [1.5, 2.0, 3.0, 4.0, 5.0, 6.0]), ("f", "a", [0], []), ("g", "é", [70000], [float(i) for i in range(70000)])]
    df = spark.createDataFrame(rows, "file string, name string, shape array<int>, values array<float>")
    made = {r.file: bytes(r.content) for r in tensors.packed(df, "file", b"MAGC").collect()}
    assert made["f"][:8] == b"MAGC\x02\x00\x00\x00"
    for name, content in made.items():
        (tmp_path / f"{name}.bin").write_bytes(content)
    back = tensors.read_tensors(spark, str(tmp_path), b"MAGC").orderBy("name", "part").collect()
    assert [(r.name, r["shape"], r.part, len(r["values"])) for r in back] == [("a", [0], 0, 0), ("b", [2, 3], 0, 6), ("é", [70000], 0, 65536), ("é", [70000], 1, 4464)]
    assert back[1]["values"] == rows[0][3] and back[2]["values"] + back[3]["values"] == rows[2][3]
    with pytest.raises(ValueError):
        list(tensors.tensors(b"nothing", b"MAGC"))


def test_language_model(spark):
    shape = denoise.Shape(radius=2, width=4, hidden=6)
    w = denoise.started(7, shape)
    seen, target = np.array([[0, 1, 0, 2, 3], [4, 4, 0, 5, 0]]), np.array([3, 6])
    _, g = denoise.gradients(w, seen, target)
    for k in w:
        at = tuple(s // 2 for s in w[k].shape)
        side = []
        for d in (1e-5, -1e-5):
            moved = {n: v.copy() for n, v in w.items()}
            moved[k][at] += d
            side.append(denoise.gradients(moved, seen, target)[0] / 2)
        assert abs((side[0] - side[1]) / 2e-5 - g[k][at]) < 1e-6
    texts = [("The cat sat on the mat. The dog ran to the door!",), ("Birds fly over the hills",), (None,), ("",), ("too short",)] * 40
    rows = denoise.corpus(spark.createDataFrame(texts, "text string"), "text")
    words = denoise.vocabulary(rows, 50)
    assert words[0] == "[MASK]" and words[1:] == sorted(words[1:]) and "short" not in words
    w, told = denoise.train(rows, words, 12, workers=2)
    assert told[-1][1] < told[0][1] / 2
    assert denoise.train(rows, words, 2, workers=2)[1] == denoise.train(rows, words, 2, workers=2)[1]
    assert denoise.train(rows.limit(0), words, 2)[1] == [(0, 0.0, 0), (1, 0.0, 0)]
    out = {r.k: r.generated for r in denoise.generate(spark.createDataFrame([(1, "the cat"), (2, None), (3, "zzz")], "k long, t string"), "k", "t", w, words, 4).collect()}
    assert set(out) == {1, 2, 3} and all(x in words[1:] for t in out.values() for x in t.split())


def test_masked_places():
    shape, index = denoise.Shape(radius=1, masked=1.0), {"a": 1, "b": 2}
    words = [["a", "b", "a"], ["a", "zzz", "b"], []]
    for whole, want in ((False, [1, 1, 1, 2, 2]), (True, [1, 1, 2])):
        seen, target = denoise.masked_windows(words, index, shape, np.random.default_rng(0), whole)
        assert sorted(target.tolist()) == want and (seen == 0).all() and seen.shape == (len(want), 3)
    assert denoise.masked_windows([], index, shape, np.random.default_rng(0))[0].shape == (0, 3)


def test_merges_encode_and_decode(spark):
    words = spark.createDataFrame([("aba", 5), ("abab", 3), ("cd", 1)], "word string, n long")
    merges = bpe.train(words, 3)
    assert merges[0] == (0, "a", "b", 11)
    names = bpe.symbols(words, merges)
    assert names[:6] == ["[MASK]", "</w>", "a", "b", "c", "d"] and len(names) == len(set(names)) == 9
    asked = spark.createDataFrame([("aba",), ("dcba",), ("axb",), ("",), (None,)], "word string")
    got = {r.word: (r.ids, r.d) for r in bpe.encode(asked, merges, names).withColumn("d", bpe.decode(F.col("ids"), names)).collect()}
    assert got["aba"][1] == "aba" and got["dcba"][1] == "dcba" and got["axb"][1] == "a[MASK]b" and got[""] == got[None] == ([], "")
    assert len(got["aba"][0]) < 4 and got["axb"][0][1] == 0
