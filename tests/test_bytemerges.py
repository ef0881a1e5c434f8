"""Byte merges, model files, locked chunks and the greedy reverse steps against plain versions of the same."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.operators import bytemerges, codebook, denoise, projection
from hashloom.sources import tensors


def plain_merge(ids, left, right, new):
    out, i = [], 0
    while i < len(ids):
        if ids[i : i + 2] == [left, right]:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def plain_train(texts, merges, rules):
    rows, size, out = [list((t or "").encode()) for t in texts], {k: 1 for k in range(256)}, []
    for new in range(rules.first, rules.first + merges):
        pairs = Counter(p for r in rows for p in zip(r, r[1:]))
        able = [(-n, p) for p, n in pairs.items() if n >= rules.least and (rules.longest is None or size[p[0]] + size[p[1]] <= rules.longest)]
        if not able:
            break
        n, (left, right) = min(able)
        out.append((new, left, right, -n))
        size[new] = size[left] + size[right]
        rows = [plain_merge(r, left, right, new) for r in rows]
    return out, rows


@pytest.mark.parametrize("rules", [bytemerges.CODEBOOK, bytemerges.MODEL, bytemerges.Rules(longest=3, least=4), bytemerges.Rules(longest=1)])
def test_byte_merges(spark, rules):
    rng = random.Random(8)
    texts = ["".join(rng.choices("aab é😀\n", k=rng.randint(1, 40))) for _ in range(60)]
    texts += texts[:20] + ["aaaaaaa", "a", "", None, "\x00\x01\x02"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    merges, ids = plain_train(texts, 25, rules)
    assert bytemerges.train(rows, "text", 25, rules, every=4) == merges
    coded = rows.withColumn("ids", bytemerges.encode(F.col("text"), merges))
    names = bytemerges.table(merges, rules)
    for r in coded.withColumn("back", bytemerges.decode(F.col("ids"), names)).collect():
        assert r.ids == ids[r.id]
        # the special names stand where their bytes would
        assert r.back == ("[PAD][MASK][UNK]" if rules.special and texts[r.id] == "\x00\x01\x02" else texts[r.id] or "")
    assert bytemerges.train(rows.limit(0), "text", 3) == []


def test_model_files():
    shape = denoise.Shape(radius=2, width=4, hidden=6)
    w, words = denoise.started(5, shape), ["[MASK]", "a", "é", "漢", ""]
    content = tensors.model_bytes(w, words, b"MAGC")
    assert content[:20] == b"MAGC" + np.array([4, 6, 2, 5], "<i4").tobytes()
    back, names = tensors.model_of(content, b"MAGC")
    assert names == words and all((back[k] == w[k].astype("<f4")).all() for k in w)
    for bad in (b"XXXX" + content[4:], content[:-1], content[:22], content + b"\0"):
        with pytest.raises(ValueError):
            tensors.model_of(bad, b"MAGC")


def test_locked_chunks(spark):
    key, other = codebook.stretched(b"one", b"s" * 16), codebook.stretched(b"two", b"s" * 16)
    assert key == hashlib.pbkdf2_hmac("sha256", b"one", b"s" * 16, 100000) and len(other) == 32
    rows = spark.createDataFrame([(1, b"abc"), (2, b"abc"), (3, b""), (4, None)], "id long, data binary")
    got = rows.withColumn("x", codebook.lock(F.col("data"), key))
    told = {r.id: r for r in got.select("id", "data", "x", codebook.unlock(F.col("x"), key).alias("a"), codebook.unlock(F.col("x"), other).alias("b")).collect()}
    assert all(r.a == r.data and r.b is None for r in told.values())
    assert len(told[1].x) == 31 and told[1].x != told[2].x and told[4].x is None


def test_reverse_steps(spark):
    shape = denoise.Shape(radius=2, width=4, hidden=6)
    w = denoise.started(9, shape, seed=5)
    for n in (0, 1, 7, 40):
        seq = [0] * n
        for step in range(20 if n else 0):
            p = denoise.softmax(denoise.forward(w, denoise.windows(np.array(seq), 2))[0])
            sure = sorted(((-p[i].max(), i) for i in range(n)))
            k = n * (step + 1) // 20
            kept = {i for s, i in sure if k and s <= sure[k - 1][0]}
            seq = [int(p[i].argmax()) if i in kept else 0 for i in range(n)]
        assert denoise.revealed(w, n, shape) == seq
    words = ["[MASK]", *"abcdefgh"]
    got = denoise.unmask(spark.createDataFrame([(3,), (None,), (0,)], "n long"), "n", w, words, shape).collect()
    assert sorted(len(r.generated.split()) for r in got) == [0, 0, 3]


def test_sine_state(spark):
    rows = spark.createDataFrame([(1, [3, 0, 12]), (2, []), (3, None)], "id long, t array<int>")
    got = {r.id: r.h for r in rows.select("id", projection.sine_state(F.col("t"), 8).alias("h")).collect()}
    assert np.allclose(got[1], [sum(np.sin(t + i * k) for k, t in enumerate([3, 0, 12])) for i in range(8)])
    assert got[2] == [0.0] * 8 and got[3] is None or got[3] == [None] * 8
