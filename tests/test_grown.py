"""Queries that were too slow or too wide on large tables: what they must not do again, and results against plain versions."""

import hashlib
import random
import uuid
from itertools import pairwise

import pyarrow as pa
import pytest

from hashloom.operators import bitsample, bpe, bytemerges, chunks, codebook, edits, pairs, search
from hashloom.plans import catalog

from .test_bytemerges import plain_train
from .test_whole import plain_merges


@pytest.fixture
def jobs(spark):
    """A function that runs another one and tells its result and how many jobs it took."""

    def counted(f):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, group)
        out = f()
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("other", "other")
        return out, n

    yield counted


def test_byte_encode_counts_pairs_seldom(spark, sf, jobs):
    """A job for each merge went over all texts."""
    rows, n = jobs(lambda: catalog.queries()["byte_encode"](spark, sf).collect())
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert n < 48 and {r.doc_id: r.decoded_md5 for r in rows} == {k: hashlib.md5(t).hexdigest() for k, t in texts.items()}
    assert all(len(r.ids) == r.n_ids <= len(texts[r.doc_id]) for r in rows)


def test_byte_merges_count_pairs_seldom(spark, jobs):
    """Merges as plain ones, also where they are rarer than what texts are cut at first; far fewer jobs than two a merge."""
    rng = random.Random(4)
    texts = ["".join(rng.choices(["the ", "cat ", "éa", "x", "yz", "q"], [9, 5, 3, 1, 1, 1], k=rng.randint(1, 30))) for _ in range(50)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got, n = jobs(lambda: bytemerges.train(rows, "text", 40))
    assert got == plain_train(texts, 40, bytemerges.CODEBOOK)[0] and len(got) == 40 and n < 80


def test_tiers_take_no_pairs_through_the_plan(spark):
    """As a plain search, with an empty tier too; codewords come to the tasks once and not as a join of all pairs."""
    rng = random.Random(6)
    book = [[bytes(rng.choices(range(4), k=12)) for _ in range(n)] for n in (9, 0, 30)]
    asked = [bytes(rng.choices(range(256), k=12)) for _ in range(40)] + book[0][:3] + book[2][:3]
    frame = lambda data, name: spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], f"{name} long, data binary")
    found = codebook.nearest_tiered(frame(asked, "k"), [frame(b, "id") for b in book], ["k"], 60)

    def plain(q):
        far = [min((sum((x ^ y).bit_count() for x, y in zip(q, d, strict=True)), i) for i, d in enumerate(b)) if b else None for b in book]
        near = [(k, f[1], f[0]) for k, f in enumerate(far) if f and f[0] * 2 <= 60]
        return near[0] if near else min((f[0], k, f[1]) for k, f in enumerate(far) if f)[1:] + (min(f[0] for f in far if f),)

    assert {r.k: (r.tier, r.id, r.distance) for r in found.collect()} == {k: plain(q) for k, q in enumerate(asked)}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def plain_beside(rows, size):
    cut = [(k, [t.encode()[i : i + size] for i in range(0, len(t.encode()), size)]) for k, t in rows if k is not None and t]
    return sorted((k, i, a[i], b[i + 1]) for k, a in cut for j, b in cut if j == k for i in range(min(len(a), len(b) - 1)))


@pytest.mark.parametrize("repeated", [False, True])
def test_chunks_beside(spark, repeated):
    """What the join of chunks gives, without one where no key is repeated."""
    rng = random.Random(7)
    rows = [(i, "é" * (i % 3) + "".join(rng.choices("abc", k=i))) for i in range(40)] + [(None, "x" * 30), (99, ""), (98, None)]
    rows += [(7, "y" * 33), (7, "z" * 9), (8, "w" * 50)] if repeated else []
    got = chunks.beside(spark.createDataFrame(rows, "id long, t string").repartition(3), "id", "t", 8)
    assert sorted((r.id, r.chunk_no, bytes(r.data), bytes(r.pattern)) for r in got.collect()) == plain_beside(rows, 8)
    assert ("Join" in got._jdf.queryExecution().toString()) == repeated


def test_xored():
    rng = random.Random(8)
    for longest in (9, 3000):
        a, b = ([None if rng.random() < 0.1 else rng.randbytes(rng.choice((0, 1, 8, 8, 9, longest if i == 3 else 5))) for i in range(60)] for _ in range(2))
        want = [None if x is None or y is None else bytes(p ^ q for p, q in zip(x, y.ljust(len(x), b"\0"))) for x, y in zip(a, b, strict=True)]
        assert codebook.xored_bytes(pa.array(a, pa.binary()), pa.array(b, pa.binary())).to_pylist() == want
        assert codebook.xored_bytes(pa.array(a, pa.binary())[5:50], pa.array(b, pa.binary())[5:50]).to_pylist() == want[5:50]
    big = [b"x" * 3_000_000] + [b"y"] * 500
    assert codebook.xored_bytes(pa.array(big), pa.array(big)).to_pylist() == [bytes(len(x)) for x in big]


def test_cuts_of_parts(monkeypatch):
    """A text is hashed a part at a time; its cuts are those of the text hashed whole."""
    rng = random.Random(9)
    for n in (0, 1, 7, 8, 40, 999, 5000):
        data = rng.randbytes(n)
        whole = [bpe.cut_points(data, 64), bpe.rabin_cuts(data, 64)]
        with monkeypatch.context() as m:
            m.setattr(bpe, "PART", 37)
            assert [bpe.cut_points(data, 64), bpe.rabin_cuts(data, 64)] == whole


def test_chunks_of_empty_texts(spark):
    """An empty or null text, which has no chunk, ended the query; and no row of a chunk carries its text."""
    rows = [(1, "é" * 3000), (None, "x" * 700), (3, ""), (4, None), (1, "ab" * 500)]
    for cuts in (bpe.cut_points, bpe.rabin_cuts):
        got = bpe.content_chunks(spark.createDataFrame(rows, "id long, t string"), "id", "t", 64, cuts)
        want = [(k, i, a, z - a, hashlib.sha256(t.encode()[a:z]).hexdigest()) for k, t in rows for ends in [cuts((t or "").encode(), 64)] for i, (a, z) in enumerate(pairwise([0, *ends]))]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert "Generate" not in got._jdf.queryExecution().toString()


def test_nearest_in_blocks(spark, monkeypatch):
    """As a plain search, with blocks of few queries, equal hashes and rows of one id; no join of all pairs."""
    rng = random.Random(10)
    rows = [(i, rng.getrandbits(6) - 20) for i in range(150)] + [(5, 3), (140, -4), (500, None)]
    table = spark.createDataFrame(rows, "id long, hash long").repartition(4)
    queries = table.filter("id % 7 = 0 OR id = 500").selectExpr("id AS query", "hash AS qhash")
    want = {}
    for q, h in rows:
        if q % 7 == 0 and h is not None:
            want[q] = min([want.get(q, (99, 0)), *((((h ^ g) & (1 << 64) - 1).bit_count(), i) for i, g in rows if i != q and g is not None)])
    for size in (4, 1000):
        with monkeypatch.context() as m:
            m.setattr(search.in_blocks, "__defaults__", (size,))
            got = search.nearest(queries, table)
            assert {r["query"]: (r.distance, r.id) for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_softmax_moves_no_products(spark, sf, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search.in_blocks, "__defaults__", (2,))
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    table = spark.createDataFrame([*rows, (70, None)], "id long, v array<double>").repartition(4)
    got = search.softmax(table.filter("id % 10 = 0").selectExpr("id AS query", "v AS a"), table.selectExpr("id", "v AS b"))
    s = np.array([v for _, v in rows]) @ np.array([v for _, v in rows]).T
    told = {r["query"]: (r.m, r.z, r.own) for r in got.collect()}
    assert told.pop(70) == (None, None, None) and set(told) == {0, 10, 20, 30, 40, 50}
    for q, (m, z, own) in told.items():
        assert np.allclose((m, z, own), (s[q].max(), np.exp(s[q] - s[q].max()).sum(), s[q, q]))


@pytest.mark.parametrize("top", [pairs.TOP, 3, 1])
def test_merges_of_words_count_pairs_seldom(spark, jobs, monkeypatch, top):
    """As plain merges, also where few pairs come to the driver; a symbol that two pairs make is one."""
    rng = random.Random(12)
    words = [(w, rng.randint(1, 30)) for w in sorted({"".join(rng.choices("abcé😀", k=rng.randint(1, 9))) for _ in range(80)})] + [("</w>", 50), ("x</w>", 20), ("", 3)]
    rows = spark.createDataFrame([*words, (None, 5)], "word string, n long").repartition(3)
    monkeypatch.setattr(pairs, "TOP", top)
    got, n = jobs(lambda: bpe.train(rows, 30))
    assert got == plain_merges(words, 30) and (top < 9 or n < 60)
    table = bpe.symbols(rows, got)
    for r in bpe.encode(rows, got, table).collect():
        parts = (*r.word, "</w>") if r.word else ()
        for _, left, right, _ in got:
            parts = bpe.merged(parts, left, right)
        assert r.ids == [table.index(x) for x in parts]


def test_links_of_the_index_are_compared_in_blocks(spark):
    """No row goes to each table; the links are those that the tables bring together."""
    rng = random.Random(13)
    hashes = [rng.getrandbits(63) for _ in range(40)]
    hashes += [h ^ sum(1 << i for i in rng.sample(range(63), rng.randint(0, 22))) for h in hashes for _ in range(3)]
    index = bitsample.tables(20, 9, 1, 0.5)
    got = bitsample.links(spark.createDataFrame(list(enumerate(hashes)), "id long, hash long"), index, 50)
    near = lambda x: x.bit_count() <= 20 and any((x & m).bit_count() <= 1 for m in (m & (1 << 64) - 1 for m in index.masks))
    assert {r.id: r.n_links for r in got.collect()} == {i: sum(i != j and near(a ^ b) for j, b in enumerate(hashes)) for i, a in enumerate(hashes)}
    assert "mask" not in got._jdf.queryExecution().toString()


def test_no_nested_loop_over_turns(spark, sf):
    for name in ("qa_retrieval", "retrieve_or_generate"):
        assert "NestedLoop" not in catalog.queries()[name](spark, sf)._jdf.queryExecution().toString()


def test_scripts_of_many_pairs():
    """Those of the step by step versions, and applied again, for all rows together."""
    import numpy as np

    rng = random.Random(14)
    for p, c in ((64, 64), (64, 5), (3, 64), (0, 4), (4, 0), (1, 1), (150, 60), (0, 0)):
        patterns, made = ([bytes(rng.choices(b"abcd", k=n)) for _ in range(50)] for n in (p, c))
        patterns[0] = patterns[0][:0] + bytes(p)
        grid = [np.frombuffer(b"".join(x), np.uint8).reshape(50, n) for x, n in ((patterns, p), (made, c))]
        got = edits.scripts(*grid)
        assert got == [edits.script(x, y, t.tolist()) for x, y, t in zip(patterns, made, edits.tables(*grid), strict=True)]
        assert edits.apply_all(patterns, got) == made
    assert edits.apply_all([], []) == []
