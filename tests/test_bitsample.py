"""The index of sampled bits: its recall against all pairs, and cells that lose and repeat nothing."""

import random

import pytest

from hashloom.operators import bitsample, search


def brute(hashes, index):
    u = lambda x: x & (1 << 64) - 1
    near = lambda a, b: (u(a) ^ u(b)).bit_count() <= index.radius and any((u(a ^ b) & u(m)).bit_count() <= index.flips for m in index.masks)
    return {i: sum(i != j and near(a, b) for j, b in enumerate(hashes)) for i, a in enumerate(hashes)}


@pytest.fixture(scope="module")
def hashes():
    """Random ones, neighbours of some at up to 24 bits, a third of all rows equal, and a cluster within few bits."""
    rng = random.Random(11)
    out = [rng.getrandbits(64) for _ in range(60)]
    out += [h ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 24))) for h in out for _ in range(2)]
    out += [out[0]] * 120 + [out[1] ^ 1 << i for i in range(60)]
    return [h - (1 << 64) if h >> 63 else h for h in out]


def rows(spark, hashes):
    return spark.createDataFrame(list(enumerate(hashes)), "id long, hash long").repartition(3)


@pytest.mark.parametrize("bits, flips, recall, cell", [(10, 0, 0.95, bitsample.CELL), (12, 1, 0.9, 7), (6, 2, 0.5, 1), (8, 0, 0.3, 20)])
def test_links_are_those_of_the_tables(spark, hashes, bits, flips, recall, cell):
    index = bitsample.tables(20, bits, flips, recall)
    got = {r.id: r.n_links for r in bitsample.links(rows(spark, hashes), index, cell).collect()}
    assert got == brute(hashes, index)


def test_recall_against_all_links(spark, sf):
    from hashloom.plans import index, vectors

    table = vectors.hashed(spark, sf).selectExpr("vec_id AS id", "h AS hash").cache()
    every = {r.id: r.n_links for r in search.all_links(table, 20).collect()}
    found = {r.id: r.n_links for r in bitsample.links(table, index.INDEX).collect()}
    assert sum(every.values()) > 500 and all(found[i] <= every[i] for i in every)
    assert sum(found.values()) >= 0.9 * sum(every.values())


def test_recall_at_the_radius(spark):
    """Pairs at exactly 20 bits, the hardest, for tables sized for three numbers of rows."""
    rng = random.Random(5)
    a = [rng.getrandbits(63) for _ in range(400)]
    b = [h ^ sum(1 << i for i in rng.sample(range(63), 20)) for h in a]
    asked = spark.createDataFrame([(-1 - i, h) for i, h in enumerate(a)], "query long, qhash long")
    kept = spark.createDataFrame(list(enumerate(b)), "id long, hash long")
    for size in (1000, 100_000, 10_000_000):
        index = bitsample.sized(size, 20, 0.95)
        met = bitsample.found(asked, kept, index).filter("id = -1 - query").count()
        assert met >= 0.9 * len(a), (size, index.bits, index.flips, len(index.masks), met)


def test_first_and_nothing(spark, hashes):
    index = bitsample.tables(20, 10, 1, 0.95)
    table = rows(spark, hashes)
    asked = table.filter("id % 10 = 0").selectExpr("id AS query", "hash AS qhash")
    every = [tuple(r) for r in bitsample.found(asked, table, index).collect()]
    assert len(every) == len(set(every)) == sum(n for i, n in brute(hashes, index).items() if i % 10 == 0)
    first = {r["query"]: r.id for r in bitsample.first_found(asked, table, index).collect()}
    assert first == {q: min(i for p, i, _ in every if p == q) for q, _, _ in every}
    assert bitsample.links(table.limit(0), index).count() == 0
    null = spark.createDataFrame([(1, None), (2, 5), (3, 5)], "id long, hash long")
    assert sorted(map(tuple, bitsample.links(null, index).collect())) == [(1, 0), (2, 1), (3, 1)]
