import hashlib
from collections import defaultdict

import pytest

from hashloom.llm import common, exactdedup

from .data import documents


def digests(spark, keys):
    """(doc_id, digest) of numbered keys; the same key gives the same digest."""
    return spark.createDataFrame([(i, hashlib.sha256(str(k).encode()).digest()) for i, k in keys], "doc_id long, digest binary")


def plain(batches, best):
    out = defaultdict(list)
    for i, k in (x for b in batches for x in b):
        out[hashlib.sha256(str(k).encode()).digest()].append(i)
    return {d: (best([i for i in ids if i is not None], default=None), len(ids)) for d, ids in out.items() if len(ids) > 1}


# sizes 100, 100 (compacted to 190), 30, an empty batch, 20 (compacted to 50): keys repeat inside a batch, over two and over three; ids may be null
BATCHES = [
    [(i, i % 95) for i in range(100)],
    [(1000 + i, 95 + i if i else 7) for i in range(100)],
    [(2000 + i, 5000 + i if i > 2 else 40 + i) for i in range(30)],
    [],
    [(None if i == 1 else 10 - i, 6000 + i if i > 4 else (7, 8, 5003, 9, 9)[i]) for i in range(20)],
]


@pytest.mark.parametrize(("keep", "memtable"), [("min", 7), ("max", 200_000)])
def test_batches_against_a_plain_version(spark, keep, memtable):
    """Runs grow and are compacted; filters rule most entries out; what is left sums up to the repeats of all batches."""
    index, sizes = exactdedup.DigestIndex(keep, memtable), []
    for b in BATCHES:
        index.add(digests(spark, b))
        sizes.append([r.n for r in index.runs])
    assert [len(s) for s in sizes] == [1, 1, 2, 2, 2] and sizes[4][0] > sizes[3][0]
    got = {bytes(r.digest): (r.best, r.n) for r in index.repeats().collect()}
    assert got == plain(BATCHES, {"min": min, "max": max}[keep])
    shared, alone = index.entries()
    total, skipped = sum(r.n for r in index.runs), alone.count()
    assert shared.count() + skipped == total and skipped > 0.8 * total
    assert all(r.rows.count() == r.rows.select("digest").distinct().count() for r in index.runs)


def test_full_filters_change_no_result(spark, monkeypatch):
    """With filters of one size that lets nearly everything pass, the repeats are the same."""
    monkeypatch.setattr(common, "FILTER_WORDS", 64)
    many = [[(j * 10_000 + i, (j * 9_990 + i)) for i in range(10_000)] for j in range(2)]
    index = exactdedup.DigestIndex(fanout=100)
    for b in many:
        index.add(digests(spark, b))
    assert index.runs[0].n > 64 * common.FILTER_WORDS
    assert {bytes(r.digest): (r.best, r.n) for r in index.repeats().collect()} == plain(many, min)


@pytest.mark.parametrize("batches", [7])
def test_batches_do_not_matter(spark, batches):
    docs = documents(spark).repartition(4)
    want = exactdedup.exact_dedup(docs.coalesce(1), batches=1)
    got = exactdedup.exact_dedup(docs, batches=batches)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_nothing_added(spark):
    index = exactdedup.DigestIndex()
    index.add(digests(spark, []))
    assert index.runs == [] and index.repeats() is None and index.entries() == (None, None)
