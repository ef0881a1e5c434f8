"""Containers: what was packed comes back, and only blocks that a range touches are opened."""

import random

import pytest
from pyspark.sql import functions as F

from hashloom.operators import chunks
from hashloom.sources import container


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    line = "".join(rng.choices("abcdefgh ", k=64))
    out = {i: "".join(rng.choices("abcd é\n", k=rng.choice([0, 1, 15, 16, 17, 63, 64, 500]))) for i in range(60)}
    out |= {100 + i: line * i for i in range(12)} | {-5: "x" * 5000, 1000: line * 300 + "end", None: "no key " * 9, 2000: None}
    return out


@pytest.fixture(scope="module", params=[container.FILE_BYTES, 1])
def packed(spark, tmp_path_factory, texts, request):
    """In one file a task, and in a new file for each block."""
    path = str(tmp_path_factory.mktemp("container") / "c")
    docs = spark.createDataFrame(list(texts.items()), "k long, t string").repartition(3)
    counts = chunks.frequency(chunks.fixed(docs, "k", "t", 16).filter(F.length("data") == 16))
    container.pack(docs, "k", "t", path, chunks.elite(counts, 2, 20), chunk=16, per_block=4, file_bytes=request.param)
    return path


def back(df):
    return {r.doc: (bytes(r.data), r.blocks) for r in df.collect()}


def test_whole(spark, packed, texts):
    want = {k: (t.encode(), -(-len(t.encode()) // 64)) for k, t in texts.items() if t}
    assert back(container.unpacked(spark, packed, 16)) == want
    kinds = container.read(spark, packed).groupBy(F.col("id").isNull().alias("literal")).count().collect()
    assert len(kinds) == 2


@pytest.mark.parametrize("start, end", [(63, 65), (64, 128), (19_000, 50_000), (10**9, None), (130, None)])
def test_ranges(spark, packed, texts, start, end):
    """A document without bytes in the range has no row; others open the blocks that the range touches and no more."""
    want = {}
    for k, t in texts.items():
        data = (t or "").encode()
        cut = data[start : len(data) if end is None else end]
        if cut:
            want[k] = (cut, (start + len(cut) - 1) // 64 - start // 64 + 1)
    assert back(container.unpacked(spark, packed, 16, start, end)) == want


@pytest.mark.parametrize("first, last", [(100, 104), (None, -5), (5000, 6000)])
def test_keys(spark, packed, texts, first, last):
    want = {k for k, t in texts.items() if t and k is not None and (first is None or k >= first) and (last is None or k <= last)}
    assert set(back(container.unpacked(spark, packed, 16, firstDoc=first, lastDoc=last))) == want


def test_files_outside_the_range_are_not_opened(packed):
    reader = lambda **o: container.ContainerReader({"path": packed} | o).partitions()
    every = [p for p in reader() if p.file]
    far = [p for p in reader(start="19000") if p.file]
    some = [p for p in reader(firstDoc="1000", lastDoc="1000") if p.file]
    assert 0 < len(far) <= len(every) and 0 < len(some) <= len(every) and not [p for p in reader(firstDoc="7777") if p.file]
    if len(every) > 100:
        assert len(far) < 10 and len(some) < len(every)


def test_tables_of_a_file(packed):
    """The header's counts and the tables say where every block and chunk is."""
    fs, root = container.open_fs(packed)
    total = 0
    for p in container.ContainerReader({"path": packed}).partitions():
        with fs.open_input_file(f"{root}/{p.file}") as f:
            magic, chunk, per_block, documents, n, blocks = container.HEADER.unpack(f.read_at(container.HEADER.size, 0))
            assert (magic, chunk, per_block) == (container.MAGIC, 16, 4)
            table = list(container.BLOCK.iter_unpack(f.read_at(blocks * container.BLOCK.size, container.HEADER.size)))
            pool = container.HEADER.size + blocks * container.BLOCK.size + documents * container.DOCUMENT.size + n * container.CHUNK.size
            assert table[-1][0] + table[-1][1] + pool == f.size()
            total += n
    assert total > 1200


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "")], "k long, t string")
    book = spark.createDataFrame([], "id long, data binary")
    container.pack(docs, "k", "t", str(tmp_path / "e"), book, 16, 4)
    assert container.unpacked(spark, str(tmp_path / "e"), 16).count() == 0
