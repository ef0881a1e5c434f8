"""Keyed state in blocks: the same answers whatever the batches and blocks, after a restart, and when idle."""

import random
import time

import pytest

from hashloom.plans.streams import ON_DISK, STORE
from hashloom.streaming import keyed

SCHEMA = "conv_id long, turn long, hash long"


@pytest.fixture
def on_disk(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ON_DISK)
    yield
    spark.conf.set(STORE, before)


def turns():
    """One conversation with most of the turns, small ones, near hashes, a gap in the turns."""
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(12)]
    near = lambda: rng.choice(base) ^ sum(1 << i for i in rng.sample(range(64), rng.choice([0, 3, 18, 25])))
    rows = [(1, t, near()) for t in range(150)] + [(2, t, near()) for t in range(5)] + [(3, t, near()) for t in (0, 1, 4, 5)] + [(4, 0, 0)]
    return [(c, t, h - (1 << 64) if h >> 63 else h) for c, t, h in rows]


def plain(rows, limit=20, sixteenths=2):
    out, held, last = [], {}, {}
    for c, t, h in sorted(rows):
        h &= (1 << 64) - 1
        own = keyed.mixed(last[c][1] if c in last and last[c][0] == t - 1 else None, h, f"{c}:{t}", sixteenths)
        hit = next(((m, (own ^ x).bit_count()) for x, m in held.setdefault(c, []) if (own ^ x).bit_count() <= limit), None)
        if hit is None:
            held[c].append((own, t))
        out.append((c, t, "insert" if hit is None else "hit", *(hit or (None, None))))
        last[c] = (t, h)
    return out


def run(spark, tmp_path, name, **how):
    """Takes what is new in the folder since the last run, and stops."""
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = keyed.decayed_cache(source, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def told(spark, tmp_path):
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: (r[0], r[1] if r[1] is not None else 1 << 40))


@pytest.mark.parametrize("block", [1, 7, keyed.BLOCK])
def test_blocks_and_restart(spark, on_disk, tmp_path, block):
    """Three batches, the last one after the query was stopped and started again from its checkpoint."""
    rows = turns()
    for k, part in enumerate((rows[:60] + rows[150:], rows[60:100], rows[100:150])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k > 0:
            run(spark, tmp_path, f"s{k}", block=block)
    assert told(spark, tmp_path) == plain(rows)


def test_an_idle_conversation_is_ended(spark, on_disk, tmp_path):
    """A query with timers never says that all is done: it is stopped once the rows are there."""
    write = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write([(1, 0, 5), (2, 0, 9)])
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = keyed.decayed_cache(source, idle_ms=1500, ttl_ms=600_000).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()

    def wait(*rows):
        until = time.time() + 60
        while time.time() < until and not set(rows) <= set(got := list(map(tuple, spark.table("idle").collect()))):
            time.sleep(0.3)
        return got

    try:
        got = wait((1, None, "ended", None, None), (2, None, "ended", None, None))
        assert len(got) == 4
        write([(1, 1, 5)])
        assert (1, 1, "insert", None, None) in wait((1, 1, "insert", None, None))  # nothing is known any more of what was ended
    finally:
        q.stop()


def test_as_a_table(spark, on_disk):
    spark.streams.active  # noqa: B018
    rows = turns()
    got = keyed.decayed_cache(spark.createDataFrame(rows, SCHEMA).repartition(3), block=5).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))


def test_masks_are_those_of_the_column_function(spark):
    from pyspark.sql import functions as F

    from hashloom.functions.bits import bernoulli_mask

    keys = ["", "1:2", "77:0", "é"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", bernoulli_mask(F.col("k"), F.lit(5)).alias("m")).collect()
    assert {r.k: r.m & (1 << 64) - 1 for r in rows} == {k: keyed.mask(k, 5) for k in keys}
