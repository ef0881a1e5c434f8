"""Codebooks carried over, and lossy choices, against plain versions."""

import random
from itertools import combinations

from hashloom.operators import transfer


def test_transferred(spark):
    base = spark.createDataFrame([(i, bytearray(w)) for i, w in enumerate([b"aaaa", b"bbbb", b"cccc", b"dddd"])], "id long, data binary")
    counts = spark.createDataFrame([(bytearray(b"bbbb"), 2), (bytearray(b"dddd"), 7), (bytearray(b"eeee"), 9), (bytearray(b"ffff"), 1)], "data binary, n long")
    told = lambda most: [(r.place, r.origin, r.n, bytes(r.data)) for r in transfer.transferred(base, counts, most).orderBy("place").collect()]
    assert told(9) == [(0, "base", 7, b"dddd"), (1, "base", 2, b"bbbb"), (2, "new", 9, b"eeee"), (3, "new", 1, b"ffff"), (4, "idle", 0, b"aaaa"), (5, "idle", 0, b"cccc")]
    assert told(3) == told(9)[:3]
    own = counts.filter("n > 1")
    assert tuple(transfer.coverage(base, own, counts).first()) == (4, 2, 9)
    assert transfer.transferred(base.limit(0), counts.limit(0), 5).count() == 0


def test_given_up_is_the_best_choice(spark):
    """As many chunks as any choice within the budget gives up, with the least bits among those; ties by number; nulls never."""
    rng = random.Random(4)
    rows = [(d, k, rng.choice([None, 0, 1, 1, 2, 3, 5]), 8) for d in range(40) for k in range(rng.randint(1, 8))]
    got = {}
    for r in transfer.given_up(spark.createDataFrame(rows, "d long, chunk_no long, distance long, bits long"), "d", 0.1).collect():
        got.setdefault(r.d, []).append((r.chunk_no, r.distance, r.lossy))
    assert sum(map(len, got.values())) == len(rows)
    for some in got.values():
        budget, near = 0.1 * 8 * len(some), [(x, k) for k, x, _ in some if x is not None]
        best = max((c for n in range(len(near) + 1) for c in combinations(sorted(near), n) if sum(x for x, _ in c) <= budget), key=lambda c: (len(c), -sum(x for x, _ in c), [-k for _, k in c]))
        assert sorted((x, k) for k, x, lossy in some if lossy) == sorted(best)
