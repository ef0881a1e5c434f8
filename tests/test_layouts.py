"""Layouts against plain moves of a grid."""

import hashlib

from hashloom.operators import layouts


def test_layouts(spark):
    images = (0, 1, 7, 12345, None)
    rows = [(m, p, [float(16 * (m or 0) + p + i / 100) for i in range(20)]) for m in images for p in range(16)] + [(1, 3, None)]
    got = {}
    for r in layouts.layouts(spark.createDataFrame(rows, "image long, patch long, vector array<double>")).collect():
        got.setdefault((r.image, r.layout), []).append((r.patch, r.vector, r.weight))
    assert len(got) == 5 * len(images)
    for m in images[:-1]:
        d = lambda kind, k: int(hashlib.md5(f"{m}:{kind}".encode()).hexdigest()[k - 1], 16)  # noqa: B023, E731
        own = {p: v for i, p, v in rows if i == m and v}
        place = {"centre": lambda r, c: (r, c), "occlusion": lambda r, c: (r, c), "grain": lambda r, c: (r, c)}
        place["shift"] = lambda r, c: ((r + d("shift", 2)) % 4, (c + 1 + d("shift", 1) % 3) % 4)  # noqa: B023
        quarter = lambda r, c: (c, 3 - r)

        def turn(r, c):
            for _ in range(1 + d("rotation", 1) % 3):  # noqa: B023
                r, c = quarter(r, c)  # noqa: B023
            return r, c

        place["rotation"] = turn
        for kind, to in place.items():
            want = []
            for p, v in own.items():
                r, c = to(p // 4, p % 4)
                if kind == "occlusion" and 0 <= p // 4 - d(kind, 1) % 3 <= 1 and 0 <= p % 4 - d(kind, 2) % 3 <= 1:
                    v = [0.0] * 20
                if kind == "grain":
                    g = [hashlib.md5(f"{m}:{p}:{i}".encode()).hexdigest()[0] for i in range(20)]
                    v = [{"0": 1.0, "f": -1.0}.get(x, y) for x, y in zip(g, v, strict=True)]
                want.append((4 * r + c, v, 1.5 if 4 * r + c in (5, 6, 9, 10) else 0.8))
            assert sorted(x for x in got[m, kind] if x[1]) == sorted(want)
    assert sum(v is None for x in got.values() for _, v, _ in x) == 5
