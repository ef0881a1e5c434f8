"""Best-fit packing of token sequences by bin completion.

Only how many pieces there are of each length decides a packing, and there are at most `capacity` lengths. That
histogram is packed on the driver into patterns (lengths with a number of repeats); Spark numbers the pieces of each
length and looks up each piece's sequence and place. Nothing on the driver grows with the documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, texts_of
from .pieces import worker_encoder

#: Steps of one enumeration of fillings, completions kept of each, and steps of all enumerations; None: no limit, an exact search.
FILLING_STEPS, FILLINGS, SEARCH_STEPS = 400, 3, 400_000
#: Bins of the first part of an incumbent that is packed anew; failing it, the part doubles until it is the whole.
PART = 8


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces: doc_id, piece, start, length, ids_crc32, and a number (bucket, local_no) among a task's pieces of that length.

    Each document is its ids and end_id; only longer ones are cut, each capacity ids. Null and empty texts: end_id only.
    """
    end = np.array([end_id], "<u4").tobytes()

    def tasks(batches):
        from pyspark import TaskContext

        bucket, encoder, seen = TaskContext.get().partitionId(), worker_encoder(tokenizer), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows = []
            for doc, data in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                data += end
                for k in range(0, len(data), 4 * capacity):
                    part = data[k : k + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, k // 4 // capacity, k // 4, n, zlib.crc32(part), bucket, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bucket", "local_no"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return map_batches(texts_of(docs), tasks, "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int, local_no long")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing on a histogram: (repeats, lengths) of equal bins, longest items first into the fullest bin that takes them."""
    open_bins: dict[int, list] = defaultdict(list)  # free room -> [repeats, lengths]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in open_bins if r >= size):
            while left and open_bins[room]:
                n, held = open_bins[room].pop()
                each = min(room // size, left // n) if left >= n else 0
                if each == 0:  # fewer items than bins: split the group
                    if n > left:
                        open_bins[room].append([n - left, held])
                    n, each = left, 1
                open_bins[room - each * size].append([n, held | {size: held.get(size, 0) + each}])
                left -= n * each
        each = capacity // size
        if left >= each:
            open_bins[capacity - each * size].append([left // each, {size: each}])
            left %= each
        if left:
            open_bins[capacity - left * size].append([1, {size: left}])
    return [(n, held) for group in open_bins.values() for n, held in group]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Fewest bins that any packing needs: the best of volume bounds in which items over half a bin, but for those below each cut, lie alone."""
    number, volume = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for k, n in counts.items():
        number[k + 1], volume[k + 1] = n, k * n
    number, volume = np.cumsum(number), np.cumsum(volume)  # of items below k
    half = capacity // 2 + 1
    most = 0
    for cut in range(capacity // 2 + 1):
        alone = number[-1] - number[half]
        beside = capacity * (number[capacity - cut + 1] - number[half]) - (volume[capacity - cut + 1] - volume[half])
        small = volume[half] - volume[cut]
        most = max(most, int(alone + max(0, -(-(small - beside) // capacity))))
    return most


def fillings(room: int, sizes: list[int], counts: dict[int, int], best: int | None = FILLINGS, steps: int | None = FILLING_STEPS) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """Undominated fillings (waste, lengths) of room with the remaining sizes (ascending), least waste first, and the steps taken.

    A filling is dominated, and left out, if an unused item fits beside it, or could take the place of one or two
    of its items without exceeding the room: the other filling leaves easier items for later bins. If the steps run
    out before one is found, the one of largest items first is given.
    """
    found: list[tuple[int, dict[int, int]]] = []
    greedy: list[tuple[int, dict[int, int]]] = []
    spent = 0
    most, limit = (best or float("inf")), (steps or float("inf"))

    def spare(x: int, held: dict[int, int]) -> bool:
        return counts.get(x, 0) > held.get(x, 0)

    def dominated(held: dict[int, int], waste: int) -> bool:
        def swap(low: int) -> bool:  # is there an unused item of low < size <= low + waste?
            k = bisect_right(sizes, low + waste)
            while k and sizes[k - 1] > low:
                if spare(sizes[k - 1], held):
                    return True
                k -= 1
            return False

        items = sorted(held)
        if swap(0) or waste and any(swap(x) for x in items):
            return True
        pairs = {a + b for i, a in enumerate(items) for b in items[i:] if a != b or held[a] > 1}
        return any(spare(p, held) for p in pairs) or waste > 0 and any(swap(p) for p in pairs)

    def search(room: int, upto: int, held: dict[int, int]) -> bool:
        nonlocal spent
        spent += 1
        k = min(bisect_right(sizes, room), upto)
        while k and not spare(sizes[k - 1], held):
            k -= 1
        if k == 0 or room == 0:
            if not greedy:
                greedy.append((room, dict(held)))
            if not dominated(held, room):
                found.append((room, dict(held)))
            return room == 0 and sum(f[0] == 0 for f in found) >= most or spent > limit
        for i in range(k, 0, -1):
            if spare(sizes[i - 1], held):
                held[sizes[i - 1]] = held.get(sizes[i - 1], 0) + 1
                stop = search(room - sizes[i - 1], i, held)
                held[sizes[i - 1]] -= 1
                if not held[sizes[i - 1]]:
                    del held[sizes[i - 1]]
                if stop or spent > limit:
                    return True
        return False

    search(room, len(sizes), {})
    ordered = sorted(found or greedy, key=lambda f: (f[0], sum(f[1].values())))
    return (ordered if best is None else ordered[:best]), spent


def complete(counts: dict[int, int], capacity: int, most: int, limits: dict, steps: int | None) -> tuple[list[tuple[int, dict[int, int]]] | None, int]:
    """Patterns for all of counts in fewer than `most` bins, or None; and the steps taken.

    Depth first: the largest length left with each of its undominated fillings, repeated as often as the counts allow
    (once, in an exact search); a branch ends once its waste can no longer lead to fewer bins.
    """
    total, spent = sum(k * n for k, n in counts.items()), 0
    stack = [(counts, [], 0, 0)]
    while stack and (steps is None or spent < steps):
        counts, made, bins, waste = stack.pop()
        if not counts:
            return made, spent
        if waste > (most - 1) * capacity - total or bins + lower_volume(counts, capacity) >= most:
            continue
        largest = max(counts)
        rest = {k: n for k, n in counts.items() if k != largest or n > 1}
        if largest in rest:
            rest[largest] -= 1
        found, own = fillings(capacity - largest, sorted(rest), rest, **limits)
        spent += own + len(rest) // 4
        for lost, held in reversed(found):
            whole = held | {largest: held.get(largest, 0) + 1}
            times = 1 if limits["best"] is None else min(counts[k] // n for k, n in whole.items())
            left = {k: m for k, n in counts.items() if (m := n - times * whole.get(k, 0))}
            stack.append((left, [*made, (times, whole)], bins + times, waste + lost * times))
    return None, spent


def lower_volume(counts: dict[int, int], capacity: int) -> int:
    return -(-sum(k * n for k, n in counts.items()) // capacity)


def bin_completion(histogram: dict[int, int], capacity: int, best: int | None = FILLINGS, filling_steps: int | None = FILLING_STEPS, steps: int | None = SEARCH_STEPS) -> list[tuple[int, dict[int, int]]]:
    """Patterns (repeats, {length: times}) that use the whole histogram, in as few bins as the search finds.

    The incumbent is the best-fit solution. Until it meets the lower bound, a part of it is packed anew by bin
    completion: the bins with most waste, so that one bin less is possible, and bins of many small items, which are
    easy to fill. A part that is saved a bin is saved it as often as its bins repeat. A part that is not doubles, up to
    the whole. With best, filling_steps and steps None the search is exact.
    """
    counts = {k: n for k, n in histogram.items() if n}
    bound, incumbent, part = lower_bound(counts, capacity), best_fit(counts, capacity), PART
    bins = sum(n for n, _ in incumbent)
    limits = {"best": best, "steps": filling_steps}
    while bins > bound and (steps is None or steps > 0):
        waste = [capacity - sum(k * n for k, n in held.items()) for _, held in incumbent]
        take, lost, size = [0] * len(incumbent), 0, 0
        # bins whose kind wastes most in all; the more often they repeat, the more often a gain does
        for i in sorted(range(len(incumbent)), key=lambda i: (-waste[i] * incumbent[i][0], -waste[i])):
            if waste[i] and lost < capacity:
                take[i] = min(incumbent[i][0], -(-(capacity - lost) // waste[i]))
                lost, size = lost + take[i] * waste[i], size + take[i]
        often = min((n // t for t, (n, _) in zip(take, incumbent, strict=True) if t), default=1)
        for i in sorted(range(len(incumbent)), key=lambda i: (-min(often, incumbent[i][0]), -sum(incumbent[i][1].values()))):
            if size < part and not take[i]:
                take[i] = 1
                size += 1
        whole = size == bins or size < part
        if whole:
            take, size = [n for n, _ in incumbent], bins
        own = defaultdict(int)
        for n, (_, held) in zip(take, incumbent, strict=True):
            for k, m in held.items():
                own[k] += n * m
        # a part gets a share of the steps, the whole what is left of them
        found, spent = complete({k: n for k, n in own.items() if n}, capacity, size, limits, None if steps is None else steps if whole else steps // 8 + 1)
        steps = None if steps is None else steps - spent
        if found:
            again = min(n // t for t, (n, _) in zip(take, incumbent, strict=True) if t)
            incumbent = [(n - t * again, held) for t, (n, held) in zip(take, incumbent, strict=True) if n > t * again] + [(n * again, held) for n, held in found]
            bins = sum(n for n, _ in incumbent)
        elif whole:
            break
        else:
            part *= 2
    return incumbent


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Of each length, rows (first number, first sequence, offset): number r has sequence first + r - number, at offset."""
    out, taken, base = defaultdict(list), defaultdict(int), 0
    for times, held in patterns:
        at = 0
        for size in sorted(held, reverse=True):
            for _ in range(held[size]):
                out[size].append((taken[size], base, at))
                taken[size] += times
                at += size
        base += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with sequence_id and offset, gapless in each sequence; sequences and bound (how many are used, and
    how many any packing needs at least) are the same in each row.

    Every row of docs is packed, repeated ones and null doc_ids too; null and empty texts are the end id alone. No
    documents: no rows. Pieces of equal length are interchangeable, so a length that most rows share is no hot key:
    tasks number their own pieces and only counts per task and length are brought together.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    per_task = materialize(cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns, bound = bin_completion(histogram, capacity), lower_bound(histogram, capacity)
    used, table = sum(n for n, _ in patterns), spark.sparkContext.broadcast(places(patterns))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # one row per length and task: slim, but it grows with the tasks, so it is never broadcast
    starts = per_task.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before")).hint("merge")
    numbered = cut.join(starts, ["length", "bucket"])
    rows = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_no")).alias("number"))

    def tasks(batches):
        for b in batches:
            size, number = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
                t = table.value[int(size[own[0]])]
                k = np.searchsorted(t[:, 0], number[own], side="right") - 1
                sequence[own], offset[own] = t[k, 1] + number[own] - t[k, 0], t[k, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset), *(pa.array(np.full(len(size), x, np.int64)) for x in (used, bound))], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "sequences", "bound"])

    return map_batches(rows, tasks, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, sequences long, bound long")
