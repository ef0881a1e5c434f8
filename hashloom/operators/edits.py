"""Edit scripts between a chunk and a pattern: insertions and deletions only, in runs."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: The first byte of a run; then its length (255 at most) and, for an insertion, the bytes.
KEEP, INSERT, DELETE = 0, 1, 2


def tables(patterns: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Longest common subsequences of the suffixes of each row's pattern and chunk; all rows go cell by cell together."""
    n, p = patterns.shape
    c = chunks.shape[1]
    t = np.zeros((p + 1, c + 1, n), np.int16)
    for i in range(p - 1, -1, -1):
        for j in range(c - 1, -1, -1):
            t[i, j] = np.where(patterns[:, i] == chunks[:, j], t[i + 1, j + 1] + 1, np.maximum(t[i + 1, j], t[i, j + 1]))
    return t.transpose(2, 0, 1)


def script(pattern: bytes, chunk: bytes, table: np.ndarray) -> bytes:
    out, i, j, run, held = bytearray(), 0, 0, [None, 0], bytearray()

    def put(op, byte=None):
        if run[0] != op or run[1] == 255:
            close()
            run[0], run[1] = op, 0
        run[1] += 1
        if byte is not None:
            held.append(byte)

    def close():
        if run[1]:
            out.extend((run[0], run[1]))
            out.extend(held)
        held.clear()
        run[1] = 0

    while i < len(pattern) or j < len(chunk):
        if i < len(pattern) and j < len(chunk) and pattern[i] == chunk[j]:
            put(KEEP)
            i, j = i + 1, j + 1
        elif j == len(chunk) or i < len(pattern) and table[i + 1][j] >= table[i][j + 1]:
            put(DELETE)
            i += 1
        else:
            put(INSERT, chunk[j])
            j += 1
    close()
    return bytes(out)


def apply_script(pattern: bytes, delta: bytes) -> bytes:
    out, at, i = bytearray(), 0, 0
    while i < len(delta):
        op, n = delta[i], delta[i + 1]
        i += 2
        if op == INSERT:
            out += delta[i : i + n]
            i += n
        else:
            out += pattern[at : at + n] if op == KEEP else b""
            at += n
    return bytes(out)


def lengths(patterns: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """For 64 bytes of a chunk at most: by number of last pattern bytes and row, a word whose clear bits among the lowest k are the longest common subsequence with the chunk's last k bytes."""
    n, p = patterns.shape
    behind = np.zeros((n, 64), np.uint8)
    out = np.full((p + 1, n), ~np.uint64(0))
    c = chunks.shape[1]
    for k in range(p):
        behind[:, :c] = chunks[:, ::-1] == patterns[:, p - 1 - k, None]
        same = out[k] & np.packbits(behind, axis=1, bitorder="little").view(np.uint64)[:, 0]
        out[k + 1] = (out[k] + same) | (out[k] - same)
    return out


def scripts(patterns: np.ndarray, chunks: np.ndarray) -> list[bytes]:
    """script() of many pairs of one length each, 64 bytes of a chunk and 255 of both at most; all rows go step by step together."""
    (n, p), c = patterns.shape, chunks.shape[1]
    found, low = lengths(patterns, chunks), np.array([(1 << k) - 1 for k in range(65)], np.uint64)
    row, i, j = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    pattern, chunk = np.pad(patterns, ((0, 0), (0, 1))), np.pad(chunks, ((0, 0), (0, 1)))
    ops, inserted = np.full((n, p + c), 255, np.uint8), np.zeros((n, p + c), np.uint8)
    for step in range(p + c):
        more_p, more_c = i < p, j < c
        byte = chunk[row, j]
        keep = more_p & more_c & (pattern[row, i] == byte)
        without_p = np.bitwise_count(~found[np.maximum(p - i - 1, 0), row] & low[c - j])
        without_c = np.bitwise_count(~found[p - i, row] & low[np.maximum(c - j - 1, 0)])
        drop = ~keep & more_p & (~more_c | (without_p >= without_c))
        put = ~keep & ~drop & more_c
        if not (keep | drop | put).any():
            break
        ops[keep, step], ops[drop, step], ops[put, step] = KEEP, DELETE, INSERT
        inserted[:, step] = byte
        i += keep | drop
        j += keep | put
    live = ops != 255
    begins = live.copy()
    begins[:, 1:] &= ops[:, 1:] != ops[:, :-1]
    # two bytes where a run begins, and each byte that is put in
    size = 2 * begins + (ops == INSERT)
    upto = np.cumsum(size.ravel()).reshape(size.shape) if size.size else size
    out = np.zeros(int(size.sum()), np.uint8)
    heads = (upto - size)[begins]
    at = np.flatnonzero(begins[live])
    out[heads], out[heads + 1] = ops[begins], np.diff(np.r_[at, int(live.sum())])
    out[upto[ops == INSERT] - 1] = inserted[ops == INSERT]
    data, ends = out.tobytes(), upto[:, -1].tolist() if p + c else [0] * n
    return [data[a:b] for a, b in pairwise([0, *ends])]


def apply_all(patterns: list[bytes], deltas: list[bytes]) -> list[bytes]:
    """apply_script() of many short pairs; all rows go run by run together."""
    n, p, d = len(patterns), max(map(len, patterns), default=0), max(map(len, deltas), default=0)
    both = np.frombuffer(b"".join(x.ljust(p, b"\0") + y.ljust(d + 2, b"\0") for x, y in zip(patterns, deltas, strict=True)), np.uint8).reshape(n, p + d + 2)
    row, at, i, size = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.array([len(x) for x in deltas], np.int64)
    starts, counts = [np.zeros(n, np.int64)], [np.zeros(n, np.int64)]
    while (live := i < size).any():
        here = np.where(live, i, d)
        op, k = both[row, p + here], np.where(live, both[row, p + here + 1], 0).astype(np.int64)
        put = live & (op == INSERT)
        starts.append(np.where(put, p + i + 2, at))
        counts.append(np.where(live & (op == DELETE), 0, k))
        at += np.where(put, 0, k)
        i += np.where(live, 2 + np.where(put, k, 0), 0)
    counts = np.stack(counts, axis=1)
    flat, first = counts.ravel(), (np.stack(starts, axis=1) + row[:, None] * (p + d + 2)).ravel()
    data = both.ravel()[np.repeat(first - np.cumsum(flat) + flat, flat) + np.arange(flat.sum())].tobytes()
    ends = np.cumsum(counts.sum(axis=1)).tolist()
    return [data[a:b] for a, b in pairwise([0, *ends])]


def diff_all(patterns: list[bytes], chunks: list[bytes], rows: int = 1024) -> list[bytes]:
    """Scripts of many pairs; pairs of equal lengths go together, `rows` pairs at a time."""
    out: list[bytes] = [b""] * len(patterns)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (p, c) in enumerate(zip(patterns, chunks, strict=True)):
        alike.setdefault((len(p), len(c)), []).append(k)
    for (p, c), members in alike.items():
        for at in range(0, len(members), rows):
            part = members[at : at + rows]
            both = [np.frombuffer(b"".join(x[k] for k in part), np.uint8).reshape(len(part), n) for x, n in ((patterns, p), (chunks, c))]
            if c <= 64 and p + c <= 255:
                made = scripts(*both)
            else:
                made = [script(patterns[k], chunks[k], t.tolist()) for k, t in zip(part, tables(*both), strict=True)]
            for k, x in zip(part, made, strict=True):
                out[k] = x
    return out


@F.pandas_udf(BinaryType())
def _diff(pattern: pd.Series, chunk: pd.Series) -> pd.Series:
    return pd.Series(diff_all([x or b"" for x in pattern], [x or b"" for x in chunk]))


@F.pandas_udf(BinaryType())
def _patch(pattern: pd.Series, delta: pd.Series) -> pd.Series:
    out, rows = [], [(bytes(p or b""), bytes(d or b"")) for p, d in zip(pattern, delta, strict=True)]
    for at in range(0, len(rows), 1024):
        part = rows[at : at + 1024]
        short = all(len(p) <= 1024 and len(d) <= 1024 for p, d in part)
        out += apply_all(*map(list, zip(*part, strict=True))) if short else [apply_script(*x) for x in part]
    return pd.Series(out, dtype=object)


def diff(pattern: Column, chunk: Column) -> Column:
    """Shortest script of insertions and deletions that makes chunk of pattern; both are short (a chunk's size). Null: empty."""
    return _diff(pattern, chunk)


def patch(pattern: Column, delta: Column) -> Column:
    return _patch(pattern, delta)
