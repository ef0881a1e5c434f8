"""Merges over bytes: learnt from whole texts in Spark, pairs' counts alone to the driver; texts in their ids, and read back."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import CUT, GAP, binary, column_of, learn, merged, rows_of, spaced

#: Bytes of texts that are cut into words at once about.
TEXTS = 1 << 24


@dataclass(frozen=True)
class Rules:
    """first: the first merge's id; longest: bytes of a merged token at most (None: any); least: how often a pair must occur; special: names of the ids from 0 on, in place of these bytes."""

    first: int = 256
    longest: int | None = None
    least: int = 1
    special: tuple[str, ...] = ()


#: Tokens for a codebook of 128-byte patterns, and those of a small language model.
CODEBOOK = Rules(longest=128, least=2)
MODEL = Rules(first=259, special=("[PAD]", "[MASK]", "[UNK]"))


def _codes(values: np.ndarray):
    """(place, left * 256 + right) of each two bytes that stand side by side, some at once."""
    for i in range(0, len(values) - 1, CUT):
        part = values[i : i + CUT + 1]
        yield i, part[:-1].astype(np.uint16) << 8 | part[1:]


def _byte_pairs(raw: DataFrame) -> np.ndarray:
    """How often each two bytes stand side by side in a text, at their number left * 256 + right."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for values, ends in rows_of(b.column(0)):
                for _, code in _codes(values):
                    total += np.bincount(code, minlength=len(total))
                inner = ends[(ends > 0) & (ends < len(values))]  # pairs between two texts; a text has a byte at least
                total -= np.bincount(values[inner - 1].astype(np.int64) << 8 | values[inner], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["code", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in raw.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r["code"]] = r["n"]
    return out


def _cut(values: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> pa.Array:
    """Texts cut into words between any two bytes whose pair is not inside."""
    last = np.zeros(len(values), bool)
    for i, code in _codes(values):
        last[i : i + len(code)] = ~inside[code]
    last[ends[ends > 0] - 1] = True
    return binary(np.r_[0, np.flatnonzero(last) + 1], values)


def _words(raw: DataFrame, inside: np.ndarray, done: list) -> DataFrame:
    """(ids, n): the distinct words of all texts, merged as far as done, and how often they occur."""

    def cut(batches):
        for b in batches:
            for values, ends in rows_of(b.column(0), TEXTS):
                each = pc.value_counts(_cut(values, ends, inside))
                yield pa.RecordBatch.from_arrays([each.field(0), each.field(1)], names=["data", "n"])

    def widened(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([column_of([merged(spaced(*x), done) for x in rows_of(b.column(0))]), b.column(1)], names=["ids", "n"])

    return raw.mapInArrow(cut, "data binary, n long").groupBy("data").agg(F.sum("n").alias("n")).mapInArrow(widened, "ids binary, n long")


def train(texts: DataFrame, text: str, merges: int, rules: Rules = CODEBOOK, every: int = 8) -> list[tuple[int, int, int, int]]:
    """(id, left, right, count) of each merge, the commonest pair first, ties by the smaller ids; fewer if no pair is left that the rules allow.

    Pairs do not reach from one text into the next; null and empty texts have none. Texts are cut into words between
    bytes that seldom stand side by side: symbols on either side of a cut are no commoner there than the two bytes. So
    the distinct words tell every merge that is commoner than the commonest cut; for others they are cut more rarely.
    """
    raw = texts.filter(F.length(text) > 0).select(F.encode(F.col(text), "UTF-8").alias("data"))
    beside = _byte_pairs(raw)
    size, out = {k: 1 for k in range(256)}, []

    def make(left: int, right: int) -> tuple[int, bool]:
        made = rules.first + len(size) - 256
        size[made] = size[left] + size[right]
        return made, True

    allowed = (lambda left, right: size[left] + size[right] <= rules.longest) if rules.longest else None
    cut = int(np.sort(beside)[::-1][min(merges, len(beside)) - 1]) // 2 if merges else 0
    while len(out) < merges:
        words = _words(raw, beside > cut, [(left, right, made) for made, left, right, _ in out])
        more, whole = learn(words, merges - len(out), int, int, make, allowed, rules.least, cut, every)
        out += [(rules.first + k, *x) for k, x in enumerate(more, len(out))]
        if whole:
            break
        cut //= 8
    return out


def encode(text: Column, merges: list[tuple[int, int, int, int]]) -> Column:
    """Ids of the whole text: all merges in the order they were learnt. Null and empty texts have none.

    No merge reaches over two bytes that no merge brings together: texts are cut there, and a word that repeats is merged once a batch.
    """
    names, new = table(merges), [(left, right, made) for made, left, right, _ in merges]
    inside = np.zeros(1 << 16, bool)
    for left, right, _ in new:
        inside[names[left][-1] << 8 | names[right][0]] = True

    @F.arrow_udf("array<int>")
    def ids(data: pa.Array) -> pa.Array:
        sizes, parts = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
        for values, ends in rows_of(data, TEXTS):
            words = _cut(values, ends, inside)
            upto = np.frombuffer(words.buffers()[1], np.int32)[1 : len(words) + 1]
            coded = words.dictionary_encode()
            flat = np.concatenate([np.zeros(0, np.int32), *(merged(spaced(*x), new) for x in rows_of(coded.dictionary))])
            stops = np.flatnonzero(flat == GAP)
            starts, at = np.r_[0, stops[:-1] + 1], coded.indices.to_numpy()
            n = (stops - starts)[at] if len(at) else np.zeros(0, np.int64)
            total = np.cumsum(n)
            if len(at):
                parts.append(flat[np.repeat(starts[at] - total + n, n) + np.arange(total[-1])])
            # ids up to the end of each text, from those of the words that lie before it
            sizes.append(np.diff(np.r_[0, np.r_[0, total][np.searchsorted(upto, ends, "right")]]))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(parts)))

    return ids(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def table(merges: list[tuple[int, int, int, int]], rules: Rules = CODEBOOK) -> dict[int, bytes]:
    """The bytes of each id; a special name takes the place of the byte of its number."""
    out = {k: bytes([k]) for k in range(256)} | {k: name.encode() for k, name in enumerate(rules.special)}
    for made, left, right, _ in merges:
        out[made] = out[left] + out[right]
    return out


def decode(ids: Column, names: dict[int, bytes]) -> Column:
    """The bytes of ids as text; what is no UTF-8 becomes a replacement character, an unknown id nothing, a null list nothing."""
    known = [names.get(i, b"") for i in range(max(names, default=-1) + 1)] + [b""]
    sizes = np.array([len(x) for x in known], np.int64)
    starts, joined = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), np.uint8)

    def read(at: np.ndarray) -> str:
        n = sizes[at]
        return joined[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes().decode(errors="replace")

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        out = []
        for x in lists:
            at = x.values.fill_null(-1).to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64)
            out.append(read(np.where((at < 0) | (at >= len(known)), len(known) - 1, at).astype(np.int64)))
        return pa.array(out, pa.string())

    return text(ids)
