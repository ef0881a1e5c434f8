"""Phrases mined from compressed position bitmaps.

A shard is about a million words of one language's texts, word after word, with a gap between pieces. Each word has a
bitmap of its positions, kept as its non-zero blocks of 64. The bitmap of a phrase, shifted by one, is ANDed with the
bitmap of a word that may follow; what remains is the longer phrase's bitmap and its popcount is the phrase's count in
the shard. A shift into a gap meets no word, so no phrase leaves its piece. Phrases are extended depth-first, a slice of
first words at a time. Popcounts of all shards are summed: first those of phrases' 64-bit hashes, which tell what surely
is too rare, then those of the phrases that are left.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILTER_BITS, map_batches, materialize

#: Words of a shard about, bytes of a long text that are cut into words at once, and blocks of bitmaps that are extended at once.
SHARD_WORDS, CUT_BYTES, SLICE_BLOCKS = 1 << 20, 1 << 20, 1 << 17

#: 64-bit words of the filter of phrases that may be frequent at most (32 MiB): with more members it lets more phrases pass.
FILTER_WORDS = 1 << 22

#: Sub-tables of the last step's ranking: rows that one table alone would bring to one task.
SALTS = 256

#: A-Z to lower case, the marks between pieces (and line ends) to '.', the tab to a space: what is left of a text are words, '.' and spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz.........\x20")
_NEXT, _GAP = re.compile(rb"[^ .]+|\."), re.compile(rb"[ .]")


def cuts(data: bytes, most: int, after: int):
    """(tokens, starts) of folded text, about `most` bytes at a time: the tokens behind `starts` are the next ones, which only end phrases that start before."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + most)
        end = gap.start() if gap else len(data)
        tokens = data[at:end].replace(b".", b" . ").split()
        starts, more = len(tokens), end
        for _ in range(after):
            found = _NEXT.search(data, more)
            if not found:
                break
            tokens.append(found[0])
            more = found.end()
        yield tokens, starts
        at = end


class Shard:
    """Word ids by position; a gap follows each text and each cut."""

    def __init__(self):
        self.names: defaultdict = defaultdict()
        self.names.default_factory = self.names.__len__
        self.gap, self.ids, self.starts = self.names[b"."], [], []

    def add(self, tokens: list[bytes], starts: int) -> None:
        ids = np.full(len(tokens) + 1, self.gap, np.int32)
        ids[:-1] = np.fromiter(map(self.names.__getitem__, tokens), np.int32, len(tokens))
        self.ids.append(ids)
        self.starts.append(np.arange(len(ids)) < starts)

    @functools.cached_property
    def words(self) -> pa.Array:
        """By id; asked for when the shard is whole."""
        return pa.array(list(self.names), pa.binary())


class Bitmaps:
    """Bitmaps of a shard's words over its positions: blocks (owner, place, bits) with bits of 64 positions."""

    def __init__(self, shard: Shard):
        at, starts = np.concatenate(shard.ids), np.concatenate(shard.starts)
        self.words = list(shard.names)
        order = np.argsort(at, kind="stable")
        order = order[np.searchsorted(at[order], shard.gap, "right") :]  # the gap has the smallest id and no bitmap
        key = at[order].astype(np.int64) * (len(at) // 64 + 1) + (order >> 6)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        one = np.left_shift(np.uint64(1), (order & 63).astype(np.uint64))
        self.owner, self.place = at[order[first]], (order[first] >> 6).astype(np.int32)
        self.bits, self.first_bits = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(first):
            self.bits = np.bitwise_or.reduceat(one, first)
            self.first_bits = np.bitwise_or.reduceat(one * starts[order], first)  # where phrases may start
        # of each position, the block of its word that it lies in
        self.block = np.full(len(at) + 64, -1, np.int32)
        self.block[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(order))))

    def shift(self, owner, place, bits):
        """Bitmaps moved by one position; a bit that leaves its block enters the next one."""
        over = np.flatnonzero(bits >> np.uint64(63))
        bits = np.concatenate((bits << np.uint64(1), np.ones(len(over), np.uint64)))
        owner, place = np.concatenate((owner, owner[over])), np.concatenate((place, place[over] + 1))
        key = owner.astype(np.int64) << 32 | place
        order = np.argsort(key, kind="stable")
        order = order[bits[order] != 0]
        new = np.flatnonzero(np.diff(key[order], prepend=-1))
        return owner[order[new]], place[order[new]], np.bitwise_or.reduceat(bits[order], new) if len(new) else bits[:0]

    def extend(self, owner, place, bits):
        """(owner, word, place, bits): each owner's bitmap, shifted, ANDed with those of the words that stand where it has bits."""
        owner, place, left = self.shift(owner, place, bits)
        whole, rows, out = left.copy(), np.arange(len(left)), []
        while len(rows):
            low = left[rows] & (~left[rows] + np.uint64(1))
            position = place[rows].astype(np.int64) * 64 + np.bitwise_count(low - np.uint64(1))
            block = self.block[position]
            met = block >= 0
            both = np.where(met, whole[rows] & self.bits[block], low)
            out.append((owner[rows[met]], self.owner[block[met]], place[rows[met]], both[met]))
            left[rows] &= ~both
            rows = rows[left[rows] != 0]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (owner, owner, place, left)


def _numbered(columns, n_words: int):
    """Distinct rows of ids below n_words in order, and of each row its number there; columns: one array for each place."""
    number = first = None
    for ids in columns:
        keys = ids.astype(np.int64) if number is None else number * n_words + ids
        _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    return np.column_stack([c[first] for c in columns]), number


def mine(shard: Shard, longest: int, ask=None):
    """Yields (n, ids, counts) for phrases of n = 1 to longest words: rows of ids, and how often they occur in the shard.

    ask(ids): which phrases may be frequent. A phrase is made longer only if it may be, and by a word only if the new
    phrase without its first word may be, too.
    """
    maps = Bitmaps(shard)
    cut = np.append(np.unique(np.searchsorted(maps.owner, maps.owner[::SLICE_BLOCKS])), len(maps.owner))  # where a word's blocks begin
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        words, owner = np.unique(maps.owner[a:b], return_inverse=True)
        ids, place, bits = words[:, None], maps.place[a:b], maps.first_bits[a:b]
        for n in range(1, longest + 1):
            counts = np.bincount(owner, np.bitwise_count(bits), len(ids)).astype(np.int64)
            yield n, ids[counts > 0], counts[counts > 0]
            if n == longest:
                break
            if ask:
                kept = ask(ids)[owner]
                owner, place, bits = owner[kept], place[kept], bits[kept]
            before, word, place, bits = maps.extend(owner, place, bits)
            if ask and len(word):
                rest, back = _numbered([*ids[before][:, 1:].T, word], len(maps.words))
                kept = ask(rest)[back]
                before, word, place, bits = before[kept], word[kept], place[kept], bits[kept]
            if not len(word):
                break
            ids, owner = _numbered([*ids[before].T, word], len(maps.words))


def hashes(ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """64-bit hashes of phrases, rows of ids, from their words' hashes; they depend on words and their order alone."""
    h = own[ids[:, 0]].copy()
    for k in range(1, ids.shape[1]):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + own[ids[:, k]]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _filter(frequent: DataFrame) -> np.ndarray:
    """A filter of hashes (column h), two bits of a word for each."""
    n, words = frequent.count(), 64
    while words < FILTER_WORDS and words * 64 < n * FILTER_BITS:
        words *= 2
    h, one = F.col("h"), F.lit(1).cast("long")
    bit = lambda by: F.call_function("shiftleft", one, F.shiftrightunsigned(h, by).bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned(h, 12).bitwiseAND(F.lit(words - 1)).cast("int")
    made = frequent.select(word.alias("word"), bit(0).bitwiseOR(bit(6)).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = made.toArrow()  # FILTER_WORDS rows at most
    table = np.zeros(words, np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint64)


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)
    mask = (one << (h & low)) | (one << (h >> np.uint64(6) & low))
    return table[(h >> np.uint64(12) & np.uint64(len(table) - 1)).astype(np.int64)] & mask == mask


def _over_shards(docs: DataFrame, longest: int, table: np.ndarray | None, told, schema: str, shard_words: int) -> DataFrame:
    """What told(lang, shard, word hashes, n, ids, counts) yields for the phrases of all shards, up to `longest` words.

    table: a filter for phrases of less words, by hash; those of one word pass if there is none of them.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table) if table is not None else None
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text")).filter("text IS NOT NULL")

    def mined(lang: str, shard: Shard):
        seed, hash64 = xxhash.xxh64_intdigest(lang.encode(), 42), xxhash.xxh64_intdigest
        own = np.fromiter((hash64(w, seed) for w in shard.names), np.uint64, len(shard.names))
        ask = (lambda ids: passes(shared.value, hashes(ids, own))) if shared is not None else None
        for n, ids, counts in mine(shard, longest, ask):
            for i in range(0, len(counts), 50_000):
                yield from told(lang, shard, own, n, ids[i : i + 50_000], counts[i : i + 50_000])

    def tasks(batches):
        held: dict[str, Shard] = {}
        size = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for tokens, starts in cuts(text.as_buffer().to_pybytes().translate(FOLD), CUT_BYTES, longest - 1):
                    held.setdefault(lang, Shard()).add(tokens, starts)
                    size += len(tokens)
                    if size >= shard_words:
                        for x in held.items():
                            yield from mined(*x)
                        held, size = {}, 0
        for x in held.items():
            yield from mined(*x)

    return map_batches(rows, tasks, schema)


def may_be_frequent(docs: DataFrame, longest: int, least: int, table: np.ndarray | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(h): hashes that occur at least `least` times, of phrases of `longest` words (without a filter, of less words too)."""

    def told(lang, shard, own, n, ids, counts):
        if table_is_none or n == longest:
            yield pa.RecordBatch.from_arrays([pa.array(hashes(ids, own).view(np.int64)), pa.array(counts)], names=["h", "f"])

    table_is_none = table is None
    found = _over_shards(docs, longest, table, told, "h long, f long", shard_words)
    return found.groupBy("h").agg(F.sum("f").alias("f")).filter(F.col("f") >= least).select("h")


def counted(docs: DataFrame, longest: int, table: np.ndarray, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, words, phrase, f): phrases of 1 to `longest` words that pass the filter or whose parts do; and, as words = 0, each lang's number of words."""

    def told(lang, shard, own, n, ids, counts):
        if n == 1:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([int(counts.sum())])], names=names)
        if n < longest:
            kept = passes(table_of(), hashes(ids, own))
            ids, counts = ids[kept], counts[kept]
        part = [shard.words.take(pa.array(ids[:, k])) for k in range(n)]
        phrase = pc.binary_join_element_wise(*part, pa.scalar(b" ", pa.binary())) if n > 1 else part[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(np.full(len(counts), n, np.int32)), phrase.cast(pa.string()), pa.array(counts)], names=names)

    names = ["lang", "words", "phrase", "f"]
    shared = docs.sparkSession.sparkContext.broadcast(table)
    table_of = lambda: shared.value
    found = _over_shards(docs, longest, table, told, "lang string, words int, phrase string, f long", shard_words)
    return found.groupBy(*names[:3]).agg(F.sum("f").alias("f"))


def mine_phrases(docs: DataFrame, longest: int = 3, least: int = 10, top: int | None = 2000, covered: int = 50, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each lang's first `top` phrases (None: all) of 2 to `longest` words: lang, rank, phrase, words, a, l, r, n, score, cut.

    A-Z are lower-cased; pieces end at . , ; : ! ? and line ends, words at spaces and tabs. A phrase of a = f(phrase) >=
    least occurrences is cut after its first `cut` words, which occur l times, and the rest r times; score is
    floor(1000000 a a / (l r)) of the lowest-scoring cut (ties: the shortest first part). Phrases that lie in a longer one that
    occurs at least `covered` per cent as often are left out. n counts the lang's words. A null lang is `und`; null,
    empty and wordless texts add nothing; no candidates, no rows. Equal texts count as often as they occur. doc_id is not
    read. Counts are exact at every size: what the filter excludes surely is too rare.
    """
    table = None
    for n in range(2, max(longest, 3)):
        known = may_be_frequent(docs, n, least, table, shard_words)
        frequent = materialize(known, "frequent") if table is None else frequent.unionByName(materialize(known, "frequent"))
        table = _filter(frequent)
    first = materialize(counted(docs, longest, table, shard_words).filter((F.col("f") >= least) | (F.col("words") == 0)), "counts")
    n_words = first.filter("words = 0").select("lang", F.col("f").alias("n"))
    common = first.filter("words > 0")

    part = common.select("lang", "phrase", "f")
    several = common.filter("words > 1")
    pieces = F.split("phrase", " ")
    cuts = several.select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"), pieces.alias("w"))
    cuts = cuts.select("lang", "words", "phrase", "a", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("head"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("rest"))
    heads = part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    known = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    big = lambda c: F.col(c).cast("decimal(38,0)")
    scored = known.withColumn("score", F.expr("(CAST(1000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0))) div (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "words")).alias("x")).select("lang", "phrase", "x.*")

    inside = several.filter("words > 2").select("lang", F.col("f").alias("longer"), F.explode(F.expr(f"flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(split(phrase, ' '), i, k), ' '))))")).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * big("longer") < covered * big("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # the best of each of some sub-tables first: the last ranking has SALTS * top rows of a lang at most
        salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        kept = salted.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_at") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(n_words, "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score", "cut")
