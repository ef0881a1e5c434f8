"""Conversations as keyed state in small pieces: a semantic cache whose context decays with each turn.

What a conversation has stored lies in a map of blocks of bounded size: a batch reads blocks one after another and
writes the last ones alone, so neither a batch nor a worker ever holds a whole conversation. State may expire (TTL), and
a timer ends a conversation that has been idle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_MASK = (1 << 64) - 1
OUT = "conv_id long, turn long, action string, match_turn long, distance long"

#: Hashes of a block of state, and turns that meet a block at once.
BLOCK, STRIP = 4096, 512


def mask(key: str, sixteenths: int) -> int:
    """What functions.bits.bernoulli_mask gives for a key: bit i is set where hex digit i of two MD5s is below `sixteenths`."""
    digits = hashlib.md5(f"{key}:a".encode()).hexdigest() + hashlib.md5(f"{key}:b".encode()).hexdigest()
    return sum(1 << i for i, c in enumerate(digits) if int(c, 16) < sixteenths)


def mixed(before: int | None, raw: int, key: str, sixteenths: int) -> int:
    """A turn's hash under the context of the turn before it, some of whose bits are lost; without a context as it is."""
    context = (before or 0) & ~mask(key, sixteenths) & _MASK
    return raw if context == 0 else context & 0xFFFFFFFF00000000 | raw & 0xFFFFFFFF


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class DecayedCache(StatefulProcessor):
    """Each turn reuses the first stored hash of its conversation within `limit` (`hit`), or stores its own (`insert`)."""

    def __init__(self, limit: int = 20, sixteenths: int = 2, block: int = BLOCK, ttl_ms: int | None = None, idle_ms: int | None = None):
        self.limit, self.sixteenths, self.block, self.ttl_ms, self.idle_ms = limit, sixteenths, block, ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "turn long, hash long, stored long", self.ttl_ms)
        self.blocks = handle.getMapState("blocks", "block long", "hashes array<long>, turns array<long>", self.ttl_ms)

    def _first_in_blocks(self, hashes: np.ndarray, n: int) -> dict[int, tuple[int, int]]:
        """Of each hash, by its place, the turn and distance of the first stored hash within the limit."""
        found: dict[int, tuple[int, int]] = {}
        left = np.arange(len(hashes))
        for b in range(-(-n // self.block)):
            if not len(left):
                break
            kept = self.blocks.getValue((b,)) if self.blocks.containsKey((b,)) else None
            if kept is None:  # expired
                continue
            own = np.array(kept[0], np.int64).view(np.uint64)
            for i in range(0, len(left), STRIP):
                some = left[i : i + STRIP]
                d = np.bitwise_count(hashes[some, None] ^ own[None])
                near = d <= self.limit
                for k in np.flatnonzero(near.any(axis=1)).tolist():
                    at = int(near[k].argmax())
                    found[int(some[k])] = (int(kept[1][at]), int(d[k, at]))
            left = np.array([i for i in left.tolist() if i not in found], np.int64)
        return found

    def _store(self, fresh: list[tuple[int, int]], n: int) -> None:
        """Appends (hash, turn) behind the n that are stored: the last block is written again, others are new."""
        while fresh:
            b, held = n // self.block, n % self.block
            kept = self.blocks.getValue((b,)) if held and self.blocks.containsKey((b,)) else None
            hashes, turns = (list(kept[0]), list(kept[1])) if kept else ([], [])
            part, fresh = fresh[: self.block - held], fresh[self.block - held :]
            self.blocks.updateValue((b,), (hashes + [_signed(h) for h, _ in part], turns + [t for _, t in part]))
            n += len(part)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows)).sort_values("turn")
        last = self.last.get() if self.last.exists() else None
        at, before, n = (last[0], last[1] & _MASK, last[2]) if last else (None, None, 0)
        own = []
        for turn, raw in zip(turns["turn"].tolist(), turns["hash"].tolist(), strict=True):
            raw &= _MASK
            own.append(mixed(before if at == turn - 1 else None, raw, f"{key[0]}:{turn}", self.sixteenths))
            at, before = turn, raw
        hashes = np.array(own, np.uint64)
        found, fresh, out = self._first_in_blocks(hashes, n), [], []
        new = np.zeros(len(own), np.uint64)
        for i, turn in enumerate(turns["turn"].tolist()):
            hit = found.get(i)
            if hit is None and fresh:
                d = np.bitwise_count(new[: len(fresh)] ^ hashes[i])
                near = np.flatnonzero(d <= self.limit)
                hit = (fresh[near[0]][1], int(d[near[0]])) if len(near) else None
            if hit is None:
                new[len(fresh)] = hashes[i]
                fresh.append((own[i], turn))
            out.append((key[0], turn, "insert" if hit is None else "hit", *(hit or (None, None))))
        self._store(fresh, n)
        self.last.update((at, _signed(before), n + len(fresh)))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.blocks.clear()
        yield _frame([(key[0], None, "ended", None, None)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["conv_id", "turn", "action", "match_turn", "distance"])
    return f.astype({"turn": "Int64", "match_turn": "Int64", "distance": "Int64"})


def decayed_cache(turns: DataFrame, limit: int = 20, sixteenths: int = 2, block: int = BLOCK, ttl_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Stream or table of (conv_id, turn, hash) -> conv_id, turn, action, match_turn, distance.

    The session's state store must be the one on disk (spark.sql.streaming.stateStore.providerClass of RocksDB). Rows of
    one conversation are taken in the order of turns within a batch; a turn that comes later than its successors is taken
    as it comes, without a context. ttl_ms: state that is not written for so long is forgotten. idle_ms: a conversation
    without turns for so long is ended (`ended`, turn null) and its state cleared.
    """
    mode = "None" if ttl_ms is None and idle_ms is None else "ProcessingTime"
    return turns.select("conv_id", "turn", "hash").groupBy("conv_id").transformWithStateInPandas(DecayedCache(limit, sixteenths, block, ttl_ms, idle_ms), OUT, "Append", mode)
