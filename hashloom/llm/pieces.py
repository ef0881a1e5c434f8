"""Whole-text token ids from the tokenizers library, at the cost of one library call per distinct pre-token.

The vocabularies used here split a text by a pattern before any merge, so a text's ids are those of its pre-tokens
in order. Texts of ASCII and Latin letters (up to U+024F) are cut here, a chunk of bytes at once, at places that no
pre-token spans; of the distinct parts, those that are not known are split by the pattern, and the library encodes each
distinct pre-token once. Any other text goes through the library whole, and so does a text that holds one of the file's
added tokens, and every text of a file that folds or splits by other rules.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import filterfalse

import numpy as np
import pyarrow as pa

#: What the two patterns below know: white space, ASCII, Latin-1 and Latin Extended-A and -B.
ODD = re.compile("[^\x09-\x0d\x20-\x7e\xa0-ɏ]")
#: The letters, numbers and spaces of that range.
LETTER, NUMBER, SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\x09-\x0d\x20\xa0"
#: How the two kinds of vocabulary files fold and split a text, as their own normalizer and pre-tokenizer say it.
BYTE_RULES = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
WORD_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: The pre-tokens of these two rules, in the range of ODD. Letters stand first, being the most: no contraction begins with one.
PATTERNS = {
    "byte": re.compile(f" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"),
}

#: Kinds of characters, and after which a part ends before which: never behind white space, and letters stay with a quote before them, as they may be a contraction.
SPACES, LETTERS, NUMBERS, QUOTES, OTHERS = range(5)
ENDS = {LETTERS: (SPACES, NUMBERS, QUOTES, OTHERS), NUMBERS: (SPACES, LETTERS, QUOTES, OTHERS), QUOTES: (SPACES, NUMBERS), OTHERS: (SPACES, LETTERS, NUMBERS)}


def _kind(char: str) -> int:
    return next((k for k, own in ((SPACES, SPACE), (LETTERS, LETTER), (NUMBERS, NUMBER), (QUOTES, "'")) if re.match(f"[{own}]", char)), OTHERS)


#: Of each byte its kind; of each pair of bytes from 0xC2 0x80 on, in that order, their character's; of eight times a kind and the next, whether a part ends between.
ONE_BYTE = bytes(_kind(chr(b)) if b < 128 else OTHERS for b in range(256))
TWO_BYTES = np.array([_kind(chr(c)) for c in range(0x80, 0x250)] + [OTHERS] * 0x30, np.uint8)
PART_ENDS = bytes(k % 8 in ENDS.get(k // 8, ()) for k in range(256))


def parts_of(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """Texts of the range of ODD in UTF-8, in parts such that no pre-token spans two; and of each text, how many parts come before it (at last, all)."""
    data, ends = b"".join(texts), np.cumsum([0, *map(len, texts)])
    if not data:
        return pa.array([], pa.binary()), np.zeros(len(ends), np.int64)
    raw, kind = np.frombuffer(data, np.uint8), np.frombuffer(bytearray(data.translate(ONE_BYTE)), np.uint8)
    lead = np.flatnonzero(raw >= 0xC2)
    kind[lead] = kind[lead + 1] = TWO_BYTES[(raw[lead] - np.uint8(0xC2)).astype(np.int64) * 64 + (raw[lead + 1] & 63)]
    begins = np.ones(len(raw) + 1, bool)
    begins[1:-1] = np.frombuffer((kind[:-1] * np.uint8(8) + kind[1:]).tobytes().translate(PART_ENDS), bool)
    begins[ends] = True
    at = np.flatnonzero(begins).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]), np.searchsorted(at, ends)


def gathered(which: np.ndarray, values: list[bytes], bounds: np.ndarray) -> list[bytes]:
    """Packed ids of each text from those of the distinct parts: which says which each part is, bounds how many parts come before each text."""
    sizes = np.array(list(map(len, values)), np.int64) // 4
    own = sizes[which]
    ends = np.concatenate([[0], np.cumsum(own)])
    ids = np.frombuffer(b"".join(values), "<u4")[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], own) + np.arange(ends[-1])]
    at, data = (4 * ends[bounds]).tolist(), ids.tobytes()
    return [data[i:j] for i, j in zip(at, at[1:], strict=False)]


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in prints)
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


_ENCODERS: dict = {}


def worker_encoder(path: str, kind=None):
    """The worker process's encoder for a file: what it has learnt of one task's words serves the next task."""
    kind = kind or PieceEncoder
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


class Recent(dict):
    """A dict of so many entries and bytes at most: when full it sets its entries aside, and drops those not asked for by the next time. Long keys are never kept."""

    def __init__(self, entries: int, most_bytes: int = 32 << 20, longest: int = 256):
        super().__init__()
        self.entries, self.most_bytes, self.longest, self.bytes, self.aside = entries, most_bytes, longest, 0, {}

    def missing(self, keys) -> list:
        """The keys that are not known; afterwards those set aside are at hand again."""
        if len(self) >= self.entries or self.bytes >= self.most_bytes:
            self.aside = dict(self)
            self.clear()
            self.bytes = 0
        new = set(filterfalse(self.__contains__, keys))  # a difference of sets would go over all that is known
        if self.aside:
            again = [k for k in new if k in self.aside]
            self.update((k, self.aside[k]) for k in again)
            self.bytes += sum(map(len, again))
            new.difference_update(again)
        return list(new)

    def learn(self, keys: list, values):
        """Keeps the values of missing() keys; returns what looks any of them up, and all that are known."""
        values = list(values)
        if max(map(len, keys), default=0) <= self.longest:
            self.update(zip(keys, values, strict=True))
            self.bytes += sum(map(len, keys)) + sum(map(len, values))
            return self.__getitem__
        long = {k: v for k, v in zip(keys, values, strict=True) if len(k) > self.longest}
        short = [(k, v) for k, v in zip(keys, values, strict=True) if len(k) <= self.longest]
        self.update(short)
        self.bytes += sum(len(k) + len(v) for k, v in short)
        return lambda k: long[k] if k in long else self[k]

    def values_of(self, keys: list, make) -> list:
        """The value of each key; make gives those of a list of keys that are not known. Known keys are looked up once."""
        found = list(map(self.get, keys))
        if lost := [i for i, v in enumerate(found) if v is None]:
            new = self.missing(keys[i] for i in lost)
            get = self.learn(new, make(new))
            for i in lost:
                found[i] = get(keys[i])
        return found


class PieceEncoder:
    """Encodes lists of texts to ids packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, entries: int = 400_000, chunk_bytes: int = 4 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        kind = {"byte": BYTE_RULES, "word": WORD_RULES}
        rules = (spec["normalizer"], spec["pre_tokenizer"])
        kind = next((k for k, known in kind.items() if known == rules and spec["model"]["type"] == "BPE"), None)
        # added tokens that are looked for in a text as it is can be looked for here too; with others, every text goes whole
        plain = not any(t[x] for t in spec["added_tokens"] for x in ("normalized", "single_word"))
        self.pattern, self.lower = PATTERNS.get(kind) if plain else None, kind == "word"
        self.added = [t["content"] for t in spec["added_tokens"]]
        # of pre-tokens in parts of several, and of parts
        self.chunk_bytes, self.pieces, self.known = chunk_bytes, Recent(entries // 8, 4 << 20), Recent(entries)
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet() | {0: "\0"}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Pre-tokens' ids from the library's merges alone: they are split and folded already. They are respelt in one go, and none holds a byte 0."""
        spelt = "\0".join(words).encode().decode("latin-1").translate(self.alphabet).split("\0") if words else []
        return [array("I", [t.id for t in own]).tobytes() for own in map(self.model.tokenize, spelt)]

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        split = [self.pattern.findall(p.decode()) for p in parts]
        # a part is mostly one pre-token, and is met here once
        alone = iter(self._words([s[0] for s in split if len(s) == 1]))
        several = list({x for s in split if len(s) > 1 for x in s})
        ids = dict(zip(several, self.pieces.values_of(several, self._words), strict=True))
        return [next(alone) if len(s) == 1 else b"".join(map(ids.__getitem__, s)) for s in split]

    def _chunk(self, texts: list[str]) -> list[bytes]:
        plain = [t.lower() if self.lower else t for t in texts]
        # what a text is folded to may be out of the range, too
        usual = [self.pattern is not None and not ODD.search(p) and not any(a in t for a in self.added) for t, p in zip(texts, plain, strict=True)]
        parts, bounds = parts_of([p.encode() if ok else b"" for p, ok in zip(plain, usual, strict=True)])
        parts = parts.dictionary_encode()
        values = self.known.values_of(parts.dictionary.to_pylist(), self._parts)
        ids = gathered(parts.indices.to_numpy(), values, bounds)
        return [i if ok else self._whole([t])[0] for t, i, ok in zip(texts, ids, usual, strict=True)]

    def encode(self, texts):
        """Packed ids of each text, in order; texts are taken some megabytes at a time."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= self.chunk_bytes:
                yield from self._chunk(held)
                held, size = [], 0
        yield from self._chunk(held)
