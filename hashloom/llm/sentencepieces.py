"""SentencePiece encoding and decoding with a forward pass shared by common prefixes.

A text becomes marked words (white-space marks in front), each encoded by itself: no piece has a mark behind another
character. With a merge vocabulary a word is also cut between two characters that stand side by side in no piece: no
merge can span them. The distinct words of a chunk are sorted, which makes their trie's depth-first order; the forward state of
a prefix is computed once and kept on a stack while words share it. In a unigram vocabulary the state is the best sum
of scores (Viterbi). In a merge vocabulary a prefix has exactly one last piece: the one that, with the last piece of
the prefix before it, merges back to just these two; the walk back along last pieces gives the merged result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of
from .pieces import Recent, gathered, worker_encoder

MARK = "▁"
#: Characters below NEAR are told apart where words are cut; NEAR is the mark's number there, FAR that of all others.
NEAR, FAR = 0x250, 0x251


class Merges:
    """Merges of a word by falling score, leftmost first: the definition that the shared pass must meet. A heap of pairs, so n log n steps."""

    def __init__(self, scores: dict[str, float]):
        falling = sorted(set(scores.values()), reverse=True)
        rank = {s: r for r, s in enumerate(falling)}
        self.ranks = {piece: rank[s] for piece, s in scores.items()}
        self.numbers: dict[str, int] = {}
        self.names: list[str] = []
        self.pairs: dict[int, tuple[int, int] | None] = {}  # of two pieces' numbers: the rank and number of what they merge to

    def _number(self, piece: str) -> int:
        n = self.numbers.get(piece)
        if n is None:
            n = self.numbers[piece] = len(self.names)
            self.names.append(piece)
        return n

    def _pair(self, key: int) -> tuple[int, int] | None:
        made = self.names[key >> 32] + self.names[key & 0xFFFFFFFF]
        rank = self.ranks.get(made)
        found = self.pairs[key] = None if rank is None else (rank, self._number(made))
        return found

    def parts(self, word: str) -> list[str]:
        pairs, n = self.pairs, len(word)
        if len(self.names) + len(pairs) > 1_000_000:  # characters beyond the vocabulary are numbered too
            pairs.clear(), self.numbers.clear(), self.names.clear()
        own = list(map(self._number, word))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            key = own[i] << 32 | own[j]
            pair = pairs[key] if key in pairs else self._pair(key)
            if pair:
                heap.append(pair[0] << 40 | i)

        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(heap)
        push, pop, heads = heapq.heappush, heapq.heappop, (1 << 40) - 1
        while heap:
            top = pop(heap)
            i = top & heads
            j = after[i]
            if own[i] < 0 or j >= n:
                continue  # one of the two has merged since
            pair = pairs.get(own[i] << 32 | own[j])
            if not pair or pair[0] != top >> 40:
                continue
            own[i], own[j], after[i] = pair[1], -1, after[j]
            j, k = after[i], before[i]
            if j < n:
                before[j] = i
                key = own[i] << 32 | own[j]
                if pair := pairs[key] if key in pairs else self._pair(key):
                    push(heap, pair[0] << 40 | i)
            if k >= 0:
                key = own[k] << 32 | own[i]
                if pair := pairs[key] if key in pairs else self._pair(key):
                    push(heap, pair[0] << 40 | k)
        return [self.names[x] for x in own if x >= 0]


class SharedPrefixes:
    """Segments sorted words; the forward state of the last word's prefixes stays for the next word."""

    def __init__(self, scores: dict[str, float], unigram: bool = False, entries: int = 500_000):
        self.scores, self.unigram, self.entries, self.merges = scores, unigram, entries, Merges(scores)
        self.longest = max(map(len, scores), default=1)
        self.fits: dict[tuple[str, str], bool] = {}
        self.fitted: dict[tuple[str, str], bool] = {}  # set aside when there were many
        self.starts = {""}.union(p[:k] for p in scores for k in range(1, len(p) + 1))
        self.ends: dict[str, tuple[str, list[tuple[int, str]]]] = {}
        self.floor = min(scores.values(), default=0.0) - 10.0

    def _follows(self, before: str, piece: str) -> bool:
        key = (before, piece)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.entries // 2:
                self.fits, self.fitted = {}, self.fits
            known = self.fitted.get(key)
            if known is None:
                known = self.merges.parts(before + piece) == ([before, piece] if before else [piece])
            self.fits[key] = known
        return known

    def _end(self, tail: str) -> tuple[str, list[tuple[int, str]]]:
        """Of a tail (what a prefix ends with that a piece begins with, and one more character): its own longest end that a piece
        begins with, and the pieces that end it, longest first, at last its last character. No other piece can end the prefix."""
        if len(self.ends) >= self.entries:
            self.ends.clear()
        node = tail
        while node not in self.starts:
            node = node[1:]
        n = len(tail)
        found = self.ends[tail] = node, [(n - j, tail[j:]) for j in range(n) if j == n - 1 or tail[j:] in self.scores]
        return found

    def segment(self, words: list[str]) -> list[list[str]]:
        """Pieces of each word; words ascending. A character that is no piece stands alone."""
        scores, longest, out, before, ends, follows = self.scores, self.longest, [], "", self.ends, self._follows
        last: list[str] = [""]
        tails, total, fits = [""], [0.0], self.fits
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], total[shared + 1 :], tails[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                if self.unigram:
                    best, pick = None, ""
                    for k in range(min(i, longest), 0, -1):
                        piece = word[i - k : i]
                        s = scores.get(piece, self.floor if k == 1 else None)
                        if s is not None and (best is None or total[i - k] + s > best):
                            best, pick = total[i - k] + s, piece
                    total.append(best)
                    last.append(pick)
                else:
                    tail = tails[-1] + word[i - 1]
                    node, pieces = ends.get(tail) or self._end(tail)
                    tails.append(node)
                    for k, piece in pieces:
                        fit = fits.get((last[i - k], piece))
                        if fit is None:
                            fit, fits = follows(last[i - k], piece), self.fits
                        if fit:
                            last.append(piece)
                            break
                    else:
                        raise ValueError(f"no piece ends {word[:i]!r}")
            before, pieces, i = word, [], len(word)
            while i:
                pieces.append(last[i])
                i -= len(last[i])
            out.append(pieces[::-1])
        return out


#: Fields of the model file's messages (the trainer's part and the kind of model in it; the normalizer's part, its table
#: and whether it drops white space) and the kinds there are.
TRAINER, KIND, KINDS = 2, 3, {1: "unigram", 2: "merges", 3: "words", 4: "characters"}
NORMALIZER, TABLE, DROPS = 3, 2, 4


def _fields(data: bytes):
    """(number, value) of each field of a serialized message: numbers as they are, parts as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = number() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


def model_kind(model: bytes) -> str:
    """unigram, merges, words or characters: what the file's trainer made (a file that does not say is unigram)."""
    trainer = next((v for k, v in _fields(model) if k == TRAINER), b"")
    return KINDS.get(next((v for k, v in _fields(trainer) if k == KIND), 1), "unknown")


def changes_text(model: bytes) -> bool:
    """Whether the file's normalizer has a table of characters, or drops white space (it does unless it says otherwise)."""
    rules = dict(_fields(next((v for k, v in _fields(model) if k == NORMALIZER), b"")))
    return bool(rules.get(TABLE)) or bool(rules.get(DROPS, 1))


class MarkedEncoder:
    """Whole texts to packed ids, and back, with a SentencePiece model file's vocabulary, of merges or unigram."""

    def __init__(self, model_file: str, entries: int = 300_000, chunk_chars: int = 4 << 20):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        kind = model_kind(sp.serialized_model_proto())
        if kind not in ("unigram", "merges"):
            raise ValueError(f"a vocabulary of {kind} is not read here")
        if changes_text(sp.serialized_model_proto()):
            raise ValueError("a vocabulary whose normalizer changes texts is not read here")
        every = range(sp.get_piece_size())
        kinds = {i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in every}
        self.ids = {sp.id_to_piece(i): i for i in every if not kinds[i]}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece has a mark behind another character")
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in every if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("a vocabulary without pieces for all bytes is not read here")
        self.trie = SharedPrefixes({p: sp.get_score(i) for p, i in self.ids.items()}, unigram=kind == "unigram")
        self.plain = [p.replace(MARK, " ").encode() for p in map(sp.id_to_piece, every)]
        for i in every:
            if sp.is_byte(i):
                self.plain[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)])
            elif kinds[i]:
                self.plain[i] = b""
        used = set("".join(self.ids))
        # of two characters side by side, whether a word may go on: those up to U+024F as they are, the mark, any other
        self.kind = np.full(ord(MARK) + 2, FAR, np.uint16)
        self.kind[:NEAR], self.kind[ord(MARK)] = range(NEAR), NEAR
        joined = np.ones((FAR + 1, FAR + 1), bool)
        if not self.trie.unigram:
            joined[:FAR, :FAR] = False
            for a, b in {x for p in self.ids for x in zip(p, p[1:], strict=False)}:
                joined[self._kind(a), self._kind(b)] = True
        joined[:NEAR, NEAR] = joined[FAR, NEAR] = False
        apart = [ord(c) for c in "\n\t" if c not in used]
        joined[apart], joined[:, apart] = False, False
        self.ends = ~joined.reshape(-1)
        self.chunk_chars, self.known = chunk_chars, Recent(entries)

    def _kind(self, char: str) -> int:
        return int(self.kind[min(ord(char), len(self.kind) - 1)])

    def _words(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """Words of all texts, and of each text, how many come before it (at last, all)."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        bounds, marked = np.cumsum([0, *map(len, marked)]), "".join(marked)
        if not marked:
            return pa.array([], pa.string()), np.zeros(len(bounds), np.int64)
        chars = np.frombuffer(marked.encode("utf-32-le"), "<u4")
        kind = self.kind[np.minimum(chars, len(self.kind) - 1)].astype(np.int32)
        begins = np.ones(len(chars) + 1, bool)
        begins[1:-1] = self.ends[kind[:-1] * (FAR + 1) + kind[1:]]
        begins[bounds] = True
        at = np.flatnonzero(begins)
        width = (chars >= 0x80).astype(np.uint8) + (chars >= 0x800) + (chars >= 0x10000) + np.uint8(1)
        places = np.concatenate([np.zeros(1, np.int32), np.cumsum(width, dtype=np.int32)])[at]
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(places), pa.py_buffer(marked.encode())), np.searchsorted(at, bounds)

    def _pack(self, pieces: list[str]) -> bytes:
        try:
            return array("I", [self.ids[p] for p in pieces]).tobytes()
        except KeyError:
            ids = []
        for p in pieces:
            own = self.ids.get(p)
            if own is None:
                ids.extend(self.bytes[b] for b in p.encode())
            else:
                ids.append(own)
        return array("I", ids).tobytes()

    def _new(self, words: list[str]) -> list[bytes]:
        # marks of equal score merge from the left, which a prefix alone cannot tell: few distinct words begin with two
        parts = {w: self.trie.merges.parts(w) for w in words if w.startswith(MARK * 2) and not self.trie.unigram}
        single = sorted(w for w in words if w not in parts)
        parts.update(zip(single, self.trie.segment(single), strict=True))
        return [self._pack(parts[w]) for w in words]

    def _chunk(self, texts: list[str]) -> list[bytes]:
        words, bounds = self._words(texts)
        words = words.dictionary_encode()
        return gathered(words.indices.to_numpy(), self.known.values_of(words.dictionary.to_pylist(), self._new), bounds)

    def encode(self, texts):
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= self.chunk_chars:
                yield from self._chunk(held)
                held, size = [], 0
        yield from self._chunk(held)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes that are no UTF-8 become replacement characters, and the mark in front goes."""
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model_file: str, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), round_trip (decoding
    gives the text again), decoded_bytes and, if asked, ids. Null and empty texts have no ids. A text that itself has
    the mark U+2581 comes back with a space in its place, so its round_trip is false. Nothing is shuffled: each task
    keeps the words it has met, up to a bound.
    """

    def tasks(batches):
        encoder = worker_encoder(model_file, MarkedEncoder)
        for b in batches:
            texts, rows = b.column(1).to_pylist(), []
            for text, data in zip(texts, encoder.encode(texts), strict=True):
                ids = np.frombuffer(data, "<u4")
                back = encoder.decode(ids.tolist())
                rows.append((len(ids), zlib.crc32(data), back == text, len(back.encode()), *[ids.astype(np.int32)] * with_ids))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
    names = ["doc_id", "n_tokens", "ids_crc32", "round_trip", "decoded_bytes", *["ids"] * with_ids]
    return map_batches(texts_of(docs), tasks, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, decoded_bytes long" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, text. Null ids: null."""

    def tasks(batches):
        encoder = worker_encoder(model_file, MarkedEncoder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else encoder.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), tasks, "doc_id long, text string")
