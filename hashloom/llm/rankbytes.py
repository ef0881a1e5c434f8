"""Byte-level BPE with the tiktoken library and a local file of ranks.

A text is split by the vocabulary's pattern and each match is merged by rank. Long texts are cut first, at places where
the pattern ends a match whatever stands around them, so that no regular expression and no list of ids spans more than
a bounded part of a text. Decoding joins the tokens' raw bytes; they need not be whole characters token by token.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of

#: A text of more characters is cut at the next safe boundary after each so many.
PIECE_CHARS = 1 << 18

#: An ASCII letter or digit before a space, a line end or a mark: no match of the usual patterns goes on from the one to the other, and
#: none that ends here looks ahead at more than the next character's kind.
BOUNDARY = re.compile("[A-Za-z0-9](?=[ \n.,;:!?])")


@functools.lru_cache(4)
def encoding(rank_file: str, pattern: str):
    """The library's encoder for a file of lines `base64 rank`; the worker process keeps it."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text in parts, each cut at the first safe boundary after `most` characters (without one: in one part)."""
    at = 0
    while len(text) - at > most:
        cut = BOUNDARY.search(text, at + most - 1)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def encode_parts(text: str, encoder, most: int = PIECE_CHARS) -> Iterator[array]:
    """The text's ids as arrays of unsigned 32-bit integers, part by part."""
    for part in pieces(text, most):
        yield array("I", encoder.encode_ordinary(part))


def encode(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True, most: int = PIECE_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256 and decoded_bytes (of the ids' bytes), round_trip (they are the text's) and, if asked, ids.

    Null and empty texts have no ids; strings that look like special tokens are text; a null doc_id stays null and
    repeated rows repeat. Other columns of docs are left behind. Nothing is shuffled.
    """

    def tasks(batches):
        encoder = encoding(rank_file, pattern)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                n, size, ids, ids_sha, back, own = 0, 0, [], hashlib.sha256(), hashlib.sha256(), hashlib.sha256(text.encode())
                for part in encode_parts(text, encoder, most):
                    packed = np.frombuffer(part, np.uint32).astype("<u4")
                    ids_sha.update(packed.tobytes())
                    raw = encoder.decode_bytes(part)
                    back.update(raw)
                    n, size = n + len(part), size + len(raw)
                    if with_ids:
                        ids.append(packed.astype(np.int32))
                rows.append((n, ids_sha.hexdigest(), back.hexdigest(), size, back.digest() == own.digest(), *[np.concatenate(ids or [np.zeros(0, np.int32)])] * with_ids))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), *[pa.list_(pa.int32())] * with_ids]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_bytes", "round_trip", *["ids"] * with_ids]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_bytes long, round_trip boolean"
    return map_batches(texts_of(docs), tasks, schema + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, bytes (the tokens' raw bytes, whether they are whole UTF-8 or not). Null ids: null; ids out of the vocabulary stop the job."""

    def tasks(batches):
        encoder = encoding(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else encoder.decode_bytes(x) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return map_batches(encoded.select("doc_id", "ids"), tasks, "doc_id long, bytes binary")
