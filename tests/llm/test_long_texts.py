"""Very long texts and words, bounded caches, and rows of one doc_id over several files."""

import random
import time

import numpy as np
import public_tokenizers
import pytest

from hashloom.llm import pieces, sentencepieces, tokenio

from .data import documents

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
RNG = random.Random(12)
LONG = {
    "spaces": " " * 1_000_000 + "x",
    "two spaces and a word": "  " + "".join(RNG.choices("abcdefghij", k=300_000)),
    "word": "".join(RNG.choices("abcdefghijé", k=300_000)),
    "one letter": "a" * 200_000,
    "lines": "    indented  twice,\n\t\tand   more.\n" * 20_000,
}


def ids_of(data):
    return np.frombuffer(b"".join(data), "<u4").tolist()


@pytest.mark.parametrize("name", LONG)
def test_long_texts_against_sentencepiece(name):
    from sentencepiece import SentencePieceProcessor

    encoder = sentencepieces.MarkedEncoder(PIECE)
    began = time.time()
    ids = ids_of(encoder.encode([LONG[name]]))
    assert time.time() - began < 30  # some seconds where the machine is free
    assert ids == SentencePieceProcessor(model_file=PIECE).encode(LONG[name], num_threads=1)


def test_merges_against_rescanning():
    """The heap's merges are those of looking for the best pair again each time; equal scores merge leftmost first."""
    for seed in range(300):
        rng = random.Random(seed)
        scores = {"".join(rng.choices("abc", k=rng.randint(2, 5))): -float(rng.randint(1, 6)) for _ in range(14)}
        merges = sentencepieces.Merges(scores)
        for _ in range(10):
            word = "".join(rng.choices("abcd", k=rng.randint(0, 14)))
            parts = list(word)
            while True:
                best = max(((scores.get(parts[i] + parts[i + 1], -99.0), -i) for i in range(len(parts) - 1)), default=(-99.0, 0))
                if best[0] == -99.0:
                    break
                i = -best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert merges.parts(word) == parts


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("name", LONG)
def test_long_texts_against_the_library(path, name):
    from tokenizers import Tokenizer

    assert ids_of(pieces.PieceEncoder(path).encode([LONG[name]])) == Tokenizer.from_file(path).encode(LONG[name], add_special_tokens=False).ids


def test_text_of_twenty_megabytes(spark):
    text = "Some words, again and again; 123 of them. " * 500_000
    row = sentencepieces.encode(documents(spark, [(1, text)]), PIECE, with_ids=False).first()
    assert row.round_trip and row.decoded_bytes == len(text)
    one, two = (len(ids_of(pieces.PieceEncoder(BYTE).encode([text[: k * 42_000]]))) for k in (1, 2))
    assert tokenio.token_files(documents(spark, [(1, text)]), BYTE).first().n_tokens == one + 499 * (two - one) + 1


def test_known_words_are_bounded():
    known = pieces.Recent(1000, most_bytes=5000, longest=10)
    for i in range(200):
        words = [f"{i}:{k}" for k in range(20)] + ["x" * 50]
        new = known.missing(words)
        get = known.learn(new, [w.encode() for w in new])
        assert [get(w) for w in words] == [w.encode() for w in words]
        assert known.bytes < 5000 + 20 * 14 and "x" * 50 not in known
        assert sum(len(k) + len(v) for k, v in known.items()) <= 2 * known.bytes


def test_a_hot_doc_id_fills_several_files(spark):
    """Half of the rows have no doc_id, a quarter one and the same; equal rows too."""
    rows = [(None, f"text {i}") for i in range(100)] + [(None, "same")] * 100 + [(7, f"other {i % 5}") for i in range(100)] + [(i, "x " * (i % 9)) for i in range(100)]
    docs = documents(spark, rows).repartition(4)
    folder, manifest = tokenio.write_files(docs, BYTE, 2, files=8)
    sizes = sorted(r.docs for r in manifest.collect())
    assert sum(sizes) == 400 and sizes[-1] < 120
    read = tokenio.read_files(spark, folder, manifest).orderBy("start").collect()
    assert [r.start for r in read] == [sum(x.n_tokens for x in read[:i]) for i in range(len(read))]
    ids = [r.doc_id for r in read]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
