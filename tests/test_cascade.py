"""Gates before the search, and routing by content."""

import random

from hashloom.functions import content
from hashloom.operators import cascade
from pyspark.sql import functions as F


def test_gates(spark):
    """What a gate takes meets no codeword, even one that it equals; the rest is decided by similarity."""
    rng = random.Random(2)
    text, noise = b"abcdabcd" * 8, bytes(rng.sample(range(256), 64))
    near = b"abcdabcX" + text[8:]
    rows = [(1, b"plain", text), (2, b"\x89PNG\r\n", text), (3, b"RIFF1234WEBPx", text), (4, b"RIFF1234WAVEx", near), (5, b"", noise), (6, None, b"zz" * 32), (7, b"GGUF1", text), (8, b"\x1f\x8b", text), (9, b"x", None)]
    table = spark.createDataFrame([(i, h and bytearray(h), d and bytearray(d)) for i, h, d in rows], "k long, head binary, data binary")
    book = spark.createDataFrame([(0, bytearray(text)), (1, bytearray(noise))], "id long, data binary")
    got = {r.k: (r.decision, r.id, bytes(r.stored)) for r in cascade.decided(table, book, ["k"], noisy=5.5).collect()}
    assert got[1][:2] == ("hit", 0) and set(got[1][2]) == {0}
    assert {got[k] for k in (2, 3, 7)} == {("packed", None, text)}
    assert got[4][:2] == ("hit", 0) and got[5] == ("noise", None, noise) and got[6][0] == "literal"
    assert got[8][:2] == ("hit", 0)  # four bytes or less are no content to tell by
    assert got[9] == ("literal", None, b"") and len(got) == 9


def test_webp(spark):
    d = spark.createDataFrame([(bytearray(b"RIFF\x01\x02\x03\x04WEBPVP8 "),), (bytearray(b"RIFF\x01\x02\x03\x04WAVE"),), (bytearray(b"RIFF"),)], "d binary")
    assert [r[0] for r in d.select(content.detected(F.col("d"))["hint"]).collect()][0] == "webp"
    assert "webp" not in [r[0] for r in d.select(content.detected(F.col("d"))["hint"]).collect()][1:]


def test_routes(spark):
    """Each arm: category, hint where the category is unsure or has no book, universal, any of the size, none."""
    books = spark.createDataFrame([("logs", "text_logs", "", 8), ("odd", "x", "unknown", 8), ("pdf", "y", "pdf", 8), ("all", "universal", "", 8), ("last", "z", "", 4)], "book string, category string, hint string, size long")
    data = [(1, b"only text here", 8), (2, b"\x00\x01\x02\x03", 8), (3, b"%PDF-1.4", 8), (4, b"BM..", 8), (5, b"only text", 4), (6, b"only text", 2), (7, None, 8)]
    rows = spark.createDataFrame([(i, d and bytearray(d), n) for i, d, n in data], "k long, data binary, size long")
    assert {r.k: r.book for r in cascade.routed(rows, books).collect()} == {1: "logs", 2: "odd", 3: "pdf", 4: "all", 5: "last", 6: None, 7: "all"}
