"""What a sample of bytes looks like, digests and message filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: First bytes in hex (?: any digit), category, hint and confidence, in the order they are tried.
MAGIC = [
    ("89504e47", "compressed", "png", 1.0),
    ("504b0304", "compressed", "zip", 1.0),
    ("1f8b", "compressed", "gzip", 1.0),
    ("ffd8ff", "compressed", "jpeg", 1.0),
    ("474946383761", "compressed", "gif", 1.0),
    ("474946383961", "compressed", "gif", 1.0),
    ("52494646????????57454250", "compressed", "webp", 1.0),
    ("424d", "raw_image", "bmp", 0.9),
    ("49492a00", "raw_image", "tiff", 0.9),
    ("4d4d002a", "raw_image", "tiff", 0.9),
    ("7f454c46", "binary", "elf", 0.9),
    ("255044462d", "binary", "pdf", 0.9),
]
#: First bytes in hex of content that is compressed already, or a model's weights.
PACKED = ("89504e47", "52494646????????57454250", "504b0304", "1f8b", "7f454c46", "47475546", "ffd8ff", "47494638")
#: Characters of a sample, and words that tell statements and code.
SAMPLE, STATEMENTS, CODE = 8192, "SELECT |INSERT INTO |CREATE TABLE ", "func |class |def |package |import |function "
#: The basis and the prime of FNV-1a.
BASIS, PRIME = 14695981039346656037, 1099511628211


def _begins(data: Column, magic: str) -> Column:
    head = F.hex(F.substring(data, 1, len(magic) // 2))
    return head.like(magic.upper().replace("?", "_")) if "?" in magic else head == magic.upper()


def _sample(data: Column) -> Column:
    """The first characters of bytes read as UTF-8 (what is no UTF-8 becomes a replacement character)."""
    return F.substring(F.make_valid_utf8(data.cast("string")), 1, SAMPLE)


def detected(data: Column) -> Column:
    """Struct of category, hint and confidence: first bytes, then words, then the share of printable ASCII. Null counts as empty."""
    kind = lambda c, h, s: F.struct(F.lit(c).alias("category"), F.lit(h).alias("hint"), F.lit(float(s)).alias("confidence"))
    sample = _sample(data)
    out = F.when(F.coalesce(F.length(data), F.lit(0)) == 0, kind("empty", "none", 1.0))
    for magic, c, h, s in MAGIC:
        out = out.when(_begins(data, magic), kind(c, h, s))
    printable = F.length(F.regexp_replace(sample, "[^ -~\\n\\r\\t]", "")) / F.octet_length(sample)
    out = out.when(F.contains(sample, F.lit("<svg")) | F.contains(F.upper(sample), F.lit("XML")), kind("raw_image", "svg", 0.8))
    out = out.when(F.upper(sample).rlike(STATEMENTS), kind("text_sql", "sql", 0.8)).when(sample.rlike(CODE), kind("text_code", "code", 0.7))
    return out.when(printable > 0.85, kind("text_logs", "text", 0.7)).otherwise(kind("binary", "unknown", 0.3))


def extension(data: Column) -> Column:
    """ELF, ZIP, PNG, JSONL, JSON, LINES or UNKNOWN. Null counts as empty."""
    sample = _sample(data)
    lines = F.length(sample) - F.length(F.replace(sample, F.lit("\n"), F.lit("")))
    odd = F.length(sample) - F.length(F.regexp_replace(sample, "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}]", ""))
    out = F.when(F.coalesce(F.length(data), F.lit(0)) == 0, "UNKNOWN")
    for magic, name in (("7f454c46", "ELF"), ("504b0304", "ZIP"), ("89504e47", "PNG")):
        out = out.when(_begins(data, magic), name)
    out = out.when(sample.rlike("^[ \\t\\n\\r]*[{\\[]"), F.when(F.contains(sample, F.lit("}\n{")), "JSONL").otherwise("JSON"))
    return out.when((lines > 5) & (odd < F.length(sample) / 10), "LINES").otherwise("UNKNOWN")


def packed_already(data: Column) -> Column:
    """Whether more than four bytes begin as compressed content does. Null: false."""
    begins = F.lit(False)
    for magic in PACKED:
        begins = begins | _begins(data, magic)
    return F.coalesce((F.length(data) > 4) & begins, F.lit(False))


def passes_through(entropy: Column, limit: float = 7.8) -> Column:
    """Whether bytes are too random to be worth packing."""
    return entropy > limit


@F.pandas_udf(StringType())
def _fnv(texts: pd.Series) -> pd.Series:
    """Texts of a batch go on together, a byte at a time, in 64-bit arithmetic that wraps; the last few, which are long, one by one."""
    data = [(x or "").encode() for x in texts]
    sizes = np.array([len(x) for x in data], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    out = np.full(len(data), BASIS, np.uint64)
    i, at = 0, np.flatnonzero(sizes)
    while len(at) >= 16:
        out[at] = (out[at] ^ flat[starts[at] + i]) * np.uint64(PRIME)
        i += 1
        at = at[sizes[at] > i]
    for k in at.tolist():
        h = int(out[k])
        for byte in data[k][i:]:
            h = (h ^ byte) * PRIME & 0xFFFFFFFFFFFFFFFF
        out[k] = h
    return pd.Series([str(x) for x in out.tolist()])


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as an unsigned decimal; null counts as empty."""
    return _fnv(text)


def accepted(messages: DataFrame, own: int, topics: list[str], signed: Column) -> DataFrame:
    """Messages (peer, topic, weight, ..) of these topics, without one's own and without weighted ones that are not signed. Works on streams and tables."""
    return messages.filter((F.col("peer") != own) & F.col("topic").isin(topics) & ((F.col("weight") <= 0) | signed))
