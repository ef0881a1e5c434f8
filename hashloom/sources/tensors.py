"""Containers of named tensors: a magic word, their number, then of each its name, shape and 32-bit floats, all little-endian."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .tables import files

#: Floats in a row that the reader gives.
PART = 1 << 16


@F.pandas_udf(BinaryType())
def tensor_bytes(name: pd.Series, shape: pd.Series, values: pd.Series) -> pd.Series:
    out = []
    for n, s, v in zip(name, shape, values, strict=True):
        n, v = n.encode(), np.asarray(v, "<f4")
        if int(np.prod(s)) != len(v):
            raise ValueError(f"a tensor of shape {list(s)} with {len(v)} values")
        out.append(struct.pack("<I", len(n)) + n + struct.pack(f"<I{len(s)}I", len(s), *s) + v.tobytes())
    return pd.Series(out)


def packed(rows: DataFrame, file: str, magic: bytes) -> DataFrame:
    """(file, content) from (file, name, shape, values): tensors of a file in order of their names. A file's size is the caller's bound."""
    body = F.array_sort(F.collect_list(F.struct("name", F.hex(tensor_bytes("name", "shape", "values")).alias("hex"))))
    n = F.lpad(F.hex(F.size("_b")), 8, "0")
    count = F.concat(*(F.substring(n, i, 2) for i in (7, 5, 3, 1)))
    joined = F.array_join(F.transform("_b", lambda x: x["hex"]), "")
    return rows.groupBy(file).agg(body.alias("_b")).select(file, F.unhex(F.concat(F.lit(magic.hex()), count, joined)).alias("content"))


def tensors(content: bytes, magic: bytes):
    """(name, shape, values) of each tensor; a container cut short is an error."""
    if content[: len(magic)] != magic:
        raise ValueError("not a tensor container")
    at = len(magic)

    def numbers(n: int) -> tuple:
        nonlocal at
        at += 4 * n
        return struct.unpack_from(f"<{n}I", content, at - 4 * n)

    for _ in range(*numbers(1)):
        (size,) = numbers(1)
        name, at = content[at : at + size].decode(), at + size
        shape = numbers(*numbers(1))
        n = int(np.prod(shape, dtype=np.int64))
        values, at = np.frombuffer(content, "<f4", n, at), at + 4 * n
        yield name, list(shape), values


def unpacked(rows: DataFrame, file: str, magic: bytes) -> DataFrame:
    """(file, name, shape, part, values) from (file, content): each tensor's values in parts of 65,536."""

    def run(frames):
        for f in frames:
            for key, content in zip(f[file], f["content"], strict=True):
                for name, shape, v in tensors(content, magic):
                    at = range(0, max(len(v), 1), PART)
                    yield pd.DataFrame({file: key, "name": name, "shape": [shape] * len(at), "part": list(range(len(at))), "values": [v[i : i + PART] for i in at]})

    kind = rows.schema[file].dataType.simpleString()
    return rows.select(file, "content").mapInPandas(run, f"{file} {kind}, name string, shape array<int>, part long, values array<float>")


def read_tensors(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """(path, name, shape, part, values) of every container below a folder."""
    return unpacked(files(spark, path), "path", magic)


#: Matrices and vectors of a model file, in their order.
LAYERS = ["emb", "pos", "w1", "b1", "w2", "b2"]


def model_bytes(weights: dict[str, np.ndarray], words: list[str], magic: bytes) -> bytes:
    """A language model as one file: magic, widths and radius, the words in order, then each layer's 32-bit floats."""
    span, width = weights["pos"].shape
    head = [magic, struct.pack("<4i", width, weights["w1"].shape[1], span // 2, len(words))]
    named = [struct.pack("<i", len(x)) + x for x in (x.encode() for x in words)]
    return b"".join([*head, *named, *(np.asarray(weights[k], "<f4").tobytes() for k in LAYERS)])


def model_of(content: bytes, magic: bytes) -> tuple[dict[str, np.ndarray], list[str]]:
    """Weights and words of model_bytes(); another kind of file, or one of another length than it says, is an error."""
    if content[: len(magic)] != magic:
        raise ValueError("not a model file")
    try:
        width, hidden, radius, n = struct.unpack_from("<4i", content, len(magic))
        at, words = len(magic) + 16, []
        for _ in range(n):
            (size,) = struct.unpack_from("<i", content, at)
            words.append(content[at + 4 : at + 4 + size].decode())
            at += 4 + size
    except struct.error as e:
        raise ValueError("a model file is cut off") from e
    span = 2 * radius + 1
    shapes = dict(zip(LAYERS, [(n, width), (span, width), (span * width, hidden), (hidden,), (hidden, n), (n,)], strict=True))
    if len(content) - at != 4 * sum(int(np.prod(x)) for x in shapes.values()):
        raise ValueError("a model file is cut off, or goes on")
    weights = {}
    for k, x in shapes.items():
        count = int(np.prod(x))
        weights[k], at = np.frombuffer(content, "<f4", count, at).reshape(x).astype(float), at + 4 * count
    return weights, words
