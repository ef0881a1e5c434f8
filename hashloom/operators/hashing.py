"""SimHash of vectors and of weighted tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions.bits import digest_bit


def planes(bits: int = 64, size: int = 64, family: int = 0) -> np.ndarray:
    """Deterministic whole-number hyperplanes; families differ by a shift of the row number."""
    i, j = np.arange(bits)[:, None] + 64 * family, np.arange(size)[None, :]
    return (((i * 131 + j * 71 + i * j * 37 + (i + 1) * (j + 1) * (j + 3)) % 201) - 100).astype(np.float64)


def simhash(vector: Column, family: int = 0, centre: np.ndarray | None = None) -> Column:
    """64 sign bits of a vector's products with the planes; bit 0 is the lowest. The product is one matrix product a batch."""

    @F.pandas_udf("long")
    def packed(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="int64")
        x = np.stack(v.to_numpy()).astype(np.float64)
        if centre is not None:
            x = x - centre
        bits = x @ planes(64, x.shape[1], family).T > 0
        return pd.Series(np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0])

    return packed(vector)


def token_simhash(weights: DataFrame, key: str, token: str, weight: str) -> DataFrame:
    """(key, hash) of a sparse bag of tokens: the planes' components are the signs of a token's MD5 bits.

    One grouping with 64 sums: partial sums are made before the shuffle, and no dense vector is built.
    """
    digest = F.md5(token)
    sums = [F.sum(F.col(weight) * (2 * digest_bit(digest, i) - 1)).alias(f"_{i}") for i in range(64)]
    summed = weights.groupBy(key).agg(*sums)
    bits = [F.when(F.col(f"_{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return summed.select(key, out.alias("hash"))
