"""Principal components of a vector column: one distributed pass for the moments, power iteration on the small matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(rows: DataFrame, vector: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of vectors of `size` numbers; null vectors are left out.

    Each task adds up its own rows; what is shuffled and what reaches the driver has size x (size + 1) numbers,
    whatever the number of rows.
    """

    def summed(frames):
        n, total = 0, np.zeros((size + 1, size))
        for f in frames:
            x = np.stack(f["v"].to_numpy()).astype(np.float64) if len(f) else np.zeros((0, size))
            n += len(x)
            total[:size] += x.T @ x
            total[size] += x.sum(axis=0)
        if n:
            yield pd.DataFrame({"place": np.arange(total.size), "s": total.ravel(), "n": n})

    sums = rows.select(F.col(vector).alias("v")).filter("v IS NOT NULL").mapInPandas(summed, "place long, s double, n long")
    found = sums.groupBy("place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas().sort_values("place")
    if not len(found):
        return 0, np.zeros(size), np.zeros((size, size))
    n, flat = int(found["n"].iloc[0]), found["s"].to_numpy().reshape(size + 1, size)
    mean = flat[size] / n
    return n, mean, flat[:size] / n - np.outer(mean, mean)


def principal(covariance: np.ndarray, count: int, most: int = 1000, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Variances and unit vectors of the largest components by power iteration with deflation; each vector's largest entry is positive."""
    left, values, vectors = covariance.copy(), np.zeros(count), np.zeros((count, len(covariance)))

    def apart(v):  # rows of vectors not found yet are zero
        return v - vectors.T @ (vectors @ v)

    for k in range(count):
        v = apart(np.cos(np.arange(len(left)) * (k + 1.0) + k))
        v /= np.linalg.norm(v)
        for _ in range(most):
            w = apart(left @ v)
            size = np.linalg.norm(w)
            if size < 1e-15:
                break
            w = apart(w / size)
            w /= np.linalg.norm(w)
            moved = np.abs(w - v).max()
            v = w
            if moved < tolerance:
                break
        v = v * np.sign(v[np.abs(v).argmax()])
        value = float(v @ covariance @ v)
        values[k], vectors[k] = value, v
        left = left - value * np.outer(v, v)
    return values, vectors


def projected_hash(vector: Column, mean: np.ndarray, components: np.ndarray) -> Column:
    """Sign bits of a centred vector's products with up to 64 components; bit 0 is the first."""

    @F.pandas_udf("long")
    def packed(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="int64")
        bits = np.zeros((len(v), 64), bool)
        bits[:, : len(components)] = (np.stack(v.to_numpy()).astype(np.float64) - mean) @ components.T > 0
        return pd.Series(np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0])

    return packed(vector)


def sine_state(tokens: Column, width: int = 256) -> Column:
    """Of each dimension i the sum of sin(token + i * place) over the tokens. No tokens: zeros; null: null."""
    placed = F.transform(tokens, lambda t, k: F.struct(t.alias("t"), k.alias("k")))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(placed, F.lit(0.0), lambda s, x: s + F.sin((x["t"] + i * x["k"]).cast("double"))))
