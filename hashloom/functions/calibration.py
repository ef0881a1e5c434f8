"""Distances to confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence(distance: Column, middle: Column | float, slope: float = 1.5) -> Column:
    """Falling sigmoid, in percent: 50 at the middle."""
    return 100 / (1 + F.exp(slope * (distance - middle)))


def hard_negative(distance: Column, limit: int, middle: float = 4.0, slope: float = 1.5) -> Column:
    return F.when(distance > limit, F.lit(0.0)).otherwise(confidence(distance, middle, slope))


def dynamic(distance: Column, middle: Column, slope: float = 1.5) -> Column:
    """hard_negative with a limit of three middles, rounded up."""
    return F.when(distance > F.ceil(3 * middle), F.lit(0.0)).otherwise(confidence(distance, middle, slope))


def length_middle(n_words: Column) -> Column:
    return 12 + 6 / F.log2(F.greatest(n_words, F.lit(1)) + 1)


def punished(times: Column) -> Column:
    """Middle of a bucket after some failures: each takes 15 %, not below 1."""
    return F.greatest(F.lit(1.0), 4 * F.pow(F.lit(0.85), times))


def consensus(*distances: Column) -> Column:
    mean = sum(distances[1:], distances[0]) / len(distances)
    return F.greatest(F.lit(0.0), 100 - 2 * mean)


def cosine_rate(base: float, step: Column, steps: Column) -> Column:
    return base * (0.1 + 0.45 * (1 + F.cos(F.pi() * step / steps)))
