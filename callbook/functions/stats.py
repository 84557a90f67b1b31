"""Small statistics as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95, Z99 = 1.959964, 2.575829


def wilson(hits: Column, n: Column, z: float = Z95, empty: tuple[float | None, float | None] = (0.0, 1.0)) -> tuple[Column, Column]:
    """A5: Wilson interval of hits out of n, clamped to [0, 1]; `empty` where n is 0 or less."""
    p, z2 = hits / n, z * z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    some = n > 0
    low = F.when(some, F.greatest(F.lit(0.0), middle - half)).otherwise(F.lit(empty[0]).cast("double"))
    high = F.when(some, F.least(F.lit(1.0), middle + half)).otherwise(F.lit(empty[1]).cast("double"))
    return low, high


def hit_rate(value: Column, threshold: float = 0.0) -> Column:
    """Share of non-null values strictly above the threshold."""
    return F.avg(F.when(value.isNotNull(), (value > threshold).cast("double")))


def sharpe_like(value: Column) -> Column:
    """Mean over sample deviation; null where that is null or 0."""
    deviation = F.stddev_samp(value)
    return F.when(deviation > 0, F.avg(value) / deviation)
