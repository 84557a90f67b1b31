"""Exact quantiles of groups of any size, by histograms that are refined around the wanted ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """counts (by, order, n) with the number of values before each row within `by`."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _between(a: Column, b: Column, share: Column) -> Column:
    """The value at a share of the way from a to b; between equal values it is that value, which rounding must not miss."""
    return F.when(a == b, a).otherwise(a * (1 - share) + b * share)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...], bins: int = 1024, rounds: int = 2) -> DataFrame:
    """keys, n and quantiles (array<double>, one per share): the values at share * (n - 1), interpolated between neighbours.

    Each round bins the values that may still hold a wanted rank between their least and greatest one, counts the bins
    (at most `bins` rows per kept range, summed in its tasks first) and keeps the bins that hold the ranks; the values
    left are counted one by one. So no task holds a group's values, nor a map of them, unless they share one of bins^rounds
    ranges. Nulls and NaN don't count; groups without values have no row.
    """
    held = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("v"))
    sizes = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    at = lambda s: F.lit(s) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(s)).cast("long"), F.ceil(at(s)).cast("long")) for s in shares])))
    # path: the bins chosen so far; ranks that share them share the values kept. left: a rank among those
    path = [*keys, "path"]
    wanted = sizes.withColumn("rank", F.explode(ranks)).select(*keys, "rank", F.lit(0).cast("long").alias("path"), F.col("rank").alias("left"))
    kept = held.withColumn("path", F.lit(0).cast("long"))
    inside = (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("n"))
    for _ in range(rounds):
        span = kept.groupBy(*path).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
        binned = kept.join(span, path).withColumn("bin", F.coalesce(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)), F.lit(0)).cast("int")).drop("lo", "hi")
        counts = binned.groupBy(*path, "bin").agg(F.count(F.lit(1)).alias("n"))
        chosen = _ranked(counts, path, "bin").join(wanted, path).where(inside)
        deeper = (F.col("path") * bins + F.col("bin")).alias("path")
        kept = binned.join(chosen.select(*path, "bin").distinct(), [*path, "bin"]).select(*keys, "v", deeper)
        wanted = chosen.select(*keys, "rank", deeper, (F.col("left") - F.col("before")).alias("left"))
    each = kept.groupBy(*path, "v").agg(F.count(F.lit(1)).alias("n"))
    found = _ranked(each, path, "v").join(wanted, path).where(inside).select(*keys, "rank", "v")
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m")).join(sizes, keys)  # two ranks per share at most

    def one(s: float):
        low, high = F.floor(at(s)).cast("long"), F.ceil(at(s)).cast("long")
        a, b = F.element_at("m", low), F.element_at("m", high)
        return F.when(low == high, a).otherwise(_between(a, b, at(s) - low))

    return values.select(*keys, "n", F.array(*[one(s) for s in shares]).alias("quantiles"))
