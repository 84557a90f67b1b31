"""Recurrences over a ticker's history as affine maps: folded per block of time, carried from block to block.

A step of the form y -> a y + b composes with the next one into a step of the same form. So a ticker's rows are cut into
blocks of days, each block is folded apart (the blocks of one ticker are many tasks), one short row of block maps per
ticker gives what each block begins with, and the blocks' rows take that in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_block(ts: str | Column, days: int) -> Column:
    """The number of the block of `days` days that holds a time."""
    return F.floor(F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")) / days).cast("int")


def running_means(bars: DataFrame, spans: dict[str, float], value: str = "close", days: int = 256) -> DataFrame:
    """bars with y_t = alpha x_t + (1 - alpha) y_(t-1) per ticker for each column and alpha in `spans`, begun with the first
    value, and _bars, the number of the ticker's bars so far.

    Bars are at most one a day. A bar without a value keeps the mean before it. In a block the sum of alpha x_i w^-i for
    w = 1 - alpha, times w^t, is the mean but for what the block begins with, w^t times the carry; all terms weigh less than
    the newest, so nothing cancels, and `days` keeps w^-i far within doubles.
    """
    rows = bars.withColumn("_block", day_block("ts", days))
    w = Window.partitionBy("ticker", "_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_i": F.count(value).over(w), "_k": F.count(F.lit(1)).over(w)})
    weight = lambda a: F.pow(F.lit(1 - a), F.col("_i"))
    sums = lambda a: F.coalesce(a * weight(a) * F.sum(F.col(value) / weight(a)).over(w), F.lit(0.0))
    own = {f"_own_{c}": sums(a) if a < 1 else F.last(value, True).over(w) for c, a in spans.items()}
    rows = rows.withColumns(own)
    last = lambda c: F.max_by(c, "ts").alias(c)
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col("ts"))).alias("_first")
    blocks = rows.groupBy("ticker", "_block").agg(last("_i"), last("_k"), first, *[last(c) for c in own])
    maps = blocks.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("_block", "_i", "_k", "_first", *own))).alias("maps"))
    begin = F.get(F.transform(F.filter("maps", lambda m: m["_first"].isNotNull()), lambda m: m["_first"]), F.lit(0))
    carried = lambda bars, seen, **y: F.struct(bars.alias("bars"), seen.alias("seen"), *[y[c].alias(c) for c in own])
    kind = "array<struct<block:int,bars:bigint,seen:bigint" + "".join(f",{c}:double" for c in own) + ">>"

    def step(s, m):
        here = F.struct(m["_block"].alias("block"), s["now"]["bars"].alias("bars"), s["now"]["seen"].alias("seen"), *[s["now"][c].alias(c) for c in own])
        after = {f"_own_{c}": F.pow(F.lit(1 - a), m["_i"]) * s["now"][f"_own_{c}"] + m[f"_own_{c}"] if a < 1 else F.coalesce(m[f"_own_{c}"], s["now"][f"_own_{c}"]) for c, a in spans.items()}
        return F.struct(carried(s["now"]["bars"] + m["_k"], s["now"]["seen"] + m["_i"], **after).alias("now"), F.concat(s["out"], F.array(here)).alias("out"))

    zero = F.struct(carried(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), **dict.fromkeys(own, begin)).alias("now"), F.array().cast(kind).alias("out"))
    begins = maps.select("ticker", F.explode(F.aggregate("maps", zero, step)["out"]).alias("m"))
    begins = begins.select("ticker", F.col("m.block").alias("_block"), F.col("m.bars").alias("_before"), F.col("m.seen").alias("_seen"), *[F.col(f"m.{c}").alias(f"{c}_0") for c in own])
    joined = rows.join(begins, ["ticker", "_block"])
    # before the first value there is nothing to carry
    seen = (F.col("_i") > 0) | (F.col("_seen") > 0)
    means = {c: F.when(seen, weight(a) * F.col(f"_own_{c}_0") + F.col(f"_own_{c}") if a < 1 else F.coalesce(f"_own_{c}", f"_own_{c}_0")) for c, a in spans.items()}
    return joined.withColumns({**means, "_bars": F.col("_before") + F.col("_k")}).select(*bars.columns, *spans, "_bars")
