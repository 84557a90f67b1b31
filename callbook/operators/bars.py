"""Daily bars: reading rules, slices, numbering, and lookups by calendar day.

Bars are stamped at UTC midnight of their session. Numbering the bars of a ticker, and laying each bar over the
calendar days until the next one, turns time ranges and as-of lookups into equi-joins, which Spark can split when a
ticker is hot; no operator here ranges over all bars of all tickers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbook.operators.asof import as_of_join, over_times

PRICES = ("open", "high", "low", "close")


def by_ticker() -> "Window":
    return Window.partitionBy("ticker").orderBy("ts")


def clean_bars(bars: DataFrame, load_seq: str | None = None) -> DataFrame:
    """IO1: NaN prices become null; of rows with one (ticker, ts) the last loaded stays (without load_seq, the highest volume)."""
    bars = bars.withColumns({p: F.when(F.isnan(p), None).otherwise(F.col(p)) for p in PRICES})
    order = [F.col(load_seq).desc()] if load_seq else []
    last = Window.partitionBy("ticker", "ts").orderBy(*order, F.desc_nulls_last("volume"), F.desc_nulls_last("close"))
    return bars.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def merge_bars(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """IO2: both, the fresh bar where both have one."""
    both = cached.withColumn("_seq", F.lit(0)).unionByName(fresh.withColumn("_seq", F.lit(1)))
    return clean_bars(both, "_seq").drop("_seq")


def upsert_bars(fresh: DataFrame, path: str, buckets: int = 64) -> None:
    """IO2: merge fresh bars into the table at path, which is partitioned by bucket of the ticker and year.

    Only partitions that fresh bars fall into are read and replaced; others keep their files. Doing it again, as after a
    lost job, writes the same.
    """
    spark = fresh.sparkSession
    keyed = fresh.withColumns({"bucket": F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int"), "year": F.year("ts")})
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    merged = keyed
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        held = spark.read.schema(keyed.schema).parquet(path)
        touched = keyed.select("bucket", "year").distinct()  # at most buckets times years
        merged = merge_bars(held.join(F.broadcast(touched), ["bucket", "year"], "left_semi"), keyed)
    else:
        merged = clean_bars(keyed)
    rows = merged.repartition("bucket", "year").sortWithinPartitions("bucket", "year", "ticker", "ts")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "year").parquet(path)


def as_of_slice(df: DataFrame, as_of, ts: str = "ts") -> DataFrame:
    """rows not after as_of."""
    return df.where(F.col(ts) <= F.lit(as_of).cast("timestamp"))


def numbered(bars: DataFrame) -> DataFrame:
    """bars with bar_no (from 1), n_bars of the ticker and the next bar's ts."""
    w = by_ticker()
    return bars.withColumns({"bar_no": F.row_number().over(w), "next_ts": F.lead("ts").over(w), "n_bars": F.count(F.lit(1)).over(Window.partitionBy("ticker"))})


def day_index(bars: DataFrame, ahead_days: int = 60) -> DataFrame:
    """(ticker, day, bar_no, ...): for each calendar day, the last bar at or before it, up to ahead_days after a ticker's last bar.

    An equi-join on (ticker, day) is then an as-of lookup.
    """
    until = F.coalesce(F.date_sub(F.to_date("next_ts"), 1), F.date_add(F.to_date("ts"), ahead_days))
    return numbered(bars).withColumn("day", F.explode(F.sequence(F.to_date("ts"), until)))


def latest_close(events: DataFrame, bars: DataFrame, at: str, lookback_days: int = 30) -> DataFrame:
    """Events (ticker, at) with `close` and `close_ts` of the last bar at or before `at`, none if older than lookback_days."""
    found = as_of_join(events, bars.withColumn("close_ts", F.col("ts")), at, "ts", ["close", "close_ts"])
    fresh = F.col("close_ts") >= F.col(at) - F.expr(f"interval {lookback_days} days")
    return found.withColumns({"close": F.when(fresh, F.col("close")), "close_ts": F.when(fresh, F.col("close_ts"))})


def align_benchmark(bars: DataFrame, benchmark: str, aligned_with: DataFrame | None = None) -> DataFrame:
    """Bars with the benchmark's close (from aligned_with, where given) of the same day, where both have one.

    The benchmark is one ticker: its rows are as many as days, so broadcasting them is bounded by the calendar.
    """
    series = (bars if aligned_with is None else aligned_with).where((F.col("ticker") == benchmark) & F.col("close").isNotNull()).select("ts", F.col("close").alias("benchmark_close"))
    return bars.where(F.col("close").isNotNull()).join(F.broadcast(series), "ts")


def ticker_bars(bars: DataFrame, ticker: str, until, days: int) -> DataFrame:
    """a ticker's bars of the last `days` calendar days, time in epoch seconds, missing volume 0."""
    end = F.lit(until).cast("timestamp")
    rows = bars.where((F.col("ticker") == ticker) & (F.col("ts") >= end - F.expr(f"interval {days} days")) & (F.col("ts") <= end))
    return rows.select(F.unix_timestamp("ts").alias("time"), *PRICES, F.coalesce("volume", F.lit(0)).alias("volume"))


def tradeable(as_ofs: DataFrame, bars: DataFrame, days: int = 14, min_volume: int = 1000) -> DataFrame:
    """(as_of, ticker) with a bar of at least min_volume in the `days` before the as_of's last knowable session.

    as_ofs holds as_of and knowable_through. Each such bar serves the as_ofs until the ticker's next one, for which the
    calendar is asked, so only rows of the result are made.
    """
    w = by_ticker()
    sold = bars.where(F.coalesce("volume", F.lit(0)) >= min_volume).select("ticker", "ts").withColumn("_next", F.lead("ts").over(w))
    last = F.least(F.coalesce(F.date_sub(F.to_date("_next"), 1), F.date_add(F.to_date("ts"), days + 8)), F.date_add(F.to_date("ts"), days + 8))
    served = over_times(sold, as_ofs.select("as_of", "knowable_through"), "knowable_through", F.to_date("ts"), last)
    inside = (F.col("ts") <= F.col("knowable_through")) & (F.col("ts") >= F.date_trunc("day", F.col("as_of") - F.expr(f"interval {days} days")))
    return served.where(inside).select("as_of", "ticker").distinct()


def price_in(lower: Column, upper: Column, value: Column) -> Column:
    return F.coalesce((value >= lower) & (value <= upper), F.lit(False))


def _between(as_ofs: DataFrame, bars: DataFrame, first_day: Column, last_day: Column, ahead: int) -> DataFrame:
    """bars with each as_of's columns, from the last bar at or before first_day to the last one at or before last_day.

    Both ends are looked up by day and only the numbers between them are exploded, so the work is that of the result.
    as_ofs are as many as the calendar's days.
    """
    index = day_index(bars.select("ticker", "ts"), ahead).select("ticker", "day", "bar_no")
    ends = index.join(F.broadcast(as_ofs.withColumn("day", last_day)), "day").withColumnRenamed("bar_no", "_to").withColumn("day", first_day)
    spans = ends.join(index.withColumnRenamed("bar_no", "_from"), ["ticker", "day"], "left").drop("day")
    numbers = spans.withColumn("bar_no", F.explode(F.sequence(F.coalesce("_from", F.lit(1)), "_to"))).drop("_from", "_to")
    return numbers.join(numbered(bars).drop("next_ts", "n_bars"), ["ticker", "bar_no"]).drop("bar_no")


def knowable_slice(as_ofs: DataFrame, bars: DataFrame, lookback_days: int) -> DataFrame:
    """bars visible at each as_of (as_of, knowable_through): up to the last closed session, from lookback_days before as_of."""
    since = F.col("as_of") - F.expr(f"interval {lookback_days} days")
    near = _between(as_ofs, bars, F.to_date(since), F.to_date("knowable_through"), lookback_days + 7)
    return near.where((F.col("ts") <= F.col("knowable_through")) & (F.col("ts") >= since))


def forward_slice(as_ofs: DataFrame, bars: DataFrame, forward_days: int) -> DataFrame:
    """the complement of F2: bars after the last closed session, up to forward_days after as_of."""
    until = F.col("as_of") + F.expr(f"interval {forward_days} days")
    near = _between(as_ofs, bars, F.to_date("knowable_through"), F.to_date(until), forward_days + 60)
    return near.where((F.col("ts") > F.col("knowable_through")) & (F.col("ts") <= until))


def bars_in_interval(rows: DataFrame, bars: DataFrame, start_no: str, n: str, end: str) -> DataFrame:
    """Rows (with ticker) and the bars from number start_no up to n further ones that begin by `end`: one equi-join on (ticker, bar number)."""
    numbers = F.explode(F.sequence(F.col(start_no), F.col(start_no) + F.col(n)))
    wanted = rows.withColumn("bar_no", numbers)
    return wanted.join(numbered(bars).select("ticker", "bar_no", "ts", "open", "high", "low", "close"), ["ticker", "bar_no"]).where(F.col("ts") <= F.col(end))
