"""Technical indicators of every ticker on every bar.

All rolling columns share one partitioning and order, so Spark sorts a ticker's bars once for the whole panel. As of
any date the panel is a filter. A ticker has about 252 bars a year, which bounds every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbook.operators import bars as B
from callbook.operators import recurrences as R
from callbook.operators.levels import swing_flags

SMA = (20, 50, 150, 200)
EMA = (8, 21)
RETURNS = (1, 5, 21, 63, 126, 252)
#: Fixed value: the widest 20-bar range that counts as tight.
TIGHT = 0.05


def _last(n: int, skip: int = 0):
    return B.by_ticker().rowsBetween(-(n - 1) - skip, -skip)


def _known(n: int, value: Column) -> Column:
    """value once the ticker has n bars."""
    return F.when(F.col("bar_no") >= n, value)


def _change(now: Column, before: Column) -> Column:
    return F.when(before != 0, now / before - 1)


def ema(bars: DataFrame, spans: tuple[int, ...] = EMA) -> DataFrame:
    """Bars with ema_<n>, alpha 2/(n+1), seeded with the first close; null until n bars."""
    means = R.running_means(bars, {f"ema_{n}": 2 / (n + 1) for n in spans})
    return means.withColumns({f"ema_{n}": F.when(F.col("_bars") >= n, F.col(f"ema_{n}")) for n in spans}).drop("_bars")


def ema_distances(bars: DataFrame, spans: tuple[int, ...] = EMA) -> DataFrame:
    """(ticker, ts, dist_ema_<n>): the close over each EMA, less 1."""
    return ema(bars, spans).select("ticker", "ts", *[_change(F.col("close"), F.col(f"ema_{n}")).alias(f"dist_ema_{n}") for n in spans])


def panel(bars: DataFrame) -> DataFrame:
    """Bars with all rolling columns but the EMAs."""
    w = B.by_ticker()
    close, prev = F.col("close"), F.lag("close").over(w)
    base = bars.select("ticker", "ts", "open", "high", "low", "close", "volume").withColumns({"bar_no": F.row_number().over(w), "prev_close": prev})
    move = F.col("close") - F.col("prev_close")
    base = base.withColumns(
        {
            "_up": F.greatest(move, F.lit(0.0)), "_down": F.greatest(-move, F.lit(0.0)),
            "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close"))),
            "_log": F.log(F.col("close") / F.col("prev_close")),
            **{f"sma_{n}": F.when(F.count("close").over(_last(n)) >= n, F.avg("close").over(_last(n))) for n in SMA},
        }
    )
    up, down = F.avg("_up").over(_last(14)), F.avg("_down").over(_last(14))
    rsi = F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).when(up == 0, 0.0).otherwise(100 - 100 / (1 + up / down))
    high52, low52 = F.max("close").over(_last(252)), F.min("close").over(_last(252))
    top20, low20 = F.max("high").over(_last(20)), F.min("low").over(_last(20))
    middle = (top20 + low20) / 2
    cols = {
        "sma_50_slope_21": _known(71, _change(F.col("sma_50"), F.lag("sma_50", 21).over(w))),
        "sma_200_slope_63": _known(263, _change(F.col("sma_200"), F.lag("sma_200", 63).over(w))),
        "rsi_14": _known(15, rsi),
        "atr_14": _known(15, F.avg("_tr").over(_last(14))),
        "realized_vol_21": _known(22, F.stddev_samp("_log").over(_last(21)) * (252**0.5)),
        "volume_ratio_20": _known(21, F.col("volume") / F.nullif(F.avg("volume").over(_last(20)), F.lit(0.0))),
        "avg_volume_20": _known(20, F.avg("volume").over(_last(20))),
        "avg_volume_63": _known(63, F.avg("volume").over(_last(63))),
        "dollar_volume": F.col("volume") * close,
        **{f"return_{n}": _change(close, F.lag("close", n).over(w)) for n in RETURNS},
        "gap": _change(F.col("open"), F.col("prev_close")),
        "pct_off_high_52w": _change(close, high52), "pct_off_low_52w": _change(close, low52),
        "consolidation_20": _known(20, (top20 - low20) / middle),
        "pullback_63": _known(63, 1 - close / F.max("close").over(_last(63))),
        "breakout_63": _known(64, close / F.max("close").over(_last(63, 1)) - 1),
        "recent_high_63": F.max("high").over(_last(63)), "recent_low_63": F.min("low").over(_last(63)),
        "base_low_60": F.min("low").over(_last(60)), "base_high_60": F.max("high").over(_last(60)),
    }
    out = base.withColumns(cols)
    out = out.withColumns({**{f"dist_sma_{n}": _change(close, F.col(f"sma_{n}")) for n in SMA}, "atr_14_pct": F.col("atr_14") / close, "tight_20": F.col("consolidation_20") <= TIGHT, "ma_alignment": ma_alignment()})
    return out.drop("_up", "_down", "_tr", "_log")


def ma_alignment() -> Column:
    """Price over 50 over 200 is a bullish stack, under is a bearish one."""
    p, a, b = F.col("close"), F.col("sma_50"), F.col("sma_200")
    return F.when(a.isNull() | b.isNull(), "insufficient").when((p > a) & (a > b), "bullish_stack").when((p < a) & (a < b), "bearish_stack").otherwise("mixed")


def relative_strength(bars: DataFrame, benchmark: str, spans: tuple[int, ...] = (63, 126), aligned_with: DataFrame | None = None) -> DataFrame:
    """(ticker, ts, rs_<n>): return over n common bars minus the benchmark's over the same ones.

    aligned_with: bars that hold the benchmark's, where `bars` are only some of them.
    """
    w = B.by_ticker()
    aligned = B.align_benchmark(bars, benchmark, aligned_with)
    rs = {f"rs_{n}": _change(F.col("close"), F.lag("close", n).over(w)) - _change(F.col("benchmark_close"), F.lag("benchmark_close", n).over(w)) for n in spans}
    return aligned.select("ticker", "ts", *[c.alias(k) for k, c in rs.items()])


def excess_returns(bars: DataFrame, benchmark: str, spans: tuple[int, ...] = (5, 21, 63)) -> DataFrame:
    """Each ticker's own n-bar return minus the benchmark's own n-bar return as of the same day."""
    w = B.by_ticker()
    own = bars.select("ticker", "ts", *[_change(F.col("close"), F.lag("close", n).over(w)).alias(f"return_{n}") for n in spans])
    index = B.day_index(bars.where(F.col("ticker") == benchmark).select("ticker", "ts", "close"), 400)
    ref = own.where(F.col("ticker") == benchmark).select("ts", *[F.col(f"return_{n}").alias(f"b_{n}") for n in spans])
    by_day = index.select("day", "ts").join(ref, "ts").drop("ts")  # one row per calendar day
    joined = own.withColumn("day", F.to_date("ts")).join(F.broadcast(by_day), "day", "left")
    return joined.select("ticker", "ts", *[(F.col(f"return_{n}") - F.col(f"b_{n}")).alias(f"excess_{n}") for n in spans])


def regimes(bars: DataFrame, benchmark: str) -> DataFrame:
    """(day, regime) for every calendar day from the benchmark's 21-bar trend: up over +2 %, down under -2 %, else flat; unknown under 22 bars."""
    only = bars.where(F.col("ticker") == benchmark)
    w = B.by_ticker()
    change = _change(F.col("close"), F.lag("close", 21).over(w))
    named = F.when(change.isNull(), "unknown").when(change > 0.02, "up").when(change < -0.02, "down").otherwise("flat")
    marked = only.select("ticker", "ts", named.alias("regime"))
    return B.day_index(marked, 400).select("day", "regime")


def screen_technicals(bars: DataFrame, benchmark: str) -> DataFrame:
    """Per ticker: last close, mean of the last 200 closes (from 50 bars on), return from the 63rd last close, and that minus the benchmark's."""
    back = Window.partitionBy("ticker").orderBy(F.desc("ts"))
    last = bars.where("close is not null").withColumn("back", F.row_number().over(back)).where("back <= 200")
    at = lambda n: F.max(F.when(F.col("back") == n, F.col("close")))
    rows = last.groupBy("ticker").agg(at(1).alias("last_close"), F.when(F.count(F.lit(1)) >= 50, F.avg("close")).alias("sma_200"), (at(1) / at(63) - 1).alias("return_63"))
    ref = rows.where(F.col("ticker") == benchmark).select(F.col("return_63").alias("_b"))
    return rows.crossJoin(F.broadcast(ref)).withColumn("rs_vs_benchmark", F.col("return_63") - F.col("_b")).drop("_b")  # one row


def swings(bars: DataFrame, reach: int = 5) -> DataFrame:
    """(ticker, bar_no, ts, kind, price, confirmed_no): bars strictly beyond the `reach` bars on each side.

    A swing is knowable only when the bars after it exist: from bar confirmed_no on.
    """
    kinds = F.array_compact(F.array(*[F.when(F.col(f"swing_{k}").isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(f"swing_{k}").alias("price"))) for k in ("high", "low")]))
    return swing_flags(bars, reach).withColumn("s", F.explode(kinds)).select("ticker", "bar_no", "ts", "s.kind", "s.price", (F.col("bar_no") + reach).alias("confirmed_no"))
