"""Support and resistance of every bar (W15) and a ticker's bars in blocks.

Levels of a bar come from the swings that its ticker had confirmed by then among the last bars. Each ticker's numbered
bars are cut into blocks; a block also gets the swings shortly before it, so blocks are worked on apart and a ticker with
a long history is many tasks. Within a block one pass keeps the confirmed swings' prices in order: a swing is put in
when it is confirmed, taken out when it is too old, and the prices next to the close are found by bisection.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.operators import bars as B

_FIELDS = "ticker string, ts timestamp, bar_no int, close double, support double, resistance double, swing_highs array<double>, swing_lows array<double>"


def swing_flags(bars: DataFrame, reach: int = 5) -> DataFrame:
    """ticker, ts, close, bar_no (from 1) and, where the bar is a swing, its swing_high and swing_low price: strictly beyond the `reach` bars on each side."""
    w = B.by_ticker()
    rows = bars.select("ticker", "ts", "high", "low", "close").withColumns({"bar_no": F.row_number().over(w), "_ahead": F.lead("ts", reach).over(w)})
    before, after = w.rowsBetween(-reach, -1), w.rowsBetween(1, reach)
    whole = (F.col("bar_no") > reach) & F.col("_ahead").isNotNull()
    high = whole & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))
    low = whole & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))
    return rows.select("ticker", "ts", "close", "bar_no", F.when(high, F.col("high")).alias("swing_high"), F.when(low, F.col("low")).alias("swing_low"))


def _slide(rows: list[tuple], reach: int, span: int, keep: int) -> Iterator[tuple]:
    """For each bar (ts, bar_no, close, swing_high, swing_low, own) of a block, by number: levels of those that are its own."""
    prices: list[float] = []  # of the swings in the window, in order
    waiting: deque = deque()  # (bar_no, high, low) of swings that aren't confirmed yet
    inside: deque = deque()  # of those in the window
    highs: deque = deque(maxlen=keep)
    lows: deque = deque(maxlen=keep)
    for ts, no, close, high, low, own in rows:
        if high is not None or low is not None:
            waiting.append((no, high, low))
        while waiting and waiting[0][0] + reach <= no:
            swing = waiting.popleft()
            inside.append(swing)
            for price, newest in ((swing[1], highs), (swing[2], lows)):
                if price is not None:
                    insort(prices, price)
                    newest.append((swing[0], price))
        while inside and inside[0][0] <= no - span:
            for price in inside.popleft()[1:]:
                if price is not None:
                    del prices[bisect_left(prices, price)]
        if own:
            under = over = None
            if close is not None:
                at = bisect_left(prices, close)
                under = prices[at - 1] if at else None
                at = bisect_right(prices, close)
                over = prices[at] if at < len(prices) else None
            recent = [sorted(p for n, p in newest if n > no - span) for newest in (highs, lows)]
            yield ts, no, close, under, over, recent[0][::-1], recent[1]


def levels(bars: DataFrame, reach: int = 5, span: int = 252, keep: int = 5, block: int = 2048) -> DataFrame:
    """One row per ticker and bar: support and resistance (the swing prices next under and over the close, among swings
    confirmed by then in the last `span` bars), the `keep` newest swing_highs (falling) and swing_lows (rising), and the
    distances to both levels as shares of the close.

    A swing is confirmed `reach` bars after it. A bar without a close has no levels; without swings the arrays are empty.
    """
    block = max(block, span)
    rows = swing_flags(bars, reach)
    own = F.floor((F.col("bar_no") - 1) / block).cast("int")
    is_swing = F.col("swing_high").isNotNull() | F.col("swing_low").isNotNull()
    late = is_swing & (F.col("bar_no") > (own + 1) * block - span)  # a swing that the next block still sees
    placed = rows.withColumn("home", own).withColumn("block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("bar_no")
        mine = [h == key[1].as_py() for h in table["home"].to_pylist()]
        columns = [table[c].to_pylist() for c in ("bar_no", "close", "swing_high", "swing_low")]
        made = list(zip(*_slide(list(zip(range(len(mine)), *columns, mine, strict=True)), reach, span, keep), strict=True))
        if not made:  # swings of the last block alone
            return pa.table({f.name: pa.array([], f.type) for f in out}, schema=out)
        kept = table.take(pa.array(made[0], pa.int64()))
        values = [pa.array(v, t) for v, t in zip(made[3:], (pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)]
        return pa.Table.from_arrays([kept["ticker"], kept["ts"], kept["bar_no"], kept["close"], *values], schema=out)

    out = pa.schema([("ticker", pa.string()), ("ts", pa.timestamp("us", tz="UTC")), ("bar_no", pa.int32()), ("close", pa.float64()), ("support", pa.float64()), ("resistance", pa.float64()), ("swing_highs", pa.list_(pa.float64())), ("swing_lows", pa.list_(pa.float64()))])
    found = placed.groupBy("ticker", "block").applyInArrow(run, _FIELDS)
    close = F.col("close")
    share = lambda distance: F.when(close > 0, distance / close)
    return found.withColumns({"support_distance": share(close - F.col("support")), "resistance_distance": share(F.col("resistance") - close)})
