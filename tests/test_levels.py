"""Levels of every bar against a plain scan; blocks; the judged panel."""

import datetime as dt
import random

import pytest

from callbook.operators.levels import levels

BAR = "ticker string, ts timestamp, high double, low double, close double"
DAY = dt.datetime(2020, 1, 1)


def bars_of(ticker, n, seed):
    rng, rows, price = random.Random(seed), [], 100.0
    for i in range(n):
        price = max(1.0, price + rng.choice([-2, -1, 0, 1, 2]))
        high = price + rng.choice([0, 1, 2])
        rows.append((ticker, DAY + dt.timedelta(days=i), float(high), float(price - rng.choice([0, 1, 2])), None if rng.random() < 0.02 else float(price)))
    return rows


def scan(rows, reach, span, keep):
    """Levels of each bar of one ticker, each from the bars up to it alone."""
    for t in range(len(rows)):
        seen = rows[: t + 1]
        highs, lows = [], []
        for i in range(reach, len(seen) - reach):
            around = [j for j in range(i - reach, i + reach + 1) if j != i]
            if i > t - span:
                if all(seen[i][2] > seen[j][2] for j in around):
                    highs.append(seen[i][2])
                if all(seen[i][3] < seen[j][3] for j in around):
                    lows.append(seen[i][3])
        close = rows[t][4]
        under = [p for p in highs + lows if close is not None and p < close]
        over = [p for p in highs + lows if close is not None and p > close]
        yield max(under, default=None), min(over, default=None), sorted(highs[-keep:], reverse=True), sorted(lows[-keep:])


@pytest.mark.parametrize(("reach", "span", "block"), [(2, 30, 40), (5, 252, 300), (1, 7, 1)])
def test_every_bar_equals_a_plain_scan(spark, reach, span, block):
    rows = {t: bars_of(t, n, k) for k, (t, n) in enumerate((("A", 700), ("B", 9), ("C", 41), ("D", 1)))}
    df = spark.createDataFrame([r for x in rows.values() for r in x], BAR).repartition(5)
    got = {}
    for r in levels(df, reach, span, 3, block).collect():
        got.setdefault(r.ticker, []).append(r)
    for ticker, bars in rows.items():
        found = sorted(got[ticker], key=lambda r: r.bar_no)
        assert [r.ts for r in found] == [b[1] for b in bars]
        for r, want in zip(found, scan(bars, reach, span, 3), strict=True):
            assert (r.support, r.resistance, r.swing_highs, r.swing_lows) == want
            assert r.support_distance == (None if r.support is None else (r.close - r.support) / r.close)
            assert r.resistance_distance == (None if r.resistance is None else (r.resistance - r.close) / r.close)


def test_no_bars(spark):
    assert levels(spark.createDataFrame([], BAR)).count() == 0
