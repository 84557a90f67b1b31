"""Affine scans: EMA against the recursion, the ledger's blocks against a plain fold, on long histories."""

import datetime as dt
import random

import pytest

from callbook.operators.indicators import ema
from callbook.operators.recurrences import running_means
from callbook.plans.portfolio import EPS, fold_ledger

DAY = dt.datetime(1990, 1, 1)
TRADE = "id long, ticker string, side string, quantity double, price_per_share double, currency string, fees double, traded_at timestamp, eur_amount double"


@pytest.mark.parametrize("days", [1, 30, 256])
def test_means_equal_the_recursion(spark, days):
    rng = random.Random(days)
    rows, want = [], {}
    for ticker, n in (("A", 1500), ("B", 3), ("C", 1)):
        y = {}
        for i in range(n):
            x = None if rng.random() < 0.05 else rng.uniform(1, 500)
            day = DAY + dt.timedelta(days=i * 3 // 2)
            rows.append((ticker, day, x))
            for name, a in (("one", 1.0), ("slow", 0.01), ("fast", 0.6)):
                if x is not None:
                    y[name] = x if name not in y else a * x + (1 - a) * y[name]
            want[ticker, day] = (y.get("one"), y.get("slow"), y.get("fast"), i + 1)
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, close double").repartition(7)
    got = running_means(df, {"one": 1.0, "slow": 0.01, "fast": 0.6}, days=days).collect()
    assert len(got) == len(rows)
    for r in got:
        for a, b in zip((r.one, r.slow, r.fast, r._bars), want[r.ticker, r.ts], strict=True):
            assert a == b if b is None else a == pytest.approx(b, rel=1e-12)


def test_ema_is_null_until_enough_bars(spark):
    df = spark.createDataFrame([("A", DAY + dt.timedelta(days=i), float(i)) for i in range(30)], "ticker string, ts timestamp, close double")
    got = [r.ema_21 for r in ema(df).orderBy("ts").collect()]
    assert got[:20] == [None] * 20 and got[20] is not None
    plan = ema(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def fold(trades):
    """The ledger of one ticker, trade by trade."""
    qty = basis = realized = eur = eur_realized = 0.0
    for t in sorted(trades, key=lambda t: (t[7], t[0])):
        _, _, side, n, price, _, fees, _, in_eur = t
        if side not in ("buy", "sell"):
            return qty, basis, realized, eur, eur_realized, "unknown side"
        if side == "buy":
            qty, basis, eur = qty + n, basis + n * price + (fees or 0), eur + in_eur
            continue
        if n > qty + EPS:
            return qty, basis, realized, eur, eur_realized, "oversell"
        part = n / qty if qty > EPS else 0.0
        realized += n * price - (fees or 0) - part * basis
        eur_realized += in_eur - part * eur
        qty, basis, eur = qty - n, basis - part * basis, eur - part * eur
        if qty <= EPS:
            qty = basis = eur = 0.0
    return qty, basis, realized, eur, eur_realized, None


def ledger(ticker, n, seed, step, bad=None):
    rng, held, rows = random.Random(seed), 0.0, []
    for i in range(n):
        sell = held > 0 and rng.random() < 0.5
        size = (held if rng.random() < 0.1 else rng.randrange(1, int(held) + 1)) if sell else float(rng.randrange(1, 50))
        held += -size if sell else size
        price = rng.uniform(5, 50)
        rows.append((i, ticker, "sell" if sell else "buy", float(size), price, "USD", rng.choice([None, 0.5]), DAY + dt.timedelta(hours=step * i), 0.9 * size * price))
    if bad is not None:
        i, side, size = bad
        rows[i] = (*rows[i][:2], side, size, *rows[i][4:])
    return rows


def test_blocks_equal_the_plain_fold(spark):
    logs = {"long": ledger("long", 60_000, 1, 1), "short": ledger("short", 3, 2, 500), "over": ledger("over", 400, 3, 20, (250, "sell", 1e9)), "odd": ledger("odd", 400, 4, 20, (100, "gift", 1.0)), "first": ledger("first", 5, 5, 2000, (0, "sell", 1.0))}
    trades = spark.createDataFrame([t for log in logs.values() for t in log], TRADE).repartition(6)
    for days in (3, 30, 100_000):
        for r in fold_ledger(trades, days).collect():
            want = fold(logs[r.ticker])
            got = (r.quantity, r.cost_basis, r.realized, r.eur_cost_basis, r.eur_realized)
            assert got == pytest.approx(want[:5], rel=1e-9, abs=1e-6) and r.error == want[5] and r.n_trades == len(logs[r.ticker]), r.ticker


def test_one_hot_ticker_is_many_tasks(spark):
    plan = fold_ledger(spark.createDataFrame(ledger("hot", 10, 1, 1), TRADE))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ticker" in plan and "block" in plan and "Python" not in plan
