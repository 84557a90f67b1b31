"""Exact quantiles against `percentile`, and equity curves against a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from callbook.operators.quantiles import exact_quantiles
from callbook.plans.strategies import equity_curve

SHARES = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)


@pytest.mark.parametrize(("bins", "rounds"), [(1024, 2), (3, 4), (2, 0)])
def test_equal_to_percentile(spark, bins, rounds):
    rng = random.Random(bins)
    rows = [("spread", rng.gauss(0, 100)) for _ in range(3000)] + [("equal", 7.0)] * 500 + [("few", x) for x in (1.0, 2.0)] + [("one", -3.5)] + [("third", 5.0 if rng.random() < 0.4 else rng.random() * 1e9) for _ in range(2000)]
    rows += [("spread", None), ("spread", float("nan")), ("none", None), ("tiny", 1e-300), ("tiny", 2e-300), ("tiny", 1e300)]
    df = spark.createDataFrame(rows, "run string, v double").repartition(5)
    want = {r.run: r.q for r in df.where("v is not null and not isnan(v)").groupBy("run").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")).collect()}
    got = {r.run: (r.quantiles, r.n) for r in exact_quantiles(df, ["run"], "v", SHARES, bins, rounds).collect()}
    assert got.keys() == want.keys()
    for run, q in want.items():
        assert got[run][0] == pytest.approx(q, rel=1e-12, abs=0)


def test_quantiles_among_equal_values_are_these_values(spark):
    rng = random.Random(4)
    rows = [(f"{k}", round(rng.random(), 6) * 20) for k in range(60)]
    df = spark.createDataFrame([r for r in rows for _ in range(7)], "run string, v double")
    values = dict(rows)
    for r in exact_quantiles(df, ["run"], "v", tuple(i / 10 for i in range(1, 10))).collect():
        assert r.quantiles == [values[r.run]] * 9


def test_a_large_run(spark):
    df = spark.range(2_000_000).select(F.lit("x").alias("run"), (F.pmod(F.col("id") * 7919, F.lit(1_999_993)) * 1.0).alias("v"))
    got = exact_quantiles(df, ["run"], "v", (0.5, 0.99))
    want = df.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.99)))).first()[0]
    assert got.first().quantiles == pytest.approx(want)
    assert "percentile" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("days", [1, 30, 10_000])
def test_curve_equals_a_plain_loop(spark, days):
    rng = random.Random(days)
    start = dt.datetime(2020, 1, 1)
    rows = [(run, f"T{k % 5}", start + dt.timedelta(minutes=k), start + dt.timedelta(days=rng.randrange(400)), 0.1 + k % 3 / 10, rng.gauss(0, 0.2)) for run in ("a", "b") for k in range(300)] + [("c", "T", start, start, 1.0, -1.0), ("c", "U", start, start + dt.timedelta(days=90), 0.5, 0.2)]
    df = spark.createDataFrame(rows, "strategy string, ticker string, as_of timestamp, exit_at timestamp, weight double, return_pct double").repartition(4)
    for run in "abc":
        nav = high = 1.0
        want = []
        for r in sorted((r for r in rows if r[0] == run), key=lambda r: (r[3], r[1], r[2])):
            nav *= 1 + r[4] * r[5]
            high = max(high, nav)
            want.append((nav, nav / high - 1))
        got = equity_curve(df.where(F.col("strategy") == run), days=days).orderBy("step").collect()
        assert [r.step for r in got] == list(range(1, len(want) + 1))
        for r, (a, b) in zip(got, want, strict=True):
            assert r.nav == pytest.approx(a, rel=1e-9) and r.drawdown == pytest.approx(b, abs=1e-9)
