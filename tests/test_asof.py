"""As-of lookups against plain scans, peers, partitioned bars, extractions, lens outcomes and digests."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from callbook.functions import text as T
from callbook.functions import zones as Z
from callbook.operators import bars as B
from callbook.operators.asof import as_of_join, over_times
from callbook.plans import extraction as E
from callbook.plans import lenses as L
from callbook.plans import research as R
from callbook.plans import screener as S
from callbook.plans import strategies as X

DAY = dt.datetime(2020, 1, 1)


@pytest.mark.parametrize("days", [1, 7, 5000])
def test_as_of_join_equals_a_scan(spark, days):
    rng = random.Random(days)
    at = lambda: DAY + dt.timedelta(hours=rng.randrange(0, 24 * 300))
    rows = [(rng.choice("ABC"), at(), k, float(k)) for k in range(300)]
    rows += [(k, t, n + 1000, -v) for k, t, n, v in rows[:40]]  # ties in time
    events = [(k, rng.choice(["A", "B", "C", "D", None]), at() if rng.random() < 0.9 else None) for k in range(400)] + [(1000 + k, r[0], r[1]) for k, r in enumerate(rows[:50])]
    left = spark.createDataFrame(events, "id long, ticker string, at timestamp").repartition(5)
    right = spark.createDataFrame(rows, "ticker string, ts timestamp, no long, v double").repartition(3)
    got = {r.id: (r.no, r.v) for r in as_of_join(left, right, "at", "ts", ["no", "v"], ties="no", days=days).collect()}
    assert len(got) == len(events)
    for k, ticker, t in events:
        before = [(r[1], r[2], r[3]) for r in rows if r[0] == ticker and t is not None and r[1] <= t]
        assert got[k] == ((None, None) if not before else max(before)[1:])


def test_latest_close_explodes_nothing(spark):
    bars = spark.createDataFrame([("A", DAY, 1.0)], "ticker string, ts timestamp, close double")
    plan = B.latest_close(spark.createDataFrame([("A", DAY)], "ticker string, at timestamp"), bars, "at")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "_block" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_over_times_equals_all_pairs(spark):
    rng = random.Random(3)
    times = sorted({DAY + dt.timedelta(days=7 * k, hours=rng.randrange(24)) for k in range(40)})
    rows = [(k, (a := (DAY + dt.timedelta(days=rng.randrange(-60, 340))).date()), None if rng.random() < 0.1 else a + dt.timedelta(days=rng.randrange(-3, 40))) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, a date, z date")
    got = sorted((r.id, r.as_of) for r in over_times(df, spark.createDataFrame([(t,) for t in times], "as_of timestamp"), "as_of", F.col("a"), F.col("z")).collect())
    assert got == sorted((k, t) for k, a, z in rows for t in times if a <= t.date() and (z is None or t.date() <= z))
    assert over_times(df, spark.createDataFrame([], "as_of timestamp"), "as_of", F.col("a"), F.col("z")).count() == 0


def test_peers(spark):
    keyed, fallback = S.peer_tables(spark)
    rows = [("NVDA", "Technology", "Semiconductors", "industry"), ("AMAT", "Technology", "Semiconductor Equipment & Materials", "industry"), ("ZZ", "Technology", "Quantum things", "sector"), ("YY", "Nowhere", "Quantum", "none"), ("XX", None, None, "none"),
            ("WW", None, "Crypto mining", "industry"), ("MARA", "Financial Services", "Capital Markets", "special"), ("VV", "Energy", "Semiconductors", "sector"), ("UU", "Real Estate", None, "sector"), ("TT", "Real Estate", "REIT - Office", "industry"), ("SS", None, "Semiconductors", "none")]
    found = {}
    for r in S.resolve_peers(spark.createDataFrame([r[:3] for r in rows], "ticker string, sector string, industry string"), keyed, fallback).orderBy("target", "rank").collect():
        found.setdefault(r.target, (r.by, []))[1].append(r.peer)
    assert {t: b for t, (b, _) in found.items()} == {r[0]: r[3] for r in rows}
    assert found["NVDA"][1] == ["AMD", "AVGO", "MU", "INTC", "QCOM"] and found["AMAT"][1] == ["NVDA", "AMD", "AVGO", "MU", "INTC", "QCOM"]
    assert found["MARA"][1] == [p for p in S.CRYPTO_PEERS if p != "MARA"] and found["WW"][1] == list(S.CRYPTO_PEERS) and found["YY"][1] == [None]
    short = spark.createDataFrame([(1, None, "ab", ["P"]), (2, "s", "c", ["Q"]), (3, "s", "zzzz", ["R"])], "place int, sector string, key string, peers array<string>")
    few = S.resolve_peers(spark.createDataFrame([("1", "s", "xABx"), ("2", "s", "cc"), ("3", "t", "c")], "ticker string, sector string, industry string"), short, fallback)
    assert sorted((r.target, r.peer) for r in few.collect()) == [("1", "P"), ("2", "Q"), ("3", None)]


def test_bars_replace_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "bars")
    schema = "ticker string, ts timestamp, open double, high double, low double, close double, volume long"
    bar = lambda t, y, d, c: (t, dt.datetime(y, 1, d), c, c, c, c, 1)
    B.upsert_bars(spark.createDataFrame([bar(t, y, d, 1.0) for t in "ABCDEF" for y in (2019, 2020) for d in (2, 3)], schema), path, 4)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    fresh = spark.createDataFrame([bar("A", 2020, 3, 9.0), bar("A", 2020, 4, 9.0)], schema)
    B.upsert_bars(fresh, path, 4)
    after = files()
    assert len(before - after) == len(after - before) == 1  # one bucket and year
    rows = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("ticker", "ts", "close").collect())
    once = rows()
    assert len(once) == 25 and [c for t, s, c in once if t == "A" and s.year == 2020] == [1.0, 9.0, 9.0]
    B.upsert_bars(fresh, path, 4)  # a retry
    assert rows() == once


def test_malformed_extractions_never_reach_their_source(spark):
    universe = spark.createDataFrame([("A",)], "ticker string")
    claim = ("A", "rates may fall", "so rates may fall soon", "factual", 0.9, None)
    rows = [(1, *claim[:5], "earnings_view", None), (2, None, *claim[1:5], "earnings_view", "tech"), (3, None, *claim[1:5], "risk", None), (4, None, *claim[1:5], "risk", "tech")]
    got = {r.id: r for r in E.extract_claims(spark.createDataFrame(rows, "id long, ticker string, evidence_quote string, source string, claim_class string, overall_confidence double, claim_type string, sector string"), universe).collect()}
    assert [got[k].failures for k in (1, 2, 3, 4)] == [[], ["malformed_ticker"], ["malformed_ticker_or_sector"], []]
    assert got[2].status == "rejected" and got[2].final_confidence == 0.0 and got[1].claim_class == "opinion"
    call = dict(ticker="A", ticker_evidence="a", direction_evidence="buy", source="buy a above 10", entry_type="market", overall_confidence=0.9, market_price=10.0, timeframe="swing", entry_price=10.0, entry_evidence="above 10", target_price=None, target_evidence=None, stop_price=None, stop_evidence=None)
    calls = [call | {"id": 1}, call | {"id": 2, "target_price": 12.0}, call | {"id": 3, "entry_type": "limit", "entry_price": None, "entry_evidence": None}]
    fields = "id long, ticker string, ticker_evidence string, direction_evidence string, source string, entry_type string, overall_confidence double, market_price double, timeframe string, entry_price double, entry_evidence string, target_price double, target_evidence string, stop_price double, stop_evidence string"
    names = [f.split()[0] for f in fields.split(", ")]
    got = {r.id: r for r in E.extract_calls(spark.createDataFrame([tuple(c[n] for n in names) for c in calls], fields), universe).collect()}
    assert got[1].failures == [] and got[1].status == "accepted" and got[2].failures == ["malformed_target_evidence"] and got[3].failures == ["malformed_entry_price"] and got[3].status == "rejected"
    placed = E.windowed(spark.createDataFrame([(7, 1, "x"), (7, 2, "y")], "document_id long, cluster long, note string"), spark.createDataFrame([(7, 1, "text", 0.0, 9.0, [4, 5])], "document_id long, cluster long, context string, context_start double, context_end double, first_segment_ids array<long>"))
    assert {(r.note, r.source, r.primary_segment_id) for r in placed.collect()} == {("x", "text", 4), ("y", None, None)}


def test_lens_outcomes_keep_existing_ones_and_age(spark):
    days = [DAY + dt.timedelta(days=k) for k in range(90)]
    bars = spark.createDataFrame([(t, d, 100.0 + k * (1 if t == "A" else 0.5)) for t in ("A", "SPY") for k, d in enumerate(days)], "ticker string, ts timestamp, close double")
    sessions = spark.createDataFrame([(d, d + dt.timedelta(hours=14), d + dt.timedelta(hours=21)) for d in days], "session_date timestamp, market_open timestamp, market_close timestamp")
    snaps = spark.createDataFrame([(1, "A", days[50] + dt.timedelta(hours=22), "bullish"), (2, "A", days[5] + dt.timedelta(hours=22), "bearish"), (3, "A", days[20] + dt.timedelta(hours=22), "bearish")], "snapshot_id long, ticker string, as_of timestamp, direction string")
    first = L.lens_outcomes(snaps, bars, sessions, "SPY", str(days[75]))
    rows = {(r.snapshot_id, r.horizon): r for r in first.collect()}
    assert {k[0] for k in rows} == {1, 3} and rows[1, "5d"].regime == "up" and rows[3, "1d"].regime == "unknown"
    assert rows[1, "5d"].return_pct == pytest.approx(155 / 150 - 1) and rows[1, "5d"].excess_pct == pytest.approx(155 / 150 - 127.5 / 125) and rows[1, "5d"].direction_correct
    held = first.where("horizon = '5d'").withColumn("return_pct", F.lit(9.0))
    again = {(r.snapshot_id, r.horizon): r for r in L.lens_outcomes(snaps, bars, sessions, "SPY", str(days[75]), existing=held).collect()}
    assert again.keys() == rows.keys() and all((r.return_pct == 9.0) == (k[1] == "5d") for k, r in again.items())


def test_digest_counts_and_small_rules(spark):
    view = spark.createDataFrame([("A", DAY, 0.004, 12.0, "mixed", float("nan")), ("B", DAY, 1.5, None, " ", 3.0)], "ticker string, ts timestamp, dividend_yield double, forward_pe double, ma_alignment string, rsi_14 double")
    got = {(r.ticker, r.path): (r.value, r.label, r.unit) for r in R.measures(view).collect()}
    assert got == {("A", "valuation.dividend_yield"): (0.4, None, "percent"), ("A", "valuation.forward_pe"): (12.0, None, "ratio"), ("A", "indicators.ma_alignment"): (None, "mixed", "categorical"), ("B", "valuation.dividend_yield"): (1.5, None, "percent"), ("B", "indicators.rsi_14"): (3.0, None, "index_0_100")}
    assert "indicators.ma_alignment" in R.measures(view).where("ticker = 'B'").first().missing
    screened = spark.createDataFrame([("A", True, None), ("B", False, None), ("C", None, "timeout")], "ticker string, passed boolean, error string")
    assert tuple(S.screen_counts(screened).first()) == (3, 2, 1, 1)
    levels = spark.createDataFrame([("high", "low", "low"), ("low", "high", "low"), ("medium", "high", "medium"), ("odd", "high", "low"), (None, "high", "low"), ("high", None, "low"), ("high", "high", "high")], "a string, b string, want string")
    assert levels.where(Z.bounded_confidence(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    texts = spark.createDataFrame([("x" * 300,), (None,), ("short",)], "t string").select(T.summary(F.col("t")).alias("s"), T.wrapped(F.col("t")).alias("w")).collect()
    assert [r.s and len(r.s) for r in texts] == [240, None, 5] and texts[0].s.endswith("…") and [len(r.w) for r in texts] == [1, 0, 1]
    trades = spark.createDataFrame([("s", "A", DAY + dt.timedelta(days=9 * k), DAY + dt.timedelta(days=9 * k), DAY + dt.timedelta(days=9 * k + 5), 0.1, 0.01 * (k % 4 - 1), 0.0, 5) for k in range(12)], "strategy string, ticker string, as_of timestamp, entry_at timestamp, exit_at timestamp, weight double, return_pct double, benchmark_return_pct double, hold_days int")
    plain, over = (X.run_metrics(trades, rf=rf).first() for rf in (0.0, 0.05))
    assert over["sharpe"] < plain["sharpe"] and over["volatility"] == plain["volatility"]
