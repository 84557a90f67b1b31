"""Operators against known values."""

from datetime import datetime as D

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from callbook.functions import setup, stats, text
from callbook.operators import bars as B
from callbook.operators import indicators as I
from callbook.operators import windows
from callbook.plans import outcomes as O
from callbook.plans import portfolio as P
from callbook.plans import research as R
from callbook.plans import scoring as S
from callbook.plans import screener as SC
from callbook.plans import signals as G
from callbook.plans import strategies as X
from callbook.sources import tables as IO

BAR = "ticker string, ts timestamp, open double, high double, low double, close double, volume bigint"
CALL = "call_id long, document_id long, creator_id long, ticker string, posted_at timestamp, direction string, entry_type string, entry_price double, target_price double, stop_price double, final_confidence double, status string"


def day(n, month=5):
    return D(2026, month, n)


def bars_of(spark, rows):
    return spark.createDataFrame(rows, BAR)


def call(i=1, **kw):
    base = dict(call_id=i, document_id=i, creator_id=1, ticker="AAA", posted_at=day(3), direction="long", entry_type="market", entry_price=None, target_price=None, stop_price=None, final_confidence=0.8, status="accepted")
    return tuple({**base, **kw}.values())


def sessions_of(spark, days):
    return spark.createDataFrame([(d, d.replace(hour=13, minute=30), d.replace(hour=20)) for d in days], "session_date timestamp, market_open timestamp, market_close timestamp")


def series(ticker, first, closes):
    return [(ticker, D(2026, 5, first + k), c, c * 1.01, c * 0.99, c, 1000) for k, c in enumerate(closes)]


@pytest.mark.parametrize(
    ("entry", "direction", "price", "bar", "want"),
    [
        ("market", "long", None, (100.0, 102.0, 98.0), 100.0),
        ("limit", "long", 99.0, (100.0, 102.0, 98.0), 99.0),
        ("limit", "long", 101.0, (100.0, 102.0, 98.0), 100.0),
        ("limit", "short", 101.0, (100.0, 102.0, 98.0), 101.0),
        ("limit", "short", 99.0, (100.0, 102.0, 98.0), 100.0),
        ("limit", "unspecified", 99.0, (100.0, 102.0, 98.0), None),
        ("limit", "long", None, (100.0, 102.0, 98.0), None),
        ("trigger_above", "long", 101.0, (100.0, 102.0, 98.0), 101.0),
        ("trigger_above", "long", 99.0, (100.0, 102.0, 98.0), 100.0),
        ("trigger_above", "long", 103.0, (100.0, 102.0, 98.0), None),
        ("trigger_below", "short", 99.0, (100.0, 102.0, 98.0), 99.0),
        ("trigger_below", "short", 97.0, (100.0, 102.0, 98.0), None),
    ],
)
def test_entry_fill(spark, entry, direction, price, bar, want):
    df = spark.createDataFrame([(entry, direction, price, *bar)], "e string, d string, p double, o double, h double, l double")
    assert df.select(O.entry_fill(*[F.col(c) for c in "edpohl"])).first()[0] == want


def test_outcome_of_three_bars(spark):
    own = [("AAA", day(4), 100.0, 102.0, 98.0, 101.0, 1), ("AAA", day(5), 102.0, 105.0, 100.0, 104.0, 1), ("AAA", day(6), 104.0, 108.0, 102.0, 107.0, 1), ("AAA", day(7), 107.0, 109.0, 106.0, 108.0, 1)]
    ref = [("SPY", day(4), 500.0, 501.0, 499.0, 500.0, 1), ("SPY", day(5), 500.0, 502.0, 499.0, 501.0, 1), ("SPY", day(6), 501.0, 503.0, 500.0, 502.0, 1), ("SPY", day(7), 502.0, 504.0, 501.0, 503.0, 1)]
    calls = spark.createDataFrame([call(target_price=107.5, stop_price=90.0), call(2, ticker="NONE"), call(3, entry_type="limit", entry_price=50.0)], CALL)
    got = {(r["call_id"], r["horizon"]): r for r in O.evaluate(calls, bars_of(spark, own + ref), sessions_of(spark, [day(n) for n in (4, 5, 6, 7)]), "SPY").collect()}
    r = got[1, "3d"]
    assert [round(r[c], 6) for c in ("gross_return_pct", "return_pct", "mfe", "mae", "benchmark_return_pct", "excess_return_pct")] == [0.07, 0.069, 0.08, -0.02, 0.004, 0.065]
    assert r["hit_target"] is True and r["hit_stop"] is False
    # the horizon of 5 days is still open, the limit may still trigger, and a ticker without bars is missing
    assert set(got) == {(1, "1d"), (1, "3d")} | {(2, h) for h in O.HORIZONS}
    assert got[2, "1d"]["status"] == "data_missing"


def test_scorecard(spark):
    returns = [0.05, 0.02, -0.01, 0.08, None, -0.03]
    outs = spark.createDataFrame([(i, "5d", v is not None, v, v, v, "evaluated" if v is not None else "not_triggered") for i, v in enumerate(returns)], "call_id long, horizon string, activated boolean, return_pct double, excess_return_pct double, mae double, status string")
    calls = spark.createDataFrame([call(i, posted_at=day(1 + 3 * i)) for i in range(6)], CALL)
    cards = {r["window_label"]: r for r in S.creator_scorecards(outs, calls, "2026-06-01 00:00:00").collect()}
    r = cards["all"]
    assert (r["n_calls"], r["n_activated"]) == (6, 5) and r["hit_rate"] == pytest.approx(3 / 5) and r["mean_return"] == pytest.approx(0.022) and r["activation_rate"] == pytest.approx(5 / 6)
    assert S.creator_scorecards(outs, calls, "2028-01-01 00:00:00", {"90d": 90}).count() == 0


def test_wilson_of_nothing(spark):
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 1.0)


def test_ledger(spark):
    rows = [(1, "A", "buy", 10.0, 100.0, "USD", 0.0, day(1)), (2, "A", "buy", 30.0, 200.0, "USD", 0.0, day(2)), (3, "B", "buy", 10.0, 100.0, "USD", 25.0, day(1)), (4, "C", "sell", 1.0, 5.0, "USD", 0.0, day(1)),
            (5, "D", "buy", 10.0, 10.0, "USD", 0.0, day(1)), (6, "D", "sell", 10.0, 12.0, "USD", 1.0, day(2)), (7, "E", "buy", 1.0, 1.0, "USD", 0.0, day(1)), (8, "E", "buy", 1.0, 1.0, "EUR", 0.0, day(2)), (9, "F", "gift", 1.0, 1.0, "USD", 0.0, day(1))]
    trades = spark.createDataFrame(rows, "id long, ticker string, side string, quantity double, price_per_share double, currency string, fees double, traded_at timestamp")
    got = {r["ticker"]: r for r in P.fold_ledger(trades).collect()}
    assert (got["A"]["quantity"], got["A"]["cost_basis"]) == (40.0, 7000.0) and got["B"]["cost_basis"] == 1025.0
    assert (got["D"]["quantity"], got["D"]["cost_basis"], got["D"]["realized"]) == (0.0, 0.0, 19.0)
    assert [got[t]["error"] for t in "ACEF"] == [None, "oversell", "mixed currency", "unknown side"]


def test_policy_band(spark):
    view = spark.createDataFrame([("A", 10.8, True), ("B", 89.2, True)], "ticker string, market_value double, is_open boolean")
    targets = spark.createDataFrame([("A", 0.06), ("Z", 0.05)], "ticker string, target double")
    got = {r["ticker"]: r["status"] for r in P.policy_view(view, targets).collect()}
    assert got == {"A": "trim", "B": "no_target", "Z": "add"}
    unpriced = view.union(spark.createDataFrame([("C", None, True)], view.schema))
    assert {r["status"] for r in P.policy_view(unpriced, targets).collect()} == {None}


def test_indicators(spark):
    flat = I.panel(bars_of(spark, [("A", D(2026, 1, 1 + k), 100.0, 101.0, 99.0, 100.0, 5) for k in range(25)])).orderBy("ts").collect()[-1]
    assert flat["consolidation_20"] == pytest.approx(0.02) and flat["rsi_14"] == 50.0 and flat["sma_50"] is None and flat["atr_14"] == pytest.approx(2.0)
    up = I.panel(bars_of(spark, series("A", 1, [100.0 + k for k in range(20)]))).orderBy("ts").collect()[-1]
    assert up["rsi_14"] == 100.0 and up["return_5"] == pytest.approx(119 / 114 - 1)


def test_swings_are_confirmed_later(spark):
    closes = [10.0, 11.0, 12.0, 13.0, 14.0, 20.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0]
    got = I.swings(bars_of(spark, series("A", 1, closes))).collect()
    assert [(r["bar_no"], r["kind"], r["confirmed_no"]) for r in got] == [(6, "high", 11)]


def test_latest_close_looks_back_only_so_far(spark):
    bars = bars_of(spark, series("A", 1, [1.0, 2.0]))
    events = spark.createDataFrame([(1, "A", D(2026, 5, 2, 12)), (2, "A", D(2026, 5, 20)), (3, "A", D(2026, 7, 20)), (4, "A", D(2026, 4, 1))], "id long, ticker string, at timestamp")
    got = {r["id"]: r["close"] for r in B.latest_close(events, bars, "at").collect()}
    assert got == {1: 2.0, 2: 2.0, 3: None, 4: None}


def test_actions(spark):
    cases = [("insufficient_data", "low", True, "N/A"), ("skip_for_now", "high", True, "AVOID"), ("extended_risk", "medium", True, "REDUCE"), ("research_candidate", "high", True, "BUY"), ("research_candidate", "high", None, "ACCUMULATE"),
             ("research_candidate", "low", True, "HOLD"), ("watch", "high", False, "HOLD"), ("watch", "low", False, "WAIT"), ("wait_for_setup", "low", False, "WAIT")]
    df = spark.createDataFrame(cases, "s string, c string, e boolean, want string")
    assert df.select(setup.action(F.col("s"), F.col("c"), F.col("e"))["label"].alias("got"), "want").where("got <> want").count() == 0


def test_segments_merge_and_split(spark):
    rows = [(1, 0, 0.0, 2.0, "one"), (1, 1, 2.5, 4.5, "two"), (1, 2, 10.0, 11.0, "  "), (1, 3, 20.0, 22.0, "three"), (2, 0, 0.0, 30.0, "long"), (2, 1, 30.5, 31.0, "next")]
    got = windows.consolidate(spark.createDataFrame(rows, "document_id long, segment_id long, start_seconds double, end_seconds double, text string"))
    assert sorted((r["document_id"], r["window_no"], r["text"]) for r in got.collect()) == [(1, 0, "one two"), (1, 1, "three"), (2, 0, "long"), (2, 1, "next")]


def test_mentions(spark):
    detect = text.detector({"NVDA": "Nvidia", "AMD": "AMD", "AAPL": "Apple", "AI": "C3", "BRK-B": "Berkshire Hathaway", "ON": "Onsemi", "IT": "Gartner"}, {"in video": "NVDA"})
    cases = {
        "Buy $NVDA and AMD; AI helps apple, in video and a m d.": [("NVDA", "dollar"), ("AMD", "cased"), ("AI", "cased"), ("AAPL", "company_name"), ("NVDA", "asr_map"), ("AMD", "spelled_out")],
        "go ON with IT": [], "$BRK.B or BRK.B": [("BRK-B", "dollar"), ("BRK-B", "cased")], "N V D A": [("NVDA", "spelled_out")], "$ON it goes": [("ON", "dollar")], None: [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.select("t", detect("t").alias("m")).collect():
        assert [(m["ticker"], m["method"]) for m in r["m"]] == cases[r["t"]], r["t"]
        assert all(r["t"][m["start"] : m["end"]] == m["matched"] for m in r["m"])


def test_calibration_needs_enough_rows(spark):
    df = spark.createDataFrame([("s", i / 9, 1) for i in range(9)], "strategy string, score double, hit int")
    assert X.calibrate(df).count() == 0
    assert X.config_hash({"b": 1, "a": 2}) == X.config_hash({"a": 2, "b": 1}) and len(X.config_hash({})) == 16


def test_reviews(spark):
    schema = "call_id long, manual_status string, notes string, reviewed_at timestamp"
    calls = spark.createDataFrame([(1, "unreviewed", None, None), (2, "confirmed", "x", day(1)), (3, "flagged", None, day(1))], schema)
    reviews = spark.createDataFrame([(1, "confirmed", "good", day(2)), (2, "unreviewed", None, day(2))], schema)
    got = {r["call_id"]: (r["manual_status"], r["notes"], r["reviewed_at"]) for r in G.review_calls(calls, reviews).collect()}
    assert got == {1: ("confirmed", "good", day(2)), 2: ("unreviewed", "x", None), 3: ("flagged", None, day(1))}
    with pytest.raises(Exception, match="unknown manual_status approved"):
        G.review_calls(calls, spark.createDataFrame([(3, "approved", None, day(2))], schema)).collect()


def test_flags_and_peers(spark):
    metrics = "ticker string, forward_pe double, peg_ratio double, ev_to_ebitda double, earnings_growth double, days_to_earnings int, price_vs_sma_200 double"
    rows = [("A", 20.0, None, None, -0.1, 30, 0.3), ("B", 40.0, 1.0, None, -0.1, 31, 0.31), ("C", 40.0, -1.0, -2.0, -0.1, -1, None), ("D", 10.0, None, None, 0.1, 0, None), ("E", None, None, None, -0.5, None, None)]
    got = {r["ticker"]: r["f"] for r in spark.createDataFrame(rows, metrics).select("ticker", SC.flags(SC.ScreenConfig()).alias("f")).collect()}
    assert got == {"A": ["cheap_for_a_reason", "earnings_in_30d"], "B": ["cheap_for_a_reason", "extended_above_200d"], "C": [], "D": ["earnings_in_0d"], "E": []}
    ratios = spark.createDataFrame([("X", 10.0, 0.5), ("Y", 20.0, 0.1), ("Z", 500.0, None), ("T", 40.0, 0.1)], "ticker string, forward_pe double, profit_margins double")
    ratios = ratios.withColumns({c: F.lit(None).cast("double") for c in SC.BOUNDS if c not in ratios.columns})
    peers = spark.createDataFrame([("T", p) for p in ("X", "Y", "Z", "T", "none")] + [("U", "none")], "target string, peer string")
    got = {r["target"]: r for r in SC.peer_medians(peers, ratios).collect()}
    assert got["T"]["peers"] == ["X", "Y"] and got["T"]["median_forward_pe"] == 15.0 and got["U"]["n_peers"] == 0 and got["U"]["median_forward_pe"] is None
    r = SC.relative_value(peers, ratios).first()
    assert (r["value"], r["margin"], r["growth"]) == ("rich", "lower", "unknown")


def test_status_chain(spark):
    """A healthy pullback is a candidate; without relative strength and style it is watched; blockers decide alone."""
    base = dict(bar_no=300, close=100.0, setup_type="uptrend_pullback", setup_confidence="medium", ma_alignment="bullish_stack", sma_50_slope_21=0.02, rs_63=0.04, rs_126=0.02, rsi_14=55.0, breakout_63=-0.08, consolidation_20=0.07, pullback_63=0.08, dist_sma_50=0.01, sma_50=99.0, ema_21=99.5, base_low_60=85.0, base_high_60=109.0, recent_high_63=109.0, atr_14=2.0, support=95.0, resistance=108.0, n=0)
    rows = [base, base | {"n": 1, "ema_21": 120.0, "dist_sma_50": 0.2, "rs_63": -0.1}, base | {"n": 2, "setup_type": "downtrend", "sma_50_slope_21": -0.01}, base | {"n": 3, "setup_type": "range_bound", "rsi_14": 28.0}, base | {"n": 4, "setup_type": "extended_momentum", "rsi_14": 80.0}, base | {"n": 5, "setup_type": "insufficient_data"}, base | {"n": 6, "sma_50_slope_21": None, "ma_alignment": "mixed"}]
    got = {r["n"]: r for r in R.judged(spark.createDataFrame([Row(**r) for r in rows])).collect()}
    state = {n: (r["status"], r["status_confidence"], r["action"], r["primary_style"]) for n, r in got.items()}
    assert state[0] == ("research_candidate", "high", "BUY", "trend_pullback") and got[0]["pass_rate"] == 1.0
    assert state[1] == ("watch", "medium", "WAIT", "trend_pullback")
    assert state[2] == ("skip_for_now", "medium", "AVOID", "not_suitable_now") and got[2]["pass_rate"] == 0.0
    assert state[3] == ("wait_for_setup", "medium", "WAIT", "mean_reversion")
    assert state[4] == ("extended_risk", "medium", "REDUCE", "not_suitable_now")
    assert state[5][0] == "insufficient_data" and state[5][2] == "N/A" and state[6][:2] == ("watch", "low")


def test_sources(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker,name,sector,source\n brk.b ,Berkshire,Finance,own\n,none,x,own\nAAPL,Apple,Tech,own\n")
    u = IO.read_universe(spark, str(tmp_path / "u.csv"))
    assert sorted(r["ticker"] for r in u.collect()) == ["AAPL", "BRK-B"] and IO.read_universe(spark, str(tmp_path / "u.csv"), "TECH").count() == 1
    (tmp_path / "g.jsonl").write_text('// note\n\n{"id": "1", "source_text": "buy", "expected": null}\n{"id": "2", "expected": {"ticker": "AMD"}}\n')
    assert [(r["id"], r["expected"] and r["expected"]["ticker"]) for r in IO.read_gold(spark, str(tmp_path / "g.jsonl")).orderBy("id").collect()] == [("1", None), ("2", "AMD")]
    raw = spark.createDataFrame([("yt", "a", [(0.0, "x"), (1.0, "y")]), ("yt", "a", [(0.0, "x")]), ("yt", "b", [(0.0, "z")])], "source_type string, external_id string, segments array<struct<start:double,text:string>>")
    docs, segments = IO.ingest_documents(spark.createDataFrame([("yt", "b")], "source_type string, external_id string"), raw)
    assert docs.count() == 1 and {r["external_id"] for r in segments.collect()} == {"a"}
    rows = spark.createDataFrame([("A", 1, ["x", "y"]), ("B", 0, [])], "ticker string, n_passed int, flags array<string>")
    IO.write_screen(rows, str(tmp_path / "s"), "2026-05-01")
    assert spark.read.csv(str(tmp_path / "s/day=2026-05-01/passing"), header=True).collect()[0]["flags"] == "x,y" and spark.read.csv(str(tmp_path / "s/day=2026-05-01/passing"), header=True).columns == list(SC.SCREEN_TABLE) and spark.read.json(str(tmp_path / "s/day=2026-05-01/full")).count() == 2
