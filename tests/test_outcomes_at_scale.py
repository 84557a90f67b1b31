"""Outcomes and scorecards: what is worked out once per bar, and counts of distinct calls without copies of the rows."""

import datetime as dt

from callbook.plans import outcomes as O
from callbook.plans import scoring as S


def _day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def test_spans_are_worked_out_once_per_bar(spark):
    bars = spark.createDataFrame([(t, _day(n), 10.0 + n, 11.0 + n, 9.0 + n, 10.0 + n, 5) for t in ("A", "T00") for n in range(40)], "ticker string, ts timestamp, open double, high double, low double, close double, volume long")
    sessions = spark.createDataFrame([(_day(n), _day(n, 14), _day(n, 21)) for n in range(40)], "session_date timestamp, market_open timestamp, market_close timestamp")
    got = {(r.ticker, r.a0): {s.horizon: s for s in r.spans} for r in O.horizon_spans(bars, sessions, "T00").collect()}
    assert set(got) == {(t, n) for t in ("A", "T00") for n in range(1, 41)}
    # activated on the bar of day 4, held over the sessions of days 4 to 6
    three = got["A", 5]["3d"]
    assert (three.horizon_end, three.covered_at, three.exit_at, three.exit_price, three.top, three.bottom) == (_day(6, 21), _day(7), _day(6), 16.0, 17.0, 13.0)
    assert abs(three.benchmark_return_pct - 2 / 14) < 1e-12
    assert got["A", 40]["1d"].covered_at is None and got["A", 40]["5d"].horizon_end is None and got["A", 40]["5d"].exit_at is None


def test_repeated_outcomes_count_their_call_once(spark):
    calls = spark.createDataFrame([(k, 1, "AB"[k % 2], _day(k)) for k in range(8)], "call_id long, creator_id long, ticker string, posted_at timestamp")
    rows = [(k, "5d", k > 1, 0.1 * k if k > 1 else None, 0.0, -0.1, "evaluated" if k > 1 else "not_triggered") for k in range(8)]
    rows += [(0, "5d", True, 0.3, 0.0, -0.1, "evaluated"), rows[3], rows[3]]
    outcomes = spark.createDataFrame(rows, "call_id long, horizon string, activated boolean, return_pct double, excess_return_pct double, mae double, status string")
    cards = S.creator_scorecards(outcomes, calls, _day(50))
    report = S.creator_report(outcomes, calls)
    card = cards.where("window_label = 'all'").first()
    assert (card.n_calls, card.n_activated, card.n_unique_tickers) == (8, 7, 2)
    assert report.first().n_calls == 7
    for df in (cards, report):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
