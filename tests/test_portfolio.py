"""The ledger in two currencies and its totals."""

from datetime import datetime as D

import pytest

from callbook.plans import portfolio as P

TRADE = "id long, ticker string, side string, quantity double, price_per_share double, currency string, fees double, traded_at timestamp, eur_amount double"


@pytest.fixture
def ledger(spark):
    rows = [
        (1, "A", "buy", 10.0, 100.0, "USD", 0.0, D(2024, 5, 1), 900.0), (2, "A", "buy", 10.0, 200.0, "USD", 0.0, D(2024, 5, 2), 1900.0), (3, "A", "sell", 5.0, 300.0, "USD", 0.0, D(2024, 5, 3), 1400.0),
        (4, "B", "buy", 1.0, 50.0, "EUR", 0.0, D(2024, 5, 1), None),
        (5, "C", "buy", 2.0, 10.0, "USD", 0.0, D(2024, 5, 1), 18.0), (6, "C", "sell", 2.0, 20.0, "USD", 0.0, D(2024, 5, 4), 36.0),
    ]
    return P.fold_ledger(spark.createDataFrame(rows, TRADE))


def quotes(spark, *rows):
    return spark.createDataFrame(list(rows), "ticker string, price double, previous double, currency string")


def test_fold_in_eur(ledger):
    got = {r["ticker"]: r for r in ledger.collect()}
    assert (got["A"]["eur_cost_basis"], got["A"]["eur_realized"]) == (2100.0, 700.0)  # 2800 less 5 of 20; 1400 less 700
    assert (got["A"]["n_trades"], got["A"]["first_traded_at"], got["A"]["last_traded_at"]) == (3, D(2024, 5, 1), D(2024, 5, 3))
    assert (got["B"]["eur_cost_basis"], got["B"]["eur_realized"]) == (None, None)  # one trade without an amount
    assert (got["C"]["quantity"], got["C"]["eur_cost_basis"], got["C"]["eur_realized"]) == (0.0, 0.0, 18.0)


def test_views_and_totals(spark, ledger):
    view = P.positions(ledger, quotes(spark, ("A", 200.0, 190.0, "usd"), ("B", 60.0, 0.0, None)), 1.25)
    got = {r["ticker"]: r for r in view.collect()}
    assert (got["A"]["market_value_eur"], got["B"]["market_value_eur"], got["C"]["market_value"]) == (2400.0, 60.0, None)
    assert got["B"]["day_change"] is None and got["A"]["day_change"] == 150.0 and round(got["B"]["unrealized_pct"], 6) == 20.0
    assert (got["A"]["eur_avg_cost"], got["C"]["avg_cost"]) == (140.0, None)
    both = P.totals(view).first()
    assert (both["n_open"], both["market_value"], both["realized"], both["market_value_eur"]) == (2, None, None, 2460.0)
    no_rate = P.positions(ledger, quotes(spark, ("A", 200.0, 190.0, "usd"), ("B", 60.0, 0.0, "EUR")))
    assert P.totals(no_rate).first()["market_value_eur"] is None
    odd = P.positions(ledger, quotes(spark, ("A", 200.0, 190.0, "GBP"), ("B", 60.0, 55.0, "eur")), 1.25)
    assert [r["ticker"] for r in P.quote_errors(odd).collect()] == ["A"] and P.totals(odd).first()["market_value_eur"] is None
    dollars = P.totals(view.where("currency = 'USD'")).first()
    assert (dollars["market_value"], dollars["realized"]) == (3000.0, 750.0 + 20.0)
    assert P.totals(view.where("not is_open")).first()["market_value"] is None  # nothing held, nothing to sum


def test_oversell_stops_the_fold(spark):
    rows = [(1, "A", "buy", 1.0, 10.0, "USD", 0.0, D(2024, 5, 1), 9.0), (2, "A", "sell", 2.0, 10.0, "USD", 0.0, D(2024, 5, 2), 18.0), (3, "A", "buy", 5.0, 10.0, "USD", 0.0, D(2024, 5, 3), 45.0)]
    got = P.fold_ledger(spark.createDataFrame(rows, TRADE)).first()
    assert (got["error"], got["quantity"], got["cost_basis"]) == ("oversell", 1.0, 10.0)
