"""Statement trajectories against known values."""

from datetime import date

from callbook.plans import fundamentals as U

ROW = "ticker string, statement string, label string, fiscal_end date, value double"


def line(ticker, statement, label, *newest_first):
    return [(ticker, statement, label, date(2024 - i, 12, 31), v) for i, v in enumerate(newest_first)]


def test_trajectories(spark):
    rows = (
        line("AAA", "financials", "Total Revenue", 120.0, 110.0, 100.0)
        + line("AAA", "financials", "Revenue", 1.0, 1.0, 1.0)  # the preferred label wins
        + line("AAA", "financials", "Operating Income As Reported", 30.0, None, 20.0)
        + line("AAA", "cashflow", "Free Cash Flow", float("nan"), 8.0)  # not a number: the year before counts
        + line("AAA", "cashflow", "Free Cashflow", 99.0)
        + line("AAA", "cashflow", "Capital Expenditure", -30.0)
        + line("AAA", "cashflow", "Repurchase Of Capital Stock", -4.0)
        + line("AAA", "balance_sheet", "Current Assets", 40.0)
        + line("AAA", "balance_sheet", "Current Liabilities", 20.0)
        + line("AAA", "balance_sheet", "Total Debt", 10.0)
        + line("AAA", "balance_sheet", "Stockholders Equity", 100.0)
        + line("AAA", "balance_sheet", "Ordinary Shares Number", 105.0, 100.0)
        + line("BBB", "balance_sheet", "Total Current Assets", 9.0)
        + line("BBB", "balance_sheet", "Current Liabilities", 10.0)
    )
    caps = spark.createDataFrame([("AAA", 200.0), ("CCC", 1.0)], "ticker string, market_cap double")
    got = {r["ticker"]: r for r in U.trajectories(spark.createDataFrame(rows, ROW), caps).collect()}
    a, b = got["AAA"], got["BBB"]
    assert set(got) == {"AAA", "BBB"}
    assert a["fiscal_year_ends"] == ["2022-12-31", "2023-12-31", "2024-12-31"] and a["sources"] == ["financials", "cashflow", "balance_sheet"]
    assert (a["revenue_fy_minus_2"], a["revenue_fy_minus_1"], a["revenue_fy_minus_0"]) == (100, 110, 120)
    assert a["revenue_quality"] == "growing (steady)" and round(a["revenue_yoy_recent"], 4) == 0.0909
    assert (a["operating_margin_fy_minus_2"], a["operating_margin_fy_minus_1"], a["operating_margin_fy_minus_0"]) == (0.2, None, 0.25)
    assert a["operating_margin_trajectory"] == "expanding"
    assert (a["fcf"], a["fcf_yield"], a["capex"], a["capex_pct_revenue"], a["buyback_yield"]) == (8.0, 0.04, 30.0, 0.25, 0.02)
    assert (a["current_ratio"], a["debt_to_equity"], a["balance_sheet_strength"]) == (2.0, 0.1, "strong")
    assert round(a["shares_yoy"], 4) == 0.05 and a["capital_allocation"] == "returning cash (buybacks)"
    assert b["revenue_quality"] is None and b["operating_margin_trajectory"] == "unknown" and b["balance_sheet_strength"] == "stressed"
    assert (b["current_ratio"], b["fcf_yield"], b["capital_allocation"], b["fiscal_year_ends"]) == (0.9, None, "balanced", ["2024-12-31"])


def test_readings(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    quality = lambda r, p: one.select(U.growth_quality(F.lit(r).cast("double"), F.lit(p).cast("double"))).first()[0]
    assert [quality(None, 0.1), quality(0.06, None), quality(0.0, 0.05), quality(-0.1, -0.3), quality(0.1, 0.09)] == ["unknown", "growing", "stable (decelerating)", "declining (accelerating)", "growing (steady)"]
    allocation = lambda *x: one.select(U.capital_allocation(*[F.lit(v).cast("double") for v in x])).first()[0]
    assert [allocation(0.0, 0.04, 0.2), allocation(None, None, 0.2), allocation(None, 0.03, 0.15)] == ["diluting", "reinvesting (heavy capex)", "balanced"]
