"""Trajectories of companies from long statement rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The labels that providers give to a line of a statement, the preferred one first.
LABELS = {
    ("financials", "revenue"): ("Total Revenue", "Operating Revenue", "Revenue"),
    ("financials", "operating_income"): ("Operating Income", "Operating Income As Reported", "Total Operating Income As Reported"),
    ("financials", "net_income"): ("Net Income", "Net Income Common Stockholders", "Net Income From Continuing Operation Net Minority Interest"),
    ("cashflow", "fcf"): ("Free Cash Flow", "Free Cashflow"),
    ("cashflow", "capex"): ("Capital Expenditure", "Capital Expenditures"),
    ("cashflow", "buyback"): ("Repurchase Of Capital Stock", "Net Common Stock Issuance"),
    ("balance_sheet", "current_assets"): ("Current Assets", "Total Current Assets"),
    ("balance_sheet", "current_liabilities"): ("Current Liabilities", "Total Current Liabilities"),
    ("balance_sheet", "debt"): ("Total Debt", "Net Debt"),
    ("balance_sheet", "equity"): ("Stockholders Equity", "Common Stock Equity", "Total Equity Gross Minority Interest"),
    ("balance_sheet", "cash"): ("Cash Cash Equivalents And Short Term Investments", "Cash And Cash Equivalents", "Cash Financial"),
    ("balance_sheet", "shares"): ("Ordinary Shares Number", "Share Issued"),
}
#: Bounds of the readings below.
GROWING, SHRINKING, STEADY = 0.05, -0.02, 0.02
MARGIN_MOVE = 0.01
SOUND_CURRENT, WEAK_CURRENT, LOW_DEBT, HIGH_DEBT = 1.5, 1.0, 0.5, 1.5
BUYING_BACK, DILUTING, HEAVY_CAPEX = 0.01, 0.03, 0.15
STATEMENTS = ("financials", "cashflow", "balance_sheet")


def _over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _some(x: Column) -> Column:
    """A figure of 0 says nothing in a ratio."""
    return F.nullif(x, F.lit(0.0))


def growth_quality(recent: Column, prior: Column) -> Column:
    """Direction of the last year's growth and, where the year before is known, whether growth gains or loses speed."""
    way = F.when(recent > GROWING, "growing").when(recent > SHRINKING, "stable").otherwise("declining")
    speed = F.when(F.abs(recent - prior) < STEADY, " (steady)").when(recent > prior, " (accelerating)").otherwise(" (decelerating)")
    return F.when(recent.isNull(), "unknown").otherwise(F.concat(way, F.coalesce(F.when(prior.isNotNull(), speed), F.lit(""))))


def margin_trajectory(oldest: Column, middle: Column, newest: Column) -> Column:
    """The latest known margin against the earliest known one of three years."""
    known = F.array_compact(F.array(oldest, middle, newest))
    first, last = F.get(known, F.lit(0)), F.get(known, F.size(known) - 1)
    return F.when(F.size(known) < 2, "unknown").when(last > first + MARGIN_MOVE, "expanding").when(last < first - MARGIN_MOVE, "compressing").otherwise("stable")


def balance_strength(current_ratio: Column, debt_to_equity: Column) -> Column:
    """Mean of one point per known ratio: +1 sound, 0 middling, -1 weak."""
    liquid = F.when(current_ratio > SOUND_CURRENT, 1).when(current_ratio > WEAK_CURRENT, 0).when(current_ratio.isNotNull(), -1)
    geared = F.when(debt_to_equity < LOW_DEBT, 1).when(debt_to_equity < HIGH_DEBT, 0).when(debt_to_equity.isNotNull(), -1)
    known = liquid.isNotNull().cast("int") + geared.isNotNull().cast("int")
    mean = (F.coalesce(liquid, F.lit(0)) + F.coalesce(geared, F.lit(0))) / F.nullif(known, F.lit(0))
    return F.when(known == 0, "unknown").when(mean > 0.5, "strong").when(mean < -0.5, "stressed").otherwise("adequate")


def capital_allocation(buyback_yield: Column, share_change: Column, capex_share: Column) -> Column:
    """What the cash is used for; the first that applies."""
    return F.when(buyback_yield > BUYING_BACK, "returning cash (buybacks)").when(share_change > DILUTING, "diluting").when(capex_share > HEAVY_CAPEX, "reinvesting (heavy capex)").otherwise("balanced")


def trajectories(statements: DataFrame, caps: DataFrame) -> DataFrame:
    """One row per ticker of statements (ticker, statement, label, fiscal_end, value); caps holds (ticker, market_cap).

    A line is read from its preferred label. Three-year figures take the best label that a statement has at all, and
    its values in the statement's three newest years; latest figures take the newest known value of the best label
    that has one. Values that are no finite number are unknown. All steps after the one shuffle by ticker stay in place.
    """
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    years = Window.partitionBy("ticker", "statement").orderBy(F.desc("fiscal_end"))
    rows = statements.repartition("ticker").withColumns({"v": finite, "k": F.dense_rank().over(years)})
    measure, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for (statement, name), labels in LABELS.items():
        here = (F.col("statement") == statement) & F.col("label").isin(*labels)
        measure = F.when(here, name).otherwise(measure)
        rank = F.when(here, F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int")).otherwise(rank)
    at = lambda n: F.max(F.when(F.col("k") == n, F.col("v"))).alias(f"y{n}")
    lines = rows.withColumns({"measure": measure, "rank": rank}).groupBy("ticker", "statement", "measure", "rank").agg(
        at(1), at(2), at(3), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("k"))).alias("latest"), F.collect_set("fiscal_end").alias("ends")
    )
    of = lambda name: F.col("measure") == name
    three = lambda name: F.min_by(F.struct("y1", "y2", "y3"), F.when(of(name), F.col("rank"))).alias(f"_{name}")
    latest = lambda name: F.min_by("latest", F.when(of(name) & F.col("latest").isNotNull(), F.col("rank"))).alias(f"_{name}")
    ends = lambda s: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("statement") == s, F.col("ends")))))).alias(f"_{s}")
    whole = lines.groupBy("ticker").agg(
        *[three(m) for m in ("revenue", "operating_income", "net_income", "shares")],
        *[latest(m) for m in ("fcf", "capex", "buyback", "current_assets", "current_liabilities", "debt", "equity", "cash")],
        *[ends(s) for s in STATEMENTS],
    ).join(caps.select("ticker", F.col("market_cap").alias("_cap")), "ticker", "left")
    year = lambda name, n: F.col(f"_{name}.y{n}")
    cap, capex = _some(F.col("_cap")), F.abs("_capex")
    growth = lambda n: _over(year("revenue", n) - year("revenue", n + 1), year("revenue", n + 1))
    margins = [_over(year("operating_income", n), year("revenue", n)) for n in (3, 2, 1)]
    spent = F.when(F.col("_buyback") < 0, -F.col("_buyback")).when(F.col("_buyback").isNotNull(), 0.0)
    has_revenue = F.coalesce(year("revenue", 1), year("revenue", 2), year("revenue", 3)).isNotNull()
    out = whole.select(
        "ticker",
        F.transform(F.coalesce(*[F.when(F.size(f"_{s}") > 0, F.col(f"_{s}")) for s in STATEMENTS]), lambda d: d.cast("string")).alias("fiscal_year_ends"),
        F.array_compact(F.array(*[F.when(F.size(f"_{s}") > 0, F.lit(s)) for s in STATEMENTS])).alias("sources"),
        *[year("revenue", 3 - i).alias(f"revenue_fy_minus_{2 - i}") for i in range(3)],
        growth(1).alias("revenue_yoy_recent"), growth(2).alias("revenue_yoy_prior"), F.when(has_revenue, growth_quality(growth(1), growth(2))).alias("revenue_quality"),
        *[m.alias(f"operating_margin_fy_minus_{2 - i}") for i, m in enumerate(margins)],
        margin_trajectory(*margins).alias("operating_margin_trajectory"),
        *[year("net_income", 3 - i).alias(f"net_income_fy_minus_{2 - i}") for i in range(3)],
        F.col("_fcf").alias("fcf"), (_some(F.col("_fcf")) / cap).alias("fcf_yield"), capex.alias("capex"), (_some(capex) / _some(year("revenue", 1))).alias("capex_pct_revenue"),
        _over(F.col("_current_assets"), F.col("_current_liabilities")).alias("current_ratio"), _over(F.col("_debt"), F.col("_equity")).alias("debt_to_equity"),
        F.col("_cash").alias("total_cash"), F.col("_debt").alias("total_debt"), (_some(F.col("_cash")) / cap).alias("cash_to_market_cap"),
        year("shares", 1).alias("shares_now"), (_some(year("shares", 1)) / _some(year("shares", 2)) - 1).alias("shares_yoy"), (spent / cap).alias("buyback_yield"),
    )
    return out.withColumns(
        {
            "balance_sheet_strength": balance_strength(F.col("current_ratio"), F.col("debt_to_equity")),
            "capital_allocation": capital_allocation(F.col("buyback_yield"), F.col("shares_yoy"), F.col("capex_pct_revenue")),
        }
    )
