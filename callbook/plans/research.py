"""Panels to ranked scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbook.functions import setup as U
from callbook.functions import zones as Z
from callbook.operators import bars as B
from callbook.operators import indicators as I
from callbook.operators import levels as L

#: More bars than any window of the panel and of the levels spans.
TAIL = 330


#: Columns of a view that levels, EMAs and excess returns give.
LEVELS = ("support", "resistance", "support_distance", "resistance_distance", "swing_highs", "swing_lows")
EXCESS = ("excess_5", "excess_21", "excess_63")


def research_panel(bars: DataFrame, benchmark: str) -> DataFrame:
    """Indicators, relative strength and setup of every ticker on every bar, in one pass over its bars."""
    return U.with_setup(I.panel(bars).join(I.relative_strength(bars, benchmark), ["ticker", "ts"], "left"))


def judged(panel: DataFrame, heard=None) -> DataFrame:
    """A panel with ema_21 (and, where known, support and resistance) and its style fits, status, entry zone and action."""
    panel = panel.withColumns({c: F.lit(None).cast("double") for c in ("support", "resistance") if c not in panel.columns})
    panel = panel.withColumns({c: F.lit(None).cast("double") for c in ("dollar_volume", "atr_14_pct") if c not in panel.columns})
    out = panel.withColumn("style_fit", U.style_fit()).withColumn("primary_style", U.primary_style(F.col("style_fit"), F.col("setup_type"))).withColumn("_s", U.status(heard))
    parts = {"status": "status", "confidence": "status_confidence", "summary": "status_summary", "caveats": "caveats", "rubric": "rubric"}
    out = Z.with_risk(out.withColumns({to: F.col(f"_s.{part}") for part, to in parts.items()}).drop("_s"))
    label = U.action(F.col("status"), F.col("status_confidence"), F.col("available"))
    return out.withColumns({"_a": label, "pass_rate": U.pass_rate(F.col("rubric"))}).withColumns({"action": F.col("_a.label"), "action_confidence": F.col("_a.confidence")}).drop("_a")


def research_view(bars: DataFrame, benchmark: str, coverage: DataFrame | None = None, context: DataFrame | None = None) -> DataFrame:
    """The whole view of every ticker on every bar, as it was known then: indicators, relative strength, excess returns,
    EMAs, levels, setup with reasons, style fits, status with its rubric, entry zone, action, and whether history suffices.

    coverage (ticker, has_signals, has_calls, has_claims) and context (ticker, as_of, ... of transcript_context, met where
    as_of falls on the bar's day) are joined where given; tickers that coverage lacks were never heard of.
    """
    at = ["ticker", "ts"]
    rows = research_panel(bars, benchmark).join(I.excess_returns(bars, benchmark), at, "left")
    rows = rows.join(I.ema(bars).select(*at, *[f"ema_{n}" for n in I.EMA]), at).join(L.levels(bars).select(*at, *LEVELS), at)
    heard = None
    if coverage is not None:
        flags = ("has_signals", "has_calls", "has_claims")
        rows = rows.join(coverage.select("ticker", *flags), "ticker", "left").na.fill(False, list(flags))
        heard = F.col("has_signals") | F.col("has_calls")
    out = judged(rows, heard).withColumn("enough_history", U.enough_history(F.col("bar_no")))
    if context is not None:
        said = context.withColumn("_day", F.to_date("as_of")).drop("setup_type")
        out = out.withColumn("_day", F.to_date("ts")).join(said, ["ticker", "_day"], "left").drop("_day")
    return out


def _rank(values: tuple[str, ...], column: str):
    at = F.array_position(F.array(*map(F.lit, values)), F.col(column))
    return F.when(at > 0, at).otherwise(F.lit(99))


def scan(tickers: DataFrame, bars: DataFrame, benchmark: str, as_of) -> DataFrame:
    """One ranked row per requested ticker as of a date, with its levels, status and action.

    Symbols are trimmed and upper-cased first; a ticker without bars is an insufficient_data row. Best status first, then
    its confidence, the setup's confidence, rows with a suitable style, and the ticker.
    """
    seen = bars.where(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    last = Window.partitionBy("ticker").orderBy(F.desc("ts"))
    newest = lambda rows, n=1: rows.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")
    # all windows of a ticker's newest bar lie in its last TAIL bars; only its EMA and its number look further back
    tail = newest(seen, TAIL)
    strength = newest(I.relative_strength(newest(B.align_benchmark(seen, benchmark), TAIL).drop("benchmark_close"), benchmark, aligned_with=seen))
    counts = seen.groupBy("ticker").agg(F.count(F.lit(1)).alias("bar_no"))
    rows = newest(I.panel(tail)).drop("bar_no").join(counts, "ticker").join(strength, ["ticker", "ts"], "left")
    rows = rows.join(newest(I.ema(seen, (21,))).select("ticker", "ema_21"), "ticker").join(newest(L.levels(tail)).select("ticker", *LEVELS), "ticker")
    newest = U.with_setup(rows)
    asked = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    out = asked.join(newest, "ticker", "left").withColumns({"setup_type": F.coalesce("setup_type", F.lit("insufficient_data")), "setup_confidence": F.coalesce("setup_confidence", F.lit("low"))})
    suited = F.coalesce(F.col("primary_style") != "not_suitable_now", F.lit(False))
    return judged(out).orderBy(_rank(U.STATUSES, "status"), _rank(U.CONFIDENCES, "status_confidence"), _rank(U.CONFIDENCES, "setup_confidence"), F.desc(suited), "ticker")


def scan_counts(scanned: DataFrame) -> DataFrame:
    """Rows of a scan: all, research candidates, watched, skipped, those without enough data, and those with an error (where the scan has that column)."""
    of = lambda state: F.count_if(F.col("status") == state)
    failed = F.col("error").isNotNull() if "error" in scanned.columns else F.lit(False)
    return scanned.agg(F.count_if(failed).alias("n_errors"), F.count(F.lit(1)).alias("n"), of("research_candidate").alias("n_research_candidates"), of("watch").alias("n_watch"), of("skip_for_now").alias("n_skip"), of("insufficient_data").alias("n_insufficient"))


def snapshot_history(snapshots: DataFrame, ticker: str, until, days: int, limit: int) -> DataFrame:
    """F8: a ticker's snapshots of the last days, oldest first."""
    end = F.lit(until).cast("timestamp")
    rows = snapshots.where((F.col("ticker") == ticker) & (F.col("as_of") <= end) & (F.col("as_of") >= end - F.expr(f"interval {days} days")))
    return rows.orderBy("as_of", "snapshot_id").limit(limit)


#: Fields of a digest and their units, by panel, as the columns of a view are named here.
CATALOGUE = {
    "valuation": {
        "market_cap": "usd", "forward_pe": "ratio", "trailing_pe": "ratio", "peg_ratio": "ratio", "price_to_sales_ttm": "ratio", "price_to_book": "ratio", "enterprise_to_ebitda": "ratio",
        "earnings_growth_forward": "fraction", "revenue_growth_yoy": "fraction", "profit_margins": "fraction", "float_shares": "shares", "shares_outstanding": "shares", "short_pct_of_float": "fraction",
        "held_pct_institutions": "fraction", "beta": "ratio", "dividend_yield": "percent", "days_to_next_earnings": "days", "sector": "categorical", "industry": "categorical",
    },
    "market": {"close": "price", "return_5": "fraction", "return_21": "fraction", "return_63": "fraction", "return_252": "fraction", "excess_21": "fraction", "pct_off_high_52w": "fraction", "pct_off_low_52w": "fraction", "dollar_volume": "usd"},
    "indicators": {
        "rsi_14": "index_0_100", "atr_14": "price", "atr_14_pct": "fraction", "ma_alignment": "categorical", "sma_50_slope_21": "fraction", "sma_200_slope_63": "fraction",
        "dist_sma_50": "fraction", "dist_sma_200": "fraction", "realized_vol_21": "fraction", "rs_63": "fraction",
    },
    "levels": {"support": "price", "resistance": "price", "recent_high_63": "price", "base_low_60": "price", "pullback_63": "fraction", "breakout_63": "fraction"},
}


def dividend_yield(value: Column) -> Column:
    """A yield as percent: one between 0 and 0.05 is a share, since no payer yields so little."""
    return F.when((value > 0) & (value < 0.05), value * 100).otherwise(value)


def measures(view: DataFrame, catalogue: dict[str, dict[str, str]] = CATALOGUE) -> DataFrame:
    """One row per ticker, bar and known field of the catalogue: path (panel.field), value, label (of categorical fields), unit, and all missing paths.

    Fields that the view has no column for are missing. A text without letters counts as missing.
    """
    known, missing = [], []
    for panel, fields in catalogue.items():
        for field, unit in fields.items():
            path = f"{panel}.{field}"
            there = F.col(field) if field in view.columns else F.lit(None).cast("string")
            text = unit == "categorical"
            label = F.nullif(F.trim(there.cast("string")), F.lit("")) if text else F.lit(None).cast("string")
            value = F.lit(None).cast("double") if text else F.nanvl(there.cast("double"), F.lit(None).cast("double"))
            value = dividend_yield(value) if field == "dividend_yield" else value
            one = F.struct(F.lit(path).alias("path"), value.alias("value"), label.alias("label"), F.lit(unit).alias("unit"))
            held = (label if text else value).isNotNull()
            known.append(F.when(held, one))
            missing.append(F.when(~held, F.lit(path)))
    rows = view.select("ticker", "ts", F.array_compact(F.array(*missing)).alias("missing"), F.explode(F.array_compact(F.array(*known))).alias("m"))
    return rows.select("ticker", "ts", "m.*", "missing")


def panel_digest(panel: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row per ticker, bar and known field (field, value, unit) of a wide panel; unknown fields are listed in `missing`, one row's list on each of its rows."""
    known = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.lit(u).alias("unit"))) for f, u in fields.items()]))
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in fields]))
    return panel.select("ticker", "ts", missing.alias("missing"), F.explode(known).alias("d")).select("ticker", "ts", "d.field", "d.value", "d.unit", "missing")
