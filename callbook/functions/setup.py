"""Setup, style fit, status, action and freshness as columns over a panel row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the setup cascade.
MIN_DOLLAR_VOLUME = 5_000_000.0
HIGH_ATR, HIGH_VOL = 0.08, 0.80
DOWN_SLOPE, UP_SLOPE = -0.005, 0.005
EXTENDED, OVERBOUGHT = 0.15, 75.0
PULLBACK = (0.04, 0.18)
NEAR_HIGH = 0.03
TIGHT, RANGE = 0.08, 0.10
BROKEN = (-0.03, -0.005, -0.10)  # distance to the 200-SMA, its slope, relative strength
#: Thresholds of style fits.
TIGHT_BASE, BASE_DEPTH = 0.05, 0.20
AT_HIGH = (-0.05, 0.02)
AT_EMA, AT_SMA = (-0.06, 0.04), (-0.08, 0.04)
LEADER, OUTPERFORMER = (0.05, 0.10), 0.03
OVERSOLD, STRETCHED = 30.0, 70.0
STYLES = ("momentum_breakout", "trend_pullback", "mean_reversion", "base_breakout", "relative_strength_leader", "not_suitable_now")
PREFERRED = {"strong_uptrend": "trend_pullback", "uptrend_pullback": "trend_pullback", "breakout_candidate": "momentum_breakout", "extended_momentum": "relative_strength_leader", "range_bound": "mean_reversion"}
UNSUITABLE = ("downtrend", "high_volatility_unstable", "low_liquidity", "insufficient_data", "extended_momentum", "unclear")
#: The order of statuses and confidences in a scan, and the healthy RSI.
STATUSES = ("research_candidate", "watch", "extended_risk", "wait_for_setup", "skip_for_now", "insufficient_data")
CONFIDENCES = ("high", "medium", "low")
HEALTHY_RSI = (40.0, 70.0)
RISING = ("strong_uptrend", "uptrend_pullback", "breakout_candidate")


def _is(condition: Column) -> Column:
    """A condition in which unknown counts as not met."""
    return F.coalesce(condition, F.lit(False))


def _percent(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", value * 100)


def dollars(value: Column) -> Column:
    """An amount in dollars as text, in billions, millions or thousands."""
    scaled = lambda unit, digits, mark: F.concat(F.lit("$"), F.format_string(f"%.{digits}f", value / unit), F.lit(mark))
    return F.when(value >= 1e9, scaled(1e9, 1, "B")).when(value >= 1e6, scaled(1e6, 1, "M")).when(value >= 1e3, scaled(1e3, 0, "K")).otherwise(scaled(1, 0, ""))


#: What is said against each setup.
AGAINST = {
    "high_volatility_unstable": ("High volatility on a strong base sometimes precedes large breakouts; rule out only after checking the chart.",),
    "downtrend": ("Downtrends end. Look for capitulation + base before re-engaging.",),
    "broken downtrend": ("Downtrends end. Look for capitulation + base before re-engaging.", "Counter-trend bounces can be sharp; don't confuse a bounce for a regime change."),
    "extended_momentum": ("Strong trends can stay extended longer than feels reasonable; not always a top.",),
    "uptrend_pullback": ("Pullbacks of this depth sometimes precede a deeper correction; watch the 50-day MA hold.",),
    "breakout_candidate": ("Breakouts fail more than they succeed; size and risk discipline matter.",),
    "strong_uptrend": ("No clean entry trigger from this snapshot alone; entries either chase or require pullback patience.",),
    "range_bound": ("Range trading rewards patience; ranges break eventually — direction is unknown.",),
}


def with_setup(rows: DataFrame) -> DataFrame:
    """Panel rows with rs_126 and, of the first rule that holds, setup_type, setup_confidence, setup_reasons and counterarguments.

    Only the number of the rule is found by trying them; what isn't asked for is not made.
    """
    c = F.col
    bull, bear = c("ma_alignment") == "bullish_stack", c("ma_alignment") == "bearish_stack"
    falling = bear & (c("sma_50_slope_21").isNull() | (c("sma_50_slope_21") < DOWN_SLOPE))
    broken = _is((c("dist_sma_200") < BROKEN[0]) & (c("sma_200_slope_63") < BROKEN[1]) & (c("rs_126") < BROKEN[2]))
    fresh = _is((c("breakout_63") > 0) & (c("breakout_63") <= NEAR_HIGH))
    tight = _is(c("consolidation_20") <= TIGHT)
    poised = tight & _is(c("breakout_63").between(-NEAR_HIGH, NEAR_HIGH))
    rising = _is(c("sma_50_slope_21") > UP_SLOPE)
    slope, zero = _percent(c("sma_50_slope_21")), F.lit(0.0)
    # The sentences of reasons. A null part leaves its sentence out.
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    down = [
        F.when(c("sma_50_slope_21").isNotNull(), say("50-day slope is ", slope, "% over 21 bars — pointing down.")),
        F.when(c("rs_126") < 0, say("Underperformed SPY by ", _percent(F.abs("rs_126")), "% over 126 bars.")),
    ]
    rules = [
        ((c("bar_no") < 200) | c("sma_200").isNull(), "insufficient_data", "low", [say("Only ", c("bar_no").cast("string"), " bars available; need ≥200 to evaluate the long-trend stack.")]),
        (_is(c("dollar_volume") < MIN_DOLLAR_VOLUME), "low_liquidity", "medium", [say("Dollar volume ", dollars(c("dollar_volume")), " below ", dollars(F.lit(MIN_DOLLAR_VOLUME)), " threshold.")]),
        (
            _is(c("atr_14_pct") > HIGH_ATR) | _is(c("realized_vol_21") > HIGH_VOL), "high_volatility_unstable", "medium",
            [say("ATR(14) is ", _percent(F.coalesce("atr_14_pct", zero)), "% of price or realized vol is ", _percent(F.coalesce("realized_vol_21", zero), 0), "% annualized — both stops and entries become wide.")],
        ),
        (_is(falling), "downtrend", "medium", ["MAs are stacked bearishly (price < 50 < 200).", *down]),
        (broken, "broken downtrend", "low", [say("Price is ", _percent(c("dist_sma_200")), "% below the 200-SMA with the 200-day slope still negative."), *down]),
        (
            bull & _is((c("dist_sma_50") > EXTENDED) & (c("rsi_14") > OVERBOUGHT)), "extended_momentum", "medium",
            [say("Price is ", _percent(c("dist_sma_50"), 0), "% above the 50-day MA — extended."), say("RSI(14) at ", F.format_string("%.0f", c("rsi_14")), " — overbought.")],
        ),
        (
            bull & _is(c("pullback_63").between(*PULLBACK)), "uptrend_pullback", "medium",
            [say("Bullish MA stack with a ", _percent(c("pullback_63")), "% pullback from the 63-bar high."), F.when(rising, say("50-day slope ", slope, "% over 21 bars — uptrend still intact."))],
        ),
        (
            bull & (poised | fresh), "breakout_candidate", "medium",
            [
                F.when(fresh, say("Fresh breakout: closed ", _percent(c("breakout_63")), "% above the 63-bar recent high.")).otherwise(say("Within ", _percent(F.abs("breakout_63")), "% of the 63-bar recent high — breakout setup.")),
                F.when(tight, say("Tight consolidation (", _percent(c("consolidation_20")), "% range over 20 bars).")),
            ],
        ),
        (bull & rising, "strong_uptrend", "medium", ["Bullish MA stack (price > 20 > 50 > 200).", say("50-day slope ", slope, "% over 21 bars — upward sloping.")]),
        (c("ma_alignment").isin("mixed", "insufficient") & _is(c("consolidation_20") <= RANGE), "range_bound", "medium", ["MAs are not stacked; price is consolidating in a tight range."]),
    ]
    rules.append((F.lit(True), "unclear", "low", ["No rule branch matched this combination of indicators + levels."]))
    texts = lambda items: F.array_compact(F.array(*[i if isinstance(i, Column) else F.lit(i) for i in items])).cast("array<string>")

    def chain(tests: list[Column], values: list[Column]) -> Column:
        out = F.when(tests[0], values[0])
        for test, value in zip(tests[1:], values[1:], strict=True):
            out = out.when(test, value)
        return out

    number = chain([test for test, *_ in rules], [F.lit(k) for k in range(len(rules))])
    of = lambda value: chain([F.col("_rule") == k for k in range(len(rules))], [value(*rule[1:]) for rule in rules])
    made = {
        "setup_type": of(lambda kind, sure, reasons: F.lit(kind.removeprefix("broken "))), "setup_confidence": of(lambda kind, sure, reasons: F.lit(sure)),
        "setup_reasons": of(lambda kind, sure, reasons: texts(reasons)), "counterarguments": of(lambda kind, sure, reasons: texts(AGAINST.get(kind, ()))),
    }
    return rows.withColumn("_rule", number).withColumns(made).drop("_rule")


def style_fit() -> Column:
    """array<struct<style, fit_level>> in the order of STYLES, of a panel row with its setup, ema_21 and relative strength."""
    c, kind = F.col, F.col("setup_type")
    near_high = _is(c("breakout_63").between(*AT_HIGH))
    tight, leads = _is(c("consolidation_20") <= TIGHT_BASE), _is(c("rs_63") > 0)
    breakout = kind == "breakout_candidate"
    momentum = F.when(breakout & tight & leads, "high").when((breakout | near_high) & (tight | leads), "medium").otherwise("low")
    pulled = _is(c("pullback_63").between(*PULLBACK))
    at_mean = _is((c("close") / c("ema_21") - 1).between(*AT_EMA)) | _is(c("dist_sma_50").between(*AT_SMA))
    pullback = (
        F.when(kind == "uptrend_pullback", F.when(at_mean, "high").otherwise("medium"))
        .when(kind == "strong_uptrend", F.when(pulled, "medium").otherwise("low"))
        .when((c("ma_alignment") == "bullish_stack") & pulled, "medium")
        .otherwise("low")
    )
    oversold, stretched = _is(c("rsi_14") <= OVERSOLD), _is(c("rsi_14") >= STRETCHED)
    reversion = F.when((kind == "range_bound") & oversold, "high").when((kind == "range_bound") & stretched, "medium").when(oversold & kind.isin("uptrend_pullback", "strong_uptrend"), "medium").otherwise("low")
    shallow = _is((c("base_high_60") > 0) & ((c("base_high_60") - c("base_low_60")) / c("base_high_60") < BASE_DEPTH))
    base = F.when(shallow & near_high & kind.isin("breakout_candidate", "strong_uptrend"), "high").when(shallow, "medium").otherwise("low")
    leader = _is((c("rs_63") > LEADER[0]) & (c("rs_126") > LEADER[1]))
    strength = F.when(leader, F.when(kind.isin(*RISING), "high").otherwise("medium")).when(_is(c("rs_63") > OUTPERFORMER) & kind.isin("strong_uptrend", "uptrend_pullback"), "medium").otherwise("low")
    blocked = F.when(kind.isin(*UNSUITABLE), "high").otherwise("low")
    return F.array(*[F.struct(F.lit(n).alias("style"), f.alias("fit_level")) for n, f in zip(STYLES, (momentum, pullback, reversion, base, strength, blocked), strict=True)])


def primary_style(fits: Column, kind: Column) -> Column:
    """The style that fits best; of equal ones the setup's preferred one, or else the first; null if all are low."""
    preferred = F.lit("not_suitable_now")
    for setup_type, style in PREFERRED.items():
        preferred = F.when(kind == setup_type, style).otherwise(preferred)
    at = lambda level: F.transform(F.filter(fits, lambda x: x["fit_level"] == level), lambda x: x["style"])
    best = lambda styles: F.when(F.array_contains(styles, preferred), preferred).otherwise(F.get(styles, F.lit(0)))
    return F.when(F.size(at("high")) > 0, best(at("high"))).otherwise(best(at("medium")))


RUBRIC = "array<struct<rule:string,weight:string,passed:boolean,value:string,threshold:string,note:string>>"
#: What a status says, notes of rules, and caveats.
SUMMARIES = {
    "insufficient_data": "Not enough price history loaded to evaluate this ticker yet.",
    "low_liquidity": "Liquidity is below the threshold for clean fills — skip until volume picks up.",
    "high_volatility_unstable": "Volatility is too high to size a position with a meaningful stop. Skip until ATR contracts.",
    "downtrend": "Bearish MA stack with weak slope — not a long-only setup.",
    "extended_momentum": "Strong trend but price is stretched well above the 50-SMA with overbought RSI — chase risk is high; wait for a pullback.",
    "watch": "Trend is intact but the trigger isn't fully formed — keep on the watchlist and revisit when the missing components show up.",
    "range_bound": "Range-bound. Wait for either a clean break or a tag of the range boundary with confirmation.",
    "unclear": "Indicators don't form a coherent setup right now.",
    "other": "Mixed signals — placeholder watch status; revisit after more data.",
}
NOTES = {
    "data_sufficiency": "Need ≥200 daily bars for the long-trend stack.",
    "rsi_in_range_40_70": "Inside the band = healthy; below 40 = oversold; above 70 = extended.",
    "has_clean_risk_reference": "An identifiable swing low or base low for placing an invalidation reference.",
}
CAVEATS = {
    "insufficient_data": "Increase history_days when fetching, or wait for more data to land.",
    "low_liquidity": "Liquidity is dynamic; a catalyst can change this quickly.",
    "high_volatility_unstable": "High vol on a constructive base sometimes precedes a clean breakout — chart context matters.",
    "downtrend": "Downtrends end. Re-evaluate once a base forms.",
    "extended_momentum": "Strong trends can stay extended; this is risk-management framing, not a top call.",
}
UNHEARD = "No transcript signals — read is technicals-only."
NO_REFERENCE = "No clean swing-low / base-low reference — entry-zone confidence is reduced."


def status(heard: Column | None = None) -> Column:
    """struct<status, confidence, summary, caveats, rubric> of a panel row with setup_type, style_fit, primary_style and, if known, support.

    Setups that rule a long position out decide by themselves; else six weighted rules do. A rule's value and threshold
    are text. heard: whether the ticker has signals or calls (none given: not).
    """
    c, kind = F.col, F.col("setup_type")

    def rule(name: str, weight: str, passed: Column | bool, value: Column, threshold: str) -> Column:
        parts = {"rule": F.lit(name), "weight": F.lit(weight), "passed": passed if isinstance(passed, Column) else F.lit(passed), "value": value.cast("string"), "threshold": F.lit(threshold), "note": F.lit(NOTES.get(name)).cast("string")}
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    fits = F.filter("style_fit", lambda x: x["style"] != "not_suitable_now")
    some = lambda *levels: F.exists(fits, lambda x: x["fit_level"].isin(*levels))
    stacked, rising, reference = c("ma_alignment") == "bullish_stack", _is(c("sma_50_slope_21") > 0), c("support").isNotNull() | c("base_low_60").isNotNull()
    # Names of rules.
    rules = {
        "ma_alignment_bullish": ("high", stacked, c("ma_alignment"), "bullish_stack"),
        "sma_50_slope_positive": ("high", rising, c("sma_50_slope_21"), "0.0"),
        "rs_vs_spy_63d_positive": ("medium", _is(c("rs_63") > 0), c("rs_63"), "0.0"),
        "rsi_in_range_40_70": ("low", _is(c("rsi_14").between(*HEALTHY_RSI)), c("rsi_14"), "40-70"),
        "has_clean_risk_reference": ("medium", reference, F.when(reference, "yes").otherwise("no"), "yes"),
        "style_fit_present": ("medium", some("high", "medium"), F.coalesce("primary_style", F.lit("none")), "non-low"),
    }
    passed = lambda weight: sum((p.cast("int") for w, p, *_ in rules.values() if w == weight), F.lit(0))
    n_high = sum(w == "high" for w, *_ in rules.values())
    whole = F.array(*[rule(n, w, p, v, t) for n, (w, p, v, t) in rules.items()])
    caveats = F.array_compact(F.array(F.when(~_is(heard if heard is not None else F.lit(False)), UNHEARD), F.when(~reference, NO_REFERENCE)))

    def to(state: str, sure: Column | str, summary: Column | str, caveats: Column, rubric: Column) -> Column:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(state).alias("status"), text(sure).alias("confidence"), text(summary).alias("summary"), caveats.cast("array<string>").alias("caveats"), rubric.cast(RUBRIC).alias("rubric"))

    def alone(state: str, sure: str, by: str, *rubric: Column) -> Column:
        return to(state, sure, SUMMARIES[by], F.array(F.lit(CAVEATS[by])), F.array(*rubric))

    trend = rule("ma_alignment_bullish", "high", False, c("ma_alignment"), "bullish_stack")
    ready = F.concat(F.lit("Constructive "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" with clean trend + style fit. Worth a closer look."))
    up = kind.isin(*RISING)
    return (
        F.when(kind == "insufficient_data", alone("insufficient_data", "low", "insufficient_data", rule("data_sufficiency", "high", False, F.coalesce(c("bar_no"), F.lit(0)), "200")))
        .when(kind == "low_liquidity", alone("skip_for_now", "medium", "low_liquidity", rule("dollar_volume_min", "high", False, c("dollar_volume"), "5000000")))
        .when(kind == "high_volatility_unstable", alone("skip_for_now", "medium", "high_volatility_unstable", rule("atr_pct_under_high", "high", False, c("atr_14_pct"), "0.08")))
        .when(kind == "downtrend", alone("skip_for_now", "medium", "downtrend", trend, rule("sma_50_slope_positive", "high", rising, c("sma_50_slope_21"), "0.0")))
        .when(
            kind == "extended_momentum",
            alone("extended_risk", "medium", "extended_momentum", rule("dist_to_sma_50_below_extended", "high", False, c("dist_sma_50"), "0.15"), rule("rsi_under_75", "medium", _is(c("rsi_14") <= OVERBOUGHT), c("rsi_14"), "75")),
        )
        .when(up & (passed("high") == n_high) & (passed("medium") >= 1) & some("high"), to("research_candidate", F.when(passed("medium") >= 2, "high").otherwise("medium"), ready, caveats, whole))
        .when(up & (passed("high") >= n_high - 1), to("watch", "medium", SUMMARIES["watch"], caveats, whole))
        .when(kind == "range_bound", to("wait_for_setup", "medium", SUMMARIES["range_bound"], caveats, whole))
        .when(kind == "unclear", to("wait_for_setup", "low", SUMMARIES["unclear"], caveats, whole))
        .otherwise(to("watch", "low", SUMMARIES["other"], caveats, whole))
    )


def action(status: Column, confidence: Column, entry_available: Column) -> Column:
    """struct<label, confidence> of a status, its confidence and whether an entry zone exists."""
    to = lambda label, sure: F.struct(F.lit(label).alias("label"), (sure if isinstance(sure, Column) else F.lit(sure)).alias("confidence"))
    high, medium = confidence == "high", confidence == "medium"
    candidate = F.when(high & _is(entry_available), to("BUY", "high")).when(high | medium, to("ACCUMULATE", "medium")).otherwise(to("HOLD", "low"))
    return (
        F.when(status == "insufficient_data", to("N/A", "low"))
        .when(status == "skip_for_now", to("AVOID", confidence))
        .when(status == "extended_risk", to("REDUCE", confidence))
        .when(status == "research_candidate", candidate)
        .when(status == "watch", F.when(high, to("HOLD", "medium")).otherwise(to("WAIT", confidence)))
        .when(status == "wait_for_setup", to("WAIT", confidence))
        .otherwise(to("HOLD", "low"))
    )


def pass_rate(rubric: Column) -> Column:
    """Share of passed rules among those that could be judged (passed not null)."""
    judged = F.filter(rubric, lambda r: r["passed"].isNotNull())
    return F.when(F.size(judged) > 0, F.size(F.filter(judged, lambda r: r["passed"])) / F.size(judged))


def bar_age(last: Column, as_of: Column) -> Column:
    """Whole days from a ticker's last bar to as_of."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(last)) / 86400).cast("int")


def enough_history(n_bars: Column) -> Column:
    """Whether all panels can be computed."""
    return n_bars >= 252


def freshness(n_bars: Column, last: Column, as_of: Column) -> Column:
    """Warnings about a ticker's bars: none, fewer than 200, or older than 7 days."""
    notes = F.array(F.when(n_bars == 0, "no_bars"), F.when((n_bars > 0) & (n_bars < 200), "short_history"), F.when(_is(bar_age(last, as_of) > 7), "stale"))
    return F.filter(notes, lambda n: n.isNotNull())
