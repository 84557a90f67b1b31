"""Entry zones, exits, picks and reward to risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "struct<kind:string,trigger:double,low:double,high:double,invalidation:double>"


def _zone(kind: str, trigger: Column, low: Column, high: Column, invalidation: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), trigger.alias("trigger"), low.alias("low"), high.alias("high"), invalidation.alias("invalidation"))


def breakout_zone() -> Column:
    """Half an ATR above the 63-bar high; void under the base's low or 1.5 ATR under the trigger, whichever is nearer."""
    top, atr = F.col("recent_high_63"), F.col("atr_14")
    return F.when(top.isNotNull(), _zone("breakout", top, top, top + 0.5 * atr, F.greatest(F.col("base_low_60"), top - 1.5 * atr)))


def pullback_zone() -> Column:
    """Between the 21-EMA and the 50-SMA; void under the nearest support, the SMA less an ATR or the zone less 1.5 ATR, whichever is nearest."""
    e, s, atr = F.col("ema_21"), F.col("sma_50"), F.col("atr_14")
    low, high = F.least(e, s), F.greatest(e, s)
    support = F.when(F.col("support") < low, F.col("support"))
    return F.when(low.isNotNull(), _zone("pullback", F.coalesce(e, s), low, F.when(high == low, low + 0.5 * atr).otherwise(high), F.greatest(support, s - atr, low - 1.5 * atr)))


def range_zone() -> Column:
    """Half an ATR above the low of the 60-bar range, void half an ATR under it."""
    low, atr = F.col("base_low_60"), F.col("atr_14")
    return F.when(low.isNotNull() & F.col("base_high_60").isNotNull(), _zone("range", low, low, low + 0.5 * atr, low - 0.5 * atr))


def entry_zone() -> Column:
    """Struct of the zone that suits a row's setup, null where none does or the close or ATR is unknown."""
    s = F.col("setup_type")
    chased = F.coalesce(F.col("pullback_63") >= 0.04, F.lit(False))
    zone = F.when(s == "breakout_candidate", breakout_zone()).when((s == "uptrend_pullback") | ((s == "strong_uptrend") & chased), pullback_zone()).when(s == "range_bound", range_zone())
    return F.when(F.col("close").isNotNull() & F.col("atr_14").isNotNull(), zone)


def dual_entry_zones() -> Column:
    """struct<breakout, pullback> of both zones whatever the setup, each null where its levels, the close or the ATR are unknown."""
    known = F.col("close").isNotNull() & F.col("atr_14").isNotNull()
    return F.struct(F.when(known, breakout_zone()).alias("breakout"), F.when(known, pullback_zone()).alias("pullback"))


#: Cushions, offsets and extensions of exits, the widths of a usable entry band, and the distance of a stop set anew.
CUSHION, RUNNER_OFFSET, EXTENSIONS = 0.25, 1.5, (1.272, 1.618)
BAND = (0.05, 5.0)
SNAP = 0.75
BANDS = "array<struct<low:double,high:double>>"


def candidate_levels(rows: DataFrame) -> DataFrame:
    """Rows with breakout_entry and pullback_entry (struct<low, high>), primaries and runners (arrays of them) and invalidations.

    rows hold close, atr_14, recent_high_63, base_low_60, support, resistance and what dual_entry_zones reads. Entry bands
    without width, or under 0.05 or over 5 ATR wide, are left out. Invalidations stand below all entry bands, each once
    (by four decimals), in order.
    """
    c, atr = F.col, F.col("atr_14")
    cushion = F.coalesce(CUSHION * atr, F.lit(0.0))
    band = lambda low: F.struct(low.alias("low"), (low + cushion).alias("high"))
    rows = rows.withColumn("_z", dual_entry_zones())

    def entry(kind: str) -> Column:
        low, high = c(f"_z.{kind}.low"), c(f"_z.{kind}.high")
        width = high - low
        bad = (atr > 0) & ((width <= 0) | (width < BAND[0] * atr) | (width > BAND[1] * atr))
        return F.when(c(f"_z.{kind}").isNotNull() & ~F.coalesce(bad, F.lit(False)), F.struct(low.alias("low"), high.alias("high")))

    rows = rows.withColumns({"breakout_entry": entry("breakout"), "pullback_entry": entry("pullback")})
    near = F.when(c("resistance") > c("close"), c("resistance"))
    high = F.when((c("recent_high_63") > c("close")) & ~F.coalesce(F.abs(c("recent_high_63") - near) < atr, F.lit(False)), c("recent_high_63"))
    ahead = lambda m: c("base_low_60") + (c("recent_high_63") - c("base_low_60")) * m
    extension = lambda m: F.when((c("recent_high_63") > c("base_low_60")) & (ahead(m) + cushion > c("close")), ahead(m))
    present = lambda *lows: F.array_compact(F.array(*[F.when(x.isNotNull(), band(x)) for x in lows])).cast(BANDS)
    none = F.array().cast(BANDS)
    rows = rows.withColumn("primaries", F.when(c("close") > 0, present(near, high, extension(EXTENSIONS[0]))).otherwise(none))
    trail = F.transform("primaries", lambda p: band(p["high"] + RUNNER_OFFSET * atr))
    rows = rows.withColumn("runners", F.when(c("close").isNotNull() & atr.isNotNull(), F.array_sort(F.concat(trail, present(extension(EXTENSIONS[1]))))).otherwise(none))
    stops = F.array_compact(F.array(c("_z.breakout.invalidation"), c("_z.pullback.invalidation"), c("support"), F.when(atr > 0, c("base_low_60") - 0.5 * atr)))
    floor = F.least(c("breakout_entry.low"), c("pullback_entry.low"))
    low_enough = F.filter(stops, lambda x: F.coalesce(x < floor, F.lit(True)))
    once = F.filter(low_enough, lambda x, i: F.array_position(F.transform(low_enough, lambda y: F.bround(y, 4)), F.bround(x, 4)) == i + 1)
    return rows.withColumn("invalidations", once).drop("_z")


def resolve_picks(rows: DataFrame) -> DataFrame:
    """Rows of candidate_levels with a model's picks (entry_kind, primary_index, runner_index, invalidation_index) made valid, and the plan that they name.

    An unknown kind is a breakout; a kind without a band gives way to the other one; indices are cut to the lists, no
    runner stays none, a missing index is the first. A stop that is not under the entry, or that no candidate gives, is
    set 0.75 ATR under it (5 % without ATR). Rows without an entry band, a primary exit or an invalidation have no plan (null entry).
    """
    c = F.col
    wanted = F.when(c("entry_kind") == "pullback", "pullback").otherwise("breakout")
    kind = F.when(c("breakout_entry").isNull(), "pullback").when(c("pullback_entry").isNull(), "breakout").otherwise(wanted)
    cut = lambda index, items: F.greatest(F.lit(0), F.least(F.coalesce(c(index), F.lit(0)), F.size(items) - 1))
    possible = (c("breakout_entry").isNotNull() | c("pullback_entry").isNotNull()) & (F.size("primaries") > 0) & (F.size("invalidations") > 0)
    rows = rows.withColumns(
        {
            "entry_kind": F.when(possible, kind), "primary_index": F.when(possible, cut("primary_index", "primaries")),
            "runner_index": F.when(possible & c("runner_index").isNotNull() & (F.size("runners") > 0), cut("runner_index", "runners")), "invalidation_index": F.when(possible, cut("invalidation_index", "invalidations")),
        }
    )
    rows = rows.withColumn("entry", F.when(c("entry_kind") == "breakout", c("breakout_entry")).when(c("entry_kind") == "pullback", c("pullback_entry")))
    low, picked = c("entry.low"), F.get("invalidations", c("invalidation_index"))
    stop = F.when(picked < low, picked).when(c("atr_14") > 0, low - SNAP * c("atr_14")).otherwise(low * 0.95)
    return rows.withColumns({"primary": F.get("primaries", c("primary_index")), "runner": F.get("runners", c("runner_index")), "invalidation": stop})


def bounded_confidence(raw: Column, rubric: Column) -> Column:
    """A model's confidence, but no higher than the rubric's; an unknown one is low."""
    rank = lambda c: F.greatest(F.array_position(F.array(*map(F.lit, ("low", "medium", "high"))), F.coalesce(c, F.lit("low"))), F.lit(1))
    return F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), F.least(rank(raw), rank(rubric)).cast("int"))


def with_risk(rows: DataFrame) -> DataFrame:
    """Rows with zone, available, risk_pct, risk_atrs and reward_risk (to the nearest resistance, or the range's top)."""
    rows = rows.withColumn("zone", entry_zone())
    z = F.col("zone")
    risk = z["low"] - z["invalidation"]
    target = F.when(z["kind"] == "range", F.col("base_high_60")).otherwise(F.col("resistance"))
    counted = (risk > 0) & ((z["kind"] == "range") | (target > z["low"]))
    return rows.withColumns({"available": z.isNotNull(), "risk_pct": F.when(z["low"] > 0, risk / z["low"]), "risk_atrs": F.when(F.col("atr_14") > 0, risk / F.col("atr_14")), "reward_risk": F.when(counted, (target - z["low"]) / risk)})


def rr_distribution(plans: DataFrame) -> DataFrame:
    """Per ticker the least, median and greatest blended reward to risk over all combinations of its entries, primary
    exits, runner exits or none, and invalidations, each a struct<low, high> or a price. At most a few hundred per ticker.

    A combination without positive risk, or whose primary exit has no reward, is dropped; a runner without reward counts
    as 0. The blend is a third of the primary and two thirds of the runner, or the primary alone. A ticker without
    combinations has n 0 and zeros.
    """
    none = F.array(F.lit(None).cast("struct<low:double,high:double>"))
    rows = plans.select("ticker", F.explode("entries").alias("e"), "primaries", F.concat(F.coalesce("runners", F.array().cast("array<struct<low:double,high:double>>")), none).alias("runners"), "invalidations")
    rows = rows.select("ticker", "e", F.explode("primaries").alias("p"), "runners", "invalidations")
    rows = rows.select("ticker", "e", "p", F.explode("runners").alias("r"), "invalidations").select("ticker", "e", "p", "r", F.explode("invalidations").alias("inv"))
    risk = F.col("e.low") - F.col("inv")
    ratio = lambda x: F.bround(F.greatest(F.lit(0.0), F.col(f"{x}.low") - F.col("e.high")) / risk, 2)
    rows = rows.where(risk > 0).withColumns({"rp": ratio("p"), "rr": F.when(F.col("r").isNotNull(), ratio("r"))}).where("rp > 0")
    blend = F.when(F.col("rr").isNull(), F.col("rp")).otherwise(F.bround(F.col("rp") / 3 + F.col("rr") * 2 / 3, 2))
    found = rows.withColumn("blended", blend).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("blended").alias("low"), F.bround(F.median("blended"), 2).alias("middle"), F.max("blended").alias("high"))
    return plans.select("ticker").distinct().join(found, "ticker", "left").na.fill(0)


def days_to_earnings(dates: Column, today: Column) -> Column:
    """Days until the first candidate date at most 3 days past, at least 0; null without one."""
    ahead = F.filter(F.transform(dates, lambda d: F.date_diff(d, today)), lambda n: n >= -3)
    return F.greatest(F.get(ahead, F.lit(0)), F.lit(0))


def call_defects() -> Column:
    """Why a raw call cannot stand: a price without its evidence or evidence without its price, or an entry type that needs a price."""
    pairs = [F.when(F.col(f"{k}_price").isNull() != F.col(f"{k}_evidence").isNull(), f"{k}_evidence") for k in ("entry", "target", "stop")]
    needs = F.when(F.col("entry_type").isin("limit", "trigger_above", "trigger_below") & F.col("entry_price").isNull(), "entry_price")
    return F.array_compact(F.array(*pairs, needs))


def claim_defects() -> Column:
    """Why a raw claim cannot stand: an earnings view needs a ticker, sector views, catalysts and risks a ticker or sector."""
    kind = F.col("claim_type")
    return F.array_compact(F.array(F.when((kind == "earnings_view") & F.col("ticker").isNull(), "ticker"), F.when(kind.isin("sector_view", "catalyst", "risk") & F.col("ticker").isNull() & F.col("sector").isNull(), "ticker_or_sector")))
