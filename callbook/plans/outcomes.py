"""Calls to outcomes: activation, horizon outcomes and their states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbook.operators import bars as B
from callbook.operators import calendar as C

HORIZONS = {"1d": 1, "3d": 3, "5d": 5, "21d": 21}
TRIGGER_WINDOW = 10
LOADED_BEFORE, LOADED_AFTER = 5, 60  # calendar days of bars around a post
PACK = 32  # bars; no fewer than the trigger window and the longest horizon together


def signed_pct(fill: Column, value: Column, is_long: Column) -> Column:
    """Return from fill to value; anything but long counts as short."""
    raw = (value - fill) / fill
    return F.when(is_long, raw).otherwise(-raw)


def _is_long() -> Column:
    return F.coalesce(F.col("direction"), F.lit("long")) == "long"


def pending_calls(calls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Accepted calls without an outcome."""
    return calls.where("status = 'accepted'").join(outcomes.select("call_id").distinct(), "call_id", "left_anti")


def first_bar(calls: DataFrame, bars: DataFrame) -> DataFrame:
    """calls with b0, the number of the ticker's first bar strictly after posted_at, and whether any bar was loaded around the post."""
    index = B.day_index(bars, LOADED_AFTER + 1).select("ticker", "day", "bar_no", "ts", "next_ts")
    first = bars.groupBy("ticker").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    found = calls.withColumn("day", F.to_date("posted_at")).join(index, ["ticker", "day"], "left").join(first, "ticker", "left")
    upper = F.col("posted_at") + F.expr(f"interval {LOADED_AFTER} days")
    lower = F.col("posted_at") - F.expr(f"interval {LOADED_BEFORE} days")
    b0 = F.when(F.col("bar_no").isNotNull(), F.col("bar_no") + 1).when(F.col("posted_at") < F.col("first_ts"), F.lit(1))
    following = F.when(F.col("bar_no").isNotNull(), F.col("next_ts")).when(F.col("posted_at") < F.col("first_ts"), F.col("first_ts"))
    before = F.coalesce(F.col("ts") >= lower, F.lit(False))
    after = F.coalesce(following <= upper, F.lit(False))
    return found.withColumns({"b0": b0, "loaded": before | after, "loaded_until": upper}).drop("day", "bar_no", "ts", "next_ts", "first_ts", "last_ts")


def entry_fill(entry_type: Column, direction: Column, price: Column, open_: Column, high: Column, low: Column) -> Column:
    """The fill of a bar that meets the entry rule, else null."""
    limit = F.when((direction == "long") & (low <= price), F.least(open_, price)).when((direction == "short") & (high >= price), F.greatest(open_, price))
    return (
        F.when(entry_type.isin("market", "unspecified"), open_)
        .when(entry_type == "limit", limit)
        .when((entry_type == "trigger_above") & (high >= price), F.greatest(open_, price))
        .when((entry_type == "trigger_below") & (low <= price), F.least(open_, price))
    )


def packed(bars: DataFrame) -> DataFrame:
    """(ticker, pack, bars): pack p holds a ticker's bars of blocks p and p + 1 of `PACK` numbers each, in order.

    From any bar of its first block a pack reaches `PACK` bars ahead, so one equi-join brings a call all that it can need.
    """
    block = F.floor(F.col("bar_no") / PACK)
    rows = B.numbered(bars).select("ticker", F.explode(F.array(block, block - 1)).alias("pack"), F.struct("bar_no", "ts", "open", "high", "low", "close").alias("bar"))
    return rows.groupBy("ticker", "pack").agg(F.sort_array(F.collect_list("bar")).alias("bars"))


def _from_bar(first: Column, n: Column | int) -> Column:
    """n bars of a pack from number `first` on; its bars are numbered without gaps."""
    return F.slice("bars", (first - F.get("bars", F.lit(0))["bar_no"] + 1).cast("int"), n)


def _followed(calls: DataFrame, bars: DataFrame) -> DataFrame:
    """calls with first_bar's columns and `path`, the bars that can activate them (null where there is no bar after the post)."""
    started = first_bar(calls, bars).withColumn("pack", F.floor(F.col("b0") / PACK))
    return started.join(packed(bars), ["ticker", "pack"], "left").withColumn("path", _from_bar(F.col("b0"), TRIGGER_WINDOW)).drop("pack", "bars")


def _activated(followed: DataFrame) -> DataFrame:
    tried = F.filter("path", lambda x: x["ts"] <= F.col("loaded_until"))
    fill = lambda x: entry_fill(F.col("entry_type"), F.coalesce("direction", F.lit("")), F.col("entry_price"), x["open"], x["high"], x["low"])
    hits = F.filter(F.transform("tried", lambda x: F.struct(x["bar_no"].alias("bar_no"), x["ts"].alias("ts"), fill(x).alias("fill"))), lambda x: x["fill"].isNotNull())
    out = followed.withColumn("tried", tried).withColumn("hit", F.get(hits, F.lit(0)))
    return out.withColumns({"sessions_seen": F.coalesce(F.size("tried"), F.lit(0)).cast("long"), "a0": F.col("hit.bar_no"), "activation_at": F.col("hit.ts"), "entry_fill_price": F.col("hit.fill")}).drop("hit", "tried")


def activations(calls: DataFrame, bars: DataFrame) -> DataFrame:
    """Calls with activation_at, entry_fill_price, a0 (number of the activation bar) and sessions_seen, over the next ten bars after the post."""
    return _activated(_followed(calls, bars)).drop("path")


def benchmark_returns(spans: DataFrame, bars: DataFrame, benchmark: str) -> DataFrame:
    """spans (activation_at, horizon_end, ...) with benchmark_return_pct, close to close of the benchmark's bars inside.

    The benchmark's day index is one row per calendar day, so broadcasting it is bounded.
    """
    only = bars.where(F.col("ticker") == benchmark)
    index = B.day_index(only, LOADED_AFTER + 40).select("day", "ts", "close", "next_ts")
    opening = index.select(F.col("day").alias("from_day"), F.col("ts").alias("from_ts"), F.col("close").alias("from_close"), F.col("next_ts").alias("after_ts"))
    closing = index.select(F.col("day").alias("to_day"), F.col("ts").alias("to_ts"), F.col("close").alias("to_close"))
    # activation is at a bar's midnight: the benchmark's bar of that day, or else its next one
    joined = spans.withColumns({"from_day": F.to_date("activation_at"), "to_day": F.to_date("horizon_end")}).join(F.broadcast(opening), "from_day", "left").join(F.broadcast(closing), "to_day", "left")
    # an activation before the benchmark's first bar looks ahead to that bar
    joined = joined.crossJoin(F.broadcast(only.agg(F.min("ts").alias("_first")))).withColumn("after_ts", F.when(F.col("from_ts").isNull(), F.col("_first")).otherwise(F.col("after_ts")))
    late = only.select(F.col("ts").alias("after_ts"), F.col("close").alias("after_close"))
    joined = joined.join(F.broadcast(late), "after_ts", "left")
    same = F.coalesce(F.col("from_ts") >= F.col("activation_at"), F.lit(False))
    entry = F.when(same, F.col("from_close")).when(F.col("after_ts") <= F.col("horizon_end"), F.col("after_close"))
    exit_ = F.when(F.col("to_ts") >= F.col("activation_at"), F.col("to_close"))
    return joined.select(*[joined[c] for c in spans.columns], ((exit_ - entry) / entry).alias("benchmark_return_pct"))


#: What an activation leads to at a horizon.
_SPAN = {"horizon": "string", "horizon_end": "timestamp", "covered_at": "timestamp", "exit_at": "timestamp", "exit_price": "double", "top": "double", "bottom": "double", "benchmark_return_pct": "double"}


def horizon_spans(bars: DataFrame, sessions: DataFrame, benchmark: str) -> DataFrame:
    """(ticker, a0, spans): for each bar, what an activation at it leads to, one struct per horizon.

    horizon_end is the close of the horizon's last session, covered_at the first bar that shows it is over; the rest is
    over the bars until then. All calls that are activated at a bar share these, so they are worked out once per bar.
    """
    starts = B.numbered(bars).select("ticker", F.col("bar_no").alias("a0"), F.col("ts").alias("activation_at"), F.floor(F.col("bar_no") / PACK).alias("pack"))
    horizons = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("n")) for h, n in HORIZONS.items()])).alias("h")
    each = starts.select("*", horizons).select("*", "h.horizon", "h.n").drop("h")
    each = C.nth_session_close(each, sessions, "activation_at", "n")
    each = each.join(packed(bars), ["ticker", "pack"]).withColumn("walk", _from_bar(F.col("a0"), F.col("n") + 1)).drop("bars", "pack")
    each = each.withColumns({"covered_at": F.get(F.filter("walk", lambda x: x["ts"] >= F.col("horizon_end")), F.lit(0))["ts"], "inside": F.filter("walk", lambda x: x["ts"] <= F.col("horizon_end"))})
    last = F.get("inside", F.size("inside") - 1)
    each = each.withColumns({"exit_at": last["ts"], "exit_price": last["close"], "top": F.array_max(F.transform("inside", lambda x: x["high"])), "bottom": F.array_min(F.transform("inside", lambda x: x["low"]))})
    each = benchmark_returns(each.drop("walk", "inside"), bars, benchmark)
    return each.groupBy("ticker", "a0").agg(F.collect_list(F.struct(*_SPAN)).alias("spans"))


def evaluate(calls: DataFrame, bars: DataFrame, sessions: DataFrame, benchmark: str, cost_bps: int = 10) -> DataFrame:
    """One row per call and horizon that has a state: data_missing, not_triggered or evaluated.

    Calls whose bars have not come yet, or whose window or horizon is still open, give no row and stay pending.
    """
    # calls without activation meet no span; numbers below 1 spread them over the tasks
    at = F.coalesce(F.col("a0").cast("long"), -1 - F.pmod(F.xxhash64("call_id"), F.lit(4096)))
    done = _activated(_followed(calls, bars)).drop("path").withColumn("a0", at)
    none = F.array(*[F.struct(*[F.lit(h if c == "horizon" else None).cast(t).alias(c) for c, t in _SPAN.items()]) for h in HORIZONS])
    spans = horizon_spans(bars, sessions, benchmark).withColumn("a0", F.col("a0").cast("long"))
    each = done.join(spans, ["ticker", "a0"], "left").select("*", F.explode(F.coalesce("spans", none)).alias("s")).drop("spans").select("*", "s.*").drop("s")
    known = F.col("activation_at").isNotNull() & (F.col("horizon_end") <= F.col("loaded_until")) & (F.col("covered_at") <= F.col("loaded_until"))
    state = (
        F.when(~F.col("loaded"), "data_missing")
        .when(F.col("activation_at").isNull() & (F.col("sessions_seen") >= TRIGGER_WINDOW), "not_triggered")
        .when(known, "evaluated")
    )
    each = each.withColumn("status", state).where("status is not null")
    # only an evaluated call has walked its span
    each = each.withColumns({c: F.when(F.col("status") == "evaluated", F.col(c)) for c in ("exit_at", "exit_price", "top", "bottom")})
    live, long_, fill = F.col("status") == "evaluated", _is_long(), F.col("entry_fill_price")
    gross = signed_pct(fill, F.col("exit_price"), long_)
    good, bad = F.when(long_, F.col("top")).otherwise(F.col("bottom")), F.when(long_, F.col("bottom")).otherwise(F.col("top"))
    met = lambda level, up: F.when(up, F.col("top") >= level).otherwise(F.col("bottom") <= level)
    values = {
        "activated": live, "activation_at": F.when(live, F.col("activation_at")), "entry_fill_price": F.when(live, fill), "exit_at": F.col("exit_at"), "exit_price": F.col("exit_price"),
        "gross_return_pct": F.when(live, gross), "return_pct": F.when(live, gross - cost_bps / 10000.0), "mfe": F.when(live, signed_pct(fill, good, long_)), "mae": F.when(live, signed_pct(fill, bad, long_)),
        "hit_target": met(F.col("target_price"), long_), "hit_stop": met(F.col("stop_price"), ~long_), "benchmark_return_pct": F.when(live, F.col("benchmark_return_pct")),
        "excess_return_pct": F.when(live, gross - cost_bps / 10000.0 - F.col("benchmark_return_pct")),
    }
    return each.select("call_id", "horizon", *[v.alias(k) for k, v in values.items()], "status")


def leakage_audit(calls: DataFrame, outcomes: DataFrame, bars: DataFrame) -> DataFrame:
    """Violations that must be 0: activation before the post's day, fill outside its bar, exit before activation."""
    live = outcomes.where("status = 'evaluated'").join(calls.select("call_id", "ticker", "posted_at"), "call_id")
    bar = bars.select("ticker", F.col("ts").alias("activation_at"), "high", "low")
    joined = live.join(bar, ["ticker", "activation_at"], "left")
    broken = {
        "activation_before_post": F.col("activation_at") <= F.col("posted_at"),
        "fill_outside_bar": ~F.coalesce(F.col("entry_fill_price").between(F.col("low") - 1e-9, F.col("high") + 1e-9), F.lit(False)),
        "exit_before_activation": F.col("exit_at") < F.col("activation_at"),
    }
    return joined.agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in broken.items()], F.count(F.lit(1)).alias("n_checked"))
