"""Strategies over all as-of dates at once, simulation and walk-forward metrics.

A strategy is a function of StrategyFrames that returns decisions (as_of, ticker, score, direction, weight, hold_days).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbook.functions.stats import hit_rate, wilson
from callbook.operators import bars as B
from callbook.operators.asof import over_times
from callbook.operators.quantiles import exact_quantiles
from callbook.operators.recurrences import day_block
from callbook.operators import calendar as C
from callbook.sources.tables import upsert_by_key
from callbook.operators import indicators as I
from callbook.plans.outcomes import benchmark_returns
from callbook.plans.signals import CREDIBLE, polarity_value, scorecard_as_of


@dataclass
class StrategyFrames:
    """What a strategy may see: as_ofs (as_of, knowable_through), tradeable (as_of, ticker), claims, calls and scorecards."""

    as_ofs: DataFrame
    tradeable: DataFrame
    claims: DataFrame
    calls: DataFrame
    scorecards: DataFrame

    def visible(self, mentions: DataFrame, days: int) -> DataFrame:
        """mentions with every as_of that sees them in the `days` before it, on tradeable tickers.

        The as_ofs of a mention's days are looked up in the calendar, so only rows of the result are made.
        """
        fed = mentions.where("status = 'accepted' and ticker is not null and posted_at is not null")
        near = over_times(fed, self.as_ofs.select("as_of"), "as_of", F.to_date("posted_at"), F.date_add(F.to_date("posted_at"), days))
        return near.where((F.col("posted_at") <= F.col("as_of")) & (F.col("posted_at") >= F.col("as_of") - F.expr(f"interval {days} days"))).join(self.tradeable, ["as_of", "ticker"])


STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def strategy(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    STRATEGIES[fn.__name__] = fn
    return fn


def top_fraction(scored: DataFrame, share: float) -> DataFrame:
    """K4: per as_of the best max(1, int(n * share + 0.999)) rows by score, ties by ticker."""
    by = Window.partitionBy("as_of")
    ranked = scored.withColumns({"_n": F.row_number().over(by.orderBy(F.desc("score"), "ticker")), "_all": F.count(F.lit(1)).over(by)})
    return ranked.where(F.col("_n") <= F.greatest(F.lit(1), F.floor(F.col("_all") * share + 0.999))).drop("_n", "_all")


def _equal_weight(picked: DataFrame, hold_days: int) -> DataFrame:
    weight = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("as_of"))
    return picked.select("as_of", "ticker", F.col("score").cast("double").alias("score"), "direction", weight.alias("weight"), F.lit(hold_days).alias("hold_days"))


@strategy
def mention_momentum(f: StrategyFrames, days: int = 7, share: float = 0.10, hold_days: int = 5, min_creators: int = 1) -> DataFrame:
    """Mean polarity times distinct creators of the week's claims; the best tenth of the positive ones, long."""
    scored = f.visible(f.claims, days).groupBy("as_of", "ticker").agg(F.count_distinct("creator_id").alias("n"), F.avg(polarity_value(F.col("polarity"))).alias("p"))
    scored = scored.where(F.col("n") >= min_creators).withColumn("score", F.col("p") * F.col("n")).where("score > 0").withColumn("direction", F.lit("long"))
    return _equal_weight(top_fraction(scored, share), hold_days)


@strategy
def bullish_catalyst(f: StrategyFrames, days: int = 14, min_creators: int = 2, hold_days: int = 5) -> DataFrame:
    """Tickers on which enough creators raised bullish catalysts, as fact or opinion."""
    rows = f.visible(f.claims.where("claim_type = 'catalyst' and claim_class in ('factual', 'opinion') and polarity = 'bullish'"), days)
    picked = rows.groupBy("as_of", "ticker").agg(F.count_distinct("creator_id").alias("score")).where(F.col("score") >= min_creators)
    return _equal_weight(picked.withColumn("direction", F.lit("long")), hold_days)


@strategy
def creator_consensus(f: StrategyFrames, days: int = 7, credible: float = CREDIBLE, min_creators: int = 2, hold_days: int = 5) -> DataFrame:
    """Tickers on which enough credible creators (as of the date) agree on a direction; none where both directions have
    enough, and no decision on dates with fewer than min_creators credible creators."""
    trusted = scorecard_as_of(f.as_ofs, f.scorecards).where(F.col("hit_rate_lower_ci") > credible).select("as_of", "creator_id")
    enough = trusted.groupBy("as_of").agg(F.count_distinct("creator_id").alias("_c")).where(F.col("_c") >= min_creators).select("as_of")
    rows = f.visible(f.calls.where("direction in ('long', 'short')"), days).join(trusted, ["as_of", "creator_id"]).join(enough, "as_of", "left_semi")
    agreed = rows.groupBy("as_of", "ticker", "direction").agg(F.count_distinct("creator_id").alias("score")).where(F.col("score") >= min_creators)
    sides = F.count(F.lit(1)).over(Window.partitionBy("as_of", "ticker"))
    return _equal_weight(agreed.withColumn("_sides", sides).where("_sides = 1"), hold_days)


def simulate(decisions: DataFrame, as_ofs: DataFrame, bars: DataFrame, benchmark: str, cost_bps: int = 10) -> DataFrame:
    """C11: one trade per decision that could fill: the first bar after what was knowable at its open, out hold_days bars later at the close.

    Decisions that are flat, weightless or without enough bars in hold_days * 4 + 14 days give none. Further columns of decisions are passed on.
    """
    live = decisions.where("direction <> 'flat' and weight > 0").join(F.broadcast(as_ofs.select("as_of", "knowable_through")), "as_of")
    index = B.day_index(bars, 400).select("ticker", "day", F.col("bar_no").alias("b0"))
    placed = live.withColumn("day", F.to_date("knowable_through")).join(index, ["ticker", "day"])
    nb = B.numbered(bars).select("ticker", "bar_no", "ts", "open", "close")
    entry = nb.select("ticker", F.col("bar_no").alias("_in"), F.col("ts").alias("entry_at"), F.col("open").alias("entry_price"))
    out = nb.select("ticker", F.col("bar_no").alias("_out"), F.col("ts").alias("exit_at"), F.col("close").alias("exit_price"))
    trades = placed.withColumns({"_in": F.col("b0") + 1, "_out": F.col("b0") + 1 + F.col("hold_days")}).join(entry, ["ticker", "_in"]).join(out, ["ticker", "_out"])
    trades = trades.where((F.col("entry_price") > 0) & (F.col("exit_at") <= F.col("as_of") + F.make_dt_interval(F.col("hold_days") * 4 + 14)))
    raw = F.col("exit_price") / F.col("entry_price") - 1
    trades = trades.withColumn("return_pct", F.when(F.col("direction") == "short", -raw).otherwise(raw) - cost_bps / 10000.0)
    trades = trades.join(F.broadcast(I.regimes(bars, benchmark)), "day", "left").withColumnRenamed("regime", "regime_at_entry")
    trades = benchmark_returns(trades.withColumnsRenamed({"entry_at": "activation_at", "exit_at": "horizon_end"}), bars, benchmark).withColumnsRenamed({"activation_at": "entry_at", "horizon_end": "exit_at"})
    more = [c for c in decisions.columns if c not in ("as_of", "ticker", "direction", "score", "weight", "hold_days")]
    return trades.select("as_of", "ticker", "direction", "score", "weight", "hold_days", "entry_at", "exit_at", "entry_price", "exit_price", "return_pct", F.coalesce("regime_at_entry", F.lit("unknown")).alias("regime_at_entry"), "benchmark_return_pct", *more)


def equity_curve(trades: DataFrame, run: str | list[str] = "strategy", days: int = 64) -> DataFrame:
    """Per run its trades by exit with step, nav (compounded weight * return, start 1) and drawdown from the running high.

    A block of days of a run multiplies the nav that it begins with, so blocks are worked on apart; one short row per run
    and block gives what each begins with: its nav, the high so far, and its number of steps.
    """
    keys = [run] if isinstance(run, str) else list(run)
    rows = trades.withColumn("_block", day_block("exit_at", days))
    w = Window.partitionBy(*keys, "_block").orderBy("exit_at", "ticker", "as_of")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_step": F.row_number().over(w), "_grown": F.product(1 + F.col("weight") * F.col("return_pct")).over(upto)})
    rows = rows.withColumn("_top", F.max("_grown").over(upto))
    ends = rows.groupBy(*keys, "_block").agg(F.max_by("_grown", "_step").alias("grown"), F.max("_top").alias("top"), F.max("_step").alias("steps"))
    over = Window.partitionBy(*keys).orderBy("_block")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.withColumn("_nav", F.coalesce(F.product("grown").over(earlier), F.lit(1.0))).withColumn("_high", F.col("_nav") * F.col("top"))
    begins = begins.select(*keys, "_block", "_nav", F.greatest(F.lit(1.0), F.max("_high").over(earlier)).alias("_before"), F.coalesce(F.sum("steps").over(earlier), F.lit(0)).alias("_steps"))
    out = rows.join(begins, [*keys, "_block"]).withColumns({"step": (F.col("_step") + F.col("_steps")).cast("int"), "nav": F.col("_nav") * F.col("_grown")})
    high = F.greatest("_before", F.col("_nav") * F.col("_top"))
    return out.withColumn("drawdown", F.col("nav") / high - 1).select(*trades.columns, "step", "nav", "drawdown")


def cagr(final: Column, days: Column) -> Column:
    """Yearly growth of a curve from 1 to `final`; null under 30 days or without anything left."""
    return F.when((days >= 30) & (final > 0), F.pow(final, F.lit(365.25) / days) - 1)


def run_metrics(trades: DataFrame, run: str | list[str] = "strategy", start=None, end=None, min_trades: int = 30, rf: float = 0.0) -> DataFrame:
    """Per run total, CAGR, Sharpe (over a yearly rate rf) and volatility of the curve's steps, drawdown, hit rate with interval, win/loss ratio, turnover and sanity flags.

    ordered: every trade enters no later than it leaves, and inside [start, end] where these are given. leak_suspect: over
    30 trades whose mean return is more than five times the benchmark's, where the benchmark has a mean other than 0.
    """
    entry = F.col("entry_at")
    inside = (entry >= F.lit(start).cast("timestamp") if start is not None else F.lit(True)) & (entry <= F.lit(end).cast("timestamp") if end is not None else F.lit(True))
    curve = equity_curve(trades, run)
    steps = curve.withColumn("r", F.col("weight") * F.col("return_pct"))  # the curve's own steps
    r = F.col("return_pct")
    out = steps.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_trades"), F.max_by("nav", "step").alias("final_nav"), F.min_by("entry_at", "step").alias("start_at"), F.max("exit_at").alias("end_at"), F.min(F.least(F.lit(0.0), "drawdown")).alias("max_drawdown"),
        F.avg("r").alias("_mean"), F.stddev_samp("r").alias("_sd"), hit_rate(r).alias("hit_rate"), F.count_if(r > 0).alias("_hits"), F.avg("hold_days").alias("avg_holding"),
        (F.avg(F.when(r > 0, r)) / F.abs(F.avg(F.when(r < 0, r)))).alias("win_loss"), F.sum("weight").alias("_w"), r_mean(r), F.avg("benchmark_return_pct").alias("mean_benchmark"),
        F.bool_and((entry <= F.col("exit_at")) & inside).alias("ordered"),
    )
    days = F.date_diff("end_at", "start_at")
    low, high = wilson(F.col("_hits"), F.col("n_trades"), 1.96, (None, None))
    enough = (F.col("n_trades") >= 5) & (F.col("_sd") > 0)
    year = 365.25
    return out.withColumns(
        {
            "cagr": cagr(F.col("final_nav"), days),
            "sharpe": F.when(enough, (F.col("_mean") - rf / 252) / F.col("_sd") * 252**0.5), "volatility": F.when(enough, F.col("_sd") * 252**0.5),
            "hit_rate_lower_ci": low, "hit_rate_upper_ci": high, "turnover": F.when(days > 0, F.col("_w") * year / days),
            "underpowered": F.col("n_trades") < min_trades,
            "leak_suspect": F.coalesce((F.col("n_trades") > 30) & (F.col("mean_benchmark") != 0) & (F.col("mean_return") > 5 * F.abs("mean_benchmark")), F.lit(False)),
        }
    ).drop("_mean", "_sd", "_hits", "_w")


def r_mean(r):
    return F.avg(r).alias("mean_return")


def regime_breakdown(trades: DataFrame, run: str = "strategy") -> DataFrame:
    """A10: per run and regime at entry, trades, hit rate with interval (z 1.96) and mean return."""
    r = F.col("return_pct")
    out = trades.groupBy(run, "regime_at_entry").agg(F.count(F.lit(1)).alias("n"), F.count_if(r > 0).alias("hits"), F.avg(r).alias("mean_return"))
    low, high = wilson(F.col("hits"), F.col("n"), 1.96, (None, None))
    return out.withColumns({"hit_rate": F.col("hits") / F.col("n"), "lower_ci": low, "upper_ci": high})


def benchmark_curve(bars: DataFrame, benchmark: str, start, end) -> DataFrame:
    """The benchmark's closes in [start, end] over its first; nothing if fewer than 2."""
    rows = bars.where((F.col("ticker") == benchmark) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    w = Window.partitionBy("ticker")
    first = F.first("close").over(w.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumns({"nav": F.col("close") / first, "_n": F.count(F.lit(1)).over(w)}).where("_n >= 2").select("ts", "nav")


def calibrate(scores: DataFrame, buckets: int = 10, flag_above: float = 0.20, run: str = "strategy") -> DataFrame:
    """Per run, exact score quantile buckets (low, high] with mean score, hit rate and flag; Brier score and the least-squares line over buckets.
    The quantiles come from refined histograms, so a run's scores are never one task's.

    scores: (run, score, hit 0/1). Runs with fewer rows than buckets give nothing.
    """
    edges = exact_quantiles(scores, [run], "score", tuple(i / buckets for i in range(1, buckets))).select(run, F.col("quantiles").alias("edges"), F.col("n").alias("_n")).where(F.col("_n") >= buckets)
    placed = scores.join(edges, run).withColumn("bucket", F.size(F.filter("edges", lambda e: e < F.col("score"))))
    rows = placed.groupBy(run, "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("hit").alias("hit_rate"), F.sum(F.pow(F.col("score") - F.col("hit"), 2)).alias("_b"))
    w = Window.partitionBy(run)
    gap = F.abs(F.col("mean_score") - F.col("hit_rate"))
    return rows.withColumns(
        {
            "gap": gap, "flagged": gap > flag_above, "max_gap": F.max(gap).over(w), "brier": F.sum("_b").over(w) / F.sum("n").over(w),
            "slope": F.regr_slope("hit_rate", "mean_score").over(w), "intercept": F.regr_intercept("hit_rate", "mean_score").over(w),
        }
    ).drop("_b")


def config_hash(config: dict) -> str:
    """First 16 hex digits of the SHA-256 of a configuration's sorted JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def walkforward(
    names: list[str], bars: DataFrame, sessions: DataFrame, claims: DataFrame, calls: DataFrame, scorecards: DataFrame, benchmark: str, start, end, cost_grid: tuple[int, ...] = (10,), frequency: str = "weekly", cutoff=None
) -> DataFrame:
    """Trades of the named strategies over all rebalance dates, once per cost of the grid (the same fills, another cost).

    The end is clamped to the cutoff, if one is given: later windows are kept for a last evaluation.
    """
    end = clamped(end, cutoff)
    as_ofs = C.knowable_through(C.rebalance_dates(sessions, start, end, frequency).select("as_of"), sessions)
    frames = StrategyFrames(as_ofs, B.tradeable(as_ofs, bars), claims, calls, scorecards)
    # decisions of all strategies, told apart by a column, meet the bars once
    decided = reduce(DataFrame.unionByName, [STRATEGIES[name](frames).withColumn("strategy", F.lit(name)) for name in names])
    runs = simulate(decided, as_ofs, bars, benchmark, 0)
    return runs.withColumn("cost_bps", F.explode(F.array(*[F.lit(c) for c in cost_grid]))).withColumn("return_pct", F.col("return_pct") - F.col("cost_bps") / 10000.0)


def clamped(end: str, cutoff: str | None) -> str:
    """The earlier of two ISO dates."""
    return end if cutoff is None else min(end, cutoff)


def walkforward_results(trades: DataFrame, versions: dict[str, str], cost_grid: tuple[int, ...], config: dict) -> DataFrame:
    """Metrics of each strategy and cost with the strategy's version and the hash of the whole configuration.

    versions: of each strategy by name. config: what else makes up a run; its start, end and min_n_trades serve the sanity checks.
    """
    hashed = F.lit(None).cast("string")
    for name, version in versions.items():
        for cost in cost_grid:
            run = config_hash({**config, "strategy_name": name, "strategy_version": version, "cost_bps": cost})
            hashed = F.when((F.col("strategy") == name) & (F.col("cost_bps") == cost), run).otherwise(hashed)
    version = reduce(lambda rest, item: F.when(F.col("strategy") == item[0], item[1]).otherwise(rest), versions.items(), F.lit(None).cast("string"))
    out = run_metrics(trades, ["strategy", "cost_bps"], config.get("start"), config.get("end"), config.get("min_n_trades", 30))
    return out.withColumns({"strategy_version": version, "config_hash": hashed})


def persist_results(held: DataFrame, new: DataFrame) -> DataFrame:
    """Held results with the new ones in place of those of the same strategy, version and configuration."""
    return upsert_by_key(held, new, ["strategy", "strategy_version", "config_hash"])
