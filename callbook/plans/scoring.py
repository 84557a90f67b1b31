"""Scores of creators and lenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbook.functions.stats import hit_rate, sharpe_like, wilson
from callbook.plans.signals import with_context

WINDOWS = {"all": None, "365d": 365, "90d": 90}


def _once(*keys: str) -> Column:
    """True for one row per call of each group, an activated one if there is any: counting these rows counts distinct calls.

    The rows lie by call_id already, from the join with the calls, so this moves none and copies none.
    """
    return F.row_number().over(Window.partitionBy("call_id", *keys).orderBy(F.col("activated").desc_nulls_last())) == 1


def creator_scorecards(outcomes: DataFrame, calls: DataFrame, as_of, windows: dict = WINDOWS, min_calls: int = 5) -> DataFrame:
    """A4: one row per creator, window and horizon with at least min_calls calls. Every row falls into its windows at
    once, so one shuffle serves all; medians are exact."""
    end = F.lit(as_of).cast("timestamp")
    age = F.array(*[F.struct(F.lit(w).alias("window_label"), (F.lit(True) if d is None else F.col("posted_at") >= end - F.expr(f"interval {d} days")).alias("inside")) for w, d in windows.items()])
    rows = outcomes.where("status in ('evaluated', 'not_triggered')").join(calls.select("call_id", "creator_id", "ticker", "posted_at"), "call_id")
    rows = rows.select("*", F.explode(age).alias("w")).where("w.inside").withColumn("window_label", F.col("w.window_label"))
    rows = rows.withColumn("_once", _once("creator_id", "window_label", "horizon"))
    live = lambda c: F.when(F.col("activated"), F.col(c))
    ret, excess, mae = live("return_pct"), live("excess_return_pct"), live("mae")
    out = rows.groupBy("creator_id", "window_label", "horizon").agg(
        F.count_if("_once").alias("n_calls"),
        F.count_if(F.col("_once") & F.coalesce("activated", F.lit(False))).alias("n_activated"),
        F.size(F.collect_set("ticker")).cast("long").alias("n_unique_tickers"),  # no more than there are tickers
        F.count(ret).alias("_n"), F.count_if(ret > 0).alias("_hits"), F.sum(ret).alias("_sum"),
        hit_rate(ret).alias("hit_rate"), F.avg(ret).alias("mean_return"), F.median(ret).alias("median_return"), F.stddev_samp(ret).alias("std_return"), sharpe_like(ret).alias("sharpe_like"),
        F.avg(mae).alias("mean_mae"), F.min(mae).alias("worst_mae"),
        F.avg(excess).alias("mean_excess_return"), F.median(excess).alias("median_excess_return"), hit_rate(excess).alias("excess_hit_rate"),
    ).where(F.col("n_calls") >= min_calls)
    low, high = wilson(F.col("_hits"), F.col("_n"))
    idle = F.col("n_calls") - F.col("n_activated")
    return out.withColumns(
        {"activation_rate": F.col("n_activated") / F.col("n_calls"), "hit_rate_lower_ci": low, "hit_rate_upper_ci": high, "expectancy_unconditional": F.coalesce("_sum", F.lit(0.0)) / F.nullif(F.col("_n") + idle, F.lit(0))}
    ).drop("_n", "_hits", "_sum")


def leaderboard(scorecards: DataFrame, horizon: str = "5d", window: str = "all") -> DataFrame:
    """K1: creators of one horizon and window by mean excess return, nulls last."""
    return scorecards.where((F.col("horizon") == horizon) & (F.col("window_label") == window)).orderBy(F.desc_nulls_last("mean_excess_return"), "creator_id")


def lens_scorecards(results: DataFrame, horizon: str, since) -> DataFrame:
    """Per lens at one horizon since a date."""
    rows = results.where((F.col("horizon") == horizon) & (F.col("as_of") >= F.lit(since).cast("timestamp")))
    sign = F.when(F.col("direction") == "bullish", 1.0).when(F.col("direction") == "bearish", -1.0)
    hits = F.count_if(F.col("direction_correct"))
    out = rows.groupBy("lens_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("ticker", F.to_date("as_of"))).alias("n_ticker_days"), hits.alias("hits"),
        F.round(F.avg("excess_vs_spy_pct"), 4).alias("avg_excess"), F.round(F.avg(sign * F.col("excess_vs_spy_pct")), 4).alias("directional_excess"), F.count(sign * F.col("excess_vs_spy_pct")).alias("n_directional"),
    )
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.withColumns({"hit_rate": F.col("hits") / F.col("n"), "lower_ci": low, "upper_ci": high})


def lens_breakdowns(results: DataFrame, horizon: str = "5d") -> DataFrame:
    """Hits per lens by regime, by conviction and by direction, in one pass of grouping sets."""
    rows = results.where(F.col("horizon") == horizon)
    sets = rows.groupingSets([["lens_name", "regime"], ["lens_name", "conviction"], ["lens_name", "direction"]], "lens_name", "regime", "conviction", "direction")
    out = sets.agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.count_if("direction_correct").alias("hits"))
    kind = F.when(F.col("_g") == 3, "regime").when(F.col("_g") == 5, "conviction").otherwise("direction")
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.select("lens_name", kind.alias("kind"), F.coalesce("regime", "conviction", "direction").alias("value"), "n", "hits", (F.col("hits") / F.col("n")).alias("hit_rate"), low.alias("lower_ci"), high.alias("upper_ci"))


def outcomes_report(outcomes: DataFrame, calls: DataFrame, documents: DataFrame, channels: DataFrame, creators: DataFrame) -> DataFrame:
    """Every outcome with its call, when it was posted and by whom; calls that lead to no creator are left out."""
    posted = with_context(calls.select("call_id", "document_id", "ticker", "direction", "entry_type"), documents, channels, creators)
    return outcomes.join(posted.drop("document_id", "channel_id", "creator_id", "active").withColumnRenamed("display_name", "creator"), "call_id")


def creator_report(outcomes: DataFrame, calls: DataFrame) -> DataFrame:
    """Per creator and horizon: calls, sum, mean, median and hit rate of the known returns."""
    rows = outcomes.where("status = 'evaluated'").join(calls.select("call_id", "creator_id"), "call_id").withColumn("_once", _once("creator_id", "horizon"))
    return rows.groupBy("creator_id", "horizon").agg(F.count_if("_once").alias("n_calls"), F.sum("return_pct").alias("sum_return"), F.avg("return_pct").alias("mean_return"), F.median("return_pct").alias("median_return"), hit_rate(F.col("return_pct")).alias("hit_rate"))


def recency_pivot(scorecards: DataFrame, horizon: str = "5d") -> DataFrame:
    """Per creator, activated calls and mean excess of each window side by side."""
    picked = scorecards.where(F.col("horizon") == horizon).groupBy("creator_id").pivot("window_label", list(WINDOWS))
    return picked.agg(F.first("n_activated").alias("n_activated"), F.first("mean_excess_return").alias("mean_excess"))


def regime_split(outcomes: DataFrame, calls: DataFrame, regimes: DataFrame) -> DataFrame:
    """C20: per creator and market regime at the post: calls, hits and mean return of 5d outcomes. regimes: (day, regime), one row per day."""
    rows = outcomes.where("status = 'evaluated' and horizon = '5d'").join(calls.select("call_id", "creator_id", "posted_at"), "call_id")
    dated = rows.withColumn("day", F.to_date("posted_at")).join(F.broadcast(regimes), "day", "left")
    return dated.groupBy("creator_id", F.coalesce("regime", F.lit("unknown")).alias("regime")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("return_pct") > 0).alias("hits"), F.avg("return_pct").alias("mean_return"))
