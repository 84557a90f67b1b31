"""Outcomes of research lenses and evaluation of extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbook.functions.text import direction_correct
from callbook.operators import bars as B
from callbook.operators import calendar as C
from callbook.operators.indicators import regimes
from callbook.plans.outcomes import HORIZONS
from callbook.sources.tables import append_if_absent


def lens_outcomes(snapshots: DataFrame, bars: DataFrame, sessions: DataFrame, benchmark: str, now, max_age_days: int = 60, existing: DataFrame | None = None) -> DataFrame:
    """C4: per snapshot (snapshot_id, ticker, as_of, direction) and horizon that has passed: return from the last knowable
    close to the last bar by the n-th session after it, excess over the benchmark (which counts as 0 where it is
    unknown), whether the direction was right, and the benchmark's regime at as_of. Horizons pass in calendar days and are
    measured in sessions. Snapshots older than max_age_days are left; existing outcomes (of the same columns) stay as they
    are and come first: only keys that they lack are computed.
    """
    snapshots = snapshots.where(F.col("as_of") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(max_age_days)))
    horizons = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("n")) for h, n in HORIZONS.items()])).alias("h")
    rows = C.as_of_session(snapshots, sessions, "as_of").select("*", horizons).select("*", "h.horizon", "h.n").drop("h")
    rows = rows.where(F.col("as_of") + F.make_dt_interval(F.col("n")) <= F.lit(now).cast("timestamp"))
    if existing is not None:
        rows = rows.join(existing.select("snapshot_id", "horizon").distinct(), ["snapshot_id", "horizon"], "left_anti")
    dates = C.numbered_sessions(sessions).select("session_no", F.to_date("session_date").alias("date"))
    rows = rows.join(F.broadcast(dates.withColumnRenamed("date", "from_day")), "session_no")
    rows = rows.withColumn("_to", F.col("session_no") + F.col("n")).join(F.broadcast(dates.select(F.col("session_no").alias("_to"), F.col("date").alias("to_day"))), "_to")
    index = B.day_index(bars, 60).select("ticker", "day", "ts", "close")
    move = _moves(rows, index, ["ticker"], "own")
    ref = index.where(F.col("ticker") == benchmark).drop("ticker")
    both = _moves(move, ref, [], "benchmark")
    out = both.where("own is not null").withColumn("excess_pct", F.col("own") - F.coalesce("benchmark", F.lit(0.0)))
    states = regimes(bars, benchmark)  # a row per calendar day
    out = out.withColumn("day", F.to_date("as_of")).join(F.broadcast(states), "day", "left").withColumn("regime", F.coalesce("regime", F.lit("unknown")))
    made = out.select("snapshot_id", "horizon", F.col("own").alias("return_pct"), "excess_pct", direction_correct(F.col("direction"), F.col("own")).alias("direction_correct"), "regime")
    return made if existing is None else append_if_absent(existing, made, ["snapshot_id", "horizon"])


def _moves(rows: DataFrame, index: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with the return of the index's series from the close known on from_day to the last one by to_day, if that is a later bar."""
    side = lambda day, ts, close: index.select(*keys, F.col("day").alias(day), F.col("ts").alias(ts), F.col("close").alias(close))
    start, end = side("from_day", "_t0", "_c0"), side("to_day", "_t1", "_c1")
    if not keys:  # one series: a row per calendar day
        start, end = F.broadcast(start), F.broadcast(end)
    found = rows.join(start, [*keys, "from_day"], "left").join(end, [*keys, "to_day"], "left")
    return found.withColumn(name, F.when(F.col("_t1") > F.col("from_day").cast("timestamp"), F.col("_c1") / F.col("_c0") - 1)).drop("_t0", "_c0", "_t1", "_c1")


def _same_price(want: Column, got: Column) -> Column:
    """Within 1 %; both unknown agree; an expected 0 allows 0.01."""
    close = F.when(want == 0, F.abs(got) < 0.01).otherwise(F.abs(got - want) <= 0.01 * F.abs(want))
    return F.when(want.isNull() & got.isNull(), True).otherwise(F.coalesce(close, F.lit(False)))


#: Compared fields and how: as they are, or as prices.
SAME, PRICES = ("ticker", "direction", "entry_type", "timeframe"), ("entry_price", "target_price", "stop_price")


def extraction_eval(expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counts, precision, recall, F1 (0 where nothing can be divided) and accuracy per field on joint positives.

    Both hold id, is_call and the fields above; an id missing on a side is no call there. An expected timeframe that is
    unknown counts as unspecified. Accuracies are null without joint positives.
    """
    side = lambda df, k: df.select("id", *[F.col(c).alias(f"{k}_{c}") for c in ("is_call", *SAME, *PRICES)])
    rows = side(expected, "e").join(side(found, "f"), "id", "full_outer").withColumn("e_timeframe", F.coalesce("e_timeframe", F.lit("unspecified")))
    want, got = F.coalesce("e_is_call", F.lit(False)), F.coalesce("f_is_call", F.lit(False))
    both = want & got
    share = lambda c, ok: F.avg(F.when(both, F.coalesce(ok, F.lit(False)).cast("double"))).alias(f"{c}_accuracy")
    out = rows.agg(
        F.count_if(both).alias("tp"), F.count_if(~want & got).alias("fp"), F.count_if(want & ~got).alias("fn"), F.count_if(~want & ~got).alias("tn"),
        *[share(c, F.col(f"e_{c}").eqNullSafe(F.col(f"f_{c}"))) for c in SAME], *[share(c, _same_price(F.col(f"e_{c}"), F.col(f"f_{c}"))) for c in PRICES],
    )
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp = F.col("tp")
    out = out.withColumns({"precision": over(tp, tp + F.col("fp")), "recall": over(tp, tp + F.col("fn"))})
    return out.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
