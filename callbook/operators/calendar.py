"""Sessions: numbering, as-of session, n-th next session, rebalance dates.

Sessions are one row per trading day for the whole market: a dimension bounded by the calendar, so it is broadcast,
and its window over all rows is a window over a few thousand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_sessions(sessions: DataFrame) -> DataFrame:
    """sessions with session_no (from 1) in time order."""
    return sessions.withColumn("session_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("session_date")))


def _days(sessions: DataFrame, stamp: str) -> DataFrame:
    """(day, before): sessions whose stamp falls before that calendar day, and its own session's stamp if any."""
    numbered = numbered_sessions(sessions)
    every = Window.partitionBy(F.lit(0)).orderBy("session_date")
    following = F.coalesce(F.date_sub(F.to_date(F.lead("session_date").over(every)), 1), F.date_add(F.to_date("session_date"), 400))
    return numbered.withColumn("until", following).select("session_no", F.col(stamp).alias("stamp"), F.explode(F.sequence(F.to_date("session_date"), "until")).alias("day"))


def as_of_session(events: DataFrame, sessions: DataFrame, at: str, stamp: str = "market_close") -> DataFrame:
    """Events with session_no of the last session whose stamp is at or before `at` (0 if none)."""
    days = _days(sessions, stamp)
    found = events.withColumn("day", F.to_date(at)).join(F.broadcast(days), "day", "left")
    number = F.when(F.col("stamp") <= F.col(at), F.col("session_no")).otherwise(F.col("session_no") - 1)
    return found.withColumn("session_no", F.coalesce(number, F.lit(0))).drop("day", "stamp")


def nth_session_close(events: DataFrame, sessions: DataFrame, at: str, n: str, to: str = "horizon_end") -> DataFrame:
    """Events with the close of the n-th session whose open is strictly after `at` (null where the calendar ends)."""
    dated = as_of_session(events, sessions, at, "market_open").withColumn("_target", F.col("session_no") + F.col(n)).drop("session_no")
    closes = numbered_sessions(sessions).select(F.col("session_no").alias("_target"), F.col("market_close").alias(to))
    return dated.join(F.broadcast(closes), "_target", "left").drop("_target")


def knowable_through(as_ofs: DataFrame, sessions: DataFrame) -> DataFrame:
    """as_ofs with the date of the last session that has closed by as_of (as_of's own date where the calendar has none)."""
    dated = as_of_session(as_ofs, sessions, "as_of")
    dates = numbered_sessions(sessions).select("session_no", F.col("session_date").alias("knowable_through"))
    return dated.join(F.broadcast(dates), "session_no", "left").drop("session_no").withColumn("knowable_through", F.coalesce("knowable_through", F.date_trunc("day", "as_of")))


def rebalance_dates(sessions: DataFrame, start, end, frequency: str = "weekly") -> DataFrame:
    """as_of = close of the sessions in [start, end]; weekly: the first session of each ISO week."""
    inside = sessions.where(F.col("session_date").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    if frequency == "weekly":
        week = Window.partitionBy(F.extract(F.lit("YEAROFWEEK"), "session_date"), F.weekofyear("session_date")).orderBy("session_date")
        inside = inside.withColumn("_n", F.row_number().over(week)).where("_n = 1").drop("_n")
    return inside.select("session_date", F.col("market_close").alias("as_of"))
