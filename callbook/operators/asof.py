"""As-of lookups: the newest row at or before an event's time, per key, and the as_of dates that a span of time holds.

Events and rows are cut into the same blocks of days per key, sorted together and swept: each event takes the last row
before it. What a block begins with comes from one short row per key and block. So nothing is laid over days, and one
hot key's events are many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbook.operators.recurrences import day_block


def as_of_join(events: DataFrame, rows: DataFrame, at: str, ts: str, columns: list[str], by: tuple[str, ...] = ("ticker",), ties: str | None = None, days: int = 64) -> DataFrame:
    """events with `columns` of the newest of `rows` (by ts, then `ties`) of their key with ts at or before `at`; null where there is none.

    Events without a key or a time find none. The columns must not be columns of events.
    """
    keys = list(by)
    order = [F.col(ts), F.col(ties)] if ties else [F.col(ts)]
    value = F.struct(F.col(ts).alias("_ts"), *([F.col(ties).alias("_tie")] if ties else []), *[F.col(c).alias(f"v_{c}") for c in columns])
    left = events.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*[F.col(c) for c in events.columns]).alias("_event"))
    right = rows.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_at"), F.lit(0).alias("_kind"), value.alias("_value"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_block", day_block("_at", days))
    last = Window.partitionBy(*keys, "_block").orderBy("_at", "_kind", *(["_value._tie"] if ties else [])).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_found", F.last("_value", True).over(last)).where("_kind = 1")
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    newest = both.groupBy(*keys, "_block").agg(F.max("_value").alias("_value"))
    begins = newest.select(*keys, "_block", F.last("_value", True).over(earlier).alias("_before")).where("_before is not null")
    joined = swept.join(begins, [*keys, "_block"], "left").withColumn("_found", F.coalesce("_found", "_before"))
    known = F.col("_at").isNotNull()
    return joined.select("_event.*", *[F.when(known, F.col(f"_found.v_{c}")).alias(c) for c in columns])


def calendar_row(times: DataFrame, column: str) -> DataFrame:
    """One row: the dates `times` by `column` (_times, an array of structs), the first day (_first), and for each day from it to
    the one after the last how many dates lie on earlier days (_earlier). as_of dates are bounded by the calendar, and so is the row.
    """
    day = lambda t: F.to_date(t[column])
    row = times.where(F.col(column).isNotNull()).agg(F.sort_array(F.collect_list(F.struct(F.col(column), *[F.col(c) for c in times.columns if c != column]))).alias("_times")).where(F.size("_times") > 0)
    row = row.withColumns({"_first": day(F.element_at("_times", 1)), "_last": F.date_add(day(F.element_at("_times", -1)), 1)})
    earlier = F.transform(F.sequence("_first", "_last"), lambda d: F.size(F.filter("_times", lambda t: day(t) < d)))
    return row.select("_times", "_first", "_last", earlier.alias("_earlier"))


def over_times(rows: DataFrame, times: DataFrame, column: str, first_day: Column, last_day: Column) -> DataFrame:
    """Each row with every one of `times` (as_of dates) whose `column` falls on first_day to last_day (null: without end).

    Where the first and the last such date stand is looked up by day in a calendar of one row, so the work is that of the result.
    """
    rows = rows.crossJoin(F.broadcast(calendar_row(times, column)))  # one row
    at = lambda d: F.get("_earlier", F.date_diff(F.greatest(F.col("_first"), F.least(d, F.col("_last"))), F.col("_first")))
    rows = rows.withColumns({"_lo": at(first_day), "_hi": at(F.coalesce(F.date_add(last_day, 1), F.col("_last")))}).where("_hi > _lo")
    rows = rows.withColumn("_t", F.explode(F.slice("_times", F.col("_lo") + 1, F.col("_hi") - F.col("_lo"))))
    return rows.drop("_times", "_first", "_last", "_earlier", "_lo", "_hi").select("*", "_t.*").drop("_t")
