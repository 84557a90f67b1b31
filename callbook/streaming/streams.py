"""Streaming forms of the daily jobs (ST1-ST5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from callbook.plans.signals import WINDOW_DAYS, class_weight, polarity_value


def unique_documents(raw: DataFrame, late: str = "2 days") -> DataFrame:
    """ST1: each (source_type, external_id) once within the watermark on posted_at; of a table, once altogether (its earliest)."""
    keys = ["source_type", "external_id"]
    if not raw.isStreaming:
        rest = [c for c in raw.columns if c not in keys]
        return raw.groupBy(*keys).agg(F.min_by(F.struct(*rest), "posted_at").alias("first")).select(*keys, "first.*").select(raw.columns)
    return raw.withWatermark("posted_at", late).dropDuplicatesWithinWatermark(keys)


def continuous_signals(claims: DataFrame, size: str = "1d", late: str = "2 days") -> DataFrame:
    """ST2: per ticker and window (1d tumbling; 7d and 30d sliding by a day) mentions, approximate distinct creators and mean polarity."""
    days = WINDOW_DAYS[size]
    rows = claims.where("status = 'accepted' and ticker is not null").withWatermark("posted_at", late)
    span = F.window("posted_at", f"{days} days", "1 day")
    out = rows.groupBy(span.alias("w"), "ticker").agg(F.count(F.lit(1)).alias("n_mentions"), F.approx_count_distinct("creator_id").alias("n_creators"), F.avg(polarity_value(F.col("polarity"))).alias("net_polarity"))
    return out.select("ticker", F.col("w.end").alias("window_end"), F.lit(size).alias("window_size"), "n_mentions", "n_creators", "net_polarity")


def daily_mentions(claims: DataFrame, calls: DataFrame, credibility: DataFrame, late: str = "2 days") -> DataFrame:
    """ST2: per ticker and UTC day accepted claims and calls, sums of polarity, weights and weighted polarity, and a sketch of creators.

    Both tables may be streams. A creator without a credibility (creator_id, credibility) weighs 1, claims weigh by class as
    well. Rows of this table add up and their sketches merge, so `window_signals` makes any window of days from it: a claim is
    counted once, however long the windows.
    """
    call_rows = calls.where("status = 'accepted' and ticker is not null").select("ticker", "creator_id", "posted_at", F.col("direction").alias("polarity"), F.lit(1.0).alias("class"), F.lit(1).alias("call"))
    claim_rows = claims.where("status = 'accepted' and ticker is not null").select("ticker", "creator_id", "posted_at", "polarity", class_weight(F.col("claim_class")).alias("class"), F.lit(0).alias("call"))
    rows = call_rows.unionByName(claim_rows).withWatermark("posted_at", late).join(credibility, "creator_id", "left")
    p, weight = polarity_value(F.col("polarity")), F.coalesce("credibility", F.lit(1.0)) * F.col("class")
    out = rows.groupBy(F.window("posted_at", "1 day").alias("w"), "ticker").agg(
        F.sum(1 - F.col("call")).alias("n_claims"), F.sum("call").alias("n_calls"), F.sum(p).alias("polarity"), F.sum(weight).alias("weight"), F.sum(p * weight).alias("weighted"), F.hll_sketch_agg("creator_id", 14).alias("creators")
    )
    return out.select("ticker", F.to_date("w.start").alias("day"), "n_claims", "n_calls", "polarity", "weight", "weighted", "creators")


def window_signals(daily: DataFrame, size: str) -> DataFrame:
    """ST2: windows of 1, 7 or 30 days that end with each day on which a ticker was mentioned in them, from daily_mentions (a table or its stream's result)."""
    days = WINDOW_DAYS[size]
    ends = F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", days)))
    out = daily.withColumn("window_end", ends).groupBy("ticker", "window_end").agg(
        F.sum("n_claims").alias("n_claims"), F.sum("n_calls").alias("n_calls"), F.hll_sketch_estimate(F.hll_union_agg("creators")).alias("n_creators"),
        (F.sum("polarity") / F.sum(F.col("n_claims") + F.col("n_calls"))).alias("net_polarity"), (F.sum("weighted") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("credibility_weighted"),
    )
    return out.withColumns({"window_end": F.col("window_end").cast("timestamp"), "window_size": F.lit(size)})


def _table_at(spark: SparkSession, path: str, schema) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else None


def evaluate_batches(evaluate: Callable[[DataFrame], DataFrame], path: str, day: str | None = None) -> Callable[[DataFrame, int], None]:
    """ST3: a foreachBatch function that evaluates a batch's calls and appends outcomes of keys not yet in the table at path.

    What the table holds decides, not the batch's number: a batch that comes again, or a query started anew over the same
    table, appends nothing twice. With `day`, a date column of the outcomes that is the same whenever a call is evaluated
    (such as that of its post), the table is partitioned by it and only the batch's own days of it are read.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        found = evaluate(batch).dropDuplicates(["call_id", "horizon"])
        held = _table_at(batch.sparkSession, path, found.schema)
        if held is not None and day is not None:
            days = [r[0] for r in found.select(day).distinct().collect()]  # as many as the batch has days
            held = held.where(F.col(day).isin([d for d in days if d is not None]) | (F.col(day).isNull() if None in days else F.lit(False)))
        fresh = found if held is None else found.join(held.select("call_id", "horizon"), ["call_id", "horizon"], "left_anti")
        writer = fresh.write.mode("append")
        (writer if day is None else writer.partitionBy(day)).parquet(path)

    return run


POSITION = "ticker string, quantity double, cost_basis double, realized double, rejected long"


def live_positions(trades: DataFrame) -> DataFrame:
    """ST5: after each batch, the positions of the tickers that traded in it (update mode), folded at average cost.

    trades: ticker, side, quantity, price_per_share, fees, traded_at, id. The state of a ticker is its quantity, cost and
    realized gain; trades of a batch are folded in order of time and id. Sells beyond what is held, and unknown sides,
    change nothing and are counted as rejected. Trades of later batches follow those of earlier ones.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        quantity, basis, realized, rejected = _fold(state.get if state.exists else (0.0, 0.0, 0.0, 0), pd.concat(list(frames)))
        state.update((quantity, basis, realized, rejected))
        yield pd.DataFrame([(*key, quantity, basis, realized, rejected)], columns=["ticker", "quantity", "cost_basis", "realized", "rejected"])

    state = "quantity double, cost_basis double, realized double, rejected long"
    return trades.groupBy("ticker").applyInPandasWithState(fold, POSITION, state, "update", GroupStateTimeout.NoTimeout)


TRADE = "traded_at timestamp, id long, side string, quantity double, price_per_share double, fees double"


def _fold(state: tuple[float, float, float, int], trades: pd.DataFrame) -> tuple[float, float, float, int]:
    """Quantity, basis, realized gain and rejected trades after more trades in order."""
    quantity, basis, realized, rejected = state
    trades = trades.sort_values(["traded_at", "id"])
    for side, n, price, fees in zip(trades["side"], trades["quantity"], trades["price_per_share"], trades["fees"].fillna(0.0), strict=True):
        if side == "buy":
            quantity, basis = quantity + n, basis + n * price + fees
        elif side == "sell" and n <= quantity + 1e-9:
            cost = basis * n / quantity if quantity else 0.0
            realized += n * price - fees - cost
            quantity, basis = quantity - n, basis - cost
            if abs(quantity) <= 1e-9:
                quantity, basis = 0.0, 0.0
        else:
            rejected += 1
    return quantity, basis, realized, rejected


class _Ordered(StatefulProcessor):
    """Holds trades until the watermark has passed them, then folds them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", TRADE)
        self.position = handle.getValueState("position", "quantity double, cost_basis double, realized double, rejected long")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for frame in rows:
            if len(frame):
                kept = frame[["traded_at", "id", "side", "quantity", "price_per_share", "fees"]]
                self.waiting.appendList([tuple(None if pd.isna(v) else v for v in row) for row in kept.itertuples(index=False)])
                first = kept["traded_at"].min() if first is None else min(first, kept["traded_at"].min())
        if first is not None:
            self._wake(first, timerValues)
        yield pd.DataFrame(columns=["ticker", "quantity", "cost_basis", "realized", "rejected", "folded_until"])

    def _wake(self, at, timerValues) -> None:
        due = int(pd.Timestamp(at).timestamp() * 1000) + 1
        self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        held = pd.DataFrame(list(self.waiting.get()), columns=["traded_at", "id", "side", "quantity", "price_per_share", "fees"])
        held["traded_at"] = pd.to_datetime(held["traded_at"]) if len(held) else held["traded_at"]
        due = held["traded_at"] < now if len(held) else pd.Series([], dtype=bool)
        ready, rest = held[due], held[~due]
        if len(ready):
            state = _fold(tuple(self.position.get()) if self.position.exists() else (0.0, 0.0, 0.0, 0), ready)
            self.position.update(state)
            self.waiting.clear()
            if len(rest):
                self.waiting.put([tuple(None if pd.isna(v) else v for v in row) for row in rest.itertuples(index=False)])
                self._wake(rest["traded_at"].min(), timerValues)
            yield pd.DataFrame([(*key, *state, ready["traded_at"].max())], columns=["ticker", "quantity", "cost_basis", "realized", "rejected", "folded_until"])

    def close(self) -> None:
        pass


def ordered_positions(trades: DataFrame, late: str = "1 day") -> DataFrame:
    """ST5: positions folded in the order of traded_at and id, however the trades arrive within the watermark.

    Trades wait in state until the watermark has passed their time; event-time timers then release them in order, and each
    release gives the ticker's position with folded_until. Trades that come later than the watermark allows change nothing:
    the query's progress counts them (numRowsDroppedByWatermark). State needs the RocksDB provider
    (spark.sql.streaming.stateStore.providerClass); a query that starts again from its checkpoint goes on with what waits.
    """
    rows = trades.withWatermark("traded_at", late)
    return rows.groupBy("ticker").transformWithStateInPandas(_Ordered(), f"{POSITION}, folded_until timestamp", "update", "eventTime")


def pauses(segments: DataFrame, gap: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """ST4: stretches of speech per document, closed by a pause longer than the gap. segments hold spoken_at timestamps."""
    rows = segments.withWatermark("spoken_at", late).groupBy("document_id", F.session_window("spoken_at", gap).alias("s"))
    return rows.agg(F.count(F.lit(1)).alias("n_segments")).select("document_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "n_segments")
