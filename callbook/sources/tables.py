"""Readers, merges and sinks (IO3-IO12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callbook.functions.text import canonical_symbol
from callbook.plans.screener import screen_table

UNIVERSE = "ticker string, name string, sector string, source string"
GOLD = "id string, source_text string, expected struct<is_trade_call:boolean,ticker:string,direction:string,entry_type:string,entry_price:double,target_price:double,stop_price:double,timeframe:string>, notes string"
PLAN = "as_of string, cost double, lenses array<struct<name:string,direction:string,conviction:string>>"


def read_universe(spark: SparkSession, path: str, sector: str | None = None) -> DataFrame:
    """IO3: ticker, name, sector, source of a CSV with a header; blank tickers are dropped, symbols made canonical."""
    return universe_rows(spark.read.csv(path, header=True, schema=UNIVERSE, enforceSchema=False), sector)


def universe_rows(raw: DataFrame, sector: str | None = None) -> DataFrame:
    """IO3 from a table of the same columns."""
    rows = raw.withColumn("ticker", canonical_symbol(F.col("ticker"))).where("ticker is not null and ticker <> ''")
    return rows if sector is None else rows.where(F.lower("sector") == sector.lower())


def merge_universes(left: DataFrame, right: DataFrame) -> DataFrame:
    """IO4: both by ticker; the left name and sector win, and the source of a ticker in both is `both`."""
    r = right.select("ticker", F.col("name").alias("_n"), F.col("sector").alias("_s"), F.col("source").alias("_o"), F.lit(True).alias("_r"))
    rows = left.withColumn("_l", F.lit(True)).join(r, "ticker", "full_outer")
    source = F.when(F.col("_l") & F.col("_r"), "both").otherwise(F.coalesce("source", "_o"))
    return rows.select("ticker", F.coalesce("name", "_n").alias("name"), F.coalesce("sector", "_s").alias("sector"), source.alias("source")).orderBy("ticker")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """IO5: one JSON object a line; blank lines and those that begin with // are skipped."""
    return gold_of_lines(spark.read.text(path))


def gold_of_lines(lines: DataFrame) -> DataFrame:
    """IO5 from a table of lines (value)."""
    lines = lines.where("trim(value) <> '' and not startswith(trim(value), '//')")
    return lines.select(F.from_json("value", GOLD).alias("g")).select("g.*")


def upsert_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """IO8: new rows, and the existing ones without a new row of their key."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def append_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """IO9: existing rows, and new ones of keys that do not exist yet."""
    return existing.unionByName(new.join(existing.select(*keys).distinct(), keys, "left_anti"))


def gold_rows(gold: DataFrame) -> DataFrame:
    """IO6: read_gold's rows as flat labels; null or empty expectations are no call."""
    fields = [f.name for f in gold.schema["expected"].dataType.fields if f.name != "is_trade_call"]
    known = F.coalesce(*[F.col(f"expected.{c}").cast("string") for c in ("is_trade_call", *fields)]).isNotNull()
    return gold.select(F.col("id").alias("source_key"), "source_text", known.alias("expected_is_call"), *[F.col(f"expected.{c}").alias(f"expected_{c}") for c in fields], F.coalesce("notes", F.lit("")).alias("notes"))


def upsert_gold(existing: DataFrame, incoming: DataFrame, key: str = "source_key") -> DataFrame:
    """IO6: labels with the incoming ones in place of those of their key. Which of repeated incoming keys stays is not defined."""
    return upsert_by_key(existing, incoming.dropDuplicates([key]), [key])


def upsert_counts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """IO6: how many keys of incoming are new and how many replace one."""
    keys = incoming.select(key).distinct().join(existing.select(key, F.lit(True).alias("_old")).distinct(), key, "left")
    return keys.agg(F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_old").isNotNull()).alias("updated"))


def as_utc(column: str) -> Column:
    """A time in text; one without a zone is meant in UTC, whatever the session's zone."""
    text = F.trim(F.col(column).cast("string"))
    return F.try_to_timestamp(F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.contains(text, F.lit(":")), text).otherwise(F.concat(text, F.lit("Z"))))


def ingest_documents(existing: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO7: new documents (source_type, external_id unseen; repeats once) and their segments in rows.

    A posted_at of text or without a zone is meant in UTC. A document without segments is kept and has no rows of them.
    """
    keys = ["source_type", "external_id"]
    fresh = raw.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    if dict(raw.dtypes).get("posted_at") in ("string", "timestamp_ntz"):
        fresh = fresh.withColumn("posted_at", as_utc("posted_at"))
    segments = fresh.select(*keys, F.posexplode("segments").alias("segment_id", "segment")).select(*keys, "segment_id", "segment.*")
    return fresh.drop("segments"), segments


def explode_plan_lenses(plans: DataFrame) -> DataFrame:
    """IO12: one row per lens of plan_json; broken or empty plans give none; as_of falls back to computed_at and then to the day; the cost is shared evenly."""
    parsed = plans.withColumn("p", F.from_json("plan_json", PLAN)).where("p is not null and size(p.lenses) > 0")
    as_of = F.coalesce(F.try_to_timestamp("p.as_of"), F.col("computed_at"), F.col("day_key").cast("timestamp"))
    share = F.round(F.col("p.cost") / F.greatest(F.size("p.lenses"), F.lit(1)), 6)
    rows = parsed.select("plan_id", "ticker", as_of.alias("as_of"), share.alias("cost"), F.explode("p.lenses").alias("l"))
    return rows.select("plan_id", "ticker", "as_of", "cost", F.col("l.name").alias("lens_name"), F.coalesce("l.direction", F.lit("neutral")).alias("direction"), F.coalesce("l.conviction", F.lit("low")).alias("conviction"))


def write_screen(screened: DataFrame, path: str, day: str) -> None:
    """IO10: passing rows as CSV of fixed columns (screener.screen_table) and all rows as JSON, in a folder of the day."""
    screen_table(screened).write.mode("overwrite").csv(f"{path}/day={day}/passing", header=True)
    screened.write.mode("overwrite").json(f"{path}/day={day}/full")


#: The columns of a snapshot.
HEADLINE = (
    "ticker", "as_of", "status", "status_confidence", "setup_type", "setup_confidence", "primary_style", "last_close", "pct_off_52w_high", "return_5d", "return_21d", "return_63d",
    "ma_alignment", "rsi_14", "atr_14_pct", "sma_50_slope_21d_pct", "relative_strength_vs_spy_63d", "nearest_support", "nearest_resistance", "pullback_pct_from_recent_high",
    "breakout_distance_pct", "entry_zone_available", "entry_trigger", "entry_zone_low", "entry_zone_high", "invalidation_reference", "risk_reward_estimate", "transcript_n_calls",
    "transcript_n_claims", "transcript_n_creators", "transcript_polarity_30d", "transcript_coverage_status", "transcript_confirms",
)
#: Where a research view (with its zone and the context of transcripts) has those that differ in name.
SOURCES = {
    "as_of": "ts", "last_close": "close", "pct_off_52w_high": "pct_off_high_52w", "return_5d": "return_5", "return_21d": "return_21", "return_63d": "return_63", "sma_50_slope_21d_pct": "sma_50_slope_21",
    "relative_strength_vs_spy_63d": "rs_63", "nearest_support": "support", "nearest_resistance": "resistance", "pullback_pct_from_recent_high": "pullback_63", "breakout_distance_pct": "breakout_63",
    "entry_zone_available": "available", "entry_trigger": "zone.trigger", "entry_zone_low": "zone.low", "entry_zone_high": "zone.high", "invalidation_reference": "zone.invalidation", "risk_reward_estimate": "reward_risk",
    "transcript_n_calls": "n_calls", "transcript_n_claims": "n_claims", "transcript_n_creators": "n_creators", "transcript_polarity_30d": "net_polarity_30d", "transcript_coverage_status": "coverage", "transcript_confirms": "verdict",
}
_STRINGS = ("ticker", "status", "status_confidence", "setup_type", "setup_confidence", "primary_style", "ma_alignment", "transcript_coverage_status", "transcript_confirms")
TYPES = dict.fromkeys(HEADLINE, "double") | dict.fromkeys(_STRINGS, "string") | dict.fromkeys(("transcript_n_calls", "transcript_n_claims", "transcript_n_creators"), "long") | {"as_of": "timestamp", "entry_zone_available": "boolean"}


def headline(view: DataFrame) -> DataFrame:
    """IO11: a research view's row per (ticker, as_of) cut to the columns of a snapshot, in their order and types; what the view lacks is null."""

    def pick(name: str) -> Column:
        source = next((c for c in (SOURCES.get(name, name), name) if c.split(".")[0] in view.columns), None)
        return (F.lit(None) if source is None else F.col(source)).cast(TYPES[name]).alias(name)

    return view.select(*[pick(c) for c in HEADLINE])


def snapshot(view: DataFrame, path: str) -> None:
    """IO11: append the headline rows of a view."""
    headline(view).write.mode("append").parquet(path)
