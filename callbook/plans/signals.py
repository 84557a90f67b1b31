"""Mentions to signals, coverage and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbook.operators.asof import over_times

CLASS_WEIGHT = {"factual": 1.0, "opinion": 0.5, "speculation": 0.25, "hype": 0.0}
WINDOW_DAYS = {"1d": 1, "7d": 7, "30d": 30}
CREDIBLE = 0.55


def polarity_value(polarity: Column) -> Column:
    """+1 for bullish or long, -1 for bearish or short, else 0."""
    return F.when(polarity.isin("bullish", "long"), 1.0).when(polarity.isin("bearish", "short"), -1.0).otherwise(0.0)


def class_weight(claim_class: Column) -> Column:
    weight = F.lit(0.0)
    for name, value in CLASS_WEIGHT.items():
        weight = F.when(claim_class == name, value).otherwise(weight)
    return weight


def latest_credibility(scorecards: DataFrame) -> DataFrame:
    """(creator_id, credibility) of the newest scorecard with a lower bound, over all windows and horizons."""
    newest = F.max_by("hit_rate_lower_ci", F.struct("computed_at", "scorecard_id"))
    return scorecards.where("hit_rate_lower_ci is not null").groupBy("creator_id").agg(newest.alias("credibility"))


def scorecard_as_of(as_ofs: DataFrame, scorecards: DataFrame) -> DataFrame:
    """(as_of, creator_id, hit_rate_lower_ci) of each creator's newest scorecard computed by as_of.

    A scorecard holds from its computation until the creator's next one. The as_ofs of the days from one to the other are
    looked up in the calendar, so only rows of the result are made; on the days of a change the hour decides.
    """
    w = Window.partitionBy("creator_id").orderBy("computed_at", "scorecard_id")
    held = scorecards.withColumn("until", F.lead("computed_at").over(w)).drop("as_of")
    met = over_times(held, as_ofs.select("as_of").distinct(), "as_of", F.to_date("computed_at"), F.to_date("until"))
    return met.where((F.col("computed_at") <= F.col("as_of")) & (F.col("until").isNull() | (F.col("until") > F.col("as_of")))).select("as_of", "creator_id", "hit_rate_lower_ci")


def ticker_signals(calls: DataFrame, claims: DataFrame, scorecards: DataFrame, window_end) -> DataFrame:
    """A1-A3: per ticker, window (1d, 7d, 30d, both ends inclusive) and signal type, all in one shuffle.

    Each accepted row goes to the windows and types that hold it. A creator without credibility weighs 1; claims weigh
    by class as well, hype and unknown classes nothing. credibility_weighted is null where the weights sum to 0.
    """
    end = F.lit(window_end).cast("timestamp")
    call_rows = calls.where("status = 'accepted'").select("ticker", "creator_id", "document_id", "posted_at", F.col("direction").alias("polarity"), F.lit(None).cast("string").alias("claim_class"), F.lit(True).alias("is_call"))
    claim_rows = claims.where("status = 'accepted' and ticker is not null").select("ticker", "creator_id", "document_id", "posted_at", "polarity", "claim_class", F.lit(False).alias("is_call"))
    rows = call_rows.unionByName(claim_rows).where((F.col("posted_at") <= end) & (F.col("posted_at") >= end - F.expr("interval 30 days")))
    rows = rows.join(latest_credibility(scorecards), "creator_id", "left")
    credible = F.coalesce(F.col("credibility") > CREDIBLE, F.lit(False))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("is_call"), "trade_calls"),
            F.when(~F.col("is_call"), "claims_all"),
            F.when(~F.col("is_call") & (F.col("claim_class") == "factual"), "claims_factual"),
            F.when(F.col("is_call") & credible, "creator_consensus"),
        )
    )
    windows = F.array_compact(F.array(*[F.when(F.col("posted_at") >= end - F.expr(f"interval {d} days"), F.lit(w)) for w, d in WINDOW_DAYS.items()]))
    rows = rows.withColumn("window_size", F.explode(windows)).withColumn("signal_type", F.explode(kinds))
    p = polarity_value(F.col("polarity"))
    weight = F.coalesce("credibility", F.lit(1.0)) * F.when(F.col("is_call"), 1.0).otherwise(class_weight(F.col("claim_class")))
    counts = [F.count_if(F.coalesce(F.col("claim_class") == c, F.lit(False))).alias(f"n_{c}") for c in CLASS_WEIGHT]
    out = rows.groupBy("ticker", "window_size", "signal_type").agg(
        F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("creator_id").alias("n_creators"), F.count_distinct("document_id").alias("n_documents"),
        F.avg(p).alias("net_polarity"), (F.sum(p * weight) / F.nullif(F.sum(weight), F.lit(0.0))).alias("credibility_weighted"), *counts,
    )
    return out.withColumn("window_end", end)


def mentions(calls: DataFrame, claims: DataFrame) -> DataFrame:
    """S3: accepted calls and claims in one table."""
    one = lambda rows, is_call: rows.where("status = 'accepted'").select("ticker", "creator_id", "final_confidence", F.lit(is_call).alias("is_call"))
    return one(calls, True).unionByName(one(claims, False))


def creator_coverage(tickers: DataFrame, calls: DataFrame, claims: DataFrame) -> DataFrame:
    """Per requested ticker, accepted calls and claims and their mean confidence; tickers without any stay with 0 and null."""
    found = mentions(calls, claims).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_mentions"), F.avg("final_confidence").alias("avg_confidence"))
    return tickers.select("ticker").distinct().join(found, "ticker", "left").withColumn("n_mentions", F.coalesce("n_mentions", F.lit(0)))


def ticker_creator_coverage(calls: DataFrame, claims: DataFrame, scorecards: DataFrame) -> DataFrame:
    """Per ticker and creator, calls, claims, last mention, credibility and net polarity; calibrated creators first."""
    both = calls.where("status = 'accepted'").select("ticker", "creator_id", "posted_at", F.col("direction").alias("polarity"), F.lit(1).alias("c"), F.lit(0).alias("m")).unionByName(
        claims.where("status = 'accepted' and ticker is not null").select("ticker", "creator_id", "posted_at", "polarity", F.lit(0).alias("c"), F.lit(1).alias("m"))
    )
    out = both.groupBy("ticker", "creator_id").agg(F.sum("c").alias("n_calls"), F.sum("m").alias("n_claims"), F.max("posted_at").alias("last_mention"), F.avg(polarity_value(F.col("polarity"))).alias("net_polarity"))
    out = out.join(latest_credibility(scorecards), "creator_id", "left").withColumn("calibrated", F.col("credibility").isNotNull())
    return out.orderBy("ticker", F.desc("calibrated"), F.desc_nulls_last("credibility"), F.desc(F.col("n_calls") + F.col("n_claims")), "creator_id")


def ticker_list(calls: DataFrame) -> DataFrame:
    """Calls and last post per ticker, most first."""
    return calls.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_calls"), F.max("posted_at").alias("last_seen")).orderBy(F.desc("n_calls"), "ticker")


def ticker_summary(calls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per ticker, calls, calls by direction and outcomes by status."""
    way = {d: F.count_if(F.col("direction") == d).alias(f"n_{d}") for d in ("long", "short", "unspecified")}
    state = {s: F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("evaluated", "not_triggered", "data_missing")}
    told = outcomes.select("call_id", "status").join(calls.select("call_id", "ticker"), "call_id").groupBy("ticker").agg(*state.values())
    return calls.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_calls"), *way.values()).join(told, "ticker", "left").na.fill(0)


def list_calls(calls: DataFrame, *, creator_id=None, ticker=None, direction=None, status=None, manual_status=None, min_confidence=None, order: str = "recent", limit: int = 50, offset: int = 0) -> DataFrame:
    """calls by optional filters, newest or most confident first, with the total before paging as n_total."""
    rows = calls
    for column, value in (("creator_id", creator_id), ("ticker", ticker and ticker.upper()), ("direction", direction), ("status", status), ("manual_status", manual_status)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if min_confidence is not None:
        rows = rows.where(F.col("final_confidence") >= min_confidence)
    total = rows.agg(F.count(F.lit(1)).alias("n_total"))
    key = F.desc_nulls_last("final_confidence") if order == "confidence" else F.desc("posted_at")
    return rows.orderBy(key, "call_id").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def ticker_claims(claims: DataFrame, ticker: str, since=None, types=None, classes=None, polarity=None, creator_id=None, status: str = "accepted", limit: int = 50, offset: int = 0) -> DataFrame:
    """a page of a ticker's claims, newest first."""
    rows = claims.where((F.col("ticker") == ticker.upper()) & (F.col("status") == status))
    if since is not None:
        rows = rows.where(F.col("posted_at") >= F.lit(since).cast("timestamp"))
    for column, values in (("claim_type", types), ("claim_class", classes), ("polarity", polarity and [polarity]), ("creator_id", creator_id is not None and [creator_id])):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return rows.orderBy(F.desc("posted_at"), "claim_id").offset(offset).limit(limit)


def signals_feed(signals: DataFrame, signal_type: str | None = None, window_size: str | None = None) -> DataFrame:
    """signals of a type and a window, the newest window first."""
    rows = signals
    for column, value in (("signal_type", signal_type), ("window_size", window_size)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("window_end"), "signal_type", "ticker")


def recent_claims(claims: DataFrame, creators: DataFrame, as_of, days: int = 30, most: int = 12) -> DataFrame:
    """Up to `most` newest accepted claims per ticker in the days before as_of, with the creator's name if known."""
    end = F.lit(as_of).cast("timestamp")
    rows = claims.where("status = 'accepted' and ticker is not null").where((F.col("posted_at") <= end) & (F.col("posted_at") >= end - F.expr(f"interval {days} days")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("posted_at"), "claim_id"))).where(F.col("rank") <= most)
    return ranked.join(creators.select("creator_id", "display_name"), "creator_id", "left")


def document_view(documents: DataFrame, channels: DataFrame, creators: DataFrame) -> DataFrame:
    """Documents (document_id, channel_id, posted_at, ...) with the creator of their channel; those without one are left out."""
    return documents.join(channels.select("channel_id", "creator_id"), "channel_id").join(creators.select("creator_id", "display_name", "active"), "creator_id")


def with_context(rows: DataFrame, documents: DataFrame, channels: DataFrame, creators: DataFrame) -> DataFrame:
    """Rows of documents (calls or claims) with when and by whom their document was posted. The document decides, not the row."""
    context = document_view(documents, channels, creators).select("document_id", "channel_id", "creator_id", "posted_at", "display_name", "active")
    return rows.drop("creator_id", "posted_at").join(context, "document_id")


def calls_overlay(calls: DataFrame, outcomes: DataFrame, horizon: str = "5d") -> DataFrame:
    """Calls with their outcome at one horizon, if any."""
    only = outcomes.where(F.col("horizon") == horizon).select("call_id", "activation_at", "entry_fill_price", "return_pct", F.col("status").alias("outcome_status"))
    return calls.select("call_id", "ticker", "posted_at", "direction").join(only, "call_id", "left")


def nested_outcomes(calls: DataFrame, outcomes: DataFrame, documents: DataFrame, channels: DataFrame, creators: DataFrame) -> DataFrame:
    """Calls (with extracted_at) with their creator if known, the time of their document or else of extraction, and all
    their outcomes as an array sorted by horizon (empty if none)."""
    lists = outcomes.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("horizon", "status", "return_pct"))).alias("outcomes"))
    posted = documents.select("document_id", "channel_id", F.col("posted_at").alias("_posted")).join(channels.select("channel_id", "creator_id"), "channel_id", "left").join(creators.select("creator_id", "display_name"), "creator_id", "left")
    out = calls.drop("creator_id", "posted_at").join(posted, "document_id", "left").join(lists, "call_id", "left")
    none = F.array().cast("array<struct<horizon:string,status:string,return_pct:double>>")
    return out.withColumns({"posted_at": F.coalesce("_posted", "extracted_at"), "outcomes": F.coalesce("outcomes", none)}).drop("_posted")


def processed_documents(calls: DataFrame, claims: DataFrame, version: str | None = None) -> DataFrame:
    """document_id of every call and claim, of one extractor_version where given."""
    rows = [r if version is None else r.where(F.col("extractor_version") == version) for r in (calls, claims)]
    return rows[0].select("document_id").unionByName(rows[1].select("document_id"))


def pending_documents(documents: DataFrame, segments: DataFrame, processed: DataFrame, min_segments: int = 3, creator: str | None = None) -> DataFrame:
    """Documents (document_view) with enough segments that no call or claim comes from, newest first; of creators whose name holds a text, in any case."""
    if creator is not None:
        documents = documents.where(F.col("display_name").ilike(f"%{creator}%"))
    enough = segments.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_segments")).where(F.col("n_segments") >= min_segments)
    rows = documents.join(enough, "document_id").join(processed.select("document_id").distinct(), "document_id", "left_anti")
    return rows.orderBy(F.desc_nulls_last("posted_at"), "document_id")


def latest_plan(plans: DataFrame) -> DataFrame:
    """Newest plan per ticker, mode and UTC day."""
    return plans.groupBy("ticker", "mode", F.to_date("computed_at").alias("day")).agg(F.max("plan_id").alias("plan_id"))


def coverage_flags(tickers: DataFrame, signals: DataFrame, calls: DataFrame, claims: DataFrame) -> DataFrame:
    """Whether a ticker has signals, accepted calls and accepted claims."""
    has = lambda df, name: df.select("ticker").distinct().withColumn(name, F.lit(True))
    out = tickers.select("ticker").distinct().join(has(signals, "has_signals"), "ticker", "left")
    for rows, name in ((calls, "has_calls"), (claims, "has_claims")):
        out = out.join(has(rows.where("status = 'accepted'"), name), "ticker", "left")
    return out.na.fill(False)


#: States of a review.
REVIEW_STATES = ("unreviewed", "confirmed", "rejected", "flagged")


def review_calls(calls: DataFrame, reviews: DataFrame) -> DataFrame:
    """calls with reviews (call_id, manual_status, notes, reviewed_at) applied; notes only where given, no review time when
    set back to unreviewed. An unknown state is an error: the job fails with it when it runs."""
    state = F.col("manual_status")
    known = reviews.withColumn("manual_status", F.when(state.isin(*REVIEW_STATES), state).otherwise(F.raise_error(F.concat(F.lit("unknown manual_status "), F.coalesce(state, F.lit("null")))).cast("string")))
    joined = calls.join(known.select("call_id", F.col("manual_status").alias("_s"), F.col("notes").alias("_n"), F.col("reviewed_at").alias("_t")), "call_id", "left")
    state = F.coalesce("_s", "manual_status")
    when = F.when(F.col("_s") == "unreviewed", None).when(F.col("_s").isNotNull(), F.col("_t")).otherwise(F.col("reviewed_at"))
    return joined.withColumns({"manual_status": state, "notes": F.coalesce("_n", "notes"), "reviewed_at": when}).drop("_s", "_n", "_t")


def latest_signals(signals: DataFrame, as_of) -> DataFrame:
    """Newest row per ticker, window and type whose window ends by as_of."""
    w = Window.partitionBy("ticker", "window_size", "signal_type").orderBy(F.desc("window_end"))
    return signals.where(F.col("window_end") <= F.lit(as_of).cast("timestamp")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def active_creators(creators: DataFrame) -> DataFrame:
    """creators that are active, by name."""
    return creators.where("active").orderBy("display_name")


def scan_input(watchlist: DataFrame) -> DataFrame:
    """tickers of a watchlist, trimmed and upper-cased, each once."""
    return watchlist.where("entity_type = 'ticker'").select(F.upper(F.trim("entity_id")).alias("ticker")).where("ticker <> ''").distinct()


def labels(tags: DataFrame) -> DataFrame:
    """distinct tag labels in order."""
    return tags.select("label").distinct().orderBy("label")


def entity_tags(tags: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    """the tags of one entity, newest first."""
    return tags.where((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)).orderBy(F.desc("created_at"), "label")


def document_segments(segments: DataFrame, document_id: int) -> DataFrame:
    """a document's segments in time order."""
    return segments.where(F.col("document_id") == document_id).orderBy("start_seconds", "segment_id")


#: Setups that mentions can confirm, ages in days of fresh and stale coverage, and the mentions and polarity that count.
BULLISH_SETUPS = ("strong_uptrend", "uptrend_pullback", "breakout_candidate", "extended_momentum")
BEARISH_SETUPS = ("downtrend",)
FRESH_DAYS, STALE_DAYS = 30, 90
ENOUGH_MENTIONS, SMALL_SAMPLE, CLEAR_POLARITY = 3, 5, 0.1


def transcript_context(asked: DataFrame, signals: DataFrame, claims: DataFrame, calls: DataFrame, scorecards: DataFrame) -> DataFrame:
    """What was said of each asked (ticker, as_of, setup_type) by then, and whether it confirms the setup.

    asked has one row per ticker. Accepted claims and calls count from whenever until as_of. The polarity is that of the
    newest 30d claims_all signal by as_of or, without one, the mean over claims of the last 30 days. Creators are
    calibrated when any scorecard gives them a lower bound. Each table meets the asked tickers by one equi-join.
    """
    one = asked.select("ticker", "as_of")
    both = claims.where("status = 'accepted'").select("ticker", "creator_id", "posted_at", polarity_value(F.col("polarity")).alias("p"), F.lit(1).alias("claim")).unionByName(
        calls.where("status = 'accepted'").select("ticker", "creator_id", "posted_at", F.lit(None).cast("double").alias("p"), F.lit(0).alias("claim"))
    )
    calibrated = scorecards.where("hit_rate_lower_ci is not null").select("creator_id", F.lit(True).alias("calibrated")).distinct()
    said = both.join(one, "ticker").where("posted_at <= as_of").join(calibrated, "creator_id", "left")
    lately = F.col("posted_at") >= F.col("as_of") - F.expr("interval 30 days")
    told = said.groupBy("ticker").agg(
        F.sum("claim").alias("n_claims"), F.sum(1 - F.col("claim")).alias("n_calls"), F.max("posted_at").alias("most_recent_at"), F.count_distinct("creator_id").alias("n_creators"),
        F.count_distinct(F.when(F.col("calibrated"), F.col("creator_id"))).alias("n_calibrated"), F.avg(F.when(lately, F.col("p"))).alias("_recent"),
    )
    heard = signals.join(one, "ticker").where("window_end <= as_of")
    newest = F.when((F.col("window_size") == "30d") & (F.col("signal_type") == "claims_all"), F.struct("window_end", "net_polarity", "credibility_weighted"))
    slots = heard.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_signals"), F.max(newest).alias("_s"))
    out = asked.join(told, "ticker", "left").join(slots, "ticker", "left").na.fill(0, ["n_claims", "n_calls", "n_creators", "n_calibrated", "n_signals"])
    mentions, days = F.col("n_claims") + F.col("n_calls"), F.floor((F.unix_timestamp("as_of") - F.unix_timestamp("most_recent_at")) / 86400)
    p = F.coalesce("_s.net_polarity", "_recent")
    sided = lambda sign: F.when(p * sign > CLEAR_POLARITY, "confirms").when(p * sign < -CLEAR_POLARITY, "contradicts").otherwise("irrelevant")
    verdict = F.when(F.col("setup_type").isin(*BULLISH_SETUPS), sided(1)).when(F.col("setup_type").isin(*BEARISH_SETUPS), sided(-1)).otherwise("irrelevant")
    return out.withColumns(
        {
            "days_since": days, "coverage": F.when(days.isNull(), "absent").when(days <= FRESH_DAYS, "fresh").when(days <= STALE_DAYS, "stale").otherwise("historical_only"),
            "net_polarity_30d": p, "weighted_polarity_30d": F.col("_s.credibility_weighted"), "has_data": (mentions > 0) | (F.col("n_signals") > 0), "small_sample": mentions < SMALL_SAMPLE,
            "verdict": F.when(p.isNotNull() & (mentions >= ENOUGH_MENTIONS), verdict).otherwise("unknown"),
        }
    ).drop("_recent", "_s")
