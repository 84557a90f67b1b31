"""Signals, coverage, feeds and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from callbook.operators import bars as B
from callbook.operators import calendar as C
from callbook.plans import outcomes as O
from callbook.plans import scoring as S
from callbook.plans import signals as G
from callbook.queries.base import query, r6
from callbook.queries.calls import BASE, OUTCOMES, outcomes
from callbook.testdata import BENCHMARK

END = "2001-01-20 21:00:00"
TS = f"TIMESTAMP '{END}'"
CRED = "cred AS (SELECT creator_id, arg_max(hit_rate_lower_ci, (computed_at, scorecard_id)) AS credibility FROM scorecards WHERE hit_rate_lower_ci IS NOT NULL GROUP BY 1)"
MENTIONS = f"""{CRED},
mentions AS (
  SELECT ticker, creator_id, document_id, posted_at, CASE direction WHEN 'long' THEN 1.0e0 WHEN 'short' THEN -1.0e0 ELSE 0.0e0 END AS p, NULL AS claim_class, true AS is_call, 1.0e0 AS k, final_confidence FROM calls WHERE status='accepted'
  UNION ALL SELECT ticker, creator_id, document_id, posted_at, CASE polarity WHEN 'bullish' THEN 1.0e0 WHEN 'bearish' THEN -1.0e0 ELSE 0.0e0 END, claim_class, false,
    CASE claim_class WHEN 'factual' THEN 1.0e0 WHEN 'opinion' THEN 0.5e0 WHEN 'speculation' THEN 0.25e0 ELSE 0.0e0 END, final_confidence FROM claims WHERE status='accepted'
)"""
MT = ("calls", "claims", "scorecards")


@query("a3_ticker_signals", f"""SELECT ticker, window_size, signal_type, window_end, n_mentions, n_creators, n_documents, n_factual, n_opinion, n_speculation, n_hype, {r6('net_polarity','credibility_weighted')} FROM (
 SELECT m.ticker, w.window_size, s.signal_type, {TS} AS window_end, count(*) AS n_mentions, count(DISTINCT m.creator_id) AS n_creators, count(DISTINCT document_id) AS n_documents, avg(p) AS net_polarity,
  sum(p*k*coalesce(credibility,1.0e0))/nullif(sum(k*coalesce(credibility,1.0e0)),0) AS credibility_weighted, count(*) FILTER (WHERE claim_class='factual') AS n_factual, count(*) FILTER (WHERE claim_class='opinion') AS n_opinion,
  count(*) FILTER (WHERE claim_class='speculation') AS n_speculation, count(*) FILTER (WHERE claim_class='hype') AS n_hype
 FROM mentions m LEFT JOIN cred USING (creator_id) JOIN (VALUES ('1d',1),('7d',7),('30d',30)) w(window_size,d) ON m.posted_at<={TS} AND m.posted_at>={TS}-to_days(w.d)
 JOIN (VALUES ('trade_calls'),('claims_all'),('claims_factual'),('creator_consensus')) s(signal_type)
  ON CASE s.signal_type WHEN 'trade_calls' THEN is_call WHEN 'claims_all' THEN NOT is_call WHEN 'claims_factual' THEN NOT is_call AND claim_class='factual' ELSE is_call AND coalesce(credibility>0.55,false) END
 WHERE m.ticker IS NOT NULL GROUP BY 1,2,3) x""", MT, MENTIONS)
def _(t):
    return G.ticker_signals(t.calls, t.claims, t.scorecards, END)


@query("a1_call_signals", f"SELECT ticker, n_mentions, n_creators, {r6('net_polarity','credibility_weighted')} FROM (SELECT ticker, count(*) AS n_mentions, count(DISTINCT creator_id) AS n_creators, avg(p) AS net_polarity, sum(p*coalesce(credibility,1.0e0))/nullif(sum(coalesce(credibility,1.0e0)),0) AS credibility_weighted FROM mentions LEFT JOIN cred USING (creator_id) WHERE is_call AND posted_at<={TS} AND posted_at>={TS}-INTERVAL 30 DAY GROUP BY 1) x", MT, MENTIONS)
def _(t):
    return G.ticker_signals(t.calls, t.claims, t.scorecards, END).where("window_size = '30d' and signal_type = 'trade_calls'").select("ticker", "n_mentions", "n_creators", "net_polarity", "credibility_weighted")


@query("a2_claim_signals", f"SELECT ticker, n_mentions, {r6('credibility_weighted')} FROM (SELECT ticker, count(*) AS n_mentions, sum(p*k*coalesce(credibility,1.0e0))/nullif(sum(k*coalesce(credibility,1.0e0)),0) AS credibility_weighted FROM mentions LEFT JOIN cred USING (creator_id) WHERE NOT is_call AND ticker IS NOT NULL AND posted_at<={TS} AND posted_at>={TS}-INTERVAL 7 DAY GROUP BY 1) x", MT, MENTIONS)
def _(t):
    return G.ticker_signals(t.calls, t.claims, t.scorecards, END).where("window_size = '7d' and signal_type = 'claims_all'").select("ticker", "n_mentions", "credibility_weighted")


@query("j9_latest_credibility", f"SELECT creator_id, {r6('credibility')} FROM cred", ("scorecards",), CRED)
def _(t):
    return G.latest_credibility(t.scorecards)


@query("a12_creator_coverage", f"SELECT ticker, count(m) AS n_mentions, round(avg(final_confidence),6)+0.0e0 AS avg_confidence FROM (SELECT DISTINCT ticker FROM bars UNION SELECT 'ZZZ') u LEFT JOIN (SELECT *, 1 AS m FROM mentions) USING (ticker) GROUP BY 1", ("bars",) + MT, MENTIONS)
def _(t):
    return G.creator_coverage(t.bars.select("ticker").union(t.spark.sql("select 'ZZZ'")), t.calls, t.claims)


@query("a13_ticker_creator_coverage", f"SELECT ticker, creator_id, n_calls, n_claims, last_mention, credibility IS NOT NULL AS calibrated, {r6('credibility','net_polarity')} FROM (SELECT ticker, creator_id, count(*) FILTER (WHERE is_call) AS n_calls, count(*) FILTER (WHERE NOT is_call) AS n_claims, max(posted_at) AS last_mention, avg(p) AS net_polarity FROM mentions WHERE ticker IS NOT NULL GROUP BY 1,2) x LEFT JOIN cred USING (creator_id)", MT, MENTIONS)
def _(t):
    return G.ticker_creator_coverage(t.calls, t.claims, t.scorecards)


@query("a14_ticker_list", "SELECT ticker, count(*) AS n_calls, max(posted_at) AS last_seen FROM calls GROUP BY 1", ("calls",))
def _(t):
    return G.ticker_list(t.calls)


@query("a15_ticker_summary", "SELECT ticker, n_calls, n_long, n_short, n_unspecified, coalesce(n_evaluated,0) AS n_evaluated, coalesce(n_not_triggered,0) AS n_not_triggered, coalesce(n_data_missing,0) AS n_data_missing FROM (SELECT ticker, count(*) AS n_calls, count(*) FILTER (WHERE direction='long') AS n_long, count(*) FILTER (WHERE direction='short') AS n_short, count(*) FILTER (WHERE direction='unspecified') AS n_unspecified FROM calls GROUP BY 1) a LEFT JOIN (SELECT ticker, count(*) FILTER (WHERE o.status='evaluated') AS n_evaluated, count(*) FILTER (WHERE o.status='not_triggered') AS n_not_triggered, count(*) FILTER (WHERE o.status='data_missing') AS n_data_missing FROM outcomes o JOIN calls USING (call_id) GROUP BY 1) b USING (ticker)", BASE, OUTCOMES)
def _(t):
    return G.ticker_summary(t.calls, outcomes(t))


@query("f5_list_calls", "SELECT call_id, ticker, creator_id, posted_at, direction, (SELECT count(*) FROM calls WHERE ticker='T03' AND direction='long' AND final_confidence>=0.5e0) AS n_total FROM calls WHERE ticker='T03' AND direction='long' AND final_confidence>=0.5e0 ORDER BY posted_at DESC, call_id LIMIT 20 OFFSET 5", ("calls",))
def _(t):
    return G.list_calls(t.calls, ticker="t03", direction="long", min_confidence=0.5, limit=20, offset=5).select("call_id", "ticker", "creator_id", "posted_at", "direction", "n_total")


@query("f6_ticker_claims", "SELECT claim_id, claim_type, claim_class, polarity, posted_at FROM claims WHERE ticker='T05' AND status='accepted' AND posted_at>=TIMESTAMP '2001-01-05' AND claim_type IN ('catalyst','risk') ORDER BY posted_at DESC, claim_id LIMIT 50", ("claims",))
def _(t):
    return G.ticker_claims(t.claims, "t05", "2001-01-05 00:00:00", types=["catalyst", "risk"]).select("claim_id", "claim_type", "claim_class", "polarity", "posted_at")


@query("f6_creator_claims", "SELECT claim_id, posted_at FROM claims WHERE ticker='T05' AND status='accepted' AND creator_id=5 ORDER BY posted_at DESC, claim_id LIMIT 10 OFFSET 3", ("claims",))
def _(t):
    return G.ticker_claims(t.claims, "T05", creator_id=5, limit=10, offset=3).select("claim_id", "posted_at")


@query("f10_entity_tags", "SELECT label, created_at FROM (SELECT concat('topic ', CAST(event_id%7 AS varchar)) AS label, ts AS created_at FROM events WHERE user_id=3) x")
def _(t):
    tags = t.events.select(F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.concat(F.lit("topic "), (F.col("event_id") % 7).cast("string")).alias("label"), F.col("ts").alias("created_at"))
    return G.entity_tags(tags, "user", "3").select("label", "created_at")


@query("f7_signals_feed", f"SELECT ticker, n_mentions FROM (SELECT ticker, count(*) AS n_mentions FROM mentions WHERE NOT is_call AND ticker IS NOT NULL AND claim_class='factual' AND posted_at<={TS} AND posted_at>={TS}-INTERVAL 7 DAY GROUP BY 1) x", MT, MENTIONS)
def _(t):
    return G.signals_feed(G.ticker_signals(t.calls, t.claims, t.scorecards, END), "claims_factual", "7d").select("ticker", "n_mentions")


@query("f11_active_creators", "SELECT creator_id, display_name FROM creators WHERE active", ("creators",))
def _(t):
    return G.active_creators(t.creators).select("creator_id", "display_name")


@query("f12_ticker_bars", "SELECT epoch(ts)::BIGINT AS time, open, high, low, close, coalesce(volume,0) AS volume FROM bars WHERE ticker='T04' AND ts>=TIMESTAMP '2000-06-30'-INTERVAL 90 DAY AND ts<=TIMESTAMP '2000-06-30'", ("bars",))
def _(t):
    return B.ticker_bars(t.bars, "T04", "2000-06-30", 90)


@query("f13_document_segments", "SELECT segment_id, start_seconds, end_seconds, text FROM segments WHERE document_id=3", ("segments",))
def _(t):
    return G.document_segments(t.segments, 3).select("segment_id", "start_seconds", "end_seconds", "text")


@query("j1_calls_with_context", "SELECT call_id, ticker, d.posted_at, k.creator_id, display_name, active FROM calls c JOIN call_documents d USING (document_id) JOIN channels h USING (channel_id) JOIN creators k ON k.creator_id=h.creator_id", ("calls", "call_documents", "channels", "creators"))
def _(t):
    return G.with_context(t.calls, t.call_documents, t.channels, t.creators).select("call_id", "ticker", "posted_at", "creator_id", "display_name", "active")


@query("j2_claims_with_context", "SELECT claim_id, ticker, claim_class, d.posted_at, display_name FROM claims c JOIN claim_documents d USING (document_id) JOIN channels h USING (channel_id) JOIN creators k ON k.creator_id=h.creator_id WHERE ticker IS NOT NULL", ("claims", "claim_documents", "channels", "creators"))
def _(t):
    return G.with_context(t.claims.where("ticker is not null"), t.claim_documents, t.channels, t.creators).select("claim_id", "ticker", "claim_class", "posted_at", "display_name")


@query("j4_outcomes_report", f"SELECT call_id, k.display_name AS creator, d.posted_at, c.ticker, c.direction, c.entry_type, o.horizon, o.activated, o.status, CAST(o.hit_target AS varchar) AS hit_target, CAST(o.hit_stop AS varchar) AS hit_stop, {r6('return_pct','gross_return_pct','benchmark_return_pct','excess_return_pct','mfe','mae')} FROM outcomes o JOIN calls c USING (call_id) JOIN call_documents d USING (document_id) JOIN channels h USING (channel_id) JOIN creators k ON k.creator_id=h.creator_id", BASE + ("call_documents", "channels", "creators"), OUTCOMES)
def _(t):
    rows = S.outcomes_report(outcomes(t), t.calls, t.call_documents, t.channels, t.creators).drop("activation_at", "entry_fill_price", "exit_at", "exit_price")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("hit_target", "hit_stop")})


@query("j3_recent_claims", f"SELECT ticker, claim_id, \"rank\", display_name FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY posted_at DESC, claim_id) AS \"rank\" FROM claims WHERE status='accepted' AND ticker IS NOT NULL AND posted_at<={TS} AND posted_at>={TS}-INTERVAL 30 DAY) c LEFT JOIN creators USING (creator_id) WHERE \"rank\"<=12", ("claims", "creators"))
def _(t):
    return G.recent_claims(t.claims, t.creators, END).select("ticker", "claim_id", "rank", "display_name")


@query("j5_calls_overlay", f"SELECT c.call_id, c.ticker, c.posted_at, c.direction, o.activation_at, o.status AS outcome_status, {r6('entry_fill_price','return_pct')} FROM calls c LEFT JOIN (SELECT * FROM outcomes WHERE horizon='5d') o USING (call_id)", BASE, OUTCOMES)
def _(t):
    return G.calls_overlay(t.calls, outcomes(t))


@query("j6_asof_session", "SELECT call_id, (SELECT count(*) FROM sessions s WHERE s.market_close<=c.posted_at) AS session_no FROM calls c", ("bars", "calls", "sessions"))
def _(t):
    return C.as_of_session(t.calls, t.sessions, "posted_at").select("call_id", F.col("session_no").cast("long").alias("session_no"))


@query("j7_latest_close", "SELECT call_id, round(b.close,6)+0.0e0 AS close, b.ts AS close_ts FROM calls c ASOF LEFT JOIN bars b ON b.ticker=c.ticker AND b.ts<=c.posted_at AND true WHERE b.ts IS NULL OR b.ts>=c.posted_at-INTERVAL 30 DAY UNION ALL SELECT call_id, NULL, NULL FROM calls c ASOF LEFT JOIN bars b ON b.ticker=c.ticker AND b.ts<=c.posted_at WHERE b.ts<c.posted_at-INTERVAL 30 DAY".replace(" AND true", ""), ("bars", "calls"))
def _(t):
    return B.latest_close(t.calls, t.bars, "posted_at").select("call_id", "close", "close_ts")


@query("j8_scorecard_asof", f"SELECT a.as_of, s.creator_id, round(arg_max(coalesce(s.hit_rate_lower_ci,-1), (s.computed_at, s.scorecard_id)),6)+0.0e0 AS lower_ci FROM (SELECT min(market_close) AS as_of, min(session_date) AS k FROM sessions GROUP BY isoyear(session_date), week(session_date)) a JOIN scorecards s ON s.computed_at<=a.as_of GROUP BY 1,2", ("sessions", "scorecards"))
def _(t):
    days = C.rebalance_dates(t.sessions, "1900-01-01", "2100-01-01")
    return G.scorecard_as_of(days, t.scorecards).select("as_of", "creator_id", F.coalesce("hit_rate_lower_ci", F.lit(-1.0)).alias("lower_ci"))


@query("j10_align_benchmark", "SELECT b.ticker, b.ts, b.close, s.close AS benchmark_close FROM bars b JOIN bars s ON s.ticker='T00' AND s.ts=b.ts", ("bars",))
def _(t):
    return B.align_benchmark(t.bars, BENCHMARK).select("ticker", "ts", "close", "benchmark_close")


@query("j11_bars_in_interval", "SELECT call_id, count(b.ts) AS n_bars, round(max(b.high),6) AS top, round(min(b.low),6) AS bottom FROM aimed m JOIN bars b ON b.ticker=m.ticker AND b.ts BETWEEN m.activation_at AND m.horizon_end WHERE m.horizon='5d' GROUP BY 1", BASE, OUTCOMES)
def _(t):
    live = O.activations(t.calls.where("status = 'accepted'"), t.bars).where("activation_at is not null").withColumn("n", F.lit(5))
    aimed = C.nth_session_close(live, t.sessions, "activation_at", "n").where("horizon_end is not null")
    rows = B.bars_in_interval(aimed.select("call_id", "ticker", "horizon_end", "a0", "n"), t.bars, "a0", "n", "horizon_end")
    return rows.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_bars"), F.max("high").alias("top"), F.min("low").alias("bottom"))


PENDING = "done AS (SELECT document_id FROM calls WHERE status='accepted' UNION ALL SELECT document_id FROM claims WHERE claim_id%3=0), long_ones AS (SELECT document_id, count(*) AS n_segments FROM segments GROUP BY 1 HAVING count(*)>=3), pend AS (SELECT d.document_id, title, d.posted_at, n_segments, display_name FROM call_documents d JOIN channels USING (channel_id) JOIN creators USING (creator_id) JOIN long_ones USING (document_id) WHERE d.document_id NOT IN (SELECT document_id FROM done))"
PT = ("segments", "calls", "claims", "call_documents", "channels", "creators")


def pending(t, creator=None):
    versions = lambda rows, live: rows.withColumn("extractor_version", F.when(live, "v2").otherwise("v1"))
    done = G.processed_documents(versions(t.calls, F.col("status") == "accepted"), versions(t.claims, F.col("claim_id") % 3 == 0), "v2")
    return G.pending_documents(G.document_view(t.call_documents, t.channels, t.creators), t.segments, done, creator=creator).select("document_id", "title", "posted_at", "n_segments", "display_name")


@query("j13_pending_documents", "SELECT * FROM pend", PT, PENDING)
def _(t):
    return pending(t)


@query("j13_pending_of_creator", "SELECT * FROM pend WHERE display_name ILIKE '%nation_1%'", PT, PENDING)
def _(t):
    return pending(t, "Nation_1")


@query("j14_plan_cache", "SELECT ticker, mode, CAST(CAST(computed_at AS date) AS varchar) AS day, max(plan_id) AS plan_id FROM (SELECT snapshot_id AS plan_id, ticker, lens_name AS mode, as_of AS computed_at FROM lens_results) GROUP BY 1,2,3", ("lens_results",))
def _(t):
    plans = t.lens_results.select(F.col("snapshot_id").alias("plan_id"), "ticker", F.col("lens_name").alias("mode"), F.col("as_of").alias("computed_at"))
    return G.latest_plan(plans).withColumn("day", F.col("day").cast("string"))


@query("j16_coverage_flags", f"SELECT ticker, ticker IN (SELECT ticker FROM mentions WHERE ticker IS NOT NULL AND posted_at<={TS} AND posted_at>={TS}-INTERVAL 30 DAY) AS has_signals, ticker IN (SELECT ticker FROM calls WHERE status='accepted') AS has_calls, ticker IN (SELECT ticker FROM claims WHERE status='accepted' AND ticker IS NOT NULL) AS has_claims FROM (SELECT DISTINCT ticker FROM bars UNION SELECT 'ZZZ')", ("bars",) + MT, MENTIONS)
def _(t):
    return G.coverage_flags(t.bars.select("ticker").union(t.spark.sql("select 'ZZZ'")), G.ticker_signals(t.calls, t.claims, t.scorecards, END), t.calls, t.claims)


@query("j17_document_view", "SELECT document_id, title, posted_at, creator_id, display_name, active FROM claim_documents JOIN channels USING (channel_id) JOIN creators USING (creator_id)", ("claim_documents", "channels", "creators"))
def _(t):
    return G.document_view(t.claim_documents, t.channels, t.creators).select("document_id", "title", "posted_at", "creator_id", "display_name", "active")


@query("j18_nested_outcomes", "SELECT call_id, any_value(display_name) AS display_name, coalesce(any_value(d.posted_at), any_value(c.posted_at)+INTERVAL 2 DAY) AS posted_at, coalesce(string_agg(o.horizon || '=' || o.status, ',' ORDER BY o.horizon), '') AS outcomes FROM calls c LEFT JOIN call_documents d USING (document_id) LEFT JOIN channels h USING (channel_id) LEFT JOIN creators k ON k.creator_id=h.creator_id LEFT JOIN (SELECT call_id, horizon, status FROM outcomes) o USING (call_id) GROUP BY call_id", BASE + ("call_documents", "channels", "creators"), OUTCOMES)
def _(t):
    calls = t.calls.withColumn("extracted_at", F.col("posted_at") + F.expr("interval 2 days"))
    rows = G.nested_outcomes(calls, outcomes(t), t.call_documents, t.channels, t.creators)
    return rows.select("call_id", "display_name", "posted_at", F.array_join(F.transform("outcomes", lambda o: F.concat_ws("=", o["horizon"], o["status"])), ",").alias("outcomes"))


@query("w25_latest_signals", "SELECT lens_name, ticker, max(as_of) AS window_end FROM lens_results WHERE as_of<=TIMESTAMP '2001-01-20 00:00:00' GROUP BY 1,2", ("lens_results",))
def _(t):
    rows = t.lens_results.select("ticker", F.col("lens_name").alias("signal_type"), F.lit("1d").alias("window_size"), F.col("as_of").alias("window_end"))
    return G.latest_signals(rows, "2001-01-20 00:00:00").select(F.col("signal_type").alias("lens_name"), "ticker", "window_end")


@query("w26_rebalance_dates", "SELECT min(session_date) AS session_date, min(market_close) AS as_of FROM sessions WHERE session_date BETWEEN TIMESTAMP '1999-11-01' AND TIMESTAMP '2000-06-30' GROUP BY isoyear(session_date), week(session_date)", ("sessions",))
def _(t):
    return C.rebalance_dates(t.sessions, "1999-11-01", "2000-06-30")


@query("f4_tradeable", "SELECT DISTINCT a.as_of, b.ticker FROM (SELECT min(market_close) AS as_of, min(session_date) AS k FROM sessions GROUP BY isoyear(session_date), week(session_date)) a JOIN bars b ON b.ts<=a.k AND b.ts>=date_trunc('day', a.as_of-INTERVAL 14 DAY) WHERE coalesce(b.volume,0)>=1000", ("bars", "sessions"))
def _(t):
    days = C.rebalance_dates(t.sessions, "1900-01-01", "2100-01-01").select("as_of")
    return B.tradeable(C.knowable_through(days, t.sessions), t.bars)


@query("s3_mentions", "SELECT is_call, count(*) AS n, count(DISTINCT ticker) AS n_tickers FROM mentions GROUP BY 1", MT, MENTIONS)
def _(t):
    return G.mentions(t.calls, t.claims).groupBy("is_call").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("n_tickers"))


@query("s1_processed_documents", "SELECT document_id, count(*) AS n FROM (SELECT document_id FROM calls UNION ALL SELECT document_id FROM claims) GROUP BY 1", ("calls", "claims"))
def _(t):
    return G.processed_documents(t.calls, t.claims).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
