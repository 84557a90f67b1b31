"""Window scores, limits, checks, reviews, digests and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from callbook.functions import text as X
from callbook.operators import indicators as I
from callbook.operators import windows as W
from callbook.plans import research as R
from callbook.plans import signals as G
from callbook.queries.base import query
from callbook.queries.technical import NEAR, PANEL, SETUP, SWINGS, judged, status_sql
from callbook.sources import tables as IO
from callbook.streaming import streams


@query("t5_score_window", f"""SELECT document_id, segment_id, round(1.5e0*m+least(w,3)+0.5e0*least(p,3)+CASE WHEN m>0 AND w>0 THEN 0.5e0 ELSE 0 END,6) AS score FROM (
 SELECT document_id, segment_id, len(regexp_extract_all(text, '\\$T[0-9]{{2}}')) AS m, len(regexp_extract_all(text, '{X.CALL_WORDS}')) AS w, len(list_filter(regexp_extract_all(text, '{X.PRICE}'), lambda x: CAST(replace(x,'$','') AS double) BETWEEN 1 AND 100000)) AS p FROM segments WHERE text IS NOT NULL) q""", ("segments",))
def _(t):
    rows = t.segments.where("text is not null")
    return rows.select("document_id", "segment_id", X.score_window(F.col("text"), F.regexp_count("text", F.lit(r"\$T[0-9]{2}"))).alias("score"))


@query("t8_limits", "SELECT document_id, segment_id, CASE WHEN length(text)>40 THEN rtrim(substr(text,1,39)) || '…' ELSE text END AS text FROM segments WHERE text IS NOT NULL", ("segments",))
def _(t):
    rows = t.segments.where("text is not null")
    return rows.select("document_id", "segment_id", F.get(X.limited(F.array("text"), 5, 40), F.lit(0)).alias("text"))


@query("t10_plausible_price", "SELECT call_id, round(CASE WHEN NOT coalesce(entry_price>0 AND NOT (target_price*p BETWEEN entry_price*0.5e0 AND entry_price*1.5e0), false) THEN target_price*p END,6) AS price FROM (SELECT *, CASE WHEN call_id%4=0 THEN 2.0e0 ELSE 1.0e0 END AS p FROM calls) c", ("calls",))
def _(t):
    price = F.col("target_price") * F.when(F.col("call_id") % 4 == 0, 2.0).otherwise(1.0)
    return t.calls.select("call_id", X.plausible_price(price, F.col("entry_price")).alias("price"))


@query("t11_claim_class", r"SELECT document_id, segment_id, CASE WHEN h THEN 'opinion' ELSE 'factual' END AS claim_class, CASE WHEN h THEN 0.8e0 ELSE 1.0e0 END AS rule_confidence FROM (SELECT *, regexp_matches(text, '(?i)\b(could|might|may(?:be)?|probably|possibly|likely|unlikely|should|would|seems|appears|i\s+think)\b') AS h FROM segments WHERE text IS NOT NULL) q", ("segments",))
def _(t):
    rows = t.segments.where("text is not null").withColumn("c", X.checked_claim(F.lit("factual"), F.col("text")))
    return rows.select("document_id", "segment_id", "c.claim_class", "c.rule_confidence")


DIGEST = " UNION ALL ".join(
    f"SELECT ticker, ts, '{f}' AS field, round({f},6) AS value, '{u}' AS unit, CAST(rsi_14 IS NULL AS int)+CAST(atr_14 IS NULL AS int)+CAST(return_1 IS NULL AS int) AS n_missing FROM panel WHERE {f} IS NOT NULL"
    for f, u in (("rsi_14", "points"), ("atr_14", "price"), ("return_1", "share"))
)


@query("t28_panel_digest", DIGEST, ("bars",), PANEL)
def _(t):
    rows = R.panel_digest(I.panel(t.bars), {"rsi_14": "points", "atr_14": "price", "return_1": "share"})
    return rows.select("ticker", "ts", "field", "value", "unit", F.size("missing").alias("n_missing"))


@query("f9_review_calls", "SELECT call_id, CASE call_id%5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'unreviewed' WHEN 2 THEN 'rejected' WHEN 3 THEN 'flagged' ELSE 'flagged' END AS manual_status, CASE WHEN call_id%5=0 THEN 'good' ELSE 'old' END AS notes, call_id%5<>1 AS reviewed FROM calls", ("calls",))
def _(t):
    calls = t.calls.withColumns({"manual_status": F.lit("flagged"), "notes": F.lit("old"), "reviewed_at": F.col("posted_at")})
    kind = F.get(F.array(*map(F.lit, G.REVIEW_STATES)), F.array_position(F.array(F.lit(1), F.lit(0), F.lit(2), F.lit(3)), (F.col("call_id") % 5).cast("int")).cast("int") - 1)
    reviews = t.calls.where("call_id % 5 < 4").select("call_id", kind.alias("manual_status"), F.when(F.col("call_id") % 5 == 0, "good").alias("notes"), F.col("posted_at").alias("reviewed_at"))
    return G.review_calls(calls, reviews).select("call_id", "manual_status", "notes", F.col("reviewed_at").isNotNull().alias("reviewed"))


@query("f10_labels", "SELECT DISTINCT p_type AS label FROM part")
def _(t):
    return G.labels(t.part.select(F.col("p_type").alias("label")))


@query("w28_clusters", "SELECT document_id, segment_id, cluster FROM (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY start_seconds) AS cluster FROM (SELECT *, CASE WHEN coalesce(start_seconds-lag(end_seconds) OVER (PARTITION BY document_id ORDER BY start_seconds)>3,true) THEN 1 ELSE 0 END AS fresh FROM segments WHERE segment_id%3<>1) q) r", ("segments",))
def _(t):
    rows = t.segments.withColumn("score", F.when(F.col("segment_id") % 3 != 1, 2.0).otherwise(0.0))
    return W.cluster_windows(rows, 2.0, 3.0).select("document_id", "segment_id", F.col("cluster").cast("long").alias("cluster"))


@query("io7_ingest_documents", "SELECT CAST(document_id AS varchar) AS external_id, count(*) AS n_segments FROM segments WHERE document_id%3<>0 GROUP BY 1", ("segments",))
def _(t):
    lists = t.segments.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("start_seconds", "text"))).alias("segments"))
    raw = lists.select(F.lit("chat").alias("source_type"), F.col("document_id").cast("string").alias("external_id"), "segments")
    known = t.segments.where("document_id % 3 = 0").select(F.lit("chat").alias("source_type"), F.col("document_id").cast("string").alias("external_id")).distinct()
    return IO.ingest_documents(known, raw)[1].groupBy("external_id").agg(F.count(F.lit(1)).alias("n_segments"))


@query("t28_measures", " UNION ALL ".join(f"SELECT '{panel}.{c}' AS path, '{u}' AS unit, count({c}) AS n, round({'NULL' if u == 'categorical' else f'sum({c})/count({c})'},4)+0.0e0 AS mean FROM panel HAVING count({c})>0" for panel, fields in R.CATALOGUE.items() for c, u in fields.items() if c in ("close", "rsi_14", "atr_14", "atr_14_pct", "ma_alignment", "return_5", "return_21", "return_63", "return_252", "pct_off_high_52w", "pct_off_low_52w", "dollar_volume", "sma_50_slope_21", "sma_200_slope_63", "dist_sma_50", "dist_sma_200", "realized_vol_21", "recent_high_63", "base_low_60", "pullback_63", "breakout_63")), ("bars",), PANEL, 4)
def _(t):
    # every field that the indicator panel has, over all bars
    return R.measures(I.panel(t.bars)).groupBy("path", "unit").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query("io3_universe", "SELECT 'P' || p_partkey || '-B' AS ticker, p_name AS name, p_brand AS sector, 'file' AS source FROM part WHERE p_partkey%9>1 AND p_brand='Brand#13'")
def _(t):
    key = F.col("p_partkey")
    ticker = F.when(key % 9 == 0, "  ").when(key % 9 > 1, F.concat(F.lit(" p"), key.cast("string"), F.lit(".b ")))
    return IO.universe_rows(t.part.select(ticker.alias("ticker"), F.col("p_name").alias("name"), F.col("p_brand").alias("sector"), F.lit("file").alias("source")), "BRAND#13")


@query("io5_gold", """SELECT CAST(call_id AS varchar) AS id, 'about ' || ticker AS source_text, CASE WHEN status='accepted' THEN true END AS is_call, CASE WHEN status='accepted' THEN ticker END AS ticker, CASE WHEN status='accepted' THEN direction END AS direction,
 CASE WHEN status='accepted' THEN round(entry_price,6) END AS entry_price, CASE WHEN status='accepted' THEN round(stop_price,6) END AS stop_price, CASE WHEN call_id%2=0 THEN 'n' END AS notes FROM calls""", ("calls",))
def _(t):
    # one line a call, and blank lines and remarks between them
    expected = F.when(F.col("status") == "accepted", F.struct(F.lit(True).alias("is_trade_call"), "ticker", "direction", "entry_price", "stop_price"))
    line = F.to_json(F.struct(F.col("call_id").cast("string").alias("id"), F.concat(F.lit("about "), "ticker").alias("source_text"), expected.alias("expected"), F.when(F.col("call_id") % 2 == 0, "n").alias("notes")))
    gold = IO.gold_of_lines(t.calls.select(F.explode(F.array(line, F.lit("  "), F.lit(" // {a remark}"))).alias("value")))
    e = F.col("expected")
    return gold.select("id", "source_text", e["is_trade_call"].alias("is_call"), e["ticker"].alias("ticker"), e["direction"].alias("direction"), e["entry_price"].alias("entry_price"), e["stop_price"].alias("stop_price"), "notes")


_HEAD = """hz AS (SELECT st.*, n.support, n.resistance, CASE WHEN available THEN CASE kind WHEN 'breakout_candidate' THEN 'breakout' WHEN 'range_bound' THEN 'range' ELSE 'pullback' END END AS zk FROM st JOIN (SELECT ticker, ts, support, resistance FROM near) n USING (ticker, ts)),
hz1 AS (SELECT *, CASE zk WHEN 'breakout' THEN recent_high_63 WHEN 'pullback' THEN least(ema_21,sma_50) WHEN 'range' THEN base_low_60 END AS zlow, CASE zk WHEN 'breakout' THEN recent_high_63 WHEN 'pullback' THEN coalesce(ema_21,sma_50) WHEN 'range' THEN base_low_60 END AS trig,
 CASE zk WHEN 'breakout' THEN greatest(base_low_60, recent_high_63-1.5e0*atr_14) WHEN 'pullback' THEN greatest(CASE WHEN support<least(ema_21,sma_50) THEN support END, sma_50-atr_14, least(ema_21,sma_50)-1.5e0*atr_14) WHEN 'range' THEN base_low_60-0.5e0*atr_14 END AS inv,
 CASE zk WHEN 'range' THEN base_high_60 ELSE resistance END AS aim FROM hz)"""
#: The columns of a snapshot in the SQL's terms; the rest bear their own names.
_HEAD_SQL = {
    "as_of": "ts", "setup_type": "kind", "setup_confidence": "sure", "last_close": "close", "pct_off_52w_high": "pct_off_high_52w", "return_5d": "return_5", "return_21d": "return_21", "return_63d": "return_63", "sma_50_slope_21d_pct": "sma_50_slope_21",
    "relative_strength_vs_spy_63d": "rs_63", "nearest_support": "support", "nearest_resistance": "resistance", "pullback_pct_from_recent_high": "pullback_63", "breakout_distance_pct": "breakout_63", "entry_zone_available": "available", "entry_trigger": "trig",
    "entry_zone_low": "zlow", "entry_zone_high": "CASE WHEN zk='pullback' AND ema_21<>sma_50 THEN greatest(ema_21,sma_50) ELSE zlow+0.5e0*atr_14 END", "invalidation_reference": "inv", "risk_reward_estimate": "CASE WHEN zlow>inv AND (zk='range' OR aim>zlow) THEN (aim-zlow)/(zlow-inv) END",
} | {c: "NULL" for c in IO.HEADLINE if c.startswith("transcript_")}


def _head(name: str) -> str:
    value = _HEAD_SQL.get(name, name)
    kind = {"string": "varchar", "long": "bigint"}.get(IO.TYPES[name], IO.TYPES[name])
    return f"round({value},6)+0.0e0 AS {name}" if kind == "double" and value != "NULL" else f"CAST({value} AS {kind}) AS {name}"


@query("io11_snapshot", f"SELECT {', '.join(map(_head, IO.HEADLINE))} FROM hz1", ("bars",), f"{SETUP}, {status_sql()}, {SWINGS}, {NEAR}, {_HEAD}")
def _(t):
    return IO.headline(judged(t))


@query("st1_unique_documents", "SELECT 'talk' AS source_type, CAST(document_id AS varchar) AS external_id, title, posted_at FROM claim_documents", ("claim_documents",))
def _(t):
    first = t.claim_documents.select(F.lit("talk").alias("source_type"), F.col("document_id").cast("string").alias("external_id"), "title", "posted_at")
    again = first.withColumns({"title": F.lit("again"), "posted_at": F.col("posted_at") + F.expr("interval 1 hour")})
    return streams.unique_documents(again.unionByName(first))


@query("st4_pauses", """SELECT document_id, make_timestamp(CAST(min(start_seconds)*1000000 AS bigint)) AS start_at, make_timestamp(CAST(max(start_seconds)*1000000 AS bigint)) + INTERVAL 5 SECOND AS end_at, count(*) AS n_segments
 FROM (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY start_seconds) AS stretch FROM (SELECT *, CASE WHEN coalesce(start_seconds-lag(start_seconds) OVER (PARTITION BY document_id ORDER BY start_seconds)>5,true) THEN 1 ELSE 0 END AS fresh FROM segments) a) b GROUP BY document_id, stretch""", ("segments",))
def _(t):
    return streams.pauses(t.segments.withColumn("spoken_at", F.timestamp_seconds("start_seconds")), "5 seconds")
