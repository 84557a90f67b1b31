"""Entry zones, reward to risk, raw-extraction checks, visible slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from callbook.functions import zones as Z
from callbook.operators import bars as B
from callbook.operators import calendar as C
from callbook.plans import research as R
from callbook.queries.base import query, r6
from callbook.queries.technical import SETUP
from callbook.testdata import BENCHMARK

LEVELS = """ext AS (SELECT ticker, ts, high, low, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS bar_no, count(*) OVER (PARTITION BY ticker) AS n_bars,
 max(high) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS hb, max(high) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ha,
 min(low) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lb, min(low) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS la FROM bars),
piv AS (SELECT ticker, bar_no, high AS price FROM ext WHERE bar_no>5 AND bar_no<=n_bars-5 AND high>hb AND high>ha UNION ALL SELECT ticker, bar_no, low FROM ext WHERE bar_no>5 AND bar_no<=n_bars-5 AND low<lb AND low<la),
rec AS (SELECT ticker, bar_no, close AS ema_21 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS bar_no FROM bars) WHERE bar_no=1 UNION ALL SELECT n.ticker, n.bar_no, n.close*2/22.0e0+r.ema_21*20/22.0e0 FROM rec r JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS bar_no FROM bars) n ON n.ticker=r.ticker AND n.bar_no=r.bar_no+1),
at0 AS (SELECT p.*, split_part(s.setup,' ',1) AS setup_type, CASE WHEN p.bar_no>=21 THEN r.ema_21 END AS ema_21, (SELECT max(price) FROM piv v WHERE v.ticker=p.ticker AND v.bar_no+5<=p.bar_no AND v.bar_no>p.bar_no-252 AND price<p.close) AS support,
 (SELECT min(price) FROM piv v WHERE v.ticker=p.ticker AND v.bar_no+5<=p.bar_no AND v.bar_no>p.bar_no-252 AND price>p.close) AS resistance
 FROM panel p JOIN setups s USING (ticker, ts) JOIN rec r ON r.ticker=p.ticker AND r.bar_no=p.bar_no WHERE s.setup<>'insufficient_data low'),
z0 AS (SELECT *, CASE WHEN setup_type='breakout_candidate' THEN 'breakout' WHEN setup_type='uptrend_pullback' OR (setup_type='strong_uptrend' AND pullback_63>=0.04e0) THEN 'pullback' WHEN setup_type='range_bound' THEN 'range' END AS kind FROM at0),
z1 AS (SELECT *, CASE kind WHEN 'breakout' THEN recent_high_63 WHEN 'pullback' THEN least(ema_21, sma_50) WHEN 'range' THEN base_low_60 END AS zlow,
 CASE kind WHEN 'breakout' THEN greatest(base_low_60, recent_high_63-1.5e0*atr_14) WHEN 'pullback' THEN greatest(CASE WHEN support<least(ema_21,sma_50) THEN support END, sma_50-atr_14, least(ema_21,sma_50)-1.5e0*atr_14) WHEN 'range' THEN base_low_60-0.5e0*atr_14 END AS inv,
 CASE kind WHEN 'range' THEN base_high_60 ELSE resistance END AS target FROM z0)"""


def _rows(t):
    return R.research_view(t.bars, BENCHMARK).where("setup_type <> 'insufficient_data'")


@query("t18_entry_zone", f"SELECT ticker, ts, setup_type, kind IS NOT NULL AS available, {r6('zlow','inv','risk_pct','risk_atrs','reward_risk')} FROM (SELECT *, (zlow-inv)/zlow AS risk_pct, (zlow-inv)/atr_14 AS risk_atrs, CASE WHEN zlow>inv AND (kind='range' OR target>zlow) THEN (target-zlow)/(zlow-inv) END AS reward_risk FROM z1) q", ("bars",), f"{SETUP}, {LEVELS}")
def _(t):
    out = _rows(t)
    return out.select("ticker", "ts", "setup_type", "available", F.col("zone.low").alias("zlow"), F.col("zone.invalidation").alias("inv"), "risk_pct", "risk_atrs", "reward_risk")


@query("t20_rr_distribution", """SELECT ticker, count(*) AS n, round(min(b),6) AS low, round_even(median(b),2) AS middle, round(max(b),6) AS high FROM (
 SELECT ticker, CASE WHEN rr IS NULL THEN rp ELSE round_even(rp/3+rr*2/3,2) END AS b FROM (
  SELECT ticker, round_even(greatest(0.0e0,c+10*dp-(c+1))/(c-(c-4*di)),2) AS rp, CASE WHEN dr IS NOT NULL THEN round_even(greatest(0.0e0,c+10*dr-(c+1))/(c-(c-4*di)),2) END AS rr FROM q, (SELECT unnest([0.0e0,1.0e0,2.0e0]) AS dp) a, (SELECT unnest([-1.0e0,3.0e0,5.0e0,NULL]) AS dr) b2, (SELECT unnest([-1.0e0,1.0e0,2.5e0]) AS di) d WHERE di>0) z WHERE rp>0) y GROUP BY 1""", ("bars",), "q AS (SELECT ticker, max(close) AS c FROM bars GROUP BY 1)")
def _(t):
    top = t.bars.groupBy("ticker").agg(F.max("close").alias("c"))
    band = lambda x: F.struct(x.alias("low"), (x + 1).alias("high"))
    c = F.col("c")
    plans = top.select("ticker", F.array(band(c)).alias("entries"), F.array(band(c), band(c + 10), band(c + 20)).alias("primaries"), F.array(band(c - 10), band(c + 30), band(c + 50)).alias("runners"), F.array(c + 4, c - 4, c - 10).alias("invalidations"))
    return Z.rr_distribution(plans)


@query("t25_days_to_earnings", "SELECT ticker, CAST(CASE WHEN days_to_earnings>=-3 THEN greatest(days_to_earnings,0) ELSE days_to_earnings+100 END AS double) AS days FROM metrics WHERE days_to_earnings IS NOT NULL", ("metrics",))
def _(t):
    today = F.lit("2001-01-01").cast("date")
    rows = t.metrics.where("days_to_earnings is not null")
    dates = F.array(F.date_add(today, F.col("days_to_earnings")), F.date_add(today, F.col("days_to_earnings") + 100))
    return rows.select("ticker", Z.days_to_earnings(dates, today).cast("double").alias("days"))


@query("t34_call_defects", "SELECT call_id, CASE WHEN (target_price IS NULL)<>(call_id%2=0) THEN 'target_evidence' ELSE '' END || CASE WHEN entry_type IN ('limit','trigger_above','trigger_below') AND entry_price IS NULL THEN '+entry_price' ELSE '' END AS defects FROM calls", ("calls",))
def _(t):
    rows = t.calls.withColumns({"entry_evidence": F.when(F.col("entry_price").isNotNull(), "q"), "stop_evidence": F.when(F.col("stop_price").isNotNull(), "q"), "target_evidence": F.when(F.col("call_id") % 2 != 0, "q")})
    d = Z.call_defects()
    return rows.select("call_id", F.concat(F.when(F.array_contains(d, "target_evidence"), "target_evidence").otherwise(""), F.when(F.array_contains(d, "entry_price"), "+entry_price").otherwise("")).alias("defects"))


SLICE = "ao AS (SELECT as_of, coalesce(k0, date_trunc('day', as_of)) AS k FROM (SELECT market_close-INTERVAL 2 HOUR AS as_of, (SELECT max(session_date) FROM sessions s2 WHERE s2.market_close<=s.market_close-INTERVAL 2 HOUR) AS k0 FROM (SELECT *, row_number() OVER (PARTITION BY isoyear(session_date), week(session_date) ORDER BY session_date) AS w FROM sessions) s WHERE w=1) q)"


@query("f2_knowable_slice", "SELECT as_of, ticker, count(*) AS n_bars, max(ts) AS last_ts FROM ao JOIN bars b ON b.ts<=ao.k AND b.ts>=ao.as_of-INTERVAL 30 DAY GROUP BY 1,2", ("bars", "sessions"), SLICE)
def _(t):
    return B.knowable_slice(_as_ofs(t), t.bars, 30).groupBy("as_of", "ticker").agg(F.count(F.lit(1)).alias("n_bars"), F.max("ts").alias("last_ts"))


@query("f3_forward_slice", "SELECT as_of, ticker, count(*) AS n_bars, min(ts) AS first_ts FROM ao JOIN bars b ON b.ts>ao.k AND b.ts<=ao.as_of+INTERVAL 20 DAY GROUP BY 1,2", ("bars", "sessions"), SLICE)
def _(t):
    return B.forward_slice(_as_ofs(t), t.bars, 20).groupBy("as_of", "ticker").agg(F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("first_ts"))


@query("f1_as_of_slice", "SELECT ticker, count(*) AS n FROM bars WHERE ts<=TIMESTAMP '2000-06-30' GROUP BY 1", ("bars",))
def _(t):
    return B.as_of_slice(t.bars, "2000-06-30").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


def _as_ofs(t):
    # every week of the calendar, two hours before the close: that session's own bar is not knowable yet
    days = C.rebalance_dates(t.sessions, "1900-01-01", "2100-01-01").select((F.col("as_of") - F.expr("interval 2 hours")).alias("as_of"))
    return C.knowable_through(days, t.sessions)


@query("f8_snapshot_history", "SELECT snapshot_id, as_of, lens_name FROM lens_results WHERE ticker='T03' AND as_of>=TIMESTAMP '2001-01-20'-INTERVAL 10 DAY AND as_of<=TIMESTAMP '2001-01-20' ORDER BY as_of, snapshot_id LIMIT 40", ("lens_results",))
def _(t):
    return R.snapshot_history(t.lens_results, "T03", "2001-01-20 00:00:00", 10, 40).select("snapshot_id", "as_of", "lens_name")
