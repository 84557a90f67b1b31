"""Calls, outcomes, scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from callbook.plans import outcomes as O
from callbook.plans import scoring as S
from callbook.queries.base import Tables, query, r6
from callbook.testdata import BENCHMARK

AS_OF = "2002-01-01 00:00:00"

ACTIVATIONS = """
accepted AS (SELECT * FROM calls WHERE status='accepted'),
near AS (
  SELECT c.call_id, c.direction, c.entry_type, c.entry_price, b.ts, b.open, b.high, b.low, row_number() OVER (PARTITION BY c.call_id ORDER BY b.ts) AS k
  FROM accepted c JOIN bars b ON b.ticker=c.ticker AND b.ts>c.posted_at AND b.ts<=c.posted_at+INTERVAL 60 DAY
), fills AS (
  SELECT *, CASE
    WHEN entry_type IN ('market','unspecified') THEN open
    WHEN entry_type='limit' AND direction='long' AND low<=entry_price THEN least(open,entry_price)
    WHEN entry_type='limit' AND direction='short' AND high>=entry_price THEN greatest(open,entry_price)
    WHEN entry_type='trigger_above' AND high>=entry_price THEN greatest(open,entry_price)
    WHEN entry_type='trigger_below' AND low<=entry_price THEN least(open,entry_price) END AS fill
  FROM near WHERE k<=10
), acts AS (
  SELECT call_id, count(*) AS sessions_seen, min(ts) FILTER (WHERE fill IS NOT NULL) AS activation_at, arg_min(fill, ts) FILTER (WHERE fill IS NOT NULL) AS entry_fill_price
  FROM fills GROUP BY call_id
)"""

OUTCOMES = (
    ACTIVATIONS
    + """,
loaded AS (SELECT DISTINCT c.call_id FROM accepted c JOIN bars b ON b.ticker=c.ticker AND b.ts>=c.posted_at-INTERVAL 5 DAY AND b.ts<=c.posted_at+INTERVAL 60 DAY),
state AS (
  SELECT c.*, l.call_id IS NOT NULL AS has_bars, coalesce(a.sessions_seen,0) AS sessions_seen, a.activation_at, a.entry_fill_price, h.horizon, h.n
  FROM accepted c LEFT JOIN loaded l USING (call_id) LEFT JOIN acts a USING (call_id)
  CROSS JOIN (VALUES ('1d',1),('3d',3),('5d',5),('21d',21)) h(horizon,n)
), ses AS (SELECT *, row_number() OVER (ORDER BY session_date) AS session_no FROM sessions),
aimed AS (
  SELECT s.*, e.market_close AS horizon_end
  FROM state s JOIN ses a ON a.session_date=s.activation_at JOIN ses e ON e.session_no=a.session_no+s.n-1
  WHERE s.activation_at IS NOT NULL
), walked AS (
  SELECT m.call_id, m.horizon, any_value(m.direction) AS direction, any_value(m.entry_fill_price) AS fill, any_value(m.target_price) AS target_price, any_value(m.stop_price) AS stop_price,
    any_value(m.activation_at) AS activation_at, any_value(m.horizon_end) AS horizon_end, bool_or(b.ts>=m.horizon_end) AS covered,
    max(b.ts) FILTER (WHERE b.ts<=m.horizon_end) AS exit_at, arg_max(b.close,b.ts) FILTER (WHERE b.ts<=m.horizon_end) AS exit_price,
    max(b.high) FILTER (WHERE b.ts<=m.horizon_end) AS top, min(b.low) FILTER (WHERE b.ts<=m.horizon_end) AS bottom
  FROM aimed m JOIN bars b ON b.ticker=m.ticker AND b.ts>=m.activation_at AND b.ts<=m.posted_at+INTERVAL 60 DAY
  GROUP BY m.call_id, m.horizon
), bench AS (
  SELECT w.call_id, w.horizon, arg_min(b.close,b.ts) AS c0, arg_max(b.close,b.ts) AS c1
  FROM walked w JOIN bars b ON b.ticker='T00' AND b.ts>=w.activation_at AND b.ts<=w.horizon_end WHERE w.covered GROUP BY 1,2
), outcomes AS (
  SELECT w.call_id, w.horizon, true AS activated, w.activation_at, w.fill AS entry_fill_price, w.exit_at, w.exit_price,
    s*(w.exit_price-w.fill)/w.fill AS gross_return_pct, s*(w.exit_price-w.fill)/w.fill-0.001e0 AS return_pct,
    s*(CASE WHEN s>0 THEN top ELSE bottom END-fill)/fill AS mfe, s*(CASE WHEN s>0 THEN bottom ELSE top END-fill)/fill AS mae,
    CASE WHEN s>0 THEN top>=target_price ELSE bottom<=target_price END AS hit_target,
    CASE WHEN s>0 THEN bottom<=stop_price ELSE top>=stop_price END AS hit_stop,
    (c1-c0)/c0 AS benchmark_return_pct, s*(w.exit_price-w.fill)/w.fill-0.001e0-(c1-c0)/c0 AS excess_return_pct, 'evaluated' AS status
  FROM (SELECT *, CASE WHEN direction='long' THEN 1.0e0 ELSE -1.0e0 END AS s FROM walked WHERE covered) w LEFT JOIN bench USING (call_id, horizon)
  UNION ALL
  SELECT call_id, horizon, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN has_bars THEN 'not_triggered' ELSE 'data_missing' END
  FROM state WHERE NOT has_bars OR (activation_at IS NULL AND sessions_seen>=10)
)"""
)

SCORECARDS = (
    OUTCOMES
    + f""",
scored AS (
  SELECT o.*, c.creator_id, c.ticker, w.window_label FROM outcomes o JOIN calls c USING (call_id)
  JOIN (VALUES ('all', TIMESTAMP '1900-01-01'), ('365d', TIMESTAMP '{AS_OF}'-INTERVAL 365 DAY), ('90d', TIMESTAMP '{AS_OF}'-INTERVAL 90 DAY)) w(window_label, since) ON c.posted_at>=w.since
  WHERE o.status IN ('evaluated','not_triggered')
), cards0 AS (
  SELECT creator_id, window_label, horizon, count(DISTINCT call_id) AS n_calls, count(DISTINCT call_id) FILTER (WHERE activated) AS n_activated, count(DISTINCT ticker) AS n_unique_tickers,
    count(return_pct) AS n, count(*) FILTER (WHERE return_pct>0) AS hits, sum(return_pct) AS total, avg(return_pct) AS mean_return, median(return_pct) AS median_return, stddev_samp(return_pct) AS std_return,
    avg(mae) AS mean_mae, min(mae) AS worst_mae, avg(excess_return_pct) AS mean_excess_return, median(excess_return_pct) AS median_excess_return,
    count(*) FILTER (WHERE excess_return_pct>0)*1.0e0/nullif(count(excess_return_pct),0) AS excess_hit_rate
  FROM scored GROUP BY 1,2,3 HAVING count(DISTINCT call_id)>=5
), cards AS (
  SELECT *, hits*1.0e0/nullif(n,0) AS hit_rate, n_activated*1.0e0/n_calls AS activation_rate, CASE WHEN std_return>0 THEN mean_return/std_return END AS sharpe_like,
    coalesce(total,0)/nullif(n+n_calls-n_activated,0) AS expectancy_unconditional,
    CASE WHEN n>0 THEN greatest(0.0e0, (hits*1.0e0/n+z*z/(2*n)-z*sqrt((hits*1.0e0/n)*(1-hits*1.0e0/n)/n+z*z/(4.0e0*n*n)))/(1+z*z/n)) ELSE 0.0e0 END AS hit_rate_lower_ci,
    CASE WHEN n>0 THEN least(1.0e0, (hits*1.0e0/n+z*z/(2*n)+z*sqrt((hits*1.0e0/n)*(1-hits*1.0e0/n)/n+z*z/(4.0e0*n*n)))/(1+z*z/n)) ELSE 1.0e0 END AS hit_rate_upper_ci
  FROM cards0, (SELECT 1.959964e0 AS z)
)"""
)
CARD_VALUES = ("mean_return", "median_return", "std_return", "mean_mae", "worst_mae", "mean_excess_return", "median_excess_return", "excess_hit_rate", "hit_rate", "activation_rate", "sharpe_like", "expectancy_unconditional", "hit_rate_lower_ci", "hit_rate_upper_ci")
BASE = ("bars", "sessions", "calls")


def outcomes(t: Tables):
    return O.evaluate(t.calls.where("status = 'accepted'"), t.bars, t.sessions, BENCHMARK)


def scorecards(t: Tables):
    return S.creator_scorecards(outcomes(t), t.calls, AS_OF)


@query("c1_activation", f"SELECT c.call_id, a.activation_at, {r6('entry_fill_price')}, coalesce(a.sessions_seen,0) AS sessions_seen FROM accepted c LEFT JOIN acts a USING (call_id)", BASE, ACTIVATIONS)
def _(t):
    return O.activations(t.calls.where("status = 'accepted'"), t.bars).select("call_id", "activation_at", "entry_fill_price", "sessions_seen")


@query("c3_outcomes", f"SELECT call_id, horizon, activated, activation_at, exit_at, CAST(hit_target AS varchar) AS hit_target, CAST(hit_stop AS varchar) AS hit_stop, status, {r6('entry_fill_price','exit_price','gross_return_pct','return_pct','mfe','mae','benchmark_return_pct','excess_return_pct')} FROM outcomes", BASE, OUTCOMES)
def _(t):
    return outcomes(t).withColumns({c: F.col(c).cast("string") for c in ("hit_target", "hit_stop")})


@query("c2_outcome_summary", f"SELECT horizon, status, count(*) AS n, {r6('mean_gross','mean_mfe','mean_mae')}, n_target, n_stop FROM (SELECT horizon, status, avg(gross_return_pct) AS mean_gross, avg(mfe) AS mean_mfe, avg(mae) AS mean_mae, count(*) FILTER (WHERE hit_target) AS n_target, count(*) FILTER (WHERE hit_stop) AS n_stop, count(*) AS c FROM outcomes GROUP BY 1,2) x GROUP BY ALL".replace("count(*) AS n, ", "c AS n, "), BASE, OUTCOMES)
def _(t):
    return outcomes(t).groupBy("horizon", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("gross_return_pct").alias("mean_gross"), F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"), F.count_if("hit_target").alias("n_target"), F.count_if("hit_stop").alias("n_stop"))


@query("c19_leakage_audit", "SELECT count(*) FILTER (WHERE o.activation_at<=c.posted_at) AS activation_before_post, count(*) FILTER (WHERE NOT coalesce(o.entry_fill_price BETWEEN b.low-1e-9 AND b.high+1e-9, false)) AS fill_outside_bar, count(*) FILTER (WHERE o.exit_at<o.activation_at) AS exit_before_activation, count(*) AS n_checked FROM outcomes o JOIN calls c USING (call_id) LEFT JOIN bars b ON b.ticker=c.ticker AND b.ts=o.activation_at WHERE o.status='evaluated'", BASE, OUTCOMES)
def _(t):
    return O.leakage_audit(t.calls, outcomes(t), t.bars)


@query("j12_pending_calls", "SELECT call_id FROM calls c WHERE status='accepted' AND call_id NOT IN (SELECT call_id FROM outcomes WHERE horizon='21d' AND status='evaluated')", BASE, OUTCOMES)
def _(t):
    return O.pending_calls(t.calls, outcomes(t).where("horizon = '21d' and status = 'evaluated'")).select("call_id")


@query("a4_creator_scorecards", f"SELECT creator_id, window_label, horizon, n_calls, n_activated, n_unique_tickers, {r6(*CARD_VALUES)} FROM cards", BASE, SCORECARDS)
def _(t):
    return scorecards(t)


@query("k1_leaderboard", f"SELECT creator_id, window_label, horizon, n_calls, n_activated, n_unique_tickers, {r6(*CARD_VALUES)} FROM cards WHERE horizon='5d' AND window_label='all' ORDER BY mean_excess_return DESC NULLS LAST, creator_id", BASE, SCORECARDS)
def _(t):
    return S.leaderboard(scorecards(t))


@query("a16_creator_report", f"SELECT creator_id, horizon, n_calls, {r6('sum_return','mean_return','median_return','hit_rate')} FROM (SELECT creator_id, horizon, count(DISTINCT call_id) AS n_calls, sum(return_pct) AS sum_return, avg(return_pct) AS mean_return, median(return_pct) AS median_return, avg(CASE WHEN return_pct>0 THEN 1.0e0 WHEN return_pct IS NOT NULL THEN 0.0e0 END) AS hit_rate FROM outcomes JOIN calls USING (call_id) WHERE outcomes.status='evaluated' GROUP BY 1,2) x", BASE, OUTCOMES)
def _(t):
    return S.creator_report(outcomes(t), t.calls)


@query("a17_recency_pivot", """SELECT creator_id, CAST(max(n_activated) FILTER (WHERE window_label='all') AS double) AS all_n_activated, round(max(mean_excess_return) FILTER (WHERE window_label='all'),6) AS all_mean_excess,
 CAST(max(n_activated) FILTER (WHERE window_label='365d') AS double) AS "365d_n_activated", round(max(mean_excess_return) FILTER (WHERE window_label='365d'),6) AS "365d_mean_excess",
 CAST(max(n_activated) FILTER (WHERE window_label='90d') AS double) AS "90d_n_activated", round(max(mean_excess_return) FILTER (WHERE window_label='90d'),6) AS "90d_mean_excess" FROM cards WHERE horizon='5d' GROUP BY 1""", BASE, SCORECARDS)
def _(t):
    wide = S.recency_pivot(scorecards(t))
    return wide.withColumns({c: F.col(c).cast("double") for c in wide.columns if c.endswith("n_activated")})


LENS = """wil AS (SELECT *, hits*1.0e0/n AS hit_rate,
  greatest(0.0e0,(hits*1.0e0/n+z*z/(2*n)-z*sqrt((hits*1.0e0/n)*(1-hits*1.0e0/n)/n+z*z/(4.0e0*n*n)))/(1+z*z/n)) AS lower_ci,
  least(1.0e0,(hits*1.0e0/n+z*z/(2*n)+z*sqrt((hits*1.0e0/n)*(1-hits*1.0e0/n)/n+z*z/(4.0e0*n*n)))/(1+z*z/n)) AS upper_ci FROM ({}), (SELECT 1.959964e0 AS z))"""


@query("a7_lens_scorecards", f"SELECT lens_name, n, n_ticker_days, hits, n_directional, {r6('avg_excess','directional_excess','hit_rate','lower_ci','upper_ci')} FROM wil", ("lens_results",), LENS.format("""
 SELECT lens_name, count(*) AS n, count(DISTINCT (ticker, CAST(as_of AS date))) AS n_ticker_days, count(*) FILTER (WHERE direction_correct) AS hits, round(avg(excess_vs_spy_pct),4) AS avg_excess,
 round(avg(s*excess_vs_spy_pct),4) AS directional_excess, count(s*excess_vs_spy_pct) AS n_directional FROM (SELECT *, CASE direction WHEN 'bullish' THEN 1.0e0 WHEN 'bearish' THEN -1.0e0 END AS s FROM lens_results WHERE horizon='5d' AND as_of>=TIMESTAMP '2001-01-10') GROUP BY 1"""))
def _(t):
    return S.lens_scorecards(t.lens_results, "5d", "2001-01-10 00:00:00")


@query("a8_lens_breakdowns", f"SELECT lens_name, kind, value, n, hits, {r6('hit_rate','lower_ci','upper_ci')} FROM wil", ("lens_results",), LENS.format("""
 SELECT lens_name, kind, value, count(*) AS n, count(*) FILTER (WHERE direction_correct) AS hits FROM (SELECT lens_name, direction_correct, unnest(['regime','conviction','direction']) AS kind, unnest([regime, conviction, direction]) AS value FROM lens_results WHERE horizon='5d') GROUP BY 1,2,3"""))
def _(t):
    return S.lens_breakdowns(t.lens_results)
