"""Strategies, simulation, walk-forward."""

from __future__ import annotations

from pyspark.sql import functions as F

from callbook.operators import bars as B
from callbook.operators import calendar as C
from callbook.plans import strategies as X
from callbook.queries.base import Tables, query, r6
from callbook.queries.technical import REGIME
from callbook.testdata import BENCHMARK

START, END = "2000-01-03", "2001-06-30"
FRAMES = f"""rebal AS (SELECT min(market_close) AS as_of, min(session_date) AS k FROM sessions WHERE session_date BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY isoyear(session_date), week(session_date)),
trad AS (SELECT DISTINCT a.as_of, b.ticker FROM rebal a JOIN bars b ON b.ts<=a.k AND b.ts>=date_trunc('day', a.as_of-INTERVAL 14 DAY) WHERE coalesce(b.volume,0)>=1000),
mm0 AS (SELECT a.as_of, c.ticker, count(DISTINCT creator_id) AS n, avg(CASE polarity WHEN 'bullish' THEN 1.0e0 WHEN 'bearish' THEN -1.0e0 ELSE 0.0e0 END)*count(DISTINCT creator_id) AS score FROM rebal a JOIN claims c ON c.posted_at<=a.as_of AND c.posted_at>=a.as_of-INTERVAL 7 DAY JOIN trad t ON t.as_of=a.as_of AND t.ticker=c.ticker WHERE c.status='accepted' GROUP BY 1,2),
mm AS (SELECT as_of, ticker, score, 'long' AS direction FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, ticker) AS k, count(*) OVER (PARTITION BY as_of) AS m FROM mm0 WHERE score>0) x WHERE k<=greatest(1, floor(m*0.1e0+0.999e0))),
bc AS (SELECT a.as_of, c.ticker, count(DISTINCT creator_id)*1.0e0 AS score, 'long' AS direction FROM rebal a JOIN claims c ON c.posted_at<=a.as_of AND c.posted_at>=a.as_of-INTERVAL 14 DAY JOIN trad t ON t.as_of=a.as_of AND t.ticker=c.ticker WHERE c.status='accepted' AND claim_type='catalyst' AND claim_class IN ('factual','opinion') AND polarity='bullish' GROUP BY 1,2 HAVING count(DISTINCT creator_id)>=2),
tr0 AS (SELECT as_of, creator_id FROM (SELECT a.as_of, s.creator_id, s.hit_rate_lower_ci AS ci, row_number() OVER (PARTITION BY a.as_of, s.creator_id ORDER BY s.computed_at DESC, s.scorecard_id DESC) AS k FROM rebal a JOIN scorecards s ON s.computed_at<=a.as_of) x WHERE k=1 AND ci>0.55e0),
trusted AS (SELECT * FROM tr0 WHERE as_of IN (SELECT as_of FROM tr0 GROUP BY 1 HAVING count(DISTINCT creator_id)>=2)),
cc0 AS (SELECT a.as_of, c.ticker, c.direction, count(DISTINCT c.creator_id)*1.0e0 AS score FROM rebal a JOIN calls c ON c.posted_at<=a.as_of AND c.posted_at>=a.as_of-INTERVAL 7 DAY JOIN trad t ON t.as_of=a.as_of AND t.ticker=c.ticker JOIN trusted u ON u.as_of=a.as_of AND u.creator_id=c.creator_id WHERE c.status='accepted' AND c.direction IN ('long','short') GROUP BY 1,2,3 HAVING count(DISTINCT c.creator_id)>=2),
cc AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY as_of, ticker) AS sides FROM cc0) x WHERE sides=1),
decisions AS (SELECT 'mention_momentum' AS strategy, as_of, ticker, score, direction FROM mm UNION ALL SELECT 'bullish_catalyst', as_of, ticker, score, direction FROM bc UNION ALL SELECT 'creator_consensus', as_of, ticker, score, direction FROM cc),
weighted AS (SELECT *, 1.0e0/count(*) OVER (PARTITION BY strategy, as_of) AS weight FROM decisions),
nb AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS bar_no FROM bars), {REGIME},
trades AS (
 SELECT w.*, 5 AS hold_days, i.ts AS entry_at, o.ts AS exit_at, i.open AS entry_price, o.close AS exit_price, CASE w.direction WHEN 'short' THEN -1.0e0 ELSE 1.0e0 END*(o.close/i.open-1) AS gross,
  (SELECT coalesce(arg_max(r.regime, r.ts),'unknown') FROM reg r WHERE r.ts<=a.k) AS regime_at_entry,
  (SELECT arg_max(s.close,s.ts)/arg_min(s.close,s.ts)-1 FROM bars s WHERE s.ticker='T00' AND s.ts BETWEEN i.ts AND o.ts) AS benchmark_return_pct
 FROM weighted w JOIN rebal a USING (as_of) JOIN (SELECT a.as_of, b.ticker, max(b.bar_no) AS b0 FROM rebal a JOIN nb b ON b.ts<=a.k GROUP BY 1,2) p ON p.as_of=w.as_of AND p.ticker=w.ticker
 JOIN nb i ON i.ticker=w.ticker AND i.bar_no=p.b0+1 JOIN nb o ON o.ticker=w.ticker AND o.bar_no=p.b0+6 WHERE o.ts<=w.as_of+INTERVAL 34 DAY),
curve AS (SELECT *, gross-0.001e0 AS return_pct, row_number() OVER v AS step, product(1+weight*(gross-0.001e0)) OVER (PARTITION BY strategy ORDER BY exit_at, ticker, as_of ROWS UNBOUNDED PRECEDING) AS nav FROM trades WINDOW v AS (PARTITION BY strategy ORDER BY exit_at, ticker, as_of)),
dd AS (SELECT *, nav/greatest(1.0e0, max(nav) OVER (PARTITION BY strategy ORDER BY step ROWS UNBOUNDED PRECEDING))-1 AS drawdown, nav/coalesce(lag(nav) OVER (PARTITION BY strategy ORDER BY step),1.0e0)-1 AS r FROM curve)"""
T5 = ("bars", "sessions", "calls", "claims", "scorecards")
ALL = ["mention_momentum", "bullish_catalyst", "creator_consensus"]


def frames(t: Tables):
    as_ofs = C.knowable_through(C.rebalance_dates(t.sessions, START, END).select("as_of"), t.sessions)
    return X.StrategyFrames(as_ofs, B.tradeable(as_ofs, t.bars), t.claims, t.calls, t.scorecards)


def trades(t: Tables, cost=(10,)):
    return X.walkforward(ALL, t.bars, t.sessions, t.claims, t.calls, t.scorecards, BENCHMARK, START, END, cost)


def _decisions(number: str, name: str):
    @query(f"{number}_{name}", f"SELECT as_of, ticker, direction, {r6('score','weight')}, 5 AS hold_days FROM weighted WHERE strategy='{name}'", T5, FRAMES)
    def _(t):
        return X.STRATEGIES[name](frames(t))


_decisions("c8", "mention_momentum")
_decisions("c9", "bullish_catalyst")
_decisions("c10", "creator_consensus")


@query("k4_top_fraction", "SELECT as_of, ticker FROM mm", T5, FRAMES)
def _(t):
    return X.mention_momentum(frames(t)).select("as_of", "ticker")


@query("c11_simulated_trades", f"SELECT strategy, as_of, ticker, direction, entry_at, exit_at, regime_at_entry, {r6('entry_price','exit_price','return_pct','benchmark_return_pct')} FROM curve", T5, FRAMES)
def _(t):
    return trades(t).select("strategy", "as_of", "ticker", "direction", "entry_at", "exit_at", "regime_at_entry", "entry_price", "exit_price", "return_pct", "benchmark_return_pct")


@query("w20_equity_curve", f"SELECT strategy, step, exit_at, {r6('nav','drawdown')} FROM dd", T5, FRAMES)
def _(t):
    return X.equity_curve(trades(t)).select("strategy", F.col("step").cast("long").alias("step"), "exit_at", "nav", "drawdown")


@query("w21_max_drawdown", f"SELECT strategy, round(min(least(0.0e0,drawdown)),6)+0.0e0 AS max_drawdown FROM dd GROUP BY 1", T5, FRAMES)
def _(t):
    return X.run_metrics(trades(t)).select("strategy", "max_drawdown")


@query("c12_walkforward", f"""SELECT strategy, n_trades, start_at, end_at, underpowered, leak_suspect, {r6('final_nav','cagr','sharpe','volatility','hit_rate','hit_rate_lower_ci','hit_rate_upper_ci','win_loss','turnover','mean_return','mean_benchmark')} FROM (
 SELECT *, CASE WHEN d>=30 AND final_nav>0 THEN pow(final_nav, 365.25e0/d)-1 END AS cagr, CASE WHEN n_trades>=5 AND sd>0 THEN m/sd*sqrt(252.0e0) END AS sharpe, CASE WHEN n_trades>=5 AND sd>0 THEN sd*sqrt(252.0e0) END AS volatility, hits*1.0e0/n_trades AS hit_rate,
  greatest(0.0e0,(hits*1.0e0/n_trades+z*z/(2*n_trades)-z*sqrt((hits*1.0e0/n_trades)*(1-hits*1.0e0/n_trades)/n_trades+z*z/(4.0e0*n_trades*n_trades)))/(1+z*z/n_trades)) AS hit_rate_lower_ci,
  least(1.0e0,(hits*1.0e0/n_trades+z*z/(2*n_trades)+z*sqrt((hits*1.0e0/n_trades)*(1-hits*1.0e0/n_trades)/n_trades+z*z/(4.0e0*n_trades*n_trades)))/(1+z*z/n_trades)) AS hit_rate_upper_ci,
  CASE WHEN d>0 THEN w*365.25e0/d END AS turnover, n_trades<30 AS underpowered, coalesce(n_trades>30 AND mean_return>5*abs(mean_benchmark),false) AS leak_suspect
 FROM (SELECT *, date_diff('day', start_at::DATE, end_at::DATE) AS d, 1.96e0 AS z FROM (SELECT strategy, count(*) AS n_trades, arg_max(nav,step) AS final_nav, arg_min(entry_at,step) AS start_at, max(exit_at) AS end_at, avg(r) AS m, stddev_samp(r) AS sd, count(*) FILTER (WHERE return_pct>0) AS hits, avg(return_pct) FILTER (WHERE return_pct>0)/abs(avg(return_pct) FILTER (WHERE return_pct<0)) AS win_loss, sum(weight) AS w, avg(return_pct) AS mean_return, avg(benchmark_return_pct) AS mean_benchmark FROM dd GROUP BY 1) x) y) q""", T5, FRAMES)
def _(t):
    return X.run_metrics(trades(t)).drop("max_drawdown", "avg_holding", "ordered")


@query("c12_cost_grid", "SELECT strategy, cost_bps, count(*) AS n, round(avg(gross-cost_bps/10000.0e0),6)+0.0e0 AS mean_return FROM trades, (SELECT unnest([5,10,25,50]) AS cost_bps) c GROUP BY 1,2", T5, FRAMES)
def _(t):
    return trades(t, (5, 10, 25, 50)).groupBy("strategy", "cost_bps").agg(F.count(F.lit(1)).alias("n"), F.avg("return_pct").alias("mean_return"))


@query("c12_results", f"""SELECT strategy, c.cost_bps, 'v1' AS strategy_version, count(*) AS n_trades, round(avg(gross-c.cost_bps/10000.0e0),6)+0.0e0 AS mean_return, count(*)<40 AS underpowered,
 substr(sha256('{{"benchmark_ticker": "T00", "cost_bps": ' || c.cost_bps || ', "end": "{END}", "min_n_trades": 40, "rebalance": "weekly", "start": "{START}", "strategy_name": "' || strategy || '", "strategy_version": "v1"}}'), 1, 16) AS config_hash FROM trades, (SELECT unnest([5,25]) AS cost_bps) c GROUP BY 1,2""", T5, FRAMES)
def _(t):
    config = {"start": START, "end": END, "benchmark_ticker": BENCHMARK, "rebalance": "weekly", "min_n_trades": 40}
    costs = (5, 25)
    made = X.walkforward(ALL, t.bars, t.sessions, t.claims, t.calls, t.scorecards, BENCHMARK, START, "2010-01-01", costs, cutoff=END)
    return X.walkforward_results(made, dict.fromkeys(ALL, "v1"), costs, config).select("strategy", "cost_bps", "strategy_version", "n_trades", "mean_return", "underpowered", "config_hash")


@query("a11_trade_stats", "SELECT strategy, count(*) AS n_trades, round(avg(CASE WHEN return_pct>0 THEN 1.0e0 ELSE 0.0e0 END),6) AS hit_rate, round(avg(hold_days),6) AS avg_holding FROM curve GROUP BY 1", T5, FRAMES)
def _(t):
    return X.run_metrics(trades(t)).select("strategy", "n_trades", "hit_rate", "avg_holding")


@query("c18_sanity", "SELECT strategy, bool_and(entry_at<=exit_at AND entry_at BETWEEN TIMESTAMP '2000-02-01' AND TIMESTAMP '2000-11-01') AS ordered, count(*)<30 AS underpowered, count(*)>30 AND coalesce(avg(benchmark_return_pct)<>0 AND avg(return_pct)>5*abs(avg(benchmark_return_pct)), false) AS leak_suspect FROM curve GROUP BY 1", T5, FRAMES)
def _(t):
    return X.run_metrics(trades(t), start="2000-02-01", end="2000-11-01").select("strategy", "ordered", "underpowered", "leak_suspect")


@query("a10_regime_breakdown", f"""SELECT strategy, regime_at_entry, n, hits, {r6('mean_return','hit_rate')} FROM (SELECT strategy, regime_at_entry, count(*) AS n, count(*) FILTER (WHERE return_pct>0) AS hits, avg(return_pct) AS mean_return, count(*) FILTER (WHERE return_pct>0)*1.0e0/count(*) AS hit_rate FROM curve GROUP BY 1,2) x""", T5, FRAMES)
def _(t):
    return X.regime_breakdown(trades(t)).drop("lower_ci", "upper_ci")


@query("w23_benchmark_curve", "SELECT ts, round(close/first_value(close) OVER (ORDER BY ts),6) AS nav FROM bars WHERE ticker='T00' AND ts BETWEEN TIMESTAMP '2000-01-03' AND TIMESTAMP '2000-12-31'", ("bars",))
def _(t):
    return X.benchmark_curve(t.bars, BENCHMARK, "2000-01-03", "2000-12-31")


@query("w22_cagr", "SELECT ticker, CASE WHEN d>=30 THEN round(pow(b/a, 365.25e0/d)-1,6)+0.0e0 END AS cagr FROM (SELECT ticker, arg_max(close,ts) AS b, arg_min(close,ts) AS a, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS d FROM bars GROUP BY 1) x", ("bars",))
def _(t):
    ends = t.bars.groupBy("ticker").agg((F.max_by("close", "ts") / F.min_by("close", "ts")).alias("final"), F.date_diff(F.max("ts"), F.min("ts")).alias("days"))
    return ends.select("ticker", X.cagr(F.col("final"), F.col("days")).alias("cagr"))


@query("a9_calibration", f"""SELECT lens_name AS strategy, bucket, n, {r6('mean_score','hit_rate','gap','max_gap','brier','slope','intercept')}, flagged FROM (
 SELECT *, gap>0.2e0 AS flagged, max(gap) OVER (PARTITION BY lens_name) AS max_gap, sum(b) OVER (PARTITION BY lens_name)/sum(n) OVER (PARTITION BY lens_name) AS brier, regr_slope(hit_rate, mean_score) OVER (PARTITION BY lens_name) AS slope, regr_intercept(hit_rate, mean_score) OVER (PARTITION BY lens_name) AS intercept
 FROM (SELECT lens_name, bucket, count(*) AS n, avg(score) AS mean_score, avg(hit) AS hit_rate, abs(avg(score)-avg(hit)) AS gap, sum((score-hit)*(score-hit)) AS b FROM (
  SELECT s.*, len(list_filter(e.edges, lambda x: x<s.score)) AS bucket FROM sc s JOIN (SELECT lens_name, quantile_cont(score, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges FROM sc GROUP BY 1) e USING (lens_name)) x GROUP BY 1,2) y) z""", ("lens_results",),
       "sc AS (SELECT lens_name, abs(return_pct)*20 AS score, CASE WHEN direction_correct THEN 1 ELSE 0 END AS hit FROM lens_results)")
def _(t):
    rows = t.lens_results.select(F.col("lens_name").alias("strategy"), (F.abs("return_pct") * 20).alias("score"), F.col("direction_correct").cast("int").alias("hit"))
    return X.calibrate(rows).withColumn("bucket", F.col("bucket").cast("long"))
