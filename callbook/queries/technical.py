"""Indicators, levels, setups and the scan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callbook.functions import setup as U
from callbook.operators import indicators as I
from callbook.operators import levels as L
from callbook.plans import research as R
from callbook.plans import scoring
from callbook.queries.base import query, r6
from callbook.queries.calls import OUTCOMES, outcomes
from callbook.testdata import BENCHMARK


def _w(n: int, skip: int = 0) -> str:
    return f"(PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n - 1 + skip} PRECEDING AND {skip} PRECEDING)".replace(" AND 0 PRECEDING", " AND CURRENT ROW")


def _chg(a: str, b: str) -> str:
    return f"CASE WHEN ({b})<>0 THEN ({a})/({b})-1 END"


_O = "(PARTITION BY ticker ORDER BY ts)"
PANEL = f"""b1 AS (SELECT *, row_number() OVER {_O} AS bar_no, lag(close) OVER {_O} AS prev FROM bars),
b2 AS (SELECT *, greatest(close-prev,0) AS up, greatest(prev-close,0) AS down, greatest(high-low, abs(high-prev), abs(low-prev)) AS tr, ln(close/prev) AS lg,
 {", ".join(f"CASE WHEN count(close) OVER {_w(n)}>={n} THEN avg(close) OVER {_w(n)} END AS sma_{n}" for n in I.SMA)} FROM b1),
b3 AS (SELECT *, avg(up) OVER {_w(14)} AS au, avg(down) OVER {_w(14)} AS ad, max(high) OVER {_w(20)} AS t20, min(low) OVER {_w(20)} AS l20 FROM b2),
panel0 AS (SELECT ticker, ts, open, high, low, close, volume, bar_no, {", ".join(f"sma_{n}" for n in I.SMA)},
 CASE WHEN bar_no>=71 THEN {_chg("sma_50", f"lag(sma_50,21) OVER {_O}")} END AS sma_50_slope_21, CASE WHEN bar_no>=263 THEN {_chg("sma_200", f"lag(sma_200,63) OVER {_O}")} END AS sma_200_slope_63,
 CASE WHEN bar_no>=15 THEN CASE WHEN au=0 AND ad=0 THEN 50.0e0 WHEN ad=0 THEN 100.0e0 WHEN au=0 THEN 0.0e0 ELSE 100-100/(1+au/ad) END END AS rsi_14,
 CASE WHEN bar_no>=15 THEN avg(tr) OVER {_w(14)} END AS atr_14, CASE WHEN bar_no>=22 THEN stddev_samp(lg) OVER {_w(21)}*sqrt(252.0e0) END AS realized_vol_21,
 CASE WHEN bar_no>=21 THEN volume/nullif(avg(volume) OVER {_w(20)},0) END AS volume_ratio_20, CASE WHEN bar_no>=20 THEN avg(volume) OVER {_w(20)} END AS avg_volume_20, CASE WHEN bar_no>=63 THEN avg(volume) OVER {_w(63)} END AS avg_volume_63,
 volume*close AS dollar_volume, {", ".join(f"{_chg('close', f'lag(close,{n}) OVER {_O}')} AS return_{n}" for n in I.RETURNS)}, {_chg("open", "prev")} AS gap,
 {_chg("close", f"max(close) OVER {_w(252)}")} AS pct_off_high_52w, {_chg("close", f"min(close) OVER {_w(252)}")} AS pct_off_low_52w,
 CASE WHEN bar_no>=20 THEN (t20-l20)/((t20+l20)/2) END AS consolidation_20, CASE WHEN bar_no>=63 THEN 1-close/max(close) OVER {_w(63)} END AS pullback_63, CASE WHEN bar_no>=64 THEN close/max(close) OVER {_w(63, 1)}-1 END AS breakout_63,
 max(high) OVER {_w(63)} AS recent_high_63, min(low) OVER {_w(63)} AS recent_low_63, min(low) OVER {_w(60)} AS base_low_60, max(high) OVER {_w(60)} AS base_high_60,
 {", ".join(f"{_chg('close', f'sma_{n}')} AS dist_sma_{n}" for n in I.SMA)},
 CASE WHEN sma_50 IS NULL OR sma_200 IS NULL THEN 'insufficient' WHEN close>sma_50 AND sma_50>sma_200 THEN 'bullish_stack' WHEN close<sma_50 AND sma_50<sma_200 THEN 'bearish_stack' ELSE 'mixed' END AS ma_alignment FROM b3),
panel AS (SELECT *, atr_14/close AS atr_14_pct, CAST(consolidation_20<=0.05e0 AS varchar) AS tight_20 FROM panel0)"""
RS = f"""al AS (SELECT b.ticker, b.ts, b.close, s.close AS bc FROM bars b JOIN bars s ON s.ticker='T00' AND s.ts=b.ts),
rs AS (SELECT ticker, ts, {", ".join(f"({_chg('close', f'lag(close,{n}) OVER {_O}')})-({_chg('bc', f'lag(bc,{n}) OVER {_O}')}) AS rs_{n}" for n in (63, 126))} FROM al)"""


def _panel_query(name: str, *columns: str, digits: int = 6):
    texts = [c for c in columns if c in ("ma_alignment", "tight_20")]
    numbers = [c for c in columns if c not in texts]

    @query(name, f"SELECT {', '.join(['ticker', 'ts', *texts])}{', ' if numbers else ''}{r6(*numbers, digits=digits)} FROM panel", ("bars",), PANEL, digits)
    def _(t):
        return I.panel(t.bars).select("ticker", "ts", *[F.col(c).cast("string").alias(c) for c in texts], *numbers)


# means of prices of four decimals fall on ties at six
_panel_query("w1_sma", *[f"sma_{n}" for n in I.SMA], digits=8)
_panel_query("w3_slope", "sma_50_slope_21", "sma_200_slope_63")
_panel_query("w4_rsi", "rsi_14")
_panel_query("w5_atr", "atr_14", "atr_14_pct")
_panel_query("w6_realized_vol", "realized_vol_21")
_panel_query("w7_volume", "volume_ratio_20", "avg_volume_20", "avg_volume_63", "dollar_volume")
_panel_query("w8_returns", *[f"return_{n}" for n in I.RETURNS])
_panel_query("w9_gap", "gap")
_panel_query("w10_high_low_52w", "pct_off_high_52w", "pct_off_low_52w")
_panel_query("w13_distances", *[f"dist_sma_{n}" for n in I.SMA])
_panel_query("w16_consolidation", "consolidation_20", "tight_20")
_panel_query("w17_pullback_breakout", "pullback_63", "breakout_63")
_panel_query("w18_recent_range", "recent_high_63", "recent_low_63", "base_low_60", "base_high_60")
_panel_query("t13_ma_alignment", "ma_alignment")


EMAS = f"nb AS (SELECT *, row_number() OVER {_O} AS bar_no FROM bars), rec AS (SELECT ticker, ts, bar_no, close AS e8, close AS e21 FROM nb WHERE bar_no=1 UNION ALL SELECT n.ticker, n.ts, n.bar_no, n.close*2/9.0e0+r.e8*7/9.0e0, n.close*2/22.0e0+r.e21*20/22.0e0 FROM rec r JOIN nb n ON n.ticker=r.ticker AND n.bar_no=r.bar_no+1)"


@query("w2_ema", f"""SELECT ticker, ts, {r6('ema_8','ema_21')} FROM (SELECT ticker, ts, CASE WHEN bar_no>=8 THEN e8 END AS ema_8, CASE WHEN bar_no>=21 THEN e21 END AS ema_21 FROM rec) x""", ("bars",),
       EMAS)
def _(t):
    return I.ema(t.bars).select("ticker", "ts", "ema_8", "ema_21")


@query("w13_ema_distances", f"SELECT ticker, ts, CASE WHEN bar_no>=8 THEN round(close/e8-1,6)+0.0e0 END AS dist_ema_8, CASE WHEN bar_no>=21 THEN round(close/e21-1,6)+0.0e0 END AS dist_ema_21 FROM rec JOIN bars USING (ticker, ts)", ("bars",), EMAS)
def _(t):
    return I.ema_distances(t.bars)


@query("w11_relative_strength", f"SELECT ticker, ts, {r6('rs_63','rs_126')} FROM rs", ("bars",), RS)
def _(t):
    return I.relative_strength(t.bars, BENCHMARK)


@query("w12_excess_return", f"SELECT o.ticker, o.ts, round(o.r5-b.r5,6)+0.0e0 AS excess_5, round(o.r21-b.r21,6)+0.0e0 AS excess_21, round(o.r63-b.r63,6)+0.0e0 AS excess_63 FROM own o ASOF LEFT JOIN (SELECT * FROM own WHERE ticker='T00') b ON b.ts<=o.ts", ("bars",),
       f"own AS (SELECT ticker, ts, {', '.join(f'{_chg('close', f'lag(close,{n}) OVER {_O}')} AS r{n}' for n in (5, 21, 63))} FROM bars)")
def _(t):
    return I.excess_returns(t.bars, BENCHMARK)


SWINGS = f"""nb AS (SELECT *, row_number() OVER {_O} AS bar_no, count(*) OVER (PARTITION BY ticker) AS n_bars FROM bars),
ext AS (SELECT *, max(high) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS hb, max(high) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ha,
 min(low) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lb, min(low) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS la FROM nb),
swings AS (SELECT ticker, bar_no, ts, 'high' AS kind, high AS price FROM ext WHERE bar_no>5 AND bar_no<=n_bars-5 AND high>hb AND high>ha UNION ALL SELECT ticker, bar_no, ts, 'low', low FROM ext WHERE bar_no>5 AND bar_no<=n_bars-5 AND low<lb AND low<la)"""


@query("w14_swings", f"SELECT ticker, bar_no, ts, kind, {r6('price')}, bar_no+5 AS confirmed_no FROM swings", ("bars",), SWINGS)
def _(t):
    return I.swings(t.bars).withColumns({"bar_no": F.col("bar_no").cast("long"), "confirmed_no": F.col("confirmed_no").cast("long")})


_NEWEST = "array_to_string(list_transform({}(list(price) FILTER (WHERE kind='{}' AND k<=5)), lambda x: printf('%.8f', x)), ',')"
# the levels of every bar from the swings confirmed by then
NEAR = f"""near AS (SELECT n.ticker, n.ts, n.bar_no, n.close, max(price) FILTER (WHERE price<close) AS support, min(price) FILTER (WHERE price>close) AS resistance, coalesce({_NEWEST.format('list_reverse_sort', 'high')},'') AS highs, coalesce({_NEWEST.format('list_sort', 'low')},'') AS lows
 FROM nb n LEFT JOIN (SELECT m.ticker, m.bar_no AS at_no, s.price, s.kind, row_number() OVER (PARTITION BY m.ticker, m.bar_no, s.kind ORDER BY s.bar_no DESC) AS k FROM nb m JOIN swings s ON s.ticker=m.ticker AND s.bar_no+5<=m.bar_no AND s.bar_no>m.bar_no-252) y ON y.ticker=n.ticker AND y.at_no=n.bar_no GROUP BY 1,2,3,4)"""


def _texts(prices: str):
    return F.array_join(F.transform(prices, lambda x: F.format_string("%.8f", x)), ",")


@query("w15_nearest_levels", f"SELECT ticker, ts, bar_no, {r6('support','resistance')}, highs, lows, round((close-support)/close,6)+0.0e0 AS support_distance, round((resistance-close)/close,6)+0.0e0 AS resistance_distance FROM near", ("bars",), f"{SWINGS}, {NEAR}")
def _(t):
    out = L.levels(t.bars)
    return out.select("ticker", "ts", F.col("bar_no").cast("long").alias("bar_no"), "support", "resistance", _texts("swing_highs").alias("highs"), _texts("swing_lows").alias("lows"), "support_distance", "resistance_distance")


REGIME = f"reg AS (SELECT ts, CASE WHEN c IS NULL THEN 'unknown' WHEN c>0.02e0 THEN 'up' WHEN c<-0.02e0 THEN 'down' ELSE 'flat' END AS regime FROM (SELECT ts, close/lag(close,21) OVER (ORDER BY ts)-1 AS c FROM bars WHERE ticker='T00') x)"


@query("w19_regime", "SELECT call_id, coalesce(regime,'unknown') AS regime FROM calls c ASOF LEFT JOIN reg r ON r.ts<=date_trunc('day', c.posted_at)", ("bars", "calls"), REGIME)
def _(t):
    days = I.regimes(t.bars, BENCHMARK)
    return t.calls.withColumn("day", F.to_date("posted_at")).join(days, "day", "left").select("call_id", F.coalesce("regime", F.lit("unknown")).alias("regime"))


@query("w24_screen_technicals", f"SELECT ticker, {r6('last_close','sma_200','return_63')}, round(return_63-(SELECT return_63 FROM sc WHERE ticker='T00'),6)+0.0e0 AS rs_vs_benchmark FROM sc", ("bars",),
       "sc AS (SELECT ticker, max(close) FILTER (WHERE k=1) AS last_close, CASE WHEN count(*)>=50 THEN avg(close) END AS sma_200, max(close) FILTER (WHERE k=1)/max(close) FILTER (WHERE k=63)-1 AS return_63 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k FROM bars) WHERE k<=200 GROUP BY 1)")
def _(t):
    return I.screen_technicals(t.bars, BENCHMARK)


SETUP = f"""{PANEL}, {RS},
setups AS (SELECT p.ticker, p.ts, p.close, p.bar_no, CASE
 WHEN bar_no<200 OR sma_200 IS NULL THEN 'insufficient_data low' WHEN coalesce(dollar_volume<5000000,false) THEN 'low_liquidity medium'
 WHEN coalesce(atr_14_pct>0.08e0,false) OR coalesce(realized_vol_21>0.8e0,false) THEN 'high_volatility_unstable medium'
 WHEN ma_alignment='bearish_stack' AND (sma_50_slope_21 IS NULL OR sma_50_slope_21< -0.005e0) THEN 'downtrend medium'
 WHEN coalesce(dist_sma_200< -0.03e0 AND sma_200_slope_63< -0.005e0 AND rs_126< -0.1e0,false) THEN 'downtrend low'
 WHEN ma_alignment='bullish_stack' AND coalesce(dist_sma_50>0.15e0 AND rsi_14>75,false) THEN 'extended_momentum medium'
 WHEN ma_alignment='bullish_stack' AND coalesce(pullback_63 BETWEEN 0.04e0 AND 0.18e0,false) THEN 'uptrend_pullback medium'
 WHEN ma_alignment='bullish_stack' AND (coalesce(consolidation_20<=0.08e0 AND breakout_63 BETWEEN -0.03e0 AND 0.03e0,false) OR coalesce(breakout_63>0 AND breakout_63<=0.03e0,false)) THEN 'breakout_candidate medium'
 WHEN ma_alignment='bullish_stack' AND coalesce(sma_50_slope_21>0.005e0,false) THEN 'strong_uptrend medium'
 WHEN ma_alignment IN ('mixed','insufficient') AND coalesce(consolidation_20<=0.1e0,false) THEN 'range_bound medium' ELSE 'unclear low' END AS setup
 FROM panel p LEFT JOIN rs USING (ticker, ts))"""


@query("t14_setup", "SELECT ticker, ts, setup FROM setups", ("bars",), SETUP)
def _(t):
    return R.research_panel(t.bars, BENCHMARK).select("ticker", "ts", F.concat_ws(" ", "setup_type", "setup_confidence").alias("setup"))


@query("t14_setup_counts", "SELECT setup, count(*) AS n FROM setups GROUP BY 1", ("bars",), SETUP)
def _(t):
    return R.research_panel(t.bars, BENCHMARK).groupBy(F.concat_ws(" ", "setup_type", "setup_confidence").alias("setup")).agg(F.count(F.lit(1)).alias("n"))


_P = lambda x, d=1: f"printf('%.{d}f', ({x})*100)"
_DOWN = f"""|| CASE WHEN sma_50_slope_21 IS NOT NULL THEN '|50-day slope is '||{_P('sma_50_slope_21')}||'% over 21 bars — pointing down.' ELSE '' END || CASE WHEN rs_126<0 THEN '|Underperformed SPY by '||{_P('abs(rs_126)')}||'% over 126 bars.' ELSE '' END"""


@query("t14_reasons", f"""SELECT p.ticker, p.ts, CASE split_part(setup,' ',1)
 WHEN 'insufficient_data' THEN 'Only '||p.bar_no||' bars available; need ≥200 to evaluate the long-trend stack.'
 WHEN 'low_liquidity' THEN 'Dollar volume '||CASE WHEN dollar_volume>=1e6 THEN '$'||printf('%.1f',dollar_volume/1e6)||'M' WHEN dollar_volume>=1e3 THEN '$'||printf('%.0f',dollar_volume/1e3)||'K' ELSE '$'||printf('%.0f',dollar_volume) END||' below $5.0M threshold.'
 WHEN 'high_volatility_unstable' THEN 'ATR(14) is '||{_P('coalesce(atr_14_pct,0)')}||'% of price or realized vol is '||{_P('coalesce(realized_vol_21,0)', 0)}||'% annualized — both stops and entries become wide.'
 WHEN 'downtrend' THEN CASE WHEN setup='downtrend medium' THEN 'MAs are stacked bearishly (price < 50 < 200).' ELSE 'Price is '||{_P('dist_sma_200')}||'% below the 200-SMA with the 200-day slope still negative.' END {_DOWN}
 WHEN 'extended_momentum' THEN 'Price is '||{_P('dist_sma_50', 0)}||'% above the 50-day MA — extended.|RSI(14) at '||printf('%.0f',rsi_14)||' — overbought.'
 WHEN 'uptrend_pullback' THEN 'Bullish MA stack with a '||{_P('pullback_63')}||'% pullback from the 63-bar high.'||CASE WHEN sma_50_slope_21>0.005e0 THEN '|50-day slope '||{_P('sma_50_slope_21')}||'% over 21 bars — uptrend still intact.' ELSE '' END
 WHEN 'breakout_candidate' THEN CASE WHEN breakout_63>0 AND breakout_63<=0.03e0 THEN 'Fresh breakout: closed '||{_P('breakout_63')}||'% above the 63-bar recent high.' ELSE 'Within '||{_P('abs(breakout_63)')}||'% of the 63-bar recent high — breakout setup.' END||CASE WHEN consolidation_20<=0.08e0 THEN '|Tight consolidation ('||{_P('consolidation_20')}||'% range over 20 bars).' ELSE '' END
 WHEN 'strong_uptrend' THEN 'Bullish MA stack (price > 20 > 50 > 200).|50-day slope '||{_P('sma_50_slope_21')}||'% over 21 bars — upward sloping.'
 WHEN 'range_bound' THEN 'MAs are not stacked; price is consolidating in a tight range.' ELSE 'No rule branch matched this combination of indicators + levels.' END AS reasons FROM panel p JOIN setups s USING (ticker, ts) LEFT JOIN rs USING (ticker, ts)""", ("bars",), SETUP)
def _(t):
    return R.research_panel(t.bars, BENCHMARK).select("ticker", "ts", F.array_join("setup_reasons", "|").alias("reasons"))


@query("t33_freshness", "SELECT ticker, count(*) AS n_bars, count(*)>=252 AS enough, date_diff('day', max(ts)::DATE, DATE '2001-12-20') AS age, CASE WHEN count(*)<200 THEN 'short_history' ELSE '' END || CASE WHEN date_diff('day', max(ts)::DATE, DATE '2001-12-20')>7 THEN 'stale' ELSE '' END AS notes FROM bars GROUP BY 1", ("bars",))
def _(t):
    rows = t.bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars"), F.max("ts").alias("last"))
    at = F.lit("2001-12-20 00:00:00").cast("timestamp")
    return rows.select("ticker", "n_bars", U.enough_history(F.col("n_bars")).alias("enough"), U.bar_age(F.col("last"), at).cast("long").alias("age"), F.array_join(U.freshness(F.col("n_bars"), F.col("last"), at), "").alias("notes"))


def status_sql(where: str = "") -> str:
    """Styles, status and action of panel rows by the rules' own words: st (one row per ticker and bar), from SETUP and EMA21."""
    fits = {
        "momentum_breakout": "CASE WHEN brk AND tight AND leads THEN 3 WHEN (brk OR near) AND (tight OR leads) THEN 2 ELSE 1 END",
        "trend_pullback": "CASE WHEN kind='uptrend_pullback' THEN CASE WHEN at_mean THEN 3 ELSE 2 END WHEN kind='strong_uptrend' THEN CASE WHEN pulled THEN 2 ELSE 1 END WHEN ma_alignment='bullish_stack' AND pulled THEN 2 ELSE 1 END",
        "mean_reversion": "CASE WHEN kind='range_bound' AND rsi_14<=30 THEN 3 WHEN kind='range_bound' AND rsi_14>=70 THEN 2 WHEN rsi_14<=30 AND kind IN ('uptrend_pullback','strong_uptrend') THEN 2 ELSE 1 END",
        "base_breakout": "CASE WHEN shallow AND near AND kind IN ('breakout_candidate','strong_uptrend') THEN 3 WHEN shallow THEN 2 ELSE 1 END",
        "relative_strength_leader": "CASE WHEN rs_63>0.05e0 AND rs_126>0.1e0 THEN CASE WHEN up THEN 3 ELSE 2 END WHEN rs_63>0.03e0 AND kind IN ('strong_uptrend','uptrend_pullback') THEN 2 ELSE 1 END",
        "not_suitable_now": "CASE WHEN kind IN ('downtrend','high_volatility_unstable','low_liquidity','insufficient_data','extended_momentum','unclear') THEN 3 ELSE 1 END",
    }
    preferred = "CASE WHEN kind IN ('strong_uptrend','uptrend_pullback') THEN 'trend_pullback' WHEN kind='breakout_candidate' THEN 'momentum_breakout' WHEN kind='extended_momentum' THEN 'relative_strength_leader' WHEN kind='range_bound' THEN 'mean_reversion' ELSE 'not_suitable_now' END"
    first = "".join(f"WHEN f_{n}=top THEN '{n}' " for n in fits)
    return f"""rec AS (SELECT ticker, bar_no, close AS e FROM b1 WHERE bar_no=1 UNION ALL SELECT n.ticker, n.bar_no, n.close*2/22.0e0+r.e*20/22.0e0 FROM rec r JOIN b1 n ON n.ticker=r.ticker AND n.bar_no=r.bar_no+1),
st0 AS (SELECT p.*, rs_63, rs_126, split_part(s.setup,' ',1) AS kind, split_part(s.setup,' ',2) AS sure, CASE WHEN p.bar_no>=21 THEN e END AS ema_21 FROM panel p JOIN setups s USING (ticker, ts) LEFT JOIN rs USING (ticker, ts) JOIN rec ON rec.ticker=p.ticker AND rec.bar_no=p.bar_no {where}),
st1 AS (SELECT *, kind='breakout_candidate' AS brk, kind IN ('strong_uptrend','uptrend_pullback','breakout_candidate') AS up, coalesce(breakout_63 BETWEEN -0.05e0 AND 0.02e0,false) AS near, coalesce(consolidation_20<=0.05e0,false) AS tight, coalesce(rs_63>0,false) AS leads,
 coalesce(pullback_63 BETWEEN 0.04e0 AND 0.18e0,false) AS pulled, coalesce(close/ema_21-1 BETWEEN -0.06e0 AND 0.04e0,false) OR coalesce(dist_sma_50 BETWEEN -0.08e0 AND 0.04e0,false) AS at_mean, coalesce((base_high_60-base_low_60)/base_high_60<0.2e0,false) AS shallow FROM st0),
st2 AS (SELECT *, {', '.join(f'{f} AS f_{n}' for n, f in fits.items())}, {preferred} AS preferred FROM st1),
st3 AS (SELECT *, greatest({', '.join(f'f_{n}' for n in fits)}) AS top, greatest({', '.join(f'f_{n}' for n in fits if n != 'not_suitable_now')}) AS best, CAST(ma_alignment='bullish_stack' AS int)+CAST(coalesce(sma_50_slope_21>0,false) AS int) AS hi FROM st2),
st4 AS (SELECT *, CAST(leads AS int)+CAST(base_low_60 IS NOT NULL AS int)+CAST(best>=2 AS int) AS mid, CAST(coalesce(rsi_14 BETWEEN 40 AND 70,false) AS int) AS lo,
 CASE WHEN top=1 THEN NULL WHEN CASE preferred {''.join(f"WHEN '{n}' THEN f_{n} " for n in fits)}END=top THEN preferred {first}END AS primary_style FROM st3),
st5 AS (SELECT *, CASE WHEN kind='insufficient_data' THEN 'insufficient_data' WHEN kind IN ('low_liquidity','high_volatility_unstable','downtrend') THEN 'skip_for_now' WHEN kind='extended_momentum' THEN 'extended_risk'
  WHEN up AND hi=2 AND mid>=1 AND best=3 THEN 'research_candidate' WHEN up AND hi>=1 THEN 'watch' WHEN kind IN ('range_bound','unclear') THEN 'wait_for_setup' ELSE 'watch' END AS status,
 CASE WHEN kind IN ('insufficient_data','unclear') THEN 'low' WHEN kind IN ('low_liquidity','high_volatility_unstable','downtrend','extended_momentum') THEN 'medium' WHEN up AND hi=2 AND mid>=1 AND best=3 THEN CASE WHEN mid>=2 THEN 'high' ELSE 'medium' END WHEN up AND hi>=1 THEN 'medium' WHEN kind='range_bound' THEN 'medium' ELSE 'low' END AS status_confidence,
 CASE WHEN kind IN ('insufficient_data','low_liquidity','high_volatility_unstable') THEN 0.0e0 WHEN kind='downtrend' THEN CAST(coalesce(sma_50_slope_21>0,false) AS int)/2.0e0 WHEN kind='extended_momentum' THEN CAST(coalesce(rsi_14<=75,false) AS int)/2.0e0 ELSE (hi+mid+lo)/6.0e0 END AS pass_rate,
 close IS NOT NULL AND atr_14 IS NOT NULL AND (kind='breakout_candidate' OR ((kind='uptrend_pullback' OR (kind='strong_uptrend' AND pulled_some)) AND coalesce(ema_21,sma_50) IS NOT NULL) OR kind='range_bound') AS available FROM (SELECT *, coalesce(pullback_63>=0.04e0,false) AS pulled_some FROM st4) q),
st AS (SELECT *, CASE status WHEN 'insufficient_data' THEN 'N/A' WHEN 'skip_for_now' THEN 'AVOID' WHEN 'extended_risk' THEN 'REDUCE' WHEN 'research_candidate' THEN CASE WHEN status_confidence='high' AND available THEN 'BUY' WHEN status_confidence IN ('high','medium') THEN 'ACCUMULATE' ELSE 'HOLD' END WHEN 'watch' THEN CASE WHEN status_confidence='high' THEN 'HOLD' ELSE 'WAIT' END ELSE 'WAIT' END AS action FROM st5)"""


def judged(t):
    return R.research_view(t.bars, BENCHMARK)


_FITS = " || ".join(f"CAST(f_{n} AS varchar)" for n in U.STYLES)


@query("t15_style_fit", f"SELECT ticker, ts, {_FITS} AS fits, primary_style FROM st", ("bars",), f"{SETUP}, {status_sql()}")
def _(t):
    level = F.transform("style_fit", lambda x: F.when(x["fit_level"] == "high", "3").when(x["fit_level"] == "medium", "2").otherwise("1"))
    return judged(t).select("ticker", "ts", F.array_join(level, "").alias("fits"), "primary_style")


@query("t16_status", f"SELECT ticker, ts, status, status_confidence, {r6('pass_rate')} FROM st", ("bars",), f"{SETUP}, {status_sql()}")
def _(t):
    return judged(t).select("ticker", "ts", "status", "status_confidence", "pass_rate")


_RULES = {
    "ma_alignment_bullish": ("high", "ma_alignment='bullish_stack'", "NULL", "bullish_stack", "kind NOT IN ('insufficient_data','low_liquidity','high_volatility_unstable','extended_momentum')"),
    "sma_50_slope_positive": ("high", "coalesce(sma_50_slope_21>0,false)", "sma_50_slope_21", "0.0", "kind NOT IN ('insufficient_data','low_liquidity','high_volatility_unstable','extended_momentum')"),
    "rs_vs_spy_63d_positive": ("medium", "leads", "rs_63", "0.0", "plain"), "rsi_in_range_40_70": ("low", "lo=1", "rsi_14", "40-70", "plain"),
    "has_clean_risk_reference": ("medium", "base_low_60 IS NOT NULL", "NULL", "yes", "plain"), "style_fit_present": ("medium", "best>=2", "NULL", "non-low", "plain"),
    "data_sufficiency": ("high", "false", "bar_no", "200", "kind='insufficient_data'"), "dollar_volume_min": ("high", "false", "dollar_volume", "5000000", "kind='low_liquidity'"),
    "atr_pct_under_high": ("high", "false", "atr_14_pct", "0.08", "kind='high_volatility_unstable'"), "dist_to_sma_50_below_extended": ("high", "false", "dist_sma_50", "0.15", "kind='extended_momentum'"),
    "rsi_under_75": ("medium", "coalesce(rsi_14<=75,false)", "rsi_14", "75", "kind='extended_momentum'"),
}
_PLAIN = "(SELECT *, kind NOT IN ('insufficient_data','low_liquidity','high_volatility_unstable','extended_momentum','downtrend') AS plain FROM st)"


@query("t16_rubric", " UNION ALL ".join(f"SELECT ticker, ts, '{n}' AS rule, '{w}' AS weight, {p} AS passed, round(CAST({v} AS double),6)+0.0e0 AS value, '{x}' AS threshold FROM {_PLAIN} WHERE {given}" for n, (w, p, v, x, given) in _RULES.items()), ("bars",), f"{SETUP}, {status_sql()}")
def _(t):
    rows = judged(t).select("ticker", "ts", F.explode("rubric").alias("r")).select("ticker", "ts", "r.*")
    return rows.select("ticker", "ts", "rule", "weight", "passed", F.expr("try_cast(value as double)").alias("value"), "threshold")


@query("t17_action", "SELECT ticker, ts, action, available FROM st", ("bars",), f"{SETUP}, {status_sql()}")
def _(t):
    return judged(t).select("ticker", "ts", "action", "available")


@query("c5_research_view", f"""SELECT ticker, ts, kind AS setup_type, sure AS setup_confidence, status, status_confidence, primary_style, action, bar_no>=252 AS enough_history, highs, lows, {r6('support','resistance','ema_21','rs_63','rs_126','pass_rate')}, round(o.r5-b.r5,6)+0.0e0 AS excess_5, round(o.r21-b.r21,6)+0.0e0 AS excess_21, round(o.r63-b.r63,6)+0.0e0 AS excess_63
 FROM st JOIN (SELECT ticker, ts, support, resistance, highs, lows FROM near) USING (ticker, ts) JOIN own o USING (ticker, ts) ASOF LEFT JOIN (SELECT ts, r5, r21, r63 FROM own WHERE ticker='T00') b ON b.ts<=st.ts""", ("bars",),
       f"{SETUP}, {status_sql()}, {SWINGS}, {NEAR}, own AS (SELECT ticker, ts, {', '.join(f'{_chg('close', f'lag(close,{n}) OVER {_O}')} AS r{n}' for n in (5, 21, 63))} FROM bars)")
def _(t):
    out = judged(t)
    return out.select("ticker", "ts", "setup_type", "setup_confidence", "status", "status_confidence", "primary_style", "action", "enough_history", _texts("swing_highs").alias("highs"), _texts("swing_lows").alias("lows"), "support", "resistance", "ema_21", "rs_63", "rs_126", "pass_rate", "excess_5", "excess_21", "excess_63")


AS_OF = "2000-06-30"
SCAN = f"""{SETUP}, {status_sql(f"WHERE p.ts<=TIMESTAMP '{AS_OF}'")},
asked AS (SELECT DISTINCT ticker FROM bars UNION SELECT 'ZZZ'),
scanned AS (SELECT a.ticker, coalesce(kind,'insufficient_data') AS setup_type, coalesce(sure,'low') AS setup_confidence, coalesce(status,'insufficient_data') AS status, coalesce(status_confidence,'low') AS status_confidence, CASE WHEN s.ticker IS NULL THEN 'not_suitable_now' ELSE primary_style END AS primary_style, coalesce(action,'N/A') AS action, close
 FROM asked a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k FROM st) s ON s.ticker=a.ticker AND s.k=1)"""


def scanned(t):
    return R.scan(t.bars.select("ticker").union(t.spark.sql("select ' zzz'")), t.bars, BENCHMARK, AS_OF)


@query("c6_scan", "SELECT ticker, setup_type, setup_confidence, status, status_confidence, primary_style, action, round(close,6) AS close FROM scanned", ("bars",), SCAN)
def _(t):
    return scanned(t).select("ticker", "setup_type", "setup_confidence", "status", "status_confidence", "primary_style", "action", "close")


@query("k2_rank_scan", """SELECT ticker, row_number() OVER (ORDER BY CASE status WHEN 'research_candidate' THEN 0 WHEN 'watch' THEN 1 WHEN 'extended_risk' THEN 2 WHEN 'wait_for_setup' THEN 3 WHEN 'skip_for_now' THEN 4 ELSE 5 END,
 CASE status_confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE setup_confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE WHEN primary_style<>'not_suitable_now' THEN 0 ELSE 1 END, ticker) AS place FROM scanned""", ("bars",), SCAN)
def _(t):
    # one row per requested ticker: numbering them in one task is bounded by the request
    rows = scanned(t).select("ticker", F.monotonically_increasing_id().alias("_at"))
    return rows.select("ticker", F.row_number().over(Window.orderBy("_at")).cast("long").alias("place"))


@query("a20_scan_counts", "SELECT count(*) AS n, CAST(0 AS bigint) AS n_errors, count(*) FILTER (WHERE status='research_candidate') AS n_research_candidates, count(*) FILTER (WHERE status='watch') AS n_watch, count(*) FILTER (WHERE status='skip_for_now') AS n_skip, count(*) FILTER (WHERE status='insufficient_data') AS n_insufficient FROM scanned", ("bars",), SCAN)
def _(t):
    return R.scan_counts(scanned(t))


@query("c20_regime_split", f"SELECT creator_id, regime, n, hits, {r6('mean_return')} FROM (SELECT creator_id, coalesce(r.regime,'unknown') AS regime, count(*) AS n, count(*) FILTER (WHERE return_pct>0) AS hits, avg(return_pct) AS mean_return FROM (SELECT o.*, c.creator_id, date_trunc('day', c.posted_at) AS d FROM outcomes o JOIN calls c USING (call_id) WHERE o.status='evaluated' AND o.horizon='5d') x ASOF LEFT JOIN reg r ON r.ts<=x.d GROUP BY 1,2) y", ("bars", "sessions", "calls"), f"{OUTCOMES}, {REGIME}")
def _(t):
    return scoring.regime_split(outcomes(t), t.calls, I.regimes(t.bars, BENCHMARK))
