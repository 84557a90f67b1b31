"""Lens outcomes and extraction evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from callbook.plans import lenses as L
from callbook.queries.base import query, r6
from callbook.queries.technical import REGIME
from callbook.testdata import BENCHMARK

NOW = "2001-02-20 00:00:00"


@query("c4_lens_outcomes", f"""SELECT snapshot_id, horizon, {r6('return_pct','excess_pct')}, CASE direction WHEN 'bullish' THEN return_pct>0.005e0 WHEN 'bearish' THEN return_pct< -0.005e0 ELSE abs(return_pct)<=0.005e0 END AS direction_correct, coalesce(regime,'unknown') AS regime FROM (
 SELECT q.snapshot_id, q.horizon, q.direction, q.as_of, b1.close/b0.close-1 AS return_pct, b1.close/b0.close-1-coalesce(CASE WHEN m1.ts>q.d0 THEN m1.close/m0.close-1 END,0) AS excess_pct
 FROM q ASOF JOIN bars b0 ON b0.ticker=q.ticker AND b0.ts<=q.d0 ASOF JOIN bars b1 ON b1.ticker=q.ticker AND b1.ts<=q.d1 ASOF LEFT JOIN mk m0 ON m0.ts<=q.d0 ASOF LEFT JOIN mk m1 ON m1.ts<=q.d1 WHERE b1.ts>q.d0) x ASOF LEFT JOIN reg r ON r.ts<=date_trunc('day', x.as_of)""", ("bars", "sessions", "lens_results"),
       f"""mk AS (SELECT * FROM bars WHERE ticker='{BENCHMARK}'), ses AS (SELECT *, row_number() OVER (ORDER BY session_date) AS no FROM sessions),
{REGIME},
q AS (SELECT l.snapshot_id, l.ticker, l.direction, l.as_of, h.horizon, s.session_date AS d0, e.session_date AS d1 FROM lens_results l ASOF JOIN ses s ON s.market_close<=l.as_of JOIN (VALUES ('1d',1),('3d',3),('5d',5),('21d',21)) h(horizon,n) ON l.as_of+to_days(h.n)<=TIMESTAMP '{NOW}' AND l.as_of>=TIMESTAMP '{NOW}'-INTERVAL 60 DAY JOIN ses e ON e.no=s.no+h.n)""")
def _(t):
    return L.lens_outcomes(t.lens_results.select("snapshot_id", "ticker", "as_of", "direction"), t.bars, t.sessions, BENCHMARK, NOW)


_FIELDS = ("ticker", "direction", "entry_type", "timeframe", "entry_price", "target_price", "stop_price")


@query("a19_extraction_eval", f"""SELECT tp, fp, fn, tn, {r6(*[f'{c}_accuracy' for c in _FIELDS], 'precision', 'recall')}, round(2*precision*recall/(precision+recall),6) AS f1 FROM (SELECT *, tp*1.0e0/(tp+fp) AS precision, tp*1.0e0/(tp+fn) AS recall FROM (
 SELECT count(*) FILTER (WHERE w AND g) AS tp, count(*) FILTER (WHERE NOT w AND g) AS fp, count(*) FILTER (WHERE w AND NOT g) AS fn, count(*) FILTER (WHERE NOT w AND NOT g) AS tn,
 {", ".join(f"avg(CASE WHEN {ok} THEN 1.0e0 ELSE 0.0e0 END) FILTER (WHERE w AND g) AS {c}_accuracy" for c, ok in zip(_FIELDS, ("call_id%10<>3", "true", "entry_type<>'limit'", "call_id%6=1 OR call_id%6=4 OR call_id%6=2", "entry_price IS NULL OR call_id%4<>0", "call_id%8<>5 OR target_price IS NULL AND entry_price IS NULL", "stop_price IS NULL OR stop_price<>0")))}
 FROM (SELECT *, status='accepted' AS w, call_id%7<>0 AS g FROM calls)) a) b""", ("calls",))
def _(t):
    n = F.col("call_id")
    want = t.calls.select(n.alias("id"), (F.col("status") == "accepted").alias("is_call"), "ticker", "direction", "entry_type", F.when(n % 3 == 1, "swing").when(n % 3 == 0, "intraday").alias("timeframe"), "entry_price", "target_price", "stop_price")
    off = F.when(n % 4 == 0, 1.05).otherwise(1.005)
    # a target where none is expected and none where one is
    target = F.when(n % 8 == 5, F.when(F.col("target_price").isNull(), F.col("entry_price"))).otherwise(F.col("target_price"))
    got = t.calls.where("call_id % 7 <> 0").select(
        n.alias("id"), F.lit(True).alias("is_call"), F.when(n % 10 == 3, "ZZZ").otherwise(F.col("ticker")).alias("ticker"), "direction", F.when(F.col("entry_type") == "limit", "market").otherwise(F.col("entry_type")).alias("entry_type"),
        F.when(n % 3 == 1, "swing").when(n % 6 == 2, "unspecified").otherwise("position").alias("timeframe"), (F.col("entry_price") * off).alias("entry_price"), target.alias("target_price"), "stop_price",
    )
    return L.extraction_eval(want, got)
