"""Portfolio, screen, text, sources and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callbook.functions import text as X
from callbook.operators import bars as B
from callbook.operators import indicators as I
from callbook.operators import windows as W
from callbook.plans import portfolio as P
from callbook.plans import screener as S
from callbook.plans import signals as G
from callbook.queries.base import query, r6
from callbook.sources import tables as IO
from callbook.streaming import streams
from callbook.testdata import BENCHMARK

LEDGER = """lg AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY traded_at, id) AS k FROM trades),
rec AS (SELECT ticker, k, quantity AS qty, quantity*price_per_share+fees AS basis, 0.0e0 AS realized, eur_amount AS eb, 0.0e0 AS er FROM lg WHERE k=1
 UNION ALL SELECT l.ticker, l.k, CASE l.side WHEN 'buy' THEN r.qty+l.quantity ELSE r.qty-l.quantity END, CASE l.side WHEN 'buy' THEN r.basis+l.quantity*l.price_per_share+l.fees ELSE r.basis-l.quantity*(r.basis/r.qty) END,
  CASE l.side WHEN 'buy' THEN r.realized ELSE r.realized+(l.quantity*l.price_per_share-l.fees)-l.quantity*(r.basis/r.qty) END,
  CASE l.side WHEN 'buy' THEN r.eb+l.eur_amount ELSE r.eb-l.quantity*(r.eb/r.qty) END, CASE l.side WHEN 'buy' THEN r.er+0*l.eur_amount ELSE r.er+l.eur_amount-l.quantity*(r.eb/r.qty) END FROM rec r JOIN lg l ON l.ticker=r.ticker AND l.k=r.k+1),
ledger AS (SELECT ticker, qty AS quantity, basis AS cost_basis, realized, eb, er FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY k DESC) AS z FROM rec) WHERE z=1),
quotes AS (SELECT ticker, arg_max(close, ts) AS price, arg_max(open, ts) AS previous FROM bars GROUP BY 1),
view AS (SELECT l.*, q.price, quantity*price AS market_value, quantity*price-cost_basis AS unrealized, quantity*(price-previous) AS day_change FROM ledger l LEFT JOIN quotes q USING (ticker))"""
TARGETS = "targets AS (SELECT concat('T', lpad(CAST(k AS varchar),2,'0')) AS ticker, 0.02e0+0.01e0*(k%5) AS target FROM range(0, 15) r(k) UNION ALL SELECT 'ZZZ', 0.05e0)"


def quotes(t):
    return t.bars.groupBy("ticker").agg(F.max_by("close", "ts").alias("price"), F.max_by("open", "ts").alias("previous")).withColumn("currency", F.lit("usd"))


def targets(t):
    own = t.spark.range(15).select(F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("ticker"), (0.02 + 0.01 * (F.col("id") % 5)).alias("target"))
    return own.unionByName(t.spark.sql("select 'ZZZ' ticker, 0.05d target"))


def view(t):
    return P.positions(P.fold_ledger(t.trades), quotes(t), 1.1)


@query("c13_fold_ledger", "SELECT ticker, round(quantity,4) AS quantity, round(cost_basis,4) AS cost_basis, round(realized,4) AS realized, first_traded_at, last_traded_at, n_trades FROM ledger JOIN (SELECT ticker, min(traded_at) AS first_traded_at, max(traded_at) AS last_traded_at, count(*) AS n_trades FROM trades GROUP BY 1) n USING (ticker)", ("trades", "bars"), LEDGER, 4)
def _(t):
    return P.fold_ledger(t.trades).select("ticker", "quantity", "cost_basis", "realized", "first_traded_at", "last_traded_at", "n_trades")


@query("c13_fold_in_eur", "SELECT ticker, CASE WHEN n=0 THEN round(eb,4) END AS eur_cost_basis, CASE WHEN n=0 THEN round(er,4) END AS eur_realized FROM ledger JOIN (SELECT ticker, count(*) FILTER (WHERE eur_amount IS NULL) AS n FROM trades GROUP BY 1) n USING (ticker)", ("trades", "bars"), LEDGER, 4)
def _(t):
    return P.fold_ledger(t.trades).select("ticker", "eur_cost_basis", "eur_realized")


@query("k6_trade_log", "SELECT id, ticker, traded_at FROM trades ORDER BY traded_at DESC, id DESC", ("trades",))
def _(t):
    return P.trade_log(t.trades).select("id", "ticker", "traded_at")


@query("c14_validate_ledger", """SELECT ticker, error FROM (SELECT l.ticker, CASE n%3 WHEN 0 THEN CASE WHEN l.quantity<1000000 THEN 'oversell' END WHEN 1 THEN CASE WHEN TIMESTAMP '1990-01-01' + INTERVAL 1 DAY * CAST(18000+n AS int) > TIMESTAMP '2030-01-01' THEN 'future trade' END END AS error
 FROM (SELECT *, CAST(substr(ticker,2) AS int) AS n FROM ledger) l) x WHERE error IS NOT NULL""", ("trades", "bars"), LEDGER)
def _(t):
    # every ticker gets one more trade: a large sale, a purchase in a future that some of them only reach, or a small purchase
    k = F.substring("ticker", 2, 2).cast("int")
    days = F.when(k % 3 == 1, 18000 + k).otherwise(14000)
    newest = t.trades.groupBy("ticker").agg(F.max("id").alias("id"), F.first("currency").alias("currency"))
    edits = newest.select((-F.col("id")).alias("id"), "ticker", F.when(k % 3 == 0, "sell").otherwise("buy").alias("side"), F.when(k % 3 == 0, 1e6).otherwise(1.0).alias("quantity"), F.lit(1.0).alias("price_per_share"), "currency", F.lit(0.0).alias("fees"), (F.lit("1990-01-01").cast("timestamp") + F.make_dt_interval(days)).alias("traded_at"))
    return P.validate_ledger(t.trades, edits, "2030-01-01 00:00:00")


@query("c15_positions", "SELECT ticker, round(market_value,3) AS market_value, round(unrealized,3) AS unrealized, round(day_change,3) AS day_change, round(unrealized/cost_basis*100,3) AS unrealized_pct, round(day_change/quantity/(price-day_change/quantity)*100,3)+0.0e0 AS day_change_pct, round(market_value/1.1e0,3) AS market_value_eur FROM view", ("trades", "bars"), LEDGER, 3)
def _(t):
    return P.ordered(view(t)).select("ticker", "market_value", "unrealized", "day_change", "unrealized_pct", "day_change_pct", "market_value_eur")


@query("j15_quotes", "SELECT ticker, round(price,6) AS price FROM view", ("trades", "bars"), LEDGER)
def _(t):
    return view(t).select("ticker", "price")


@query("a22_portfolio_totals", "SELECT count(*) AS n_open, round(sum(market_value),2) AS market_value, round(sum(unrealized),2) AS unrealized, round(sum(day_change),2) AS day_change, round(sum(realized),2) AS realized, round(sum(market_value)/1.1e0,2) AS market_value_eur FROM view", ("trades", "bars"), LEDGER, 2)
def _(t):
    return P.totals(view(t))


POLICY = f"""{LEDGER}, {TARGETS},
pol0 AS (SELECT ticker, market_value FROM view UNION ALL SELECT ticker, 0.0e0 FROM targets WHERE ticker NOT IN (SELECT ticker FROM view)),
pol AS (SELECT p.ticker, market_value/sum(market_value) OVER () AS weight, target, greatest(target-0.05e0, target*0.75e0) AS low, least(target+0.05e0, target*1.25e0) AS high FROM pol0 p LEFT JOIN targets USING (ticker))"""


@query("t29_policy", "SELECT ticker, round(weight,6) AS weight, CASE WHEN target IS NULL THEN 'no_target' WHEN weight>high THEN 'trim' WHEN weight<low THEN 'add' ELSE 'in_band' END AS status, round((weight-target)*100,6)+0.0e0 AS deviation_pp FROM pol", ("trades", "bars"), POLICY)
def _(t):
    return P.policy_view(view(t), targets(t)).select("ticker", "weight", "status", "deviation_pp")


@query("s2_missing_targets", "SELECT ticker FROM targets EXCEPT SELECT ticker FROM view", ("trades", "bars"), f"{LEDGER}, {TARGETS}")
def _(t):
    return targets(t).join(view(t), "ticker", "left_anti").select("ticker")


@query("a21_factors", "SELECT factor, round(sum(market_value),2) AS value, round(sum(market_value)/(SELECT sum(market_value) FROM view),2) AS weight, round((sum(market_value)/(SELECT sum(market_value) FROM view)-0.3e0)*100,2) AS excess_pp FROM view JOIN (SELECT ticker, 'F' || CAST(CAST(substr(ticker,2) AS int)%3 AS varchar) AS factor FROM view) f USING (ticker) GROUP BY 1", ("trades", "bars"), LEDGER, 2)
def _(t):
    v = view(t)
    factors = quotes(t).select("ticker", F.concat(F.lit("F"), (F.substring("ticker", 2, 2).cast("int") % 3).cast("string")).alias("factor"))
    return P.factor_concentration(v, factors, 0.3)


@query("a21_listed_weight", "SELECT round(w,6) AS weight, round((w-0.4e0)*100,6)+0.0e0 AS excess_pp FROM (SELECT sum(CASE WHEN CAST(substr(ticker,2) AS int)%3<2 THEN market_value ELSE 0 END)/sum(market_value) AS w FROM view) x", ("trades", "bars"), LEDGER)
def _(t):
    v = view(t)
    factors = quotes(t).select("ticker", F.concat(F.lit("F"), (F.substring("ticker", 2, 2).cast("int") % 3).cast("string")).alias("factor"))
    return P.listed_weight(P.factor_concentration(v, factors, 0.3), ["F0", "F1"], 0.4)


SCREEN = """sc AS (SELECT *, coalesce(forward_pe<25,false) OR coalesce(peg_ratio>0 AND peg_ratio<1.5e0,false) OR coalesce(ev_to_ebitda>0 AND ev_to_ebitda<15,false) AS pass_value,
 coalesce(revenue_growth>0.15e0 AND earnings_growth IS NOT NULL AND (earnings_growth>0 OR coalesce(revenue_growth_qoq>revenue_growth,false)),false) AS pass_growth,
 coalesce(gross_margin>0.4e0 AND return_on_equity>0.15e0 AND debt_to_equity<1,false) AS pass_quality,
 coalesce(price_vs_sma_200>0 AND price_vs_sma_200<=0.3e0 AND rs_vs_benchmark>0,false) AS pass_technical FROM metrics)"""


@query("c7_screen", "SELECT ticker, pass_value, pass_growth, pass_quality, pass_technical, CAST(pass_value AS int)+CAST(pass_growth AS int)+CAST(pass_quality AS int)+CAST(pass_technical AS int) AS n_passed FROM sc", ("metrics",), SCREEN)
def _(t):
    return S.screen(t.metrics).select("ticker", "pass_value", "pass_growth", "pass_quality", "pass_technical", "n_passed")


UNIVERSE = f"""sn AS (SELECT ticker, max(close) FILTER (WHERE k=1) AS last_close, CASE WHEN count(*)>=50 THEN avg(close) END AS sma_200, max(close) FILTER (WHERE k=1)/max(close) FILTER (WHERE k=63)-1 AS r FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k FROM bars) WHERE k<=200 GROUP BY 1),
tech AS (SELECT ticker, last_close/sma_200-1 AS x, sma_200, r-(SELECT r FROM sn WHERE ticker='T00') AS rs FROM sn),
said AS (SELECT ticker, count(*) AS n, avg(final_confidence) AS c FROM (SELECT 'P' || CAST(call_id%300 AS varchar) AS ticker, final_confidence FROM calls WHERE status='accepted' UNION ALL SELECT 'P' || CAST(claim_id%200 AS varchar), final_confidence FROM claims WHERE status='accepted') z GROUP BY 1),
joined AS (SELECT u.ticker, u.own, CASE WHEN m.ticker IS NULL THEN u.sector ELSE coalesce(m.sector, u.sector) END AS sector, m.ticker IS NOT NULL AS known, forward_pe, peg_ratio, ev_to_ebitda, revenue_growth, earnings_growth, revenue_growth_qoq, gross_margin, return_on_equity, debt_to_equity, days_to_earnings, x, sma_200, rs, coalesce(n,0) AS n, c
 FROM (SELECT ticker, sector, CAST(substr(ticker,2) AS int) AS own FROM metrics) u LEFT JOIN (SELECT * REPLACE (CASE WHEN CAST(substr(ticker,2) AS int)%3=0 THEN NULL ELSE sector END AS sector) FROM metrics WHERE CAST(substr(ticker,2) AS int)%10<>7) m ON m.ticker=u.ticker LEFT JOIN tech t ON t.ticker=concat('T', lpad(CAST(own%20 AS varchar),2,'0')) LEFT JOIN said s ON s.ticker=u.ticker),
su AS (SELECT *, known AND (coalesce(forward_pe<25,false) OR coalesce(peg_ratio>0 AND peg_ratio<1.5e0,false) OR coalesce(ev_to_ebitda>0 AND ev_to_ebitda<15,false)) AS v, known AND coalesce(revenue_growth>0.15e0 AND earnings_growth IS NOT NULL AND (earnings_growth>0 OR coalesce(revenue_growth_qoq>revenue_growth,false)),false) AS g,
 known AND coalesce(gross_margin>0.4e0 AND return_on_equity>0.15e0 AND debt_to_equity<1,false) AS q, known AND coalesce(x>0 AND x<=0.3e0 AND rs>0,false) AS h FROM joined)"""


def screened(t):
    number = F.expr("cast(substr(ticker, 2) as int)")
    metrics = t.metrics.where(number % 10 != 7).withColumn("sector", F.when(number % 3 != 0, F.col("sector")))
    listing = t.metrics.select("ticker", F.concat(F.lit("T"), F.lpad((number % 20).cast("string"), 2, "0")).alias("_t"))
    technicals = I.screen_technicals(t.bars, BENCHMARK).withColumnRenamed("ticker", "_t").join(listing, "_t")
    about = lambda rows, key, n: rows.withColumn("ticker", F.concat(F.lit("P"), (F.col(key) % n).cast("string")))
    return S.screen_universe(t.metrics.select("ticker", "sector"), metrics, technicals, about(t.calls, "call_id", 300), about(t.claims, "claim_id", 200))


@query("c7_screen_universe", f"SELECT ticker, sector, CASE WHEN NOT known THEN 'no_metrics' END AS error, CAST(v AS int)+CAST(g AS int)+CAST(q AS int)+CAST(h AS int) AS n_passed, CASE WHEN known THEN n ELSE 0 END AS n_mentions, CASE WHEN known THEN round(c,6) END AS avg_confidence, CASE WHEN known THEN round(x,6)+0.0e0 END AS price_vs_sma_200 FROM su", ("metrics", "bars", "calls", "claims"), UNIVERSE)
def _(t):
    return screened(t).select("ticker", "sector", "error", "n_passed", "n_mentions", "avg_confidence", "price_vs_sma_200")


@query("io10_screen_table", f"""SELECT ticker, coalesce(sector,'') AS sector, {r6('fwd_pe','peg','ev_ebitda','rev_growth','earn_growth','gross_margin','roe','debt_equity','pct_vs_200d','rs_vs_spy_3mo','avg_creator_confidence')}, CAST(days_to_earnings AS varchar) AS days_to_earnings, creator_mentions, filters_passed, flags, data_quality, '' AS error FROM (
 SELECT ticker, sector, forward_pe AS fwd_pe, peg_ratio AS peg, ev_to_ebitda AS ev_ebitda, revenue_growth AS rev_growth, earnings_growth AS earn_growth, gross_margin, return_on_equity AS roe, debt_to_equity AS debt_equity, x AS pct_vs_200d, rs AS rs_vs_spy_3mo, c AS avg_creator_confidence, days_to_earnings, n AS creator_mentions,
 concat_ws(',', CASE WHEN v THEN 'value' END, CASE WHEN g THEN 'growth' END, CASE WHEN q THEN 'quality' END, CASE WHEN h THEN 'technical' END) AS filters_passed,
 concat_ws(',', CASE WHEN v AND earnings_growth<0 THEN 'cheap_for_a_reason' END, CASE WHEN days_to_earnings BETWEEN 0 AND 30 THEN 'earnings_in_' || CAST(days_to_earnings AS varchar) || 'd' END, CASE WHEN x>0.3e0 THEN 'extended_above_200d' END) AS flags,
 concat_ws(',', CASE WHEN forward_pe IS NULL THEN 'no_pe' END, CASE WHEN revenue_growth IS NULL THEN 'no_revenue_growth' END, CASE WHEN gross_margin IS NULL THEN 'no_gross_margin' END, CASE WHEN return_on_equity IS NULL THEN 'no_roe' END, CASE WHEN sma_200 IS NULL THEN 'no_sma_200' END, CASE WHEN rs IS NULL THEN 'no_relative_strength' END) AS data_quality
 FROM su WHERE v OR g OR q OR h) y""", ("metrics", "bars", "calls", "claims"), UNIVERSE)
def _(t):
    return S.screen_table(screened(t)).withColumn("days_to_earnings", F.col("days_to_earnings").cast("string"))


@query("t24_flags", "SELECT ticker, CASE WHEN (coalesce(forward_pe<25,false) OR coalesce(peg_ratio>0 AND peg_ratio<1.5e0,false) OR coalesce(ev_to_ebitda>0 AND ev_to_ebitda<15,false)) AND earnings_growth<0 THEN 'cheap_for_a_reason|' ELSE '' END || CASE WHEN days_to_earnings BETWEEN 0 AND 30 THEN 'earnings_in_' || CAST(days_to_earnings AS varchar) || 'd|' ELSE '' END || CASE WHEN price_vs_sma_200>0.3e0 THEN 'extended_above_200d|' ELSE '' END AS flags FROM metrics", ("metrics",))
def _(t):
    return S.screen(t.metrics).select("ticker", F.array_join(F.transform("flags", lambda x: F.concat(x, F.lit("|"))), "").alias("flags"))


RATIOS = {"forward_pe": (-200, 500), "trailing_pe": (-200, 500), "peg": (-50, 50), "price_to_sales": (0, 200), "revenue_growth": (-2, 5), "profit_margins": (-2, 5), "operating_margins": (-2, 5)}
_SANE = ", ".join(f"CASE WHEN {c}>{a} AND {c}<{b} THEN {c} END AS {c}" for c, (a, b) in RATIOS.items())
MEDIANS = f"""sane AS (SELECT * FROM (SELECT ticker, {_SANE}, market_cap FROM ratios) x WHERE coalesce({', '.join([*RATIOS, 'market_cap'])}) IS NOT NULL),
med AS (SELECT p.target, count(s.ticker) AS n_peers, list_sort(list(s.ticker) FILTER (WHERE s.ticker IS NOT NULL)) AS peer_list, {', '.join(f'median(s.{c}) AS median_{c}' for c in [*RATIOS, 'market_cap'])} FROM peers p LEFT JOIN sane s ON s.ticker=p.peer AND p.peer<>p.target GROUP BY 1)"""


@query("a18_peer_medians", f"SELECT target, n_peers, coalesce(array_to_string(peer_list, ','), '') AS peers, {r6(*[f'median_{c}' for c in [*RATIOS, 'market_cap']])} FROM med", ("peers", "ratios"), MEDIANS)
def _(t):
    return S.peer_medians(t.peers, t.ratios).withColumn("peers", F.array_join("peers", ","))


@query("t27_relative_value", """SELECT target, n_peers, round(r,6) AS ratio, CASE WHEN r>1.3e0 THEN 'rich' WHEN r<0.75e0 THEN 'cheap' WHEN r IS NOT NULL THEN 'in_line' ELSE 'unknown' END AS value,
 CASE WHEN g>0.05e0 THEN 'faster' WHEN g< -0.05e0 THEN 'slower' WHEN g IS NOT NULL THEN 'in_line' ELSE 'unknown' END AS growth, CASE WHEN m>0.05e0 THEN 'higher' WHEN m< -0.05e0 THEN 'lower' WHEN m IS NOT NULL THEN 'in_line' ELSE 'unknown' END AS margin
 FROM (SELECT target, n_peers, r.forward_pe/nullif(median_forward_pe,0) AS r, r.revenue_growth-median_revenue_growth AS g, r.profit_margins-median_profit_margins AS m FROM med JOIN ratios r ON r.ticker=target) x""", ("peers", "ratios"), MEDIANS)
def _(t):
    return S.relative_value(t.peers, t.ratios)


@query("t1_clean_text", "SELECT document_id, segment_id, trim(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '\\s+', ' ', 'g')) AS text FROM segments", ("segments",))
def _(t):
    return t.segments.select("document_id", "segment_id", X.clean_text(F.col("text")).alias("text"))


@query("t2_symbols", "SELECT DISTINCT replace(upper(trim(sector)), '.', '-') AS canonical, replace(replace(upper(trim(sector)), '.', '-'), '-', '.') AS display FROM metrics", ("metrics",))
def _(t):
    return t.metrics.select(X.canonical_symbol(F.col("sector")).alias("canonical"), X.display_symbol(F.col("sector")).alias("display")).distinct()


def universe():
    return {f"T{i:02d}": f"Company{i}" for i in range(20)}


MENTIONED = "ment AS (SELECT document_id, segment_id, regexp_extract_all(text, '\\bT[01][0-9]\\b') AS found FROM segments)"


@query("t3_detect_tickers", "SELECT document_id, segment_id, array_to_string(found, ',') AS tickers FROM ment WHERE len(found)>0", ("segments",), MENTIONED)
def _(t):
    m = t.segments.withColumn("m", X.detector(universe(), letters="[A-Z0-9]")(F.col("text"))).where(F.size("m") > 0)
    return m.select("document_id", "segment_id", F.array_join(F.transform("m", lambda x: x["ticker"]), ",").alias("tickers"))


@query("t4_unique_tickers", "SELECT document_id, segment_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(found), lambda x: {'p': list_position(found, x), 'x': x})), lambda y: y.x), ',') AS tickers FROM ment WHERE len(found)>0", ("segments",), MENTIONED)
def _(t):
    m = t.segments.withColumn("m", X.detector(universe(), letters="[A-Z0-9]")(F.col("text"))).where(F.size("m") > 0)
    return m.select("document_id", "segment_id", F.array_join(X.unique_tickers(F.col("m")), ",").alias("tickers"))


@query("t7_hedges", r"SELECT document_id, segment_id, regexp_matches(text, '(?i)\b(could|might|may(?:be)?|probably|possibly|likely|unlikely|should|would|seems|appears|i\s+think)\b') AS hedged FROM segments WHERE text IS NOT NULL", ("segments",))
def _(t):
    return t.segments.where("text is not null").select("document_id", "segment_id", X.has_hedge(F.col("text")).alias("hedged"))


_SQUASHED = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


@query("t6_evidence", f"SELECT document_id, segment_id, length({_SQUASHED.format('quote')})>0 AND contains({_SQUASHED.format('text')}, {_SQUASHED.format('quote')}) AS there FROM (SELECT document_id, segment_id, coalesce(text,'') AS text, coalesce(upper(substr(lead(text) OVER (PARTITION BY document_id ORDER BY segment_id), 3, 4)), '') AS quote FROM segments) x", ("segments",))
def _(t):
    # a few characters of the next segment, in another case
    some = F.substring(F.lead("text").over(Window.partitionBy("document_id").orderBy("segment_id")), 3, 4)
    # letter by letter: one without a single upper letter, as the German sharp s, stays
    quote = F.array_join(F.transform(F.split(some, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")
    return t.segments.withColumn("quote", quote).select("document_id", "segment_id", X.evidence_in_source(F.col("quote"), F.col("text")).alias("there"))


@query("t12_confidence", "SELECT call_id, round(greatest(0.0e0, least(1.0e0, 0.6e0*final_confidence+0.4e0*(1-0.25e0*CAST(target_price IS NULL AS int))+least(0.1e0, 0.025e0*(CAST(entry_price IS NOT NULL AS int)+CAST(target_price IS NOT NULL AS int)+CAST(stop_price IS NOT NULL AS int))))),6) AS confidence FROM calls", ("calls",))
def _(t):
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("entry_price", "target_price", "stop_price")), F.lit(0))
    return t.calls.select("call_id", X.final_confidence(F.col("final_confidence"), 1 - 0.25 * F.col("target_price").isNull().cast("int"), filled).alias("confidence"))


@query("t30_direction_correct", "SELECT snapshot_id, CASE direction WHEN 'bullish' THEN return_pct>0.005e0 WHEN 'bearish' THEN return_pct< -0.005e0 ELSE abs(return_pct)<=0.005e0 END AS correct FROM lens_results", ("lens_results",))
def _(t):
    return t.lens_results.select("snapshot_id", X.direction_correct(F.col("direction"), F.col("return_pct")).alias("correct"))


# segments walked one window after the other; rec holds the first segment of each
WINDOWS = r"""sg0 AS (SELECT document_id, segment_id, start_seconds AS s, end_seconds AS e, trim(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\s+', ' ', 'g')) AS txt FROM segments),
sg AS (SELECT *, row_number() OVER w AS i, sum(length(txt)+1) OVER w AS p, coalesce(s-lag(e) OVER w>3, false) AS gap FROM sg0 WHERE txt<>'' WINDOW w AS (PARTITION BY document_id ORDER BY s, segment_id)),
nxt AS (SELECT a.document_id, a.i, min(b.i) AS j FROM sg a LEFT JOIN sg b ON b.document_id=a.document_id AND b.i>a.i AND b.i<=a.i+751 AND (b.e-a.s>25 OR b.p-1-(a.p-length(a.txt)-1)>1500 OR b.gap) GROUP BY 1,2),
rec AS (SELECT DISTINCT document_id, CAST(1 AS bigint) AS i, 0 AS window_no FROM sg UNION ALL SELECT r.document_id, n.j, r.window_no+1 FROM rec r JOIN nxt n ON n.document_id=r.document_id AND n.i=r.i WHERE n.j IS NOT NULL),
win AS (SELECT r.document_id, r.window_no, min(g.s) AS start_seconds, max_by(g.e, g.i) AS end_seconds, string_agg(g.txt, ' ' ORDER BY g.i) AS text, count(*) AS n_segments, string_agg(CAST(g.segment_id AS varchar), ',' ORDER BY g.i) AS ids FROM rec r JOIN nxt n ON n.document_id=r.document_id AND n.i=r.i JOIN sg g ON g.document_id=r.document_id AND g.i>=r.i AND (n.j IS NULL OR g.i<n.j) GROUP BY 1,2)"""


def _ids(column: str):
    return F.array_join(F.transform(column, lambda i: i.cast("string")), ",")


@query("w27_consolidate", "SELECT document_id, CAST(window_no AS int) AS window_no, start_seconds, end_seconds, text, CAST(n_segments AS int) AS n_segments, ids FROM win", ("segments",), WINDOWS)
def _(t):
    return W.consolidate(t.segments).withColumn("ids", _ids("segment_ids")).drop("segment_ids")


_WORDS = X.CALL_WORDS.replace("'", "''")
CANDIDATES = f"""{WINDOWS},
sc AS (SELECT *, 1.5e0*m+least(v,3)+0.5e0*least(pr,3)+CASE WHEN m>0 AND v>0 THEN 0.5e0 ELSE 0.0e0 END AS score FROM (SELECT *, regexp_extract_all(text, '\\bT[01][0-9]\\b') AS found, len(regexp_extract_all(text, '\\bT[01][0-9]\\b')) AS m, len(regexp_extract_all(text, '{_WORDS}')) AS v,
 len(list_filter(regexp_extract_all(text, '{X.PRICE}'), lambda x: CAST(replace(x,'$','') AS double) BETWEEN 1 AND 100000)) AS pr FROM win) x),
cl AS (SELECT *, sum(CASE WHEN start_seconds-last_end<=60 THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY start_seconds) AS cluster FROM (SELECT *, lag(end_seconds) OVER (PARTITION BY document_id ORDER BY start_seconds) AS last_end FROM sc WHERE score>=2) y),
gr AS (SELECT document_id, cluster, min(start_seconds) AS lo, max(end_seconds) AS hi, sum(score) AS score, min_by(ids, window_no) AS first_ids, array_to_string(list_sort(list_distinct(flatten(list(found)))), ',') AS tickers FROM cl GROUP BY 1,2)"""


@query("c16_candidate_windows", """SELECT g.document_id, CAST(cluster AS bigint) AS cluster, lo AS "from", hi AS "to", round(any_value(score),6) AS score, any_value(tickers) AS tickers, any_value(first_ids) AS first_ids, string_agg(w.text, ' ' ORDER BY w.window_no) AS context, string_agg(w.ids, ',' ORDER BY w.window_no) AS context_ids, min(w.start_seconds) AS context_start, max(w.end_seconds) AS context_end
 FROM gr g JOIN win w ON w.document_id=g.document_id AND w.end_seconds>=lo-90 AND w.start_seconds<=hi+90 GROUP BY 1,2,3,4""", ("segments",), CANDIDATES)
def _(t):
    out = W.candidate_windows(t.segments, X.detector(universe(), letters="[A-Z0-9]"))
    return out.select("document_id", "cluster", "from", "to", "score", F.array_join("tickers", ",").alias("tickers"), _ids("first_segment_ids").alias("first_ids"), "context", _ids("context_segment_ids").alias("context_ids"), "context_start", "context_end")


@query("io1_clean_bars", "SELECT ticker, count(*) AS n, round(sum(close),4) AS total FROM bars GROUP BY 1", ("bars",), digits=4)
def _(t):
    return B.clean_bars(t.bars.unionByName(t.bars)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total"))


@query("io2_merge_bars", "SELECT ticker, ts, CASE WHEN ts>=TIMESTAMP '2001-01-01' THEN round(close+1,4) ELSE close END AS close FROM bars", ("bars",))
def _(t):
    revised = t.bars.where("ts >= '2001-01-01'").withColumn("close", F.round(F.col("close") + 1, 4))
    return B.merge_bars(t.bars, revised).select("ticker", "ts", "close")


@query("io4_merge_universes", "SELECT coalesce(a.ticker,b.ticker) AS ticker, coalesce(a.name,b.name) AS name, CASE WHEN a.ticker IS NOT NULL AND b.ticker IS NOT NULL THEN 'both' WHEN a.ticker IS NOT NULL THEN 'own' ELSE 'web' END AS source FROM (SELECT * FROM metrics WHERE hash(1)=hash(1) AND CAST(substr(ticker,2) AS int)%3<>0) a FULL JOIN (SELECT ticker, upper(name) AS name FROM metrics WHERE CAST(substr(ticker,2) AS int)%2=0) b USING (ticker)", ("metrics",))
def _(t):
    number = F.expr("cast(substr(ticker, 2) as int)")
    a = t.metrics.where(number % 3 != 0).select("ticker", "name", "sector", F.lit("own").alias("source"))
    b = t.metrics.where(number % 2 == 0).select("ticker", F.upper("name").alias("name"), "sector", F.lit("web").alias("source"))
    return IO.merge_universes(a, b).select("ticker", "name", "source")


@query("io6_upsert_counts", "SELECT count(*) FILTER (WHERE status<>'accepted') AS inserted, count(*) FILTER (WHERE status='accepted') AS updated FROM calls", ("calls",))
def _(t):
    return IO.upsert_counts(t.calls.where("status = 'accepted'"), t.calls, "call_id")


@query("io6_upsert_gold", "SELECT call_id AS source_key, CASE WHEN status='accepted' THEN 'call' ELSE 'none' END AS label, CASE WHEN direction='long' THEN 'new' ELSE 'old' END AS notes FROM calls", ("calls",))
def _(t):
    label = F.when(F.col("status") == "accepted", "call").otherwise("none").alias("label")
    rows = lambda df, notes: df.select(F.col("call_id").alias("source_key"), label, F.lit(notes).alias("notes"))
    return IO.upsert_gold(rows(t.calls, "old"), rows(t.calls.where("direction = 'long'"), "new"))


@query("io8_upsert_by_key", "SELECT call_id, CASE WHEN direction='long' THEN 'new' ELSE 'old' END AS version FROM calls", ("calls",))
def _(t):
    old = t.calls.select("call_id", F.lit("old").alias("version"))
    return IO.upsert_by_key(old, t.calls.where("direction = 'long'").select("call_id", F.lit("new").alias("version")), ["call_id"])


@query("io9_append_if_absent", "SELECT call_id, CASE WHEN direction='long' THEN 'old' ELSE 'new' END AS version FROM calls", ("calls",))
def _(t):
    old = t.calls.where("direction = 'long'").select("call_id", F.lit("old").alias("version"))
    return IO.append_if_absent(old, t.calls.select("call_id", F.lit("new").alias("version")), ["call_id"])


@query("io12_plan_lenses", "SELECT snapshot_id AS plan_id, ticker, as_of, round(3.0e0/2,6) AS cost, u.lens_name, u.direction, u.conviction FROM lens_results CROSS JOIN LATERAL (SELECT lens_name, direction, 'low' AS conviction UNION ALL SELECT 'second', 'neutral', conviction) u WHERE snapshot_id%10<>0", ("lens_results",))
def _(t):
    lenses = F.array(F.struct(F.col("lens_name").alias("name"), "direction", F.lit(None).cast("string").alias("conviction")), F.struct(F.lit("second").alias("name"), F.lit(None).cast("string").alias("direction"), "conviction"))
    body = F.when(F.col("snapshot_id") % 10 == 0, "{broken").otherwise(F.to_json(F.struct(F.lit(3.0).alias("cost"), lenses.alias("lenses"))))
    plans = t.lens_results.select(F.col("snapshot_id").alias("plan_id"), "ticker", F.col("as_of").alias("computed_at"), F.to_date("as_of").alias("day_key"), body.alias("plan_json"))
    return IO.explode_plan_lenses(plans)


@query("st2_signals_batch_twin", "SELECT ticker, date_trunc('day', posted_at)+INTERVAL 1 DAY AS window_end, count(*) AS n_mentions FROM claims WHERE status='accepted' AND ticker IS NOT NULL GROUP BY 1,2", ("claims",))
def _(t):
    return streams.continuous_signals(t.claims).select("ticker", "window_end", "n_mentions")


_MENTIONED = """m0 AS (SELECT ticker, creator_id, posted_at, CASE direction WHEN 'long' THEN 1.0e0 WHEN 'short' THEN -1.0e0 ELSE 0.0e0 END AS p, 1.0e0 AS cw, 1 AS c FROM calls WHERE status='accepted' AND ticker IS NOT NULL
 UNION ALL SELECT ticker, creator_id, posted_at, CASE polarity WHEN 'bullish' THEN 1.0e0 WHEN 'bearish' THEN -1.0e0 ELSE 0.0e0 END, CASE claim_class WHEN 'factual' THEN 1.0e0 WHEN 'opinion' THEN 0.5e0 WHEN 'speculation' THEN 0.25e0 ELSE 0.0e0 END, 0 FROM claims WHERE status='accepted' AND ticker IS NOT NULL),
cred AS (SELECT creator_id, max_by(hit_rate_lower_ci, (computed_at, scorecard_id)) AS credibility FROM scorecards WHERE hit_rate_lower_ci IS NOT NULL GROUP BY 1),
m1 AS (SELECT m0.*, coalesce(credibility,1.0e0)*cw AS w, CAST(date_trunc('day', posted_at) AS date) AS d FROM m0 LEFT JOIN cred USING (creator_id)),
ends AS (SELECT DISTINCT ticker, n, d+CAST(i+1 AS int) AS e FROM m1, (VALUES (1),(7),(30)) z(n), range(30) r(i) WHERE i<n)"""


@query("st2_window_signals", f"SELECT ticker, CAST(n AS varchar)||'d' AS window_size, CAST(e AS timestamp) AS window_end, CAST(sum(1-c) AS bigint) AS n_claims, CAST(sum(c) AS bigint) AS n_calls, round(avg(p),8)+0.0e0 AS net_polarity, round(sum(p*w)/nullif(sum(w),0),8)+0.0e0 AS credibility_weighted, true AS creators_in_bound FROM ends JOIN m1 USING (ticker) WHERE m1.d<e AND m1.d>=e-CAST(n AS int) GROUP BY 1,2,3", ("calls", "claims", "scorecards"), _MENTIONED, 8)
def _(t):
    daily = streams.daily_mentions(t.claims, t.calls, G.latest_credibility(t.scorecards))
    out = [streams.window_signals(daily, size) for size in G.WINDOW_DAYS]
    # at most 25 creators here, which sketches of this size count exactly
    both = reduce(DataFrame.unionByName, out)
    return both.select("ticker", "window_size", "window_end", "n_claims", "n_calls", "net_polarity", "credibility_weighted", F.col("n_creators").between(1, 25).alias("creators_in_bound"))


_SECTORS = "CASE p_partkey%5 WHEN 0 THEN 'Metal' WHEN 1 THEN 'Plated' WHEN 2 THEN 'Other' WHEN 3 THEN NULL ELSE '' END"


@query("t27_resolve_peers", f"""SELECT target, CASE WHEN peers IS NULL THEN 'none' WHEN place IS NULL THEN 'sector' ELSE 'industry' END AS by, array_to_string(list_filter(coalesce(peers,[]), lambda x: x<>target), ',') AS peers FROM (
 SELECT c.ticker AS target, min(k.place) AS place, coalesce(min_by(k.peers, k.place), any_value(f.peers)) AS peers FROM (SELECT 'P'||p_partkey AS ticker, {_SECTORS} AS sector, lower(p_type) AS industry FROM part) c
 LEFT JOIN (VALUES (0, NULL, 'promo burnished', ['P1','P2','P3']), (1, 'Metal', 'copper', ['P5','P10','P15']), (2, 'Metal', 'steel', ['P20','P25']), (3, 'Plated', 'plated', ['P6','P11']), (4, 'Other', 'zzz', ['P7'])) k(place, sector, key, peers) ON contains(c.industry, k.key) AND (k.sector IS NULL OR k.sector=c.sector)
 LEFT JOIN (VALUES ('Metal', ['P30','P35']), ('Other', ['P2','P7'])) f(sector, peers) ON f.sector=c.sector GROUP BY 1) q""")
def _(t):
    parts = t.part.select(F.concat(F.lit("P"), "p_partkey").alias("ticker"), F.expr(_SECTORS).alias("sector"), F.col("p_type").alias("industry"))
    keyed = [(0, None, "promo burnished", ["P1", "P2", "P3"]), (1, "Metal", "Copper", ["P5", "P10", "P15"]), (2, "Metal", "steel", ["P20", "P25"]), (3, "Plated", "plated", ["P6", "P11"]), (4, "Other", "zzz", ["P7"])]
    fallback = t.spark.createDataFrame([("Metal", ["P30", "P35"]), ("Other", ["P2", "P7"])], "sector string, peers array<string>")
    found = S.resolve_peers(parts, t.spark.createDataFrame(keyed, "place int, sector string, key string, peers array<string>"), fallback)
    listed = F.sort_array(F.collect_list(F.when(F.col("peer").isNotNull(), F.struct("rank", "peer"))))
    return found.groupBy("target", "by").agg(F.array_join(listed["peer"], ",").alias("peers"))


@query("f11_scan_input", "SELECT DISTINCT upper(trim(c_mktsegment)) AS ticker FROM customer WHERE trim(c_mktsegment)<>'' AND c_custkey%3<>0")
def _(t):
    watched = t.customer.select(F.when(F.col("c_custkey") % 3 == 0, "creator").otherwise("ticker").alias("entity_type"), F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("entity_id"))
    return G.scan_input(watched)


@query("a20_screen_counts", "SELECT count(*) AS universe, count(*) FILTER (WHERE p_partkey%13<>5) AS completed, count(*) FILTER (WHERE p_partkey%13=5) AS errors, count(*) FILTER (WHERE p_partkey%13<>5 AND p_size>25) AS passing FROM part")
def _(t):
    rows = t.part.select((F.col("p_size") > 25).alias("passed"), F.when(F.col("p_partkey") % 13 == 5, "timeout").alias("error"))
    return S.screen_counts(rows)
