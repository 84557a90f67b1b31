"""Validation of raw extractions, exits and picks, transcript context."""

from __future__ import annotations

from pyspark.sql import functions as F

from callbook.functions import zones as Z
from callbook.plans import extraction as E
from callbook.plans import signals as G
from callbook.queries.base import query, r6
from callbook.queries.technical import SETUP
from callbook.queries.zones import LEVELS, _rows

UNIVERSE = [f"T{i:02d}" for i in range(20)]
_PLAIN = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


def _said(quote: str) -> str:
    return f"coalesce(length({_PLAIN.format(quote)})>0 AND contains({_PLAIN.format('source')}, {_PLAIN.format(quote)}), false)"


_NAMES = ("entry", "target", "stop")
RAW = f"""v0 AS (SELECT *, ticker IN ({', '.join(f"'{u}'" for u in UNIVERSE)}) AS known, {_said('ticker_evidence')} AS quoted, {_said('direction_evidence')} AS directed, {', '.join(f"CASE WHEN {_said(f'{p}_evidence')} THEN {p}_price END AS s_{p}" for p in _NAMES)} FROM raw_calls),
v1 AS (SELECT *, {', '.join(f"CASE WHEN market_price>0 AND s_{p} NOT BETWEEN market_price*0.5e0 AND market_price*1.5e0 THEN NULL ELSE s_{p} END AS k_{p}" for p in _NAMES)} FROM v0),
v2 AS (SELECT *, entry_type IN ('limit','trigger_above','trigger_below') AND k_entry IS NULL AS loose, {'+'.join(f"CAST({p}_price IS NOT NULL AND k_{p} IS NULL AS int)" for p in _NAMES)} AS n_emptied FROM v1),
v3 AS (SELECT *, CAST(NOT directed AS int)+CAST(loose AS int)+{'+'.join(f"CAST(s_{p} IS NOT NULL AND k_{p} IS NULL AS int)" for p in _NAMES)} AS n_warnings, {'+'.join(f"CAST({c} IS NOT NULL AS int)" for c in ("k_entry", "k_target", "k_stop"))}+CAST(timeframe<>'unspecified' AS int) AS filled FROM v2),
v4 AS (SELECT *, CASE WHEN NOT known OR NOT quoted THEN 0.0e0 ELSE greatest(0.0e0, least(1.0e0, 1-0.15e0*n_warnings-0.25e0*n_emptied)) END AS rule_confidence FROM v3),
v5 AS (SELECT *, CASE WHEN NOT known OR NOT quoted THEN 0.0e0 ELSE greatest(0.0e0, least(1.0e0, 0.6e0*overall_confidence+0.4e0*rule_confidence+least(0.1e0, 0.025e0*filled))) END AS final_confidence FROM v4),
valid AS (SELECT raw_id, CASE WHEN NOT known THEN 'ticker_not_in_universe' WHEN NOT quoted THEN 'ticker_evidence_not_in_source' WHEN NOT directed THEN 'direction_evidence_not_in_source' ELSE '' END AS failures, CASE WHEN known AND quoted THEN n_warnings ELSE 0 END AS n_warnings, CASE WHEN known AND quoted THEN n_emptied ELSE 0 END AS n_emptied,
 CASE WHEN loose THEN 'unspecified' ELSE entry_type END AS entry_type, k_entry AS entry_price, k_target AS target_price, k_stop AS stop_price, rule_confidence, final_confidence, CASE WHEN NOT known OR NOT quoted OR NOT directed THEN 'rejected' WHEN final_confidence>=0.7e0 THEN 'accepted' WHEN final_confidence>=0.5e0 THEN 'pending_review' ELSE 'rejected' END AS status FROM v5)"""
RAW_CLAIMS = f"""w0 AS (SELECT *, CASE WHEN NOT {_said('evidence_quote')} THEN 'claim_evidence_not_in_source' WHEN ticker IS NOT NULL AND ticker NOT IN ({', '.join(f"'{u}'" for u in UNIVERSE)}) THEN 'claim_ticker_not_in_universe' ELSE '' END AS failures, claim_class='factual' AND regexp_matches(evidence_quote, '(?i)\\bmay(be)?\\b') AS milder FROM raw_claims),
w1 AS (SELECT *, CASE WHEN failures<>'' THEN 0.0e0 WHEN milder THEN 0.8e0 ELSE 1.0e0 END AS rule_confidence FROM w0),
w2 AS (SELECT *, CASE WHEN failures<>'' THEN 0.0e0 ELSE (overall_confidence+rule_confidence)/2 END AS final_confidence FROM w1),
vclaims AS (SELECT raw_id, failures, CASE WHEN failures='' AND milder THEN 'opinion' ELSE claim_class END AS claim_class, rule_confidence, final_confidence, CASE WHEN failures<>'' THEN 'rejected' WHEN final_confidence>=0.5e0 THEN 'accepted' ELSE 'pending_review' END AS status FROM w2)"""


def _universe(t):
    return t.spark.createDataFrame([(u,) for u in UNIVERSE], "ticker string")


@query("c17_validate_calls", f"SELECT raw_id, failures, n_warnings, n_emptied, entry_type, {r6('entry_price','target_price','stop_price','rule_confidence','final_confidence')}, status FROM valid", ("raw_calls",), RAW)
def _(t):
    out = E.validate_calls(t.raw_calls, _universe(t))
    return out.select("raw_id", F.array_join("failures", ",").alias("failures"), F.size("warnings").alias("n_warnings"), F.size("emptied").alias("n_emptied"), "entry_type", "entry_price", "target_price", "stop_price", "rule_confidence", "final_confidence", "status")


@query("c17_validate_claims", f"SELECT raw_id, failures, claim_class, {r6('rule_confidence','final_confidence')}, status FROM vclaims", ("raw_claims",), RAW_CLAIMS)
def _(t):
    return E.validate_claims(t.raw_claims, _universe(t)).select("raw_id", F.array_join("failures", ",").alias("failures"), "claim_class", "rule_confidence", "final_confidence", "status")


# T34 first: parts that contradict each other
_MALFORMED = " || ".join(f"CASE WHEN ({p}_price IS NULL)<>({p}_evidence IS NULL) THEN ',malformed_{p}_evidence' ELSE '' END" for p in _NAMES) + " || CASE WHEN entry_type IN ('limit','trigger_above','trigger_below') AND entry_price IS NULL THEN ',malformed_entry_price' ELSE '' END"


@query("c17_extract_calls", f"SELECT raw_id, CASE WHEN bad<>'' THEN substr(bad,2) ELSE failures END AS failures, CASE WHEN bad<>'' THEN 0.0e0 ELSE round(v.final_confidence,6)+0.0e0 END AS final_confidence, CASE WHEN bad<>'' THEN 'rejected' ELSE v.status END AS status FROM (SELECT raw_id, {_MALFORMED} AS bad FROM raw_calls) b JOIN valid v USING (raw_id)", ("raw_calls",), RAW)
def _(t):
    return E.extract_calls(t.raw_calls, _universe(t)).select("raw_id", F.array_join("failures", ",").alias("failures"), "final_confidence", "status")


@query("c17_extract_claims", f"SELECT raw_id, CASE WHEN bad<>'' THEN bad ELSE failures END AS failures, CASE WHEN bad<>'' THEN 0.0e0 ELSE round(v.final_confidence,6)+0.0e0 END AS final_confidence, CASE WHEN bad<>'' THEN 'rejected' ELSE v.status END AS status FROM (SELECT raw_id, CASE WHEN raw_id%3=0 AND ticker IS NULL THEN 'malformed_ticker' WHEN raw_id%3=1 AND ticker IS NULL AND raw_id%7<>0 THEN 'malformed_ticker_or_sector' ELSE '' END AS bad FROM raw_claims) b JOIN vclaims v USING (raw_id)", ("raw_claims",), RAW_CLAIMS)
def _(t):
    n = F.col("raw_id")
    raw = t.raw_claims.withColumns({"claim_type": F.when(n % 3 == 0, "earnings_view").when(n % 3 == 1, "catalyst").otherwise("macro_view"), "sector": F.when(n % 7 == 0, "Energy")})
    return E.extract_claims(raw, _universe(t)).select("raw_id", F.array_join("failures", ",").alias("failures"), "final_confidence", "status")


@query("c17_validate_extractions", "SELECT (SELECT count(*) FROM valid WHERE status<>'rejected') AS calls_extracted, (SELECT count(*) FROM valid WHERE status='rejected') AS calls_rejected, count(*) FILTER (WHERE status<>'rejected') AS claims_extracted, count(*) FILTER (WHERE status='rejected') AS claims_rejected FROM vclaims", ("raw_calls", "raw_claims"), f"{RAW}, {RAW_CLAIMS}")
def _(t):
    return E.extraction_summary(E.validate_calls(t.raw_calls, _universe(t)), E.validate_claims(t.raw_claims, _universe(t)))


_BAND = "{{'low': {0}, 'high': {0}+0.25e0*atr_14}}"
EXITS = f"""{SETUP}, {LEVELS},
x0 AS (SELECT *, recent_high_63 AS bl, recent_high_63+0.5e0*atr_14 AS bh, greatest(base_low_60, recent_high_63-1.5e0*atr_14) AS binv, least(ema_21,sma_50) AS pl, CASE WHEN ema_21=sma_50 THEN sma_50+0.5e0*atr_14 ELSE greatest(ema_21,sma_50) END AS ph,
 greatest(CASE WHEN support<least(ema_21,sma_50) THEN support END, sma_50-atr_14, least(ema_21,sma_50)-1.5e0*atr_14) AS pinv FROM at0),
x1 AS (SELECT *, bh-bl BETWEEN 0.05e0*atr_14 AND 5*atr_14 AND bh>bl AS bok, ph-pl BETWEEN 0.05e0*atr_14 AND 5*atr_14 AND ph>pl AS pok, CASE WHEN resistance>close THEN resistance END AS near, base_low_60+(recent_high_63-base_low_60)*1.272e0 AS f1, base_low_60+(recent_high_63-base_low_60)*1.618e0 AS f2 FROM x0),
x2 AS (SELECT *, list_filter([near, CASE WHEN recent_high_63>close AND NOT coalesce(abs(recent_high_63-near)<atr_14,false) THEN recent_high_63 END, CASE WHEN recent_high_63>base_low_60 AND f1+0.25e0*atr_14>close THEN f1 END], lambda x: x IS NOT NULL) AS prim, least(CASE WHEN bok THEN bl END, CASE WHEN pok THEN pl END) AS floor FROM x1),
x3 AS (SELECT *, list_sort(list_concat(list_transform(prim, lambda p: p+0.25e0*atr_14+1.5e0*atr_14), CASE WHEN recent_high_63>base_low_60 AND f2+0.25e0*atr_14>close THEN [f2] ELSE [] END)) AS runs, list_filter([binv, pinv, support, base_low_60-0.5e0*atr_14], lambda x: x IS NOT NULL AND (floor IS NULL OR x<floor)) AS inv0 FROM x2),
exits AS (SELECT *, list_filter(inv0, lambda x, i: list_position(list_transform(inv0, lambda y: round_even(y,4)), round_even(x,4))=i) AS inv FROM x3)"""


def _levels(t):
    return Z.candidate_levels(_rows(t))


def _lows(column: str):
    return F.array_join(F.transform(column, lambda b: F.format_string("%.8f", b["low"])), ",")


_TEXT = "array_to_string(list_transform({}, lambda x: printf('%.8f', x)), ',')"


@query("t19_candidate_levels", f"SELECT ticker, ts, coalesce(bok,false) AS has_breakout, coalesce(pok,false) AS has_pullback, {_TEXT.format('prim')} AS primaries, {_TEXT.format('runs')} AS runners, {_TEXT.format('inv')} AS invalidations FROM exits", ("bars",), EXITS)
def _(t):
    out = _levels(t)
    stops = F.array_join(F.transform("invalidations", lambda x: F.format_string("%.8f", x)), ",")
    return out.select("ticker", "ts", F.col("breakout_entry").isNotNull().alias("has_breakout"), F.col("pullback_entry").isNotNull().alias("has_pullback"), _lows("primaries").alias("primaries"), _lows("runners").alias("runners"), stops.alias("invalidations"))


_K = "CAST(substr(ticker,2) AS int)"
PICKS = f"""{EXITS}, k0 AS (SELECT *, (coalesce(bok,false) OR coalesce(pok,false)) AND len(prim)>0 AND len(inv)>0 AS can, CASE WHEN NOT coalesce(bok,false) THEN 'pullback' WHEN NOT coalesce(pok,false) THEN 'breakout' WHEN {_K}%3=1 THEN 'pullback' ELSE 'breakout' END AS kind2, {_K} AS k FROM exits),
picks AS (SELECT *, CASE WHEN kind2='breakout' THEN bl ELSE pl END AS elow, greatest(0, least(k%4-1, len(prim)-1)) AS pi, CASE WHEN k%5<>0 AND len(runs)>0 THEN greatest(0, least(k%5-1, len(runs)-1)) END AS ri, greatest(0, least(k%3, len(inv)-1)) AS ii FROM k0 WHERE can)"""


@query("t21_resolve_picks", f"SELECT ticker, ts, kind2 AS entry_kind, CAST(pi AS int) AS primary_index, CAST(coalesce(ri,-1) AS int) AS runner_index, CAST(ii AS int) AS invalidation_index, {r6('entry_low','primary_low','runner_low','invalidation', digits=8)} FROM (SELECT *, elow AS entry_low, prim[pi+1] AS primary_low, runs[ri+1] AS runner_low, CASE WHEN inv[ii+1]<elow THEN inv[ii+1] ELSE elow-0.75e0*atr_14 END AS invalidation FROM picks) q", ("bars",), PICKS, 8)
def _(t):
    k = F.substring("ticker", 2, 2).cast("int")
    asked = _levels(t).withColumns({"entry_kind": F.when(k % 3 == 1, "pullback").when(k % 3 == 2, "nonsense").otherwise("breakout"), "primary_index": k % 4 - 1, "runner_index": F.when(k % 5 != 0, k % 5 - 1), "invalidation_index": k % 3})
    out = Z.resolve_picks(asked).where("entry is not null")
    return out.select("ticker", "ts", "entry_kind", "primary_index", F.coalesce("runner_index", F.lit(-1)).alias("runner_index"), "invalidation_index", F.col("entry.low").alias("entry_low"), F.col("primary.low").alias("primary_low"), F.col("runner.low").alias("runner_low"), "invalidation")


ASKED = """asked AS (SELECT concat('T', lpad(CAST(i AS varchar),2,'0')) AS ticker, TIMESTAMP '2000-12-01' + INTERVAL 10 DAY * CAST(i AS int) AS as_of, CASE i%4 WHEN 0 THEN 'strong_uptrend' WHEN 1 THEN 'downtrend' WHEN 2 THEN 'unclear' ELSE 'extended_momentum' END AS setup_type FROM range(25) r(i)),
sig AS (SELECT ticker, date_trunc('day', posted_at) AS window_end, CASE claim_id%2 WHEN 0 THEN '30d' ELSE '7d' END AS window_size, CASE claim_id%3 WHEN 0 THEN 'claims_all' ELSE 'trade_calls' END AS signal_type, avg(CASE polarity WHEN 'bullish' THEN 1.0e0 WHEN 'bearish' THEN -1.0e0 ELSE 0.0e0 END) AS net_polarity, avg(final_confidence) AS credibility_weighted FROM claims WHERE ticker IS NOT NULL AND ticker<>'T03' AND claim_id%11=0 GROUP BY 1,2,3,4)"""


@query("t22_transcript_context", f"""SELECT ticker, n_claims, n_calls, n_signals, n_creators, n_calibrated, has_data, small_sample, coalesce(days_since,-1) AS days_since, CASE WHEN days_since IS NULL THEN 'absent' WHEN days_since<=30 THEN 'fresh' WHEN days_since<=90 THEN 'stale' ELSE 'historical_only' END AS coverage, {r6('net_polarity_30d','weighted_polarity_30d')},
 CASE WHEN net_polarity_30d IS NULL OR n_claims+n_calls<3 THEN 'unknown' WHEN setup_type IN ('strong_uptrend','extended_momentum') THEN CASE WHEN net_polarity_30d>0.1e0 THEN 'confirms' WHEN net_polarity_30d< -0.1e0 THEN 'contradicts' ELSE 'irrelevant' END
 WHEN setup_type='downtrend' THEN CASE WHEN net_polarity_30d< -0.1e0 THEN 'confirms' WHEN net_polarity_30d>0.1e0 THEN 'contradicts' ELSE 'irrelevant' END ELSE 'irrelevant' END AS verdict
 FROM (SELECT a.ticker, a.setup_type, coalesce(n_claims,0) AS n_claims, coalesce(n_calls,0) AS n_calls, coalesce(n_signals,0) AS n_signals, coalesce(n_creators,0) AS n_creators, coalesce(n_calibrated,0) AS n_calibrated, coalesce(n_claims,0)+coalesce(n_calls,0)>0 OR coalesce(n_signals,0)>0 AS has_data, coalesce(n_claims,0)+coalesce(n_calls,0)<5 AS small_sample,
  CAST(floor((epoch(a.as_of)-epoch(last_at))/86400) AS bigint) AS days_since, coalesce(np, recent) AS net_polarity_30d, cw AS weighted_polarity_30d
  FROM asked a LEFT JOIN (SELECT s.ticker, count(*) FILTER (WHERE claim) AS n_claims, count(*) FILTER (WHERE NOT claim) AS n_calls, max(posted_at) AS last_at, count(DISTINCT s.creator_id) AS n_creators, count(DISTINCT s.creator_id) FILTER (WHERE s.creator_id IN (SELECT creator_id FROM scorecards WHERE hit_rate_lower_ci IS NOT NULL)) AS n_calibrated, avg(p) FILTER (WHERE posted_at>=x.as_of-INTERVAL 30 DAY) AS recent
   FROM (SELECT ticker, creator_id, posted_at, true AS claim, CASE polarity WHEN 'bullish' THEN 1.0e0 WHEN 'bearish' THEN -1.0e0 ELSE 0.0e0 END AS p FROM claims WHERE status='accepted' UNION ALL SELECT ticker, creator_id, posted_at, false, NULL FROM calls WHERE status='accepted') s JOIN asked x ON x.ticker=s.ticker AND s.posted_at<=x.as_of GROUP BY 1) m ON m.ticker=a.ticker
  LEFT JOIN (SELECT s.ticker, count(*) AS n_signals, arg_max(net_polarity, window_end) FILTER (WHERE window_size='30d' AND signal_type='claims_all') AS np, arg_max(credibility_weighted, window_end) FILTER (WHERE window_size='30d' AND signal_type='claims_all') AS cw FROM sig s JOIN asked x ON x.ticker=s.ticker AND s.window_end<=x.as_of GROUP BY 1) g ON g.ticker=a.ticker) q""", ("claims", "calls", "scorecards"), ASKED)
def _(t):
    i = F.col("id")
    kind = F.when(i % 4 == 0, "strong_uptrend").when(i % 4 == 1, "downtrend").when(i % 4 == 2, "unclear").otherwise("extended_momentum")
    asked = t.spark.range(25).select(F.concat(F.lit("T"), F.lpad(i.cast("string"), 2, "0")).alias("ticker"), (F.lit("2000-12-01").cast("timestamp") + F.make_dt_interval((i * 10).cast("int"))).alias("as_of"), kind.alias("setup_type"))
    some = t.claims.where("ticker is not null and ticker <> 'T03' and claim_id % 11 = 0")
    keys = [F.date_trunc("day", "posted_at").alias("window_end"), F.when(F.col("claim_id") % 2 == 0, "30d").otherwise("7d").alias("window_size"), F.when(F.col("claim_id") % 3 == 0, "claims_all").otherwise("trade_calls").alias("signal_type")]
    signals = some.groupBy("ticker", *keys).agg(F.avg(G.polarity_value(F.col("polarity"))).alias("net_polarity"), F.avg("final_confidence").alias("credibility_weighted"))
    out = G.transcript_context(asked, signals, t.claims, t.calls, t.scorecards)
    return out.select("ticker", "n_claims", "n_calls", "n_signals", "n_creators", "n_calibrated", "has_data", "small_sample", F.coalesce("days_since", F.lit(-1)).alias("days_since"), "coverage", "net_polarity_30d", "weighted_polarity_30d", "verdict")
