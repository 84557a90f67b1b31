"""Domain tables derived from the shipped star schema, by one SQL text that Spark and DuckDB both run.

{table} stands for a table in that text. Only this module knows the shipped schema.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TEXT = {
    "bars": """
SELECT ticker, CAST(d AS timestamp) AS ts,
  round(c*(1+0.004e0*((h%11)-5)/5.0e0),4) AS open,
  round(greatest(c, c*(1+0.004e0*((h%11)-5)/5.0e0))*(1+0.001e0*(1+h%7)),4) AS high,
  round(least(c, c*(1+0.004e0*((h%11)-5)/5.0e0))*(1-0.001e0*(1+h%5)),4) AS low,
  round(c,4) AS close, vol AS volume
FROM (SELECT ticker, d, h, vol,
        (100+10*k)*(1+0.0003e0*dn)*(1+0.12e0*sin(dn/45.0e0+k))*(1+0.01e0*((h%101)-50)/50.0e0) AS c
      FROM (SELECT concat('T', lpad(CAST(l_suppkey%20 AS string),2,'0')) AS ticker, CAST(l_suppkey%20 AS int) AS k,
              CAST(l_shipdate AS date) AS d,
              (year(CAST(l_shipdate AS date))-1995)*372+(month(CAST(l_shipdate AS date))-1)*31+day(CAST(l_shipdate AS date)) AS dn,
              CAST(sum(l_partkey*7+l_orderkey)%1009 AS int) AS h, CAST(sum(l_quantity)*10000 AS bigint) AS vol
            FROM {lineitem} GROUP BY 1,2,3,4) x) y""",
    "sessions": """
SELECT CAST(d AS timestamp) AS session_date, CAST(d AS timestamp)+interval '14' hour+interval '30' minute AS market_open,
 CAST(d AS timestamp)+interval '21' hour AS market_close FROM (SELECT DISTINCT CAST(l_shipdate AS date) AS d FROM {lineitem}) s""",
    "calls": """
SELECT o_orderkey AS call_id, o_orderkey AS document_id, o_custkey%25 AS creator_id,
 concat('T', lpad(CAST(o_custkey%20 AS string),2,'0')) AS ticker,
 CAST(o_orderdate AS timestamp) + interval '1' hour * CAST(o_orderkey%24 AS int) AS posted_at,
 CASE o_orderstatus WHEN 'O' THEN 'long' WHEN 'F' THEN 'short' ELSE 'unspecified' END AS direction,
 CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'market' WHEN '2' THEN 'limit' WHEN '3' THEN 'trigger_above' WHEN '4' THEN 'trigger_below' ELSE 'unspecified' END AS entry_type,
 b.close*(0.97e0+0.01e0*(o_orderkey%7)) AS entry_price,
 CASE WHEN o_orderkey%3=0 THEN b.close*1.05e0 END AS target_price,
 CASE WHEN o_orderkey%4=0 THEN b.close*0.96e0 END AS stop_price,
 0.3e0+0.01e0*(o_orderkey%70) AS final_confidence,
 CASE WHEN o_orderkey%10<8 THEN 'accepted' ELSE 'pending_review' END AS status
FROM {orders} o LEFT JOIN {bars} b ON b.ticker=concat('T', lpad(CAST(o_custkey%20 AS string),2,'0')) AND b.ts=CAST(CAST(o_orderdate AS date) AS timestamp)""",
    "claims": """
SELECT event_id AS claim_id, event_id AS document_id, user_id%25 AS creator_id,
 CASE WHEN event_id%17=0 THEN NULL ELSE concat('T', lpad(CAST((user_id+event_id)%20 AS string),2,'0')) END AS ticker,
 CASE event_type WHEN 'purchase' THEN 'bullish' WHEN 'click' THEN 'bullish' WHEN 'error' THEN 'bearish' WHEN 'view' THEN 'neutral' ELSE 'mixed' END AS polarity,
 CASE event_id%4 WHEN 0 THEN 'factual' WHEN 1 THEN 'opinion' WHEN 2 THEN 'speculation' ELSE 'hype' END AS claim_class,
 CASE event_id%3 WHEN 0 THEN 'catalyst' WHEN 1 THEN 'risk' ELSE 'earnings_view' END AS claim_type,
 CAST(ts AS timestamp) - interval '8401' day AS posted_at, least(value/100.0e0,1.0e0) AS final_confidence,
 CASE WHEN event_id%9=0 THEN 'pending_review' ELSE 'accepted' END AS status FROM {events}""",
    "trades": """
SELECT o_orderkey AS id, concat('T', lpad(CAST(o_custkey%20 AS string),2,'0')) AS ticker,
 CASE WHEN rn%4=0 THEN 'sell' ELSE 'buy' END AS side,
 CAST(CASE WHEN rn%4=0 THEN 1+o_orderkey%5 ELSE 10+o_orderkey%20 END AS double) AS quantity,
 o_totalprice/1000.0e0 AS price_per_share, 'USD' AS currency, CAST(o_orderkey%3 AS double) AS fees, CAST(o_orderdate AS timestamp) AS traded_at,
 CASE WHEN o_custkey%4=3 AND o_orderkey%7=0 THEN NULL ELSE 0.9e0*(CASE WHEN rn%4=0 THEN 1+o_orderkey%5 ELSE 10+o_orderkey%20 END)*o_totalprice/1000.0e0 END AS eur_amount
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey%20 ORDER BY o_orderdate,o_orderkey) AS rn FROM {orders}) t""",
    # who posted: one channel per creator
    "creators": """
SELECT c.creator_id, concat(n.n_name, ' ', CAST(c.creator_id AS string)) AS display_name, c.creator_id%7<>0 AS active
FROM (SELECT DISTINCT c_custkey%25 AS creator_id FROM {customer}) c JOIN {nation} n ON n.n_nationkey=c.creator_id""",
    # published scorecards, several per creator over time
    "scorecards": """
SELECT o_orderkey AS scorecard_id, o_custkey%25 AS creator_id, CAST(o_orderdate AS timestamp) AS computed_at,
 CASE o_orderkey%3 WHEN 0 THEN 'all' WHEN 1 THEN '365d' ELSE '90d' END AS window_label,
 CASE o_orderkey%4 WHEN 0 THEN '1d' WHEN 1 THEN '3d' WHEN 2 THEN '5d' ELSE '21d' END AS horizon,
 CASE WHEN o_orderkey%5=0 THEN NULL ELSE 0.4e0+0.003e0*(o_orderkey%100) END AS hit_rate_lower_ci
FROM {orders} WHERE o_orderkey%6=0""",
    # outcomes of research lenses
    "lens_results": """
SELECT event_id AS snapshot_id, concat('T', lpad(CAST(event_id%20 AS string),2,'0')) AS ticker,
 CAST(ts AS timestamp) - interval '8401' day AS as_of, CASE event_id%4 WHEN 0 THEN 'technical' WHEN 1 THEN 'fundamental' WHEN 2 THEN 'sentiment' ELSE 'macro' END AS lens_name,
 CASE user_id%3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS direction,
 CASE user_id%5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS conviction,
 '5d' AS horizon, round((value-50)/1000.0e0,6) AS return_pct,
 CASE WHEN event_id%11=0 THEN NULL ELSE round((value-48)/1000.0e0,6) END AS excess_vs_spy_pct,
 CASE user_id%3 WHEN 0 THEN value>55 WHEN 1 THEN value<45 ELSE value BETWEEN 45 AND 55 END AS direction_correct,
 CASE event_id%7 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'flat' END AS regime FROM {events}""",
    # screening metrics of a universe of companies
    "metrics": """
SELECT concat('P', CAST(p_partkey AS string)) AS ticker, p_name AS name, p_brand AS sector,
 CASE WHEN p_partkey%13=0 THEN NULL ELSE 5.0e0+p_size END AS forward_pe,
 CASE WHEN p_partkey%11=0 THEN NULL ELSE (p_partkey%40)/10.0e0-0.5e0 END AS peg_ratio,
 CASE WHEN p_partkey%7=0 THEN NULL ELSE (p_partkey%45)*1.0e0-3 END AS ev_to_ebitda,
 CASE WHEN p_partkey%17=0 THEN NULL ELSE (p_partkey%50)/100.0e0-0.1e0 END AS revenue_growth,
 CASE WHEN p_partkey%19=0 THEN NULL ELSE (p_partkey%60)/100.0e0-0.2e0 END AS earnings_growth,
 CASE WHEN p_partkey%17=0 OR p_partkey%43=0 THEN NULL ELSE (p_partkey%50)/100.0e0-0.1e0+(p_partkey%5-2)/100.0e0 END AS revenue_growth_qoq,
 CASE WHEN p_partkey%23=0 THEN NULL ELSE (p_partkey%80)/100.0e0 END AS gross_margin,
 CASE WHEN p_partkey%29=0 THEN NULL ELSE (p_partkey%35)/100.0e0 END AS return_on_equity,
 CASE WHEN p_partkey%31=0 THEN NULL ELSE (p_partkey%25)/10.0e0 END AS debt_to_equity,
 CASE WHEN p_partkey%37=0 THEN NULL ELSE (p_partkey%70)/100.0e0-0.2e0 END AS price_vs_sma_200,
 CASE WHEN p_partkey%41=0 THEN NULL ELSE (p_partkey%30)/100.0e0-0.1e0 END AS rs_vs_benchmark,
 CASE WHEN p_partkey%5=0 THEN NULL ELSE CAST(p_partkey%120 AS int)-3 END AS days_to_earnings
FROM {part}""",
    # up to six peers of each company; a company stands among its own
    "peers": """
SELECT concat('P', CAST(p_partkey AS string)) AS target, concat('P', CAST(p_partkey+7*j AS string)) AS peer FROM {part} CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6)) AS v(j)""",
    "ratios": """
SELECT concat('P', CAST(p_partkey AS string)) AS ticker, CASE WHEN p_partkey%13=0 THEN NULL WHEN p_partkey%47=0 THEN 9999.0e0 WHEN p_partkey%53=0 THEN 500.0e0 ELSE 5.0e0+p_size END AS forward_pe,
 CASE WHEN p_partkey%6=0 THEN NULL ELSE 3.0e0+p_size END AS trailing_pe, CASE WHEN p_partkey%11=0 THEN NULL ELSE (p_partkey%130)/1.0e0-60 END AS peg, (p_partkey%260)/1.0e0 AS price_to_sales,
 CASE WHEN p_partkey%17=0 THEN NULL ELSE (p_partkey%50)/100.0e0-0.1e0 END AS revenue_growth, CASE WHEN p_partkey%9=0 THEN NULL ELSE (p_partkey%80)/100.0e0-0.2e0 END AS profit_margins,
 CASE WHEN p_partkey%8=0 THEN 7.0e0 ELSE (p_partkey%60)/100.0e0 END AS operating_margins, CASE WHEN p_partkey%10=0 THEN NULL ELSE p_retailprice*1000000 END AS market_cap
FROM {part} WHERE p_partkey%19<>0""",
    # lines of yearly statements, in millions; some lines, years and values are missing
    "statements": """
SELECT concat('P', CAST(p_partkey AS string)) AS ticker, l.statement, l.label, CAST(concat(CAST(2025-y.back AS string), '-12-31') AS date) AS fiscal_end,
 CASE WHEN (p_partkey+3*l.no+y.back)%13=0 THEN NULL WHEN (p_partkey+l.no+y.back)%41=0 THEN CAST('NaN' AS double) WHEN (p_partkey+l.no)%37=0 THEN 0.0e0
  ELSE l.base*1000000.0e0*(1+0.01e0*((p_partkey*(l.no+3)+7*y.back)%47)-0.06e0*y.back*(p_partkey%3)) END AS value
FROM {part} CROSS JOIN (VALUES (0,'financials','Total Revenue',100), (1,'financials','Operating Revenue',90), (2,'financials','Operating Income',20), (3,'financials','Operating Income As Reported',19), (4,'financials','Net Income',10),
 (5,'financials','Net Income Common Stockholders',9), (6,'cashflow','Free Cash Flow',8), (7,'cashflow','Capital Expenditure',-14), (8,'cashflow','Repurchase Of Capital Stock',-15), (9,'cashflow','Net Common Stock Issuance',4),
 (10,'balance_sheet','Current Assets',50), (11,'balance_sheet','Current Liabilities',40), (12,'balance_sheet','Total Debt',40), (13,'balance_sheet','Net Debt',25), (14,'balance_sheet','Stockholders Equity',45), (15,'balance_sheet','Common Stock Equity',44),
 (16,'balance_sheet','Cash And Cash Equivalents',15), (17,'balance_sheet','Ordinary Shares Number',9), (18,'balance_sheet','Goodwill',1)) AS l(no, statement, label, base) CROSS JOIN (VALUES (0),(1),(2),(3)) AS y(back)
WHERE (p_partkey+l.no)%5<>0 AND p_partkey%(7+y.back)<>0 AND NOT (p_partkey%9=0 AND l.no<6)""",
    # where posts come from: three channels per creator, some posts without a time
    "channels": "SELECT DISTINCT c_custkey%75 AS channel_id, c_custkey%25 AS creator_id FROM {customer}",
    "call_documents": """
SELECT o_orderkey AS document_id, o_custkey%75 AS channel_id, concat('Post ', CAST(o_orderkey AS string)) AS title,
 CASE WHEN o_orderkey%12=0 THEN NULL ELSE CAST(o_orderdate AS timestamp) + interval '1' hour * CAST(o_orderkey%24 AS int) END AS posted_at FROM {orders}""",
    "claim_documents": """
SELECT event_id AS document_id, user_id%75 AS channel_id, concat('Talk ', CAST(event_id AS string)) AS title, CAST(ts AS timestamp) - interval '8401' day AS posted_at FROM {events}""",
    # what a model took from passages: some of it unfounded
    "raw_calls": """
SELECT document_id*1000+segment_id AS raw_id, text AS source, CASE WHEN segment_id%7=6 THEN 'ZZ' ELSE concat('T0', CAST(document_id%9 AS string)) END AS ticker,
 CASE WHEN segment_id%5=4 THEN 'never said' ELSE concat('buy   $t0', CAST(document_id%9 AS string)) END AS ticker_evidence, CASE WHEN document_id%6=5 THEN NULL ELSE 'Above' END AS direction_evidence,
 CASE document_id%4 WHEN 0 THEN 'limit' WHEN 1 THEN 'market' WHEN 2 THEN 'trigger_above' ELSE 'unspecified' END AS entry_type, 100.0e0+segment_id AS entry_price, CASE WHEN document_id%3=0 THEN 'elsewhere' ELSE concat('above ', CAST(100+segment_id AS string), ' now') END AS entry_evidence,
 CASE WHEN document_id%5=0 THEN NULL ELSE 300.0e0 END AS target_price, 'now.' AS target_evidence, CASE WHEN document_id%2=0 THEN 95.0e0 END AS stop_price, CASE WHEN document_id%8=0 THEN '' ELSE 'now' END AS stop_evidence,
 CASE WHEN document_id%4<2 THEN 'swing' ELSE 'unspecified' END AS timeframe, 0.3e0+0.1e0*(document_id%7) AS overall_confidence, CASE document_id%3 WHEN 0 THEN NULL WHEN 1 THEN 110.0e0 ELSE 250.0e0 END AS market_price
FROM {segments} WHERE (document_id+segment_id)%4=0""",
    "raw_claims": """
SELECT document_id*1000+segment_id AS raw_id, text AS source, CASE document_id%5 WHEN 0 THEN NULL WHEN 1 THEN 'ZZ' ELSE 'T10' END AS ticker, CASE WHEN segment_id%6=5 THEN 'not there' WHEN segment_id%2=0 THEN 'may  BREAK out' ELSE 'target' END AS evidence_quote,
 CASE WHEN document_id%3=0 THEN 'opinion' ELSE 'factual' END AS claim_class, 0.05e0+0.1e0*(document_id%9) AS overall_confidence FROM {segments} WHERE (document_id+segment_id)%4=1""",
    # transcripts: one document per conversation
    "segments": """
SELECT conv_id AS document_id, turn AS segment_id, 4.0e0*turn+CASE WHEN turn%5=4 THEN 2.5e0 ELSE 0.0e0 END AS start_seconds, 4.0e0*turn+3.0e0 AS end_seconds,
 CASE WHEN (conv_id+turn)%4=0 THEN concat('Buy $T0', CAST(conv_id%9 AS string), ' above ', CAST(100+turn AS string), ' now. ', coalesce(text,''))
      WHEN (conv_id+turn)%4=1 THEN concat('Tickers T1', CAST(turn%9 AS string), ' may break out, target ', CAST(90+conv_id%50 AS string), '. ', coalesce(text,'')) ELSE text END AS text
FROM {conversations}""",
}
_SHIPPED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", TEXT[name])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shipped or derived table."""
    if name in _SHIPPED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(TEXT[name], **{n: table(spark, sf_dir, n) for n in needs(name)})


def ctes(*names: str) -> str:
    """WITH clause that defines derived tables for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in needs(name):
            if n not in _SHIPPED:
                visit(n)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({TEXT[n].format(**{x: x for x in needs(n)})})" for n in order)


BENCHMARK = "T00"
