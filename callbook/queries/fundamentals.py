"""Statement trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from callbook.plans import fundamentals as U
from callbook.queries.base import query, r6

_LABELS = ", ".join(f"('{s}','{m}','{label}',{i})" for (s, m), labels in U.LABELS.items() for i, label in enumerate(labels))
_YEAR = "max(v) FILTER (WHERE measure='{0}' AND i=i0 AND k={1}) AS {0}_{1}"
_NEWEST = "arg_min(v, k) FILTER (WHERE measure='{0}' AND i=i1 AND v IS NOT NULL) AS {0}"
FACTS = f"""fs AS (SELECT *, CASE WHEN isfinite(value) THEN value END AS v, dense_rank() OVER (PARTITION BY ticker, statement ORDER BY fiscal_end DESC) AS k FROM statements),
lines AS (SELECT *, min(i) OVER (PARTITION BY ticker, measure) AS i0, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY ticker, measure) AS i1 FROM fs JOIN (VALUES {_LABELS}) l(statement, measure, label, i) USING (statement, label)),
facts AS (SELECT ticker, {", ".join(_YEAR.format(m, n) for m in ("revenue", "operating_income", "net_income", "shares") for n in (1, 2, 3))}, {", ".join(_NEWEST.format(m) for m in ("fcf", "capex", "buyback", "current_assets", "current_liabilities", "debt", "equity", "cash"))} FROM lines GROUP BY 1),
ends AS (SELECT ticker, statement, string_agg(DISTINCT CAST(fiscal_end AS varchar), ',' ORDER BY CAST(fiscal_end AS varchar)) AS e FROM statements GROUP BY 1, 2),
known AS (SELECT ticker, max(e) FILTER (WHERE statement='financials') AS e1, max(e) FILTER (WHERE statement='cashflow') AS e2, max(e) FILTER (WHERE statement='balance_sheet') AS e3 FROM ends GROUP BY 1),
traj AS (SELECT *, (revenue_1-revenue_2)/nullif(revenue_2,0) AS g1, (revenue_2-revenue_3)/nullif(revenue_3,0) AS g2, operating_income_1/nullif(revenue_1,0) AS m1, operating_income_2/nullif(revenue_2,0) AS m2, operating_income_3/nullif(revenue_3,0) AS m3,
 current_assets/nullif(current_liabilities,0) AS cr, debt/nullif(equity,0) AS de, CASE WHEN fcf<>0 AND market_cap<>0 THEN fcf/market_cap END AS fy, CASE WHEN capex<>0 AND revenue_1<>0 THEN abs(capex)/revenue_1 END AS cs,
 CASE WHEN shares_1<>0 AND shares_2<>0 THEN shares_1/shares_2-1 END AS sc, CASE WHEN market_cap<>0 THEN CASE WHEN buyback<0 THEN -buyback WHEN buyback IS NOT NULL THEN 0.0e0 END/market_cap END AS bb, CASE WHEN cash<>0 AND market_cap<>0 THEN cash/market_cap END AS cc
 FROM known LEFT JOIN facts USING (ticker) LEFT JOIN (SELECT ticker, market_cap FROM ratios) r USING (ticker))"""


def _r(expression: str, name: str) -> str:
    return f"round({expression},6)+0.0e0 AS {name}"


T26 = f"""SELECT ticker, coalesce(e1,e2,e3) AS fiscal_year_ends, concat_ws(',', CASE WHEN e1 IS NOT NULL THEN 'financials' END, CASE WHEN e2 IS NOT NULL THEN 'cashflow' END, CASE WHEN e3 IS NOT NULL THEN 'balance_sheet' END) AS sources,
 {", ".join(_r(f"{m}_{3 - i}", f"{m}_fy_minus_{2 - i}") for m in ("revenue", "net_income") for i in range(3))}, {_r("g1", "revenue_yoy_recent")}, {_r("g2", "revenue_yoy_prior")},
 CASE WHEN coalesce(revenue_1,revenue_2,revenue_3) IS NULL THEN NULL WHEN g1 IS NULL THEN 'unknown' ELSE CASE WHEN g1>0.05e0 THEN 'growing' WHEN g1> -0.02e0 THEN 'stable' ELSE 'declining' END || CASE WHEN g2 IS NULL THEN '' WHEN abs(g1-g2)<0.02e0 THEN ' (steady)' WHEN g1-g2>0 THEN ' (accelerating)' ELSE ' (decelerating)' END END AS revenue_quality,
 {", ".join(_r(f"m{3 - i}", f"operating_margin_fy_minus_{2 - i}") for i in range(3))},
 CASE WHEN CAST(m1 IS NOT NULL AS int)+CAST(m2 IS NOT NULL AS int)+CAST(m3 IS NOT NULL AS int)<2 THEN 'unknown' WHEN coalesce(m1,m2)>coalesce(m3,m2)+0.01e0 THEN 'expanding' WHEN coalesce(m1,m2)<coalesce(m3,m2)-0.01e0 THEN 'compressing' ELSE 'stable' END AS operating_margin_trajectory,
 {r6("fcf")}, {_r("fy", "fcf_yield")}, {_r("abs(capex)", "capex")}, {_r("cs", "capex_pct_revenue")}, {_r("cr", "current_ratio")}, {_r("de", "debt_to_equity")}, {_r("cash", "total_cash")}, {_r("debt", "total_debt")}, {_r("cc", "cash_to_market_cap")}, {_r("shares_1", "shares_now")}, {_r("sc", "shares_yoy")}, {_r("bb", "buyback_yield")},
 CASE WHEN cr IS NULL AND de IS NULL THEN 'unknown' ELSE CASE WHEN q>0.5e0 THEN 'strong' WHEN q< -0.5e0 THEN 'stressed' ELSE 'adequate' END END AS balance_sheet_strength,
 CASE WHEN bb>0.01e0 THEN 'returning cash (buybacks)' WHEN sc>0.03e0 THEN 'diluting' WHEN cs>0.15e0 THEN 'reinvesting (heavy capex)' ELSE 'balanced' END AS capital_allocation
FROM (SELECT *, list_avg(list_filter([CASE WHEN cr>1.5e0 THEN 1 WHEN cr>1.0e0 THEN 0 WHEN cr IS NOT NULL THEN -1 END, CASE WHEN de<0.5e0 THEN 1 WHEN de<1.5e0 THEN 0 WHEN de IS NOT NULL THEN -1 END], lambda x: x IS NOT NULL)) AS q FROM traj) z"""


@query("t26_fundamentals", T26, ("statements", "ratios"), FACTS)
def _(t):
    out = U.trajectories(t.statements, t.ratios.select("ticker", "market_cap"))
    return out.withColumns({"fiscal_year_ends": F.array_join("fiscal_year_ends", ","), "sources": F.array_join("sources", ",")})
