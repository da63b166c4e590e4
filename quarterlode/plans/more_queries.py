"""Queries of breakdowns with residuals and of fallback statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import facts as A
from quarterlode.operators import reconcile as R
from quarterlode.plans.registry import query

PARTS = """parts_ AS (SELECT company_id, CAST(year(start_date) * 4 + quarter(start_date) - 1 AS INT) AS q_index, CAST(sum(CASE WHEN l_returnflag = 'A' THEN cost ELSE 0 END) AS DECIMAL(20,2)) AS a, CAST(sum(CASE WHEN l_returnflag = 'N' THEN cost ELSE 0 END) AS DECIMAL(20,2)) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN cost ELSE 0 END) AS DECIMAL(20,2)) AS r,
  CAST(sum(cost) AS DECIMAL(20,2)) AS total FROM lines GROUP BY 1, 2),
  long_ AS (SELECT company_id, q_index, total, unnest(['products', 'services', 'tac']) AS category, unnest([a, n, r]) AS value FROM parts_),
  rows_ AS (SELECT *, count(*) OVER (PARTITION BY company_id, q_index) AS k FROM (SELECT * FROM long_ WHERE value > 0 UNION ALL SELECT company_id, q_index, any_value(total), 'other_cost', any_value(total) - sum(value) FROM long_ WHERE value > 0 GROUP BY 1, 2 HAVING any_value(total) > 0 AND any_value(total) - sum(value) > greatest(100, any_value(total) * 0.01)))"""


@query("f12_cost_breakdown", "SELECT company_id, q_index, category, value FROM rows_ WHERE NOT (k = 1 AND abs(value - total) <= greatest(100, total * 0.01))", PARTS, money="value")
def f12(t):
    at = lambda flag: F.sum(F.when(flag, F.col("cost")).otherwise(0)).cast("decimal(20,2)")
    q = (F.year("start_date") * 4 + F.quarter("start_date") - 1).cast("int").alias("q_index")
    wide = t.lines.groupBy("company_id", q).agg(at(F.col("l_returnflag") == "A").alias("a"), at(F.col("l_returnflag") == "N").alias("n"), at((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("r"), F.sum("cost").cast("decimal(20,2)").alias("total"))
    return A.breakdown_with_residual(wide, {"a": "products", "n": "services", "r": "tac"}, "total", "other_cost", least=100, same=100)


FALL = """whole AS (SELECT s.company_id, s.q_index, s.revenue, s.cost_of_revenue, s.gross_profit, s.sgna, s.rnd, CAST(NULL AS DECIMAL(20,2)) AS other_opex, s.operating_expenses, s.operating_income, CAST(pretax_income - operating_income AS DECIMAL(20,2)) AS non_operating, s.pretax_income, s.tax, s.net_income FROM statements s),
  fall AS (SELECT company_id, q_index, revenue, CAST(revenue * 0.6 AS DECIMAL(20,2)) AS cost_of_revenue, CAST(coalesce(gross_profit, revenue * 0.4) AS DECIMAL(20,2)) AS gross_profit, sgna, CAST(rnd + 1 AS DECIMAL(20,2)) AS rnd, other_opex,
    CAST(greatest(coalesce(gross_profit, revenue * 0.4) - revenue * 0.05, 0) AS DECIMAL(20,2)) AS operating_expenses, CAST(revenue * 0.05 AS DECIMAL(20,2)) AS operating_income, CAST(non_operating + 100 AS DECIMAL(20,2)) AS non_operating, CAST(pretax_income + CASE WHEN q_index % 4 = 0 THEN 5000 ELSE 1 END AS DECIMAL(20,2)) AS pretax_income, tax, net_income FROM whole WHERE company_id % 5 <> 0),
  first_ AS (SELECT company_id, q_index, revenue, CASE WHEN q_index % 3 = 0 THEN NULL ELSE cost_of_revenue END AS cost_of_revenue, CASE WHEN q_index % 3 = 0 THEN NULL ELSE gross_profit END AS gross_profit, sgna, CASE WHEN q_index % 2 = 0 THEN rnd END AS rnd, other_opex,
    CAST(CASE WHEN q_index % 7 = 0 THEN revenue * 2 ELSE operating_expenses END AS DECIMAL(20,2)) AS operating_expenses, operating_income, non_operating, pretax_income, tax, net_income, CAST(CASE WHEN q_index % 5 = 0 THEN revenue * 1.5 ELSE 0 END AS DECIMAL(20,2)) AS segments FROM whole WHERE q_index % 11 <> 0)"""


def two(t):
    return t.sql("SELECT * FROM first_", FALL), t.sql("SELECT * FROM fall", FALL)


_SAME = " AND ".join(f"coalesce(abs(p.{n} - f.{n}) <= greatest({a}, greatest(abs(p.{n}), abs(f.{n})) * {b}), true)" for n, a, b in R.ALIGNED)
_OFF = " OR ".join(f"coalesce(abs(p.{n} - f.{n}) > greatest(1.2, abs(f.{n}) * {a} + {b}), false)" for n, a, b in R.OPERATING)
_MISMATCH = f"({_SAME} AND ({_OFF}) AND coalesce(abs(f.operating_expenses - greatest(f.gross_profit - f.operating_income, 0)) <= greatest(0.35, f.gross_profit * 0.03), false))"
_BROKEN = "(p.cost_of_revenue IS NULL AND p.gross_profit IS NULL AND f.revenue IS NOT NULL AND f.cost_of_revenue IS NOT NULL AND f.gross_profit IS NOT NULL AND (coalesce(p.operating_expenses > p.revenue + 0.25, false) OR coalesce(p.segments > p.revenue + greatest(0.25, p.revenue * 0.08), false)))"
_THERE = "p.company_id IS NOT NULL AND f.company_id IS NOT NULL"
_LINES = ", ".join(f"CASE WHEN {_THERE} AND ({_BROKEN}{' OR ' + _MISMATCH if n in R.STAGE else ''}) THEN coalesce(f.{n}, p.{n}) ELSE coalesce(p.{n}, f.{n}) END AS {n}" for n in R.BRIDGE)


@query("r12_merge_fallback", f"SELECT company_id, q_index, {_LINES}, CASE WHEN {_THERE} AND {_BROKEN} THEN 'financial-fallback' WHEN {_THERE} AND {_MISMATCH} THEN 'operating-stage-fallback' ELSE '' END AS fallback FROM first_ p FULL JOIN fall f USING (company_id, q_index)", FALL, money=" ".join(R.BRIDGE))
def r12(t):
    return R.merge_fallback(*two(t))


_RATED = FALL + """, first_r AS (SELECT *, q_index % 7 AS revenue_yoy_pct, CASE WHEN q_index % 2 = 0 THEN company_id % 5 END AS operating_margin_pct, q_index % 4 AS effective_tax_rate_pct FROM first_), fall_r AS (SELECT *, 100 + q_index % 7 AS revenue_yoy_pct, 200 + company_id % 5 AS operating_margin_pct, CASE WHEN q_index % 3 = 1 THEN 300 END AS effective_tax_rate_pct FROM fall)"""
_RATES = {"revenue_yoy_pct": False, "operating_margin_pct": True, "effective_tax_rate_pct": True}
_RATE_LINES = ", ".join(f"CASE WHEN {_THERE} AND ({_BROKEN}{' OR ' + _MISMATCH if stage else ''}) THEN coalesce(f.{n}, p.{n}) ELSE coalesce(p.{n}, f.{n}) END AS {n}" for n, stage in _RATES.items())


@query("r12_merge_fallback_rates", f"SELECT company_id, q_index, {_RATE_LINES} FROM first_r p FULL JOIN fall_r f USING (company_id, q_index)", _RATED)
def r12_rates(t):
    p, f = two(t)
    q, c = F.col("q_index"), F.col("company_id")
    p = p.withColumns({"revenue_yoy_pct": q % 7, "operating_margin_pct": F.when(q % 2 == 0, c % 5), "effective_tax_rate_pct": q % 4})
    f = f.withColumns({"revenue_yoy_pct": 100 + q % 7, "operating_margin_pct": 200 + c % 5, "effective_tax_rate_pct": F.when(q % 3 == 1, 300)})
    return R.merge_fallback(p, f).select("company_id", "q_index", *_RATES)


@query("r13_stage_mismatch", f"SELECT p.company_id, p.q_index, {_MISMATCH} AS mismatch FROM first_ p JOIN fall f USING (company_id, q_index)", FALL)
def r13(t):
    return R.stage_mismatch(*two(t))
