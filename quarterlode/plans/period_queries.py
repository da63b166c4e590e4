"""Queries of the period algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.functions import periods as P
from quarterlode.operators import quarters as Q
from quarterlode.plans.registry import query

NAME = "concat(y, 'Q', qn)"


@query("p1_calendar_quarter", "SELECT o_orderkey, concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS quarter FROM orders")
def p1(t):
    return t.orders.select("o_orderkey", P.calendar_quarter(F.col("o_orderdate")).alias("quarter"))


@query("p2_quarter_index", f"SELECT company_id, {NAME} AS quarter, q_index, 0 AS bad FROM quarters")
def p2(t):
    q = F.concat("y", F.lit("Q"), "qn")
    return t.quarters.select("company_id", q.alias("quarter"), P.q_index(q).alias("q_index"), P.q_sort_key(F.concat(q, F.lit("x"))).alias("bad"))


@query("p3_shift_quarter", f"SELECT company_id, {NAME} AS quarter, concat((q_index - 1) // 4, 'Q', (q_index - 1) % 4 + 1) AS previous, concat((q_index - 4) // 4, 'Q', (q_index - 4) % 4 + 1) AS year_before FROM quarters")
def p3(t):
    q = F.concat("y", F.lit("Q"), "qn")
    return t.quarters.select("company_id", q.alias("quarter"), P.q_shift(q, -1).alias("previous"), P.q_shift(q, -4).alias("year_before"))


@query("p4_quarter_window", f"SELECT company_id, {NAME} AS quarter, concat(i // 4, 'Q', i % 4 + 1) AS member FROM (SELECT *, unnest(range(q_index - 5, q_index + 1)) AS i FROM quarters)")
def p4(t):
    q = F.concat("y", F.lit("Q"), "qn")
    return t.quarters.select("company_id", q.alias("quarter"), F.explode(P.quarter_window(q, 6)).alias("member"))


@query("p5_quarter_end", f"SELECT company_id, {NAME} AS quarter, end_date FROM quarters", dates="end_date")
def p5(t):
    q = F.concat("y", F.lit("Q"), "qn")
    return t.quarters.select("company_id", q.alias("quarter"), P.quarter_end(q).alias("end_date"))


@query("p6_fiscal_quarter", """SELECT accession, concept, start_date, CASE WHEN fiscal_period IN ('Q1','Q2','Q3','Q4') THEN fiscal_period WHEN fiscal_period = 'FY' THEN 'Q4'
  WHEN end_date - start_date + 1 BETWEEN 120 AND 210 THEN 'Q2' WHEN end_date - start_date + 1 BETWEEN 211 AND 310 THEN 'Q3' WHEN end_date - start_date + 1 >= 311 THEN 'Q4' ELSE '' END AS fiscal_quarter FROM facts""", dates="start_date")
def p6(t):
    return t.facts.select("accession", "concept", "start_date", P.fiscal_quarter(F.col("fiscal_period"), P.day_span(F.col("start_date"), F.col("end_date"))).alias("fiscal_quarter"))


@query("p7_fiscal_period_end", """SELECT company_id, q_index, CAST(least(make_date(y, m, 1) + (qn - 4) * 3 * INTERVAL 1 MONTH + (d - 1) * INTERVAL 1 DAY, CAST(last_day(make_date(y, m, 1) + (qn - 4) * 3 * INTERVAL 1 MONTH) AS TIMESTAMP)) AS DATE) AS period_end
FROM (SELECT *, CAST(company_id % 12 + 1 AS INT) AS m, CAST(28 + company_id % 4 AS INT) AS d FROM quarters)""", dates="period_end")
def p7(t):
    q = t.quarters.withColumns({"m": (F.col("company_id") % 12 + 1).cast("int"), "d": (28 + F.col("company_id") % 4).cast("int")})
    return q.select("company_id", "q_index", P.fiscal_period_end(F.col("y"), F.col("qn"), F.col("m"), F.col("d")).alias("period_end"))


@query("p8_quarter_distance", f"SELECT company_id, q_index, abs(q_index - (1998 * 4 + 1)) AS distance FROM quarters")
def p8(t):
    return t.quarters.select("company_id", "q_index", P.q_distance(F.concat("y", F.lit("Q"), "qn"), F.lit("1998Q2")).alias("distance"))


@query("p9_latest_run", """SELECT company_id, min(q_index) AS first_q, max(q_index) AS last_q, count(*) AS run, count(*) >= 8 AS enough FROM (
  SELECT *, max(q_index) OVER (PARTITION BY company_id) - q_index AS back, row_number() OVER (PARTITION BY company_id ORDER BY q_index DESC) - 1 AS place FROM statements) WHERE back = place GROUP BY company_id""")
def p9(t):
    return Q.latest_run(t.statements, 8).select("company_id", "first_q", "last_q", "run", "enough")


@query("p10_window_complete", """SELECT company_id, count(DISTINCT q_index) AS held, max(q_index) - min(q_index) + 1 AS expected, count(DISTINCT q_index) = max(q_index) - min(q_index) + 1 AS complete FROM statements WHERE q_index >= 1997 * 4 GROUP BY company_id""")
def p10(t):
    return Q.window_complete(t.statements, 1997 * 4)


@query("p11_reporting_cycle", f"SELECT company_id, q_index, CASE qn WHEN 2 THEN 'half-year' WHEN 4 THEN 'annual' ELSE 'quarterly' END AS cycle FROM quarters")
def p11(t):
    return t.quarters.select("company_id", "q_index", P.reporting_cycle(F.concat("y", F.lit("Q"), "qn")).alias("cycle"))


@query("p12_match_quarter", """SELECT r.company_id, r.period_end, r.revenue, min(s.q_index) AS q_index FROM rows_ r LEFT JOIN statements s ON s.company_id = r.company_id AND s.period_end = r.period_end AND (r.revenue IS NULL OR abs(s.revenue - r.revenue) < 0.002) GROUP BY ALL""",
       "rows_ AS (SELECT company_id, end_date AS period_end, CASE WHEN q_index % 3 = 0 THEN NULL WHEN q_index % 3 = 1 THEN revenue ELSE CAST(revenue + 1 AS DECIMAL(20,2)) END AS revenue FROM quarters)", dates="period_end", money="revenue")
def p12(t):
    third = F.col("q_index") % 3
    rows = t.quarters.select("company_id", F.col("end_date").alias("period_end"), F.when(third == 1, F.col("revenue")).when(third == 2, (F.col("revenue") + 1).cast("decimal(20,2)")).alias("revenue"))
    return Q.match_quarter(rows, t.statements, 0.002)
