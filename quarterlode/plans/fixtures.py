"""Model tables as views over the given tables, in SQL that Spark and DuckDB both read.

Money is summed from exact decimals; rows are hidden or repeated by rules on their keys, so that derivation, ranking and
gap handling have work to do. Nothing is sampled: the views grow with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "companies": "SELECT s_suppkey AS company_id, s_name AS name, s_nationkey, s_acctbal FROM supplier",
    "lines": """
SELECT l_suppkey AS company_id, l_partkey, l_returnflag, l_linestatus, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS start_date,
  CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2))) AS revenue,
  CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.6 AS DECIMAL(2,1)) AS cost,
  CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2))) * CAST(l_tax AS DECIMAL(3,2)) AS tax
FROM lineitem""",
    "quarters": """
SELECT company_id, start_date, CAST(last_day(start_date + INTERVAL '2' MONTH) AS DATE) AS end_date,
  CAST(year(start_date) AS INT) AS y, CAST(quarter(start_date) AS INT) AS qn, CAST(year(start_date) * 4 + quarter(start_date) - 1 AS INT) AS q_index,
  CAST(sum(revenue) AS DECIMAL(20,2)) AS revenue, CAST(sum(cost) AS DECIMAL(20,2)) AS cost, CAST(sum(tax) AS DECIMAL(20,2)) AS tax
FROM lines GROUP BY company_id, start_date""",
    "measures": """
SELECT company_id, concept, start_date, end_date, y, qn, CASE concept WHEN 'Revenues' THEN revenue WHEN 'CostOfRevenue' THEN cost ELSE tax END AS value
FROM quarters CROSS JOIN (SELECT 'Revenues' AS concept UNION ALL SELECT 'CostOfRevenue' UNION ALL SELECT 'IncomeTaxExpenseBenefit') c""",
    "disclosed": """
SELECT company_id, concept, CASE WHEN k = 0 THEN start_date ELSE ytd_start END AS start_date, end_date, y, qn, CASE WHEN k = 0 THEN value ELSE ytd END AS value
FROM (SELECT *, CAST(min(start_date) OVER w AS DATE) AS ytd_start, CAST(sum(value) OVER w AS DECIMAL(20,2)) AS ytd FROM measures
  WINDOW w AS (PARTITION BY company_id, concept, y ORDER BY qn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) spans
WHERE CASE WHEN k = 0 THEN NOT (qn = 2 AND (company_id + y) % 3 = 0) AND NOT (qn = 4 AND (company_id + y) % 3 <> 2) ELSE qn >= 2 END""",
    "forms": "SELECT '10-Q' AS form, 30 AS lag_days, 0 AS extra UNION ALL SELECT '10-K', 60, 1 UNION ALL SELECT '8-K', 400, 2 UNION ALL SELECT 'S-1', 10, 3",
    "facts": """
SELECT d.company_id, CASE WHEN d.company_id % 4 = 0 THEN 'ifrs-full' ELSE 'us-gaap' END AS namespace, d.concept,
  CASE WHEN d.company_id % 5 = 0 AND d.concept <> 'IncomeTaxExpenseBenefit' THEN 'EUR' ELSE 'USD' END AS unit, f.form,
  concat(d.company_id, '-', d.y, '-', d.qn, '-', f.extra) AS accession, CAST(d.end_date + f.lag_days * INTERVAL '1' DAY AS DATE) AS filed,
  CAST(d.y AS STRING) AS fiscal_year, CASE WHEN d.qn = 4 THEN 'FY' WHEN d.qn = 3 THEN '' ELSE concat('Q', d.qn) END AS fiscal_period,
  d.start_date, d.end_date, CAST(d.value + f.extra AS DECIMAL(20,2)) AS value
FROM disclosed d CROSS JOIN forms f""",
    "statements": """
SELECT company_id, q_index, concat(y, 'Q', qn) AS quarter, y, qn, end_date AS period_end, revenue,
  CASE WHEN (company_id + q_index) % 4 <> 1 THEN cost END AS cost_of_revenue,
  CASE WHEN (company_id + q_index) % 4 <> 2 THEN CAST(revenue - cost AS DECIMAL(20,2)) END AS gross_profit,
  CAST(revenue * CAST(0.10 AS DECIMAL(3,2)) AS DECIMAL(20,2)) AS sgna, CAST(revenue * CAST(0.05 AS DECIMAL(3,2)) AS DECIMAL(20,2)) AS rnd,
  CASE WHEN (company_id + q_index) % 5 <> 3 THEN CAST(revenue * CAST(0.18 AS DECIMAL(3,2)) AS DECIMAL(20,2)) END AS operating_expenses,
  CASE WHEN (company_id + q_index) % 6 <> 0 THEN CAST(revenue - cost - revenue * CAST(0.18 AS DECIMAL(3,2)) AS DECIMAL(20,2)) END AS operating_income,
  CASE WHEN (company_id + q_index) % 7 <> 0 THEN CAST(revenue - cost - revenue * CAST(0.17 AS DECIMAL(3,2)) AS DECIMAL(20,2)) END AS pretax_income,
  CASE WHEN (company_id + q_index) % 8 <> 0 THEN tax END AS tax,
  CAST(revenue - cost - revenue * CAST(0.17 AS DECIMAL(3,2)) - tax AS DECIMAL(20,2)) AS net_income
FROM quarters WHERE (company_id * 7 + q_index) % 11 <> 0""",
    "segments": """
SELECT l.company_id, CAST(year(l.start_date) * 4 + quarter(l.start_date) - 1 AS INT) AS q_index, p.p_type AS member_key, p.p_type AS name,
  CAST(last_day(l.start_date + INTERVAL '2' MONTH) AS DATE) AS period_end, CAST(sum(l.revenue) AS DECIMAL(20,2)) AS value
FROM lines l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.company_id, l.start_date, p.p_type""",
    "dim_facts": """
SELECT concat_ws('-', company_id, y, qn, kind, coalesce(p_type, p_brand, 'all'), k) AS fact_id, company_id, CASE WHEN (company_id + qn) % 4 = 0 THEN 'NetSales' WHEN (company_id + qn) % 4 = 1 THEN 'InterestRevenue' ELSE 'Revenues' END AS concept,
  CASE WHEN k = 0 OR qn = 1 THEN start_date ELSE ytd_start END AS start_date, end_date, CASE WHEN k = 0 THEN '10-Q' ELSE '10-K' END AS form, CAST(end_date + (CASE WHEN (company_id + y) % 5 = 0 THEN 300 ELSE 40 END + k * 10) * INTERVAL '1' DAY AS DATE) AS filing_date,
  CASE WHEN k = 0 OR qn = 1 THEN value ELSE ytd END AS value,
  CASE kind WHEN 'type' THEN concat('us-gaap:StatementBusinessSegmentsAxis=co:', p_type, 'Member', CASE WHEN (company_id + qn) % 3 = 0 THEN ';srt:ConsolidationItemsAxis=us-gaap:OperatingSegmentsMember' WHEN qn = 2 THEN ';us-gaap:StatementBusinessSegmentsAxis=us-gaap:OperatingSegmentsMember' ELSE '' END)
    WHEN 'brand' THEN concat('srt:ProductOrServiceAxis=co:', replace(p_brand, '#', ''), 'Member') ELSE CASE WHEN company_id % 2 = 0 THEN 'co:SegmentPlaceAxis=co:NorthAmericaMember' ELSE 'srt:StatementGeographicalAxis=country:US' END END AS dims
FROM (SELECT *, CAST(last_day(start_date + INTERVAL '2' MONTH) AS DATE) AS end_date, CAST(min(start_date) OVER w AS DATE) AS ytd_start, CAST(sum(value) OVER w AS DECIMAL(20,2)) AS ytd FROM (
  SELECT l.company_id, l.start_date, CAST(year(l.start_date) AS INT) AS y, CAST(quarter(l.start_date) AS INT) AS qn, p.p_type, p.p_brand, CASE WHEN grouping(p.p_type) = 0 THEN 'type' WHEN grouping(p.p_brand) = 0 THEN 'brand' ELSE 'place' END AS kind, CAST(sum(l.revenue) AS DECIMAL(20,2)) AS value
  FROM lines l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY GROUPING SETS ((l.company_id, l.start_date, p.p_type), (l.company_id, l.start_date, p.p_brand), (l.company_id, l.start_date))) g
  WINDOW w AS (PARTITION BY company_id, kind, p_type, p_brand, y ORDER BY qn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) h CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) ks
WHERE (k = 0 AND NOT (kind = 'type' AND qn = 3 AND company_id % 2 = 0)) OR (k = 1 AND (qn = 1 OR kind <> 'brand'))""",
    "details": """
SELECT l.company_id, CAST(year(l.start_date) * 4 + quarter(l.start_date) - 1 AS INT) AS q_index, p.p_brand AS member_key, p.p_type AS target_name,
  CAST(sum(l.revenue) AS DECIMAL(20,2)) AS value
FROM lines l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.company_id, l.start_date, p.p_brand, p.p_type""",
    "filings": """
SELECT o_custkey AS company_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '10-Q' WHEN '2' THEN '10-K' WHEN '3' THEN '20-F' WHEN '4' THEN '6-K' ELSE '8-K' END AS form,
  concat('acc-', o_orderkey % 9973) AS accession, CAST(o_orderdate AS DATE) AS filing_date, concat('doc', o_orderkey, '.htm') AS primary_document, o_orderkey
FROM orders""",
    "labels_seen": """
SELECT company_id, CAST(year(start_date) * 4 + quarter(start_date) - 1 AS INT) AS q_index,
  CASE k WHEN 0 THEN concat('s', l_linestatus) WHEN 1 THEN 'sT' ELSE 'sO' END AS source_id, 'opex' AS kind,
  CASE WHEN k = 1 THEN 'Total operating expenses' WHEN k = 2 THEN 'Sundry items' ELSE CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'Sales and distribution expense' WHEN 'AO' THEN 'Advertising and promotion'
    WHEN 'NF' THEN 'General corporate overhead' WHEN 'NO' THEN 'Product development' WHEN 'RF' THEN 'Interest and other expense' ELSE 'R&D' END END AS name,
  CASE WHEN k = 2 THEN tax ELSE cost END AS value
FROM (SELECT company_id, start_date, l_returnflag, l_linestatus, grouping(l_returnflag) AS whole, CAST(sum(cost) AS DECIMAL(20,2)) AS cost, CAST(sum(tax) AS DECIMAL(20,2)) AS tax FROM lines
  GROUP BY GROUPING SETS ((company_id, start_date, l_returnflag, l_linestatus), (company_id, start_date))) g
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) kinds WHERE (k = 0 AND whole = 0) OR (k > 0 AND whole = 1)""",
    "fx_rates": """
SELECT currency, rate_date, rate FROM (
  SELECT event_type AS currency, CAST(ts AS DATE) AS rate_date, CAST(avg(CAST(value AS DECIMAL(12,4))) AS DECIMAL(12,4)) AS rate FROM events GROUP BY event_type, CAST(ts AS DATE)) x
WHERE day(rate_date) % 4 = 1""",
    "probes": "SELECT event_id, event_type AS currency, CAST(ts + INTERVAL '3' DAY AS DATE) AS at FROM events",
}

# What Spark runs in place of pieces of a view: the same rows, but dealt by company before they are summed, so that sums,
# windows and whatever else is keyed by company need no further shuffle. Grouping sets and cross joins may lose how rows
# are dealt, explode does not. All that follows is one stage, whose rows are several times what was dealt, so {parts}, a
# number that adaptive execution keeps to, goes by the rows of lineitem: a task gets LINES of them.
LINES = 250_000
_SUMS = VIEWS["dim_facts"][VIEWS["dim_facts"].index("  SELECT l.company_id") : VIEWS["dim_facts"].index(") g\n")]
_DEALT = """  SELECT company_id, start_date, CAST(year(start_date) AS INT) AS y, CAST(quarter(start_date) AS INT) AS qn, p_type, p_brand, kind, CAST(sum(revenue) AS DECIMAL(20,2)) AS value
  FROM (SELECT company_id, start_date, revenue, kind, CASE WHEN kind = 'type' THEN p_type END AS p_type, CASE WHEN kind = 'brand' THEN p_brand END AS p_brand
    FROM (SELECT /*+ REPARTITION({parts}, company_id) */ l.company_id, l.start_date, l.revenue, p.p_type, p.p_brand FROM lines l JOIN part p ON l.l_partkey = p.p_partkey) m
    LATERAL VIEW explode(array('type', 'brand', 'place')) kinds AS kind) x
  GROUP BY company_id, start_date, kind, p_type, p_brand"""
_SPANS = "CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) ks"
SPARK_VIEWS: dict[str, str] = VIEWS | {"dim_facts": VIEWS["dim_facts"].replace(_SUMS, _DEALT).replace(_SPANS, "LATERAL VIEW explode(array(0, 1)) ks AS k")}


def ctes(extra: str = "") -> str:
    """WITH clause that defines all views; `extra` is appended."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in VIEWS.items()) + (",\n" + extra if extra else "") + "\n"


def reads(sql: str) -> set[str]:
    """The given tables and views that some SQL reads, through other views."""
    words = set(re.findall(r"\w+", sql))
    views = words & VIEWS.keys()
    return views | (words & set(TABLES)).union(*(reads(VIEWS[v].replace(f" {v} ", " ")) for v in views))


def select(spark: SparkSession, sf_dir: str, sql: str, extra: str = "") -> DataFrame:
    """A query over model views and given tables of one folder; extra: more common table expressions.

    Only what is read is registered."""
    used = reads(f"{extra} {sql}")
    for t in used & set(TABLES):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    views = {k: v for k, v in SPARK_VIEWS.items() if k in used}
    if "dim_facts" in views:
        parts = max(spark.sparkContext.defaultParallelism, -(-spark.table("lineitem").count() // LINES))
        views["dim_facts"] = views["dim_facts"].replace("{parts}", str(parts))
    tables = [f"{k} AS ({v})" for k, v in views.items()] + ([extra] if extra else [])
    return spark.sql(f"WITH {', '.join(tables)} {sql}" if tables else sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables of one folder."""
    return select(spark, sf_dir, f"SELECT * FROM {name}")
