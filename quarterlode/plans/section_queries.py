"""Queries of sections of a statement page and of release summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import headers as H
from quarterlode.operators import sections as S
from quarterlode.plans.registry import query

#: Read rows of a page for each supplier and group of parts: titles, totals, items, stops, by their numbers.
READ = """seen AS (SELECT concat(l_suppkey, '-', l_partkey % 40) AS page, CAST(row_number() OVER (PARTITION BY l_suppkey, l_partkey % 40 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS INT) AS line_no, (l_orderkey + l_linenumber * 7 + l_partkey) % 12 AS k, CAST(l_quantity AS DOUBLE) AS a, CAST(l_linenumber AS DOUBLE) AS b, l_orderkey % 3 AS cnt FROM lineitem),
  read_rows AS (SELECT page, line_no, CASE k WHEN 0 THEN 'Operating expenses' WHEN 1 THEN 'Operating Expenses:' WHEN 2 THEN 'Total operating expenses' WHEN 3 THEN 'Weighted-average shares' WHEN 4 THEN 'Income tax' WHEN 5 THEN 'Total of things' ELSE concat('Item ', k % 4, CASE WHEN a > 25 THEN ' more' ELSE '' END) END AS label,
    CASE k WHEN 4 THEN 'tax' WHEN 0 THEN CASE WHEN cnt = 2 THEN 'operating_expenses' END END AS field, a, b, CASE WHEN k < 2 THEN CASE WHEN cnt = 2 THEN 2 ELSE 0 END ELSE cnt END AS cnt FROM seen)"""
SECTION = READ + """, keyed AS (SELECT *, regexp_replace(lower(label), '[^0-9a-z]', '', 'g') AS key FROM read_rows), first_ AS (SELECT page, min(line_no) AS f FROM keyed WHERE key = 'operatingexpenses' AND cnt = 0 GROUP BY page),
  closed AS (SELECT page, f, min(line_no) AS c FROM keyed RIGHT JOIN first_ USING (page) WHERE line_no > f AND (key = 'totaloperatingexpenses' OR (key = 'operatingexpenses' AND cnt > 0)) GROUP BY ALL),
  starts AS (SELECT k.page, max(line_no) AS s FROM keyed k LEFT JOIN closed c ON c.page = k.page WHERE key = 'operatingexpenses' AND cnt = 0 AND (c.c IS NULL OR line_no < c.c) GROUP BY k.page),
  ends AS (SELECT s.page, s.s, min(line_no) FILTER (line_no > s.s AND (key IN ('totaloperatingexpenses', 'operatingexpenses', 'weightedaverageshares') OR field = 'tax')) AS e FROM starts s JOIN keyed k ON k.page = s.page GROUP BY ALL),
  items AS (SELECT k.page, k.line_no, k.label, k.a, k.b, k.cnt FROM keyed k JOIN ends e ON e.page = k.page AND k.line_no > e.s AND (e.e IS NULL OR k.line_no < e.e) WHERE k.cnt >= 1 AND k.key NOT LIKE 'total%' AND k.key <> 'operatingexpenses' QUALIFY row_number() OVER (PARTITION BY k.page, k.key ORDER BY k.line_no) = 1)"""


def read_rows(t):
    return t.sql("SELECT * FROM read_rows", READ).withColumn("numbers", F.slice(F.array("a", "b"), F.lit(1), F.col("cnt").cast("int"))).drop("a", "b", "cnt")


@query("c8_section_items", "SELECT page, line_no, label, cnt::INT AS numbers FROM items", SECTION)
def c8(t):
    return S.section_items(read_rows(t), ("page",), "opex", F.lit(1)).select("page", "line_no", "label", F.size("numbers").alias("numbers"))


@query("c8_breakdown_items", 'SELECT page, 0 AS "column", label AS name, abs(a) * 1000 AS value FROM items WHERE a <> 0', SECTION)
def c8_breakdown(t):
    return S.breakdown_items(read_rows(t), ("page",), "opex", F.lit(1), F.lit(1000.0))


#: Release pages for each statement: the quarter in words, a date or none, rows in several spellings.
RELEASES = """release AS (SELECT company_id, q_index, y, qn, concat('Some Company NL', CASE WHEN company_id % 4 = 1 THEN 'May 2, 2001 NL' ELSE '' END, CASE WHEN company_id % 7 = 6 THEN 'Other notes for the quarter ended ' ELSE 'Consolidated Results for the Quarter Ended ' END, CASE qn WHEN 1 THEN 'January' WHEN 2 THEN 'April' WHEN 3 THEN 'July' ELSE 'October' END, ' 28 NL Fiscal ', y + 11, CASE WHEN company_id % 5 = 4 THEN '' ELSE concat(' Fiscal ', y + 10) END, CASE qn WHEN 1 THEN ' first quarter' WHEN 2 THEN ' Q2' WHEN 3 THEN ' 3rd Quarter' ELSE ' fourth quarter' END,
    ' NL Revenue | $', company_id + 1, '.5 billion | 3% | ', qn, ' million and 9 billion | $', q_index, ' m i l l i o n NL', CASE WHEN q_index % 3 = 0 THEN ' Operating income 1 million 2 million NL' ELSE ' Operating income $1,250 million, 2 million and 3.5 billion NL' END, ' Net income ', y, ' million, 5 billion and 6.25 million NL Net income | 1 | 2') AS text, CASE WHEN company_id % 2 = 0 THEN period_end END AS filing_date FROM statements)"""
_REL = RELEASES + """, told AS (SELECT *, CASE WHEN company_id % 4 = 1 THEN 2001 WHEN filing_date IS NOT NULL THEN year(filing_date) ELSE y + 11 END AS yr FROM release WHERE company_id % 7 <> 6 AND company_id % 5 <> 4)"""


@query("c11_release_summary", """SELECT company_id, q_index AS doc_q, yr * 4 + qn - 1 AS q_index, y + 11 AS fiscal_year, qn AS fiscal_quarter, (company_id + 1.5) * 1e9 AS revenue, CASE WHEN q_index % 3 <> 0 THEN 1250e6 END AS operating_income, y * 1e6 AS net_income FROM told
  UNION ALL SELECT company_id, q_index, yr * 4 + qn - 5, y + 10, qn, q_index * 1e6, CASE WHEN q_index % 3 <> 0 THEN 3.5e9 END, 6.25e6 FROM told""", _REL, money="revenue operating_income net_income")  # fmt: skip
def c11(t):
    pages = t.sql("SELECT * FROM release", RELEASES).select(F.struct("company_id", F.col("q_index").alias("q")).alias("doc"), F.lit(0).alias("page_no"), F.replace("text", F.lit("NL"), F.lit("\n")).alias("text"), "filing_date")
    return S.release_summary(pages, "doc").select("doc.company_id", F.col("doc.q").alias("doc_q"), "q_index", "fiscal_year", "fiscal_quarter", "revenue", "operating_income", "net_income")


#: Pages for each statement whose first lines tell their periods in six ways.
HEADS = """heads AS (SELECT company_id, q_index AS doc, y + 10 AS y, qn, (company_id + q_index) % 6 AS k, concat('Statement NL', CASE (company_id + q_index) % 6 WHEN 0 THEN concat('Income | Three Months Ended | Nine Months Ended NL | ', mon, ' 28, NL | ', y + 10, ' | ', y + 9, ' | ', y + 10, ' | ', y + 9) WHEN 1 THEN concat('Q', qn, ' ', y + 10, ' and ', qn, 'Q', y + 9, ' NL ', y + 10, 'Q', qn)
    WHEN 2 THEN concat('Fiscal Year ended June 30 NL Q', qn, ' YTD NL FY', y + 10, ' Fiscal Year ', y + 9) WHEN 3 THEN concat('Fiscal year ended ', mon, ' 30 NL FY', y + 10, ' NL First NL quarter NL fourth quarter and 2nd Quarter') WHEN 4 THEN concat('Six months ended ', mon, ' 28, NL ', y + 10, ' ', y + 9, ' ', y + 8) ELSE concat('截至', y + 10, '年', qn * 3, '月28日止六个月期间') END) AS text
  FROM (SELECT *, CASE qn WHEN 1 THEN 'February' WHEN 2 THEN 'May' WHEN 3 THEN 'August' ELSE 'November' END AS mon FROM statements) s)"""
_HEADS = HEADS + """, posed AS (SELECT *, (y - 1) * 12 + (CASE WHEN k = 2 THEN 6 ELSE qn * 3 - 1 END) - 1 AS last_, unnest(CASE k WHEN 0 THEN [0, 1, 2, 3] WHEN 1 THEN [0, 1] WHEN 2 THEN [0, 1] WHEN 3 THEN [0, 1, 2] WHEN 4 THEN [0, 1] ELSE [0] END) AS pos FROM heads)"""


@query("c18_page_periods", """SELECT company_id, doc, pos::INT AS pos, (CASE k WHEN 0 THEN (y - pos % 2) * 4 + qn - 1 WHEN 2 THEN (last_ + 12 - pos * 12 - (4 - qn) * 3) // 3 WHEN 3 THEN (last_ + 12 - (4 - [1, 4, 2][pos + 1]) * 3) // 3 ELSE (y - pos) * 4 + qn - 1 END)::INT AS q_index,
  CASE k WHEN 0 THEN CASE WHEN pos < 2 THEN 1 ELSE 3 END WHEN 2 THEN qn WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 1 END AS span FROM posed""", _HEADS)  # fmt: skip
def c18(t):
    pages = t.sql("SELECT company_id, doc, text FROM heads", HEADS).withColumn("text", F.replace("text", F.lit("NL"), F.lit("\n")))
    return H.page_periods(pages, ("company_id", "doc"))
