"""Queries of tables and text lines as sources of period entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import tables as E
from quarterlode.plans.registry import query

#: A quarter with the one a year before, as documents print them.
PAIRS = """pairs AS (SELECT company_id, q_index, y, qn, revenue, cost, tax, r4, c4 FROM (SELECT company_id, q_index, y, qn, revenue, cost, tax, lag(revenue, 4) OVER w AS r4, lag(cost, 4) OVER w AS c4, lag(q_index, 4) OVER w AS q4 FROM quarters WINDOW w AS (PARTITION BY company_id ORDER BY q_index)) x WHERE q4 = q_index - 4)"""
ENDS = ("Mar 31,", "June 30,", "September 30,", "Dec. 31,")
PHRASES = ("Three Months Ended", "Six Months Ended", "Nine months ended", "Year ended")


def pairs(t):
    return t.sql("SELECT * FROM pairs", PAIRS)


def tables(t):
    """Rows (company_id, q_index, row_no, cells) of three kinds of tables."""
    p = pairs(t)
    kind, qn = F.col("q_index") % 3, F.col("qn")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), qn)
    money = lambda c: F.format_number(F.col(c), 2)
    s = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    year = F.col("y").cast("string")
    before = (F.col("y") - 1).cast("string")
    short = lambda y: F.concat(F.lit("Q"), qn.cast("string"), F.lit(" "), y)
    dated = lambda y: F.concat(pick(("March 31, ", "June 30, ", "September 30, ", "December 31, ")), y)
    one = F.when(kind == 0, s("", short(year), short(before))).when(kind == 1, s(F.concat_ws(" ", pick(PHRASES), pick(("March 31,", "June 30,", "September 30,", "December 31,"))))).otherwise(s("", dated(year), dated(before)))
    two = F.when(kind == 1, s("", year, before)).otherwise(s("unaudited"))
    note = F.when(F.col("company_id") % 2 == 0, s("Total revenue", "12", money("revenue"), money("r4"))).otherwise(s("Net revenues", money("revenue"), money("r4")))
    rows = F.array(s("(in thousands)"), one, two, note, s("Cost of sales", F.concat(F.lit("("), money("cost"), F.lit(")")), F.concat(F.lit("("), money("c4"), F.lit(")"))), s("Revenue per share", "1", "2"), s("Income tax expense", money("tax")))
    return p.select("company_id", "q_index", F.posexplode(rows).alias("row_no", "cells"))


KEYS = ("company_id", "q_index")
_SPAN = "CASE WHEN q_index % 3 = 1 THEN qn ELSE 1 END"


@query("c3_period_columns", f"SELECT company_id, q_index AS doc, 0 AS pos, q_index, {_SPAN} AS span FROM pairs UNION ALL SELECT company_id, q_index, 1, q_index - 4, {_SPAN} FROM pairs", PAIRS)
def c3(t):
    rows = tables(t).withColumnRenamed("q_index", "doc")
    return E.period_columns(rows, ("company_id", "doc"))


_CASE = " ".join(f"WHEN regexp_matches(k, '^(?:{'|'.join(a)})|(?:{'|'.join(a)})$') THEN '{f}'" for f, a in E.ROW_ALIASES.items())
NAMES = "named AS (SELECT p_partkey, concat(p_name, CASE p_partkey % 7 WHEN 0 THEN ' Sales' WHEN 1 THEN ', Cost of Revenues' WHEN 2 THEN ' 营业利润' WHEN 3 THEN ' tax expense' WHEN 4 THEN ' (Net income / loss)' ELSE ' things' END) AS label FROM part)"


@query("c5_match_field", f"SELECT p_partkey, CASE {_CASE} END AS field FROM (SELECT p_partkey, regexp_replace(lower(trim(label)), '[^0-9a-z一-鿿]+', '', 'g') AS k FROM named)", NAMES)
def c5(t):
    return t.sql("SELECT * FROM named", NAMES).select("p_partkey", E.match_field(F.col("label")).alias("field"))


@query("c6_row_series", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN NULL WHEN l_linenumber % 4 = 2 AND l_extendedprice <= 10000 THEN 7 ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS first_number, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE 2 END AS numbers FROM lineitem", money="first_number")
def c6(t):
    price = F.format_number(F.col("l_extendedprice").cast("decimal(12,2)"), 2)
    k = F.col("l_linenumber") % 4
    cells = F.when(k == 0, F.array(F.lit("x"), price, price)).when(k == 1, F.array(F.lit("x"), F.concat(F.lit("("), price, F.lit(")")), price)).when(k == 2, F.array(F.lit("x"), F.lit("7"), price, F.lit("$"), price)).otherwise(F.array(F.lit("x"), price, F.lit("—")))
    v = E.row_series(cells, F.lit(2), k == 1)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.get(v, F.lit(0)).alias("first_number"), F.when(v.isNotNull(), F.size(v)).alias("numbers"))


@query("c9_table_entries", f"""SELECT company_id, doc, q_index, span, CASE WHEN span = 1 THEN 'direct' ELSE 'cumulative' END AS value_mode, CAST(r * 1000 AS DECIMAL(20,2)) AS revenue, CAST(c * 1000 AS DECIMAL(20,2)) AS cost_of_revenue, CAST((r - c) * 1000 AS DECIMAL(20,2)) AS gross_profit FROM (
  SELECT company_id, q_index AS doc, q_index, {_SPAN} AS span, revenue AS r, cost AS c FROM pairs UNION ALL SELECT company_id, q_index, q_index - 4, {_SPAN}, r4, c4 FROM pairs) WHERE r >= 1""", PAIRS, money="revenue cost_of_revenue gross_profit")  # fmt: skip
def c9(t):
    rows = tables(t).withColumnRenamed("q_index", "doc")
    return E.table_entries(rows, ("company_id", "doc")).select("company_id", "doc", "q_index", "span", "value_mode", "revenue", "cost_of_revenue", "gross_profit")


@query("c7_line_rows", """SELECT company_id, q_index, 0 AS line_no, 'Notes and things Total revenue' AS label, 'revenue' AS field, 2 AS numbers, revenue AS first_number FROM pairs UNION ALL SELECT company_id, q_index, 1 AS line_no, 'Total revenue' AS label, 'revenue' AS field, 2 AS numbers, revenue AS first_number FROM pairs UNION ALL SELECT company_id, q_index, 2, 'Cost of sales', 'revenue', 2, -cost FROM pairs
  UNION ALL SELECT company_id, q_index, 4, 'Operating expenses', 'operating_expenses', 0, NULL FROM pairs UNION ALL SELECT company_id, q_index, 5, 'of which tax', NULL, 2, tax FROM pairs""", PAIRS, money="first_number")  # fmt: skip
def c7(t):
    money = lambda c: F.format_number(F.col(c), 2)
    text = F.concat_ws("\n", F.lit("Notes and things"), F.concat_ws("  ", F.lit("Total revenue"), money("revenue"), F.lit("and"), money("r4")), F.lit("Cost of sales:"), F.concat(F.lit("("), money("cost"), F.lit(") ("), money("c4"), F.lit(")")), F.lit("Operating expenses"), F.concat_ws(" ", F.lit("of which tax"), money("tax"), F.lit("1"))).alias("text")
    return E.line_rows(pairs(t).select("company_id", "q_index", text), KEYS).select("company_id", "q_index", "line_no", "label", "field", F.size("numbers").alias("numbers"), F.get("numbers", F.lit(0)).alias("first_number"))


COVERS = """covers AS (SELECT conv_id, turn, concat(text, CASE WHEN turn = 1 THEN CASE conv_id % 5 WHEN 0 THEN ' 2023 年 第三季度报告 rmb' WHEN 1 THEN ' 2022年半年度报告 ' WHEN 2 THEN ' 2021年年度报告 HKD' WHEN 3 THEN ' 2020年 ' ELSE '' END ELSE '' END) AS text FROM conversations)"""
_MONEY = " ".join(f"WHEN contains(upper(t), '{c}') THEN '{'CNY' if c == 'RMB' else c}'" for c in E.CURRENCIES)


@query("c12_document_context", f"SELECT conv_id, CASE k WHEN 0 THEN 'quarterly' WHEN 1 THEN 'half-year' WHEN 2 THEN 'annual' END AS report_type, CASE k WHEN 0 THEN 2023 WHEN 1 THEN 2022 WHEN 2 THEN 2021 END AS report_year, CASE k WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 4 END AS report_quarter, CASE {_MONEY} ELSE 'USD' END AS currency FROM (SELECT conv_id, CASE WHEN max(turn) >= 1 THEN conv_id % 5 ELSE 9 END AS k, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS t FROM covers WHERE turn < 6 GROUP BY conv_id)", COVERS)
def c12(t):
    return E.document_context(t.sql("SELECT * FROM covers", COVERS), "conv_id", "turn", "text")


#: Pages with headers, rows and footers by their number; the text of a conversation stands between.
PAGES = """paged AS (SELECT conv_id, turn, concat(CASE (conv_id + turn) % 5 WHEN 0 THEN 'Statement Q1 2023 Q1 2022' WHEN 1 THEN 'continued' WHEN 2 THEN 'Reconciliations of non-GAAP financial measures' ELSE 'more' END, chr(10), CASE turn % 3 WHEN 0 THEN 'Net income 5 6' WHEN 1 THEN 'Revenue 1 2' ELSE 'Income tax expense 3 4' END, chr(10), 'a line', chr(10), 'b line', chr(10),
  CASE conv_id % 4 WHEN 0 THEN 'the Cloud segment' WHEN 1 THEN 'segment data by division' ELSE 'page' END) AS text FROM conversations)"""


@query("c10_page_entries", """SELECT conv_id, turn, CASE WHEN own THEN '2023Q1,2022Q1' ELSE prior END AS columns FROM (SELECT *, last_value(CASE WHEN own THEN '2023Q1,2022Q1' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (
  SELECT conv_id, turn, (conv_id + turn) % 5 = 0 AS own FROM conversations WHERE conv_id % 4 <> 0 AND (conv_id + turn) % 5 <> 2)) WHERE own OR (prior IS NOT NULL AND turn % 3 <> 1)""")  # fmt: skip
def c10(t):
    pages = E.usable_pages(t.sql("SELECT * FROM paged", PAGES.replace("chr(10)", "'\\n'")))
    found = F.transform(F.arrays_zip(F.regexp_extract_all("text", F.lit(r"Q([1-4]) (\d{4})"), F.lit(2)).alias("y"), F.regexp_extract_all("text", F.lit(r"Q([1-4]) (\d{4})"), F.lit(1)).alias("q")), lambda x: F.concat(x["y"], F.lit("Q"), x["q"]))
    fields = F.array_compact(F.transform(F.split("text", "\n"), lambda x: E.match_field(F.regexp_replace(x, "[0-9 ]+$", ""))))
    at = E.carry_columns(pages.select("conv_id", "turn", found.alias("columns"), fields.alias("fields")), ("conv_id",), "turn")
    return at.select("conv_id", "turn", F.array_join("columns", ",").alias("columns"))
