"""Queries of scanned pages: boxes to rows and lines, the table among lines."""

from __future__ import annotations

from quarterlode.operators import boxes as O
from quarterlode.plans.registry import query

#: Boxes of a page for each order: a label, two figures and sometimes a second word on each line, none quite in its place.
BOXES = """boxes AS (SELECT l_orderkey AS page, CASE k WHEN 0 THEN 5e-2 WHEN 1 THEN 4e-1 WHEN 2 THEN 7e-1 ELSE 11e-2 END + CAST((l_partkey + k * 3) % 9 AS DOUBLE) * 7e-3 AS x, 5e-2 + CAST(l_linenumber AS DOUBLE) * 14e-3 + CAST((l_suppkey + l_partkey * k) % 6 AS DOUBLE) * 2e-3 AS y,
    CASE k WHEN 0 THEN 8e-2 WHEN 3 THEN 4e-2 ELSE 6e-2 END AS width, CASE WHEN l_suppkey % 3 = 0 THEN 3e-2 ELSE 1e-2 END AS height, CASE k WHEN 0 THEN concat(' Line  ', l_linenumber) WHEN 1 THEN concat(l_partkey) WHEN 2 THEN concat('(', l_suppkey, ')') ELSE 'net' END AS text
  FROM lineitem CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks WHERE k < 3 OR l_returnflag = 'R')"""
ROWS = BOXES + """, tidy AS (SELECT page, x, y, width, height, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM boxes), ordered_ AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, text, width, height) AS k FROM tidy),
  walk AS (WITH RECURSIVE w AS (SELECT page, k, y, x, text, width, 0 AS row_no, y AS anchor, 1 AS n FROM ordered_ WHERE k = 1
    UNION ALL SELECT page, k, y, x, text, width, row_no + CASE WHEN near THEN 0 ELSE 1 END, CASE WHEN near THEN (anchor * n + y) / (n + 1) ELSE y END, CASE WHEN near THEN n + 1 ELSE 1 END
      FROM (SELECT b.page, b.k, b.y, b.x, b.text, b.width, w.row_no, w.anchor, w.n, abs(b.y - w.anchor) <= greatest(0.009::DOUBLE, b.height * 0.45::DOUBLE) AS near FROM w JOIN ordered_ b ON b.page = w.page AND b.k = w.k + 1)) SELECT * FROM w),
  placed AS (SELECT *, row_number() OVER (PARTITION BY page, row_no ORDER BY x, y, text) - 1 AS place, row_number() OVER (PARTITION BY page ORDER BY row_no, x, y, text) AS j FROM walk)"""
_LIST = "CASE WHEN coalesce(list_position(list_transform(w.a, lambda v: abs(p.x - v) <= 0.065::DOUBLE), true), 0) = 0 THEN list_sort(list_append(w.a, p.x)) ELSE list_transform(w.a, lambda v, i: CASE WHEN i = list_position(list_transform(w.a, lambda u: abs(p.x - u) <= 0.065::DOUBLE), true) THEN (v + p.x) / 2 ELSE v END) END"
GRID = ROWS + f""", columns_ AS (WITH RECURSIVE w AS (SELECT page, j, [x] AS a FROM placed WHERE j = 1 UNION ALL SELECT p.page, p.j, {_LIST} FROM w JOIN placed p ON p.page = w.page AND p.j = w.j + 1) SELECT page, list_sort(arg_max(a, j)) AS a FROM w GROUP BY page),
  celled AS (SELECT p.*, list_position(list_transform(c.a, lambda v: abs(v - p.x)), list_min(list_transform(c.a, lambda v: abs(v - p.x)))) AS cell FROM placed p JOIN columns_ c USING (page) WHERE len(c.a) >= 2),
  lines_ AS (SELECT page, row_no, min(y) AS y, string_agg(cell_text, ' | ' ORDER BY cell) AS line FROM (SELECT page, row_no, cell, min(y) AS y, string_agg(text, ' ' ORDER BY place) AS cell_text FROM celled GROUP BY page, row_no, cell) GROUP BY page, row_no)"""


@query("c13_ocr_rows", "SELECT page, row_no, place::INT AS place, x, text FROM placed", ROWS)
def c13(t):
    return O.ocr_rows(t.sql("SELECT * FROM boxes", BOXES), ("page",)).select("page", "row_no", "place", "x", "text")


@query("c13_grid_lines", "SELECT page, (row_number() OVER (PARTITION BY page ORDER BY y, row_no) - 1)::INT AS line_no, line FROM lines_", GRID)
def c13_grid(t):
    return O.grid_lines(t.sql("SELECT * FROM boxes", BOXES), ("page",))


@query("c13_spaced_lines", """SELECT page, (row_number() OVER (PARTITION BY page ORDER BY y, row_no) - 1)::INT AS line_no, line FROM (SELECT page, row_no, min(y) AS y, trim(string_agg(gap || text, '' ORDER BY place)) AS line
  FROM (SELECT *, CASE WHEN place = 0 THEN '' WHEN x - (lag(x) OVER v + lag(width) OVER v) > 0.05 THEN ' | ' ELSE ' ' END AS gap FROM placed WINDOW v AS (PARTITION BY page, row_no ORDER BY place)) GROUP BY page, row_no)""", ROWS)
def c13_spaced(t):
    return O.spaced_lines(t.sql("SELECT * FROM boxes", BOXES), ("page",))


#: Lines of a page for each order: headers, rows, labels, sentences, blanks and the reference to the notes by their numbers.
LINES = """lines_ AS (SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line_no, CASE (l_partkey + l_suppkey) % 9 WHEN 0 THEN 'Three Months Ended' WHEN 1 THEN concat('Sales | ', l_partkey, ' | ', l_suppkey) WHEN 2 THEN 'Interest and other' WHEN 3 THEN concat('Page ', l_partkey, ' of 9.') WHEN 4 THEN '  '
    WHEN 5 THEN concat('Total income ', l_partkey, ' (', l_suppkey, ')') WHEN 6 THEN concat('We sold ', l_partkey, ' things.') WHEN 7 THEN 'See the accompanying notes' ELSE 'Operating expenses:' END AS line FROM lineitem)"""
BLOCK = LINES + """, kinds AS (SELECT page, line_no, trim(line) AS line, row_number() OVER (PARTITION BY page ORDER BY line_no) AS k, line LIKE 'Three%' OR line LIKE 'Sales |%' OR line LIKE 'Total income%' AS opens, line LIKE 'Three%' OR line LIKE 'Sales |%' OR line LIKE 'Total income%' OR line = 'Interest and other' OR line = 'Operating expenses:' OR line LIKE 'See the%' AS fits, line LIKE 'See the%' AS notes FROM lines_),
  walk AS (WITH RECURSIVE w AS (SELECT page, 0::BIGINT AS k, NULL::INT AS line_no, '' AS line, false AS on_, 0 AS slack, false AS ended, false AS took FROM kinds WHERE k = 1
    UNION ALL SELECT c.page, c.k, c.line_no, c.line, w.on_ OR (c.opens AND NOT w.ended), CASE WHEN w.ended OR NOT w.on_ THEN 0 WHEN c.line = '' THEN w.slack + 1 WHEN c.notes THEN w.slack WHEN c.fits THEN 0 ELSE w.slack + 1 END, w.ended OR (w.on_ AND c.line <> '' AND (c.notes OR (NOT c.fits AND w.slack + 1 >= 2))),
      NOT w.ended AND CASE WHEN w.on_ THEN c.line <> '' AND NOT c.notes AND (c.fits OR w.slack + 1 < 2) ELSE c.opens END FROM w JOIN kinds c ON c.page = w.page AND c.k = w.k + 1) SELECT * FROM w)"""


@query("c14_table_block", "SELECT page, line_no, line FROM walk WHERE took", BLOCK)
def c14(t):
    return O.table_block(t.sql("SELECT * FROM lines_", LINES), ("page",))


@query("c14_merge_wrapped")
def c14_merge(t):
    return O.merge_wrapped(O.table_block(t.sql("SELECT * FROM lines_", LINES), ("page",)), ("page",))
