"""Queries of figures out of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterlode.operators import corpus as C
from quarterlode.plans.registry import query

TABLED = """tabled AS (SELECT page_id AS doc_id, replace(replace(replace(replace(html, '<ul>', '<table>'), '</ul>', '</table>'), '<li>', '<tr><td>%</td><td>'), '</li>', '</td><td>%</td></tr>') AS html FROM pages)"""


@query("c1_html_cells", """SELECT doc_id, table_no, row_no, i AS cell_no, list_extract(c, i + 1) AS text FROM (SELECT *, unnest(range(len(c))) AS i FROM (SELECT doc_id, table_no, row_no, CASE WHEN len(x) = 0 THEN [] ELSE ['%', x[1] || '%'] END AS c FROM (
  SELECT doc_id, table_no, rows_i AS row_no, list_filter(list_transform([rows_[rows_i + 1]], lambda r: trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(r, '(?is)</td><td>(.*?)</td>', 1), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'))), lambda z: z <> '') AS x
  FROM (SELECT *, unnest(range(len(rows_))) AS rows_i FROM (SELECT doc_id, ti AS table_no, regexp_extract_all(ts[ti + 1], '(?is)<tr\\b.*?</tr>') AS rows_ FROM (SELECT *, unnest(range(len(ts))) AS ti FROM (SELECT doc_id, regexp_extract_all(html, '(?is)<table\\b.*?</table>') AS ts FROM tabled)))))))""", TABLED)
def c1(t):
    html = F.col("html")
    for a, b in (("<ul>", "<table>"), ("</ul>", "</table>"), ("<li>", "<tr><td>%</td><td>"), ("</li>", "</td><td>%</td></tr>")):
        html = F.replace(html, F.lit(a), F.lit(b))
    return C.html_cells(t.pages.select(F.col("page_id").alias("doc_id"), html.alias("html")))


_CENTS = "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR)"
_WRITTEN = f"CASE l_linenumber % 5 WHEN 0 THEN concat('(', {_CENTS}, ')') WHEN 1 THEN concat('$ ', {_CENTS}, ' a') WHEN 2 THEN concat('−', {_CENTS}, '%') WHEN 3 THEN '—' ELSE concat('1,', lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0')) END"


@query("c2_parse_number", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 5 WHEN 0 THEN -CAST(l_extendedprice AS DECIMAL(12,2)) WHEN 1 THEN CAST(l_extendedprice AS DECIMAL(12,2)) WHEN 2 THEN -CAST(l_extendedprice AS DECIMAL(12,2)) WHEN 3 THEN NULL ELSE CAST(1000 + l_partkey % 1000 AS DECIMAL(12,2)) END AS number FROM lineitem", money="number")
def c2(t):
    cents, k = F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.col("l_linenumber") % 5
    text = F.when(k == 0, F.concat(F.lit("("), cents, F.lit(")"))).when(k == 1, F.concat(F.lit("$ "), cents, F.lit(" a"))).when(k == 2, F.concat(F.lit("−"), cents, F.lit("%"))).when(k == 3, "—").otherwise(F.concat(F.lit("1,"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", C.parse_number(text).alias("number"))


@query("c4_unit_scale", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1000000000 WHEN 1 THEN 1000000 WHEN 2 THEN 1000 ELSE CASE WHEN p_retailprice * (p_partkey % 200) >= 100000 THEN 1000 WHEN p_retailprice * (p_partkey % 200) >= 100 THEN 1000000 ELSE 1 END END AS scale FROM part")
def c4(t):
    k = F.col("p_size") % 4
    header = F.concat(F.lit("(in "), F.when(k == 0, "Billions").when(k == 1, "millions").when(k == 2, "thousands").otherwise("units"), F.lit(" except per share)"))
    return t.part.select("p_partkey", C.unit_scale(header, F.col("p_retailprice") * (F.col("p_partkey") % 200)).alias("scale"))


@query("c15_low_signal_docs", "SELECT conv_id, count(*) AS pages, count(*) FILTER (length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) < 80) AS thin, count(*) FILTER (length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) < 80) * 2 >= count(*) AS low_signal FROM conversations WHERE turn < 6 GROUP BY 1")
def c15(t):
    return C.low_signal_docs(t.conversations, "conv_id", "turn", "text")


@query("c16_rank_links", """SELECT page_id, CASE WHEN regexp_matches(u, 'result|earn|quarter|financial-supplement|supplement|stat-book') THEN 0 WHEN regexp_matches(u, 'release|financial') THEN 1 ELSE 2 END + CASE WHEN regexp_matches(u, 'transcript|presentation|slides|roadshow|webcast|overview|policy|codeconduct') THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(u, 'proxy|annual-report|annual\\+report|presentation|icr|conference|webcast') THEN 3 ELSE 0 END AS topic, -coalesce(list_max(list_transform(regexp_extract_all(u, '\\b(20\\d{2})\\b', 1), lambda x: x::INT)), 0) AS year, CASE WHEN regexp_matches(u, '\\.pdf($|\\?)') THEN 0 ELSE 1 END AS kind
  FROM (SELECT page_id, lower(url || CASE page_id % 5 WHEN 0 THEN '/q2-2023-results.pdf' WHEN 1 THEN '/release-2021.pdf?x=1' WHEN 2 THEN '/presentation.pdf' WHEN 3 THEN '/proxy' ELSE '' END) AS u FROM pages)""")
def c16(t):
    k = F.col("page_id") % 5
    tail = F.when(k == 0, "/Q2-2023-results.pdf").when(k == 1, "/release-2021.pdf?x=1").when(k == 2, "/presentation.pdf").when(k == 3, "/proxy").otherwise("")
    return t.pages.select("page_id", C.link_rank(F.concat("url", tail)).alias("r")).select("page_id", "r.topic", "r.year", "r.kind")


@query("c17_extract_links", """SELECT DISTINCT page_id, link, regexp_extract(link, '^https?://([^/?#]+)', 1) AS host FROM (SELECT page_id, CASE WHEN h LIKE 'http%' THEN h WHEN h LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h END AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS h FROM pages)) WHERE link IS NOT NULL""")
def c17(t):
    return C.extract_links(t.pages, "page_id", "url", "html")


@query("c19_rank_filing_documents", "SELECT company_id, primary_document, place FROM (SELECT company_id, primary_document, row_number() OVER (PARTITION BY company_id ORDER BY CASE WHEN regexp_matches(primary_document, 'ex[-_]?99|press|release') THEN 0 WHEN regexp_matches(primary_document, '10-?[qk]|20-?f|6-?k') THEN 1 WHEN regexp_matches(primary_document, '\\.html?$') THEN 2 ELSE 3 END, primary_document) AS place FROM filings) WHERE place <= 6")
def c19(t):
    return C.rank_filing_documents(t.filings, ("company_id",), "primary_document").select("company_id", "primary_document", "place")


@query("c20_labelled_numbers", """SELECT doc_id, label, i AS place, nums[i + 1] AS number FROM (SELECT *, unnest(range(len(nums))) AS i FROM (SELECT doc_id, label, regexp_extract_all(unnest(runs), '([0-9][0-9,.]*)', 1) AS nums FROM (
  SELECT doc_id, 'call' AS label, regexp_extract_all(lower(text), '\\bcall\\b((?:[^0-9a-z]{1,3}[0-9][0-9,.]*){1,4})', 1) AS runs FROM documents UNION ALL SELECT doc_id, 'version', regexp_extract_all(lower(text), '\\bversion\\b((?:[^0-9a-z]{1,3}[0-9][0-9,.]*){1,4})', 1) FROM documents)))""")
def c20(t):
    return C.labelled_numbers(t.documents, "doc_id", "text", ("call", "version"))
