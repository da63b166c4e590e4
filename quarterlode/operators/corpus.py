"""Figures out of document tables: cells, numbers, units, links. Documents are rows; every rule is a column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterlode.operators.phases import bound

# Fixed values. Words of document names and links, by how much they promise.
RESULT_WORDS = ("result", "earn", "quarter", "financial-supplement", "supplement", "stat-book")
RELEASE_WORDS = ("release", "financial")
TALK_WORDS = ("transcript", "presentation", "slides", "roadshow", "webcast", "overview", "policy", "codeconduct")
OTHER_WORDS = ("proxy", "annual-report", "annual+report", "presentation", "icr", "conference", "webcast")

ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def strip_tags(html: Column) -> Column:
    """Text of a piece of HTML: tags become blanks, the common entities signs, white space single."""
    text = F.regexp_replace(html, r"<[^>]+>", " ")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_cells(docs: DataFrame, doc_id: str = "doc_id", html: str = "html") -> DataFrame:
    """(doc, table_no, row_no, cell_no, text) of all tables; empty cells go, a lone ')' or '%' joins the cell before it."""
    every = lambda text, pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    tables = docs.select(F.col(doc_id), F.posexplode(every(F.col(html), r"(?is)<table\b.*?</table>", 0)).alias("table_no", "t"))
    rows = tables.select(doc_id, "table_no", F.posexplode(every(F.col("t"), r"(?is)<tr\b.*?</tr>", 0)).alias("row_no", "r"))
    texts = F.filter(F.transform(every(F.col("r"), r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>", 1), strip_tags), lambda c: c != "")
    glue = lambda acc, c: F.when(c.isin(")", "%") & (F.size(acc) > 0), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, F.lit(-1)), c)))).otherwise(F.concat(acc, F.array(c)))
    cells = F.aggregate(texts, F.array().cast("array<string>"), glue)
    return rows.select(doc_id, "table_no", "row_no", F.posexplode(cells).alias("cell_no", "text"))


def parse_number(text: Column) -> Column:
    """Number of a cell: parentheses are negative; dashes, commas, signs and single letters are dropped; else null."""
    t = F.translate(text, "−–—", "---")
    t = F.regexp_replace(F.regexp_replace(t, r"\b[a-zA-Z]\b", " "), r"[^0-9().\-]+", "")
    value = lambda x: F.regexp_replace(x, r"^[()]+|[()]+$", "").try_cast("double")
    return bound(t, lambda x: F.when(x.isin("", "-", ".", "()"), F.lit(None)).when(F.startswith(x, F.lit("(")) & F.endswith(x, F.lit(")")), -value(x)).otherwise(value(x)))


def unit_scale(header: Column, largest: Column) -> Column:
    """Scale that a header names; where it is silent that which the largest figure suggests."""
    h = F.lower(header)
    named = F.when(F.contains(h, F.lit("billions")), 1_000_000_000).when(F.contains(h, F.lit("millions")), 1_000_000).when(F.contains(h, F.lit("thousands")), 1_000)
    return F.coalesce(named, F.when(largest >= 100_000, 1_000).when(largest >= 100, 1_000_000).otherwise(1)).cast("long")


def low_signal_docs(pages: DataFrame, doc_id: str, page_no: str, text: str, first: int = 6, least: int = 80) -> DataFrame:
    """Documents of whose first pages at least half hold fewer than `least` signs."""
    signs = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", ""))
    n = pages.where(F.col(page_no) < first).groupBy(doc_id).agg(F.count(F.lit(1)).alias("pages"), F.count_if(signs < least).alias("thin"))
    return n.withColumn("low_signal", F.col("thin") * 2 >= F.col("pages"))


def _has(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def link_rank(url: Column) -> Column:
    """Topic, latest year and quarter named, then PDF first: the smaller the better."""
    u = F.lower(url)
    topic = F.when(_has(u, RESULT_WORDS), 0).when(_has(u, RELEASE_WORDS), 1).otherwise(2) + F.when(_has(u, TALK_WORDS), 4).otherwise(0) + F.when(_has(u, OTHER_WORDS), 3).otherwise(0)
    top = lambda pattern: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(u, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))), F.lit(0))
    return F.struct(topic.alias("topic"), (-top(r"\b(20\d{2})\b")).alias("year"), (-top(r"\bq([1-4])\b")).alias("quarter"), F.when(u.rlike(r"\.pdf($|\?)"), 0).otherwise(1).alias("kind"))


def extract_links(docs: DataFrame, doc_id: str, url: str, html: str) -> DataFrame:
    """(doc, link, host): distinct absolute links of a page, relative ones completed with its own host."""
    at = docs.select(doc_id, F.regexp_extract(url, r"^(https?://[^/?#]+)", 1).alias("_base"), F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"#]+)"'), F.lit(1)))).alias("_h"))
    link = F.when(F.startswith("_h", F.lit("http")), F.col("_h")).when(F.startswith("_h", F.lit("/")), F.concat("_base", "_h"))
    return at.withColumn("link", link).where("link is not null").select(doc_id, "link", F.regexp_extract("link", r"^https?://([^/?#]+)", 1).alias("host")).distinct()


def rank_filing_documents(names: DataFrame, keys: Sequence[str], name: str, most: int = 6) -> DataFrame:
    """The first documents of each filing: statements and releases before the rest, then by name."""
    from pyspark.sql import Window

    n = F.lower(F.col(name))
    order = F.when(n.rlike(r"ex[-_]?99|press|release"), 0).when(n.rlike(r"10-?[qk]|20-?f|6-?k"), 1).when(n.rlike(r"\.html?$"), 2).otherwise(3)
    return names.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order, name))).where(F.col("place") <= most)


def labelled_numbers(docs: DataFrame, doc_id: str, text: str, labels: Sequence[str]) -> DataFrame:
    """(doc, label, place, number): up to four numbers that follow a label in a text."""
    found = F.array(*(F.struct(F.lit(w).alias("label"), F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"\b{w}\b((?:[^0-9a-z]{{1,3}}[0-9][0-9,.]*){{1,4}})"), F.lit(1)).alias("runs")) for w in labels))
    at = docs.select(doc_id, F.explode(found).alias("f")).select(doc_id, "f.label", F.explode("f.runs").alias("run"))
    return at.select(doc_id, "label", F.posexplode(F.regexp_extract_all("run", F.lit(r"([0-9][0-9,.]*)"), F.lit(1))).alias("place", "number"))
