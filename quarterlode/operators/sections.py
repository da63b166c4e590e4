"""Items of a statement page between a section's title and its total, and the summary lines of a results release."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlode.operators.boxes import SCALED
from quarterlode.operators.phases import bound, once

# Fixed values. Titles and totals of the sections, fields and label parts that end them.
TITLES = {
    "cost": ("costofrevenue", "costofrevenues", "costofsales", "营业成本", "销售成本", "主营业务成本"),
    "opex": ("operatingexpenses", "operatingexpense", "营业费用", "经营费用", "期间费用", "总营业费用"),
}
TOTALS = {"cost": ("totalcostofrevenue", "totalcostofrevenues", "totalcostofsales", *TITLES["cost"]), "opex": ("totaloperatingexpenses", *TITLES["opex"])}
STOP_FIELDS = ("revenue", "cost_of_revenue", "gross_profit", "operating_expenses", "operating_income", "pretax_income", "tax", "net_income")
STOP_WORDS = ("earningsper", "dilutedeps", "basiceps", "dividendsdeclared", "weightedaverage", "sharesoutstanding")


def _key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^0-9a-z一-鿿]+", "")


def section_items(rows: DataFrame, keys: Sequence[str], section: str, count: Column, titles: Sequence[str] | None = None, totals: Sequence[str] | None = None) -> DataFrame:
    """(keys, line_no, label, numbers): the items of a section of a page.

    rows: line_no, label, field, numbers. The section begins at the last line that is its title and has no numbers before
    the first total behind such a line (a title with numbers is one); it ends at the next total, a stop field or a label
    about shares. Items have `count` numbers at least; totals and labels met before are passed over."""
    titles, totals = titles or TITLES[section], totals or TOTALS[section]
    w = Window.partitionBy(*keys)
    at = rows.withColumn("_key", _key(F.coalesce("label", F.lit(""))))
    title, total = F.col("_key").isin(*titles), F.col("_key").isin(*totals)
    head = title & (F.coalesce(F.size("numbers"), F.lit(0)) <= 0)
    line = F.col("line_no")
    at = at.withColumn("_first", F.min(F.when(head, line)).over(w))
    at = at.withColumn("_closed", F.min(F.when(total & ~head & (line > F.col("_first")), line)).over(w))
    at = at.withColumn("_start", F.max(F.when(head & (F.col("_closed").isNull() | (line < F.col("_closed"))), line)).over(w))
    stop = total | F.coalesce(F.col("field").isin(*STOP_FIELDS), F.lit(False)) | F.regexp_like("_key", F.lit("|".join(STOP_WORDS)))
    at = at.withColumn("_end", F.min(F.when(stop & (line > F.col("_start")), line)).over(w))
    inside = (line > F.col("_start")) & (F.col("_end").isNull() | (line < F.col("_end")))
    items = at.where(inside & (F.size("numbers") >= count) & ~F.col("_key").startswith("total") & ~title)
    first = F.row_number().over(Window.partitionBy(*keys, "_key").orderBy("line_no"))
    return items.withColumn("_r", first).where("_r = 1").select(*keys, "line_no", "label", "numbers")


def breakdown_items(rows: DataFrame, keys: Sequence[str], section: str, count: Column, scale: Column) -> DataFrame:
    """(keys, column, name, value): a section's items by period column, without sign; zeros are left out."""
    items = section_items(rows.withColumns({"_count": count, "_scale": scale}), keys, section, F.col("_count"))
    per = rows.select(*keys, count.alias("_count"), scale.alias("_scale")).distinct()
    at = items.join(per, list(keys)).select(*keys, "label", "_scale", F.posexplode(F.slice("numbers", F.lit(1), F.col("_count"))).alias("column", "value"))
    return at.where(F.coalesce(F.abs("value") > 0, F.lit(False)) & (F.trim("label") != "")).select(*keys, "column", F.trim("label").alias("name"), (F.abs("value") * F.col("_scale")).alias("value"))


# Fixed values. What the header of a results release says, its summary rows, and quarters in words.
RELEASE = ("financial results for the quarter ended", "results for the quarter ended", "consolidated results for the quarter ended")
SUMMARY_ROWS = {"revenue": "revenue", "operating income": "operating_income", "net income": "net_income"}
QUARTER_WORDS = (("first quarter", 1), ("1st quarter", 1), ("q1", 1), ("second quarter", 2), ("2nd quarter", 2), ("q2", 2), ("third quarter", 3), ("3rd quarter", 3), ("q3", 3), ("fourth quarter", 4), ("4th quarter", 4), ("q4", 4))
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
HEADER_LINES, SUMMARY_PAGES = 40, 3


def scaled_values(line: Column) -> Column:
    """Amounts with 'million' or 'billion' (letters may stand apart): the first of each cell behind the first if two or more
    cells have one, else all of the line."""
    found = lambda c: F.transform(F.regexp_extract_all(c, F.lit(SCALED), F.lit(0)), amount)
    amount = lambda m: F.replace(F.regexp_extract(m, r"\d[\d,]*(?:\.\d+)?", 0), F.lit(",")).cast("double") * F.when(F.regexp_like(m, F.lit(r"(?i)b\s*i\s*l")), 1e9).otherwise(1e6)
    cells = bound(F.split(line, r"\|"), lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1))))
    first = F.array_compact(F.transform(cells, lambda c: F.get(found(c), F.lit(0))))
    return F.when(line.contains("|"), bound(first, lambda x: F.when(F.size(x) >= 2, x).otherwise(found(line)))).otherwise(found(line))


def _beginning(lines: str, prefix: str) -> Column:
    return F.filter(lines, lambda x: F.lower(x).startswith(prefix))


def release_summary(pages: DataFrame, doc: str, page_no: str = "page_no", text: str = "text", filing_date: str = "filing_date") -> DataFrame:
    """(doc, page_no, q_index, fiscal_year, fiscal_quarter, revenue, operating_income, net_income) of the quarter and that of the year
    before: what the summary on one of the first pages of a results release says.

    The header (40 lines) must name the quarter, the day it ended on and two fiscal years; rows need three amounts, of which
    the first is this quarter's and the third last year's. The year is that of the release's date, else of the filing."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    at = once(pages.where(F.col(page_no) < SUMMARY_PAGES).select(doc, page_no, filing_date, text), _l=lines).drop(text)
    at = once(at, _h=F.array_join(F.slice("_l", 1, HEADER_LINES), " "))
    at = once(at, _low=F.lower("_h"))
    low, months = F.col("_low"), "|".join(MONTHS)
    told = F.lit(False)
    for phrase in RELEASE:
        told = told | low.contains(phrase)
    fiscal = F.transform(F.regexp_extract_all("_h", F.lit(r"(?i)Fiscal\s+(20\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    quarter = F.coalesce(*(F.when(low.contains(w), q) for w, q in QUARTER_WORDS))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, rf"quarter ended\s+({months})\s+(\d{{1,2}})", 1))
    at = once(at.where(told), _f=fiscal, _q=quarter, _m=month).where((F.size("_f") >= 2) & F.col("_q").isNotNull() & (F.col("_m") > 0))
    year = F.coalesce(F.regexp_extract(low, rf"(?:{months})\s+\d{{1,2}},\s*(20\d{{2}})", 1).try_cast("int"), F.year(filing_date), F.get("_f", F.lit(0)))
    # The last line of three amounts decides, as later lines replace earlier ones.
    amounts = lambda prefix: bound(F.filter(F.transform(_beginning("_l", prefix), scaled_values), lambda v: F.size(v) >= 3), lambda x: F.when(F.size(x) > 0, F.element_at(x, -1)))
    at = once(at, _y=year, **{field: amounts(prefix) for prefix, field in SUMMARY_ROWS.items()})
    q_index = (F.col("_y") * 4 + F.floor((F.col("_m") - 1) / 3)).cast("int")
    entry = lambda back, i: F.struct((q_index - 4 * back).alias("q_index"), F.get("_f", F.lit(back)).alias("fiscal_year"), F.col("_q").alias("fiscal_quarter"), *(F.get(f, F.lit(i)).alias(f) for f in SUMMARY_ROWS.values()))
    both = at.select(doc, page_no, F.explode(F.array(entry(0, 0), entry(1, 2))).alias("e")).select(doc, page_no, "e.*")
    return both.where(F.coalesce(*SUMMARY_ROWS.values()).isNotNull())
