"""Period entries out of document tables and text lines. A document's header rows are few and taken together; every rule
is a column expression, so a job has one shuffle by document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlode.operators.corpus import parse_number, unit_scale
from quarterlode.operators.phases import bound, once
from quarterlode.operators.taxonomy import label_key

# Fixed values. Keys of statement lines by field, in order; a label's key equals, begins or ends with one.
ROW_ALIASES = {
    "revenue": ("revenue", "revenues", "totalrevenue", "netrevenue", "netrevenues", "sales", "netsales", "salesrevenue", "totalnetrevenues", "营业收入", "主营业务收入", "收入", "销售收入"),
    "cost_of_revenue": ("costofrevenue", "costofrevenues", "costofsales", "costofgoodsold", "costofgoodssold", "costofproductsold", "costofservices", "costofservicesales", "营业成本", "销售成本", "主营业务成本"),
    "gross_profit": ("grossprofit", "毛利", "毛利润", "毛利额"),
    "sgna": ("sellinggeneralandadministrative", "sellinggeneraladministrative", "sellinggeneralandadministrativeexpenses", "sellinggeneralandadministrativeexpense", "销售及管理费用", "销售和管理费用"),
    "sales_marketing": ("salesandmarketing", "salesandmarketingexpense", "sellingandmarketing", "sellingexpense", "marketing", "marketingexpense", "销售费用", "营销费用", "销售及分销开支", "销售和市场费用"),
    "general_administrative": ("generalandadministrative", "generalandadministrativeexpense", "administrativeexpense", "administrativeexpenses", "管理费用", "一般及行政开支"),
    "rnd": ("researchanddevelopment", "researchanddevelopmentexpense", "researchdevelopmentexpense", "technologyandcontent", "研发费用", "研究及开发费用", "研究开发费用"),
    "fulfillment": ("fulfillment", "fulfillmentexpense", "履约费用"),
    "taxes_surcharges": ("taxesandsurcharges", "税金及附加"),
    "finance_expense": ("financeexpense", "财务费用", "净财务费用"),
    "operating_expenses": ("operatingexpenses", "totaloperatingexpenses", "costsandexpenses", "营业费用", "经营费用", "期间费用", "总营业费用"),
    "operating_income": ("operatingincome", "incomefromoperations", "incomelossfromoperations", "operatingprofit", "profitfromoperations", "营业利润", "经营利润"),
    "pretax_income": ("incomebeforetaxes", "incomebeforeincometaxes", "incomebeforetax", "pretaxincome", "profitbeforetax", "利润总额", "税前利润"),
    "tax": ("incometaxexpense", "incometaxexpenses", "provisionforincometaxes", "provisionforincometax", "taxexpense", "所得税费用"),
    "net_income": ("netincome", "netincomeloss", "profitloss", "netincomeattributabletoordinaryshareholders", "netincomelossattributabletoordinaryshareholders", "净利润", "本期净利润"),
}
ABSOLUTE = ("cost_of_revenue", "sgna", "sales_marketing", "general_administrative", "rnd", "fulfillment", "taxes_surcharges", "finance_expense", "operating_expenses", "tax")
# Fixed values. Phrases of period headers and the quarters they span; months; Chinese spans and quarters.
SPANS = (("threemonthsended|quarterended", 1), ("sixmonthsended", 2), ("ninemonthsended", 3), ("yearended|twelvemonthsended", 4))
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
CJK_SPAN = {"3": 1, "三": 1, "6": 2, "六": 2, "9": 3, "九": 3, "12": 4, "十二": 4}
CJK_QUARTER = {"一": 1, "二": 2, "三": 3, "四": 4, "1": 1, "2": 2, "3": 3, "4": 4}
CURRENCIES = ("USD", "EUR", "CNY", "RMB", "JPY", "TWD", "HKD", "GBP")
HEADERS = ("cost_of_revenue", "operating_expenses")
PERIOD = "array<struct<q_index:int,span:int>>"
HEADER_ROWS = 6


def _table(pairs: Mapping) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _date_quarter(date: Column, year: Column) -> Column:
    """Index of the quarter of a label like 'March 31' in a year; null where either is missing."""
    month = _table({m: i for i, m in enumerate(MONTHS)})[F.substring(F.lower(F.regexp_extract(date, r"([A-Za-z]{3,9})\s+(\d{1,2})", 1)), 1, 3)]
    y = F.regexp_extract(year, r"(\d{4})", 1).try_cast("int")
    return (y * 4 + F.floor(month / 3)).cast("int")


def match_field(label: Column, aliases: Mapping[str, Sequence[str]] = ROW_ALIASES) -> Column:
    """The first field one of whose keys the label's key equals, begins or ends with."""
    return bound(label_key(label), lambda key: F.coalesce(*(F.when(key.rlike(f"^(?:{'|'.join(a)})|(?:{'|'.join(a)})$"), f) for f, a in aliases.items())))


def match_fields(label: Column, aliases: Mapping[str, Sequence[str]] = ROW_ALIASES) -> Column:
    """All fields one of whose keys the label's key equals, begins or ends with."""
    return bound(label_key(label), lambda key: F.array_compact(F.array(*(F.when(key.rlike(f"^(?:{'|'.join(a)})|(?:{'|'.join(a)})$"), f) for f, a in aliases.items()))))


def period_columns(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, q_index, span): the periods of a table's columns, out of its first rows (row_no, cells).

    First rule that finds any: cells 'Q1 2024'; 'three (six, nine, twelve) months ended' over a row of years, the first
    two; Chinese cumulative periods; dates with a year in any cell."""
    item = F.struct("row_no", "cells")
    docs = rows.where(F.col("row_no") < HEADER_ROWS).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda r: r["cells"]).alias("_h"))
    return docs.select(*keys, F.posexplode(bound(F.col("_h"), _periods)).alias("pos", "p")).select(*keys, "pos", "p.*")


def _periods(rows: Column) -> Column:
    """The periods that header rows (arrays of cells) name; null if there are none."""
    cells = F.flatten(rows)
    plain = F.transform(F.filter(cells, lambda c: F.trim(c).rlike(r"^Q[1-4]\s+\d{4}$")), lambda c: F.struct((F.regexp_extract(c, r"(\d{4})", 1).cast("int") * 4 + F.regexp_extract(c, r"Q([1-4])", 1).cast("int") - 1).alias("q_index"), F.lit(1).alias("span")))

    def span_of(cell: Column) -> Column:
        return bound(label_key(cell), lambda k: F.coalesce(*(F.when(k.rlike(p), n) for p, n in SPANS)))

    def under(i: Column) -> Column:
        def of(x: Column) -> Column:
            """x: the first cell with a span, and the years of the next row."""
            made = F.transform(F.slice(x["years"], 1, 2), lambda y: F.struct(_date_quarter(x["head"], y).alias("q_index"), span_of(x["head"]).alias("span")))
            return F.when(x["head"].isNotNull() & (F.size(x["years"]) >= 2), F.filter(made, lambda p: p["q_index"].isNotNull()))

        head = F.get(F.filter(F.get(rows, i), lambda c: span_of(c).isNotNull()), F.lit(0))
        years = F.filter(F.transform(F.get(rows, i + 1), lambda c: F.regexp_extract(c, r"(\d{4})", 1)), lambda y: y != "")
        return bound(F.struct(head.alias("head"), years.alias("years")), of)

    below = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(rows) - 2, F.lit(0))), under), lambda p: F.size(p) > 0)
    cjk = r"截至\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(?:\d{1,2})\s*日止\s*(12|[369]|十二|三|六|九)\s*个月期间"

    def chinese(text: Column) -> Column:
        part = lambda i: F.regexp_extract_all(text, F.lit(cjk), F.lit(i))
        return F.transform(F.arrays_zip(part(1).alias("y"), part(2).alias("m"), part(3).alias("s")), lambda x: F.struct((x["y"].cast("int") * 4 + F.floor((x["m"].cast("int") - 1) / 3)).cast("int").alias("q_index"), _table(CJK_SPAN)[x["s"]].alias("span")))

    dates = F.filter(F.transform(cells, lambda c: F.struct(_date_quarter(c, c).alias("q_index"), F.lit(1).alias("span"))), lambda p: p["q_index"].isNotNull())
    some = lambda a: bound(a.cast(PERIOD), lambda x: F.when(F.size(x) > 0, x))
    return F.coalesce(some(plain), some(F.get(below, F.lit(0))), some(bound(F.array_join(cells, " "), chinese)), some(dates))


def row_series(cells: Column, count: Column, absolute: Column) -> Column:
    """The first `count` numbers of a row after its label; null if there are fewer. A small whole number before much
    larger ones is a footnote and skipped."""
    return bound(_numbers(cells), lambda v: _series(v, count, absolute))


def _numbers(cells: Column) -> Column:
    return F.filter(F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells), F.lit(1))), parse_number), lambda v: v.isNotNull())


def _series(numbers: Column, count: Column, absolute: Column) -> Column:
    def picked(values: Column) -> Column:
        first, rest = F.get(values, F.lit(0)), F.slice(values, F.lit(2), F.greatest(count, F.lit(1)))
        note = (F.size(values) > count) & (F.abs(first - F.round(first)) < 1e-9) & first.between(0, 999) & (F.array_max(F.transform(rest, lambda v: F.abs(v))) > F.greatest(F.abs(first) * 100, F.lit(10_000.0)))
        return F.when(F.coalesce(note, F.lit(False)), rest).otherwise(F.slice(values, F.lit(1), F.greatest(count, F.lit(1))))

    signless = F.transform(numbers, lambda v: F.when(absolute, F.abs(v)).otherwise(v))
    return bound(bound(signless, picked), lambda x: F.when((count > 0) & (F.size(x) >= count), x))


def table_entries(rows: DataFrame, keys: Sequence[str], fields: Sequence[str] = tuple(ROW_ALIASES)) -> DataFrame:
    """(keys, q_index, span, value_mode, fields) of tables (row_no, cells): periods from the header, the first row of each
    field, the unit from the header or the size of revenue; gross profit and operating expenses filled in by identity.

    A table whose revenue row is shorter than its header gives nothing, nor does a period without revenue above 1."""
    item = F.struct("row_no", "cells")
    docs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_r"))
    header = F.transform(F.filter("_r", lambda r: r["row_no"] < HEADER_ROWS), lambda r: r["cells"])
    lines = F.transform(F.filter("_r", lambda r: F.size(r["cells"]) > 1), lambda r: F.struct(match_fields(r["cells"][0]).alias("fields"), _numbers(r["cells"]).alias("numbers")))

    def entries(x: Column) -> Column:
        """x: the periods and the lines. Each field looks for its own first line, so a line may serve several."""
        first = lambda f: F.get(F.filter(x["lines"], lambda r: F.array_contains(r["fields"], f)), F.lit(0))["numbers"]
        series = F.struct(*(_series(first(f), F.size(x["periods"]), F.lit(f in ABSOLUTE)).alias(f) for f in fields))
        # Of columns of one period the first counts.
        periods = F.filter(F.transform(x["periods"], lambda p, i: F.struct(p["q_index"].alias("q_index"), p["span"].alias("span"), i.alias("pos"))), lambda p: F.array_position(x["periods"], F.struct(p["q_index"].alias("q_index"), p["span"].alias("span"))) == p["pos"] + 1)
        made = bound(series, lambda s: F.transform(periods, lambda p: F.struct(p["q_index"].alias("q_index"), p["span"].alias("span"), *(F.get(s[f], p["pos"]).alias(f) for f in fields))))
        return F.filter(made, lambda e: F.abs(e["revenue"]) >= 1)

    at = once(docs, _head=F.array_join(F.flatten(header), " "), _e=bound(F.struct(bound(header, _periods).alias("periods"), lines.alias("lines")), entries))
    scale = unit_scale(F.col("_head"), F.array_max(F.transform("_e", lambda e: F.abs(e["revenue"]))))
    wide = once(at, _s=scale).select(*keys, "_s", F.explode("_e").alias("e")).select(*keys, "_s", "e.*")
    gross = F.coalesce("gross_profit", F.col("revenue") - F.col("cost_of_revenue"))
    out = wide.withColumn("gross_profit", gross).withColumn("operating_expenses", F.coalesce("operating_expenses", F.col("gross_profit") - F.col("operating_income")))
    return out.select(*keys, "q_index", "span", F.when(F.col("span") == 1, "direct").otherwise("cumulative").alias("value_mode"), *((F.col(f) * F.col("_s")).cast("decimal(20,2)").alias(f) for f in fields))


def line_rows(pages: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, line_no, label, field, numbers): text lines as rows. A line without numbers takes in the next one or two
    until there are some, one with a single number the next one if that has any; of the readings of a line the one with
    most numbers, then the longest label. Words after the first number are passed over."""
    lines = pages.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line_no", "line"))
    w = Window.partitionBy(*keys).orderBy("line_no")
    tokens = lambda c: F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda x: x != "")
    number = r"^[(]?[-−–]?[$¥€£]?\d[\d,]*(?:\.\d+)?%?[)]?$"
    figures = lambda ts: F.filter(ts, lambda x: x.rlike(number))
    at = lines.withColumns({"_b": F.lead("line", 1).over(w), "_c": F.lead("line", 2).over(w)})

    def reading(ts: Column) -> Column:
        """A reading's tokens as (n, l, label, numbers): the words stand before the first number."""

        def told(ns: Column) -> Column:
            words = F.array_join(F.when(F.size(ns) > 0, F.slice(ts, F.lit(1), F.greatest(F.array_position(ts, ns[0]).cast("int") - 1, F.lit(0)))).otherwise(ts), " ")
            return bound(words, lambda x: F.struct(F.size(ns).alias("n"), F.length(x).alias("l"), F.regexp_replace(x, "[:：]+$", "").alias("label"), F.transform(ns, parse_number).alias("numbers")))

        return bound(figures(ts), told)

    def readings(x: Column) -> Column:
        """x: the tokens of the line and of the next two. Those of joined lines are theirs one behind the other."""
        n, nb, nc = (F.size(figures(x[c])) for c in "abc")
        two, three = F.concat(x["a"], x["b"]), F.concat(x["a"], x["b"], x["c"])
        joined = lambda k: F.array_compact(F.array(x["a"], F.when((k["n"] == 0) & (k["nb"] > 0), two), F.when((k["n"] == 0) & x["more"] & (k["nb"] + k["nc"] > 0), three), F.when((k["n"] == 1) & (k["nb"] > 0), two)))
        return F.transform(bound(F.struct(n.alias("n"), nb.alias("nb"), nc.alias("nc")), joined), reading)

    def best(parsed: Column) -> Column:
        # A line that names costs or operating expenses alone is a header and takes in nothing.
        bare = F.filter(parsed, lambda p: (p["n"] == 0) & F.coalesce(match_field(p["label"]).isin(*HEADERS), F.lit(False)))
        return bound(bare, lambda h: F.when(F.size(h) > 0, F.get(h, F.lit(0))).otherwise(F.array_max(F.filter(parsed, lambda p: p["label"] != ""))))

    none = F.lit("")
    x = F.struct(tokens(F.col("line")).alias("a"), tokens(F.coalesce("_b", none)).alias("b"), tokens(F.coalesce("_c", none)).alias("c"), F.col("_c").isNotNull().alias("more"))
    at = once(at, _best=bound(bound(x, readings), best)).where("_best is not null")
    at = once(at, field=match_field(F.col("_best.label"))).select(*keys, "line_no", F.col("_best.label").alias("label"), "field", F.col("_best.numbers").alias("numbers"), "line")
    return at.where((F.size("numbers") > 0) | F.trim("line").endswith(":") | F.coalesce(F.col("field").isin(*HEADERS), F.lit(False))).drop("line")


def document_context(pages: DataFrame, doc: str, page_no: str, text: str, first: int = 6) -> DataFrame:
    """(doc, report_type, report_year, report_quarter, currency): what the cover pages say; documents without a report
    title have null for it, without a currency USD."""
    item = F.struct(F.col(page_no).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    cover = pages.where(F.col(page_no) < first).groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda p: p["t"]), " ").alias("_t"))
    t = F.col("_t")
    year = F.regexp_extract(t, r"(\d{4})\s*年", 1)
    quarter = F.regexp_extract(t, r"(\d{4})\s*年\s*第?\s*([一二三四1-4])\s*季度报告", 2)
    has = lambda what: F.regexp_like(t, F.concat(year, F.lit(rf"\s*年\s*{what}")))
    kind = F.when(year == "", None).when(has(r"第?\s*[一二三四1-4]\s*季度报告"), "quarterly").when(has("半年度报告"), "half-year").when(has("年度报告"), "annual")
    number = F.when(kind == "quarterly", _table(CJK_QUARTER)[F.nullif(quarter, F.lit(""))]).when(kind == "half-year", 2).when(kind == "annual", 4)
    money = F.coalesce(*(F.when(F.upper(t).contains(c), "CNY" if c == "RMB" else c) for c in CURRENCIES), F.lit("USD"))
    return cover.select(doc, kind.alias("report_type"), F.when(kind.isNotNull(), year.try_cast("int")).alias("report_year"), number.alias("report_quarter"), money.alias("currency"))


# Fixed values. Fields that a statement begins with, and those that its continuation has.
OPENING = ("revenue", "cost_of_revenue", "gross_profit", "operating_income", "sales_marketing", "general_administrative", "rnd")
CLOSING = ("pretax_income", "tax", "net_income")


def usable_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages of four lines or more that are neither of one segment (by their last eight lines) nor a reconciliation of
    other measures (by their first twenty)."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    at = pages.withColumn("_l", lines).where(F.size("_l") >= 4)
    foot = F.lower(F.array_join(F.slice("_l", F.greatest(F.size("_l") - 7, F.lit(1)), F.lit(8)), " "))
    head = F.lower(F.array_join(F.slice("_l", 1, 20), " "))
    segment = foot.rlike(r"\b(segment|division|business unit)\b") & ~foot.rlike(r"\b(segments|segment information|segment data)\b")
    other = head.contains("reconciliations of non-gaap financial measures") | head.contains("impact per diluted share")
    return at.where(~segment & ~other).drop("_l")


def carry_columns(pages: DataFrame, keys: Sequence[str], page_no: str, columns: str = "columns", fields: str = "fields") -> DataFrame:
    """Pages with their period columns: their own, or those of the last page of the document that had any, if the page's
    fields are those of a statement's end and none of its beginning. Pages without either go."""
    own = F.when(F.size(columns) > 0, F.col(columns))
    last = F.last(own, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(page_no).rowsBetween(Window.unboundedPreceding, -1))
    has = lambda names: F.arrays_overlap(F.col(fields), F.array(*map(F.lit, names)))
    follows = F.coalesce(has(CLOSING) & ~has(OPENING), F.lit(False))
    return pages.withColumns({"_last": last, "_own": own}).withColumn(columns, F.coalesce("_own", F.when(follows, F.col("_last")))).where(F.col(columns).isNotNull()).drop("_last", "_own")
