"""Period columns of a text page: quarters named in its first lines, in pipe grids, fiscal headers, dated spans, Chinese headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterlode.operators.phases import bound

# Fixed values. Months, what names a span, quarters in words.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SPANS = ((("quarterended", "threemonthsended"), 1), (("sixmonthsended",), 2), (("ninemonthsended",), 3), (("yearended", "twelvemonthsended"), 4))
QUARTER_NAMES = (("first", 1), ("1st", 1), ("q1", 1), ("second", 2), ("2nd", 2), ("q2", 2), ("third", 3), ("3rd", 3), ("q3", 3), ("fourth", 4), ("4th", 4), ("q4", 4))
CJK_SPANS = (("3", 1), ("三", 1), ("6", 2), ("六", 2), ("9", 3), ("九", 3), ("12", 4), ("十二", 4))
PERIODS = "array<struct<q_index:int,span:int>>"
_MONTH = "|".join(MONTHS)


def _all(text: Column, pattern: str, *groups: int) -> Column:
    """Matches in order: of one group their texts, of several structs g0, g1, …"""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    return parts[0] if len(parts) == 1 else F.arrays_zip(*(p.alias(f"g{i}") for i, p in enumerate(parts)))


def _key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^0-9a-z一-鿿]+", "")


def _period(year: Column, quarter: Column, span: Column | int = 1) -> Column:
    return F.struct((year * 4 + quarter - 1).cast("int").alias("q_index"), (F.lit(span) if isinstance(span, int) else span).cast("int").alias("span"))


def _named(table: Sequence[tuple[str, int]], c: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table for x in kv))[c]


def _full_year(c: Column) -> Column:
    return F.when(c.cast("int") >= 100, c.cast("int")).otherwise(2000 + c.cast("int"))


def _span(c: Column) -> Column:
    key = _key(c)
    return F.coalesce(*(F.when(F.regexp_like(key, F.lit("|".join(words))), n) for words, n in SPANS))


def _month_quarter(label: Column) -> Column:
    return F.ceil(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(label, r"[A-Za-z]+", 0))) / 3)


def grid_periods(lines: Column) -> Column:
    """Of a pipe grid: the first row that names spans and the three behind it; years are dealt to the spans in order, as
    evenly as they go, each span having its own day or the last one named."""
    rows = F.transform(F.filter(F.slice(lines, 1, 16), lambda x: x.contains("|")), lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c)))

    def told(r: Column) -> Column:
        spans = F.transform(r, lambda cells: F.array_compact(F.transform(cells, _span)))
        at = F.array_position(F.transform(spans, lambda s: F.size(s) > 0), True)
        cells = F.flatten(F.slice(r, F.greatest(at, F.lit(1)).cast("int"), F.lit(4)))
        days = F.flatten(F.transform(cells, lambda c: _all(c, rf"(?i)({_MONTH})\s+\d{{1,2}}", 0)))
        years = F.flatten(F.transform(cells, lambda c: _all(c, r"\b(20\d{2})\b", 1)))
        parts = F.struct(F.get(spans, (at - 1).cast("int")).alias("s"), days.alias("d"), years.alias("y"))
        return F.when(at > 0, bound(parts, dealt)).otherwise(F.array().cast(PERIODS))

    def dealt(p: Column) -> Column:
        n = F.size(p["s"])

        def step(st: Column, i: Column) -> Column:
            some = F.greatest(F.floor((F.size(p["y"]) - st["at"]) / (n - i)), F.lit(1)).cast("int")
            day = F.get(p["d"], F.least(i, F.size(p["d"]) - 1))
            mine = F.transform(F.slice(p["y"], st["at"] + 1, some), lambda y: _period(y.cast("int"), _month_quarter(day), F.get(p["s"], i)))
            return F.struct((st["at"] + some).cast("int").alias("at"), F.concat(st["out"], mine.cast(PERIODS)).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(PERIODS).alias("out"))
        made = F.array_distinct(F.aggregate(F.sequence(F.lit(0), n - 1), begin, step, lambda st: st["out"]))
        return F.when((F.size(p["d"]) > 0) & (F.size(p["y"]) > 0) & (F.size(p["y"]) >= n), made).otherwise(F.array().cast(PERIODS))

    return bound(rows, told)


def quarter_periods(lines: Column) -> Column:
    """'Q1 2024', '1Q24' and '2024 Q1' in the first twelve lines, each quarter once."""
    a = lambda x: F.transform(_all(x, r"\bQ([1-4])\s+(\d{4})\b", 1, 2), lambda m: _period(m["g1"].cast("int"), m["g0"].cast("int")))
    b = lambda x: F.transform(_all(x, r"(?i)\b([1-4])Q(?:\s*|[-/']?)(\d{2,4})\b", 1, 2), lambda m: _period(_full_year(m["g1"]), m["g0"].cast("int")))
    c = lambda x: F.transform(_all(x, r"(?i)\b(\d{4})\s*Q([1-4])\b", 1, 2), lambda m: _period(m["g0"].cast("int"), m["g1"].cast("int")))
    return F.array_distinct(F.flatten(F.transform(F.slice(lines, 1, 12), lambda x: F.concat(a(x), b(x), c(x)))))


def fiscal_periods(lines: Column) -> Column:
    """Fiscal quarters of fiscal years, by the day that the year ends on: 'Q2 YTD' for every year (an annual page: the last
    one), else the quarters named in words or numbers, four to a year."""
    head = F.array_join(F.slice(lines, 1, 20), " ")
    ended = rf"(?i)(?:years?|fiscal year)\s+ended\s+({_MONTH})\s+\d{{1,2}}"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(head, ended, 1)))
    years = F.array_distinct(F.flatten(F.transform(F.slice(lines, 1, 20), lambda x: F.transform(_all(x, r"(?i)\b(?:FY|Fiscal\s+Year)\s*[' ]?(\d{2,4})\b", 1), _full_year))))
    named = F.create_map(*(F.lit(x) for kv in QUARTER_NAMES for x in kv))
    words = r"(?i)\b(first|second|third|fourth|1st|2nd|3rd|4th|q[1-4])\s+quarter\b"

    def quarters(x: Column, i: Column, every: Column) -> Column:
        alone = F.when(_key(F.coalesce(F.get(every, i + 1), F.lit(""))) == "quarter", named[_key(x)])
        one = F.coalesce(alone, F.when(_key(x).endswith("quarter"), named[F.regexp_replace(_key(x), "quarter$", "")]))
        return F.when(one.isNotNull(), F.array(one)).otherwise(F.transform(_all(x, words, 1), lambda w: named[F.lower(w)]))

    said = bound(F.slice(lines, 1, 20), lambda every: F.flatten(F.transform(every, lambda x, i: quarters(x, i, every))))
    whole = F.struct(month.cast("int").alias("m"), years.alias("y"), F.regexp_extract(head, r"(?i)\bQ([1-4])\s*YTD\b", 1).try_cast("int").alias("ytd"), said.alias("q"), F.lower(F.array_join(F.slice(lines, 1, 4), " ")).contains("annual").alias("annual"))

    def told(f: Column) -> Column:
        # The month that a fiscal quarter ends in, counted from year 0.
        def at(year: Column, quarter: Column, span: Column) -> Column:
            months = year * 12 + f["m"] - 1 - (4 - quarter) * 3
            return F.struct((F.floor(months / 12) * 4 + F.floor(F.pmod(months, F.lit(12)) / 3)).cast("int").alias("q_index"), span.cast("int").alias("span"))

        chosen = F.when(f["annual"], F.slice(f["y"], F.greatest(F.size(f["y"]), F.lit(1)), F.lit(1))).otherwise(f["y"])
        ytd = F.transform(chosen, lambda y: at(y, f["ytd"], f["ytd"]))
        each = F.flatten(F.transform(f["y"], lambda y, i: F.transform(F.slice(f["q"], i * 4 + 1, F.lit(4)), lambda q: at(y, q, F.lit(1)))))
        return F.when((f["m"] > 0) & (F.size(f["y"]) > 0), F.when(f["ytd"].isNotNull(), ytd).otherwise(each)).otherwise(F.array().cast(PERIODS))

    return bound(whole, told)


def dated_periods(lines: Column) -> Column:
    """The first of twelve lines that names a span, has a day in it or the next line and years in it or the next three: the
    first two years."""

    def line(x: Column, i: Column) -> Column:
        near = F.array_join(F.slice(lines, i + 1, F.lit(4)), " ")
        day = F.regexp_extract(F.array_join(F.slice(lines, i + 1, F.lit(2)), " "), rf"(?i)({_MONTH})\s+\d{{1,2}}", 0)
        made = F.transform(F.slice(_all(near, r"\b(20\d{2})\b", 1), 1, 2), lambda y: _period(y.cast("int"), _month_quarter(day), _span(x)))
        return F.when(_span(x).isNotNull() & (day != ""), made.cast(PERIODS)).otherwise(F.array().cast(PERIODS))

    return F.coalesce(F.get(F.filter(F.transform(F.slice(lines, 1, 12), line), lambda p: F.size(p) > 0), F.lit(0)), F.array().cast(PERIODS))


def chinese_periods(lines: Column) -> Column:
    """Spans up to a day, else ranges of months that are a quarter."""
    head = F.array_join(F.slice(lines, 1, 24), " ")
    upto = _all(head, r"截至\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(?:\d{1,2})\s*日止\s*(12|[369]|十二|三|六|九)\s*个月期间", 1, 2, 3)
    spans = F.transform(upto, lambda m: _period(m["g0"].cast("int"), F.ceil(m["g1"].cast("int") / 3), _named(CJK_SPANS, m["g2"])))
    ranges = _all(head, r"(\d{4})\s*年\s*(\d{1,2})\s*[-至]\s*(\d{1,2})\s*月", 1, 2, 3)
    whole = F.filter(ranges, lambda m: (m["g2"].cast("int") % 3 == 0) & (m["g1"].cast("int") == m["g2"].cast("int") - 2) & m["g2"].cast("int").between(3, 12))
    months = F.transform(whole, lambda m: _period(m["g0"].cast("int"), m["g2"].cast("int") / 3))
    return F.when(F.size(spans) > 0, spans).otherwise(months)


def inferred_periods(lines: Column, report_year: Column, report_quarter: Column) -> Column:
    """An income statement of a Chinese report that counts from the year's start: the report's quarter and that of the year
    before, as far as the report goes."""
    head = F.array_join(F.slice(lines, 1, 40), " ")
    said = head.rlike("利润表|损益表") & head.rlike("年初到报告期末|年初至报告期末|本期发生额") & (report_year > 0) & (report_quarter > 0)
    both = F.array(_period(report_year, report_quarter, report_quarter), _period(report_year - 1, report_quarter, report_quarter))
    return F.when(F.coalesce(said, F.lit(False)), both).otherwise(F.array().cast(PERIODS))


def page_periods(pages: DataFrame, keys: Sequence[str], text: str = "text", report_year: Column | None = None, report_quarter: Column | None = None) -> DataFrame:
    """(keys, pos, q_index, span): the period columns of text pages, by the first rule that finds any. Null text has none."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    none = F.lit(None).cast("int")
    l = F.col("_l")  # noqa: E741
    rules = [grid_periods(l), quarter_periods(l), fiscal_periods(l), dated_periods(l), chinese_periods(l), inferred_periods(l, none if report_year is None else report_year, none if report_quarter is None else report_quarter)]
    found = F.coalesce(*(bound(r.cast(PERIODS), lambda p: F.when(F.size(p) > 0, p)) for r in rules))
    return pages.withColumn("_l", lines).select(*keys, F.posexplode(found).alias("pos", "p")).select(*keys, "pos", "p.*")
