"""Period algebra on columns. A quarter is a string YYYYQn; its index is year * 4 + n - 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARTER = r"^(\d{4})Q([1-4])$"


def calendar_quarter(day: Column) -> Column:
    """Quarter of a date."""
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def q_index(quarter: Column) -> Column:
    """Index of a quarter; null for what is no quarter."""
    year, n = (F.regexp_extract(quarter, QUARTER, i) for i in (1, 2))
    return F.when(quarter.rlike(QUARTER), year.try_cast("int") * 4 + n.try_cast("int") - 1)


def q_sort_key(quarter: Column) -> Column:
    """Index for ordering: what is no quarter comes first, as 0."""
    return F.coalesce(q_index(quarter), F.lit(0))


def q_name(index: Column) -> Column:
    return F.concat(F.floor(index / 4).cast("string"), F.lit("Q"), (F.pmod(index, F.lit(4)) + 1).cast("string"))


def q_shift(quarter: Column, n: int) -> Column:
    return q_name(q_index(quarter) + n)


def quarter_window(quarter: Column, n: int) -> Column:
    """The n quarters that end at a quarter, oldest first."""
    last = q_index(quarter)
    return F.transform(F.sequence(last - (n - 1), last), q_name)


def quarter_end(quarter: Column) -> Column:
    at = q_index(quarter)
    return F.last_day(F.make_date(F.floor(at / 4).cast("int"), (F.pmod(at, F.lit(4)) * 3 + 3).cast("int"), F.lit(1)))


def day_span(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def fiscal_quarter(period: Column, span: Column) -> Column:
    """Q1-Q4 as given, FY is Q4, anything else goes by the length of the period; empty if too short."""
    p = F.upper(F.coalesce(period, F.lit("")))
    by_span = F.when(span >= 311, "Q4").when(span >= 211, "Q3").when(span >= 120, "Q2").otherwise("")
    return F.when(p.isin("Q1", "Q2", "Q3", "Q4"), p).when(p == "FY", "Q4").otherwise(by_span)


def fiscal_period_end(year: Column, quarter: Column, month: Column, day: Column) -> Column:
    """End of fiscal quarter n (1-4) when the fiscal year ends on month/day; the day is kept within the month."""
    year_end = F.make_date(year, month, F.lit(1))
    start = F.add_months(year_end, (quarter - 4) * 3)
    return F.date_add(start, F.least(day, F.day(F.last_day(start))) - 1)


def q_distance(a: Column, b: Column) -> Column:
    return F.abs(q_index(a) - q_index(b))


def reporting_cycle(quarter: Column) -> Column:
    n = F.pmod(q_index(quarter), F.lit(4)) + 1
    return F.when(n == 4, "annual").when(n == 2, "half-year").otherwise("quarterly")
