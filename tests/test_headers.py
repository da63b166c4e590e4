"""Period columns of text pages: a page for each branch of each rule, with the periods that it must give."""

import pytest
from pyspark.sql import functions as F

from quarterlode.operators import headers

q = lambda y, n, span=1: (y * 4 + n - 1, span)
PAGES = {
    "grid": ("Income | Three Months Ended | Nine Months Ended\n | September 30, | September 30,\n | 2024 | 2023 | 2024 | 2023", [q(2024, 3), q(2023, 3), q(2024, 3, 3), q(2023, 3, 3)]),
    "grid, own days": ("x | Quarter ended | Year ended\n | March 31 | December 31\n | 2024 | 2023", [q(2024, 1), q(2023, 4, 4)]),
    "grid, years uneven": ("x | Three months ended | Six months ended\n | June 30 |\n 2024 | 2023 | 2022", [q(2024, 2), q(2023, 2, 2), q(2022, 2, 2)]),
    "grid without years": ("x | Three months ended\n | June 30\nQ2 2024", [q(2024, 2)]),
    "quarters": ("Q1 2024 Q1 2023 and 2024 Q1\n4Q23 | 3Q2022 1Q'24", [q(2024, 1), q(2023, 1), q(2023, 4), q(2022, 3)]),
    "fiscal year to date": ("Statements\nFiscal year ended June 30\nQ2 YTD\nFY24 FY 2023", [q(2023, 4, 2), q(2022, 4, 2)]),
    "annual fiscal year to date": ("Annual\nYears ended June 30\nFY24 FY25\nQ4 YTD", [q(2025, 2, 4)]),
    "fiscal quarters": ("Fiscal year ended January 31\nFiscal Year 2024 Fiscal Year 2025\nFirst\nQuarter\nSecond Quarter\n3rd quarter and Q4 quarter\nfirst quarter", [q(2023, 2), q(2023, 3), q(2023, 4), q(2024, 1), q(2024, 2)]),
    "dated": ("Condensed statements\nSix Months Ended June 30,\n2024 2023 2022", [q(2024, 2, 2), q(2023, 2, 2)]),
    "dated year": ("Year ended\nDecember 31, 2024 2023", [q(2024, 4, 4), q(2023, 4, 4)]),
    "span without a day": ("Three months ended\n2024 2023", []),
    "chinese spans": ("截至2024年6月30日止六个月期间 截至 2023 年 9 月 30 日止 9 个月期间", [q(2024, 2, 2), q(2023, 3, 3)]),
    "chinese months": ("2024年7-9月 2023年7至9月 2022年2-4月", [q(2024, 3), q(2023, 3)]),
    "chinese report": ("合并利润表\n年初至报告期末", [q(2024, 3, 3), q(2023, 3, 3)]),
    "nothing": ("a line\n\nanother", []),
    "empty": (None, []),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in PAGES.items()], "page string, text string")
    out = {}
    for r in sorted(headers.page_periods(df, ("page",), report_year=F.when(F.col("page") == "chinese report", 2024), report_quarter=F.lit(3)).collect(), key=lambda r: (r.page, r.pos)):
        out.setdefault(r.page, []).append((r.q_index, r.span))
    return out


@pytest.mark.parametrize("page", sorted(PAGES))
def test_page(found, page):
    assert found.get(page, []) == PAGES[page][1]
