"""Hand-made cases of the rules: small tables with the results that the rules must give."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from quarterlode.operators import corpus, currency, entries, facts, history, reconcile, tables


def day(text):
    return dt.date.fromisoformat(text)


ENDS = [day("2023-03-31"), day("2023-06-30"), day("2023-09-30"), day("2023-12-31")]
STARTS = [day("2023-01-01"), day("2023-04-01"), day("2023-07-01"), day("2023-10-01")]
LONG = "company_id int, namespace string, concept string, start_date date, end_date date, value decimal(20,2), span_kind string"


def split(spark, rows):
    return spark.createDataFrame([(1, "us-gaap", "Revenues", s, e, Decimal(v), k) for s, e, v, k in rows], LONG)


def series(df):
    return {r.end_date: (int(r.value), r.derived) for r in facts.derive_quarters(df).collect()}


def test_year_of_cumulative_facts(spark):
    year = [(STARTS[0], ENDS[0], 10, "direct"), (STARTS[0], ENDS[1], 25, "cumulative"), (STARTS[0], ENDS[2], 45, "cumulative"), (STARTS[0], ENDS[3], 70, "cumulative")]
    assert [series(split(spark, year))[e][0] for e in ENDS] == [10, 15, 20, 25]
    other = series(split(spark, [*year, (STARTS[1], ENDS[1], 16, "direct")]))
    assert [other[e][0] for e in ENDS] == [10, 16, 19, 25]
    assert series(split(spark, year[1:])) == {}


def finalised(spark, rows, **more):
    df = spark.createDataFrame([(1, q, n, Decimal(r), Decimal(c), cur) for q, n, r, c, cur in rows], "company_id int, q_index int, span int, revenue decimal(20,2), cost decimal(20,2), currency string")
    return {r.q_index: int(r.revenue) for r in entries.finalize_quarters(df, ["revenue", "cost"], ["revenue", "cost"]).collect()}


def test_entries_of_a_year(spark):
    q = 2023 * 4
    year = [(q, 1, 10, 4, "USD"), (q + 1, 2, 25, 10, "USD"), (q + 2, 3, 45, 18, "USD"), (q + 3, 4, 70, 28, "USD")]
    assert finalised(spark, year) == {q: 10, q + 1: 15, q + 2: 20, q + 3: 25}
    assert finalised(spark, [*year, (q + 1, 1, 16, 6, "USD")]) == {q: 10, q + 1: 16, q + 2: 20, q + 3: 25}
    assert finalised(spark, year[1:]) == {q + 2: 20, q + 3: 25}
    assert finalised(spark, [(*year[0][:4], "EUR"), year[1]]) == {q: 10}
    assert finalised(spark, [(*year[0][:4], ""), year[1]]) == {q: 10, q + 1: 15}
    assert finalised(spark, [year[0], (q + 1, 2, 25, 3, "USD")]) == {q: 10}


def test_breakdown_merge(spark):
    def merged(values, total):
        items = spark.createDataFrame([(1, 1, s, c, Decimal(v), p) for s, c, v, p in values], "company_id int, q_index int, source_id string, category string, value decimal(20,2), priority int")
        totals = spark.createDataFrame([(1, 1, Decimal(total))], "company_id int, q_index int, total decimal(20,2)")
        return {r.category: (float(r.value), r.source_id) for r in reconcile.merge_breakdowns(items, totals).collect()}

    rows = [("a", "x", "60", 110), ("a", "y", "30", 110), ("b", "z", "15", 80)]
    assert merged(rows, "100") == {"x": (60, "a"), "y": (30, "a")}  # 105 of 100: the best single source
    assert merged(rows[:2], "100") == {"x": (60, "a"), "y": (30, "a"), "other_opex": (10, "residual")}
    assert merged(rows[:1], "100") == {"x": (60, "a")}


def test_rows_reconciled_to_a_total(spark):
    def got(cover):
        rows = spark.createDataFrame([(1, 1, "a", Decimal(60 * cover)), (1, 1, "b", Decimal(40 * cover))], "company_id int, q_index int, member_key string, value decimal(24,3)")
        totals = spark.createDataFrame([(1, 1, Decimal(100))], "company_id int, q_index int, total decimal(20,2)")
        return {r.member_key: float(r.value) for r in history.reconcile_to_total(rows, totals).collect()}

    assert got(Decimal("0.3")) == {} and got(1) == {"a": 60, "b": 40}
    assert got(Decimal("0.8")) == {"a": 48, "b": 32, "otherrevenue": 20} and got(Decimal("1.2")) == {"a": 60, "b": 40}


def test_rates_of_the_last_week(spark):
    rates = spark.createDataFrame([("EUR", day("2024-01-01"), Decimal("1.1"))], "currency string, rate_date date, rate decimal(12,4)")
    asked = spark.createDataFrame([(i, c, day(d)) for i, (c, d) in enumerate([("EUR", "2024-01-01"), ("EUR", "2024-01-08"), ("EUR", "2024-01-09"), ("USD", "2024-01-09"), ("GBP", "2024-01-01")])], "i int, currency string, at date")
    assert [r.rate and float(r.rate) for r in currency.fx_asof(asked, rates).orderBy("i").collect()] == [1.1, 1.1, None, 1.0, None]


def test_numbers_of_cells(spark):
    texts = {"(1,234.5)": -1234.5, "1,234": 1234, "$ 12": 12, "−7%": -7, "—": None, "": None, "(3": 3, "n a": None, "12 b": 12}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", corpus.parse_number(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == texts


def test_tables_of_filings(spark):
    docs = {
        1: [["Three Months Ended March 31,"], ["(in millions)", "2024", "2023"], ["Revenue", "3", "12,000", "(11,000)"], ["Cost of revenue", "(7,000)", "6,000"]],
        2: [["", "Q2 2024", "Q1 2024"], ["Net sales", "(in billions)"], ["Net sales", "2", "1"]],
        3: [["截至 2024 年 6 月 30 日止 六 个月期间"], ["营业收入", "5"]],
        4: [["As of September 30, 2023", "x"], ["Revenue", "150"]],
        5: [["no header"], ["Revenue", "150"]],
    }
    rows = spark.createDataFrame([(d, i, c) for d, t in docs.items() for i, c in enumerate(t)], "doc int, row_no int, cells array<string>")
    found = {}
    for r in tables.period_columns(rows, ["doc"]).orderBy("doc", "pos").collect():
        found.setdefault(r.doc, []).append((r.q_index, r.span))
    y = 2024 * 4
    assert found == {1: [(y, 1), (y - 4, 1)], 2: [(y + 1, 1), (y, 1)], 3: [(y + 1, 2)], 4: [(y - 2, 1)]}
    got = {(r.doc, r.q_index): (float(r.revenue), r.cost_of_revenue and float(r.cost_of_revenue), r.value_mode) for r in tables.table_entries(rows, ["doc"]).collect()}
    assert got[1, y] == (12e9, 7e9, "direct") and got[1, y - 4] == (-11e9, 6e9, "direct")
    assert got[3, y + 1][2] == "cumulative" and (5, y) not in got and got[4, y - 2][0] == 150e6
