"""What a row costs is worked out once: plans that repeat an expression or a read grow faster than the input."""

from decimal import Decimal

from pyspark.sql import functions as F

from quarterlode.operators import boxes, bridge, candidates, dimensions, phases, reconcile, sections, subsets, tables
from quarterlode.plans.catalogue import QUERIES
from quarterlode.sources import documents
from test_phases import best


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_segment_facts_are_read_in_one_pass(spark):
    context = lambda i, day, member: f'<context id="{i}"><entity><segment><explicitMember dimension="a:Axis">b:{member}</explicitMember></segment></entity><period><startDate>2020-01-01</startDate><endDate>{day}</endDate></period></context>'
    fact = lambda i, v: f'<us-gaap:Revenues unitRef="usd" contextRef="{i}">{v}</us-gaap:Revenues>'
    bodies = [
        context("a", "2020-03-31", "M") + context("b", "no day", "N") + fact("a", 1) + fact("b", 2) + fact("z", 3) + '<us-gaap:Assets contextRef="a">4</us-gaap:Assets>' + fact("a", "5.25"),
        context("a", "2020-06-30", "M") + context("a", "2020-09-30", "N") + fact("a", 7),
        "no XML <", None,
    ]
    docs = spark.createDataFrame([(i, b and f"<xbrl>{b}</xbrl>") for i, b in enumerate(bodies)], "doc int, body string")
    got = documents.read_segment_facts(docs)
    assert sorted((r.doc, float(r.value), str(r.end_date), [(d.dimension, d.member) for d in r.dims]) for r in got.collect()) == [
        (0, 1.0, "2020-03-31", [("Axis", "M")]), (0, 5.25, "2020-03-31", [("Axis", "M")]), (1, 7.0, "2020-06-30", [("Axis", "M")]), (1, 7.0, "2020-09-30", [("Axis", "N")]),
    ]
    assert "Join" not in plan(got) and plan(got).count("from_xml") == 1


def test_line_rows_read_each_reading_once(spark):
    text = "Notes and things\nTotal revenue  5.5 and 6\nCost of sales:\n(7) (8)\nOperating expenses\nof which tax 9 1\nnet income 4\n3 2"
    got = tables.line_rows(spark.createDataFrame([(1, text), (2, None)], "doc int, text string"), ["doc"])
    assert [(r.line_no, r.label, r.field, r.numbers) for r in got.orderBy("line_no").collect()] == [
        (0, "Notes and things Total revenue", "revenue", [5.5, 6.0]), (1, "Total revenue", "revenue", [5.5, 6.0]), (2, "Cost of sales", "revenue", [-7.0, -8.0]),
        (4, "Operating expenses", "operating_expenses", []), (5, "of which tax", None, [9.0, 1.0]), (6, "net income", "net_income", [4.0, 3.0, 2.0]),
    ]
    assert len(plan(got)) < 60_000


def test_tables_are_grouped_once(spark):
    rows = [(1, 0, ["(in thousands)"]), (1, 1, ["", "Q1 2024", "Q1 2023", "Q1 2024"]), (1, 2, ["Net revenues", "10", "20", "30"]), (1, 3, ["Cost of sales", "(4)", "(5)", "(6)"]), (1, 4, ["Revenue", "1", "2", "3"]), (2, 0, ["", "Q1 2024"]), (2, 1, ["Gross profit", "5"])]
    got = tables.table_entries(spark.createDataFrame(rows, "doc int, row_no int, cells array<string>"), ["doc"])
    assert sorted((r.doc, r.q_index, r.span, float(r.revenue), float(r.cost_of_revenue), float(r.gross_profit), r.net_income) for r in got.collect()) == [(1, 8092, 1, 20000.0, 5000.0, 15000.0, None), (1, 8096, 1, 10000.0, 4000.0, 6000.0, None)]
    assert plan(got).count("Aggregate ") == 1 and "Join" not in plan(got)


def test_a_release_is_read_once(spark):
    head = "Some Company\nResults for the Quarter Ended July 28\nFiscal 2022   Fiscal 2021 second quarter\n"
    body = "Revenue | $5.5 billion | 3% | 2 million and 9 billion | $7 m i l l i o n\nNet income 1 million\nNet income 2 million, 5 billion and 6.25 million\n"
    pages = [(1, 0, head + body), (2, 0, head.replace("Fiscal 2021", "") + body), (3, 3, head + body), (4, 0, None), (5, 0, "May 2, 2001 " + head + body)]
    got = sections.release_summary(spark.createDataFrame(pages, "doc int, page_no int, text string").withColumn("filing_date", F.lit(None).cast("date")), "doc")
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 0, 8086, 2021, 2, 7e6, None, 6.25e6), (1, 0, 8090, 2022, 2, 5.5e9, None, 2e6), (5, 0, 8002, 2021, 2, 7e6, None, 6.25e6), (5, 0, 8006, 2022, 2, 5.5e9, None, 2e6),
    ]
    assert plan(got).count("split(") <= 8


def test_rows_of_a_page_are_found_once(spark):
    boxes_ = spark.createDataFrame([(1, 0.05, 0.1, 0.1, 0.01, "Net"), (1, 0.5, 0.1, 0.1, 0.01, "7"), (1, 0.05, 0.2, 0.1, 0.01, "Tax"), (2, 0.05, 0.1, 0.1, 0.01, "alone")], "page int, x double, y double, width double, height double, text string")
    got = boxes.grid_lines(boxes_, ("page",))
    assert [tuple(r) for r in got.orderBy("line_no").collect()] == [(1, 0, "Net | 7"), (1, 1, "Tax")]
    assert plan(got).count("aggregate(") == 2


def test_a_history_is_read_once_by_its_phases(spark):
    rows = [(1, 8000 + i, k, k, Decimal(v)) for i, a in enumerate(("60", "70", "80")) for k, v in (("x", a), ("y", "30"))]
    segments = spark.createDataFrame(rows, "company_id long, q_index int, member_key string, name string, value decimal(24,3)")
    quarters = spark.createDataFrame([(1, 8000 + i, Decimal(t), None, True, 1.0, 1.0) for i, t in enumerate(("90", "50", "200"))] + [(2, 8000, Decimal(5), None, False, 1.0, 1.0)], "company_id long, q_index int, total decimal(20,2), style string, reliable boolean, source_score double, coverage double")
    at = phases.phases(phases.profiles(segments, quarters))
    assert sorted((r.company_id, r.q_index, r.phase, r.anchor, r.member) for r in at.collect()) == [(1, 8000, 0, 8002, True), (1, 8001, 0, 8002, True), (1, 8002, 0, 8002, True), (2, 8000, None, None, False)]
    got = phases.align_to_phase(at)[1]
    assert sorted((r.q_index, r.member_key, float(r.value)) for r in got.collect()) == [(8000, "x", 60.0), (8000, "y", 30.0), (8001, "x", 35.0), (8001, "y", 15.0)]
    assert plan(got).count("LogicalRDD") + plan(got).count("LocalRelation") == 2


def test_members_of_a_hierarchy_take_one_pass(spark):
    rows = [(1, "Revenues", "d", "e", "Axis=a", Decimal(v)) for v in (5, 5)] + [(1, "Revenues", "d", "e", "Axis=b", Decimal(v)) for v in (7, 8)] + [(1, "Revenues", "d", "e", "Axis=a", None)]
    facts = spark.createDataFrame(rows, "company_id int, concept string, start_date string, end_date string, dims string, value decimal(20,2)").withColumn("dims", dimensions.parse_dims(F.col("dims")))
    config = [{"member_key": "a", "name": "A", "filters": {"Axis": ["a"]}}, {"member_key": "b", "name": "B", "filters": {"Axis": ["b"]}, "aggregate": True}]
    got = dimensions.match_hierarchy(facts, config)
    assert sorted(((r.name, r.value and float(r.value)) for r in got.collect()), key=str) == [("A", 5.0), ("A", 5.0), ("A", None), ("B", 15.0)]
    assert "Union" not in plan(got)


def test_subsets_are_searched_in_batches_and_near_scores_go_to_fewer_rows(spark):
    names = ["Alpha", "Beta", "Gamma", "Delta", "Epsilon", "Zeta", "Eta", "Theta", "Iota", "Kappa", "Lambda", "Mu"]
    lots = [(0, [600] * 12, 3000), (1, [900, 600, 500, 400, 399, 200, 150, 100], 1500), (2, [400, 400, 400, 399, 301, 300, 201, 99, 98, 97], 2000), (3, [100, 90], 2000)]
    rows = [(1, q, n, v / 1000) for q, values, _ in lots for n, v in zip(names, values, strict=False)]
    money = lambda df, c: df.withColumn(c, F.col(c).cast("decimal(24,3)"))
    got = subsets.best_subset(
        money(spark.createDataFrame(rows, "company_id int, q_index int, name string, value double"), "value").withColumn("member_key", F.lit(None).cast("string")),
        money(spark.createDataFrame([(1, q, r / 1000, False, "Acme") for q, _, r in lots], "company_id int, q_index int, revenue double, styled boolean, company_name string"), "revenue"),
        spark.createDataFrame([], "company_id int, q_index int, target string"),
    )
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.q_index, -r.value, r.name)):
        found.setdefault(r.q_index, (r.how, []))[1].append(r.name)
    exhaustive = {q: best(sorted(zip(names, values, strict=False), key=lambda x: (-x[1], x[0])), revenue, [], {"acme"}) for q, values, revenue in lots}
    assert found == exhaustive and found[3][0] == "largest"
    assert "MapInArrow" in plan(got)  # not 4,096 subsets a quarter by interpreted expressions


def test_rows_travel_with_their_candidate_source(spark):
    day = lambda df, c: df.withColumns({x: F.col(x).cast("date") for x in c}).withColumn(df.columns[-1], F.col(df.columns[-1]).cast("decimal(24,3)"))
    rows = [(1, 1, "structure-history", k, k, "2020-05-01", 3.0) for k in "abc"] + [(1, 1, "official-segments", k, k, "2020-05-01", 2.0) for k in "de"] + [(1, 2, "official-segments", "a", "a", None, 5.0), (1, 4, None, "a", "a", None, 1.0), (None, 1, "official-segments", "z", "z", None, 1.0)]
    entries = [(1, 1, "2020-03-31", 9.0), (1, 3, "2020-09-30", 7.0), (1, 5, "2021-03-31", 0.01)]
    rows = day(spark.createDataFrame(rows, "company_id int, q_index int, source string, member_key string, name string, filing_date string, value double"), ["filing_date"])
    got = candidates.pick_history_source(rows, day(spark.createDataFrame(entries, "company_id int, q_index int, period_end string, revenue double"), ["period_end"]))
    assert sorted((r.q_index, r.member_key, float(r.value), r.source) for r in got.collect()) == [(1, k, 3.0, "structure-history") for k in "abc"] + [(2, "a", 5.0, "official-segments"), (3, "reportedrevenue", 7.0, "fallback-reported")]
    assert plan(got).count("Join ") == 1


def test_companies_are_resolved_without_a_broadcast_or_a_first_distinct(spark):
    asked = spark.createDataFrame([("acme",), ("acme",), (" ACME",), ("b-corp",), ("nobody",), ("",), (None,)], "name string")
    companies = spark.createDataFrame([(7, "Acme Inc", None, None), (3, "x", "ACME", None), (5, None, None, "B"), (4, "", "b-corp", None)], "company_id int, id string, ticker string, slug string")
    got = reconcile.resolve_company(asked, companies)
    assert sorted((r.name, r.company_id) for r in got.collect()) == [(" ACME", 3), ("acme", 3), ("b-corp", 4)]
    assert plan(got).count("Aggregate ") == 1 and "strategy=merge" in plan(got)


def test_a_breakdown_is_fitted_over_one_sort(spark):
    money = lambda df, c: df.withColumn(c, F.col(c).cast("decimal(20,2)"))
    items = [(1, 1, "a", 5.0), (1, 1, "b", 3.0), (1, 1, "c", 3.0), (1, 1, "d", 0.01), (1, 2, "a", 5.0), (1, 2, "b", 1.0), (1, 3, "a", 1.0), (1, 4, "a", 2.0), (1, 5, "a", 2.0)]
    targets = [(1, 1, 10.0), (1, 2, 9.0), (1, 3, 0.05), (1, 4, 2.05)]
    got = bridge.reconcile_breakdown(money(spark.createDataFrame(items, "company_id int, q_index int, category string, value double"), "value"), money(spark.createDataFrame(targets, "company_id int, q_index int, target double"), "target"))
    assert sorted((r.q_index, r.category, str(r.value)) for r in got.collect()) == [
        (1, "a", "4.55"), (1, "b", "2.73"), (1, "c", "2.72"), (2, "a", "5.00"), (2, "b", "1.00"), (2, "residual", "3.00"), (4, "a", "2.00"),
    ]
    assert plan(got).count("Join ") == 1 and "Union" not in plan(got)


def test_fact_ranks_are_held_once_a_row(spark, sf_dir):
    assert "_w0" not in plan(QUERIES["f4_fact_rank"](spark, sf_dir))  # both orders take the same columns, no struct of an own each
