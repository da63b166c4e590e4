"""Facts of the picked axis are read, dealt and worked out once: figures that grow with the input stay one shuffle of it."""

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarterlode.operators import dimensions as D
from quarterlode.plans import fixtures
from quarterlode.plans.catalogue import QUERIES


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_on_axis_are_those_of_the_picked_axis(spark):
    rng = random.Random(4)
    dims = [f"a:{axis}=b:{m}Member" for axis in ("StatementBusinessSegmentsAxis", "ProductOrServiceAxis", "SegmentPlaceAxis", "PlainAxis") for m in ("Tools", "Europe", "Product", "Phone", "Cloud", "NorthAmerica")]
    dims += [f"{a};{b}" for a, b in zip(dims[::2], dims[5::3], strict=False)] + [None, "", "=", "a:ProductOrServiceAxis=", "b:ConsolidationItemsAxis=x:OperatingSegmentsMember"]
    day = lambda: rng.choice([None, date(2020, 3, 31), date(2020, 6, 30), date(2020, 9, 30), date(2020, 12, 31)])
    rows = [(rng.choice([None, *range(200)]), rng.choice(dims), day(), rng.choice([70, 98, 108]), Decimal(i)) for i in range(900)]
    rows += rows[:50]
    facts = spark.createDataFrame(rows, "company_id long, dims string, end_date date, concept_priority int, value decimal(20,2)")
    got = D.facts_on_axis(facts)
    chosen = D.select_axis(facts.withColumn("dims", D.parse_dims(F.col("dims"))))
    want = chosen.join(D.pick_axis(chosen), ["company_id", "axis"], "left_semi")
    key = lambda df: sorted((tuple(r) for r in df.select("company_id", "end_date", "concept_priority", "value", "axis", "axis_priority", "member").collect()), key=str)
    assert got.columns == ["company_id", "end_date", "concept_priority", "value", "axis", "axis_priority", "member"]
    assert len({r.axis for r in got.collect()}) >= 3 and key(got) == key(want)
    scores, mark = D.axis_scores(chosen), D.pick_axis(chosen).withColumn("picked", F.lit(True))
    want = scores.join(mark, ["company_id", "axis"], "left").withColumn("picked", F.coalesce("picked", F.lit(False)))
    got = D.marked_axes(facts.drop("value"))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["g6_dedupe_segment_facts", "g8_segment_series", "g5_segment_quality", "g4_pick_axis"])
def test_segment_facts_are_dealt_once(spark, sf_dir, name):
    """lineitem is read once and dealt once; part is broadcast at this size."""
    plan = physical(QUERIES[name](spark, sf_dir))
    assert plan.count("FileScan parquet [l_partkey") == 1
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_series_are_dealt_by_part_and_by_company_alone(spark, sf_dir):
    """Where part is too large to broadcast: its join deals both sides, then companies are dealt, whatever comes behind."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(QUERIES["g8_segment_series"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3 and "Cartesian" not in plan, plan


def test_partitions_go_by_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fixtures, "LINES", 500)
    plan = physical(fixtures.view(spark, sf_dir, "dim_facts"))
    assert f", {-(-spark.read.parquet(f'{sf_dir}/lineitem.parquet').count() // 500)}), REPARTITION_BY_NUM" in plan, plan


def test_dealt_facts_are_those_of_the_view(spark, tmp_path):
    """The piece that Spark runs in place of the grouping sets: same rows, unknown companies, parts and amounts too."""
    lines = [(i % 7, rows % 5 if rows % 11 else None, (rows % 3 or None) and rows % 4, f"199{rows % 4 + 5}-0{rows % 9 + 1}-0{rows % 7 + 1} 00:00:00", 1000.0 + rows * 1.37 if rows % 13 else None, 0.01 * (rows % 9)) for i in range(4) for rows in range(200)]
    names = "l_orderkey long, l_suppkey long, l_partkey long, day string, l_extendedprice double, l_discount double"
    made = spark.createDataFrame(lines, names).withColumn("l_shipdate", F.to_timestamp_ntz("day")).withColumns({"l_tax": F.lit(0.02), "l_returnflag": F.lit("N"), "l_linestatus": F.lit("O")})
    made.drop("day").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, "LARGE", "Brand#1"), (1, "LARGE", None), (2, None, "Brand#2"), (3, None, None)], "p_partkey long, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = fixtures.view(spark, str(tmp_path), "dim_facts")
    names = [v for v in fixtures.VIEWS if v in fixtures.reads("dim_facts")]
    want = spark.sql("WITH " + ", ".join(f"{v} AS ({fixtures.VIEWS[v]})" for v in names) + " SELECT * FROM dim_facts")
    assert physical(got).count("Expand") == 0 and physical(want).count("Expand") == 1
    assert got.columns == want.columns and got.dtypes == want.dtypes
    rows = sorted(map(str, got.collect()))
    assert len(rows) > 100 and rows == sorted(map(str, want.collect()))
