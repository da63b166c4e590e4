"""Supplements and the dataset's documents."""

from decimal import Decimal

from quarterlode.operators import dimensions
from quarterlode.sources import documents
from pyspark.sql import functions as F


def test_profiles_are_merged_key_by_key(spark):
    kinds = "company_id int, quarter string, rnd decimal(20,2), profile map<string,double>"
    rows = [(1, "_default", Decimal(5), {"a": 1.0, "b": 2.0}), (1, "2023Q1", None, {"b": 3.0, "c": 4.0}), (1, "2023Q2", Decimal(7), None), (2, "2023Q1", None, {"x": 1.0})]
    quarters = spark.createDataFrame([(1, "2023Q1"), (1, "2023Q2"), (1, "2023Q3"), (2, "2023Q1"), (3, "2023Q1")], "company_id int, quarter string")
    got = {(r.company_id, r.quarter): (r.rnd and int(r.rnd), r.profile) for r in documents.expand_supplements(spark.createDataFrame(rows, kinds), quarters, ("rnd",)).collect()}
    assert got == {(1, "2023Q1"): (5, {"a": 1.0, "b": 3.0, "c": 4.0}), (1, "2023Q2"): (7, {"a": 1.0, "b": 2.0}), (1, "2023Q3"): (5, {"a": 1.0, "b": 2.0}), (2, "2023Q1"): (None, {"x": 1.0})}


def test_dataset_is_written_and_one_company_read_back(spark, tmp_path):
    companies = spark.createDataFrame([(i, f"Company {i}") for i in range(40)], "company_id int, name string")
    statements = spark.createDataFrame([(i, 8000 + q, 10.5 * i + q) for i in range(0, 40, 2) for q in range(3)], "company_id int, q_index int, revenue double")
    segments = spark.createDataFrame([(4, 8001, "a", 1.0), (4, 8001, "b", 2.0)], "company_id int, q_index int, member_key string, value double")
    path = str(tmp_path / "dataset")
    for _ in range(2):  # a second write takes the place of the first
        documents.write_dataset(documents.dataset(companies, statements, segments), path, parts=8)
    every = spark.read.json(path)
    assert every.count() == 40 and every.select("part").distinct().count() > 3
    part = spark.createDataFrame([(4,)], "company_id int").select(F.pmod(F.xxhash64("company_id"), F.lit(8)).alias("p")).first().p
    one = spark.read.json(f"{path}/part={part}").where("company_id = 4").first()
    assert (one.name, one.quarter_count, one.segment_quarter_count) == ("Company 4", 3, 1)
    assert [(q.q_index, q.revenue, q.segments and [(s.member_key, s.value) for s in q.segments]) for q in one.quarters] == [(8000, 42.0, None), (8001, 43.0, [("a", 1.0), ("b", 2.0)]), (8002, 44.0, None)]
    assert every.where("company_id = 5").first().quarter_count == 0


def test_country_members_are_places(spark):
    df = spark.createDataFrame([("US",), ("Canada",), ("Latin America",), ("EMEA",), ("APAC region",), ("Cloud US",)], "label string")
    assert [r.p for r in df.select(dimensions.is_place(F.col("label")).alias("p")).collect()] == [True, True, True, True, True, False]
