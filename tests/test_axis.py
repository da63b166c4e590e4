"""The axis of a fact is worked out once, whatever is asked of it behind."""

from pyspark.sql import functions as F

from quarterlode.operators import dimensions as D


def test_axis_is_worked_out_once(spark):
    rows = [(1, "a:ProductOrServiceAxis=a:PhoneMember;b:StatementBusinessSegmentsAxis=a:EuropeMember;b:StatementBusinessSegmentsAxis=a:ToolsMember;b:StatementBusinessSegmentsAxis=x:OperatingSegmentsMember"), (2, "b:ConsolidationItemsAxis=x:OperatingSegmentsMember"), (3, "b:StatementBusinessSegmentsAxis=x:EuropeMember"), (4, None), (5, "b:PlainAxis=x:NoneMember")]
    at = D.select_axis(spark.createDataFrame(rows, "fact_id int, dims string").withColumn("dims", D.parse_dims(F.col("dims"))))
    assert sorted((r.fact_id, r.axis, r.axis_priority, r.member) for r in at.collect()) == [(1, "StatementBusinessSegmentsAxis", 100, "ToolsMember"), (3, "StatementBusinessSegmentsAxis", 100, "EuropeMember")]
    named = D.label_allowlist(at, {"StatementBusinessSegmentsAxis": {"ToolsMember": "Tools"}}).join(at.select("axis").distinct(), "axis", "left_semi")
    assert [(r.fact_id, r.name) for r in named.collect()] == [(1, "Tools")]
    plan = D.label_allowlist(at, {"StatementBusinessSegmentsAxis": {"ToolsMember": "Tools"}})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("greater china") <= 1, plan
