"""Repairs and filters of statements, coverage, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUARTER = ("company_id", "q_index")


def repair_q4(statements: DataFrame, segments: DataFrame, jump: float = 2.6) -> DataFrame:
    """Fourth quarters that look like whole years: revenue of `jump` times the median of the other three becomes the sum
    of segments if these look like a quarter (1.6 times the others' at most, revenue 1.8 times as much), else it is
    divided by 4 or by the median ratio of members to the third quarter (2.6 to 5.4, spread 1.8 at most)."""
    year = F.floor(F.col("q_index") / 4)
    first = F.pmod("q_index", F.lit(4)) < 3
    sums = segments.where("value > 0").groupBy(*QUARTER).agg(F.sum("value").cast("double").alias("seg"), F.count(F.lit(1)).alias("rows"))
    at = statements.select(*QUARTER, F.col("revenue").cast("double").alias("revenue")).join(sums, list(QUARTER), "left").withColumn("y", year)
    w = Window.partitionBy("company_id", "y")
    at = at.withColumn("base", F.median(F.when(first & (F.col("revenue") > 0), F.col("revenue"))).over(w)).withColumn("three", F.count_if(first & (F.col("revenue") > 0)).over(w)).withColumn("seg_base", F.median(F.when(first & (F.col("rows") >= 2), F.col("seg"))).over(w))
    old = segments.select("company_id", (F.col("q_index") + 1).alias("q_index"), "member_key", F.col("value").cast("double").alias("before"))
    ratios = segments.where(F.pmod("q_index", F.lit(4)) == 3).join(old, [*QUARTER, "member_key"]).where("before > 0.05 and value > 0.05").groupBy(*QUARTER).agg(F.median(F.col("value").cast("double") / F.col("before")).alias("mid"), F.max(F.col("value").cast("double") / F.col("before")).alias("top"), F.min(F.col("value").cast("double") / F.col("before")).alias("low"), F.count(F.lit(1)).alias("pairs"))
    at = at.join(ratios, list(QUARTER), "left")
    odd = (F.pmod("q_index", F.lit(4)) == 3) & (F.col("three") == 3) & (F.col("revenue") >= jump * F.col("base")) & (F.col("rows") >= 2)
    align = odd & (F.col("seg") <= 1.6 * F.col("seg_base")) & (F.col("revenue") >= 1.8 * F.col("seg"))
    divide = odd & ~F.coalesce(align, F.lit(False)) & (F.col("pairs") >= 2) & F.col("mid").between(2.6, 5.4) & (F.col("top") - F.col("low") <= 1.8)
    factor = F.when(F.col("mid").between(3.3, 4.7), 4.0).otherwise(F.round("mid", 3))
    value = F.when(align, F.col("seg")).when(divide, F.col("revenue") / factor).otherwise(F.col("revenue"))
    flag = F.when(align, "aligned").when(divide, "normalized").otherwise("")
    return at.select(*QUARTER, F.round(value, 2).alias("revenue"), flag.alias("flag"))


def clear_bridge(df: DataFrame, lines: Sequence[str], most: float = 1.18) -> DataFrame:
    """Where any line exceeds revenue by 18 % all lines are cleared."""
    bad = F.coalesce((F.col("revenue") > 0) & (F.greatest(*lines) > F.col("revenue") * F.lit(str(most)).cast("decimal(4,2)")), F.lit(False))
    return df.withColumn("cleared", bad).withColumns({c: F.when(~F.col("cleared"), F.col(c)) for c in lines})


def repair_units(segments: DataFrame, statements: DataFrame) -> DataFrame:
    """Quarters whose segments look like thousands of the statement's unit are divided by 1000."""
    w = Window.partitionBy(*QUARTER)
    at = segments.join(statements.select(*QUARTER, "revenue"), list(QUARTER), "left")
    big = (F.max("value").over(w) > 500) & (F.max("value").over(w) > F.col("revenue") * 8) & (F.sum("value").over(w) > F.col("revenue") * 8)
    return at.withColumn("_big", F.coalesce(big, F.lit(False))).withColumn("value", F.when(F.col("_big"), F.round((F.col("value") / 1000).cast("decimal(38,6)"), 3)).otherwise(F.col("value")).cast("decimal(24,3)")).select(segments.columns)


def eligible_quarters(statements: DataFrame, segments: DataFrame, cycles: Sequence[int]) -> DataFrame:
    """Quarters of allowed places in the year that have segments; all quarters of a company if none is left."""
    has = segments.select(*QUARTER).distinct().withColumn("_has", F.lit(True))
    at = statements.select(*QUARTER).join(has, list(QUARTER), "left")
    ok = F.col("_has").isNotNull() & (F.pmod("q_index", F.lit(4)) + 1).isin(*cycles)
    at = at.withColumn("_ok", ok).withColumn("_any", F.bool_or("_ok").over(Window.partitionBy("company_id")))
    return at.where(F.col("_ok") | ~F.col("_any")).select(*QUARTER)


def rank_companies(companies: DataFrame, n: int | None = None) -> DataFrame:
    """Companies by balance, then name, with a search text."""
    at = companies.select("company_id", "name", F.lower(F.concat_ws(" ", "name", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"))).alias("search"), "s_acctbal")
    out = at.orderBy(F.col("s_acctbal").desc(), "name")
    return out.limit(n) if n else out


def coverage(statements: DataFrame, fields: Sequence[str]) -> DataFrame:
    return statements.groupBy("company_id").agg(F.count(F.lit(1)).alias("quarters"), *(F.count_if(F.col(f).isNotNull()).alias(f"n_{f}") for f in fields), F.min("q_index").alias("first_q"), F.max("q_index").alias("last_q"))


def pick_quarter(statements: DataFrame, requested: DataFrame) -> DataFrame:
    """The requested quarter of a company if it is there, an error if not; without a request the latest."""
    last = statements.groupBy("company_id").agg(F.max("q_index").alias("last_q"))
    have = statements.select("company_id", F.col("q_index").alias("requested"), F.lit(True).alias("_there")).distinct()
    at = last.join(requested, "company_id", "left").join(have, ["company_id", "requested"], "left")
    return at.select("company_id", F.when(F.col("requested").isNull(), F.col("last_q")).when(F.col("_there"), F.col("requested")).alias("q_index"), F.when(F.col("requested").isNotNull() & F.col("_there").isNull(), "missing").otherwise("").alias("error"))
