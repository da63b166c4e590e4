"""Runs, completeness and matching of quarters, by company."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_run(df: DataFrame, target: int = 30, key: str = "company_id") -> DataFrame:
    """Latest unbroken run of quarters of each company: islands are where index minus place is constant."""
    islands = df.select(key, "q_index").distinct().withColumn("_island", F.col("q_index") - F.row_number().over(Window.partitionBy(key).orderBy("q_index")))
    runs = islands.groupBy(key, "_island").agg(F.min("q_index").alias("first_q"), F.max("q_index").alias("last_q"), F.count(F.lit(1)).alias("run"))
    last = runs.groupBy(key).agg(F.max_by(F.struct("first_q", "last_q", "run"), "last_q").alias("r"))
    return last.select(key, "r.*", (F.col("r.run") >= target).alias("enough"))


def window_complete(df: DataFrame, floor: int, key: str = "company_id") -> DataFrame:
    """Quarters held from `floor` on against those between the first and last one held."""
    held = df.where(F.col("q_index") >= floor).groupBy(key).agg(F.count_distinct("q_index").alias("held"), (F.max("q_index") - F.min("q_index") + 1).alias("expected"))
    return held.withColumn("complete", F.col("held") == F.col("expected"))


def match_quarter(rows: DataFrame, statements: DataFrame, tolerance: float) -> DataFrame:
    """Adds the quarter of the statement with the same period end and, if the row has it, the same revenue."""
    s = statements.select("company_id", "period_end", "q_index", F.col("revenue").alias("_stated"))
    close = F.col("revenue").isNull() | (F.abs(F.col("_stated") - F.col("revenue")) < tolerance)
    found = rows.join(s, ["company_id", "period_end"], "left").groupBy("company_id", "period_end", "revenue")
    return found.agg(F.min(F.when(close, F.col("q_index"))).alias("q_index"))
