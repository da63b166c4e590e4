"""Breakdowns of cost and expense lines, and entries of one quarter that are disclosed or derived."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTER = ("company_id", "q_index")
M = "decimal(20,2)"
FLAG = "derived-from-cumulative"


def opex_breakdown(df: DataFrame, least: float = 25_000_000, share: float = 0.01) -> DataFrame:
    """(company_id, q_index, name, value): positive operating-expense lines, selling & marketing else marketing, G&A else
    SG&A, and what the total leaves if that is over `least` and 1 %. Missing line columns count as null."""

    def line(name: str, instead: str | None = None) -> Column:
        own = F.col(name) if name in df.columns else F.lit(None).cast(M)
        kept = F.when(own > 0, own)
        if instead is None:
            return kept
        before = F.coalesce(F.col(instead) > 0, F.lit(False)) if instead in df.columns else F.lit(False)
        return F.when(~before, kept)

    lines = (("Fulfillment", line("fulfillment")), ("Technology & Content", line("technology_content")), ("Sales & Marketing", line("sales_marketing")), ("Marketing", line("marketing", "sales_marketing")), ("G&A", line("general_administrative")), ("SG&A", line("sgna", "general_administrative")), ("R&D", line("rnd")), ("Restructuring", line("restructuring")), ("Impairment", line("impairment")))
    items = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), v.cast(M).alias("value")) for n, v in lines)), lambda x: x["value"].isNotNull())
    at = df.withColumn("_i", items)
    said = F.aggregate("_i", F.lit(0).cast(M), lambda a, x: (a + x["value"]).cast(M))
    rest = (F.col("total") - said).cast(M)
    much = (F.col("total") > 0) & (said > 0) & (rest > F.greatest(F.lit(least).cast(M), F.col("total") * F.lit(share).cast("decimal(4,2)")))
    more = F.when(much, F.array(F.struct(F.lit("Other OpEx").alias("name"), rest.alias("value")))).otherwise(F.array().cast(f"array<struct<name:string,value:{M}>>"))
    return at.select(*QUARTER, F.explode(F.concat("_i", more)).alias("x")).select(*QUARTER, "x.*")


def merge_breakdown_longer(items: DataFrame, order: Column, column: str = "items") -> DataFrame:
    """Of several item lists of a quarter the longest; on ties the first by `order`."""
    w = Window.partitionBy(*QUARTER).orderBy(F.size(column).desc(), order)
    return items.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def prefer_direct(entries: DataFrame, fields: Sequence[str], provenance: Sequence[str]) -> DataFrame:
    """One entry of each quarter: disclosed values, then derived ones where they are missing.

    A disclosed entry that takes up a derived one keeps nothing of the derivation: neither its columns nor its flag."""
    direct = F.col("value_mode") != "derived"
    pick = lambda c: F.coalesce(F.max_by(c, F.when(direct & F.col(c).isNotNull(), 1)), F.max_by(c, F.when(~direct & F.col(c).isNotNull(), 1))).alias(c)
    both = F.count_if(direct).alias("_d"), F.count_if(~direct).alias("_v")
    flags = F.max_by("flags", F.when(direct, 2).otherwise(1)).alias("flags")
    at = entries.groupBy(*QUARTER).agg(*(pick(f) for f in fields), *both, flags, F.max_by("value_mode", F.when(direct, 2).otherwise(1)).alias("value_mode"), *(F.max_by(p, F.when(direct, 2).otherwise(1)).alias(p) for p in provenance))
    mixed = (F.col("_d") > 0) & (F.col("_v") > 0)
    at = at.withColumn("flags", F.when(mixed, F.array_remove("flags", FLAG)).otherwise(F.col("flags"))).withColumns({p: F.when(~mixed, F.col(p)) for p in provenance})
    return at.select(*QUARTER, "value_mode", *fields, "flags", *provenance)
