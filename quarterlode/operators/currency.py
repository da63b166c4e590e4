"""Currencies: rates as of a date, fallbacks, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fx_asof(df: DataFrame, rates: DataFrame, days: int = 7, home: str = "USD") -> DataFrame:
    """Adds rate: that of the date or of the last day with one up to `days` before; the home currency is 1, else null.

    Every rate is valid for days + 1 dates, so it is repeated for these and joined by equality: no range join is left,
    whatever the number of rows."""
    valid = rates.select("currency", F.explode(F.sequence(F.col("rate_date"), F.date_add("rate_date", days))).alias("at"), "rate_date", "rate")
    last = valid.groupBy("currency", "at").agg(F.max_by("rate", "rate_date").alias("rate"))
    out = df.join(last, ["currency", "at"], "left")
    return out.withColumn("rate", F.when(F.col("currency") == home, F.lit(1).cast("decimal(12,4)")).otherwise(F.col("rate")))


def fx_fallback(df: DataFrame, rate: str = "rate", keys: Sequence[str] = ("company_id", "currency")) -> DataFrame:
    """Missing rates become the median of the rates known for the same company and currency."""
    medians = df.groupBy(*keys).agg(F.median(F.col(rate).cast("double")).alias("_median"))
    return df.join(medians, list(keys), "left").withColumn(rate, F.coalesce(F.col(rate).cast("double"), "_median")).drop("_median")


def scale_rows(df: DataFrame, columns: Sequence[str], factor: Column, places: int = 3) -> DataFrame:
    return df.withColumns({c: F.round((F.col(c) * factor).cast("decimal(38,8)"), places).cast(f"decimal(24,{places})") for c in columns})
