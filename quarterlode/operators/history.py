"""Segment history of a company: coverage, reconciliation, windows, top segments, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTER = ("company_id", "q_index")
D = "decimal(38,12)"


def d(x: float) -> Column:
    return F.lit(str(x)).cast("decimal(10,4)")


def history_rows(segments: DataFrame, statements: DataFrame) -> DataFrame:
    """Positive rows as amounts: rows that look like shares (two at least, none over 100.5, together 100 give or take 4.5)
    are shares of revenue; amounts of 0.02 or less go."""
    w = Window.partitionBy(*QUARTER)
    rows = segments.where(F.col("value") > d(0.001)).join(statements.select(*QUARTER, "revenue"), list(QUARTER), "left")
    shares = (F.col("revenue") > d(0.02)) & (F.count(F.lit(1)).over(w) >= 2) & (F.max("value").over(w) <= d(100.5)) & (F.abs(F.sum("value").over(w) - 100) <= d(4.5))
    amount = F.when(F.col("_shares"), F.round((F.col("revenue") * F.col("value") / 100).cast(D), 3)).otherwise(F.col("value")).cast("decimal(24,3)")
    return rows.withColumn("_shares", F.coalesce(shares, F.lit(False))).select(*QUARTER, "member_key", amount.alias("value"), F.col("_shares").alias("was_share")).where(F.col("value") > d(0.02))


def reconcile_to_total(rows: DataFrame, totals: DataFrame | None, least: float | Column = 0.36, residual: str = "otherrevenue") -> DataFrame:
    """Rows against the quarter's total: too little coverage leaves none, over 1.12 scales down, under 0.94 adds the rest
    to the residual member; rows without a total stay. Without `totals` the rows have a `total` of their own."""
    asked = least if isinstance(least, Column) else d(least)
    at = (rows if totals is None else rows.join(totals.select(*QUARTER, "total"), list(QUARTER), "left")).withColumn("_sum", F.sum("value").over(Window.partitionBy(*QUARTER)))
    cover = (F.col("_sum").cast("decimal(24,4)") / F.when(F.col("total") > d(0.02), F.col("total").cast("decimal(24,4)"))).cast(D)
    at = at.withColumn("_cover", cover).where(F.col("_cover").isNull() | (F.col("_cover") >= asked))
    scaled = F.when(F.col("_cover") > d(1.12), F.round((F.col("value").cast("decimal(15,3)") * F.col("total").cast("decimal(15,2)") / F.col("_sum").cast("decimal(15,3)")).cast(D), 3)).otherwise(F.col("value")).cast("decimal(24,3)")
    rest = (F.col("total") - F.col("_sum")).cast("decimal(24,3)")
    # The rest goes with one of the quarter's rows, so the rows are read once.
    one = F.row_number().over(Window.partitionBy(*QUARTER).orderBy("member_key")) == 1
    both = F.array_compact(F.array(F.struct("member_key", scaled.alias("value")), F.when(one & (F.col("_cover") < d(0.94)) & (F.col("total") - F.col("_sum") > d(0.03)), F.struct(F.lit(residual).alias("member_key"), rest.alias("value")))))
    out = at.withColumn("_x", both).select(*QUARTER, F.explode("_x").alias("x")).select(*QUARTER, "x.*")
    return out.groupBy(*QUARTER, "member_key").agg(F.sum("value").cast("decimal(24,3)").alias("value"))


def taxonomy_profile(rows: DataFrame, optional: tuple[str, ...] = ("otherrevenue",)) -> DataFrame:
    """Comparable members of a quarter (optional ones only if fewer than two others), by value, and their signature."""
    w = Window.partitionBy(*QUARTER)
    extra = F.col("member_key").isin(*optional)
    at = rows.withColumn("_plain", F.count_if(~extra).over(w)).where(~extra | (F.col("_plain") < 2))
    item = F.struct((-F.col("value")).alias("v"), "member_key")
    keys = at.groupBy(*QUARTER).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["member_key"]).alias("members"))
    return keys.select(*QUARTER, F.array_join("members", ",").alias("members"), F.array_join(F.array_sort("members"), "|").alias("signature"))


def key_overlap(rows: DataFrame, span: int = 4) -> DataFrame:
    """Jaccard of member sets of quarters at most `span` apart; quarters of a company are few."""
    sets = rows.groupBy(*QUARTER).agg(F.array_sort(F.collect_set("member_key")).alias("k"))
    # Each quarter is laid out for those before it: an equality join, `span` rows a quarter.
    b = sets.select("company_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(span)), lambda i: F.col("q_index") - i)).alias("q_index"), F.col("q_index").alias("q2"), F.col("k").alias("k2"))
    pairs = sets.join(b, list(QUARTER))
    return pairs.select("company_id", "q_index", "q2", F.round(F.size(F.array_intersect("k", "k2")) / F.size(F.array_union("k", "k2")), 6).alias("jaccard"), F.size(F.array_except("k", "k2")).alias("missing"), F.size(F.array_except("k2", "k")).alias("extra"))


def flag_gaps(rows: DataFrame) -> DataFrame:
    """Quarters with one segment where the company otherwise has two or more."""
    n = rows.groupBy(*QUARTER).agg(F.count(F.lit(1)).alias("segments"))
    return n.withColumn("gap", (F.col("segments") <= 1) & (F.max("segments").over(Window.partitionBy("company_id")) >= 2))


def history_window(df: DataFrame, n: int = 30, anchor: int | None = None) -> DataFrame:
    """The last n quarters of each company up to the anchor."""
    at = df if anchor is None else df.where(F.col("q_index") <= anchor)
    return at.withColumn("_r", F.dense_rank().over(Window.partitionBy("company_id").orderBy(F.col("q_index").desc()))).where(F.col("_r") <= n).drop("_r")


def topk_other(rows: DataFrame, most: int = 9, other: str = "__other__") -> DataFrame:
    """More than `most` members of a company over its history: the first most - 1 by total stay, the rest is summed."""
    totals = rows.groupBy("company_id", "member_key").agg(F.sum("value").alias("total"))
    w = Window.partitionBy("company_id")
    ranked = totals.withColumn("rank", F.row_number().over(w.orderBy(F.col("total").desc(), "member_key"))).withColumn("n", F.count(F.lit(1)).over(w))
    key = F.when((F.col("n") <= most) | (F.col("rank") < most), F.col("member_key")).otherwise(other)
    named = rows.join(ranked.select("company_id", "member_key", key.alias("segment")), ["company_id", "member_key"])
    out = named.groupBy(*QUARTER, "segment").agg(F.sum("value").alias("value"))
    return out.where((F.col("segment") != other) | (F.col("value") > d(0.02)))


def history_summary(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Of each company: quarters with segments, without, the greatest total, segments by total."""
    per = rows.groupBy(*QUARTER).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("segments"))
    at = statements.select(*QUARTER).join(per, list(QUARTER), "left").groupBy("company_id").agg(F.count("total").alias("available"), F.count_if(F.col("total").isNull()).alias("missing"), F.max("total").alias("max_total"))
    order = rows.groupBy("company_id", "member_key").agg(F.sum("value").alias("t")).groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("t"), "member_key"))), lambda x: x["member_key"]), ",").alias("stack_order"))
    return at.join(order, "company_id", "left")


def axis_step(df: DataFrame, column: str = "max_total", ticks: int = 6) -> DataFrame:
    """unit (0.1 where the maximum is below 3, else 1) and step: 1, 2, 5 or 10 times a power of ten near a `ticks`-th of
    the maximum in units; 1 where there is none."""
    top = F.greatest(F.col(column).cast("double"), F.lit(0.0))
    unit = F.when((top > 0) & (top < 3), 0.1).otherwise(1.0)
    raw = top / unit / ticks
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / base
    nice = F.when(part < 1.5, 1.0).when(part < 3, 2.0).when(part < 7, 5.0).otherwise(10.0)
    return df.withColumn("unit", unit).withColumn("step", F.when(top > 0, F.round(nice * base, 6)).otherwise(1.0))


def stack_offsets(rows: DataFrame) -> DataFrame:
    """Where each segment of a stacked bar begins and ends, the largest segment first."""
    w = Window.partitionBy(*QUARTER).orderBy(F.col("value").desc(), "member_key").rowsBetween(Window.unboundedPreceding, 0)
    top = F.sum("value").over(w)
    return rows.select(*QUARTER, "member_key", (top - F.col("value")).cast("decimal(24,3)").alias("low"), top.cast("decimal(24,3)").alias("high"))
