"""Income-statement bridge of a quarter: stages, reconciliation of lines, flows that balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTER = ("company_id", "q_index")
M = "decimal(20,2)"


def m(c: Column) -> Column:
    return c.cast(M)


def limit(value: Column, least: str, share: str) -> Column:
    return F.greatest(F.lit(least).cast("decimal(10,4)"), value * F.lit(share).cast("decimal(6,4)"))


def gross_stage(df: DataFrame) -> DataFrame:
    """Gross profit and cost by what is there; 'full' if both are known, else 'revenue-only'."""
    gross = F.coalesce("gross_profit", m(F.col("revenue") - F.col("cost_of_revenue")), m(F.col("operating_income") + F.col("operating_expenses")))
    at = df.withColumn("gross_profit", gross)
    cost = F.coalesce("cost_of_revenue", m(F.greatest(F.col("revenue") - F.col("gross_profit"), F.lit(0))))
    return at.withColumn("cost_of_revenue", cost).withColumn("coverage", F.when(F.col("gross_profit").isNotNull() & F.col("cost_of_revenue").isNotNull(), "full").otherwise("revenue-only"))


def resolve_opex(df: DataFrame) -> DataFrame:
    """Operating expenses as stated if they agree with gross less operating profit (0.25 or 8 %; 12 % where the column
    `opex_items`, the sum of a breakdown, is within 0.35 or 5 % of them) and do not exceed gross profit by over 0.25, else that
    difference; without it as stated, or 0 if they exceed revenue or gross profit by over 0.25."""
    stated, gross = F.greatest(F.col("operating_expenses"), F.lit(0).cast(M)), F.col("gross_profit")
    stated = F.when(F.col("operating_expenses").isNotNull(), stated)
    derived = F.when(F.col("operating_income").isNotNull() & gross.isNotNull(), m(F.greatest(gross - F.col("operating_income"), F.lit(0))))
    d = lambda x: F.lit(x).cast("decimal(10,4)")
    off = F.abs(stated - derived)
    within = lambda share: F.when(derived > d("0.05"), off <= derived * d(share)).otherwise(off <= d(share))
    near = (off <= d("0.25")) | within("0.08")
    if "opex_items" in df.columns:
        items = F.col("opex_items")
        near = near | (F.coalesce((items > d("0.05")) & (F.abs(items - stated) <= F.greatest(d("0.35"), items * d("0.05"))), F.lit(False)) & within("0.12"))
    over = F.coalesce(stated > gross + d("0.25"), F.lit(False))
    much = over | F.coalesce(stated > F.greatest(F.col("revenue"), F.lit(0)) + d("0.25"), F.lit(False))
    value = F.when(stated.isNull(), derived).when(derived.isNull(), F.when(much, F.lit(0).cast(M)).otherwise(stated)).when(near & ~over, stated).otherwise(derived)
    reliable = F.when(stated.isNull(), False).when(derived.isNull(), ~much).otherwise(near & ~over)
    return df.withColumn("opex_reliable", F.coalesce(reliable, F.lit(False))).withColumn("operating_expenses", m(value))


def resolve_pretax(df: DataFrame) -> DataFrame:
    """Pretax income as stated if it agrees (0.25 or 5 %) with net income plus tax, or operating plus non-operating; else the first of these."""
    by_net, by_operation = m(F.col("net_income") + F.col("tax")), m(F.col("operating_income") + F.col("non_operating"))
    agrees = lambda x: F.coalesce(F.abs(F.col("pretax_income") - x) <= limit(F.abs(x), "0.25", "0.05"), F.lit(False))
    other = F.coalesce(by_net, by_operation)
    return df.withColumn("pretax_income", F.when(F.col("pretax_income").isNull(), other).when(agrees(by_net) | agrees(by_operation) | other.isNull(), F.col("pretax_income")).otherwise(other))


def resolve_non_operating(df: DataFrame) -> DataFrame:
    derived = m(F.col("pretax_income") - F.col("operating_income"))
    near = F.abs(F.col("non_operating") - derived) <= limit(F.abs(derived), "0.25", "0.08")
    return df.withColumn("non_operating", F.when(F.col("non_operating").isNull(), derived).when(derived.isNull() | near, F.col("non_operating")).otherwise(derived))


def reconcile_breakdown(items: DataFrame, targets: DataFrame, residual: str = "residual") -> DataFrame:
    """Items brought to a target: what is missing (over 0.08 and 1 %) becomes a residual item; too much is scaled down,
    the last item by rank takes what rounding leaves. Targets of 0.05 or less leave no items."""
    keys = list(QUARTER)
    w = Window.partitionBy(*keys)
    # One sort serves all windows and the join: sums and ranks first, in the order of ranks, then what needs their order by quarter alone.
    at = items.where(F.col("value") > F.lit("0.02").cast("decimal(4,2)")).select(*keys, "category", "value")
    at = at.withColumn("_r", F.row_number().over(w.orderBy(F.col("value").desc(), "category"))).withColumns({"_sum": F.sum("value").over(w), "_n": F.count(F.lit(1)).over(w)})
    at = at.join(targets.select(*keys, "target").where(F.col("target") > F.lit("0.05").cast("decimal(4,2)")), keys)
    slack = limit(F.col("target"), "0.08", "0.01")
    over = F.col("_sum") > F.col("target") + slack
    scaled = F.round((F.col("value").cast("decimal(18,2)") * F.col("target").cast("decimal(18,2)") / F.col("_sum").cast("decimal(18,2)")).cast("decimal(38,8)"), 2).cast(M)
    at = at.withColumn("_v", F.when(over, scaled).otherwise(F.col("value")))
    others = F.sum("_v").over(w) - F.col("_v")
    fitted = m(F.when((F.col("_r") == F.col("_n")) & over, F.greatest(F.col("target") - others, F.lit(0).cast(M))).otherwise(F.col("_v")))
    rest = F.when((F.col("_r") == 1) & (F.col("target") - F.col("_sum") > slack), F.struct(F.lit(residual).alias("category"), m(F.col("target") - F.col("_sum")).alias("value")))
    made = F.filter(F.array(F.struct("category", F.col("_fitted").alias("value")), F.col("_rest")), lambda x: x.isNotNull())
    return at.withColumns({"_fitted": fitted, "_rest": rest}).select(*keys, F.explode(made).alias("x")).select(*keys, "x.*")


def collapse_single(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Breakdowns that are one item equal to the total go."""
    at = items.join(targets.select(*QUARTER, "target"), list(QUARTER), "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*QUARTER)))
    same = F.abs(F.col("value") - F.col("target")) <= limit(F.col("target"), "0.08", "0.01")
    return at.where(~((F.col("_n") == 1) & F.coalesce(same, F.lit(False)))).select(items.columns)


def weighted_metric(rows: DataFrame, metric: str, value: str = "value") -> DataFrame:
    """Mean of a metric weighted by value; rows without the metric keep their weight."""
    return rows.groupBy(*QUARTER).agg(F.round(F.sum((F.col(value) * F.col(metric)).cast("decimal(38,6)")).cast("double") / F.sum(value).cast("double"), 1).alias(metric))


def net_bridge(df: DataFrame) -> DataFrame:
    """Steps from operating profit to net income: a loss beyond 0.05 that gross profit does not cover, non-operating gain or
    loss, tax or tax benefit, and a closing residual where these leave more than 0.08 and 1 %."""
    c = F.col
    zero = F.lit(0).cast(M)
    gap = m(c("net_income") - (c("operating_income") + F.coalesce("non_operating", zero) - F.coalesce("tax", zero)))
    overflow = c("gross_profit").isNotNull() & (c("operating_income") < F.lit("-0.05").cast("decimal(4,2)"))
    steps = F.array(
        F.struct(F.lit("operating_loss_overflow").alias("step"), F.when(overflow, m(c("operating_income"))).alias("amount")),
        F.struct(F.when(c("non_operating") >= 0, "non_operating_gain").otherwise("non_operating_loss").alias("step"), c("non_operating").alias("amount")),
        F.struct(F.when(c("tax") >= 0, "tax").otherwise("tax_benefit").alias("step"), m(-c("tax")).alias("amount")),
        F.struct(F.lit("other").alias("step"), F.when(F.abs(gap) > limit(F.abs(c("net_income")), "0.08", "0.01"), gap).alias("amount")),
    )
    return df.select(*QUARTER, F.explode(steps).alias("s")).select(*QUARTER, "s.*").where("amount is not null and amount <> 0")


def bridge_edges(df: DataFrame) -> DataFrame:
    """Flows revenue -> cost and gross, gross -> opex and operating profit, operating profit -> net income and tax and
    other; a loss flows in from 'loss', so what enters a stage leaves it. Costs above revenue are such a loss too; no opex is
    covered by gross profit then. Quarters without gross profit have no edges."""
    c, zero = F.col, F.lit(0).cast(M)
    pos = lambda x: m(F.greatest(x, zero))
    operating = m(c("gross_profit") - c("operating_expenses"))
    rest = m(operating - c("net_income"))
    edges = [
        ("revenue", "cost_of_revenue", pos(F.least(c("revenue"), m(c("revenue") - c("gross_profit"))))),
        ("loss", "cost_of_revenue", pos(-c("gross_profit"))),
        ("revenue", "gross_profit", pos(c("gross_profit"))),
        ("gross_profit", "operating_expenses", m(F.least(c("operating_expenses"), pos(c("gross_profit"))))),
        ("loss", "operating_expenses", pos(c("operating_expenses") - pos(c("gross_profit")))),
        ("gross_profit", "operating_income", pos(operating)),
        ("operating_income", "net_income", m(F.least(pos(operating), pos(c("net_income"))))),
        ("operating_income", "deductions", F.when(operating > 0, pos(operating - pos(c("net_income"))))),
        ("gains", "net_income", pos(pos(c("net_income")) - pos(operating))),
    ]
    flows = F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), v.alias("amount")) for a, b, v in edges))
    return df.where(c("gross_profit").isNotNull()).withColumn("_rest", rest).select(*QUARTER, F.explode(flows).alias("f")).select(*QUARTER, "f.*").where("amount > 0")


def outcome_flags(df: DataFrame) -> DataFrame:
    n, o = F.col("net_income"), F.col("operating_income")
    state = F.when(F.abs(n) < F.lit("0.05").cast("decimal(4,2)"), "near-zero").when(n < F.lit("-0.05").cast("decimal(4,2)"), "loss").otherwise("profit")
    return df.select(*QUARTER, F.coalesce(o < F.lit("-0.02").cast("decimal(4,2)"), F.lit(False)).alias("operating_loss"), F.coalesce(n < F.lit("-0.05").cast("decimal(4,2)"), F.lit(False)).alias("net_loss"), state.alias("outcome"))
