"""Sources of a quarter's history rows: roll-ups, details, scores, the choice among them, and what is done with residuals.

Rows are (company_id, q_index, member_key, name, value, filing_date); a quarter has a few of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlode.operators.history import D, QUARTER, d
from quarterlode.operators.segments import is_aggregate

MONEY = "decimal(24,3)"
# Fixed values. Members whose details may stand in their place; order of sources when all else is equal.
DETAILED = ("products", "product", "adrevenue")
PREFERENCE = {"structure-history": 1, "official-groups": 2, "official-segments": 3}
OTHER = "otherrevenue"


def ratio(a: Column, b: Column) -> Column:
    """a / b in decimals; null where b is not above 0.02."""
    return (a.cast("decimal(24,4)") / F.when(b > d(0.02), b.cast("decimal(24,4)"))).cast(D)


def rollup_complete(rows: DataFrame, parents: Mapping[str, Sequence[str]]) -> DataFrame:
    """Children become their parent where all of them are there and add up to more than 0.02; a parent's own value
    stays if it is within 0.82 and 1.18 of their sum. Parents of a company share no children."""
    parent = F.create_map(*(F.lit(x) for p, kids in parents.items() for k in (*kids, p) for x in (k, p)))
    expected = F.create_map(*(F.lit(x) for p, kids in parents.items() for x in (p, len(kids))))
    group = Window.partitionBy(*QUARTER, "_p")
    at = rows.withColumn("_p", F.coalesce(parent[F.col("member_key")], F.concat(F.lit("="), F.col("member_key"))))
    child = F.col("member_key") != F.col("_p")
    at = at.withColumns({"_n": F.count_if(child).over(group), "_sum": F.sum(F.when(child, F.col("value"))).over(group), "_own": F.max(F.when(~child, F.col("value"))).over(group), "_first": F.row_number().over(group.orderBy(F.col("filing_date").desc_nulls_last(), F.col("value").desc(), "member_key"))})
    whole = F.coalesce((F.col("_n") == expected[F.col("_p")]) & (F.col("_sum") > d(0.02)), F.lit(False))
    share = ratio(F.col("_own"), F.col("_sum"))
    value = F.when((F.col("_own") > d(0.02)) & share.between(d(0.82), d(1.18)), F.col("_own")).otherwise(F.col("_sum"))
    pick = lambda new, old: F.when(whole, new).otherwise(F.col(old)).alias(old)
    return at.where(~whole | (F.col("_first") == 1)).select(*QUARTER, pick(F.col("_p"), "member_key"), pick(F.col("_p"), "name"), pick(value, "value").cast(MONEY).alias("value"), "filing_date")


def expand_details(base: DataFrame, details: DataFrame, priority: Sequence[str] = DETAILED, most: int = 7) -> DataFrame:
    """A member's row gives way to its detail rows (target = member_key) if there are two at least, they cover 0.72 to
    1.08 of it, at most `most` rows result, and the member is one of `priority`, or reads like a total, holds 28 % of the
    quarter and has three details. Targets are tried in order of their key, each seeing the rows that earlier ones left."""
    kept = details.where((F.col("value") > d(0.02)) & ~is_aggregate(F.col("name"))).groupBy(*QUARTER, F.col("target").alias("member_key")).agg(F.count(F.lit(1)).cast("int").alias("_k"), F.sum("value").alias("_d"))
    w = Window.partitionBy(*QUARTER)
    at = base.withColumns({"_rows": F.count(F.lit(1)).over(w).cast("int"), "_total": F.sum("value").over(w)}).join(kept.where("_k >= 2"), [*QUARTER, "member_key"])
    whole = is_aggregate(F.col("name")) & (F.col("_k") >= 3) & (ratio(F.col("value"), F.col("_total")) >= d(0.28))
    at = at.where((F.col("value") > d(0.02)) & ratio(F.col("_d"), F.col("value")).between(d(0.72), d(1.08)) & (F.col("member_key").isin(*priority) | whole))
    tries = at.groupBy(*QUARTER).agg(F.first("_rows").alias("n"), F.array_sort(F.collect_list(F.struct("member_key", "_k"))).alias("t"))
    state = F.struct(F.col("n").alias("n"), F.array().cast("array<string>").alias("took"))
    step = lambda s, t: F.when(s["n"] - 1 + t["_k"] <= most, F.struct((s["n"] - 1 + t["_k"]).alias("n"), F.concat(s["took"], F.array(t["member_key"])).alias("took"))).otherwise(s)
    took = tries.select(*QUARTER, F.explode(F.aggregate("t", state, step, lambda s: s["took"])).alias("member_key"))
    inner = details.where((F.col("value") > d(0.02)) & ~is_aggregate(F.col("name"))).join(took.withColumnRenamed("member_key", "target"), [*QUARTER, "target"], "left_semi")
    columns = [*QUARTER, "member_key", "name", "value", "filing_date"]
    return base.join(took, [*QUARTER, "member_key"], "left_anti").select(columns).unionByName(inner.select(columns))


def _scored(rows: DataFrame, entries: DataFrame, how: str, **more: Column) -> DataFrame:
    """The candidates of score_candidate() with `more` aggregates of their rows and the entry's revenue; a row is shuffled once."""
    days = F.unix_date("filing_date")
    per = rows.repartition(*QUARTER).groupBy(*QUARTER, "source").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.max("value").alias("top"), F.count_if(is_aggregate(F.col("name"))).alias("whole"), F.median(days).alias("filed"), *(c.alias(k) for k, c in more.items()))
    per = per.join(entries.select(*QUARTER, "revenue", "period_end"), list(QUARTER), how)
    n, lag, cover = F.col("n"), F.col("filed") - F.unix_date("period_end"), ratio(F.col("s"), F.col("revenue"))
    top = F.coalesce(ratio(F.col("top"), F.col("s")), F.lit(1))
    off = F.abs(cover - 1)
    score = F.when(n >= 2, 22).otherwise(-14) + F.when(n >= 3, 5).otherwise(0) - F.greatest(n - 7, F.lit(0)) * 4 - F.greatest(n - 10, F.lit(0)) * 5
    score = score + F.when(cover.isNull(), 0).when(off <= d(0.08), 18).when(off <= d(0.25), 10).when((cover < d(0.36)) | (cover > d(1.4)), -18).otherwise(2)
    score = score - F.when((top > d(0.84)) & (n >= 3), 8).otherwise(0) - F.when((F.col("whole") >= 2) & (n >= 4), F.col("whole") * 4).otherwise(0)
    score = score + F.when(lag.isNull(), 0).when(lag > 900, -16).when(lag > 540, -10).when(lag < -2, -6).when(lag <= 260, 3).otherwise(0)
    return per.select(*QUARTER, "source", score.cast("long").alias("score"), cover.alias("coverage"), "n", "revenue", *more)


def score_candidate(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(company_id, q_index, source, score, coverage, n): number of rows, their share of revenue, the largest one's share,
    labels that read like totals, median days from period end to filing. entries: revenue and period_end of a quarter, one
    row each."""
    return _scored(rows, entries, "left").drop("revenue")


def pick_history_source(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of the best candidate source of each quarter (score, coverage nearest 1, more rows, order of sources); a
    quarter with revenue and no rows gets one row of it.

    Rows travel with their candidate, so both inputs are read once."""
    rank = F.create_map(*(F.lit(x) for kv in PREFERENCE.items() for x in kv))
    order = F.struct("score", (-F.coalesce(F.abs(F.col("coverage") - 1), F.lit(1e9).cast(D))).alias("near"), "n", F.coalesce(rank[F.col("source")], F.lit(0)).alias("r"))
    item = F.struct("member_key", "name", F.col("value").cast(MONEY).alias("value"))
    at = _scored(rows.dropna(subset=[*QUARTER, "source"]), entries, "full_outer", items=F.collect_list(item))
    best = at.groupBy(*QUARTER).agg(F.max_by(F.struct("source", "items"), order).alias("b"), F.max("revenue").alias("revenue"))
    bare = F.when(F.col("revenue") > d(0.02), F.array(F.struct(F.lit("reportedrevenue").alias("member_key"), F.lit("Reported revenue").alias("name"), F.col("revenue").cast(MONEY).alias("value"))))
    return best.select(*QUARTER, F.explode(F.coalesce("b.items", bare)).alias("x"), F.coalesce("b.source", F.lit("fallback-reported")).alias("source")).select(*QUARTER, "x.*", "source")


def merge_canonical(rows: DataFrame) -> DataFrame:
    """One row of each member: the later filing's, then the larger value's, then the longer name's; its value is the greatest."""
    order = F.struct("filing_date", "value", F.length(F.trim("name")).alias("n"), "name")
    best = rows.where(F.col("value") > d(0.02)).groupBy(*QUARTER, "member_key").agg(F.max_by(F.struct("name", "filing_date"), order).alias("b"), F.max("value").cast(MONEY).alias("value"))
    return best.select(*QUARTER, "member_key", "b.*", "value")


def rows_from_shares(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """Shares (company_id, q_index, member_key, share), made to add up to 1, as rows of the quarter's total; what rounding
    leaves above 0.004 goes to the first row (by member_key)."""
    w = Window.partitionBy(*QUARTER)
    at = shares.where(F.col("share") > 0).withColumn("_s", F.sum("share").over(w)).join(totals.where(F.col("total") > d(0.02)).select(*QUARTER, "total"), list(QUARTER))
    at = at.withColumn("value", F.round((F.col("total").cast("decimal(20,4)") * F.col("share").cast("decimal(14,8)") / F.col("_s").cast("decimal(14,8)")).cast(D), 3).cast(MONEY))
    rest = F.round(F.col("total").cast("decimal(24,4)") - F.sum("value").over(w), 3).cast(MONEY)
    first = F.row_number().over(w.orderBy("member_key")) == 1
    return at.select(*QUARTER, "member_key", (F.col("value") + F.when(first & (F.abs(rest) > d(0.004)), rest).otherwise(0)).cast(MONEY).alias("value"))


def drop_sparse(rows: DataFrame, quarters: DataFrame, optional: Sequence[str] = (OTHER,)) -> DataFrame:
    """Quarters without a style whose official segments cover under 0.72 and leave over 28 % to the residual lose their
    rows; elsewhere optional members under 1.5 % go. quarters: total, coverage, source, style."""
    at = rows.join(quarters.select(*QUARTER, "total", "coverage", "source", "style"), list(QUARTER))
    total = F.greatest(F.col("total"), F.lit(0.001).cast("decimal(10,4)"))
    rest = F.coalesce(F.max(F.when(F.col("member_key") == OTHER, F.col("value"))).over(Window.partitionBy(*QUARTER)), F.lit(0))
    sparse = F.col("style").isNull() & (F.col("source") == "official-segments") & (F.coalesce("coverage", F.lit(0)) < d(0.72)) & (rest > total * d(0.28))
    tiny = F.col("member_key").isin(*optional) & (F.col("value") < total * d(0.015))
    return at.withColumn("_gone", sparse).where(~F.col("_gone") & ~tiny).select(*QUARTER, "member_key", "value")


def absorb_residual(rows: DataFrame, quarters: DataFrame) -> DataFrame:
    """A residual of 1 to 10 % between two quarters of the same members goes to the members by their mean shares there.

    Not where the rows are official groups, nor where official rows cover 0.85 or more and name two members. quarters:
    total, coverage, source. Neighbours are those before any absorption."""
    per = rows.groupBy(*QUARTER).agg(F.map_from_entries(F.collect_list(F.struct("member_key", "value"))).alias("m"), F.sum("value").alias("s"))
    per = per.withColumn("k", F.array_sort(F.filter(F.map_keys("m"), lambda x: x != OTHER))).join(quarters.select(*QUARTER, "total", "coverage", "source"), list(QUARTER))
    w = Window.partitionBy("company_id").orderBy("q_index")
    for name, shift in (("p", F.lag), ("n", F.lead)):
        per = per.withColumns({f"{c}_{name}": shift(c).over(w) for c in ("m", "k", "s")})
    rest = F.col("m")[OTHER]
    named = F.size(F.filter("k", lambda x: x != "reportedrevenue")) >= 2
    kept = F.col("source").isin("official-segments", "structure-history") & (F.coalesce("coverage", F.lit(0)) >= d(0.85)) & named
    share = ratio(rest, F.greatest(F.col("total"), F.lit(0.001).cast("decimal(10,4)")))
    ok = rest.isNotNull() & (F.col("source") != "official-groups") & ~kept & (F.size("k") > 0) & (F.col("k") == F.col("k_p")) & (F.col("k") == F.col("k_n")) & (share > d(0.01)) & (share <= d(0.1))
    at = per.withColumn("_ok", F.coalesce(ok, F.lit(False))).select("*", F.explode("m").alias("member_key", "value")).where(~(F.col("_ok") & (F.col("member_key") == OTHER)))
    mean = lambda key: (F.coalesce(ratio(F.col("m_p")[key], F.col("s_p")), F.lit(0)) + F.coalesce(ratio(F.col("m_n")[key], F.col("s_n")), F.lit(0))).cast("decimal(14,10)")
    at = at.withColumn("_w", F.when(F.col("_ok"), mean(F.col("member_key")))).withColumn("_all", F.sum("_w").over(Window.partitionBy(*QUARTER)))
    more = F.round((F.col("m")[OTHER].cast("decimal(18,4)") * F.col("_w") / F.when(F.col("_all") > 0, F.col("_all").cast("decimal(14,10)"))).cast(D), 3)
    return at.select(*QUARTER, "member_key", (F.col("value") + F.coalesce(F.when(F.col("_ok"), more), F.lit(0))).cast(MONEY).alias("value"), F.col("_ok").alias("absorbed"))
