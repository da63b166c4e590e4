"""Rows of a quarter's bridge and history: gaps filled from neighbours, costs by segment, capping, choice among sources.

Rows are (company_id, q_index, member_key, value). A company has a few dozen quarters, a quarter a few rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlode.operators.bridge import resolve_opex
from quarterlode.operators.candidates import MONEY, OTHER
from quarterlode.operators.history import QUARTER
from quarterlode.operators.segments import combines, is_aggregate, normal_label

RESERVED = (OTHER, "reportedrevenue")
NEAR = (-2, -1, 1, 2)


def d(x: float) -> Column:
    return F.lit(str(x)).cast("decimal(10,4)")


def _neighbours(rows: DataFrame, quarters: DataFrame) -> DataFrame:
    """Quarters of the history with their rows as a map and those of the quarters before (_p) and after (_n) as shares."""
    per = rows.groupBy(*QUARTER).agg(F.map_from_entries(F.collect_list(F.struct("member_key", F.col("value").cast("double")))).alias("m"), F.sum("value").cast("double").alias("s"))
    at = quarters.join(per, list(QUARTER), "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,double>"))).withColumn("shares", F.when(F.col("s") > 0.02, F.transform_values("m", lambda k, v: v / F.col("s"))).otherwise(F.create_map().cast("map<string,double>")))
    w = Window.partitionBy("company_id").orderBy("q_index")
    for name, shift in (("p", F.lag), ("n", F.lead)):
        at = at.withColumns({f"{c}_{name}": shift(c).over(w) for c in ("m", "shares", "harmonize")})
    return at.where("harmonize and harmonize_p and harmonize_n and total is not null")


def stable(m: Column) -> Column:
    """Members of a quarter in order, residual and total rows aside."""
    return F.array_sort(F.filter(F.map_keys(m), lambda k: ~k.isin(*RESERVED)))


def fill_missing_keys(rows: DataFrame, quarters: DataFrame, least: float = 0.12) -> DataFrame:
    """Rows that are added to a quarter between two of equal members that lacks one or two of these: its residual, else
    what the total leaves, is split by their mean shares there; estimates of 0.02 or less go, what is left above 0.03
    is the new residual. quarters: total, harmonize (whether rows may be made up). Neighbours are those before any filling."""
    at = _neighbours(rows, quarters).withColumns({"k": stable(F.col("m")), "k_p": stable(F.col("m_p")), "k_n": stable(F.col("m_n"))})
    lack = F.array_except("k_p", "k")
    at = at.where((F.size("k_p") > 0) & (F.col("k_p") == F.col("k_n")) & (F.size("k") > 0) & (F.size(F.array_except("k", "k_p")) == 0) & F.size(lack).between(1, 2))
    said = F.aggregate("k", F.lit(0.0), lambda a, k: a + F.col("m")[k])
    rest = F.coalesce(F.col("m")[OTHER], F.lit(0.0))
    at = at.withColumn("gap", F.when(rest > 0.02, rest).otherwise(F.greatest(F.col("total").cast("double") - said, F.lit(0.0)))).where(F.col("gap") > least)
    at = at.withColumn("w", F.transform(lack, lambda k: F.struct(k.alias("k"), ((F.coalesce(F.col("shares_p")[k], F.lit(0.0)) + F.coalesce(F.col("shares_n")[k], F.lit(0.0))) / 2).alias("w"))))
    whole = F.aggregate("w", F.lit(0.0), lambda a, x: a + x["w"])
    made = F.filter(F.transform("w", lambda x: F.struct(x["k"].alias("member_key"), F.round(F.col("gap") * x["w"] / whole, 3).alias("value"))), lambda x: x["value"] > 0.02)
    at = at.where(whole > 0.000001).withColumn("made", made)
    left = F.round(F.col("gap") - F.aggregate("made", F.lit(0.0), lambda a, x: a + x["value"]), 3)
    more = F.when(left > 0.03, F.array(F.struct(F.lit(OTHER).alias("member_key"), left.alias("value")))).otherwise(F.array().cast("array<struct<member_key:string,value:double>>"))
    return at.where(F.size("made") > 0).select(*QUARTER, F.explode(F.concat("made", more)).alias("x")).select(*QUARTER, "x.*")


def blend_neighbours(rows: DataFrame, quarters: DataFrame) -> DataFrame:
    """New rows of quarters between two of equal members (two at least) that have fewer than two rows, or other members
    with one above 82 % or a coverage outside 0.7 to 1.28: the mean shares of the neighbours times the quarter's total,
    what rounding leaves above 0.004 on the first member. quarters: total, harmonize, coverage, low (coverage too low)."""
    at = _neighbours(rows, quarters).withColumns({c: F.array_sort(F.map_keys(f"m{c[1:]}")) for c in ("k", "k_p", "k_n")})
    top = F.coalesce(F.array_max(F.map_values("shares")), F.lit(0.0))
    cover = F.coalesce(F.col("coverage").cast("double"), F.lit(1.0))
    gap = (F.size("k") < 2) | F.col("low")
    other = F.col("k") != F.col("k_p")
    fine = other & (F.size("k") >= 2) & (top < 0.82) & cover.between(0.7, 1.28)
    at = at.where((F.size("k_p") >= 2) & (F.col("k_p") == F.col("k_n")) & (gap | other) & ~fine & (F.col("total") > d(0.02)))
    share = F.transform("k_p", lambda k: F.struct(k.alias("member_key"), ((F.col("shares_p")[k] + F.col("shares_n")[k]) / 2).alias("s")))
    at = at.withColumn("x", F.filter(share, lambda x: x["s"] > 0)).withColumn("all", F.aggregate("x", F.lit(0.0), lambda a, x: a + x["s"]))
    at = at.withColumn("r", F.transform("x", lambda x: F.struct(x["member_key"].alias("member_key"), F.round(F.col("total").cast("double") * x["s"] / F.col("all"), 3).alias("value"))))
    left = F.round(F.col("total").cast("double") - F.aggregate("r", F.lit(0.0), lambda a, x: a + x["value"]), 3)
    fixed = F.transform("r", lambda x, i: F.struct(x["member_key"].alias("member_key"), F.when((i == 0) & (F.abs(left) > 0.004), F.round(x["value"] + left, 3)).otherwise(x["value"]).alias("value")))
    return at.select(*QUARTER, F.explode(fixed).alias("y")).select(*QUARTER, "y.*")


def normalize_operating_stage(df: DataFrame) -> DataFrame:
    """Operating expenses that are total costs (they include the cost of revenue) are taken apart, else resolve_opex().

    Likely where they exceed gross profit by over 0.25, not revenue by over 0.35 or 2 %, and without the cost not gross
    profit by over 0.35 or 4 %; taken so unless the breakdown (opex_items) says otherwise, and if operating income is
    missing, follows from gross profit less them, is far below revenue less them, or SG&A and R&D fit in."""
    opex = F.when(F.col("operating_expenses").isNotNull(), F.greatest(F.col("operating_expenses"), F.lit(0)))
    revenue, gross, income = F.greatest(F.col("revenue"), F.lit(0)), F.col("gross_profit"), F.col("operating_income")
    revenue = F.when(F.col("revenue").isNotNull(), revenue)
    cost = F.greatest(F.col("cost_of_revenue"), F.lit(0))
    said = F.greatest(F.coalesce("sgna", F.lit(0)), F.lit(0)) + F.greatest(F.coalesce("rnd", F.lit(0)), F.lit(0))
    items = F.coalesce("opex_items", F.lit(0)) if "opex_items" in df.columns else F.lit(0)
    staged = revenue.isNotNull() & gross.isNotNull() & F.col("cost_of_revenue").isNotNull()
    less = F.when(staged, F.greatest(opex - cost, F.lit(0)))
    profit = revenue - opex
    no = lambda c: F.coalesce(c, F.lit(False))
    share = lambda c, least, part: F.greatest(d(least), c * d(part))
    derived = no(F.abs(income - (gross - opex)) <= share(opex, 0.35, 0.015))
    likely = no(staged & (opex > gross + d(0.25)) & (opex <= revenue + share(revenue, 0.35, 0.02)) & (less <= gross + share(gross, 0.35, 0.04)))
    listed = (items > d(0.05)) & no(F.abs(items - opex) <= share(items, 0.35, 0.05))
    below = no(income < profit - share(F.abs(profit), 0.4, 0.08))
    fits = (said > d(0.05)) & no(less >= said - d(0.35))
    whole = likely & ~listed & (income.isNull() | derived | below | fits)
    at = resolve_opex(df.withColumns({"_whole": whole, "_less": less.cast("decimal(20,2)"), "_profit": profit.cast("decimal(20,2)")}))
    pick = lambda new, old: F.when(F.col("_whole"), F.col(new)).otherwise(F.col(old))
    return at.withColumns({"operating_expenses": pick("_less", "operating_expenses"), "operating_income": pick("_profit", "operating_income"), "opex_reliable": F.col("opex_reliable") & ~F.col("_whole"), "includes_cost": F.col("_whole")}).drop("_whole", "_less", "_profit")


def profile_cost(segments: DataFrame, margins: DataFrame, costs: DataFrame) -> DataFrame:
    """Cost of each segment from fixed gross margins (company_id, member_key, margin_pct, within -20 and 99.5): one
    segment without a margin takes what is left of the quarter's cost, several get none; without any the costs are
    scaled to the total if they are off by over 1.5 %. costs: total above 0.02."""
    w = Window.partitionBy(*QUARTER)
    at = segments.where(F.col("value") > d(0.02)).join(costs.where(F.col("total") > d(0.02)).select(*QUARTER, "total"), list(QUARTER)).join(margins, ["company_id", "member_key"], "left")
    own = F.round((F.col("value") * (100 - F.least(F.greatest(F.col("margin_pct"), F.lit(-20).cast("decimal(6,2)")), F.lit("99.5").cast("decimal(6,2)"))) / 100).cast("decimal(38,8)"), 3).cast(MONEY)
    at = at.withColumn("own", own).withColumns({"open": F.count_if(F.col("own").isNull()).over(w), "sum": F.sum("own").over(w)})
    rest = F.greatest(F.col("total") - F.coalesce("sum", F.lit(0)), F.lit(0)).cast(MONEY)
    scale = (F.col("total").cast("decimal(20,4)") / F.when(F.col("sum") > 0, F.col("sum").cast("decimal(20,4)"))).cast("decimal(38,12)")
    scaled = F.round(F.col("own").cast("double") * (F.col("total").cast("double") / F.col("sum").cast("double")), 3).cast(MONEY)
    cost = F.when(F.col("own").isNull(), F.when(F.col("open") == 1, rest)).when((F.col("open") == 0) & (F.abs(scale - 1) > d(0.015)), scaled).otherwise(F.col("own"))
    return at.select(*QUARTER, "member_key", cost.alias("value")).where("value is not null")


def tac_split(df: DataFrame) -> DataFrame:
    """(company_id, q_index, name, value) of quarters with traffic acquisition cost (tac) above 0.02: it, and other cost as
    given (other) or what the cost of revenue leaves, if above 0.02."""
    other = F.coalesce("other", F.greatest(F.coalesce("cost_of_revenue", F.lit(0)) - F.col("tac"), F.lit(0)))
    item = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("decimal(20,2)").alias("value"))
    items = F.array_compact(F.array(F.when(other > d(0.02), item("Other", other)), item("TAC", F.col("tac"))))
    return df.where(F.col("tac") > d(0.02)).select(*QUARTER, F.explode(items).alias("i")).select(*QUARTER, "i.*")


def infer_residual(rows: DataFrame, quarters: DataFrame) -> DataFrame:
    """(company_id, q_index, member_key, value): what a styled quarter's rows leave of revenue (over 0.08 and 6 %), under the
    member that is missing there and stands out in the company's other quarters: by the sum of (0.55 + share) / distance,
    1.18 times the second one's, 0.55 at least (0.28 if alone and within 24 quarters). quarters: revenue, style.

    Joined by company: the quarters that lack something with the rows of a history of a few dozen quarters."""
    kept = rows.where(F.col("value") > d(0.02))
    own = kept.groupBy(*QUARTER).agg(F.sum("value").alias("s"), F.collect_set("member_key").alias("has"))
    at = own.join(quarters.where((F.col("revenue") > d(0.2)) & F.col("style").isNotNull()).select(*QUARTER, "revenue"), list(QUARTER)).withColumn("rest", F.col("revenue") - F.col("s"))
    at = at.where(F.col("rest") > F.greatest(d(0.08), F.col("revenue") * d(0.06)))
    share = F.when(F.col("r2") > d(0.02), F.least(F.greatest(F.col("value").cast("double") / F.col("r2").cast("double"), F.lit(0.04)), F.lit(1.2))).otherwise(0.18)
    other = kept.where((F.col("member_key") != OTHER) & ~is_aggregate(F.col("member_key"))).join(quarters.select(*QUARTER, F.col("revenue").alias("r2")), list(QUARTER), "left").select("company_id", F.col("q_index").alias("q2"), "member_key", share.alias("share"))
    gap = F.abs(F.col("q_index") - F.col("q2"))
    found = at.join(other, "company_id").where((gap > 0) & ~F.array_contains("has", F.col("member_key")))
    score = found.groupBy(*QUARTER, "rest", "member_key").agg(F.round(F.sum((0.55 + F.col("share")) / gap), 9).alias("score"), F.min(gap).alias("near"))
    best = score.groupBy(*QUARTER, "rest").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "near", "member_key"))).alias("c"))
    one, two = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    good = (-one["s"] >= F.when(two.isNull() & (one["near"] <= 24), 0.28).otherwise(0.55)) & (two.isNull() | (-one["s"] >= -two["s"] * 1.18))
    return best.where(good).select(*QUARTER, one["member_key"].alias("member_key"), F.round("rest", 3).cast(MONEY).alias("value"))


def interpolate_nearby(rows: DataFrame, quarters: DataFrame) -> DataFrame:
    """Rows of quarters that have revenue above 0.2 and none: those of the best quarter at most two away (two rows, coverage
    0.62 to 1.18; by distance, then more rows and coverage near 1, the earlier on ties), scaled to revenue.

    An equality join on the four offsets. Interpolated quarters are no source of others."""
    kept = rows.where(F.col("value") > d(0.02))
    own = kept.groupBy(*QUARTER).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).join(quarters.select(*QUARTER, "revenue"), list(QUARTER))
    cover = (F.col("s").cast("decimal(24,4)") / F.when(F.col("revenue") > d(0.02), F.col("revenue").cast("decimal(24,4)"))).cast("decimal(38,12)")
    good = own.withColumn("cover", cover).where((F.col("n") >= 2) & F.col("cover").between(d(0.62), d(1.18))).select("company_id", F.col("q_index").alias("q2"), "n", "s", "cover")
    bare = quarters.where(F.col("revenue") > d(0.2)).join(own.select(*QUARTER), list(QUARTER), "left_anti").select(*QUARTER, "revenue", F.explode(F.array(*map(F.lit, NEAR))).alias("o")).withColumn("q2", F.col("q_index") + F.col("o"))
    score = F.round(F.abs("o") * 100 - F.col("n") * 4 + F.abs(F.col("cover") - 1).cast("double") * 20, 9)
    best = bare.join(good, ["company_id", "q2"]).groupBy(*QUARTER, "revenue").agg(F.min_by(F.struct("q2", "s"), F.struct(score.alias("score"), "q2")).alias("b"))
    source = kept.select("company_id", F.col("q_index").alias("q2"), "member_key", "value")
    at = best.select(*QUARTER, "revenue", "b.*").join(source, ["company_id", "q2"])
    value = F.round((F.col("value").cast("decimal(20,3)") * F.col("revenue").cast("decimal(16,2)") / F.col("s").cast("decimal(20,3)")).cast("decimal(38,8)"), 3)
    return at.select(*QUARTER, "member_key", value.cast(MONEY).alias("value"), F.col("q2").alias("from_q"))


def cap_and_balance(rows: DataFrame, quarters: DataFrame, most: int = 7) -> DataFrame:
    """At most `most` rows of a quarter, the largest first, brought to its revenue: over that number all but most - 1 go;
    what is missing (over 0.08) is a residual row; where rows exceed revenue by over 0.08, they are taken in order while
    they fit (0.04; two in any case), the rest is residual. Without revenue above 0.02 rows stay."""
    item = F.struct((-F.col("value").cast("double")).alias("v"), "member_key")
    per = rows.groupBy(*QUARTER).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["member_key"].alias("member_key"), (-x["v"]).alias("value"))).alias("r")).join(quarters.select(*QUARTER, F.col("revenue").cast("double").alias("revenue")), list(QUARTER), "left")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["value"])
    kind = "array<struct<member_key:string,value:double>>"

    def rest(a: Column) -> Column:
        left = F.round(F.col("revenue") - total(a), 3)
        return F.when(left > 0.02, F.array(F.struct(F.lit(OTHER).alias("member_key"), left.alias("value")))).otherwise(F.array().cast(kind))

    at = per.withColumn("a", F.when(F.size("r") > most, F.slice("r", 1, most - 1)).otherwise(F.col("r")))
    at = at.withColumn("b", F.when(total(F.col("a")) < F.col("revenue") - 0.08, F.concat("a", rest(F.col("a")))).otherwise(F.col("a")))
    state = F.struct(F.lit(0.0).alias("t"), F.array().cast(kind).alias("k"))
    step = lambda s, x: F.when((F.size(s["k"]) < most - 1) & ((s["t"] + x["value"] <= F.col("revenue") + 0.04) | (F.size(s["k"]) < 2)), F.struct((s["t"] + x["value"]).alias("t"), F.concat(s["k"], F.array(x)).alias("k"))).otherwise(s)
    at = at.withColumn("c", F.aggregate(F.filter("b", lambda x: x["member_key"] != OTHER), state, step, lambda s: s["k"]))
    over = (total(F.col("b")) > F.col("revenue") + 0.08) & (F.size("b") > 1)
    out = F.when(F.coalesce(F.col("revenue"), F.lit(0.0)) <= 0.02, F.col("r")).when(over, F.concat("c", rest(F.col("c")))).otherwise(F.col("b"))
    return at.select(*QUARTER, F.explode(out).alias("x")).select(*QUARTER, "x.member_key", F.round("x.value", 3).alias("value"))


def flows_to_revenue(rows: DataFrame, quarters: DataFrame) -> DataFrame:
    """Adds flow: rows scaled to revenue where they exceed it by over 0.02 and 0.2 %, the last (smallest) row takes what
    rounding leaves; else the value."""
    w = Window.partitionBy(*QUARTER)
    order = w.orderBy(F.col("value").desc(), "member_key")
    at = rows.join(quarters.select(*QUARTER, "revenue"), list(QUARTER), "left").withColumns({"_s": F.sum("value").over(w), "_r": F.row_number().over(order), "_n": F.count(F.lit(1)).over(w)})
    over = F.coalesce((F.col("revenue") > 0) & (F.col("_s") > F.col("revenue") + F.greatest(d(0.02), F.col("revenue") * d(0.002))), F.lit(False))
    scaled = F.round((F.col("value").cast("decimal(20,3)") * F.col("revenue").cast("decimal(16,2)") / F.col("_s").cast("decimal(20,3)")).cast("decimal(38,8)"), 3).cast(MONEY)
    at = at.withColumn("_f", F.when(over, F.greatest(scaled, F.lit(0))).otherwise(F.col("value")).cast(MONEY))
    before = F.coalesce(F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.when(over & (F.col("_r") == F.col("_n")), F.greatest(F.col("revenue") - before, F.lit(0)))
    return at.select(*QUARTER, "member_key", "value", F.coalesce(last, F.col("_f")).cast(MONEY).alias("flow"))


def detail_groups(details: DataFrame, rows: DataFrame, least: float = 0.55) -> DataFrame:
    """Details (target, member_key, value) of rows that are there, in order of their parent's place, then value; a lone
    detail that covers less than `least` of its parent goes."""
    place = F.row_number().over(Window.partitionBy(*QUARTER).orderBy(F.col("value").desc(), "member_key"))
    parents = rows.select(*QUARTER, F.col("member_key").alias("target"), F.col("value").alias("_whole"), place.alias("parent"))
    at = details.where(F.col("value") > d(0.02)).join(parents, [*QUARTER, "target"]).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*QUARTER, "target")))
    at = at.where((F.col("_n") > 1) | (F.col("value") >= F.col("_whole") * d(least)))
    order = Window.partitionBy(*QUARTER).orderBy("parent", F.col("value").desc(), "member_key")
    return at.select(*QUARTER, "target", "member_key", "value", F.row_number().over(order).alias("place"))


def first_rows(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str] = QUARTER) -> DataFrame:
    """Rows of the first source that has any of a quarter, with its name: one window, no join."""
    every = None
    for i, (name, df) in enumerate(sources):
        df = df.withColumns({"source": F.lit(name), "_rank": F.lit(i)})
        every = df if every is None else every.unionByName(df)
    return every.withColumn("_first", F.min("_rank").over(Window.partitionBy(*keys))).where("_rank = _first").drop("_rank", "_first")


def history_groups(history: DataFrame, quarters: DataFrame) -> DataFrame:
    """History rows as amounts of the statement: divided by the quarter's display scale (none: 1)."""
    at = history.join(quarters.select(*QUARTER, "scale"), list(QUARTER))
    return at.select(*QUARTER, "member_key", F.round((F.col("value").cast("decimal(24,4)") / F.when(F.coalesce("scale", F.lit(0)) > 0, F.col("scale").cast("decimal(12,6)")).otherwise(F.lit(1).cast("decimal(12,6)"))).cast("decimal(38,8)"), 3).cast(MONEY).alias("value")).where(F.col("value") > d(0.02))


def choose_rows(preset: DataFrame, official: DataFrame, history: DataFrame, quarters: DataFrame) -> DataFrame:
    """A quarter's rows: preset ones, else official, else those of its history, else one row of the reported revenue."""
    columns = [*QUARTER, "member_key", "value"]
    reported = quarters.where(F.col("revenue") > d(0.02)).select(*QUARTER, F.lit("reportedrevenue").alias("member_key"), F.col("revenue").cast(MONEY).alias("value"))
    take = lambda df: df.where(F.col("value") > d(0.02)).select(*QUARTER, "member_key", F.col("value").cast(MONEY).alias("value"))
    return first_rows([("preset", take(preset)), ("official", take(official)), ("history", history_groups(history, quarters).select(columns)), ("reported", reported)])


# Fixed values. More labels that stand for all or the rest of the segments.
REST_LABELS = ("other segments", "all other segments", "corporate non")


def prune_labels(rows: DataFrame, most: int = 12, least: int = 3) -> DataFrame:
    """The `most` largest named rows of a quarter above 0.02; of `least` or more, those go whose label has an "other" twin,
    reads like a total, or combines two others, unless none would be left."""
    w = Window.partitionBy(*QUARTER)
    at = rows.where(F.col("value") > d(0.02)).withColumn("_r", F.row_number().over(w.orderBy(F.col("value").desc(), "name"))).where(F.col("_r") <= most)
    at = at.withColumns({"_all": F.collect_set("name").over(w), "_n": F.count(F.lit(1)).over(w)})
    label = normal_label(F.col("name"))
    twin = ~label.startswith("other ") & F.exists("_all", lambda o: normal_label(o) == F.concat(F.lit("other "), label))
    bad = twin | is_aggregate(F.col("name")) | label.isin(*REST_LABELS) | (combines(F.col("name"), F.filter("_all", lambda o: ~normal_label(o).isin(*REST_LABELS))) >= 2)
    at = at.withColumn("_keep", (F.col("_n") < least) | ~bad)
    return at.withColumn("_some", F.max("_keep").over(w)).where(F.col("_keep") | ~F.col("_some")).select(*rows.columns)
