"""Quarters of a segment history that others are filled from: reliable templates, the nearest one, fills, the second pass.

Quarters are rows as of phases.phases(), with what is known of their source: has_raw, reported_only, insufficient, harmonize
(may be changed freely), source, schema, family, partial (rows of a legacy schema are part of the revenue only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlode.operators.history import QUARTER
from quarterlode.operators.phases import LEAST, ROWS, align_to_phase, bound, comparable_rows, ordered, phases, sum_of

EDGE = 3  # templates at the edge of a phase whose mean shares are used beyond it
DOMINANT, DOMINANT_SHARE = 6, 0.75  # templates of a phase that others lean on; their share of all for a last fill
FAR, NEAR = 16, 4  # quarters between a template and what it fills


def reliable_templates(quarters: DataFrame) -> DataFrame:
    """quarters with `idx` (place in the company's history, from 1), `template`, and of the company: `dominant` (the phase with
    most templates, the earliest of equals; null without), `n_dominant`, `n_templates`."""
    whole = Window.partitionBy("company_id")
    several = F.max((F.size("rows") >= 2).cast("int")).over(whole) == 1
    cover = F.coalesce(F.col("coverage").cast("double"), F.lit(0.0))
    sound = F.col("harmonize") | ((F.coalesce("source", F.lit("")) != "fallback-reported") & cover.between(0.78, 1.22))
    template = F.col("has_raw") & ~F.col("reported_only") & ~F.col("insufficient") & ~F.col("conceptual") & (~several | (F.size("rows") >= 2)) & sound & (F.size("rows") > 0)
    at = quarters.withColumn("idx", F.row_number().over(whole.orderBy("q_index"))).withColumn("template", F.coalesce(template, F.lit(False)))
    per = at.where("template").groupBy("company_id", "phase").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("phase").isNotNull()
    best = per.groupBy("company_id").agg(F.max_by("phase", F.when(named, F.struct("n", -F.col("phase")))).alias("dominant"), F.coalesce(F.max(F.when(named, F.col("n"))), F.lit(0)).alias("n_dominant"), F.sum("n").alias("n_templates"))
    return at.join(best, "company_id", "left").withColumns({"n_dominant": F.coalesce("n_dominant", F.lit(0)), "n_templates": F.coalesce("n_templates", F.lit(0))})


def _nearest(kept: Column, *keys: str) -> Column:
    """idx of the nearest template for which `kept` holds among the rows of equal keys; the earlier of two equally near."""
    w, mine = Window.partitionBy("company_id", *keys).orderBy("idx"), F.when(F.col("template") & kept, F.col("idx"))
    past = F.last(mine, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    future = F.first(mine, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.when(past.isNull() | (future - F.col("idx") < F.col("idx") - past), future).otherwise(past)


def pick_templates(quarters: DataFrame) -> DataFrame:
    """quarters (as of reliable_templates) with `from_idx`, the template that fills a quarter, and `tier`, how it was found.

    Asked are quarters with revenue and fewer than two rows, or with rows that stand for nothing. The nearest template of the
    same schema is taken, else of the same phase, else (outside phases) of the same family, else the last before, else the
    first behind; where the legacy schema is partial, the first behind goes first. Coarse or partial quarters lean on the
    dominant phase if it has DOMINANT templates. Null where that phase is not theirs to use, or the template is too far."""
    any_ = F.lit(True)
    w = Window.partitionBy("company_id").orderBy("idx")
    mine = F.when(F.col("template"), F.col("idx"))
    at = quarters.withColumns(
        {
            "_schema": _nearest(any_, "schema"),
            "_phase": F.when(F.col("phase").isNotNull(), _nearest(any_, "phase")),
            "_family": F.when(F.col("phase").isNull(), _nearest(any_, "family")),
            "_past": F.last(mine, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "_future": F.first(mine, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
            "_dominant": _nearest(F.coalesce(F.col("phase") == F.col("dominant"), F.lit(False))),
        }
    )
    partial = F.coalesce("partial", F.lit(False))
    coarse = ~F.col("has_raw") | F.col("reported_only") | (F.col("substantive") <= 1) | F.col("conceptual")
    needs = (F.col("total") > LEAST) & ((F.size("rows") < 2) | F.col("reported_only") | F.col("insufficient") | F.col("conceptual"))
    lean = ~F.col("harmonize") & (F.col("n_dominant") >= DOMINANT) & (coarse | partial) & F.col("_dominant").isNotNull()
    tiers = [("dominant", F.when(lean, F.col("_dominant"))), ("schema", F.col("_schema")), ("phase", F.col("_phase")), ("family", F.col("_family")), ("future", F.when(partial, F.col("_future"))), ("past", F.col("_past")), ("future", F.col("_future"))]
    found = F.coalesce(*(F.when(c.isNotNull(), F.struct(F.lit(t).alias("tier"), c.alias("idx"))) for t, c in tiers))
    at = at.withColumn("_t", F.when(needs, found)).drop("_schema", "_phase", "_family", "_past", "_future", "_dominant")
    of = at.select(F.col("company_id").alias("_c"), F.col("idx").alias("_i"), F.col("phase").alias("_of_phase"))
    at = at.join(of, (F.col("company_id") == F.col("_c")) & (F.col("_t.idx") == F.col("_i")), "left")
    usable = F.col("harmonize") | (F.coalesce(F.col("_of_phase") == F.col("dominant"), F.lit(False)) & (F.col("n_dominant") >= DOMINANT) & (coarse | partial))
    reach = F.when(~F.col("harmonize") | partial, FAR).otherwise(NEAR)
    good = usable & (F.abs(F.col("_t.idx") - F.col("idx")) <= reach)
    return at.withColumns({"from_idx": F.when(good, F.col("_t.idx")), "tier": F.when(good, F.col("_t.tier"))}).drop("_t", "_c", "_i", "_of_phase")


def fill(picked: DataFrame) -> DataFrame:
    """(company_id, q_index, from_idx, rows) of quarters with a from_idx: the template's shares, or before the first and behind
    the last template of the template's phase the mean shares of the EDGE templates there, times the quarter's total.

    What rounding leaves above four thousandths goes to the row of the largest share (ties: the first key)."""
    shares = shares_of(F.col("rows"))
    wp = Window.partitionBy("company_id", "phase")
    named = F.col("phase").isNotNull()
    first, last = (F.row_number().over(wp.orderBy(o)) for o in (F.col("idx").asc(), F.col("idx").desc()))
    made = picked.where("template").withColumns({"_s": shares, "_low": F.when(named, F.min("q_index").over(wp)).otherwise(F.col("q_index")), "_high": F.when(named, F.max("q_index").over(wp)).otherwise(F.col("q_index")), "_first": F.when(named, first).otherwise(1), "_last": F.when(named, last).otherwise(1)})
    # Mean shares of both edges; a template without a phase is its own edge.
    edge = F.coalesce(F.col("phase").cast("string"), F.concat(F.lit("="), F.col("idx")))
    sides = F.array_compact(F.array(F.when(F.col("_first") <= EDGE, F.lit("before")), F.when(F.col("_last") <= EDGE, F.lit("behind"))))
    ends = made.where(F.size("rows") >= 2).select("company_id", edge.alias("_edge"), "_s", F.explode(sides).alias("_side")).select("company_id", "_edge", "_side", F.explode("_s").alias("x"))
    ends = ends.groupBy("company_id", "_edge", "_side", "x.key").agg(F.sum("x.s").alias("s")).groupBy("company_id", "_edge", "_side").agg(F.collect_list(F.struct("s", "key")).alias("_mean"))
    of = made.select("company_id", F.col("idx").alias("from_idx"), "_s", "_low", "_high", edge.alias("_edge"))
    at = picked.where("from_idx is not null").select(*QUARTER, "from_idx", "total").join(of, ["company_id", "from_idx"])
    at = at.withColumn("_side", F.when(F.col("q_index") < F.col("_low"), "before").when(F.col("q_index") > F.col("_high"), "behind"))
    at = at.join(ends, ["company_id", "_edge", "_side"], "left").withColumn("_use", F.coalesce("_mean", "_s"))
    return at.select(*QUARTER, "from_idx", from_shares(F.col("_use"), F.col("total")).alias("rows")).where(F.size("rows") > 0)


def shares_of(rows: Column) -> Column:
    """(s, key) of rows that add up to more than LEAST."""
    none = F.array().cast("array<struct<s:double,key:string>>")
    return bound(sum_of(rows), lambda t: F.when(t > LEAST, F.transform(rows, lambda r: F.struct((r["v"].cast("double") / t.cast("double")).alias("s"), r["key"].alias("key")))).otherwise(none))


def from_shares(shares: Column, total: Column) -> Column:
    """Rows of a total by shares made to add up to 1; nothing without a total."""

    def valued(x: Column) -> Column:
        whole = F.aggregate(x, F.lit(0.0), lambda a, r: a + r["s"])
        return bound(F.transform(x, lambda r: F.struct(r["key"].alias("key"), F.round(total.cast("double") * (r["s"] / whole), 0).cast("long").alias("v"))), balanced)

    def balanced(rows: Column) -> Column:
        rest = total - F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + r["v"])
        return F.transform(rows, lambda r, i: F.struct(r["key"].alias("key"), (r["v"] + F.when((i == 0) & (F.abs(rest) > 4), rest).otherwise(0)).alias("v"), F.lit(False).alias("opt")))

    positive = F.array_sort(F.filter(shares, lambda r: r["s"] > 0), lambda a, b: F.when(a["s"] != b["s"], F.signum(b["s"] - a["s"]).cast("int")).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.when((total > LEAST) & (F.size(positive) > 0), ordered(bound(positive, valued))).otherwise(F.array().cast(ROWS))


def template_fill(quarters: DataFrame) -> DataFrame:
    """quarters (as of phases()) with rows filled from templates, and filled, from_idx, tier; a filled quarter outside phases
    takes the template's phase."""
    picked = pick_templates(reliable_templates(quarters))
    return _put(picked, fill(picked))


def _put(picked: DataFrame, made: DataFrame) -> DataFrame:
    new = made.select(*QUARTER, F.col("rows").alias("_rows"))
    at = picked.join(new, list(QUARTER), "left").withColumns({"filled": F.col("_rows").isNotNull(), "rows": F.coalesce("_rows", "rows")}).drop("_rows")
    of = picked.select(F.col("company_id").alias("_c"), F.col("idx").alias("_i"), F.col("phase").alias("_of_phase"))
    at = at.join(of, (F.col("company_id") == F.col("_c")) & (F.col("from_idx") == F.col("_i")), "left")
    return at.withColumn("phase", F.coalesce("phase", F.when(F.col("filled"), F.col("_of_phase")))).drop("_c", "_i", "_of_phase")


def promote_filled(filled: DataFrame) -> DataFrame:
    """Quarters whose filled rows stand in for nothing become quarters of their own: their rows count as reported in full."""
    up = F.col("filled") & (F.col("reported_only") | F.col("insufficient") | F.col("conceptual"))
    flags = {"reported_only": F.lit(False), "insufficient": F.lit(False), "has_raw": F.lit(True), "coverage": F.lit(1).cast("decimal(10,4)"), "reliable": F.col("total") > LEAST}
    at = filled.withColumn("promoted", up).withColumns({c: F.when(up, v).otherwise(F.col(c)) for c, v in flags.items()})
    return at.withColumn("profile", F.when(up, comparable_rows(F.col("rows"))).otherwise(F.col("profile")))


def second_pass(filled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What phases and alignment give once more with filled rows promoted: quarters as of phases(), rows as of align_to_phase()."""
    again = phases(promote_filled(filled).drop("phase", "anchor", "member"))
    return again, align_to_phase(again)[1]


def fallback_fill(quarters: DataFrame) -> DataFrame:
    """Quarters (as of reliable_templates) without rows get their revenue as one row; such quarters are filled from the
    nearest template of the dominant phase if it has DOMINANT templates and DOMINANT_SHARE of all. Adds from_idx, filled."""
    bare = F.array(F.struct(F.lit("reportedrevenue").alias("key"), F.col("total").alias("v"), F.lit(True).alias("opt")))
    at = quarters.withColumn("rows", F.when((F.size("rows") == 0) & (F.col("total") > LEAST), bare).otherwise(F.col("rows")))
    near = _nearest(F.coalesce(F.col("phase") == F.col("dominant"), F.lit(False)))
    trusted = (F.col("n_dominant") >= DOMINANT) & (F.col("n_dominant") / F.col("n_templates") >= DOMINANT_SHARE)
    only = (F.col("total") > LEAST) & (F.size("rows") == 1) & (F.get("rows", F.lit(0))["key"] == "reportedrevenue")
    picked = at.withColumn("_near", near).withColumn("from_idx", F.when(trusted & only, F.col("_near"))).drop("_near")
    return _put(picked, fill(picked))
