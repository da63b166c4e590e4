"""Quarters between two neighbours of one key set: gaps filled, other schemas brought to the neighbours', shares rebalanced.

Quarters are rows as of phases.profiles() with source, coverage, and what is known of their rows: has_raw, reported_only,
insufficient, filled. Neighbours are the quarters before and after in the history, as they were before the pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlode.operators.phases import LEAST, RESIDUALS, ROWS, aligned, bound, keys_of, ordered, reconciled, share, sum_of
from quarterlode.operators.templates import from_shares, shares_of


def stable_keys(rows: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(keys_of(rows), lambda k: ~k.isin(*RESIDUALS) & (k != ""))))


def _between(quarters: DataFrame) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy("q_index")
    state = F.struct("total", "style", "rows", "profile", "source")
    return quarters.withColumns({"_p": F.lag(state).over(w), "_n": F.lead(state).over(w)})


def _of(shares: Column, key: Column) -> Column:
    return F.coalesce(F.get(F.filter(shares, lambda x: x["key"] == key), F.lit(0))["s"], F.lit(0.0))


def _apart() -> Column:
    """Both neighbours have two rows and one key set, which the quarter between has not; all have revenue."""
    p, n = F.col("_p"), F.col("_n")
    revenue = (F.col("total") > LEAST) & (p["total"] > LEAST) & (n["total"] > LEAST)
    pk = stable_keys(p["rows"])
    return revenue & (F.size(p["rows"]) >= 2) & (F.size(n["rows"]) >= 2) & (F.size(pk) > 0) & (pk == stable_keys(n["rows"])) & (stable_keys(F.col("rows")) != pk)


def sandwich_segments(quarters: DataFrame) -> DataFrame:
    """quarters with rows of official segments brought to the neighbours' keys, and `mode` ('gap-filled', 'harmonized' or null).

    Members that the quarter alone lacks share the residual row, or what revenue leaves, by their mean shares next door (over
    120 thousandths; what is left above 30 is a residual). Otherwise all rows are made from mean shares. Not where coverage is
    outside 0.72 to 1.6 or revenue outside 0.45 to 1.85 of the neighbours' mean."""
    at = _between(quarters)
    p, n, cover, none = F.col("_p"), F.col("_n"), F.col("coverage").cast("double"), F.array().cast(ROWS)
    mean = (p["total"] + n["total"]).cast("double") / 2
    jump = F.col("total").cast("double") / mean
    other = lambda x: F.coalesce(x["source"], F.lit("")) != "fallback-reported"
    ok = _apart() & (F.col("source") == "official-segments") & other(p) & other(n) & (cover.isNull() | cover.between(0.72, 1.6)) & ((mean <= LEAST) | jump.between(0.45, 1.85))
    at = at.withColumns({"_ok": F.coalesce(ok, F.lit(False)), "_ps": shares_of(p["rows"]), "_ns": shares_of(n["rows"]), "_pk": stable_keys(p["rows"]), "_ck": stable_keys(F.col("rows"))})
    both = lambda k: (_of(F.col("_ps"), k) + _of(F.col("_ns"), k)) / 2
    missing, extra = F.array_except("_pk", "_ck"), F.array_except("_ck", "_pk")
    rest = sum_of(F.filter("rows", lambda r: r["key"] == "otherrevenue"))
    stable = sum_of(F.filter("rows", lambda r: ~r["key"].isin(*RESIDUALS)))
    gap = F.when(rest > LEAST, rest).otherwise(F.greatest(F.col("total") - stable, F.lit(0)))

    def filled(x: Column) -> Column:
        """x: gap and the missing members' weights."""
        weight = F.aggregate(x["w"], F.lit(0.0), lambda a, y: a + y["s"])
        made = F.filter(F.transform(x["w"], lambda y: F.struct(y["key"].alias("key"), F.round(x["gap"].cast("double") * y["s"] / weight, 0).cast("long").alias("v"), F.lit(False).alias("opt"))), lambda r: r["v"] > LEAST)

        def put(m: Column) -> Column:
            left = x["gap"] - sum_of(m)
            residual = F.when(left > 30, F.array(F.struct(F.lit("otherrevenue").alias("key"), left.alias("v"), F.lit(True).alias("opt")))).otherwise(none)
            rows = F.concat(F.filter("rows", lambda r: r["key"] != "otherrevenue"), m, residual)
            return F.when(sum_of(m) > LEAST, ordered(F.filter(rows, lambda r: r["v"] > LEAST))).otherwise(none)

        return F.when((x["gap"] > 120) & (weight > 1e-6), bound(made, put)).otherwise(none)

    weights = F.struct(gap.alias("gap"), F.transform(missing, lambda k: F.struct(both(k).alias("s"), k.alias("key"))).alias("w"))
    at = at.withColumn("_fill", F.when(F.col("_ok") & (F.size(missing) > 0) & (F.size(extra) == 0), bound(weights, filled)).otherwise(none))
    blend = from_shares(F.transform("_pk", lambda k: F.struct(both(k).alias("s"), k.alias("key"))), F.col("total"))
    at = at.withColumn("_blend", F.when(F.col("_ok") & (F.size("_fill") == 0), blend).otherwise(none))
    mode = F.when(F.size("_fill") > 0, "gap-filled").when(F.size("_blend") > 0, "harmonized")
    rows = F.when(F.size("_fill") > 0, F.col("_fill")).when(F.size("_blend") > 0, F.col("_blend")).otherwise(F.col("rows"))
    return at.withColumns({"mode": mode, "rows": rows}).drop("_p", "_n", "_ok", "_ps", "_ns", "_pk", "_ck", "_fill", "_blend")


def sandwich_groups(quarters: DataFrame) -> DataFrame:
    """quarters with rows of official groups aligned to the quarter before, and `mode` ('groups-aligned' or null), where
    alignment gives the neighbours' keys and coverage is within 0.95 and 1.05; aligned rows are reconciled with the total."""
    at, cover = _between(quarters), F.col("coverage").cast("double")
    ok = _apart() & (F.col("source") == "official-groups") & (cover.isNull() | cover.between(0.95, 1.05))
    at = at.withColumn("_v", F.when(ok, aligned(F.col("_p"), F.struct("total", "style", "rows", "profile"))))
    good = F.coalesce(F.col("_v")["comparable"] & (stable_keys(F.col("_v")["rows"]) == stable_keys(F.col("_p")["rows"])), F.lit(False))
    rows = F.when(good, reconciled(F.col("_v")["rows"], F.col("total"), 0.62)).otherwise(F.col("rows"))
    return at.withColumns({"mode": F.when(good, "groups-aligned"), "rows": rows}).drop("_p", "_n", "_v")


def trusted() -> Column:
    """Whether a quarter's rows are as reported: not filled, from a source, coverage 0.94 to 1.12, residual 5 % at most."""
    cover, rest = F.col("coverage").cast("double"), sum_of(F.filter("rows", lambda r: r["key"] == "otherrevenue"))
    source = ~F.coalesce("source", F.lit("none")).isin("fallback-reported", "none")
    sound = F.col("has_raw") & ~F.col("reported_only") & ~F.col("insufficient") & ~F.col("filled") & ~F.col("conceptual") & source
    return F.coalesce(sound & (cover.isNull() | cover.between(0.94, 1.12)) & (share(rest, F.col("total")) <= 0.05), F.lit(False))


def rebalance(quarters: DataFrame) -> DataFrame:
    """quarters with rows made from the neighbours' mean shares where one member has run away, and `mode` ('rebalanced' or null).

    All three have the same two keys or more; a share is over 0.3 from the neighbours' mean, the largest over 0.68, revenue
    below 1.3 times the neighbours' mean; rows that are trusted stay. What rounding leaves above four thousandths goes to
    the largest row."""
    at = _between(quarters)
    p, n = F.col("_p"), F.col("_n")
    keys = lambda r: F.array_sort(F.array_distinct(keys_of(r)))
    same = (F.size("rows") >= 2) & (F.size(p["rows"]) >= 2) & (F.size(n["rows"]) >= 2) & (keys(F.col("rows")) == keys(p["rows"])) & (keys(F.col("rows")) == keys(n["rows"])) & (F.col("total") > LEAST)
    at = at.withColumns({"_ps": shares_of(p["rows"]), "_ns": shares_of(n["rows"]), "_cs": shares_of(F.col("rows"))})
    both = lambda k: (_of(F.col("_ps"), k) + _of(F.col("_ns"), k)) / 2
    off = F.array_max(F.transform("_cs", lambda x: F.abs(x["s"] - both(x["key"]))))
    top = F.array_max(F.transform("_cs", lambda x: x["s"]))
    mean = (p["total"] + n["total"]).cast("double") / 2
    jump = F.when(mean > LEAST, F.col("total").cast("double") / mean).otherwise(1.0)
    ok = F.coalesce(same & (off > 0.3) & (top > 0.68) & (jump < 1.3), F.lit(False)) & ~trusted() & ~F.coalesce("smoothed", F.lit(False))

    def balanced(rows: Column) -> Column:
        rest = F.col("total") - sum_of(rows)
        return ordered(F.transform(rows, lambda r, i: F.struct(r["key"].alias("key"), (r["v"] + F.when((i == 0) & (F.abs(rest) > 4), rest).otherwise(0)).alias("v"), r["opt"].alias("opt"))))

    made = F.transform("rows", lambda r: F.struct(r["key"].alias("key"), F.round(F.col("total").cast("double") * F.least(both(r["key"]), F.lit(1.0)), 0).cast("long").alias("v"), r["opt"].alias("opt")))
    at = at.withColumn("_ok", ok)
    return at.withColumns({"mode": F.when(F.col("_ok"), "rebalanced"), "rows": F.when(F.col("_ok"), bound(made, balanced)).otherwise(F.col("rows"))}).drop("_p", "_n", "_ps", "_ns", "_cs", "_ok")
