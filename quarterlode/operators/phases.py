"""Regimes of a segment history: whether two quarters are comparable, phases with a moving anchor, alignment to it.

A quarter is one row with its members in an array of (key, v, opt), v in whole thousandths so that sums are exact, opt
for residuals and labels that read like totals. Rules on two quarters are one expression over two such rows, so the same
expression serves a join of pairs and the ordered fold over a company's quarters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlode.operators.history import QUARTER, d, reconcile_to_total
from quarterlode.operators.segments import is_aggregate, normal_label

ROWS = "array<struct<key:string,v:bigint,opt:boolean>>"
RESIDUALS = ("otherrevenue", "reportedrevenue")
# Fixed values. Names of revenue components that are no segments.
CONCEPTS = ("sales and other operating revenue", "income from equity affiliates", "other revenue interest", "fees and commissions", "service charges", "noninterest income", "interest income expense net")
LEAST = 20  # thousandths; what is not above is no row


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def once(at: DataFrame, **columns: Column) -> DataFrame:
    """at with columns worked out once a row. They are exploded, so that no filter or column behind is merged with them and
    works them out again; names that `at` has are replaced."""
    made = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("_once")
    return at.select(*at.columns, made).select(*(c for c in at.columns if c not in columns), "_once.*")


def thousandths(c: Column) -> Column:
    return F.round(c * 1000).cast("long")


def keys_of(rows: Column) -> Column:
    return F.transform(rows, lambda r: r["key"])


def sum_of(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + r["v"])


def share(v: Column, total: Column) -> Column:
    return v.cast("double") / F.greatest(F.coalesce(total, F.lit(0)), F.lit(1)).cast("double")


def ordered(rows: Column) -> Column:
    """Rows by value, the largest first, then by key."""
    return F.array_sort(rows, lambda a, b: F.when(a["v"] != b["v"], F.signum(b["v"] - a["v"]).cast("int")).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def comparable_rows(rows: Column) -> Column:
    """Rows above LEAST but the reported total; without optional ones where two others stay."""

    def told(kept: Column) -> Column:
        plain = F.filter(kept, lambda r: ~r["opt"])
        return F.when(F.size(plain) >= 2, plain).otherwise(kept)

    return bound(F.filter(rows, lambda r: (r["key"] != "reportedrevenue") & (r["v"] > LEAST)), told)


def profiles(segments: DataFrame, quarters: DataFrame) -> DataFrame:
    """quarters with `total` in thousandths, `rows` and `profile` (comparable rows; both empty where there are no segments),
    `substantive` (how many rows are no optional ones) and `conceptual` (two or more of these, all of CONCEPTS).

    segments: member_key, name (may be null), value; a member is in a quarter once."""
    opt = F.col("member_key").isin(*RESIDUALS, "") | F.coalesce(is_aggregate(F.col("name")), F.lit(False))
    item = F.struct(F.col("member_key").alias("key"), thousandths(F.col("value")).alias("v"), opt.alias("opt"))
    real = ~opt & (thousandths(F.col("value")) > LEAST)
    concept = F.regexp_like(normal_label(F.coalesce("name", "member_key")), F.lit("|".join(CONCEPTS)))
    counts = F.count_if(real).alias("substantive"), F.count_if(real & ~concept).alias("_segments")
    per = segments.groupBy(*QUARTER).agg(F.collect_list(item).alias("rows"), *counts)
    per = per.withColumn("conceptual", (F.col("substantive") >= 2) & (F.col("_segments") == 0)).drop("_segments")
    at = quarters.join(per, list(QUARTER), "left").withColumns({"rows": ordered(F.coalesce("rows", F.array().cast(ROWS))), "total": thousandths(F.col("total")), "substantive": F.coalesce("substantive", F.lit(0)), "conceptual": F.coalesce("conceptual", F.lit(False))})
    return at.withColumn("profile", comparable_rows(F.col("rows")))


def aligned(anchor: Column, quarter: Column) -> Column:
    """(comparable, reason, rows) of a quarter against an anchor, both with total, style, rows and profile.

    One member of the anchor that the quarter lacks may be bundled from one to three that only the quarter has, where
    both have a like share. Comparable are quarters of one style with two common members that hold 45 % of the anchor, or
    of any style with two common members and a Jaccard index of 0.58, or 55 % in common and at most 26 % apart."""
    a, c = anchor, quarter
    none = F.array().cast(ROWS)
    result = lambda ok, reason, rows: F.struct(F.lit(ok).alias("comparable"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), rows.alias("rows"))
    style = lambda q: F.nullif(F.lower(F.trim(F.coalesce(q["style"], F.lit("")))), F.lit(""))

    def without(rows: Column, other: Column) -> Column:
        """Rows whose key the other rows have not."""
        return bound(keys_of(other), lambda k: F.filter(rows, lambda r: ~F.array_contains(k, r["key"])))

    def within(rows: Column, other: Column) -> Column:
        return bound(keys_of(other), lambda k: F.filter(rows, lambda r: F.array_contains(k, r["key"])))

    def bundle(s: Column) -> Column:
        """s: missing, extra -> (rows, profile, bundled)."""
        value = sum_of(within(c["rows"], s["extra"]))
        asked = (F.size(s["missing"]) == 1) & F.size(s["extra"]).between(1, 3) & (F.size(a["profile"]) - F.size(s["missing"]) >= 2)

        def judged(x: Column) -> Column:
            like = ((x["m"] > 0.1) & (x["e"] > 0.1) & (x["e"] / F.greatest(x["m"], F.lit(0.001))).between(0.55, 1.8)) | (F.abs(x["m"] - x["e"]) <= 0.18)
            row = F.array(F.struct(x["row"]["key"].alias("key"), x["value"].alias("v"), x["row"]["opt"].alias("opt")))
            made = F.concat(without(c["rows"], s["extra"]), row)
            plain = F.struct(c["rows"].alias("rows"), c["profile"].alias("profile"), F.lit(False).alias("bundled"))
            return F.when(like, bound(made, lambda r: F.struct(r.alias("rows"), comparable_rows(r).alias("profile"), F.lit(True).alias("bundled")))).otherwise(plain)

        x = F.struct(F.get(s["missing"], F.lit(0)).alias("row"), value.alias("value"), share(F.get(s["missing"], F.lit(0))["v"], a["total"]).alias("m"), share(value, c["total"]).alias("e"))
        return F.when(asked, bound(x, judged)).otherwise(F.struct(c["rows"].alias("rows"), c["profile"].alias("profile"), F.lit(False).alias("bundled")))

    def measured(n: Column) -> Column:
        """n: the quarter after bundling -> its parts against the anchor."""
        return bound(F.struct(n.alias("n"), within(a["profile"], n["profile"]).alias("both"), without(a["profile"], n["profile"]).alias("missing"), without(n["profile"], a["profile"]).alias("extra")), told)

    def told(m: Column) -> Column:
        n, both = m["n"], m["both"]
        common = F.size(both)
        jaccard = common.cast("double") / F.greatest(common + F.size(m["missing"]) + F.size(m["extra"]), F.lit(1)).cast("double")
        of_anchor, of_quarter = share(sum_of(both), a["total"]), share(sum_of(within(n["profile"], both)), c["total"])
        styled = F.coalesce(style(a) == style(c), F.lit(False)) & (common >= 2) & (of_anchor >= 0.45)
        schema = (common >= 2) & ((jaccard >= 0.58) | ((of_anchor >= 0.55) & (of_quarter >= 0.55) & (share(sum_of(m["missing"]), a["total"]) <= 0.26) & (share(sum_of(m["extra"]), c["total"]) <= 0.26)))
        optional = F.filter(m["extra"], lambda r: r["opt"] | (share(r["v"], c["total"]) <= 0.08))
        rows = ordered(F.filter(without(n["rows"], optional), lambda r: r["v"] > LEAST))
        reason = F.when(n["bundled"], "schema-bundled").otherwise("schema-compatible")
        return F.when(styled | schema, result(True, reason, rows)).otherwise(result(False, "schema-mismatch", none))

    parts = F.struct(without(a["profile"], c["profile"]).alias("missing"), without(c["profile"], a["profile"]).alias("extra"))
    whole = bound(bound(parts, bundle), measured)
    return F.when(F.coalesce(style(a) != style(c), F.lit(False)), result(False, "style-mismatch", none)).when((F.size(a["profile"]) < 2) | (F.size(c["profile"]) < 1), result(False, "insufficient-profile", none)).otherwise(whole)


def align_pairs(quarters: DataFrame, span: int = 4) -> DataFrame:
    """(company_id, q_index, q2, comparable, reason, rows) of quarters q2 at most `span` before or after the anchor q_index.

    quarters: as of profiles(). Each quarter is laid out for its neighbours: an equality join, 2 * span rows a quarter."""
    state = F.struct("total", "style", "rows", "profile")
    a = quarters.select(*QUARTER, state.alias("_a"))
    near = F.array(*(F.lit(i) for i in range(-span, span + 1) if i))
    c = quarters.select("company_id", F.col("q_index").alias("q2"), state.alias("_c"), F.explode(F.transform(near, lambda i: F.col("q_index") + i)).alias("q_index"))
    return a.join(c, list(QUARTER)).select(*QUARTER, "q2", aligned(F.col("_a"), F.col("_c")).alias("_v")).select(*QUARTER, "q2", "_v.*")


def opens_phase(anchor: Column, quarter: Column) -> Column:
    """Whether a quarter begins a new phase against the anchor of the current one."""

    def told(v: Column) -> Column:
        a, c = F.size(anchor["profile"]), F.size(quarter["profile"])
        common = F.size(F.array_intersect(keys_of(anchor["profile"]), keys_of(quarter["profile"])))
        jaccard = common.cast("double") / F.greatest(a + c - common, F.lit(1)).cast("double")
        bundled = (v["f"]["reason"] == "schema-bundled") | (v["r"]["reason"] == "schema-bundled")
        return (bundled & (a >= 3) & (c >= 3)) | (~v["f"]["comparable"] & ~v["r"]["comparable"]) | ((a >= 3) & (c >= 3) & (jaccard < 0.75))

    pair = F.struct(aligned(anchor, quarter).alias("f"), aligned(quarter, anchor).alias("r"))
    same = (F.size(anchor["profile"]) < 2) | (F.size(quarter["profile"]) < 2) | (keys_of(anchor["profile"]) == keys_of(quarter["profile"]))
    return ~same & bound(pair, told)


def reconciled(rows: Column, total: Column, least: float) -> Column:
    """Rows against a total, as history.reconcile_to_total: none below the least coverage, over 1.12 scaled down, under 0.94
    with the rest as a residual row."""

    def told(s: Column) -> Column:
        cover, rest = s.cast("double") / total.cast("double"), total - s
        scaled = F.transform(rows, lambda r: F.struct(r["key"].alias("key"), F.round((r["v"].cast("decimal(18,0)") * total.cast("decimal(18,0)") / s.cast("decimal(18,0)")).cast("decimal(38,6)"), 0).cast("long").alias("v"), r["opt"].alias("opt")))
        own = F.exists(rows, lambda r: r["key"] == "otherrevenue")
        grown = F.transform(rows, lambda r: F.struct(r["key"].alias("key"), (r["v"] + F.when(r["key"] == "otherrevenue", rest).otherwise(0)).alias("v"), r["opt"].alias("opt")))
        added = F.concat(rows, F.array(F.struct(F.lit("otherrevenue").alias("key"), rest.alias("v"), F.lit(True).alias("opt"))))
        full = F.when(cover > 1.12, scaled).when((cover < 0.94) & (rest > 30), F.when(own, grown).otherwise(added)).otherwise(rows)
        return F.when(cover < least, F.array().cast(ROWS)).otherwise(ordered(full))

    return F.when((total > LEAST) & (F.size(rows) > 0), bound(sum_of(rows), told)).otherwise(rows)


def phases(quarters: DataFrame) -> DataFrame:
    """quarters with `phase` (null outside phases), `anchor` (q_index of the phase's anchor) and `member` (whether the
    quarter is of the phase itself, not a single hole in it).

    quarters: as of profiles(), with reliable, source_score and coverage. One ordered fold over a company's reliable quarters: the state is the
    open phase and its anchor, which moves to a quarter that scores as well or better. A company's quarters are few (a
    window of its history), so they stand in one array."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    score = F.size("profile") * 20 + number("source_score") + number("coverage") * 12 + number("total") / 1000 * 0.01
    item = F.struct("q_index", "total", "style", "rows", "profile", score.alias("score"))
    # A company's quarters are read once: the fold goes over the reliable ones of the array that all of them come out of again.
    every = quarters.withColumn("_item", F.when(F.col("reliable") & (F.size("profile") >= 2), item))
    series = every.groupBy("company_id").agg(F.collect_list(F.struct("q_index", *(c for c in every.columns if c not in QUARTER))).alias("_all"))
    kind = f"array<{dict(every.dtypes)['_item']}>"
    place = "array<struct<q_index:int,phase:int>>"

    def step(st: Column, q: Column) -> Column:
        def placed(new: Column) -> Column:
            phase = F.when(new, st["phase"] + 1).otherwise(st["phase"])
            moves = new | (q["score"] >= st["anchor"][0]["score"])
            anchors = F.when(new & (st["phase"] >= 0), F.concat(st["anchors"], F.array(F.struct(st["anchor"][0]["q_index"].cast("int").alias("q_index"), st["phase"].alias("phase"))))).otherwise(st["anchors"])
            here = F.array(F.struct(q["q_index"].cast("int").alias("q_index"), phase.alias("phase")))
            return F.struct(phase.alias("phase"), F.when(moves, F.array(q)).otherwise(st["anchor"]).alias("anchor"), anchors.alias("anchors"), F.concat(st["out"], here).alias("out"))

        first = F.size(st["anchor"]) == 0
        return bound(F.when(first, F.lit(True)).otherwise(opens_phase(st["anchor"][0], q)), placed)

    begin = F.struct(F.lit(-1).alias("phase"), F.array().cast(kind).alias("anchor"), F.array().cast(place).alias("anchors"), F.array().cast(place).alias("out"))
    last = lambda st: F.struct(st["out"].alias("out"), F.concat(st["anchors"], F.array(F.struct(st["anchor"][0]["q_index"].cast("int").alias("q_index"), st["phase"].alias("phase")))).alias("anchors"))
    kept = F.array_sort(F.filter(F.transform("_all", lambda q: q["_item"]), lambda q: q.isNotNull()))

    def placed_in(d: Column, q: Column) -> Column:
        phase = F.get(F.filter(d["out"], lambda o: o["q_index"] == q["q_index"]), F.lit(0))["phase"]
        anchor = lambda p: F.get(F.filter(d["anchors"], lambda x: x["phase"] == p), F.lit(0))["q_index"]
        return bound(phase, lambda p: F.struct(q.alias("q"), p.alias("_phase"), anchor(p).alias("_anchor")))

    folded = bound(kept, lambda k: F.when(F.size(k) > 0, F.aggregate(k, begin, step, last)))
    done = series.select("company_id", F.explode(bound(folded, lambda d: F.transform("_all", lambda q: placed_in(d, q)))).alias("o"))
    w = Window.partitionBy("company_id").orderBy("q_index")
    out = done.select("company_id", *(F.col(f"o.q.{c}").alias(c) for c in quarters.columns if c != "company_id"), "o._phase", "o._anchor").select(*quarters.columns, "_phase", "_anchor")
    out = out.withColumns({"_p": F.lag("_phase").over(w), "_n": F.lead("_phase").over(w), "_pa": F.lag("_anchor").over(w)})
    hole = F.col("_phase").isNull() & (F.col("_p") == F.col("_n"))
    return out.withColumns({"phase": F.coalesce("_phase", F.when(hole, F.col("_p"))), "anchor": F.coalesce("_anchor", F.when(hole, F.col("_pa"))), "member": F.col("_phase").isNotNull()}).drop("_phase", "_anchor", "_p", "_n", "_pa")


def align_to_phase(quarters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, rows): comparable and reason of each phase member against its anchor; rows (member_key, value) of all
    quarters, comparable ones aligned and reconciled with their total (a style asks for 36 % coverage, none for 62 %).

    quarters: as of phases(). Quarters outside phases, and those not comparable, keep their rows as they are."""
    state = F.struct("total", "style", "rows", "profile")
    own_state = F.when(F.col("member") & (F.col("q_index") == F.col("anchor")), state)
    at = quarters.withColumn("_a", F.first(own_state, ignorenulls=True).over(Window.partitionBy("company_id", "anchor"))).withColumn("_own", F.col("q_index") == F.col("anchor"))
    own = F.struct(F.lit(True).alias("comparable"), F.lit("anchor-quarter").alias("reason"), F.col("rows").alias("rows"))
    asked = F.col("member") & (F.size("rows") > 0)
    at = once(at, _v=F.when(asked, F.when(F.col("_own"), own).otherwise(aligned(F.col("_a"), state))))
    verdicts = at.where(asked).select(*QUARTER, "phase", "anchor", F.col("_v.comparable").alias("comparable"), F.col("_v.reason").alias("reason"))
    taken = F.coalesce(F.col("_v.comparable"), F.lit(False))
    rows = at.select(*QUARTER, "style", "total", taken.alias("_taken"), F.explode(F.when(taken, F.col("_v.rows")).otherwise(F.col("rows"))).alias("r"))
    value = (F.col("r.v").cast("decimal(24,3)") / 1000).cast("decimal(24,3)")
    total = F.when(F.col("_taken"), (F.col("total").cast("decimal(20,3)") / 1000).cast("decimal(20,3)"))
    least = F.when(F.trim(F.coalesce("style", F.lit(""))) != "", d(0.36)).otherwise(d(0.62))
    # Rows that are not taken have no total here, so they stay.
    kept = reconcile_to_total(rows.select(*QUARTER, F.col("r.key").alias("member_key"), value.alias("value"), total.alias("total"), least.alias("_least")), None, F.col("_least"))
    return verdicts, kept
