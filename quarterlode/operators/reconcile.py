"""Competing sources, field by field, with scores and provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTER = ("company_id", "q_index")

# Fixed values. Sources in order: id, kind, priority.
SOURCES = (
    (1, "manual_financials", "statement", 146),
    (2, "manual_revenue_structures", "revenue_structure", 146),
    (3, "official_financials", "statement", 110),
    (4, "generic_filing_tables", "statement", 80),
    (5, "generic_ir_pdf", "statement", 72),
    (6, "stockanalysis_financials", "statement", 64),
    (7, "supplemental_components", "statement", 84),
    (8, "official_segments", "revenue_segments", 96),
    (9, "official_revenue_structures", "revenue_structure", 106),
)


def sources(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(list(SOURCES), "ord int, source_id string, source_kind string, priority int")


def stack_sources(entries: DataFrame, fields: Sequence[str], enabled: DataFrame) -> DataFrame:
    """Wide entries of all sources -> (quarter, source, field, value) with priority and order; disabled sources go."""
    rest = [c for c in entries.columns if c not in fields]
    long = entries.unpivot(rest, list(fields), "field", "value").where("value is not null")
    return long.join(F.broadcast(enabled), "source_id")


def statement_score() -> Column:
    """Priority, then a little for a url, a filing date and quality flags."""
    return F.col("priority") + F.when(F.col("source_url").isNotNull(), 2.0).otherwise(0.0) + F.when(F.col("filing_date").isNotNull(), 1.0).otherwise(0.0) + F.when(F.size("quality_flags") > 0, 0.5).otherwise(0.0)


def best_field(stacked: DataFrame) -> DataFrame:
    """The value of the best source of each field, and who it was; the source first in order wins ties."""
    scored = stacked.withColumn("score", statement_score())
    top = scored.groupBy(*QUARTER, "field").agg(F.max_by(F.struct("value", "source_id", "score"), F.struct("score", (-F.col("ord")).alias("o"))).alias("b"))
    return top.select(*QUARTER, "field", "b.*")


def _scored(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Items with the score of their source's breakdown of the quarter; one sort of each quarter."""
    w = Window.partitionBy(*QUARTER, "source_id")
    at = items.withColumns({"items": F.count(F.lit(1)).over(w), "disclosed": F.sum("value").over(w), "_first": F.row_number().over(w.orderBy("category"))}).join(totals, [*QUARTER], "left")
    share = F.when(F.col("total") > 0, F.least(F.col("disclosed").cast("double") / F.col("total").cast("double"), F.lit(1.0)) * 12.0).otherwise(0.0)
    return at.withColumn("score", F.col("priority") + F.least("items", F.lit(6)) * 2.0 + share)


def collection_score(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Score of each source's breakdown: priority, up to six items, share of the total explained."""
    return _scored(items, totals).where("_first = 1").select(*QUARTER, "source_id", "items", "disclosed", "total", "score")


def merge_breakdowns(items: DataFrame, totals: DataFrame, residual_name: str = "other_opex") -> DataFrame:
    """The best source's item of each category; if these exceed the total by 2 % the best single source, else what the
    total leaves (over 1.5 % and 0.05, two items at least) as a residual item.

    Windows over a quarter's items, one after another: nothing is read or joined twice."""
    quarter = Window.partitionBy(*QUARTER)
    at = _scored(items, totals).withColumn("item_score", F.col("score") + F.least(F.col("value").cast("double"), F.lit(999.0)) / 1000)
    best = F.struct("item_score", "source_id") == F.max(F.struct("item_score", "source_id")).over(Window.partitionBy(*QUARTER, "category"))
    at = at.withColumns({"_best": best, "_single": F.max(F.struct("score", "source_id")).over(quarter)["source_id"] == F.col("source_id")})
    at = at.withColumns({"_sum": F.sum(F.when(F.col("_best"), F.col("value"))).over(quarter), "_n": F.count_if("_best").over(quarter), "_place": F.row_number().over(quarter.orderBy("source_id", "category"))})
    over = F.coalesce((F.col("total") > 0) & (F.col("_sum") > F.col("total") * F.lit(1.02).cast("decimal(4,2)")), F.lit(False))
    rest = (F.col("total") - F.col("_sum")).cast("decimal(20,2)")
    much = (F.col("total") > 0) & (F.col("_n") >= 2) & (rest > F.greatest(F.col("total") * F.lit(0.015).cast("decimal(4,3)"), F.lit(0.05).cast("decimal(3,2)")))
    own = F.when(F.when(over, F.col("_single")).otherwise(F.col("_best")), F.struct("category", F.col("value").cast("decimal(20,2)").alias("value"), "source_id"))
    left = F.when(~over & much & (F.col("_place") == 1), F.struct(F.lit(residual_name).alias("category"), rest.alias("value"), F.lit("residual").alias("source_id")))
    return at.select(*QUARTER, F.explode(F.array_compact(F.array(own, left))).alias("r")).select(*QUARTER, "r.*")


def completeness(fields: Sequence[str], items: Column | None = None) -> Column:
    """Fields that are there, up to six breakdown items a fifth each, a little for a url and for flags."""
    listed = F.lit(0.0) if items is None else F.least(items, F.lit(6)) * 0.2
    return sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0)) + listed + F.when(F.col("source_url").isNotNull(), 0.5).otherwise(0.0) + F.when(F.size("quality_flags") > 0, 0.25).otherwise(0.0)


def representative(entries: DataFrame, fields: Sequence[str], enabled: DataFrame) -> DataFrame:
    """The source whose entry stands for a quarter: completeness, then priority; first in order on ties."""
    items = F.coalesce("breakdown_items", F.lit(0)) if "breakdown_items" in entries.columns else None
    at = entries.join(F.broadcast(enabled), "source_id").withColumn("score", completeness(fields, items) + F.col("priority") / 100.0)
    return at.groupBy(*QUARTER).agg(F.max_by("source_id", F.struct("score", (-F.col("ord")).alias("o"))).alias("source_id"), F.max("score").alias("score"))


def best_segments(rows: DataFrame, enabled: DataFrame) -> DataFrame:
    """Segment sources win if they have at least as many rows as those before them; structure sources overwrite, the last one wins."""
    counts = rows.groupBy(*QUARTER, "source_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(enabled), "source_id")
    structure = (F.col("source_kind") == "revenue_structure").cast("int")
    pick = counts.groupBy(*QUARTER).agg(F.max_by("source_id", F.struct(structure.alias("s"), F.when(structure == 0, F.col("n")).otherwise(0).alias("n"), "ord")).alias("source_id"))
    return rows.join(pick, [*QUARTER, "source_id"], "left_semi")


REQUIRED = ("revenue", "operating_income", "net_income")


def coverage(total: Column, listed: Column) -> Column:
    """Share of a positive total that a breakdown explains, 1 at most, 4 places; null without such a total."""
    share = F.coalesce(listed, F.lit(0)).cast("decimal(24,4)") / F.when(total > 0, total.cast("decimal(24,4)"))
    return F.when(total > 0, F.round(F.least(share, F.lit(1)).cast("decimal(38,10)"), 4).cast("decimal(10,4)"))


def diagnostics(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Score of 0 to 100, issues, coverages, residuals and modes of each quarter.

    Besides statement fields: segments, cost_items, opex_items (sums of the breakdowns, null if there is none),
    has_profile, value_mode, flags, source_fields (how many fields have a source)."""
    c, d = F.col, lambda x: F.lit(x).cast("decimal(10,4)")
    missing = F.array_compact(F.array(*(F.when(c(f).isNull(), F.lit(f)) for f in required)))
    seg, cost, opex = coverage(c("revenue"), c("segments")), coverage(c("cost_of_revenue"), c("cost_items")), coverage(c("operating_expenses"), c("opex_items"))
    plain = ~c("has_profile")
    issues = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing-required:"), F.array_join(missing, ","))),
        F.when(seg < d(0.85), "revenue-segment-coverage-low"),
        F.when(plain & (cost < d(0.6)), "cost-breakdown-coverage-low"),
        F.when(opex < d(0.6), "opex-breakdown-coverage-low"),
        F.when(c("value_mode") == "derived", "statement-derived-quarter"),
        F.when(F.array_contains("flags", "summary-quarter-report"), "statement-summary-quarter-report"),
    ))
    lost = lambda share, at, weight: F.coalesce(F.floor(F.greatest(d(at) - share, d(0)) * weight), F.lit(0))
    score = 100 - F.size(missing) * 14 - lost(seg, 0.85, 24) - F.when(plain, lost(cost, 0.75, 18)).otherwise(0) - lost(opex, 0.75, 18) + F.least("source_fields", F.lit(6))
    rest = lambda total, listed: F.when((c(total) > 0) & c(listed).isNotNull(), F.greatest(c(total) - c(listed), F.lit(0)).cast("decimal(20,2)"))
    pct = lambda share: F.round(share * 100, 1).cast("double")
    mode = F.when(c("cost_items").isNotNull(), "explicit").when(c("has_profile"), "profile-assisted").otherwise("none")
    return df.select(*QUARTER, F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long").alias("score"), (len(required) - F.size(missing)).alias("available"), F.array_join(issues, ";").alias("issues"), mode.alias("cost_mode"), F.when(c("opex_items").isNotNull(), "explicit").otherwise("none").alias("opex_mode"),
        pct(seg).alias("segment_pct"), F.when(plain, pct(cost)).alias("cost_pct"), pct(opex).alias("opex_pct"), rest("revenue", "segments").alias("segment_residual"), F.when(plain, rest("cost_of_revenue", "cost_items")).alias("cost_residual"), rest("operating_expenses", "opex_items").alias("opex_residual"))


def fill_missing(base: DataFrame, unified: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Unified values only where the base has none; a company's quarters are taken over only if the base has none of it."""
    other = unified.select(*QUARTER, *(F.col(f).alias(f"_{f}") for f in fields))
    filled = base.join(other, [*QUARTER], "left").select(*QUARTER, *(F.coalesce(f, f"_{f}").alias(f) for f in fields))
    fresh = unified.join(base.select("company_id").distinct(), "company_id", "left_anti").select(*QUARTER, *fields)
    return filled.unionByName(fresh)


def apply_overrides(base: DataFrame, overrides: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Override values win; override rows without a base row are added."""
    o = overrides.select(*QUARTER, *(F.col(f).alias(f"_{f}") for f in fields))
    return base.join(o, [*QUARTER], "full_outer").select(*QUARTER, *(F.coalesce(f"_{f}", f).alias(f) for f in fields))


# Fixed values. Endings and words that company keys go without.
SUFFIXES = ("-inc", "-corp", "-corporation", "-co", "inc", "corporation", "company", "-")
ENDINGS = ("inc", "corp", "corporation", "company")


def name_variants(*keys: Column) -> Column:
    """Keys under which a company may be asked for: each key, its letters and digits alone, and both without the usual
    words and endings."""
    values = F.array_distinct(F.transform(F.array(*(F.lower(F.trim(F.coalesce(k, F.lit("")))) for k in keys)), lambda v: v))
    bare = lambda v: F.regexp_replace(v, "[^a-z0-9]+", "")
    compact = F.transform(values, bare)
    dropped = [F.transform(values, _without(x)) for x in SUFFIXES]
    ended = [F.transform(F.filter(compact, _ends(x)), _shorter(len(x))) for x in ENDINGS]
    return F.filter(F.array_distinct(F.concat(values, compact, *dropped, *ended)), lambda k: k != "")


def _without(word: str):
    return lambda v: F.replace(v, F.lit(word), F.lit(""))


def _ends(word: str):
    return lambda v: F.endswith(v, F.lit(word))


def _shorter(n: int):
    return lambda v: F.substring(v, F.lit(1), F.length(v) - n)


def resolve_company(asked: DataFrame, companies: DataFrame, keys: Sequence[str] = ("id", "ticker", "slug")) -> DataFrame:
    """asked(name) -> the company one of whose variants (of its keys) is the name; of several the least id.

    An equality join on exploded variants: a company has a few dozen. Spark takes exploded rows for as small as what they are made
    of and would broadcast them all, so the join is told to merge sorted sides. Names asked again fall together in the one aggregate
    behind the join, so no task holds the distinct names of its whole input."""
    c = companies.select("company_id", F.explode(name_variants(*(F.col(k) for k in keys))).alias("key"))
    a = asked.select("name", F.lower(F.trim("name")).alias("key"))
    return a.join(c.hint("merge"), "key").groupBy("name").agg(F.min("company_id").alias("company_id"))


def overlay(base: DataFrame, official: DataFrame, fields: Sequence[str], protected: Sequence[str]) -> DataFrame:
    """Official values over third-party ones; protected columns keep the old value where there is one."""
    o = official.select(*QUARTER, *(F.col(f).alias(f"_{f}") for f in fields))
    pick = [(F.coalesce(f, f"_{f}") if f in protected else F.coalesce(f"_{f}", f)).alias(f) for f in fields]
    return base.join(o, [*QUARTER], "full_outer").select(*QUARTER, *pick)


def dense_first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Rows of the first source that has any for a key."""
    return df.withColumn("_r", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


# Fixed values. Lines that must agree: least difference and share that still count as equal.
ALIGNED = (("revenue", "0.12", "0.006"), ("gross_profit", "0.12", "0.008"), ("pretax_income", "0.18", "0.012"), ("tax", "0.18", "0.02"), ("net_income", "0.18", "0.012"))
# Fixed values. Operating lines that may be off: share of the fallback's line, and what is added to that.
OPERATING = (("operating_expenses", "0.24", "0"), ("operating_income", "0.24", "0.4"), ("non_operating", "0.4", "0.4"))
BRIDGE = ("revenue", "cost_of_revenue", "gross_profit", "sgna", "rnd", "other_opex", "operating_expenses", "operating_income", "non_operating", "pretax_income", "tax", "net_income")
STAGE = BRIDGE[3:]
# Fixed values. Rates that go with the lines; those from the operating margin on go with the operating stage.
RATES = ("revenue_yoy_pct", "revenue_qoq_pct", "gross_margin_pct", "gross_margin_yoy_delta_pp", "operating_margin_pct", "operating_margin_yoy_delta_pp", "net_income_yoy_pct", "profit_margin_pct", "profit_margin_yoy_delta_pp", "effective_tax_rate_pct")
STAGE_RATES = RATES[4:]


def mismatch(first: Column, other: Column) -> Column:
    """Whether two statements (structs) agree in all lines of ALIGNED, missing ones aside, while one of the operating lines is off
    by more than 1.2 and its share, and the other one's bridge is sane (expenses are gross less operating income, 0.35 or 3 %)."""
    d = lambda x: F.lit(x).cast("decimal(10,4)")
    same, off = F.lit(True), F.lit(False)
    for name, least, share in ALIGNED:
        a, b = first[name], other[name]
        same = same & F.coalesce(F.abs(a - b) <= F.greatest(d(least), F.greatest(F.abs(a), F.abs(b)) * d(share)), F.lit(True))
    for name, share, more in OPERATING:
        a, b = first[name], other[name]
        off = off | F.coalesce(F.abs(a - b) > F.greatest(d("1.2"), F.abs(b) * d(share) + d(more)), F.lit(False))
    expected = F.greatest(other["gross_profit"] - other["operating_income"], F.lit(0))
    sane = F.coalesce(F.abs(other["operating_expenses"] - expected) <= F.greatest(d("0.35"), other["gross_profit"] * d("0.03")), F.lit(False))
    return same & sane & off


def stage_mismatch(p: DataFrame, f: DataFrame) -> DataFrame:
    """(company_id, q_index, mismatch) of quarters that both statements have."""
    lines = sorted({n for n, *_ in (*ALIGNED, *OPERATING)})
    other = f.select(*QUARTER, F.struct(*lines).alias("_f"))
    return p.select(*QUARTER, F.struct(*lines).alias("_p")).join(other, list(QUARTER)).select(*QUARTER, mismatch(F.col("_p"), F.col("_f")).alias("mismatch"))


def merge_fallback(p: DataFrame, f: DataFrame, slack: float = 0.25) -> DataFrame:
    """Missing lines from the fallback. All bridge lines that it has come from it where cost and gross profit are both
    missing, it has revenue, cost and gross profit, and operating expenses (or the segments' sum, column `segments`)
    exceed revenue by more than `slack` (or 8 %); the lines from SG&A on where mismatch() says so. Rates that both sides have
    (RATES) go with the lines."""
    rates = [c for c in RATES if c in p.columns and c in f.columns]
    d = lambda x: F.lit(str(x)).cast("decimal(10,4)")
    other = f.select(*QUARTER, F.struct(*BRIDGE, *rates).alias("_f"))
    at = p.select(*QUARTER, F.struct(*BRIDGE, *rates, "segments").alias("_p")).join(other, list(QUARTER), "full_outer")
    first, back = F.col("_p"), F.col("_f")
    lacks = first["cost_of_revenue"].isNull() & first["gross_profit"].isNull()
    whole = back["revenue"].isNotNull() & back["cost_of_revenue"].isNotNull() & back["gross_profit"].isNotNull()
    over = F.coalesce(first["operating_expenses"] > first["revenue"] + d(slack), F.lit(False)) | F.coalesce(first["segments"] > first["revenue"] + F.greatest(d(slack), first["revenue"] * d(0.08)), F.lit(False))
    there = first.isNotNull() & back.isNotNull()
    broken, off = there & lacks & whole & over, there & mismatch(first, back)
    line = lambda n: F.when(broken | (off & F.lit(n in (*STAGE, *STAGE_RATES))), F.coalesce(back[n], first[n])).otherwise(F.coalesce(first[n], back[n])).alias(n)
    return at.select(*QUARTER, *(line(n) for n in (*BRIDGE, *rates)), F.when(broken, "financial-fallback").when(off, "operating-stage-fallback").otherwise("").alias("fallback"))
