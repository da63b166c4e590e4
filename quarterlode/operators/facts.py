"""Disclosed facts to one clean quarterly series of each field. All work is by (company, field or concept)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlode.functions.periods import calendar_quarter, day_span, fiscal_quarter, q_index
from quarterlode.operators.concepts import BREAKDOWN_RULES, CONCEPTS, CURRENCY_FIELDS, FORMS, NAMESPACES

SERIES = ("company_id", "namespace", "concept")
PCT = "decimal(38,12)"


def valid_facts(facts: DataFrame, forms: Sequence[str] = FORMS, filed_from: str | None = None, namespaces: Mapping[str, int] = NAMESPACES) -> DataFrame:
    """Facts of allowed forms and known namespaces with period and value; adds namespace_priority."""
    rank = F.create_map(*(F.lit(x) for kv in namespaces.items() for x in kv))
    ok = F.col("form").isin(*forms) & F.col("start_date").isNotNull() & F.col("end_date").isNotNull() & F.col("value").isNotNull()
    df = facts.where(ok & F.col("namespace").isin(*namespaces))
    return (df.where(F.col("filed") >= F.lit(filed_from).cast("date")) if filed_from else df).withColumn("namespace_priority", rank[F.col("namespace")])


def concept_table(like: DataFrame, concepts: Mapping[str, Sequence[str]] = CONCEPTS) -> DataFrame:
    """(concept, field, concept_priority, weight): a table of fixed size."""
    rows = [(c, f, len(names) - i, len(names) + 2 - i) for f, names in concepts.items() for i, c in enumerate(names)]
    return like.sparkSession.createDataFrame(rows, "concept string, field string, concept_priority int, weight int")


def reporting_currency(facts: DataFrame, forms: Sequence[str] = FORMS, fields: Sequence[str] = CURRENCY_FIELDS) -> DataFrame:
    """Currency of each company by votes of its facts, weighted by concept; ties go to non-USD, then the later code."""
    weights = F.broadcast(concept_table(facts).where(F.col("field").isin(*fields)).select("concept", "weight"))
    votes = facts.where(F.col("form").isin(*forms) & F.col("start_date").isNotNull() & F.col("end_date").isNotNull() & F.col("unit").rlike("^[A-Z]{3}$")).join(weights, "concept")
    totals = votes.groupBy("company_id", "unit").agg(F.sum("weight").alias("score"))
    return totals.groupBy("company_id").agg(F.max_by("unit", F.struct("score", (F.col("unit") != "USD").alias("foreign"), "unit")).alias("currency"), F.max("score").alias("score"))


def map_concepts(facts: DataFrame) -> DataFrame:
    """Adds field and concept_priority; facts of other concepts go. The concept table is broadcast (fixed size)."""
    return facts.join(F.broadcast(concept_table(facts).drop("weight")), "concept")


def _gap() -> Column:
    return F.datediff("filed", "end_date")


def fact_rank() -> Column:
    """Timely filing, small gap, namespace, concept, then the later filing."""
    return F.struct(_gap().between(0, 210).alias("timely"), (-F.greatest(_gap(), F.lit(0))).alias("near"), F.col("namespace_priority"), F.col("concept_priority"), F.col("filed"), F.col("accession"))


def field_rank() -> Column:
    """As fact_rank, but the concept goes before the gap."""
    return F.struct(_gap().between(0, 210).alias("timely"), F.col("concept_priority"), F.col("namespace_priority"), (-F.greatest(_gap(), F.lit(0))).alias("near"), F.col("filed"), F.col("accession"))


def best(df: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    """The row of greatest rank for each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_best")).select(*keys, "_best.*").select(*df.columns)


def dedupe_facts(facts: DataFrame) -> DataFrame:
    return best(facts, ["company_id", "namespace", "concept", "start_date", "end_date"], fact_rank())


def split_spans(facts: DataFrame, keys: Sequence[str] = SERIES, rank: Column | None = None) -> DataFrame:
    """The best fact of each end date among quarters (45-120 days) and among year-to-date spans (121-390); others go."""
    span = day_span(F.col("start_date"), F.col("end_date"))
    kind = F.when(span.between(45, 120), "direct").when(span.between(121, 390), "cumulative")
    return best(facts.withColumn("span_kind", kind).where("span_kind is not null"), [*keys, "span_kind", "end_date"], fact_rank() if rank is None else rank)


def derive_quarters(split: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Quarters, disclosed or derived: a year-to-date fact less the quarters in it, if these are all there.

    A fact needs only what ends before it, so one pass in order of end dates over each series does; a series has a few
    facts a year. Result: keys, start_date, end_date, value, derived."""
    item = F.struct("end_date", "start_date", "value", "span_kind")
    series = split.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    entry = "array<struct<start_date:date,end_date:date,value:decimal(20,2),derived:boolean>>"
    direct = F.transform(F.filter("_items", lambda x: x["span_kind"] == "direct"), lambda x: F.struct(x["start_date"].alias("start_date"), x["end_date"].alias("end_date"), x["value"].alias("value"), F.lit(False).alias("derived")))
    cumulative = F.filter("_items", lambda x: x["span_kind"] == "cumulative")

    def step(have: Column, x: Column) -> Column:
        inside = F.filter(have, lambda e: (e["start_date"] >= x["start_date"]) & (e["end_date"] < x["end_date"]))
        expected = F.greatest(F.rint(day_span(x["start_date"], x["end_date"]) / F.lit(91)) - 1, F.lit(1.0))
        known = F.exists(have, lambda e: e["end_date"] == x["end_date"])
        used = F.aggregate(inside, F.lit(0).cast("decimal(20,2)"), lambda a, e: (a + e["value"]).cast("decimal(20,2)"))
        start = F.date_add(F.array_max(F.transform(inside, lambda e: e["end_date"])), 1)
        made = F.struct(start.alias("start_date"), x["end_date"].alias("end_date"), (x["value"] - used).cast("decimal(20,2)").alias("value"), F.lit(True).alias("derived"))
        return F.when(~known & (F.size(inside) == expected), F.concat(have, F.array(made))).otherwise(have).cast(entry)

    return series.select(*keys, F.explode(F.aggregate(cumulative, direct.cast(entry), step)).alias("e")).select(*keys, "e.*")


def one_per_quarter(df: DataFrame, rank: Column, keys: Sequence[str] = SERIES, floor: int | None = None) -> DataFrame:
    """One row of each calendar quarter, from the quarter index `floor` on if given."""
    at = df.withColumn("quarter", calendar_quarter(F.col("end_date"))).withColumn("q_index", q_index(F.col("quarter")))
    return best(at if floor is None else at.where(F.col("q_index") >= floor), [*keys, "quarter"], rank)


def field_series(facts: DataFrame) -> DataFrame:
    """Mapped facts -> quarterly values of each field: the best concept series of a quarter, else the series of all
    concepts of the field together (which can derive a quarter from spans of different concepts).

    Both kinds of series go through one pass: each fact is laid out for its concept and for its field."""
    series = F.array(F.struct(F.col("namespace"), F.col("concept"), "namespace_priority", "concept_priority", F.lit(1).alias("own")), F.struct(*(F.lit(None).cast(k).alias(c) for c, k in (("namespace", "string"), ("concept", "string"), ("namespace_priority", "int"), ("concept_priority", "int"))), F.lit(0).alias("own")))
    keys = ("company_id", "field", "series")
    rank = F.when(F.col("series.own") == 1, _same_names(fact_rank(), 0)).otherwise(_same_names(field_rank(), 1))
    rows = dedupe_facts(facts).withColumn("series", F.explode(series))
    at = derive_quarters(split_spans(rows, keys, rank), keys).withColumn("quarter", calendar_quarter(F.col("end_date")))
    own = F.col("series.own") == 1
    order = F.struct("series.own", (own & ~F.col("derived")).alias("d"), "series.concept_priority", "series.namespace_priority", "end_date", "series.concept")
    picked = at.groupBy("company_id", "field", "quarter").agg(F.max_by(F.struct("value", "derived"), order).alias("b"))
    return picked.select("company_id", "field", "quarter", "b.*")


def _same_names(rank: Column, kind: int) -> Column:
    """The ranks have fields of the same types in unlike order; as one type they can stand in one expression."""
    names = ("timely", "near", "namespace_priority", "concept_priority", "filed", "accession") if kind == 0 else ("timely", "concept_priority", "namespace_priority", "near", "filed", "accession")
    return F.struct(*(rank[n].alias(f"r{i}") for i, n in enumerate(names)))


def composite_field(series: DataFrame, target: str, parts: Sequence[str]) -> DataFrame:
    """Rows of `target` made as the sum of parts in quarters that have none (all parts that are there)."""
    have = series.where(F.col("field") == target).select("company_id", "quarter")
    made = series.where(F.col("field").isin(*parts)).join(have, ["company_id", "quarter"], "left_anti").groupBy("company_id", "quarter").agg(F.sum("value").cast("decimal(20,2)").alias("value"), F.array_join(F.array_sort(F.collect_set("field")), "+").alias("parts"))
    return made.withColumn("field", F.lit(target))


def match_breakdown_rule(concepts: DataFrame, rules=BREAKDOWN_RULES) -> DataFrame:
    """The category of each distinct concept: an exact name in rule order, else the first pattern that is found."""
    rank = lambda hit, base: F.array_compact(F.array(*(F.when(hit(r), F.lit(base + r[0])) for r in rules)))
    c = F.col("concept")
    exact = rank(lambda r: c.isin(*r[3]) if r[3] else F.lit(False), 0)
    found = rank(lambda r: F.lower(c).rlike("|".join(r[4])), 100)
    first = F.array_min(F.concat(exact, found))
    names = F.create_map(*(x for r in rules for b in (0, 100) for x in (F.lit(b + r[0]), F.struct(F.lit(r[1]).alias("category"), F.lit(r[2]).alias("kind")))))
    out = concepts.select("concept").distinct().withColumn("_rule", first).where("_rule is not null")
    return out.select("concept", names[F.col("_rule")]["category"].alias("category"), names[F.col("_rule")]["kind"].alias("kind"), (F.col("_rule") < 100).alias("exact"))


def quarter_metadata(df: DataFrame) -> DataFrame:
    """Period end, fiscal year and quarter of the best ranked fact of each calendar quarter."""
    at = df.withColumn("quarter", calendar_quarter(F.col("end_date"))).withColumn("fiscal_quarter", fiscal_quarter(F.col("fiscal_period"), day_span(F.col("start_date"), F.col("end_date"))))
    return at.groupBy("company_id", "quarter").agg(F.max_by(F.struct("end_date", "fiscal_year", "fiscal_quarter", "concept"), F.struct(fact_rank(), F.col("concept"), F.col("start_date"))).alias("m")).select("company_id", "quarter", "m.*")


def complete_statement(df: DataFrame) -> DataFrame:
    """Fills missing statement lines by the identities between them, in the order in which one gives the next."""
    for c in ("other_opex", "non_operating"):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("decimal(20,2)"))
    less = lambda a, b: (F.col(a) - F.col(b)).cast("decimal(20,2)")
    for name, value in (("gross_profit", less("revenue", "cost_of_revenue")), ("cost_of_revenue", less("revenue", "gross_profit")), ("operating_income", less("gross_profit", "operating_expenses")), ("operating_expenses", less("gross_profit", "operating_income")), ("tax", less("pretax_income", "net_income")), ("non_operating", less("pretax_income", "operating_income"))):
        df = df.withColumn(name, F.coalesce(F.col(name), value))
    residual = (F.col("operating_expenses") - F.coalesce("sgna", F.lit(0)) - F.coalesce("rnd", F.lit(0))).cast("decimal(20,2)")
    return df.withColumn("other_opex", F.coalesce("other_opex", F.when(residual > 0.01, residual)))


def percent(a: Column, b: Column, places: int = 2) -> Column:
    """a / b in percent; null if either is missing or b is zero. Decimal throughout, rounded last."""
    return F.round((a.cast("decimal(20,4)") * 100 / F.when(b != 0, b.cast("decimal(20,4)"))).cast(PCT), places).cast("double")


def margins(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({"gross_margin_pct": percent(c("gross_profit"), c("revenue")), "operating_margin_pct": percent(c("operating_income"), c("revenue")), "profit_margin_pct": percent(c("net_income"), c("revenue")), "effective_tax_rate_pct": percent(c("tax"), c("pretax_income"))})


def change(now: Column, then: Column, places: int = 2) -> Column:
    """Growth in percent; null if either is missing or zero."""
    return F.when(now != 0, percent(now - then, then, places))


def growth_positional(df: DataFrame) -> DataFrame:
    """Growth against the row before and the fourth row before, whatever quarters are missing between."""
    w = Window.partitionBy("company_id").orderBy("q_index")
    before = lambda name, n: F.lag(name, n).over(w)
    delta = lambda m: F.round(F.col(m).cast(PCT) - before(m, 4).cast(PCT), 2).cast("double")
    return df.withColumns({"revenue_qoq_pct": change(F.col("revenue"), before("revenue", 1)), "revenue_yoy_pct": change(F.col("revenue"), before("revenue", 4)), "net_income_yoy_pct": change(F.col("net_income"), before("net_income", 4)), "gross_margin_yoy_delta_pp": delta("gross_margin_pct")})


def growth_calendar(df: DataFrame) -> DataFrame:
    """Growth against exactly the previous quarter and the quarter a year before; 3 places, null unless revenues are positive."""
    w = Window.partitionBy("company_id").orderBy("q_index")
    at = lambda n: F.first("revenue").over(w.rangeBetween(-n, -n))
    grow = lambda then: F.when((F.col("revenue") > 0) & (then > 0), percent(F.col("revenue") - then, then, 3))
    return df.withColumns({"revenue_qoq_pct": grow(at(1)), "revenue_yoy_pct": grow(at(4))})


def statements(facts: DataFrame) -> DataFrame:
    """Facts -> one statement row of each company and quarter, with margins and growth."""
    series = field_series(map_concepts(valid_facts(facts)))
    fields = ["revenue", "cost_of_revenue", "gross_profit", "sgna", "rnd", "operating_expenses", "operating_income", "pretax_income", "tax", "net_income"]
    wide = series.groupBy("company_id", "quarter").pivot("field", fields).agg(F.max("value")).withColumn("q_index", q_index(F.col("quarter")))
    return growth_calendar(margins(complete_statement(wide)))


def breakdown_with_residual(df: DataFrame, parts: Mapping[str, str], total: str, residual: str, least: float = 25_000_000, share: float = 0.01, same: float = 80_000_000) -> DataFrame:
    """Positive parts of a line (column -> category) as rows, with a residual row where the total leaves more than `least`
    and 1 %; a lone item that is the total (within `same` or 1 %) goes."""
    keys = ["company_id", "q_index"]
    long = df.select(*keys, F.col(total).alias("total"), F.explode(F.array(*(F.struct(F.lit(name).alias("category"), F.col(c).alias("value")) for c, name in parts.items()))).alias("p")).select(*keys, "total", "p.*").where("value > 0")
    sums = long.groupBy(*keys).agg(F.sum("value").alias("disclosed"), F.first("total").alias("total"))
    bound = lambda x: F.greatest(F.lit(x).cast("decimal(20,2)"), F.col("total") * F.lit(share).cast("decimal(4,2)"))
    rest = sums.where((F.col("total") > 0) & (F.col("total") - F.col("disclosed") > bound(least))).select(*keys, "total", F.lit(residual).alias("category"), (F.col("total") - F.col("disclosed")).cast("decimal(20,2)").alias("value"))
    rows = long.unionByName(rest).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    lone = (F.col("_n") == 1) & (F.abs(F.col("value") - F.col("total")) <= bound(same))
    return rows.where(~F.coalesce(lone, F.lit(False))).select(*keys, "category", F.col("value").cast("decimal(20,2)").alias("value"))
