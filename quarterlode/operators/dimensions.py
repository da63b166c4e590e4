"""Dimensional facts (values of members on axes) to quarterly segments, and configured revenue structures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlode.functions.periods import calendar_quarter, day_span, q_index
from quarterlode.operators.facts import best, derive_quarters
from quarterlode.operators.phases import bound
from quarterlode.operators.segments import is_aggregate, normal_label

# Fixed values. Parts of axis names by kind, and axes and members that say nothing of a business.
BUSINESS_AXES = ("statementbusinesssegmentsaxis", "operatingsegmentsaxis", "businesssegmentsaxis", "lineofbusinessaxis", "reportablesegmentsaxis", "segmentaxis")
PRODUCT_AXES = ("productorserviceaxis", "classesofbusinessesaxis", "classesofbusinessaxis", "majorproductlinesaxis", "applicationaxis", "enduseaxis", "technologyaxis", "platformaxis")
IGNORED_AXES = ("consolidationitemsaxis", "statementscenarioaxis")
GENERIC_MEMBERS = ("operatingsegmentsmember", "businesssegmentsmember", "productmember", "serviceothermember", "servicemember", "consolidatedentitiesmember", "allothersegmentsmember")
WHOLE_MEMBERS = ("businesssegmentsmember", "operatingsegmentsmember", "consolidatedentitiesmember")
PRODUCT_MEMBERS = ("productmember", "productsmember")
SERVICE_MEMBERS = ("servicemember", "servicesmember", "serviceothermember")
SERVICE_WORDS = ("service", "cloud", "subscription", "seller", "advertising", "webservices")
# Fixed values. Places, and words that only places are made of.
PLACES = ("americas", "asia pacific", "canada", "china", "domestic", "emea", "europe", "foreign", "greater china", "international", "japan", "latin america", "north america", "rest of asia pacific", "rest of world", "south america", "united states", "worldwide")
PLACE_WORDS = ("americas", "america", "north", "south", "east", "west", "international", "europe", "asia", "pacific", "greater", "china", "japan", "domestic", "foreign", "world", "worldwide", "global", "region", "regions", "rest", "of", "the", "united", "states", "us", "canada", "latin", "emea", "apac")
# Fixed values. Revenue concepts and their priority; any other name that ends like revenue has 70.
REVENUE_CONCEPTS = {
    "RevenueFromContractWithCustomerExcludingAssessedTax": 120,
    "RevenueFromContractWithCustomerIncludingAssessedTax": 118,
    "RevenuesNetOfInterestExpense": 116,
    "RevenuesNetOfInterestExpenseFullTaxEquivalentBasis": 116,
    "NetRevenues": 114,
    "SalesRevenueNet": 112,
    "SalesRevenueServicesNet": 110,
    "SalesRevenueGoodsNet": 109,
    "Revenues": 108,
    "Revenue": 106,
    "OperatingRevenue": 104,
    "OperatingRevenueNet": 102,
    "TotalRevenue": 100,
    "NetSales": 98,
}
DIMS = "array<struct<dimension:string,member:string>>"


def local_name(name: Column) -> Column:
    """A name without its prefix."""
    return F.substring_index(name, ":", -1)


def parse_dims(text: Column) -> Column:
    """'p:Axis=q:Member;...' as an array of (dimension, member), prefixes taken off."""
    pairs = F.filter(F.split(text, ";"), lambda p: p.contains("="))
    return F.transform(pairs, lambda p: F.struct(local_name(F.split(p, "=")[0]).alias("dimension"), local_name(F.split(p, "=")[1]).alias("member")))


def revenue_priority(concept: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in REVENUE_CONCEPTS.items() for x in kv))
    return F.coalesce(table[concept], F.when(F.lower(concept).rlike("revenues?$"), 70).otherwise(-1))


def _has(text: Column, hints: Sequence[str]) -> Column:
    return F.regexp_like(text, F.lit("|".join(hints)))


def axis_priority(axis: Column) -> Column:
    low = F.lower(axis)
    return F.when(_has(low, BUSINESS_AXES), 100).when(_has(low, PRODUCT_AXES), 80).when(low.contains("segment") | low.contains("business"), 60).otherwise(0)


def axis_kind(axis: Column) -> Column:
    low = F.lower(axis)
    return F.when(_has(low, PRODUCT_AXES), "product").when(_has(low, BUSINESS_AXES) | low.contains("segment") | low.contains("business"), "business").otherwise("other")


def member_label(member: Column) -> Column:
    """Words of a member's name."""
    return F.trim(F.regexp_replace(F.regexp_replace(member, "(?i)member$", ""), "([a-z0-9])([A-Z])", "$1 $2"))


def is_place(member: Column) -> Column:
    label = normal_label(member_label(member))
    words = F.filter(F.split(label, " "), lambda w: w != "")
    return _has(label, PLACES) | ((F.size(words) > 0) & (F.size(F.array_except(words, F.array(*map(F.lit, PLACE_WORDS)))) == 0))


def is_generic(member: Column, among: Column) -> Column:
    """Whether a member stands for all others of the axis, or for products or services that `among` names one by one."""
    low, every = F.lower(member), F.array_distinct(F.transform(among, F.lower))
    plain = F.array(*map(F.lit, (*PRODUCT_MEMBERS, *SERVICE_MEMBERS)))
    services = F.filter(F.array_except(every, F.array(*map(F.lit, SERVICE_MEMBERS))), lambda m: _has(m, SERVICE_WORDS))
    return F.when(low.isin(*WHOLE_MEMBERS), True).when(low.isin(*PRODUCT_MEMBERS), F.size(F.array_except(every, plain)) >= 2).when(low.isin(*SERVICE_MEMBERS), F.size(services) > 0).otherwise(False)


def select_axis(facts: DataFrame, dims: str = "dims") -> DataFrame:
    """Adds axis, axis_priority and member: the first axis of the highest priority, of its members the last that is
    neither generic nor a place (if there is none, that is not generic). Facts without such an axis go."""
    named = F.filter(dims, lambda x: (x["dimension"] != "") & (x["member"] != "") & ~F.lower(x["dimension"]).isin(*IGNORED_AXES))

    def of_members(m: Column) -> Column:
        """m: the members of the axis -> the one that stands."""
        own = lambda k: bound(F.filter(k, lambda x: ~is_place(x)), lambda o: F.when(F.size(o) > 0, o).otherwise(k))
        kept = lambda s: bound(F.filter(s, lambda x: ~is_generic(x, m)), lambda k: F.when(F.size(k) > 0, own(k)).otherwise(F.when(F.size(s) > 0, s).otherwise(m)))
        return F.element_at(bound(F.filter(m, lambda x: ~F.lower(x).isin(*GENERIC_MEMBERS)), kept), -1)

    def of_axis(a: Column) -> Column:
        """a: the dimensions, the highest priority and its first axis."""
        members = F.transform(F.filter(a["d"], lambda x: x["dimension"] == a["axis"]), lambda x: x["member"])
        return F.struct(a["axis"].alias("axis"), a["p"].alias("axis_priority"), bound(members, of_members).alias("member"))

    def ranked(d: Column) -> Column:
        every = F.transform(d, lambda x: F.struct(axis_priority(x["dimension"]).alias("p"), x["dimension"].alias("axis")))
        top = lambda e: bound(F.array_max(F.transform(e, lambda x: x["p"])), lambda p: F.struct(d.alias("d"), p.alias("p"), F.get(F.filter(e, lambda x: x["p"] == p), F.lit(0))["axis"].alias("axis")))
        return bound(bound(every, top), lambda a: F.when(a["p"] > 0, of_axis(a)))

    # Exploded, so that no filter behind it is pushed in front of it and works all of this out again, once for every use.
    return facts.select("*", F.explode(F.array_compact(F.array(bound(named, ranked)))).alias("_axis")).select(*facts.columns, "_axis.*")


def axis_scores(facts: DataFrame) -> DataFrame:
    """(company_id, axis, score, periods, fits, own, weight): how well an axis tells a company's business."""
    per = facts.groupBy("company_id", "axis").agg(F.max("axis_priority").alias("p"), F.collect_set("member").alias("m"), F.count_distinct("end_date").alias("periods"), F.sum("concept_priority").alias("weight"))
    return _scored(per)


def _scored(per: DataFrame, *more: str) -> DataFrame:
    """per: an axis with its priority p, members m, periods and weight; `more` columns stay."""
    n = F.size("m")
    own = F.size(F.filter("m", lambda x: ~is_generic(x, F.col("m"))))
    places, whole = F.size(F.filter("m", is_place)), F.size(F.filter("m", lambda x: is_aggregate(member_label(x))))
    per = per.withColumns({"own": own, "_places": places, "_n": n, "_whole": whole, "_kind": axis_kind(F.col("axis"))})
    own, places, n = F.col("own"), F.col("_places"), F.col("_n")
    bonus = F.when((F.col("_kind") == "product") & (own >= 3) & (places == 0), 28).when((F.col("_kind") == "business") & (own >= 2) & (places == 0), 12).otherwise(0)
    away = F.when(places >= n * 0.95, 90).when(places >= n * 0.66, 70).when(places >= n * 0.4, 36).otherwise(0)
    score = F.col("p") + bonus - away - F.when(own < 2, 18).otherwise(0) - 18 * F.col("_whole") - F.when(n > 12, 10).otherwise(0)
    return per.select("company_id", "axis", score.alias("score"), "periods", own.between(2, 8).cast("int").alias("fits"), "own", "weight", *more)


def _order() -> Column:
    return F.struct("score", "periods", "fits", "own", "weight", "axis")


def pick_axis(facts: DataFrame) -> DataFrame:
    """(company_id, axis): the axis of the best score, then periods, a handful of members, members, weight, name."""
    return axis_scores(facts).groupBy("company_id").agg(F.max_by("axis", _order()).alias("axis"))


def _axes(facts: DataFrame) -> DataFrame:
    """Scored axes of each company, with their facts in _alike. A company's facts lie together by their dims (as text), of
    which there are few, so an axis is worked out for these alone. Nothing is joined; no group is larger than a company."""
    rest = [c for c in facts.columns if c not in ("company_id", "dims")]
    # The struct is made by a projection, which is compiled; inside of collect_list it would be interpreted.
    whole = facts.select("company_id", "dims", "concept_priority", F.struct(*rest).alias("_fact"))
    alike = whole.groupBy("company_id", "dims").agg(F.collect_list("_fact").alias("_facts"), F.sum("concept_priority").alias("_weight"))
    at = select_axis(alike.withColumn("dims", parse_dims(F.col("dims"))))
    per = at.groupBy("company_id", "axis").agg(F.max("axis_priority").alias("p"), F.collect_set("member").alias("m"), F.collect_list(F.struct("axis_priority", "member", "_facts")).alias("_alike"), F.sum("_weight").alias("weight"))
    periods = F.size(F.array_distinct(F.array_compact(F.flatten(F.transform("_alike", lambda a: a["_facts"]["end_date"]))))).cast("long")
    return _scored(per.withColumn("periods", periods), "_alike")


def marked_axes(facts: DataFrame) -> DataFrame:
    """axis_scores of facts whose dims are text, with `picked`: whether pick_axis picks the axis (never for no company)."""
    at = _axes(facts).drop("_alike").withColumn("_best", F.max(_order()).over(Window.partitionBy("company_id")))
    return at.withColumn("picked", F.col("company_id").isNotNull() & (F.col("axis") == F.col("_best.axis"))).drop("_best")


def facts_on_axis(facts: DataFrame) -> DataFrame:
    """Facts of the axis that pick_axis picks for their company, with axis, axis_priority and member as select_axis gives
    them; dims, here as text, goes, and so do facts of no company."""
    rest = [c for c in facts.columns if c not in ("company_id", "dims")]
    best_axis = _axes(facts.where("company_id is not null")).groupBy("company_id").agg(F.max_by(F.struct("axis", "_alike"), _order()).alias("_best"))
    members = best_axis.select("company_id", F.col("_best.axis").alias("axis"), F.explode("_best._alike").alias("_a"))
    rows = members.select("company_id", "axis", "_a.axis_priority", "_a.member", F.explode("_a._facts").alias("_fact"))
    return rows.select("company_id", *(F.col("_fact")[c].alias(c) for c in rest), "axis", "axis_priority", "member")


def form_preference(form: Column, span: Column) -> Column:
    name = F.regexp_replace(F.upper(form), " ", "")
    quarterly, annual = name.isin("10-Q", "10Q", "6-K", "6K"), name.isin("10-K", "10K", "20-F", "20F", "40-F", "40F")
    return F.when(span.between(45, 120), F.when(quarterly, 3).when(annual, 2).otherwise(1)).otherwise(F.when(annual, 3).when(quarterly, 2).otherwise(1))


def segment_quality() -> Column:
    """Order of facts of one period: concept, form, how late it was filed, a quarter's length, later filing."""
    lag, span = F.datediff("filing_date", "end_date"), day_span(F.col("start_date"), F.col("end_date"))
    bucket = F.when(lag.isNull(), 1).when(lag < -2, 0).when(lag <= 220, 5).when(lag <= 450, 4).when(lag <= 720, 3).otherwise(2)
    near = F.when(lag.isNull() | (lag < -2), -9999).when(lag <= 220, -F.abs(lag - 45)).when(lag <= 450, -F.abs(lag - 120)).when(lag <= 720, -F.abs(lag - 240)).otherwise(-F.abs(lag - 360))
    return F.struct(F.col("concept_priority").alias("concept"), form_preference(F.col("form"), span).alias("form"), bucket.alias("bucket"), near.alias("near"), (-F.abs(span - 91)).alias("length"), F.col("filing_date").alias("filed"))


def dedupe_segment_facts(facts: DataFrame) -> DataFrame:
    """The best fact of each member, period and concept; of equal ones the greater value."""
    return best(facts, ["company_id", "member", "start_date", "end_date", "concept"], F.struct(segment_quality(), F.col("value")))


def segment_series(facts: DataFrame, floor: int | None = None) -> DataFrame:
    """(company_id, member, quarter, value, derived): facts of one axis as quarters of each member; year-to-date spans
    are taken apart as for statement facts, the best fact of an end date by segment_quality."""
    keys = ["company_id", "member"]
    span = day_span(F.col("start_date"), F.col("end_date"))
    kind = F.when(span.between(45, 120), "direct").when(span.between(121, 390), "cumulative")
    split = best(facts.withColumn("span_kind", kind).where("span_kind is not null"), [*keys, "span_kind", "end_date"], F.struct(segment_quality(), F.col("concept"), F.col("value")))
    at = derive_quarters(split, keys).withColumn("quarter", calendar_quarter(F.col("end_date")))
    at = at if floor is None else at.where(q_index(F.col("quarter")) >= floor)
    return best(at, [*keys, "quarter"], F.struct((~F.col("derived")).alias("d"), F.col("end_date"))).select(*keys, "quarter", "value", "derived")


def _on_axis(axis: str) -> Column:
    return F.filter("dims", lambda x: x["dimension"] == axis)


def match_hierarchy(facts: DataFrame, config: Sequence[Mapping]) -> DataFrame:
    """Facts that meet a configured member's dimension filters: rows (…, member_key, name).

    config: member_key, name, filters (dimension -> allowed members), exact (the dimensions that must be there, none
    else; optional), aggregate (whether all matches of a concept and period are summed). The configuration is fixed and
    small, so it is laid out in expressions; nothing is joined."""
    names = F.array_sort(F.array_distinct(F.transform("dims", lambda x: x["dimension"])))
    hits = []
    for row in config:
        ok = F.lit(True)
        if row.get("exact") is not None:
            ok = ok & (names == F.array_sort(F.array(*map(F.lit, sorted(row["exact"])))))
        for axis, allowed in row["filters"].items():  # of a repeated dimension the last member counts
            own = _on_axis(axis)
            ok = ok & F.coalesce(F.when(F.size(own) > 0, F.element_at(own, -1)["member"].isin(*allowed)), F.lit(False))
        hits.append(F.when(ok, F.struct(F.lit(row["member_key"]).alias("member_key"), F.lit(row["name"]).alias("name"), F.lit(bool(row.get("aggregate"))).alias("whole"))))
    rows = facts.select("*", F.explode(F.array_compact(F.array(*hits))).alias("_hit")).select(*facts.columns, "_hit.*")
    keys = ["company_id", "concept", "start_date", "end_date", "member_key", "name"]
    # Both kinds leave one aggregate, so that the facts are read once.
    per = rows.groupBy(*keys, "whole").agg(F.sum("value").cast("decimal(20,2)").alias("_sum"), F.collect_list(F.when(~F.col("whole"), F.struct("value"))).alias("_each"))
    return per.select(*keys, F.explode(F.when(F.col("whole"), F.array(F.struct(F.col("_sum").alias("value")))).otherwise(F.col("_each"))).alias("_v")).select(*keys, F.col("_v.value").alias("value"))


def label_allowlist(facts: DataFrame, labels: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Facts of the axes and members named, relabelled: axis -> member -> name."""
    table = F.create_map(*(F.lit(x) for axis, names in labels.items() for m, name in names.items() for x in (f"{axis}|{m}", name)))
    return facts.withColumn("name", table[F.concat_ws("|", "axis", "member")]).where("name is not null")


def derive_member_quarters(records: DataFrame) -> DataFrame:
    """(company_id, q_index, member_key, value, derived) from records (company_id, q_index, span, member_key, value, ord).

    Of span-1 rows the last (by ord) stands. A record of a longer span needs all quarters before it in the span, each
    with every member that it must derive; then its members less those quarters are added, else none of them. Records go
    in order of quarter and span and see what earlier ones added: one fold over a company's few records."""
    last = records.groupBy("company_id", "q_index", "span", "member_key").agg(F.max_by("value", "ord").alias("value"))
    one = last.groupBy("company_id", "q_index", "span").agg(F.map_from_entries(F.collect_list(F.struct("member_key", "value"))).alias("m"))
    per = one.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("q_index", "span", F.map_entries("m").alias("e")))).alias("r"))
    kind = "array<struct<q_index:int,member_key:string,value:decimal(24,3),derived:boolean>>"
    flat = lambda r, derived: F.transform(r["e"], lambda e: F.struct(r["q_index"].alias("q_index"), e["key"].alias("member_key"), e["value"].cast("decimal(24,3)").alias("value"), F.lit(derived).alias("derived")))
    direct = F.flatten(F.transform(F.filter("r", lambda r: r["span"] == 1), lambda r: flat(r, False))).cast(kind)

    def step(have: Column, r: Column) -> Column:
        inside = F.filter(have, lambda h: (h["q_index"] < r["q_index"]) & (h["q_index"] > r["q_index"] - r["span"]))
        quarters = F.size(F.array_distinct(F.transform(inside, lambda h: h["q_index"])))
        fresh = F.filter(r["e"], lambda e: ~F.exists(have, lambda h: (h["q_index"] == r["q_index"]) & (h["member_key"] == e["key"])))
        whole = F.forall(fresh, lambda e: F.size(F.filter(inside, lambda h: h["member_key"] == e["key"])) == r["span"] - 1)
        less = lambda e: F.aggregate(F.filter(inside, lambda h: h["member_key"] == e["key"]), F.lit(0).cast("decimal(24,3)"), lambda a, h: (a + h["value"]).cast("decimal(24,3)"))
        made = F.transform(fresh, lambda e: F.struct(r["q_index"].alias("q_index"), e["key"].alias("member_key"), (e["value"] - less(e)).cast("decimal(24,3)").alias("value"), F.lit(True).alias("derived")))
        return F.when((quarters == r["span"] - 1) & whole, F.concat(have, made)).otherwise(have).cast(kind)

    return per.select("company_id", F.explode(F.aggregate(F.filter("r", lambda r: r["span"] > 1), direct, step)).alias("x")).select("company_id", "x.*")


def derive_display_revenue(records: DataFrame) -> DataFrame:
    """The same for a reported total (company_id, q_index, span, value): only positive values count."""
    rows = records.where("value > 0").select("company_id", "q_index", "span", F.lit("total").alias("member_key"), "value", F.lit(0).alias("ord"))
    return derive_member_quarters(rows).where("value > 0").select("company_id", "q_index", "value", "derived")


def fallback_structure(segments: DataFrame, least: float = 0.02, rows: int = 2) -> DataFrame:
    """Named segments above `least`, in quarters that have at least `rows` of them."""
    at = segments.where((F.col("value") > F.lit(least).cast("decimal(10,4)")) & (F.trim(F.coalesce("name", F.lit(""))) != ""))
    return at.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("company_id", "q_index"))).where(F.col("_n") >= rows).drop("_n")


def first_available(sources: Sequence[DataFrame], key: str = "company_id") -> DataFrame:
    """Rows of the first source that has any of a company; one window by company, nothing is joined."""
    every = None
    for i, df in enumerate(sources):
        df = df.withColumn("source_rank", F.lit(i))
        every = df if every is None else every.unionByName(df)
    return every.withColumn("_first", F.min("source_rank").over(Window.partitionBy(key))).where("source_rank = _first").drop("_first")
