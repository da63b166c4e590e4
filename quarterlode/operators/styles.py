"""Styles of a quarter's bridge: which rule its members fit, and rows regrouped for a style."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterlode.operators.history import QUARTER
from quarterlode.operators.taxonomy import label_key

RULE = "ord int, company string, style string, clauses array<struct<keys:array<string>,least:int>>"
# Fixed values. Rules of companies in order: (company, style, clauses); each clause names members and how many must be there.
COMPANY_RULES = (
    ("alibaba", "alibaba-commerce-staged", ((("taobaoandtmallgroup", "alibabachinaecommercegroup", "alidcg", "cloudintelligencegroup"), 1),)),
    ("alphabet", "ad-funnel-bridge", ((("adrevenue", "googleservices"), 1), (("googlecloud",), 1))),
    ("amazon", "commerce-service-bridge", ((("onlinestores",), 1), (("amazonwebservices", "aws", "thirdpartysellerservices"), 1))),
    ("tesla", "tesla-revenue-bridge", ((("auto", "services", "energygenerationstorage"), 2),)),
    ("xiaomi", "xiaomi-revenue-bridge", ((("smartphonexaiot", "smartevaiandothernewinitiatives", "smartphones", "internetservices"), 1),)),
    ("visa", "visa-revenue-bridge", ((("dataprocessingrevenues",), 1), (("internationaltransactionrevenues",), 1))),
    ("micron", "micron-business-unit-bridge", ((("cnbu", "mbu", "sbu", "ebu", "cmbu", "mcbu", "cdbu", "aebu", "microncomputedatacenter", "micronmobileclient", "micronstoragecloudmemory", "micronautoembedded"), 1),)),
)
# Fixed values. Rules of layouts for any company, in order.
LAYOUT_RULES = (
    (None, "triad-lockup-bridge", ((("productivitybusinessprocesses", "productivityandbusinessprocesses"), 1), (("intelligentcloud",), 1), (("morepersonalcomputing",), 1))),
    (None, "membership-fee-bridge", ((("membership", "membershipfee"), 1),)),
    (None, "ad-funnel-bridge", ((("adrevenue",), 1), (("googleplay", "googlecloud"), 1))),
    (None, "commerce-service-bridge", ((("onlinestores",), 1), (("amazonwebservices", "aws", "thirdpartysellerservices"), 1))),
    (None, "apps-labs-bridge", ((("familyofapps",), 1), (("realitylabs",), 1))),
)
# Fixed values. Styles with one member apart: (style, its key, key and name it gets, key and name of the rest).
REGROUPED = (("membership-fee-bridge", "membership", "membershipfee", "Membership Fee", "netsales", "Net Sales"),)


def rule_table(like: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """Rules as rows, so that others can be read from a table."""
    rows = [(i, company, style, [(list(keys), least) for keys, least in clauses]) for i, (company, style, clauses) in enumerate(rules)]
    return like.sparkSession.createDataFrame(rows, RULE)


def classify_style(rows: DataFrame, quarters: DataFrame, rules: DataFrame, default: str | None = None) -> DataFrame:
    """(company_id, q_index, style): the style that a quarter says itself, else that of the first rule that its members fit.

    rows: member_key, name. quarters: company (what rules name), style, has_details (a quarter with details that fits no rule
    has the style 'hierarchical-detail-bridge' where there is a default). Rules are few; they are joined by company or
    for all, as one broadcast array of candidates."""
    keys = rows.groupBy(*QUARTER).agg(F.collect_set(label_key(F.coalesce("member_key", "name"))).alias("_k"))
    every = rules.agg(F.array_sort(F.collect_list(F.struct("ord", "company", "style", "clauses"))).alias("_rules"))
    at = quarters.join(keys, list(QUARTER), "left").withColumn("_k", F.coalesce("_k", F.array().cast("array<string>"))).crossJoin(F.broadcast(every))
    fits = lambda r: (r["company"].isNull() | F.coalesce(r["company"] == F.col("company"), F.lit(False))) & F.forall(r["clauses"], lambda c: F.size(F.array_intersect("_k", c["keys"])) >= c["least"])
    found = F.get(F.filter("_rules", fits), F.lit(0))["style"]
    own = F.nullif(F.trim(F.coalesce("style", F.lit(""))), F.lit(""))
    rest = F.when(F.coalesce("has_details", F.lit(False)), "hierarchical-detail-bridge").otherwise(F.lit(default)) if default else F.lit(None).cast("string")
    return at.select(*QUARTER, F.coalesce(own, found, rest).alias("style"))


def regroup_style(rows: DataFrame, styles: DataFrame, rules: Sequence[tuple] = REGROUPED, metrics: Sequence[str] = ("yoy_pct", "qoq_pct")) -> DataFrame:
    """(company_id, q_index, member_key, name, value, metrics): rows of quarters whose style sets one member apart become two,
    that member (by key, else the first whose name holds it) and the sum of the others, metrics weighted by value (rows without
    a metric keep their weight). Rows of other styles, of one row, or without that member stay."""
    columns = [*QUARTER, "member_key", "name", "value", *metrics]
    table = rows.sparkSession.createDataFrame([tuple(r) for r in rules], "style string, apart string, apart_key string, apart_name string, rest_key string, rest_name string")
    named = rows.join(styles.select(*QUARTER, "style"), list(QUARTER), "left").join(F.broadcast(table), "style", "left")
    own, label = label_key(F.coalesce("member_key", "name")), label_key(F.coalesce("name", F.lit("")))
    place = F.struct(F.when(own == F.col("apart"), 0).otherwise(1).alias("o"), (-F.col("value")).alias("v"), "member_key")
    candidate = (own == F.col("apart")) | label.contains(F.col("apart"))
    per = named.groupBy(*QUARTER).agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(candidate, place)).alias("_apart"))
    at = named.join(per, list(QUARTER)).withColumn("_set", F.coalesce((F.col("_n") >= 2) & F.col("_apart").isNotNull(), F.lit(False)))
    mine = place == F.col("_apart")
    at = at.withColumns({"_key": F.when(~F.col("_set"), F.col("member_key")).when(mine, F.col("apart_key")).otherwise(F.col("rest_key")), "_name": F.when(~F.col("_set"), F.col("name")).when(mine, F.col("apart_name")).otherwise(F.col("rest_name")), "_rest": F.col("_set") & ~mine})
    kept = at.where(~F.col("_rest")).select(*QUARTER, F.col("_key").alias("member_key"), F.col("_name").alias("name"), "value", *(F.col(m).cast("double").alias(m) for m in metrics))
    weighted = (F.round(F.sum(F.col("value") * F.col(m)).cast("double") / F.sum("value").cast("double"), 1).alias(m) for m in metrics)
    rest = at.where("_rest").groupBy(*QUARTER, F.col("_key").alias("member_key"), F.col("_name").alias("name")).agg(F.sum("value").cast(rows.schema["value"].dataType).alias("value"), *weighted)
    return kept.select(columns).unionByName(rest.select(columns))


def generic_opex(df: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """(company_id, q_index, name, value): operating expenses from R&D, SG&A and other, those above 0.05, against the quarter's total.

    They stay, with a residual above the tolerance, if they fit the total. One that does not is cut to it; of several, R&D and
    SG&A that fit stay (scaled down if too much together), what is left above the tolerance is other opex. Without a total
    above 0.05 all stay as they are."""
    m = lambda x: x.cast("decimal(20,4)")
    d = lambda x: F.lit(str(x)).cast("decimal(10,4)")
    lines = (("R&D", "rnd", True), ("SG&A", "sgna", True), ("Other OpEx", "other_opex", False))
    items = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), m(F.col(c)).alias("value"), F.lit(a).alias("anchor")) for n, c, a in lines)), lambda x: x["value"] > d(0.05))
    total_of = lambda a: F.aggregate(a, m(F.lit(0)), lambda s, x: m(s + x["value"]))
    kind = "array<struct<name:string,value:decimal(20,4),anchor:boolean>>"
    at = df.withColumns({"_i": items, "_t": F.greatest(m(F.coalesce("operating_expenses", F.lit(0))), m(F.lit(0)))})
    at = at.withColumns({"_s": total_of(F.col("_i")), "_a": F.filter("_i", lambda x: x["anchor"] & (x["value"] <= F.col("_t") + d(tolerance)))}).withColumn("_as", total_of(F.col("_a")))
    rest = lambda name, s: F.when(F.col("_t") - s > d(tolerance), F.array(F.struct(F.lit(name).alias("name"), m(F.col("_t") - s).alias("value"), F.lit(False).alias("anchor")))).otherwise(F.array().cast(kind))
    fits = F.forall("_i", lambda x: x["value"] <= F.col("_t") + d(tolerance)) & (F.col("_s") <= F.col("_t") + d(tolerance))
    cut = F.transform("_i", lambda x: F.struct(x["name"].alias("name"), F.least(x["value"], F.col("_t")).alias("value"), x["anchor"].alias("anchor")))
    scaled = F.transform("_a", lambda x: F.struct(x["name"].alias("name"), m(F.round((x["value"].cast("decimal(18,4)") * F.col("_t").cast("decimal(18,4)") / F.col("_as").cast("decimal(18,4)")).cast("decimal(38,8)"), 4)).alias("value"), x["anchor"].alias("anchor")))
    made = F.when(F.col("_t") <= d(0.05), F.col("_i")).when(fits, F.concat("_i", rest("Residual OpEx", F.col("_s")))).when(F.size("_i") == 1, cut).when(F.col("_as") > F.col("_t") + d(tolerance), scaled).otherwise(F.concat("_a", rest("Other OpEx", F.col("_as"))))
    return at.select(*QUARTER, F.explode(made).alias("x")).select(*QUARTER, "x.name", "x.value")
