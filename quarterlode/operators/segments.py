"""Revenue segments: members, labels, clean-up, growth; all by (company, quarter)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterlode.operators.facts import percent

QUARTER = ("company_id", "q_index")

# Fixed values. Words that a member group does not go by; short plurals that are no plurals.
GROUP_STOP = ("and", "seg", "segment", "segments", "member")
NO_PLURAL = ("news", "this", "us")
# Fixed values. Labels that stand for all segments together.
AGGREGATES = ("aggregation before other operating", "reportable aggregation", "segment aggregation", "business segments", "operating segments", "consolidated", "total company", "total segment")
AGGREGATE_NAMES = ("primary", "primary segment", "reportable", "reportable segment")
LABEL_STOP = ("and", "other", "services", "service")


def normal_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(label, F.lit("&"), F.lit(" and "))), "[^a-z0-9]+", " "))


def group_key(label: Column) -> Column:
    """Sorted distinct words of a label without stop words and the plural s of words of four or five letters."""
    words = F.filter(F.split(normal_label(label), " "), lambda w: (w != "") & ~w.isin(*GROUP_STOP))
    single = F.transform(words, lambda w: F.when(F.length(w).isin(4, 5) & F.endswith(w, F.lit("s")) & ~w.isin(*NO_PLURAL), F.regexp_replace(w, "s$", "")).otherwise(w))
    return F.array_join(F.array_sort(F.array_distinct(single)), "|")


def is_aggregate(label: Column) -> Column:
    n = normal_label(label)
    return n.isin(*AGGREGATE_NAMES) | F.regexp_like(n, F.lit("|".join(AGGREGATES)))


def label_tokens(label: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_label(label), " "), lambda w: (w != "") & ~w.isin(*LABEL_STOP)))


def combines(name: Column, others: Column) -> Column:
    """How many of a quarter's labels `others` have all their words, and not all words, in a label with "and"."""
    tokens = label_tokens(name)
    part = lambda o: ~is_aggregate(o) & (o != name) & (F.size(label_tokens(o)) > 0) & (F.size(label_tokens(o)) < F.size(tokens)) & (F.size(F.array_except(label_tokens(o), tokens)) == 0)
    return F.when(F.contains(normal_label(name), F.lit(" and ")) & (F.size(tokens) >= 2), F.size(F.filter(others, part))).otherwise(0)


def combined_labels(df: DataFrame, keys: Sequence[str] = QUARTER) -> DataFrame:
    """(keys, name) of labels with "and" that contain all words of at least two other labels of the quarter.

    The few labels of a quarter are collected once and tested in place."""
    at = df.groupBy(*keys).agg(F.collect_set("name").alias("_all")).select(*keys, "_all", F.explode("_all").alias("name"))
    return at.select(*keys, "name", combines(F.col("name"), F.col("_all")).cast("long").alias("parts")).where("parts >= 2")


def group_members(df: DataFrame) -> DataFrame:
    """(company, group, label, members): members of one signature, with the longest label."""
    at = df.select("company_id", "name").distinct().withColumn("group_key", group_key(F.col("name"))).where("group_key <> ''")
    return at.groupBy("company_id", "group_key").agg(F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("label"), F.count(F.lit(1)).alias("members"))


def best_member_row(df: DataFrame, rank: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in (*QUARTER, "member_key")]
    return df.groupBy(*QUARTER, "member_key").agg(F.max_by(F.struct(*rest), rank).alias("b")).select(*QUARTER, "member_key", "b.*")


def merge_same_value(df: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Drops a row if another of the quarter has the same value and a longer name that contains its own."""
    every = F.collect_list(F.struct("name", "value")).over(Window.partitionBy(*QUARTER))
    name, value = F.col("name"), F.col("value")
    longer = lambda o: F.contains(o["name"], name) & (F.length(o["name"]) > F.length(name)) & (F.abs(o["value"] - value) < tolerance)
    return df.withColumn("_all", every).where(~F.exists("_all", longer)).select(df.columns)


def clean_segments(df: DataFrame) -> DataFrame:
    """Positive rows; of three or more, aggregates go if two others stay, then combined labels if any others stay."""
    w = Window.partitionBy(*QUARTER)
    rows = df.withColumn("_all", F.collect_set("name").over(w)).where(F.col("value") > 0.001).withColumn("_a", is_aggregate(F.col("name")))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_plain", F.count_if(~F.col("_a")).over(w))
    rows = rows.where(~(F.col("_a") & (F.col("_n") >= 3) & (F.col("_plain") >= 2))).withColumn("_c", combines(F.col("name"), F.col("_all")) >= 2)
    rows = rows.withColumn("_rest", F.count_if(~F.col("_c")).over(w))
    return rows.where(~F.col("_c") | (F.col("_n") < 3) | (F.col("_rest") == 0)).select(df.columns)


def canonical_member(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Member keys by the company's alias table (company_id, alias, canonical), else the cleaned key itself."""
    key = F.regexp_replace(F.lower(F.coalesce("member_key", "name")), "[^a-z0-9]+", "")
    at = df.withColumn("_key", key).join(aliases.select("company_id", F.col("alias").alias("_key"), "canonical"), ["company_id", "_key"], "left")
    return at.withColumn("member_key", F.coalesce("canonical", "_key")).where("member_key <> ''").select(df.columns)


def dedupe_segments(df: DataFrame) -> DataFrame:
    """One row of each member: attributes of the latest filing (then larger value), the value is the greatest."""
    rest = [c for c in df.columns if c not in (*QUARTER, "member_key", "value")]
    best = df.groupBy(*QUARTER, "member_key").agg(F.max_by(F.struct(*rest), F.struct("filing_date", "value", "name")).alias("b"), F.max("value").alias("value"))
    return best.select(*QUARTER, "member_key", "value", "b.*").select(df.columns)


def supersede(df: DataFrame, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Where a new member is reported the old ones that it replaces go. rules: (new member, old members)."""
    members = F.collect_set("member_key").over(Window.partitionBy(*QUARTER))
    gone = F.lit(False)
    for new, old in rules:
        gone = gone | (F.array_contains("_all", F.lit(new)) & F.col("member_key").isin(*old))
    return df.withColumn("_all", members).where(~gone).drop("_all")


def schema_regime(df: DataFrame, legacy: Sequence[str], current: Sequence[str], from_q: int) -> DataFrame:
    """Where keys of an old and a new scheme are mixed, those of the scheme that is valid in the quarter stay."""
    w = Window.partitionBy(*QUARTER)
    old, new = F.col("member_key").isin(*legacy), F.col("member_key").isin(*current)
    mixed = (F.max(old).over(w) & F.max(new).over(w)).alias("_mixed")
    at = df.select("*", mixed)
    return at.where(~F.col("_mixed") | F.when(F.col("q_index") >= from_q, ~old).otherwise(~new)).drop("_mixed")


def comparable_buckets(df: DataFrame, buckets: dict[str, Sequence[str]]) -> DataFrame:
    """Members summed into coarse buckets; members of no bucket stand for themselves."""
    pairs = [x for bucket, keys in buckets.items() for k in keys for x in (F.lit(k), F.lit(bucket))]
    return df.groupBy(*QUARTER, F.coalesce(F.create_map(*pairs)[F.col("member_key")], "member_key").alias("bucket")).agg(F.sum("value").cast("decimal(20,2)").alias("value"), F.count(F.lit(1)).alias("members"))


def attach_segments(statements: DataFrame, segments: DataFrame) -> DataFrame:
    return segments.join(statements.select(*QUARTER), list(QUARTER), "left_semi")


def synthesize_statements(segments: DataFrame, statements: DataFrame) -> DataFrame:
    """Statement rows, with the sum of segments as revenue, for quarters that have segments only."""
    return segments.groupBy(*QUARTER).agg(F.sum("value").cast("decimal(20,2)").alias("revenue"), F.count(F.lit(1)).alias("segments")).join(statements.select(*QUARTER), list(QUARTER), "left_anti")


def segment_growth(segments: DataFrame, statements: DataFrame) -> DataFrame:
    """Mix, growth against the previous quarter and the year before, change of mix in points, for each member."""
    w = Window.partitionBy("company_id", "member_key").orderBy("q_index")
    back = lambda c, n: F.first(c).over(w.rangeBetween(-n, -n))
    at = segments.join(statements.select(*QUARTER, "revenue"), list(QUARTER), "left")
    v, r = F.col("value"), F.col("revenue")
    share = lambda a, b: (a.cast("decimal(20,4)") * 100 / F.when(b != 0, b.cast("decimal(20,4)"))).cast("decimal(38,12)")
    delta = F.when(back("value", 4) != 0, F.round(share(v, r) - share(back("value", 4), back("revenue", 4)), 1).cast("double"))
    return at.select(*QUARTER, "member_key", "value", percent(v, r, 1).alias("mix_pct"), percent(v - back("value", 1), back("value", 1)).alias("qoq_pct"), percent(v - back("value", 4), back("value", 4)).alias("yoy_pct"), delta.alias("mix_yoy_delta_pp"))


def shares_to_amounts(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """Rows whose metric_mode is 'share' hold percentages: their amounts of the quarter's revenue."""
    at = rows.join(statements.select(*QUARTER, "revenue"), list(QUARTER), "left")
    amount = F.round((F.col("value") * F.col("revenue") / 100).cast("decimal(38,6)"), 3).cast("decimal(24,3)")
    return at.withColumn("value", F.when((F.col("metric_mode") == "share") & (F.col("revenue") != 0), amount).otherwise(F.col("value").cast("decimal(24,3)"))).select(rows.columns)


def display_scale(statements: DataFrame, totals: DataFrame, exact: float = 0.08) -> DataFrame:
    """Reported total over statement revenue; 1 where both agree within `exact`."""
    at = statements.join(totals, list(QUARTER))
    ratio = F.when(F.col("revenue") > 0, (F.col("total").cast("decimal(20,4)") / F.col("revenue").cast("decimal(20,4)")).cast("decimal(38,12)"))
    return at.select(*QUARTER, F.when(F.abs(F.col("total") - F.col("revenue")) <= exact, F.lit(1.0)).otherwise(F.round(ratio, 6).cast("double")).alias("scale"))


def rollup_members(df: DataFrame, parents: DataFrame) -> DataFrame:
    """Members summed into configured parents (member_key, parent), which are few and checked by the broadcast threshold."""
    return df.join(parents, "member_key").groupBy(*QUARTER, "parent").agg(F.sum("value").cast("decimal(20,2)").alias("value"), F.count(F.lit(1)).alias("members"))
