"""Period entries (a quarter and how many quarters it spans) to finalised quarters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUARTER = ("company_id", "q_index")
M = "decimal(20,2)"


def entry_score(fields: Sequence[str], breakdown: Column | None = None, cost: str = "cost_of_revenue") -> Column:
    """Completeness, whether there is a breakdown and a cost of revenue, then size (thousandths of revenue)."""
    have = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    listed = F.lit(0) if breakdown is None else F.coalesce(breakdown, F.lit(False)).cast("int")
    return F.struct(have.alias("fields"), listed.alias("breakdown"), F.col(cost).isNotNull().cast("int").alias("cost"), F.round(F.coalesce(F.abs("revenue"), F.lit(0).cast(M)) * 1000).alias("size"))


# Fixed values. How sources and value modes of entries read from pages rank; others have 0.
PAGE_SOURCES = {"generic-ir-pdf-release-summary": 2, "generic-ir-pdf-summary": 1}
VALUE_MODES = {"direct": 2, "derived": 1}


def page_entry_score(fields: Sequence[str], breakdown: Column, source: str = "source", value_mode: str = "value_mode", cost: str = "cost_of_revenue") -> Column:
    """entry_score of entries read from pages: before size come the rank of the source and of the value mode."""
    rank = lambda table, c: F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c], F.lit(0))
    plain = entry_score(fields, breakdown, cost)
    return F.struct(*(plain[c].alias(c) for c in ("fields", "breakdown", "cost")), rank(PAGE_SOURCES, F.col(source)).alias("source"), rank(VALUE_MODES, F.lower(F.coalesce(value_mode, F.lit("")))).alias("mode"), plain["size"].alias("size"))


def merge_period_entries(df: DataFrame, fields: Sequence[str], rank: Column, keys: Sequence[str] = QUARTER) -> DataFrame:
    """One entry of each key: every field from the highest ranked entry that has it; flags united."""
    picks = [F.max_by(f, F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields]
    return df.groupBy(*keys).agg(*picks, F.max_by("source_id", rank).alias("source_id"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("quality_flags")))), ",").alias("flags"))


def finalize_quarters(entries: DataFrame, fields: Sequence[str], never_negative: Sequence[str]) -> DataFrame:
    """Single quarters of each company: as disclosed, else the span less the span one shorter of the quarter before,
    else less all quarters before it that are final. A derived quarter with a negative line is left out.

    Entries are folded in order of quarter and span; a quarter that is there already is not derived. Spans of another
    currency (column `currency`, if there is one; empty fits all) are not subtracted, a line missing in what is subtracted is
    missing in the result, and a quarter of which no line could be derived is left out."""
    own = "currency" in entries.columns
    entries = entries.withColumn("currency", F.coalesce("currency", F.lit("")) if own else F.lit(""))
    amounts = ", ".join(f"{f}: {M}" for f in fields)
    kind = f"array<struct<q_index: int, derived: boolean, currency: string, {amounts}>>"
    rows = entries.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("q_index", "span", "currency", *fields))).alias("e"))
    made = lambda x, derived, values: F.array(F.struct(x["q_index"].alias("q_index"), F.lit(derived).alias("derived"), x["currency"].alias("currency"), *(v.cast(M).alias(f) for f, v in zip(fields, values, strict=True)))).cast(kind)
    state = F.struct(F.array().cast(kind).alias("have"), F.array().cast(f"array<struct<q_index: int, span: int, currency: string, {amounts}>>").alias("seen"))

    def total(parts: Column, f: str) -> Column:
        return F.aggregate(parts, F.lit(0).cast(M), lambda a, p: (a + p[f]).cast(M))

    def step(acc: Column, x: Column) -> Column:
        have, seen = acc["have"], acc["seen"]
        before = F.filter(seen, lambda s: (s["q_index"] == x["q_index"] - 1) & (s["span"] == x["span"] - 1))
        parts = F.filter(have, lambda h: (h["q_index"] < x["q_index"]) & (h["q_index"] > x["q_index"] - x["span"]))
        less = [F.when(F.size(before) > 0, F.get(before, F.lit(0))[f]).otherwise(total(parts, f)) for f in fields]
        values = [x[f] - v for f, v in zip(fields, less, strict=True)]
        mixes = lambda parts: (x["currency"] == "") | F.forall(parts, lambda p: (p["currency"] == "") | (p["currency"] == x["currency"]))
        fits = F.when(F.size(before) > 0, mixes(before)).otherwise((F.size(parts) == x["span"] - 1) & mixes(parts))
        fits = fits & F.coalesce(*values).isNotNull()
        for f in never_negative:
            fits = fits & F.coalesce(values[fields.index(f)] >= F.lit("-0.001").cast("decimal(4,3)"), F.lit(True))
        known = F.exists(have, lambda h: h["q_index"] == x["q_index"])
        grown = F.when(x["span"] == 1, F.concat(have, made(x, False, [x[f] for f in fields]))).when(~known & fits, F.concat(have, made(x, True, values))).otherwise(have)
        return F.struct(grown.alias("have"), F.concat(seen, F.array(x)).alias("seen"))

    folded = rows.select("company_id", F.explode(F.aggregate("e", state, step, lambda acc: acc["have"])).alias("h"))
    return folded.select("company_id", "h.*") if own else folded.select("company_id", "h.*").drop("currency")


def derive_breakdown(current: DataFrame, before: DataFrame, keys: Sequence[str] = (*QUARTER, "member_key")) -> DataFrame:
    """Members of a span less those of the span before; differences of 0.0005 or less go."""
    at = current.join(before.select(*keys, F.col("value").alias("_v")), list(keys), "left")
    return at.withColumn("value", (F.col("value") - F.coalesce("_v", F.lit(0))).cast(M)).where(F.abs("value") > F.lit("0.0005").cast("decimal(5,4)")).select(current.columns)


def drop_low_quality(df: DataFrame, core: Sequence[str], spare: Sequence[str]) -> DataFrame:
    """Entries with two core fields at least, or one of the spare ones."""
    have = sum((F.col(f).isNotNull().cast("int") for f in core), F.lit(0))
    return df.where((have >= 2) | F.coalesce(*spare).isNotNull())
