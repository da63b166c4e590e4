"""Documents of companies (JSON, XML, wide tables, overrides, supplements) as long tables, and the dataset as documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quarterlode.functions.periods import q_index
from quarterlode.operators.dimensions import DIMS, local_name, revenue_priority
from quarterlode.operators.phases import bound

# Fixed values. What a third-party statement calls its lines.
WIDE_LABELS = {
    "revenue": ("revenue", "total revenue", "revenues"),
    "cost_of_revenue": ("cost of revenue", "cost of goods sold", "cost of sales"),
    "gross_profit": ("gross profit",),
    "operating_income": ("operating income", "operating profit"),
    "net_income": ("net income", "net profit"),
}
#: Items that single values of a supplement become: field -> (kind, name).
SUPPLEMENT_ITEMS = {"traffic_acquisition_cost": ("cost", "TAC"), "other_cost_of_revenue": ("cost", "Other cost"), "sgna": ("opex", "SG&A"), "rnd": ("opex", "R&D")}


def read_company_facts(docs: DataFrame, body: str = "body") -> DataFrame:
    """(company_id, body) -> facts: namespace -> concept -> unit -> facts of a company's JSON document, one row each.

    Broken documents, and facts whose value is no number, give nothing."""
    fact = "struct<start:string,end:string,val:string,accn:string,fy:string,fp:string,form:string,filed:string>"
    schema = f"struct<facts:map<string,map<string,struct<units:map<string,array<{fact}>>>>>>"
    at = docs.select("company_id", F.explode(F.from_json(body, schema)["facts"]).alias("namespace", "c")).select("company_id", "namespace", F.explode("c").alias("concept", "u"))
    at = at.select("company_id", "namespace", "concept", F.explode("u.units").alias("unit", "f")).select("company_id", "namespace", "concept", "unit", F.explode("f").alias("f"))
    day = lambda c: F.col(f"f.{c}").try_cast("date")
    rows = at.select("company_id", "namespace", "concept", "unit", F.col("f.form").alias("form"), F.col("f.accn").alias("accession"), day("filed").alias("filed"), F.col("f.fy").alias("fiscal_year"), F.col("f.fp").alias("fiscal_period"), day("start").alias("start_date"), day("end").alias("end_date"), F.col("f.val").try_cast("decimal(20,2)").alias("value"))
    return rows.where("value is not null")


def read_segment_facts(docs: DataFrame, body: str = "body") -> DataFrame:
    """(filing columns, body) -> dimensional facts of an XML instance: revenue elements with the period and the dimensions
    of their context. Contexts without a period, elements without a number and other concepts give nothing."""
    keys = [c for c in docs.columns if c != body]
    context = "struct<_id:string,period:struct<startDate:string,endDate:string>,entity:struct<segment:struct<explicitMember:array<struct<_dimension:string,_VALUE:string>>>>>"
    parsed = F.from_xml(F.col(body), f"struct<context:array<{context}>>")["context"]
    members = lambda c: F.transform(F.coalesce(c["entity"]["segment"]["explicitMember"], F.array()), lambda m: F.struct(local_name(m["_dimension"]).alias("dimension"), local_name(m["_VALUE"]).alias("member")))
    day = lambda c: c.try_cast("date")
    told = F.transform(parsed, lambda c: F.struct(c["_id"].alias("id"), day(c["period"]["startDate"]).alias("start_date"), day(c["period"]["endDate"]).alias("end_date"), members(c).cast(DIMS).alias("dims")))
    contexts = F.filter(told, lambda c: c["id"].isNotNull() & c["start_date"].isNotNull() & c["end_date"].isNotNull())
    # Each element is found once and its parts told by one more match of it alone; XML holds no sign 1.
    element = r'<([\w:-]+)\s[^>]*?contextRef="([^"]+)"[^>]*>\s*(-?[0-9.]+)\s*<'
    elements = F.transform(F.regexp_extract_all(F.col(body), F.lit(element), F.lit(0)), lambda m: F.split(F.regexp_replace(m, element, "$1\x01$2\x01$3"), "\x01"))

    def joined(every: Column) -> Column:
        """Elements with the contexts of the document that they name: ids are there once, and where not all of them count."""
        ids = F.transform(every, lambda c: c["id"])
        known = F.when(F.size(F.array_distinct(ids)) == F.size(ids), F.map_from_arrays(ids, every))
        named = lambda k, i: F.when(k.isNotNull(), F.array_compact(F.array(k[i]))).otherwise(F.filter(every, lambda c: c["id"] == i))
        pair = lambda e, c: F.struct(e[0].alias("tag"), e[2].alias("text"), *(c[x].alias(x) for x in ("start_date", "end_date", "dims")))
        return bound(known, lambda k: F.flatten(F.transform(elements, lambda e: F.transform(named(k, e[1]), lambda c: pair(e, c)))))

    # A document is taken apart in its own row: nothing is joined, and it is written once.
    facts = docs.select(*keys, F.explode(bound(contexts, joined)).alias("f"))
    facts = facts.select(*keys, local_name(F.col("f.tag")).alias("concept"), F.col("f.text").try_cast("decimal(20,2)").alias("value"), "f.start_date", "f.end_date", "f.dims")
    return facts.withColumn("concept_priority", revenue_priority(F.col("concept"))).where("concept_priority > 0 and value is not null")


def read_wide_statement(table: DataFrame, labels: Mapping[str, Sequence[str]] = WIDE_LABELS, scale: float = 0.001) -> DataFrame:
    """Rows (company_id, label, quarters, cells) of tables with quarters in columns -> a row of each quarter with a column
    of each field: label by alias, the first row of a field counts (ord), thousands signs and brackets read, times `scale`."""
    names = F.create_map(*(F.lit(x) for f, every in labels.items() for a in every for x in (a, f)))
    at = table.withColumn("field", names[F.lower(F.trim("label"))]).where("field is not null").select("company_id", "ord", "field", F.explode(F.arrays_zip("quarters", "cells")).alias("x"))
    text = F.regexp_replace(F.col("x.cells"), "[,$\\s]", "")
    number = F.when(text.rlike(r"^\(.*\)$"), -F.regexp_replace(text, "[()]", "").try_cast("decimal(20,3)")).otherwise(text.try_cast("decimal(20,3)"))
    at = at.select("company_id", F.col("x.quarters").alias("quarter"), "ord", "field", (number * F.lit(str(scale)).cast("decimal(10,6)")).cast("decimal(20,3)").alias("value")).where("value is not null")
    return at.where(q_index(F.col("quarter")).isNotNull()).groupBy("company_id", "quarter").pivot("field", list(labels)).agg(F.min_by("value", "ord"))


def read_overrides(docs: DataFrame, fields: Sequence[str], body: str = "body") -> DataFrame:
    """JSON of company -> quarter -> fields as rows (company, quarter, fields); null and non-numeric values are null."""
    record = ",".join(f"`{f}`:string" for f in fields)
    at = docs.select(F.explode(F.from_json(body, f"map<string,map<string,struct<{record}>>>")).alias("company", "q")).select("company", F.explode("q").alias("quarter", "r"))
    return at.where(q_index(F.col("quarter")).isNotNull()).select("company", "quarter", *(F.col(f"r.{f}").try_cast("decimal(20,3)").alias(f) for f in fields))


def expand_supplements(supplements: DataFrame, quarters: DataFrame, fields: Sequence[str] = tuple(SUPPLEMENT_ITEMS)) -> DataFrame:
    """supplements: (company_id, quarter or '_default', fields…, profile map) -> one row of each asked quarter of a
    company that has any: its own values over the default ones, and the single values as breakdown items. Maps among these (the profile, and
    margins by segment) are merged key by key. A company has one default row, so the join repeats nothing."""
    maps = {f.name for f in supplements.schema.fields if isinstance(f.dataType, MapType)}
    own = supplements.where("quarter <> '_default'")
    default = supplements.where("quarter = '_default'").select("company_id", *(F.col(f).alias(f"_{f}") for f in (*fields, "profile")))
    any_ = supplements.select("company_id").distinct()
    at = quarters.select("company_id", "quarter").join(any_, "company_id", "left_semi").join(own, ["company_id", "quarter"], "left").join(default, "company_id", "left")
    over = lambda f: F.coalesce(F.map_zip_with(f"_{f}", f, lambda k, a, b: F.coalesce(b, a)), F.col(f), F.col(f"_{f}")) if f in maps else F.coalesce(f, f"_{f}")
    at = at.select("company_id", "quarter", *(over(f).alias(f) for f in (*fields, "profile")))
    at = at.where(" or ".join(f"{f} is not null" for f in (*fields, "profile")))
    items = [F.when(F.col(f).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.col(f).alias("value"))) for f, (kind, name) in SUPPLEMENT_ITEMS.items() if f in fields]
    return at.withColumn("items", F.array_compact(F.array(*items)))


def derive_opex_from_profit_items(entries: DataFrame, opex: str = "opex", profit: str = "profit_items") -> DataFrame:
    """Where an entry has no opex items, its operating-profit items that are written as negatives take their place."""
    negative = F.transform(F.filter(profit, lambda x: (x["value_format"] == "negative-parentheses") & x["value"].isNotNull()), lambda x: F.struct(x["name"].alias("name"), F.round(x["value"], 3).alias("value"), x["value_format"].alias("value_format")))
    none = F.coalesce(F.size(opex), F.lit(0)) <= 0
    return entries.withColumn(opex, F.when(none & (F.size(negative) > 0), negative).otherwise(F.col(opex)))


def dataset(companies: DataFrame, statements: DataFrame, segments: DataFrame) -> DataFrame:
    """One document of each company: its quarters in order as structs, and coverage counts. A company's quarters are few."""
    keys = ["company_id", "q_index"]
    rest = [c for c in statements.columns if c not in keys]
    per = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("member_key", "value"))).alias("segments"))
    at = statements.join(per, keys, "left").groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("q_index", *rest, "segments"))).alias("quarters"), F.count(F.lit(1)).alias("quarter_count"), F.count("segments").alias("segment_quarter_count"))
    return companies.join(at, "company_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quarter_count", "segment_quarter_count")})


def write_dataset(documents: DataFrame, path: str, parts: int = 64) -> None:
    """Writes dataset() as JSON documents in folders by a hash of the company, so that one can be read without the rest."""
    documents.withColumn("part", F.pmod(F.xxhash64("company_id"), F.lit(parts))).write.mode("overwrite").partitionBy("part").json(path)


def complete_companies(companies: DataFrame, fallback: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Missing fields of the company dimension from a fallback table, the slug from ticker or name, ranks that are missing
    after all others in order of name."""
    other = fallback.select("company_id", *(F.col(f).alias(f"_{f}") for f in fields))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    at = companies.join(other, "company_id", "left").withColumns({f: F.coalesce(text(F.col(f).cast("string")), text(F.col(f"_{f}").cast("string"))) for f in fields})
    at = at.withColumn("slug", _slug(F.coalesce(text(F.col("slug")), "ticker", "name"))).drop(*(f"_{f}" for f in fields))
    # Null ranks are numbered after the greatest one; the window is over those alone and one small dimension.
    top = at.agg(F.max("rank").alias("_top"))
    missing = at.where("rank is null").withColumn("_r", F.row_number().over(Window.orderBy(F.col("name").asc_nulls_last(), "company_id"))).crossJoin(F.broadcast(top)).withColumn("rank", (F.coalesce("_top", F.lit(0)) + F.col("_r")).cast("int")).drop("_top", "_r")
    return at.where("rank is not null").unionByName(missing)


def _slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
