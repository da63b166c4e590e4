"""Labels of cost and expense items to a taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. Categories by kind, in order, with name and aliases.
TAXONOMY = {
    "cost": {
        "products": ("Products", ("products", "product", "costproducts", "costofgoods", "costofgoodssold", "merchandise", "materials", "manufacturing")),
        "services": ("Services", ("services", "service", "costservices", "costofservices", "subscription", "cloud", "content", "platform")),
        "traffic_acquisition_cost": ("TAC", ("tac", "trafficacquisitioncost", "traffic acquisition cost")),
        "other_cost": ("Other cost", ("othercost", "other cost")),
    },
    "opex": {
        "sales_marketing": ("Sales & Marketing", ("salesmarketing", "sales & marketing", "sellingmarketing", "marketing", "sm", "sellingexpense", "sellingexpenses", "salesdistribution", "sellingdistribution", "advertising", "promotion")),
        "general_administrative": ("G&A", ("ga", "g&a", "generaladministrative", "administrative", "administrativeexpense", "administrativeexpenses", "generaladministrativeexpense", "corporate", "corporateoverhead", "sharedservices")),
        "rnd": ("R&D", ("rnd", "r&d", "researchdevelopment", "research and development", "r&dexpense", "researchdevelopmentexpense", "productdevelopment", "engineering", "technologydevelopment")),
        "taxes_surcharges": ("Taxes & Surcharges", ("taxesandsurcharges", "taxessurcharges", "taxes surcharge", "taxessurcharge", "taxesandlevies", "levies")),
        "finance_expense": ("Finance Expense", ("financeexpense", "finance expense", "net finance expense", "financecosts", "interestexpense", "interestandotherexpense", "borrowingcosts", "财务费用")),
        "fulfillment": ("Fulfillment", ("fulfillment", "logistics", "shipping", "delivery", "warehousing")),
        "technology_content": ("Technology & Content", ("technologycontent", "technology & content", "content technology")),
        "restructuring": ("Restructuring", ("restructuring", "realignment", "integration", "transformation", "reorganization")),
        "impairment": ("Impairment", ("impairment", "creditimpairment", "assetimpairment", "creditimpairmentloss", "assetimpairmentloss", "writeoff", "writedown")),
        "other_opex": ("Other opex", ("otheropex", "other opex", "other operating expenses")),
    },
}

# Fixed values. Words inside a label that speak for a category.
KEYWORDS = {
    "cost": {
        "products": ("hardware", "device", "equipment", "handset", "merchandise", "materials", "manufacturing", "productcost"),
        "services": ("service", "subscription", "cloud", "content", "platform", "support", "deliveryservice"),
        "traffic_acquisition_cost": ("trafficacquisition", "distributionpartner", "partnerfees", "contentacquisition"),
    },
    "opex": {
        "sales_marketing": ("salesanddistribution", "sellinganddistribution", "customeracquisition", "advertising", "promotion", "brandmarketing", "commercial"),
        "general_administrative": ("generalcorporate", "corporateoverhead", "sharedservices", "backoffice", "officeexpense", "administration"),
        "rnd": ("research", "development", "engineering", "productdevelopment", "technologydevelopment"),
        "taxes_surcharges": ("taxesandlevies", "surcharges", "levies"),
        "finance_expense": ("financecost", "interestexpense", "borrowingcost", "netinterest", "interestandotherexpense"),
        "fulfillment": ("shipping", "delivery", "logistics", "warehousing", "distributioncenter"),
        "restructuring": ("restructuring", "realignment", "integration", "reorganization", "transformation"),
        "impairment": ("impairment", "creditloss", "assetwriteoff", "writedown"),
    },
}

# Fixed values. A label that holds one of these is a total, not an item.
TOTALS = ("total", "subtotal", "operatingincome", "pretaxincome", "incomebeforetax", "netincome", "earningspershare", "dilutedeps", "basiceps", "dividendsdeclared", "weightedaverage", "sharesoutstanding")


def label_key(label: Column) -> Column:
    """Lower case, letters a-z, digits and CJK signs alone."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), "[^0-9a-z一-鿿]+", "")


def member_key(label: Column) -> Column:
    """label_key without a trailing 'member', then without a trailing 'segment'."""
    return F.regexp_replace(F.regexp_replace(label_key(label), "member$", ""), "segment$", "")


def _key(text: str) -> str:
    return "".join(c for c in text.strip().lower() if c in "0123456789abcdefghijklmnopqrstuvwxyz" or "一" <= c <= "鿿")


def reject_totals(items: DataFrame, *texts: str) -> DataFrame:
    """Items none of whose texts reads like a total."""
    bad = F.lit("|".join(TOTALS))
    total = F.lit(False)
    for t in texts or ("name",):
        total = total | F.regexp_like(label_key(F.col(t)), bad)
    return items.where(~total)


def _aliases(like: DataFrame) -> DataFrame:
    rows = [(kind, _key(alias), i, c) for kind, cats in TAXONOMY.items() for i, (c, (name, aliases)) in enumerate(cats.items()) for alias in dict.fromkeys((*aliases, name)) if _key(alias)]
    return F.broadcast(like.sparkSession.createDataFrame(rows, "kind string, key string, ord int, category string"))


def alias_match(items: DataFrame, name: str = "name") -> DataFrame:
    """(kind, name, category): labels whose key is an alias; the first category in order decides."""
    labels = items.select("kind", F.col(name).alias("name")).distinct().withColumn("key", label_key(F.col("name")))
    return labels.join(_aliases(items), ["kind", "key"]).groupBy("kind", "name").agg(F.min_by("category", "ord").alias("category"))


def keyword_vote(items: DataFrame, name: str = "name", *more: str) -> DataFrame:
    """(kind, name, more…, category, votes): the category with most keywords inside the label and its further texts (names in
    another language, keys, targets), each text counting for itself; ties by category id."""
    texts = ["name", *more]
    rows = [(kind, c, w) for kind, cats in KEYWORDS.items() for c, words in cats.items() for w in words]
    rules = F.broadcast(items.sparkSession.createDataFrame(rows, "rule_kind string, category string, word string"))
    labels = items.select("kind", F.col(name).alias("name"), *more).distinct().withColumns({f"_key{i}": label_key(F.col(c)) for i, c in enumerate(texts)})
    hits = sum((F.contains(f"_key{i}", "word").cast("int") for i in range(len(texts))), F.lit(0))
    found = labels.join(rules, (F.col("kind") == F.col("rule_kind")) & (hits > 0))
    votes = found.groupBy("kind", *texts, "category").agg(F.sum(hits).alias("votes"))
    top = votes.groupBy("kind", *texts).agg(F.min_by(F.struct("category", "votes"), F.struct((-F.col("votes")).alias("v"), "category")).alias("t"))
    return top.select("kind", *texts, "t.*")


def _label_table(items: DataFrame) -> DataFrame:
    """(kind, name, label): one row of each label. `label` is the name as an aggregate's result, so that what is told of it
    is computed here once and no filter on it moves down to the items."""
    return items.groupBy("kind", "name").agg(F.first("name").alias("label"))


def classify(items: DataFrame) -> DataFrame:
    """(kind, name, category): alias, else keyword vote; labels with neither are left out."""
    told = _label_table(items).select("kind", "name", category_of(F.col("kind"), F.col("label")).alias("category"))
    return told.where("category is not null")


def category_of(kind: Column, name: Column) -> Column:
    """The category of a label as one expression over the fixed tables; meant for distinct labels.

    The key is made once and bound as a variable, and the votes are named once, so nothing is computed again."""
    aliases: dict[str, str] = {}
    for k, cats in TAXONOMY.items():
        for c, (title, names) in cats.items():
            for alias in (*names, title):
                if _key(alias):
                    aliases.setdefault(f"{k}:{_key(alias)}", c)
    known = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    # Categories last in order lose ties: the greatest of (votes, place from the end, category) wins.
    ranked = [(k, c, words) for k, cats in KEYWORDS.items() for c, words in sorted(cats.items(), reverse=True)]

    def told(key: Column) -> Column:
        votes = (F.struct(F.when(kind == k, sum((F.contains(key, F.lit(w)).cast("int") for w in words), F.lit(0))).otherwise(0).alias("n"), F.lit(i).alias("place"), F.lit(c).alias("c")) for i, (k, c, words) in enumerate(ranked))
        vote = F.filter(F.array(F.array_max(F.array(*votes))), lambda v: v["n"] > 0)
        return F.coalesce(known[F.concat(kind, F.lit(":"), key)], F.get(vote, F.lit(0))["c"])

    return F.transform(F.array(label_key(name)), told)[0]


def normalize_breakdown(items: DataFrame, keys: tuple[str, ...] = ("company_id", "q_index", "source_id")) -> DataFrame:
    """One row of each category: values of known categories are summed, of unknown labels the greatest stays; totals go.

    Labels are judged once each and joined back; adaptive execution broadcasts them where they are few."""
    labels = _label_table(items)
    labels = reject_totals(labels, "label").withColumn("category", F.coalesce(category_of(F.col("kind"), F.col("label")), F.nullif(member_key(F.col("label")), F.lit(""))))
    labels = labels.where("category is not null").select(F.col("kind").alias("_kind"), F.col("name").alias("_name"), "category")
    known = items.join(labels, F.col("kind").eqNullSafe(F.col("_kind")) & F.col("name").eqNullSafe(F.col("_name")))
    fixed = F.col("category").isin(*(c for cats in TAXONOMY.values() for c in cats))
    return known.groupBy(*keys, "kind", "category").agg(F.when(F.first(fixed), F.sum("value")).otherwise(F.max("value")).cast("decimal(20,2)").alias("value"), F.array_sort(F.collect_set("name")).alias("names"))


def normalize_segments(rows: DataFrame, keys: tuple[str, ...] = ("company_id", "q_index")) -> DataFrame:
    """One row of each member key, the greatest value; on equal values the name first in order."""
    at = rows.withColumn("member_key", member_key(F.coalesce("member_key", "name"))).where("member_key <> '' and value is not null")
    return at.groupBy(*keys, "member_key").agg(F.max("value").alias("value"), F.min_by("name", F.struct(-F.col("value"), "name")).alias("name"))
