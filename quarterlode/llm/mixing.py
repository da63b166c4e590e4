"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document draws a uniform number u from a hash of its id and gets the exponential key -ln(u) / quality; in each
source the documents are taken in key order until the budget of words is used up. A budget above the source's size
takes complete epochs first; only what remains is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterlode.llm.common import WORD, documents, freeze, is_small, packed, salted_join, unpacked

SOURCE_WEIGHTS = (3, 1, 2)  # by place in code point order, repeating
SHARE = 1.5  # of all sizes
MAX_EPOCHS = 2
EDGES = 255  # quantiles of a source's keys that its budget's end is sought between, LEVELS times
LEVELS = 2
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Share of a text's characters, white space aside, that are not ASCII digits or marks; 0.05 at least."""
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    marks = F.length(text) - F.length(F.regexp_replace(text, r"[!-@\[-`{-~]+", ""))
    return F.when(F.coalesce(solid, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), 1.0 - marks / solid))


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of an MD5 that any engine can compute; a null id counts as the empty string."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def fill_targets(stats: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Word budgets of sources: (source, source_size, n) -> the same and target.

    The total is shared by weight; no source gets more than `epochs` times its size and what is left over goes to the
    others by weight. A source stops there if, at the level where it just fills up, all sources together take no more
    than the total; so sorting by cap / weight gives the end of that process at once."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    t = stats.withColumn("_w", w.cast("double")).withColumn("_cap", F.col("source_size") * float(epochs)).withColumn("_total", F.sum("source_size").over(every) * share)
    t = t.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    upto = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_caps", F.sum("_cap").over(upto)).withColumn("_rest", F.sum("_w").over(every) - F.sum("_w").over(upto))
    t = t.withColumn("_full", F.col("_caps") + F.col("_ratio") * F.col("_rest") <= F.col("_total"))
    t = t.withColumn("_taken", F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every)).withColumn("_open", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(every))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise((F.col("_total") - F.col("_taken")) * F.col("_w") / F.when(F.col("_open") > 0, F.col("_open")))
    return t.select("source", "source_size", "n", target.alias("target"))


def sampling_key(doc_id: Column, text: Column, quality: Column | None, seed: int) -> Column:
    return -F.log(uniform(doc_id, seed)) / (text_quality(text) if quality is None else quality)


def _narrowed(rows: DataFrame, salt: Column) -> DataFrame:
    """(source, before, low, high): the keys between two quantiles among which a source's budget ends, and the words before
    them. rows: key, size, rest, and before, the words before all of them."""
    edges = freeze(rows.groupBy("source").agg(F.percentile_approx("key", [(i + 1) / (EDGES + 1) for i in range(EDGES)], 10 * EDGES).alias("edges")))
    rows = salted_join(rows, edges, "source", salt, is_small(edges, "source", most=200))
    jumps = F.array(*(F.lit(1 << s) for s in range(EDGES.bit_length() - 1, -1, -1)))
    bucket = F.aggregate(jumps, F.lit(0), lambda at, jump: F.when(F.get("edges", at + jump - 1) < F.col("key"), at + jump).otherwise(at))
    sums = rows.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"), F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("before", (F.col("before") + F.sum("words").over(order) - F.col("words")).cast("long")).where(F.col("before") <= F.col("rest"))
    cut = ends.groupBy("source").agg(F.max(F.struct("bucket", "before", "low", "high")).alias("c"))
    return freeze(cut.select("source", "c.before", "c.low", "c.high"))


def decide(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", quality: Column | None = None, seed: int = SEED, weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """mix() with the figures behind it: key, whole epochs, whether the sampled epoch takes the row."""
    thin = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), sampling_key(F.col(doc_id), F.col(text), quality, seed).alias("key"))
    thin = freeze(thin)
    stats = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = fill_targets(stats, weights, share, epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = freeze(plan)
    small, salt = is_small(plan, "source"), F.xxhash64("doc_id", "key")
    rows = salted_join(thin, plan, "source", salt, small)
    inside = rows.withColumn("before", F.lit(0).cast("long"))
    for _ in range(LEVELS):
        cut = _narrowed(inside, salt)
        inside = salted_join(rows, cut, "source", salt, small).where("key between low and high")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(order) - F.col("size")
    edge = inside.withColumn("chosen", upto + F.col("size") / 2.0 <= F.col("rest"))
    rest = salted_join(rows, cut, "source", salt, small).where("not key between low and high")
    rows = rest.withColumn("chosen", F.col("key") < F.col("low")).unionByName(edge)
    return rows.withColumn("repeats", (F.col("whole") + F.col("chosen").cast("long")).cast("long"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken, repeats), one for each row of docs.

    Whole documents are taken; the last one of a sampled epoch only if that brings the source nearer to its budget.
    Null text: size 0, taken 0. Null source: a source of its own, last. Repeated rows are separate documents whose keys
    tie; ties go by size. Empty table: empty result. Other columns are ignored.

    Sources may be of any size and their keys of any distribution: words are summed between quantiles of a source's keys,
    twice, so only one of some 65,000 documents, those among which the budget ends, is put in order. Rows of one key stay
    together. Targets are computed over one row of each source, sorted in one task: sources are names, not hosts."""
    return decide(docs, **how).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"), "repeats")


def mixed_documents(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, same columns.

    For each source the last document taken in the sampled epoch is kept; a row is taken if it does not come after it.
    So rows need no identity, and repeated rows that tie at the end of a budget are taken or left together."""
    own = {"text": text, "source": source, "doc_id": doc_id, **how}
    rows = decide(docs, **own)
    last = F.max(F.when(F.col("chosen"), F.struct("key", "_id", "size")))
    ends = freeze(rows.withColumnRenamed("doc_id", "_id").groupBy("source").agg(F.first("whole").alias("_whole"), last.alias("_last")).withColumnRenamed("source", "_source"))
    get = F.col("_in").getField
    body = packed(docs).withColumns({"_source": get(source), "_key": sampling_key(get(doc_id), get(text), how.get("quality"), how.get("seed", SEED)), "_id": get(doc_id), "_size": word_count(get(text))})
    body = salted_join(body, ends, "_source", F.xxhash64("_id"), is_small(ends, "_source"))
    place = F.struct(F.col("_key").alias("key"), F.col("_id"), F.col("_size").alias("size"))
    times = F.col("_whole") + F.coalesce(place <= F.col("_last"), F.lit(False)).cast("long")
    return unpacked(body.withColumn("_times", times).where("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))), docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS solid,
    length(text) - length(regexp_replace(text, '[!-@\[-`{-~]+', '', 'g')) AS marks,
    -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7'), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) AS e
  FROM documents),
k AS (SELECT *, e / (CASE WHEN coalesce(solid, 0) = 0 THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE, 1.0::DOUBLE - marks / solid) END) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM k GROUP BY source),
t AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM s),
f AS (SELECT *, sum(cap) OVER o + ratio * (sum(w) OVER () - sum(w) OVER o) <= total AS full_up FROM t
  WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, CASE WHEN full_up THEN cap ELSE (total - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN full_up THEN 0 ELSE w END) OVER () END AS target FROM f),
h AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM g),
p AS (SELECT k.doc_id, k.size::BIGINT AS size, h.source_size, h.target, h.whole, h.target - h.whole * h.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before
  FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
