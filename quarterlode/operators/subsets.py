"""The labelled rows of a quarter that together explain its revenue best."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterlode.operators.history import QUARTER
from quarterlode.operators.phases import bound, once, thousandths
from quarterlode.operators.segments import AGGREGATE_NAMES, AGGREGATES, normal_label
from quarterlode.operators.taxonomy import label_key

MOST_CANDIDATES, MOST_ROWS = 12, 7
# Fixed values. Words of a label that say nothing about its subject.
WORD_STOP = ("and", "before", "business", "businesses", "centers", "company", "corporate", "corporation", "group", "groups", "holding", "holdings", "inc", "limited", "llc", "ltd", "operating", "other", "reportable", "retailing", "segment", "segments", "services", "the")
# Fixed values. What labels cost that read like sums or remainders.
PENALTIES = (("aggregation|reportable|consolidated", 220), ("before other operating", 200), ("all other segments", 32), ("corporate .* other|other .* corporate", 18))
AGGREGATE_PENALTY, OVERLAP_PENALTY = 110, 28


def words_of(label: Column) -> Column:
    words = F.split(F.replace(F.lower(F.coalesce(label, F.lit(""))), F.lit("&"), F.lit(" ")), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*WORD_STOP)))


def label_penalty(label: Column) -> Column:
    aggregate = lambda n: n.isin(*AGGREGATE_NAMES) | F.regexp_like(n, F.lit("|".join(AGGREGATES)))
    cost = lambda n: sum((F.when(F.regexp_like(n, F.lit(p)), cost).otherwise(0) for p, cost in PENALTIES), F.when(aggregate(n), AGGREGATE_PENALTY).otherwise(0))
    return bound(normal_label(F.coalesce(label, F.lit(""))), cost)


def _search(most_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function that puts the best subset's bits, 0 if none fits, null where v is, for the columns v, cost, bits, shared, revenue, need.

    v, cost, bits of targets: arrays by item; shared: cost of words that an item shares with each earlier one, items in a row.
    Subsets are columns of numpy arrays, by the item they begin to hold last: those without the item, then the same with it, so
    a subset's place is its bits. Rows with as many items go together, at most 64 at a time (2 MB an array of 4,096 subsets).
    The function is nested, so that tasks need not find this module."""

    def best_of(v, cost, bits, shared, revenue, need):
        q, n = v.shape
        sums, costs, held, size, k = np.zeros((q, 1), np.int64), np.zeros((q, 1), np.int64), np.zeros((q, 1), np.int64), np.zeros(1, np.int64), 0
        for i in range(n):
            more = cost[:, i : i + 1]
            for j in range(i):
                more = np.concatenate([more, more + shared[:, k + j, None]], 1)
            k += i
            sums, costs = np.concatenate([sums, sums + v[:, i, None]], 1), np.concatenate([costs, costs + more], 1)
            held, size = np.concatenate([held, held | bits[:, i, None]], 1), np.concatenate([size, size + 1])
        at = np.flatnonzero((size <= most_rows) & ((size > 1) | (n == 1)) & (size > 0))
        sums, costs, held, size = sums[:, at], costs[:, at], held[:, at], size[at]
        reward = np.where((size >= 3) & (size <= 6), 44, 0)
        counts = np.where(size > 5, (size - 5) * 18, np.where((size < 3) & (n > 3), (3 - size) * 40, 0))
        part = sums / revenue[:, None]
        cover = np.maximum(0.78 - part, 0.0) * 260 + np.maximum(part - 1.08, 0.0) * 360
        fits = (part >= 0.45) & (part <= 1.35) & ((held & need[:, None]) == need[:, None])
        score = np.where(fits, reward - np.abs(sums - revenue[:, None]).astype(float) / 1000 * 110 - counts - cover - costs, -np.inf)
        # What comes before the first best score is outdone by it; behind it only a smaller subset with a score nearer than 0.01 can win,
        # and from there a better or smaller one again.
        best, place = score.argmax(1), np.arange(len(size))
        near = (np.abs(score - np.where(fits.any(1), score.max(1), 0.0)[:, None]) < 0.01) & (size < size[best][:, None]) & (place > best[:, None])
        for r in np.flatnonzero(near.any(1)):
            while True:
                b = best[r]
                later = (place > b) & ((score[r] > score[r, b]) | ((np.abs(score[r] - score[r, b]) < 0.01) & (size < size[b])))
                if not later.any():
                    break
                best[r] = later.argmax()
        return np.where(fits.any(1), at[best], 0)

    def search(v: pa.Array, cost: pa.Array, bits: pa.Array, shared: pa.Array, revenue: pa.Array, need: pa.Array) -> pa.Array:
        lengths = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        pairs = lengths * (lengths - 1) // 2
        starts, pair_starts = np.cumsum(lengths) - lengths, np.cumsum(pairs) - pairs
        v_, cost_, bits_, shared_ = (x.flatten().to_numpy(zero_copy_only=False) for x in (v, cost, bits, shared))
        revenue_, need_ = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (revenue, need))
        out = np.zeros(len(lengths), np.int32)
        for n in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == n)
            for at in (rows[i : i + 64] for i in range(0, len(rows), 64)):
                own, other = starts[at, None] + np.arange(n), pair_starts[at, None] + np.arange(n * (n - 1) // 2)
                out[at] = best_of(v_[own], cost_[own], bits_[own], shared_[other], revenue_[at], need_[at])
        return pa.array(out, mask=lengths == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = ("_v", "_cost", "_bits", "_shared", "_revenue", "_need")
        for batch in batches:
            rest = batch.drop_columns(list(given))
            yield pa.RecordBatch.from_arrays([*rest.columns, search(*(batch.column(c) for c in given))], names=[*rest.schema.names, "_mask"])

    return run


def best_subset(rows: DataFrame, quarters: DataFrame, targets: DataFrame) -> DataFrame:
    """(company_id, q_index, name, member_key, value, how) of the rows kept of each quarter.

    rows: name, member_key, value of candidates (pruned labels); the MOST_CANDIDATES largest above 0.02 are looked at.
    quarters: revenue, styled (the company has a layout of its own), company_name (its words count for nothing).
    targets: (company_id, q_index, target), members that details hang on; they must stay.

    All are kept ('all') where their sum fits: a styled company, three to six rows, or a complete hierarchy. Else the
    subset of at most MOST_ROWS with the best score is taken ('subset'): off by how far its sum is from revenue, how many rows
    it has, its coverage, and labels that read like sums or share words; of scores nearer than 0.01 the smaller subset
    wins over one met before. Where none is within 45 to 135 % of revenue the MOST_ROWS largest stay ('largest'). Quarters
    without revenue keep all. Subsets, at most 4,096 of a quarter, are searched by numpy over batches of quarters."""
    wanted = targets.groupBy(*QUARTER).agg(F.collect_set(label_key(F.col("target"))).alias("targets"))
    item = F.struct((-F.col("value")).alias("o"), "name", "member_key", thousandths(F.col("value")).alias("v"), "value")
    per = rows.where(F.col("value") > F.lit("0.02").cast("decimal(10,4)")).groupBy(*QUARTER).agg(F.slice(F.array_sort(F.collect_list(item)), 1, MOST_CANDIDATES).alias("items"))
    at = per.join(quarters.select(*QUARTER, thousandths(F.col("revenue")).alias("revenue"), "styled", "company_name"), list(QUARTER), "left").join(wanted, list(QUARTER), "left")
    at = at.withColumn("targets", F.array_remove(F.coalesce("targets", F.array().cast("array<string>")), ""))
    # Targets are bits: those that an item holds, those that a subset must.
    bit = lambda t, k: F.pow(F.lit(2), k).cast("long")
    keys = lambda x: F.array(label_key(F.coalesce(x["member_key"], x["name"])), label_key(x["name"]))
    bits = lambda x: F.aggregate(F.array_intersect(keys(x), F.col("targets")), F.lit(0).cast("long"), lambda a, k: a + bit(k, F.array_position("targets", k) - 1))
    total = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["v"])
    at = once(at, _own=words_of(F.col("company_name")), _bits=F.transform("items", lambda x: F.when(F.size("targets") > 0, bits(x)).otherwise(0)), _ratio=total.cast("double") / F.when(F.col("revenue") > 0, F.col("revenue")).cast("double"))
    n, ratio, required = F.size("items"), F.col("_ratio"), F.size(F.filter("_bits", lambda x: x > 0))
    whole = ((required > 0) & (required == F.size("targets")) & (n <= MOST_ROWS) & ratio.between(0.72, 1.18)) | (F.col("styled") & ratio.between(0.78, 1.18)) | (n.between(3, 6) & ratio.between(0.88, 1.18))
    at = once(at, _every=(F.coalesce("revenue", F.lit(0)) <= 0) | F.coalesce(whole, F.lit(False)), _need=F.when(required > 0, F.pow(F.lit(2), F.size("targets")).cast("long") - 1).otherwise(0))
    # No subset fits where all rows together fall short.
    sought = ~F.col("_every") & (ratio >= 0.45)
    words = lambda x: F.array_except(words_of(x["name"]), F.col("_own"))
    at = once(at, _sought=F.when(sought, F.transform("items", lambda x: F.struct(x["v"].alias("v"), label_penalty(x["name"]).cast("long").alias("cost"), words(x).alias("words")))))
    shared = F.flatten(F.transform("_sought", lambda x, i: F.transform(F.slice("_sought", 1, i), lambda y: F.size(F.array_intersect(x["words"], y["words"])).cast("long") * OVERLAP_PENALTY)))
    given = {"_v": F.transform("_sought", lambda x: x["v"]), "_cost": F.transform("_sought", lambda x: x["cost"]), "_bits": F.when(F.col("_sought").isNotNull(), F.col("_bits")), "_shared": shared, "_revenue": F.col("revenue"), "_need": F.col("_need")}
    kept = at.select(*QUARTER, "items", "_every")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    at = at.select(*kept.columns, *(c.alias(k) for k, c in given.items())).mapInArrow(_search(MOST_ROWS), f"{schema}, _mask int")
    how = F.when(F.col("_every"), "all").when(F.col("_mask") > 0, "subset").otherwise("largest")
    kept = F.when(F.col("_every"), F.col("items")).when(F.col("_mask") > 0, F.filter("items", lambda x, i: F.bit_get(F.col("_mask"), i) == 1)).otherwise(F.slice("items", 1, MOST_ROWS))
    return at.select(*QUARTER, how.alias("how"), F.explode(kept).alias("x")).select(*QUARTER, "x.name", "x.member_key", "x.value", "how")
