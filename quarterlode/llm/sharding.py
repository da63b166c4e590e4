"""Sharding by a hierarchical weighted hash tree: a document descends region, rack and shard by weighted hash draws.

At each level every child draws ln(u) / weight, u from a hash of the document's id and the child's name, and the child
with the greatest draw is taken. A child's draw depends on nothing but its own weight, so a change of weights moves
documents only into or out of the subtree that changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterlode.llm.common import documents, freeze

ROWS_PER_CHUNK = 5_000
BASE_SHARDS = 16


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, base: int = BASE_SHARDS, racks: int = 2, per_rack: int = 4) -> tuple[Leaf, ...]:
    """Equal shards: the first `base` fill racks and regions in order, each further one is a region of its own.

    So the step from n to n + 1 (n >= base) changes no weight of an older subtree and moves documents only into the new shard."""
    first = [Leaf(i // (racks * per_rack), i // per_rack, i) for i in range(min(shards, base))]
    return tuple(first + [Leaf(1_000_000 + i, 1_000_000 + i, i) for i in range(base, shards)])


def descend(doc_id: Column, leaves: tuple[Leaf, ...], seed: int = 11) -> Column:
    """The shard of a document; a null id draws as a value of its own."""

    def pick(options: list[tuple[str, float, Column]]) -> Column:
        live = [x for x in options if x[1] > 0]
        if len(live) == 1:
            return live[0][2]
        hashed = [((F.xxhash64(doc_id, F.lit(f"{seed}:{name}")).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / float(1 << 52), weight, made) for name, weight, made in live]
        return F.array_max(F.array(*(F.struct((F.log(u) / F.lit(weight)).alias("draw"), made.alias("to")) for u, weight, made in hashed)))["to"]

    def below(path: str, part: list[Leaf], levels: tuple[str, ...]) -> Column:
        if not levels:
            return F.lit(part[0].shard)
        groups: dict[int, list[Leaf]] = {}
        for leaf in part:
            groups.setdefault(getattr(leaf, levels[0]), []).append(leaf)
        return pick([(f"{path}/{levels[0]}{k}", sum(x.weight for x in g), below(f"{path}/{levels[0]}{k}", g, levels[1:])) for k, g in groups.items()])

    return below("", list(leaves), ("region", "rack", "shard"))


def shard(docs: DataFrame, leaves: tuple[Leaf, ...], *, grown: tuple[Leaf, ...] | None = None, doc_id: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot, grown_shard), one for each row of docs.

    Null text: size 1, CRC of nothing (0). Rows with the same id share a shard. Slots follow the chunk and hash of id
    and CRC, then id, CRC and size; rows equal in these are alike. Empty table: empty result. Other columns are ignored.

    A shard may hold any share of the rows: rows are numbered in chunks by hash, offset by the chunks before."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    thin = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    thin = freeze(thin.withColumns({"shard": descend(F.col("doc_id"), leaves, seed), "grown_shard": descend(F.col("doc_id"), grown, seed) if grown else F.lit(None).cast("int"), "_h": F.xxhash64("doc_id", "text_crc32", F.lit(seed))}))
    chunks = max(1, thin.count() // (ROWS_PER_CHUNK * max(1, len(leaves))))
    thin = thin.withColumn("_chunk", F.pmod("_h", F.lit(chunks)))
    counts = thin.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select(F.col("shard").alias("_s"), F.col("_chunk").alias("_c"), (F.sum("_n").over(upto) - F.col("_n")).alias("_start"))
    rows = thin.withColumn("_in", F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("_h", "doc_id", "text_crc32", "size")) - 1)
    rows = rows.join(starts, (F.col("shard") == F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_in")).cast("long").alias("slot"), "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), tree(BASE_SHARDS), grown=tree(BASE_SHARDS + 1)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
