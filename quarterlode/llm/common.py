"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only if it has at most this many rows and bytes of strings.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 4_000_000
BROADCAST_IDS = 400_000  # of single numbers


def freeze(df: DataFrame) -> DataFrame:
    """Cuts the lineage: a reliable checkpoint in the folder that spark.checkpoint.dir names.

    Nothing needs the shuffle files of a frozen step any more, so Spark is told to drop them when a query ends.

    A folder of its own is made only where the session names none (tests on one machine)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return df.checkpoint(eager=True)


BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the rows of the session's Arrow batches: texts are long, and a worker holds a whole batch."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if int(conf.get(name)) not in range(1, BATCH_ROWS + 1):
        conf.set(name, str(BATCH_ROWS))
    return df


def packed(df: DataFrame) -> DataFrame:
    """df as one struct column `_in`, so that no column of its own can clash with an operator's."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_in"))


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of `_in` by name, those in `new` replaced or added."""
    kept = [new.get(c, F.col("_in").getField(c)).alias(c) for c in columns]
    return df.select(*kept, *(v.alias(c) for c, v in new.items() if c not in columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def is_small(df: DataFrame, text: str | None = None, most: int = BROADCAST_ROWS) -> bool:
    """Whether df is proven to be within the broadcast bound (`most` rows); reads one row more than the bound at most."""
    part = df.limit(most + 1)
    size = F.sum(F.octet_length(F.coalesce(F.col(text), F.lit("")))) if text else F.lit(0)
    rows, size = part.agg(F.count(F.lit(1)), size).first()
    return rows <= most and (size or 0) <= BROADCAST_BYTES


def salted_join(big: DataFrame, side: DataFrame, key: str, salt: Column, small: bool, how: str = "inner", salts: int = 32) -> DataFrame:
    """Null-safe join of a skewed table with one that has each key once.

    Proven small, the side is broadcast. Otherwise a hot key of `big` is spread over `salts` partitions and `side` is repeated for each of them."""
    side = side.withColumnRenamed(key, "_joined_key")
    if small:
        return big.join(F.broadcast(side), F.col(key).eqNullSafe(F.col("_joined_key")), how).drop("_joined_key")
    big = big.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    side = side.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(side, F.col(key).eqNullSafe(F.col("_joined_key")) & (F.col("_salt") == F.col("_salt2")), how).drop("_joined_key", "_salt", "_salt2")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (a, b): rows (node, component), component = smallest node.

    Alternating large-star and small-star steps until every node hangs on one root; only nodes with an edge are
    returned. Every step is joins and pre-aggregated minima, and each round is checkpointed; nothing but whether a round
    was the last comes to the driver."""
    now = freeze(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_stars(now):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, F.col("a") == F.col("n")).select("a", "b", "m")
        now = freeze(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _is_stars(edges: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return ends.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c > 0 and p > 0)").isEmpty()


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, component) after more edges (a, b): components are joined as wholes, so few rounds are needed."""

    def root(name: str) -> DataFrame:
        return labels.select(F.col("node").alias(name), F.col("component").alias(f"_{name}"))

    ends = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select("a", "b", F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
    ends = freeze(ends)
    over = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("component", "top")
    fresh = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("component")), F.struct(F.col("b").alias("node"), F.col("y").alias("component")))).alias("e")).select("e.*")
    every = labels.unionByName(fresh).distinct()
    return freeze(every.join(over, every["component"] == over["node"], "left").select(every["node"], F.coalesce("top", "component").alias("component")))
