"""Near-duplicate embeddings by a forest of random-projection trees.

Every tree splits its nodes again and again on random projections, where few rows stand; in its first SPILL_LEVELS levels
rows nearer to the split than a share of the distance that linked rows may have go to both sides (spill overlap), below
these every row goes to one side, until a node is a leaf. So a row has a bounded number of copies in a tree, and larger
tables get more trees instead. A node too
tight to be parted that way (a dense group) stays a leaf of any size, compared in blocks: no group is cut through again
and again. Rows that share a leaf in any tree are compared exactly, in double precision. A pair is counted only in the
first leaf that it shares, which each row's list of leaves tells, so no pair ever leaves its task: leaves give counts of
links by row and a spanning set of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlode.llm.common import components, freeze

TREES = 4  # at least; see trees_for
SPILL_LEVELS = 4
KEPT_SPILLED, KEPT_HARD = 0.98, 0.856  # shares of pairs at the threshold that a split leaves together, with and without overlap
MISSED = 0.03  # of such pairs by all trees
LEAF_ROWS = 4_000
CHUNK = 500  # rows of a leaf that are compared with all of it at once
SPARSE_PAIRS = 200_000
SPILL = 0.08  # of a node's rows at least, on either side of a split
REACH = 0.67  # of the largest distance of linked unit vectors, on either side of a split at least
SIDE, WORK = 0.75, 0.9  # a split is made if no side keeps more of the rows, nor both more of the comparisons
AXES = 3  # looked at for each split; a node that none of them can part stays a leaf
THRESHOLD = 0.9


def _is_usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def project(nodes: DataFrame, trees: int, depth: int, count: int, seed: int) -> DataFrame:
    """(node, v) -> (node, tree, p): projections of unit vectors for the levels depth .. depth + count - 1 of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("node"), batch.column("v").to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            for size, rows in by_size.items():  # vectors of unlike sizes never link
                x = unit(np.array([vectors[i] for i in rows], np.float64))
                axes = [np.random.default_rng([seed, size, t, depth]).standard_normal((size, count)) for t in range(trees)]
                own = ids.take(pa.array(rows))
                for t, a in enumerate(axes):
                    yield pa.RecordBatch.from_arrays([own, pa.array([t] * len(rows), pa.int32()), pa.array([size] * len(rows), pa.int64()), pa.array(list((x @ a).astype(np.float32)), pa.list_(pa.float32()))], names=["node", "tree", "size", "p"])

    return nodes.select("node", "v").mapInArrow(run, "node long, tree int, size long, p array<float>")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cuts(q: Column, spill: float, reach: float) -> Column:
    """The best split (low, high, at) of a node by its quantiles in twentieths; null if none makes it smaller.

    Rows up to `high` go to one side, rows from `low` to the other. Best: the fewest rows go to both. A hard split is at
    `at`, and only made where this one can be."""

    def split(i: Column) -> Column:
        at = F.get(q, i)
        low, high = at - reach, at + reach
        beyond = lambda k: F.get(q, F.least(F.greatest(i + k, F.lit(0)), F.size(q) - 1))
        steps = math.ceil(spill * 20)
        low, high = F.least(low, beyond(-steps)), F.greatest(high, beyond(steps))
        # Rows up to the n-th quantile are n twentieths; what lies between two quantiles counts in full.
        left, right = (F.size(F.filter(q, lambda y: y <= high)) + 1) / 20.0, (F.size(F.filter(q, lambda y: y >= low)) + 1) / 20.0
        return F.struct((left + right).alias("both"), F.greatest(left, right).alias("side"), (left * left + right * right).alias("work"), low.alias("low"), high.alias("high"), at.alias("at"))

    tried = F.transform(F.sequence(F.lit(3), F.lit(15)), split)
    return F.array_min(F.filter(tried, lambda s: (s["side"] <= SIDE + 1e-9) & (s["work"] <= WORK)))


def trees_for(rows: int, leaf_rows: int) -> int:
    """How many trees leave MISSED of the pairs at the threshold unfound: the more levels split hard, the more."""
    at, levels = rows, 0.0
    for _ in range(SPILL_LEVELS):
        if at > leaf_rows:
            at, levels = at * 0.62, levels + 1
    kept = KEPT_SPILLED**levels * KEPT_HARD ** max(0.0, math.log2(max(at, 1) / leaf_rows))
    return max(TREES, math.ceil(math.log(MISSED) / math.log(max(1 - kept, 1e-9))))


def grow(nodes: DataFrame, *, trees: int = TREES, leaf_rows: int = LEAF_ROWS, spill: float = SPILL, threshold: float = THRESHOLD, seed: int = 5, levels: int = 6) -> DataFrame:
    """(node, v) -> (node, leaf, rows): the leaves of all trees that each row is in, with their numbers of rows.

    All trees split one level at a time: the quantiles of every open node on AXES axes are aggregated by Spark, no node is
    gathered. A node that no split on these would make smaller (a dense group, many rows on one point) stays a leaf."""
    width = levels * AXES
    open_ = freeze(project(nodes, trees, 0, width, seed).withColumn("leaf", F.xxhash64("size", "tree")))
    done, depth = None, 0
    shares, reach = [i / 20 for i in range(1, 20)], REACH * math.sqrt(max(0.0, 2 - 2 * threshold))
    while True:
        stats = open_.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), *(F.percentile_approx(F.element_at("p", i + 1), shares, 2000).alias(f"q{i}") for i in range(AXES)))
        best = F.array(*(cuts(F.col(f"q{i}"), spill, reach).alias(f"c{i}") for i in range(AXES)))
        best = F.transform(best, lambda c, i: F.when(c.isNotNull(), F.struct(c["both"].alias("both"), i.alias("axis"), c["low"].alias("low"), c["high"].alias("high"), c["at"].alias("at"))))
        stats = stats.withColumn("cut", F.when(F.col("rows") > leaf_rows, F.array_min(best)))
        stats = freeze(stats.select("leaf", "rows", "cut.axis", "cut.low", "cut.high", "cut.at", F.col("cut").isNotNull().alias("open")))
        here = open_.join(stats, "leaf")
        leaves = here.where("not open").select("node", "leaf", "rows")
        done = leaves if done is None else done.unionByName(leaves)
        if stats.where("open").isEmpty():
            return done
        x = F.element_at("p", F.col("axis") + 1)
        left, right = (x <= F.col("high"), x >= F.col("low")) if depth < SPILL_LEVELS else (x <= F.col("at"), x > F.col("at"))
        sides = F.array(F.when(left, F.xxhash64("leaf", F.lit(0))), F.when(right, F.xxhash64("leaf", F.lit(1))))
        split = here.where("open").withColumn("leaf", F.explode(F.array_compact(sides))).drop("rows", "axis", "low", "high", "at", "open").withColumn("p", F.slice("p", AXES + 1, width))
        depth += 1
        if depth % levels == 0:  # new random directions for the next levels
            split = split.drop("p").join(project(nodes, trees, depth * AXES, width, seed).drop("size"), ["node", "tree"])
        open_ = freeze(split)


def seen_before(one: np.ndarray, two: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """Whether the rows of each pair share one of the leaves that come before this one."""
    sets: dict[int, frozenset] = {}
    for i in np.unique(np.r_[one, two]).tolist():
        sets[i] = frozenset(before[i].tolist())
    return np.array([not sets[i].isdisjoint(sets[j]) for i, j in zip(one.tolist(), two.tolist(), strict=True)], bool)


def compare(batch: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links inside one leaf (or one pair of its blocks) of rows that share no leaf of a smaller id.

    Rows are taken CHUNK at a time against all others. Returns the number of linked rows by node, and a link of each
    node to one of its connected group."""
    x, n = unit(np.stack(batch["v"].to_numpy()).astype(np.float64)), len(batch)
    ids, copies, block = batch["node"].to_numpy(), batch["copies"].to_numpy(), batch["block"].to_numpy()
    before = [np.asarray(r) for r in batch["before"]]
    apart = batch["one"].iloc[0] != batch["two"].iloc[0]
    column = None
    links, label = np.zeros(n, np.int64), np.arange(n)
    for at in range(0, n, CHUNK):
        linked = x[at : at + CHUNK] @ x.T >= threshold
        linked[np.arange(len(linked)), np.arange(at, at + len(linked))] = False
        if apart:
            linked &= block[at : at + CHUNK, None] != block[None, :]
        one, two = np.nonzero(linked)
        if len(one) > SPARSE_PAIRS:  # a dense group: its rows share few leaves
            if column is None:
                flat = np.concatenate(before)
                owner = np.repeat(np.arange(n), [len(b) for b in before])
                _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
                column, owner = column[times[column] > 1], owner[times[column] > 1]
                _, column = np.unique(column, return_inverse=True)
            for low in range(0, int(column.max()) + 1 if len(column) else 0, 4_096):
                here = (column >= low) & (column < low + 4_096)
                member = np.zeros((n, 4_096), np.float32)
                member[owner[here], column[here] - low] = 1
                linked &= member[at : at + CHUNK] @ member.T == 0
            one, two = np.nonzero(linked)
        elif len(one):
            fresh = ~seen_before(one + at, two, before)
            one, two = one[fresh], two[fresh]
        one = one + at
        np.add.at(links, one, copies[two])
        while len(one):  # the smallest label of a connected group, over the links of this chunk
            least = label.copy()
            np.minimum.at(least, one, label[two])
            np.minimum.at(least, two, label[one])
            least = least[least]
            if (least == label).all():
                break
            label = least
    some = np.flatnonzero(links)
    return pd.DataFrame({"node": ids[some], "links": links[some], "other": ids[label[some]]})


def near_duplicates(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, trees: int | None = None, leaf_rows: int = LEAF_ROWS, spill: float = SPILL, seed: int = 5) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of df.

    Linked: cosine >= threshold in double precision; no pair below it is linked, a pair above it is missed only if all
    trees part it (trees: None means as many as trees_for says). Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    unlike sizes do not link. Rows of one direction (to 12 places; repeated rows, scaled copies) are one node, all
    linked with each other and never expanded into pairs. component_id: the smallest vec_id reachable; a null vec_id
    counts for nothing in it. Empty table: empty result; other columns are ignored."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    good = rows.where(_is_usable(F.col("v")))  # components keep their type: floats are half the bytes, and exact in double
    top = F.aggregate("v", F.lit(0.0), lambda a, y: F.greatest(a, F.abs(y.cast("double"))))
    good = good.withColumn("_m", top).withColumn("_s", F.transform("v", lambda y: y.cast("double") / F.col("_m")))
    good = good.withColumn("_n", F.sqrt(F.aggregate("_s", F.lit(0.0), lambda a, y: a + y * y)))
    good = freeze(good.select("vec_id", "v", F.xxhash64(F.transform("_s", lambda y: F.round(y / F.col("_n"), 12) + 0.0)).alias("node")))
    nodes = freeze(good.groupBy("node").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id")))
    leaves = grow(nodes, trees=trees or trees_for(nodes.count(), leaf_rows), leaf_rows=leaf_rows, spill=spill, threshold=threshold, seed=seed)
    mine = leaves.groupBy("node").agg(F.collect_set(F.struct("leaf", "rows")).alias("l"))
    # Rows alone in a leaf need not go there. Each row takes along only the leaves before the one it goes to.
    placed = nodes.join(mine, "node").select("node", "v", "copies", "l", F.explode("l").alias("leaf")).where("leaf.rows > 1")
    blocks = F.ceil(F.col("leaf.rows") / F.lit(float(leaf_rows))).cast("int")
    earlier = F.transform(F.filter("l", lambda y: (y["leaf"] < F.col("leaf.leaf")) & (y["rows"] > 1)), lambda y: y["leaf"])
    placed = placed.select("node", "v", "copies", earlier.alias("before"), F.col("leaf.leaf").alias("leaf"), blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "v", "copies", "before", "leaf", "block", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"))
    found = freeze(placed.groupBy("leaf", "one", "two").applyInPandas(lambda batch: compare(batch, threshold), "node long, links long, other long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    full = nodes.select("node", "copies", "least_id").join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = full.groupBy("component").agg(F.min("least_id").alias("component_id"))
    full = full.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    linked = good.select("vec_id", "node").join(full, "node").select("vec_id", "n_links", "component_id")
    ok = F.coalesce(_is_usable(F.col("v")), F.lit(False))
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
r AS (SELECT vec_id AS v, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = v.vec_id
"""
