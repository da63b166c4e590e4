"""Exact Jaccard join of word shingle sets in their metric space.

Distances between texts are exactly 1 but for near copies and shared passages, so pivots drawn from the documents would
leave nearly all of them in one region. The pivots here are therefore small sets of shingles: the shingle space is cut
by hash into parts, and what a set holds of a part is a pivot. Sets within distance 1 - t differ in at most D members, by
the triangle inequality with either one's subsets, so they agree on all filled parts but D: of the regions of its t
pivots, rarest first, a set needs to be in D + 1 only. Pivots that no other set has fill these places first, and most
sets need no region at all; common passages come last. Sets near a size boundary are replicated into both size classes.

In every region one document is the pivot of the next step: the exact distance of the others to it is taken, those
within the threshold are linked to it. Regions that meet and then still hold several components are compared in blocks
of bounded size, those outside the triangle inequality's window of sizes (distances to the empty set) left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterlode.llm.common import BROADCAST_IDS, components, documents, freeze, is_small, joined_components, packed, small_batches, unpacked
from quarterlode.llm.shingles import U, mixed, shingle_sets, text_slices, words

SMALL_SET = 32  # classes up to it take every member as a part of its own, so that none of their sets is weak
MEDIUM_SET = 192  # classes up to it get a quarter more parts, up to half of SMALL_SET more
PIVOTS = 8  # of the main component of a region that is in several parts
BLOCK_ROWS, BLOCK_MEMBERS = 300, 500_000  # of a block, whichever is less: a task holds two blocks
MARGIN = 1.15
SAMPLE_SETS, HOT_TIMES = 5_000, 10  # keys found so often in a sample of sets are dealt to SALTS tasks; results do not depend on it
SALTS = 64
SKETCH = 64
LEVELS = 64
MASK = 0xFFFFFFFFFFFFFFFF ^ (LEVELS - 1)


def most_different(n: int, percent: int) -> int:
    """How many members may be in one of two linked sets alone, if one of the sets has n."""
    return n * (100 - percent) // percent


def least_of(level: int) -> int:
    """The smallest set of a size class; classes grow by the square root of two."""
    return math.ceil(2 ** (level / 2))


@lru_cache(maxsize=1000)
def parts_of(level: int, percent: int) -> int:
    """Into how many parts the space is cut for the sets of a size class.

    Sets of r members a part fill (1 - e^-r) / r parts for each member; that must stay MARGIN times above the
    share of members that may differ."""
    need, r, top = MARGIN * (100 - percent) / percent, 8.0, least_of(level + 1)
    while r > 0.25 and -math.expm1(-r) / r < need:
        r -= 0.01
    return math.ceil(top / r * (1.6 if top <= 2 * SMALL_SET else 1.25 if top <= MEDIUM_SET else 1))


def region_keys(s: np.ndarray, percent: int) -> tuple[list[np.ndarray], bool]:
    """Keys of the regions of a set by size class, and whether it has too few filled parts to be found by them for certain."""
    n, keys, weak = len(s), [], False
    at, allowed = int(2 * math.log2(n) + 1e-9), most_different(n, percent)
    while not keys or 100 * n >= percent * least_of(at):  # classes of all sets that may be linked with it
        h = mixed(s, 1000 + at)
        if least_of(at + 1) <= SMALL_SET:
            found = h
        else:
            part = (h >> U(20)) % U(parts_of(at, percent))
            order = np.argsort(part, kind="stable")
            part, h = part[order], mixed(h[order], 7)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            found = mixed(np.add.reduceat(h, first) ^ mixed(part[first], at))
        weak |= len(found) <= allowed
        keys.append(((found & U(MASK)) | U(at % LEVELS)).view(np.int64))  # the last bits tell the class
        at += 1
    return keys, weak


def _per_set(docs: DataFrame, text: str, size: int, schema: str, row, extra: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """One row for each row of docs: its columns `extra`, then what row(set) gives; once: equal sets only once in a task."""
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<array<long>>": pa.list_(pa.list_(pa.int64())), "boolean": pa.bool_()}
    made = [x.split(" ", 1) for x in schema.split(", ")]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            column = batch.column(text)
            kept = batch.select(list(extra))
            for at, raw, offsets in text_slices(column):
                w, before = words(raw, offsets)
                sets = shingle_sets(w, before, size)
                if once:
                    if len(seen) > 200_000:
                        seen.clear()
                    ids = ((set_id(s), s) for s in sets if len(s))
                    sets = [s for i, s in ids if not (i in seen or seen.add(i))]
                rows = [row(s) for s in sets]
                if not rows:
                    continue
                part = kept.slice(at, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), made, strict=True))], names=[*part.schema.names, *(n for n, _ in made)])

    return small_batches(docs).select(*extra, text).mapInArrow(run, ", ".join([*fields, schema]))


def set_id(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(mixed(np.array([mixed(s, 5).sum(dtype=U) ^ U(len(s) * 0x9E3779B9)]))[0].astype(np.int64)) if len(s) else 0


def sketch(s: np.ndarray) -> list[int]:
    """How many members of a set fall into each of SKETCH parts."""
    return np.bincount((mixed(s, 11) % U(SKETCH)).astype(np.int64), minlength=SKETCH).tolist()


def jaccard_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of those pairs that may be linked, from exact sizes of intersection and union.

    sets: (node, parts, members). Members are joined only where the counts by part leave room for a link."""

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), *(F.col(c).alias(f"_{c}_{name}") for c in columns))

    def enough(both: Column, all_: Column) -> Column:
        return both * 100 >= (all_ - both) * percent

    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    one = pairs.join(side("a", "parts"), "a").join(side("b", "parts"), "b")
    most = total(F.zip_with("_parts_a", "_parts_b", lambda x, y: F.least(x, y)))
    one = one.where(enough(most, total(F.col("_parts_a")) + total(F.col("_parts_b")))).select("a", "b")
    one = one.join(side("a", "members"), "a").join(side("b", "members"), "b")
    both = F.size(F.array_intersect("_members_a", "_members_b")).cast("long")
    return one.select("a", "b", enough(both, F.size("_members_a") + F.size("_members_b")).alias("linked"))


def hot_keys(src: DataFrame, n_rows: int, size: int, percent: int) -> DataFrame | None:
    """(key, hot_times, hot_low) of keys that very many sets hold, from a sample of about SAMPLE_SETS of them.

    Only how rows are dealt to tasks, the order of such keys and the pivot of their regions come from it."""
    share = SAMPLE_SETS / max(1, n_rows)
    some = src.where(F.pmod(F.xxhash64("_print", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    keys = _per_set(some, "_text", size, "node long, keys array<long>", lambda s: (set_id(s), np.concatenate(region_keys(s, percent)[0]) if len(s) else []), once=True)
    keys = keys.select("node", F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hot_low"), F.max("node").alias("high"))
    hot = freeze(keys.where(F.col("n") >= HOT_TIMES).where("hot_low <> high").select("key", (F.col("n") + F.lit(1 << 40)).alias("hot_times"), "hot_low"))
    return hot if is_small(hot) else None


def region_members(src: DataFrame, n_rows: int, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, node, low): the regions that each set must be in, low being the pivot. nodes: (node, n, parts, …).

    A function of its own: what it shuffles can be cleaned up once the table is written."""
    # Keys come from a second scan, so they need no room of their own. A task lays out equal sets once; what copies in
    # other tasks add to the count of a key only changes the order of places, which any function of the key may give.
    rows = _per_set(src, "_text", size, "node long, keys array<array<long>>", lambda s: (set_id(s), region_keys(s, percent)[0] if len(s) else []), once=True)
    rows = rows.select("node", F.explode(F.flatten("keys")).alias("key"))
    hot = hot_keys(src, n_rows, size, percent)
    level = F.col("key").bitwiseAND(F.lit(LEVELS - 1).cast("long"))

    def by_key(df: DataFrame, known: tuple[str, ...]) -> tuple[DataFrame, Window]:
        """df with what is known of hot keys, and a window over keys: rows of hot keys are dealt out by set, so that no
        task gets a hot group; their count and pivot are known already."""
        types = {"hot_times": "long", "hot_low": "long"}
        df = df.join(F.broadcast(hot.select("key", *known)), "key", "left") if hot is not None else df.withColumns({c: F.lit(None).cast(types[c]) for c in known})
        return df, Window.partitionBy("key", F.when(F.col(known[0]).isNotNull(), F.pmod("node", F.lit(SALTS))))

    rows, keyed = by_key(rows, ("hot_times",))
    met = rows.select("node", "key", F.coalesce("hot_times", F.count(F.lit(1)).over(keyed)).alias("times")).where("times > 1")
    mine = met.groupBy("node").agg(F.array_sort(F.collect_set(F.struct(level.cast("int").alias("level"), "times", "key"))).alias("met")).join(nodes, "node")
    first_level = F.floor(F.log2("n") * 2 + 1e-9).cast("int")  # of a set's own classes; they follow each other
    differ = F.floor(F.col("n") * (100 - percent) / F.lit(float(percent)) + 1e-9) + 1

    def placed(parts: Column, i: Column) -> Column:
        own = F.filter("met", lambda m: m["level"] == F.pmod(first_level + i, F.lit(LEVELS)))
        return F.slice(own, F.lit(1), F.greatest(differ - (parts - F.size(own)), F.lit(0)).cast("int"))

    mine = mine.select("node", F.explode(F.flatten(F.transform("parts", placed))).alias("m")).select("node", "m.key")
    mine, keyed = by_key(mine, ("hot_low",))
    low, high = F.coalesce("hot_low", F.min("node").over(keyed)), F.max("node").over(keyed)
    return freeze(mine.withColumn("low", low).withColumn("high", high).where("low <> high or hot_low is not null").select("key", "node", "low"))


def join_components(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, print, n_shingles, set_id, group, component_id), one for each row of docs; print: xxhash64 of its text;
    group: a number of its component, null without shingles (where ids repeat, components may share a component_id).

    Linked: 100 * |intersection| >= percent * |union| of the sets of distinct `size`-word shingles (lower-cased A-Z; with
    fewer words the whole sequence is one shingle). Null texts and texts without words have no shingles and stand alone.
    component_id: the smallest doc_id reachable by links; equal sets (repeated rows, copies) are one node. A null doc_id
    counts for nothing in that minimum. Empty table: empty result; other columns are ignored. Exact up to 64-bit hashes."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")

    def first(s: np.ndarray) -> tuple:
        keys, weak = region_keys(s, percent) if len(s) else ([], False)
        return len(s), set_id(s), [len(k) for k in keys], weak

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).withColumn("_print", F.xxhash64("_text"))
    base = freeze(_per_set(src, "_text", size, "n_shingles long, set_id long, parts array<long>, weak boolean", first, ("doc_id", "_print")))
    filled = base.where("n_shingles > 0")
    nodes = filled.groupBy(F.col("set_id").alias("node")).agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("parts").alias("parts"))
    regions = region_members(src, base.count(), nodes, size, percent)

    star = regions.where("node <> low").select(F.least("low", "node").alias("a"), F.greatest("low", "node").alias("b"))
    weak_pairs = _weak_pairs(src, base, size, percent)
    if weak_pairs is not None:
        star = star.unionByName(weak_pairs)
    star = freeze(star.distinct())

    involved = star.select(F.explode(F.array("a", "b")).alias("node")).unionByName(regions.select("node")).distinct()
    owner = freeze(nodes.join(involved, "node", "left_semi").select(F.col("least_id").alias("doc_id")).distinct())
    owner = F.broadcast(owner) if is_small(owner, most=BROADCAST_IDS) else owner
    sets = _per_set(src.join(owner, src["doc_id"].eqNullSafe(owner["doc_id"]), "left_semi"), "_text", size, "node long, parts array<int>, members array<long>", lambda s: (set_id(s), sketch(s), s.view(np.int64))).where(F.size("members") > 0)
    sets = freeze(sets.dropDuplicates(["node"]))
    known = freeze(jaccard_links(star, sets, percent))
    labels = components(known.where("linked").select("a", "b"))

    # Regions that meet in a document are one. Where one holds several components, the sets outside its main one are
    # first held against PIVOTS sets of that; what is still apart then is compared in blocks in the tasks: sets outside
    # the main component with all others. Blocks are of one size class, and classes too far apart never meet.
    whole = components(star).withColumnRenamed("component", "region")
    owned = parted(whole, nodes, labels)
    pivots = owned.where("main").groupBy("region").agg(F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(PIVOTS)))).alias("p"))
    pairs = owned.where("not main").join(pivots, "region").select("node", F.explode("p").alias("p")).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
    some = owned.select("node").distinct()
    sets = sets.join(F.broadcast(some) if is_small(some, most=BROADCAST_IDS) else some, "node", "left_semi")
    near = freeze(jaccard_links(pairs, sets, percent).where("linked").select("a", "b"))
    if not near.isEmpty():
        labels = joined_components(labels, near)
        owned = parted(whole, nodes, labels)
    left = owned.withColumn("level", F.floor(F.log2("n") * 2 + 1e-9).cast("int"))
    chunks = left.groupBy("region", "main", "level").agg(F.count(F.lit(1)).alias("n")).select("region", "main", "level", F.ceil(F.col("n") / block_rows(F.col("level"))).cast("int").alias("chunks"))
    mine = left.join(chunks, ["region", "main", "level"]).withColumn("block", F.struct("main", "level", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))).drop("chunks")
    reach = math.ceil(2 * math.log2(100 / percent) + 1e-9)
    other = chunks.select("region", F.col("main").alias("main2"), F.col("level").alias("level2"), "chunks")
    pairs = mine.join(other, "region").where((F.abs(F.col("level") - F.col("level2")) <= reach) & ~(F.col("main") & F.col("main2"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("with", F.struct(F.col("main2").alias("main"), F.col("level2").alias("level"), "chunk"))
    pairs = pairs.select("region", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), (F.col("block") == F.col("with")).alias("same"), (F.col("block") < F.col("with")).alias("lower"), "node", "component").join(sets.select("node", "members"), "node")
    more = freeze(pairs.groupBy("region", "one", "two").applyInPandas(lambda batch: compare_block(batch, percent), "a long, b long").distinct())
    if not more.isEmpty():
        labels = joined_components(labels, more)

    member = nodes.join(labels, "node")
    least = member.groupBy("component").agg(F.min("least_id").alias("component_id"))
    member = member.join(least, "component").select("node", "component", F.col("component_id").alias("_joined"))
    alone = nodes.join(member, "node", "left").select(F.col("node"), F.coalesce("component", "node").alias("group"), F.coalesce("_joined", "least_id").alias("_component"))
    out = base.select("doc_id", "_print", "n_shingles", "set_id").join(alone, F.col("set_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("_print").alias("print"), "n_shingles", "set_id", "group", F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id")).alias("component_id"))


def block_rows(level: Column) -> Column:
    """How many sets of a size class make a block: BLOCK_ROWS, of large sets so many that they hold BLOCK_MEMBERS at most."""
    return F.greatest(F.least(F.lit(float(BLOCK_ROWS)), F.floor(BLOCK_MEMBERS / F.pow(F.lit(2.0), (level + 1) / 2))), F.lit(1.0))


def parted(whole: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, n, region, component, main) of the regions that hold several components; main: of the largest one."""
    owned = whole.join(nodes.select("node", "n"), "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = owned.groupBy("region", "component").agg(F.count(F.lit(1)).alias("rows"))
    main = sizes.groupBy("region").agg(F.max_by("component", F.struct("rows", "component")).alias("main_component"), F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"))
    main = main.where("parts > 1 and rows > 2").select("region", "main_component")
    return freeze(owned.join(main, "region").withColumn("main", F.col("component") == F.col("main_component")).drop("main_component"))


def compare_block(batch: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between members of one block (or pair of blocks) that are in different components: for each linked
    member one link to its group."""
    n, members, node = len(batch), batch["members"].to_list(), batch["node"].to_numpy()
    size = np.array([len(m) for m in members])
    _, column, times = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # of the shingles that two members share
    row, keep = np.repeat(np.arange(n), size), times[column] > 1
    row, column = row[keep], place[column[keep]]
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        here = (column >= at) & (column < at + 4096)
        has = np.zeros((n, 4096), np.float32)
        has[row[here], column[here] - at] = 1
        both += has @ has.T
    linked = 100 * both.astype(np.float64) >= percent * (size[:, None] + size[None, :] - both.astype(np.float64))
    component, lower = batch["component"].to_numpy(), batch["lower"].to_numpy()
    linked &= component[:, None] != component[None, :]
    if not batch["same"].iloc[0]:
        linked &= lower[:, None] != lower[None, :]
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(1, initial=n))
        least = least[least]
        if (least == label).all():
            break
        label = least
    some = np.flatnonzero(label != np.arange(n))
    return pd.DataFrame({"a": node[some], "b": node[label[some]]})


def _weak_pairs(src: DataFrame, base: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Pairs of a weak set (too few filled parts; a few tiny sets in a million) with any that shares a shingle with it."""
    weak = base.where("weak")
    low, high = weak.agg(F.min("n_shingles"), F.max("n_shingles")).first()
    if low is None:
        return None
    least, most = low * percent // 100, high * 100 // percent + 1
    rows = _per_set(src, "_text", size, "node long, members array<long>", lambda s: (set_id(s), s.view(np.int64) if least <= len(s) <= most else []), once=True).where(F.size("members") > 0)
    rows = freeze(rows.dropDuplicates(["node"]).select("node", F.explode("members").alias("m")))
    mine = rows.join(weak.select(F.col("set_id").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("w"), "m")
    return rows.join(mine, "m").where("node <> w").select(F.least("node", "w").alias("a"), F.greatest("node", "w").alias("b")).distinct()


def keep_one(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component: the row of the smallest doc_id (null last), then of the smallest
    text hash. Rows are told apart by doc_id and text, so another text of a repeated id is judged for itself.

    Rows without shingles (null or empty text) all stay. Of rows that repeat both id and text one stays. Same columns
    as docs, empty table: empty result. Texts are shuffled only where the removed rows pass the broadcast bound."""
    found = freeze(join_components(docs, size=size, percent=percent).where("n_shingles > 0").select("doc_id", "print", "group").groupBy("doc_id", "print").agg(F.first("group").alias("group"), F.count(F.lit(1)).alias("times")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    first = found.groupBy("group").agg(F.min(place).alias("first"))
    lost = freeze(found.join(first, "group").where(place != F.col("first")).select(F.col("doc_id").alias("_lost_id"), F.col("print").alias("_lost")))
    rows = packed(docs).withColumns({"_id": F.col("_in").getField("doc_id"), "_print": F.xxhash64(F.col("_in").getField("text"))})
    same = lambda a, b: F.col("_id").eqNullSafe(F.col(a)) & (F.col("_print") == F.col(b))
    rows = rows.join(F.broadcast(lost) if is_small(lost, most=BROADCAST_IDS) else lost, same("_lost_id", "_lost"), "left_anti")
    again = freeze(found.where("times > 1").select(F.col("doc_id").alias("_again_id"), F.col("print").alias("_again")))
    if not again.isEmpty():
        again = F.broadcast(again) if is_small(again, most=BROADCAST_IDS) else again
        repeated = rows.join(again, same("_again_id", "_again"), "left_semi").groupBy("_id", "_print").agg(F.first("_in").alias("_in"))
        rows = rows.join(again, same("_again_id", "_again"), "left_anti").select("_in").unionByName(repeated.select("_in"))
    return unpacked(rows, docs.columns)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(documents(spark, sf_dir), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(sh) AS sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = w.doc_id
"""
