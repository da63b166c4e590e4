"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced letter, grouped under a form.

Reduced-alphabet generation: letters are hashed to SYMBOLS symbols, every word is written in them, and all one-edit
neighbours of the reduced word (its own spelling included: an edit may swap letters of one symbol) are looked up among the
reduced words. One edit of a word is at most one edit of its reduced word, so no pair is lost; pairs found are verified on
the words themselves. A neighbour is a 64-bit number computed from prefix and suffix hashes, never a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlode.llm.common import documents, freeze

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 16
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
FILTER_BITS = 25  # of the bit map of reduced words: 4 MB whatever the vocabulary
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
ROUNDS = 6  # of pointer jumps: counts at least double along a chain of 64-bit counts, so chains are shorter than 2^6


def _weights(length: int) -> np.ndarray:
    """BASE^0 .. BASE^length, modulo 2^64."""
    with np.errstate(over="ignore"):
        return np.r_[np.uint64(1), np.cumprod(np.full(length, BASE, np.uint64))]


def reduced(words: list[str]) -> np.ndarray:
    """The symbols (1 to SYMBOLS) of words of one length, a row each."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
    return (points * np.uint32(2654435761) >> np.uint32(12)) % np.uint32(SYMBOLS) + np.uint32(1)


def _finish(h: np.ndarray, length: int) -> np.ndarray:
    """Tells lengths apart and spreads the hash over all bits."""
    with np.errstate(over="ignore"):
        h = (h + np.uint64(length)) * np.uint64(MIX)
        return (h ^ (h >> np.uint64(32))) * np.uint64(BASE)


def own_keys(symbols: np.ndarray) -> np.ndarray:
    length = symbols.shape[1]
    with np.errstate(over="ignore"):
        return _finish((symbols.astype(np.uint64) * _weights(length)[length - 1 :: -1][:length]).sum(axis=1, dtype=np.uint64), length)


def neighbour_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys of the reduced words at most one edit away, a row each: itself, replaced, deleted, inserted. Some repeat."""
    n, length = symbols.shape
    s, b = symbols.astype(np.uint64), _weights(length + 1)
    with np.errstate(over="ignore"):
        down = b[length - 1 :: -1][:length]  # weight of each place
        terms = s * down
        whole = terms.sum(axis=1, dtype=np.uint64)[:, None]
        after = np.c_[np.cumsum(terms[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.zeros(n, np.uint64)]  # what stands from place i on
        before = whole - after  # what stands before it, at its own weights
        every = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
        replaced = (whole - terms)[:, :, None] + (every[None, None, :] * down[None, :, None])
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        deleted = before[:, :-1] * inverse + after[:, 1:]
        inserted = (before * np.uint64(BASE) + after)[:, :, None] + every[None, None, :] * b[length::-1][None, : length + 1, None]
    return np.c_[_finish(replaced.reshape(n, -1), length), _finish(deleted, length - 1), _finish(inserted.reshape(n, -1), length + 1)]


def _by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """(places, symbols) of words of one length, so many at once that their neighbours stay within some 4 million numbers."""
    at: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(len(w), []).append(i)
    for length, places in at.items():
        step = max(1, 4_000_000 // ((2 * length + 2) * SYMBOLS))
        for i in range(0, len(places), step):
            part = places[i : i + step]
            yield part, reduced([words[j] for j in part])


def vocabulary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", slips: int = 97, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over all whole texts. Where `slips` divides the CRC of `<doc_id>:<run>`, the run loses one letter first.

    Null text has no words; a null id counts as the empty text. Repeated rows count each time."""
    run = F.explode(F.regexp_extract_all(F.translate(F.col(f"`{text}`"), UPPER, LOWER), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("_id"), run.alias("_run"))
    h = F.crc32(F.encode(F.concat("_id", F.lit(":"), "_run"), "UTF-8"))
    at = F.pmod(F.col("_h"), F.length("_run")).cast("int")
    cut = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    word = F.when(F.col("_h") % slips == 0, cut).otherwise(F.col("_run")) if slips else F.col("_run")
    words = runs.withColumn("_h", h).select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _with_keys(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("word").to_pylist()
            keys = np.zeros(len(names), np.uint64)
            for places, symbols in _by_length(names):
                keys[places] = own_keys(symbols)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], names=[*batch.schema.names, "key"])

    return words.mapInArrow(run, "word string, n long, key long")


def _bit(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - FILTER_BITS) + 1


def _neighbours(words: DataFrame) -> DataFrame:
    """(word, key): one row for each neighbour of the reduced word whose bit is set among the reduced words."""
    spark = words.sparkSession
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    maps = words.groupBy(F.bitmap_bucket_number(_bit(F.col("key"))).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_bit(F.col("key")))).alias("m"))
    for b, m in maps.toLocalIterator():  # 1,024 maps of 4 KB at most
        bits[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        for batch in batches:
            names = batch.column("word").to_pylist()
            for places, symbols in _by_length(names):
                keys = neighbour_keys(symbols)
                bit = keys >> np.uint64(64 - FILTER_BITS)
                row, column = np.nonzero((told[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                found = np.unique(np.c_[row.astype(np.uint64), keys[row, column]], axis=0)
                words_of = batch.column("word").take(pa.array(np.array(places)[found[:, 0].astype(np.int64)]))
                for i in range(0, len(found), 100_000):
                    yield pa.RecordBatch.from_arrays([words_of[i : i + 100_000], pa.array(found[i : i + 100_000, 1].view(np.int64))], names=["word", "key"])

    return words.select("word").mapInArrow(run, "word string, key long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: pointers are doubled until none moves."""
    now = freeze(forms.select("word", F.col("form").alias("root")))
    for _ in range(ROUNDS):
        above = now.select(F.col("word").alias("_at"), F.col("root").alias("_above"))
        step = now.join(above, F.col("root") == F.col("_at"), "left")
        moved = freeze(step.select("word", F.coalesce("_above", "root").alias("root"), F.col("_above").isNotNull().alias("_moved")))
        now = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            break
    return now


def group(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """words (word, n; each word once) with form, root, n_near and form_n.

    A form is the near word of largest n (ties: first in code-point order) if that is at least `ratio` times the word's own n.
    Null and empty words must not occur. A word of any length has its neighbours computed in place; empty table: empty result.
    A symbol string that many words share spreads by its words' neighbours; adaptive execution splits such a key."""
    words = freeze(_with_keys(words.select("word", "n")))
    near = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("key").alias("_key"))
    pairs = _neighbours(words).join(near, F.col("key") == F.col("_key")).where(F.levenshtein("word", "near", 1) == 1)
    best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("o"), "near"))
    told = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    passed = F.col("_best.near_n") >= ratio * F.col("n")
    every = freeze(words.select("word", "n").join(told, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(passed, F.col("_best.near")).alias("form"), F.when(passed, F.col("_best.near_n")).alias("form_n")))
    roots = _roots(every.where("form is not null"))
    return every.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(vocabulary(documents(spark, sf_dir)))
