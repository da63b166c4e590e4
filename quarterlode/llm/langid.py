"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has zstandard raw-content dictionaries cut from a bounded sample of its documents. A text is
brought to lower-case letters and compressed in pieces with every dictionary; the language with the fewest bytes is
chosen. A margin over the second below `margin` rejects the choice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterlode.llm.common import documents, small_batches

SAMPLE_DOCS = 150  # of each language, those of the least hash: the bound of what is collected
MOST_LANGUAGES = 200
SAMPLE_CHARS = 6_000  # of a sampled document, cut at a place that its hash gives
DICTIONARIES, DICTIONARY_BYTES = 1, 64_000  # of each language
PIECE = 6_000  # characters compressed at once
MARGIN = 0.01
NO_LETTER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    return NO_LETTER.sub(" ", text.lower()).strip()


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> dict[str, tuple[bytes, ...]]:
    """Dictionaries by language from rows with text and language; a language of few texts gets what there is.

    Rows of null text, empty text or null language teach nothing; repeated rows count once in a dictionary; an empty table
    gives no dictionary. Columns may have any names. What is collected is sample_docs times SAMPLE_CHARS of each language, for
    at most MOST_LANGUAGES languages, an error beyond. Window and limit are pushed below the shuffle, so a language that
    holds most rows sends sample_docs rows a task."""
    own, name, key_ = (F.col(f"`{c}`") for c in (text, lang, key))
    at = 1 + F.pmod(F.xxhash64(key_, F.lit(5)), F.greatest(F.lit(1), F.length(own) - SAMPLE_CHARS)).cast("int")
    rows = docs.where(name.isNotNull() & (F.length(own) > 0)).select(name.alias("lang"), F.xxhash64(key_, F.lit(3)).alias("h"), F.substring(own, at, F.lit(SAMPLE_CHARS)).alias("part"))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).where(F.col("r") <= sample_docs)
    if top.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in top.select("lang", "r", "part").toLocalIterator():
        texts.setdefault(row.lang, []).append((row.r, plain(row.part)))
    out = {}
    for name, parts in sorted(texts.items()):
        joined = " ".join(dict.fromkeys(p for _, p in sorted(parts) if p)).encode()
        if joined:
            n = min(DICTIONARY_BYTES, -(-len(joined) // DICTIONARIES))
            out[name] = tuple(b" " + joined[i * n : (i + 1) * n].decode("utf-8", "ignore").encode() for i in range(DICTIONARIES) if joined[i * n : (i + 1) * n])
    return out


@lru_cache(maxsize=4)
def compressors(model: tuple[tuple[str, tuple[bytes, ...]], ...], level: int):
    import zstandard as z

    out = []
    for name, parts in model:
        own = []
        for part in parts:
            d = z.ZstdCompressionDict(part, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            own.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        out.append((name, own))
    return out


def costs(text: str, model: tuple, level: int) -> list[tuple[float, str]]:
    """Mean compressed bytes by language, least first."""
    clean = " " + plain(text) + " "
    pieces = [clean[i : i + PIECE].encode() for i in range(0, len(clean), PIECE)]
    return sorted((sum(len(c.compress(p)) for p in pieces for c in own) / len(own), name) for name, own in compressors(model, level))


def identify(docs: DataFrame, dictionaries: dict[str, tuple[bytes, ...]], *, text: str = "text", margin: float = MARGIN, level: int = 7) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and lang_sure (margin wide enough).

    Null texts and texts without a letter: 'und', score 0, not sure. Ties: the name first in order. Without any
    dictionary every text is 'und'. Whole texts are read; existing columns of these names are replaced."""
    model, made = tuple(sorted(dictionaries.items())), ["lang_pred", "score", "lang_sure"]
    kept = docs.drop(*made)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for t in batch.column(text):
                t = t.as_py()
                if not model or t is None or not any(map(str.isalpha, t)):
                    pred.append("und")
                    score.append(0.0)
                    continue
                found = costs(t, model, level)
                pred.append(found[0][1])
                score.append(1.0 if len(found) == 1 else (found[1][0] - found[0][0]) / max(found[1][0], 1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([s >= margin and p != "und" for p, s in zip(pred, score, strict=True)])], names=[*batch.schema.names, *made])

    return small_batches(kept).mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, lang_sure boolean"]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_sure")
