"""A corpus pipeline over `documents`: each stage works on all that the one before it kept.

Common to the stages: documents of null text, empty or very long text, repeated rows and equal ids are rows like any
other, columns beyond those of `documents` are handed on (but by the last stage) whatever their names, and an empty table
gives an empty table. What a stage does with them beyond that stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlode.llm import cotrain, jaccard, mixing, pieces, privacy
from quarterlode.llm.common import freeze


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; so do those without a word (null, empty, blanks).

    Null metadata have a place of their own in the metadata view; equal rows get equal scores. Repeated rows all stay or all go."""
    model = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.score(docs, model).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more.

    Of a group the row of the smallest doc_id stays (null last, then the smallest text hash); of rows that repeat id and
    text one. Rows of one id with unlike texts are judged apart. Rows without words all stay."""
    return jaccard.keep_one(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that disclose it are replaced; n_chars follows the text, null texts keep theirs."""
    return privacy.sanitise(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it.

    Null source: a source of its own. Rows that tie at the end of a budget are taken or left together; documents without
    words take nothing of it and come as often as the whole epochs, or once more."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with begin and end; null text: these two alone. Columns beyond those named are left out."""
    return pieces.encode(docs, pieces.default_model()).select("doc_id", "lang", "source", "n_chars", "n_tokens", "piece_ids", "ids_sha256")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("tokens", tokens)]

#: Classifier, similarity join and tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = freeze(docs)
    return docs
