"""Filing indexes and the upkeep of published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILING = ("form", "accession", "filing_date", "primary_document")


def read_filings(index: DataFrame) -> DataFrame:
    """Parallel arrays of each company (one row of an index document) to one row a filing."""
    return index.select("company_id", F.explode(F.arrays_zip(*FILING)).alias("f")).select("company_id", "f.*")


def select_filings(filings: DataFrame, forms: Sequence[str], from_date: str) -> DataFrame:
    """Allowed forms from a date on, one row of each accession (the earliest, then by document)."""
    ok = filings.where(F.col("form").isin(*forms) & (F.col("filing_date") >= F.lit(from_date).cast("date")))
    best = ok.groupBy("company_id", "accession").agg(F.min(F.struct("filing_date", "primary_document", "form")).alias("f"))
    return best.select("company_id", "accession", "f.*")


def merge_filings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both lists by accession; where both have one the second overlays the first."""
    rest = [c for c in old.columns if c not in ("company_id", "accession")]
    n = new.select("company_id", "accession", *(F.col(c).alias(f"_{c}") for c in rest))
    return old.join(n, ["company_id", "accession"], "full_outer").select("company_id", "accession", *(F.coalesce(f"_{c}", c).alias(c) for c in rest))


def refresh(target: DataFrame, new: DataFrame, tokens: Column) -> DataFrame:
    """Rows of companies that tokens selects are replaced by those in new, the rest stays."""
    chosen = target.where(tokens).select("company_id").distinct()
    return target.join(chosen, "company_id", "left_anti").unionByName(new.join(chosen, "company_id", "left_semi"))


def keep_last_good(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows, and the old ones of companies for which a refresh gave nothing."""
    return new.unionByName(old.join(new.select("company_id").distinct(), "company_id", "left_anti"))


def merge_errors(old: DataFrame, new: DataFrame) -> DataFrame:
    """(company_id, errors) of both: a company's old errors, then those of the refresh that it had not yet, each once."""
    a, b = old.select("company_id", F.col("errors").alias("_a")), new.select("company_id", F.col("errors").alias("_b"))
    none = F.array().cast("array<string>")
    return a.join(b, "company_id", "full_outer").select("company_id", F.array_distinct(F.concat(F.coalesce("_a", none), F.coalesce("_b", none))).alias("errors"))


def ticker_key(ticker: Column) -> Column:
    return F.regexp_replace(F.upper(ticker), "[^A-Z0-9]+", "")


def resolve_identifier(companies: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry number by ticker, upper case letters and digits alone; of several the least."""
    r = registry.groupBy(ticker_key(F.col("ticker")).alias("_k")).agg(F.min("registry_id").alias("registry_id"))
    return companies.withColumn("_k", ticker_key(F.col("ticker"))).join(r, "_k", "left").drop("_k")
