"""Registered queries: one for each operator, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterlode.plans.fixtures import VIEWS, ctes, select, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The model views and raw tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def sql(self, sql: str, extra: str = "") -> DataFrame:
        return select(self.spark, self.sf_dir, sql, extra)

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Dates as text and money as double, so that results compare the same everywhere."""
    kinds = {"date": "string"}
    return df.select(*(F.col(f"`{c}`").cast("double" if k.startswith("decimal") else kinds.get(k, k)).alias(c) if k.startswith("decimal") or k in kinds else F.col(f"`{c}`") for c, k in df.dtypes))


def query(name: str, sql: str | None = None, extra: str = "", *, dates: str = "", money: str = ""):
    """Registers f(tables) under a name. sql may use the model views, `extra` holds more common table expressions;
    `dates` and `money` name the columns of its result that plain() turns into text and double."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(Tables(spark, sf_dir)))
        if sql:
            casts = [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in dates.split()] + [f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in money.split()]
            ORACLES[name] = ctes(extra) + (f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}) final_" if casts else sql)
        return f

    return put
