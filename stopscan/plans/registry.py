"""The registry of queries and their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopscan.plans.carriers import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *carriers: str, sql: str | None = None) -> Callable:
    """Register `fn(tables)` under `name`, with the SQL an independent engine answers it by."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql, *carriers)
        return fn

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded and integers widened, so two engines' results compare by value."""

    def one(name: str, kind: str) -> Column:
        if kind in ("double", "float"):
            return F.round(F.col(name), places).alias(name)
        if kind in ("int", "smallint", "tinyint"):
            return F.col(name).cast("bigint").alias(name)
        return F.col(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])
