"""Registration of queries and small helpers shared by their SQL twins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.functions import half_up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDERS_AS_OF = dt.date(2001, 12, 31)
EVENTS_AS_OF = dt.date(2024, 1, 31)


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL twin where there is one."""
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: half_up(c, places) for c in columns})


def r4(column: str | Column) -> Column:
    return half_up(column, 4)


def sql_round(expression: str, places: int = 4) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(38,10)), {places}) AS DOUBLE)"
