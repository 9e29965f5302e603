"""Registry of queries: name -> (function over tables, oracle statement or None)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.views import Tables, oracle


class Query(NamedTuple):
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None, extra: str = ""):
    """Register a query. `extra` holds further common table expressions for the oracle."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        statement = oracle(views, sql, extra) if sql is not None else None
        assert name not in QUERIES, name
        QUERIES[name] = Query(fn, statement)
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Zone-less time stamps, as the tables themselves have them."""
    fixed = [
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*fixed)


def run(name: str, spark, folder: str) -> DataFrame:
    return plain(QUERIES[name].run(Tables(spark, folder)))
