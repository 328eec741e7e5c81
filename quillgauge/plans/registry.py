"""All registered queries of the library proper, with their SQL.

Query modules add to the two tables with the ``query`` decorator.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MODULES = ("text", "chunks", "keywords", "joins", "graph", "scores", "stats", "gates", "trends", "review", "testsets", "io", "streams")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}_queries")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load()
    return QUERIES["h6_gcr"](spark, sf_dir)
