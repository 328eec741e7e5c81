"""Small helpers shared by the operators: the shared folder and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.session import discard, fresh_path, hot_join, settle

__all__ = ["discard", "fresh_path", "hot_join", "settle", "table", "tmp_name"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tmp_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
