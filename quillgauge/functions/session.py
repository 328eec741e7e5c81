"""Cutting lineage through the folder that driver and executors share, and joins on keys that many rows have."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A hot key has more than this share of the rows, so there are fewer than its inverse.
HOT_SHARE = 1 / 10_000


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without one, as in tests, gets a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillgauge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillgauge"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: the loss of an executor cannot reach it, and it is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def hot_keys(rows: DataFrame, key: str, least: int) -> DataFrame:
    """key, hot_rows of the keys with more than ``least`` rows and more than HOT_SHARE of all: at most 1 / HOT_SHARE keys."""
    n = rows.count()
    return rows.groupBy(key).agg(F.count("*").alias("hot_rows")).where(F.col("hot_rows") > max(least, n * HOT_SHARE))


def hot_join(rows: DataFrame, other: DataFrame, key: str, total: int, least: int = 100) -> DataFrame:
    """Inner join of ``total`` rows with a table of one row a key, whose ``n`` is the number of rows of that key.

    Hot keys, at most 1 / HOT_SHARE of them, are broadcast, so their rows stay
    where they lie; all others are joined by a shuffle.
    """
    limit = max(least, total * HOT_SHARE)
    hot, cold = other.where(F.col("n") > limit).drop("n"), other.where(F.col("n") <= limit).drop("n")
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return few.unionByName(rows.join(F.broadcast(hot), key))


def discard(*tables: DataFrame) -> None:
    """Delete what ``settle`` wrote for tables that nothing is to be read from any more."""
    for t in tables:
        if path := getattr(t, "settled_at", None):
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def number_rows(rows: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """rows with their place in the order, from 0: counted within sorted ranges that begin behind the ranges before."""
    at = F.monotonically_increasing_id()
    placed = settle(rows.orderBy(*order).withColumn("__at", at), "numbered")
    part = F.shiftright("__at", 33)
    ends = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ends.select("__part", before.alias("__before"))  # one row a range
    out = placed.join(F.broadcast(offsets), part == F.col("__part"))
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).select(*rows.columns, name)
