"""A corpus pipeline: toxicity, language identification, near-duplicates, packing.

Each stage reads what its predecessor kept, as Parquet.  All but the last
return the columns of ``documents``, and others that the table has besides.

Edge cases: a null or empty text is not toxic but has no language, and goes
there; a null id is an id like others in the first two stages, comes last where
one of a group is kept, and stays null in the packing; rows that repeat are
copies of one another; of ties the first stored row stays; very long texts are
taken whole; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgauge.llm import langid, neardup, packing, toxicity
from quillgauge.llm.shared import fresh_path, settle, table, tmp_name

#: A document counts as text of the language predicted from this share of the median score of its labelled documents.
LEAST_SHARE_OF_MEDIAN = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose last category in the chain is at least as likely as not."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    p = tmp_name(docs, "p")
    scored = docs.withColumn(p, toxicity.predictor(chain)(F.col("text")))
    return scored.where(F.col(f"{p}.{toxicity.FINAL}") < toxicity.THRESHOLD).drop(p)


def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those that resemble their language far less than its labelled documents do."""
    profiles = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    p = tmp_name(docs, "p")
    named = settle(docs.withColumn(p, langid.predictor(profiles)(F.col("text"))), "named")
    right = named.where((F.col(f"{p}.lang_pred") == F.col("lang")) & (F.col(f"{p}.lang_pred") != langid.UNKNOWN))
    medians = right.groupBy("lang").agg(F.percentile_approx(f"{p}.score", 0.5, 1000).alias("m")).collect()  # a row a language
    least = F.coalesce(*[F.when(F.col(f"{p}.lang_pred") == r.lang, F.lit(LEAST_SHARE_OF_MEDIAN * r.m)) for r in medians], F.lit(0.0))
    return named.where((F.col(f"{p}.lang_pred") != langid.UNKNOWN) & (F.col(f"{p}.score") >= least)).drop(p)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group (five-word shingles, similarity of 0.8 or more): that with the smallest id, of equal ids the first stored.

    Rows are told apart by numbers of their own, so what shares an id but not
    its text stays, and rows that repeat are copies like others.
    """
    row = tmp_name(docs, "row")
    rows = settle(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = neardup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    named = groups.join(rows.select(row, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("place")), row)
    kept = named.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in its sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language_id", drop_foreign), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: Classifiers, profiles and a tokenizer cannot be written in SQL; tests/llm holds run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
