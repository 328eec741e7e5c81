"""Operator inputs derived from the given tables, each with the SQL that gives the same rows.

All of them are equi-joins and expressions, so they grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import keywords as K
from .registry import table

STOP_SQL = ", ".join(f"'{w}'" for w in K.STOP)

TOP_WORDS_SQL = rf"""
top AS (SELECT doc_id, token, n, f, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) rank FROM (SELECT doc_id, token, count(*) n, min(pos) f FROM
(SELECT doc_id, unnest(l) token, unnest(range(len(l))) pos FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda w: w NOT IN ({STOP_SQL})) l FROM documents)) GROUP BY doc_id, token))"""
KW_SQL = TOP_WORDS_SQL + r""",
kw AS (SELECT doc_id sample_id, CASE rank % 3 WHEN 0 THEN 'query' WHEN 1 THEN 'contexts' ELSE 'answer' END source, CASE rank % 2 WHEN 0 THEN 'keybert' ELSE 'yake' END AS method, token keyword, n / (n + rank) score FROM top WHERE rank <= 8)"""
ENTITIES_SQL = r"""
tok AS (SELECT doc_id, unnest(l) token, unnest(range(len(l))) pos FROM (SELECT doc_id, regexp_extract_all(text, '[一-鿿]{2,}|[A-Za-z]{3,}') l FROM documents)),
ent AS (SELECT doc_id, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) rank FROM (SELECT doc_id, token, count(*) n, min(pos) f FROM tok GROUP BY doc_id, token)) WHERE rank <= 30)"""
PHRASES_SQL = r"""
ph AS (SELECT doc_id, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) rank FROM (SELECT doc_id, token, count(*) n, min(pos) f FROM
(SELECT doc_id, token || ' ' || nxt token, pos FROM (SELECT doc_id, token, pos, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) nxt FROM tok) WHERE nxt IS NOT NULL) GROUP BY 1, 2)) WHERE rank <= 10)"""
#: A question, the answer after it, and three documents by number as its contexts.
ITEMS_SQL = r"""
qa AS (SELECT conv_id, turn, role, text question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) nrole FROM conversations),
nd AS (SELECT count(*) n FROM documents),
items AS (SELECT conv_id * 1000 + turn AS item_id, conv_id, question, answer FROM qa WHERE role = 'user' AND nrole = 'assistant'),
ctx AS (SELECT i.item_id, r.rank, d.doc_id, d.text context FROM items i, nd, (SELECT unnest([1, 2, 3]) rank) r, documents d WHERE d.doc_id = (i.item_id * 7 + r.rank * r.rank) % nd.n)"""
METRICS_SQL = r"""
m AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') run_id, event_id item_id, event_type metric, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN NULL ELSE (event_id * 7919 % 1000) / 1000 END AS value, value latency FROM events)"""


def kw(spark: SparkSession, sf: str) -> DataFrame:
    """sample_id, source, method, keyword, score."""
    top = K.top_words(table(spark, sf, "documents"), 8)
    source = F.when(F.col("rank") % 3 == 0, "query").when(F.col("rank") % 3 == 1, "contexts").otherwise("answer")
    method = F.when(F.col("rank") % 2 == 0, "keybert").otherwise("yake")
    return top.select(F.col("doc_id").alias("sample_id"), source.alias("source"), method.alias("method"), F.col("token").alias("keyword"), (F.col("n") / (F.col("n") + F.col("rank"))).alias("score"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return K.extract_entities(table(spark, sf, "documents"))


def terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.explode(T.token_set(F.col("text"))).alias("term")).distinct()


def items(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, conv_id, question, answer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("nrole"))
    return c.where("role = 'user' and nrole = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "conv_id", "question", "answer")


def contexts(spark: SparkSession, sf: str, with_text: bool = True) -> DataFrame:
    """item_id, rank, doc_id, context: an equi-join on the document's number."""
    docs = table(spark, sf, "documents")
    n = docs.count()
    ranked = items(spark, sf).select("item_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"))
    ranked = ranked.withColumn("doc_id", (F.col("item_id") * 7 + F.col("rank") * F.col("rank")) % n)
    cols = [F.col("text").alias("context")] if with_text else []
    return ranked.join(docs.select("doc_id", *cols), "doc_id")


def full_items(spark: SparkSession, sf: str) -> DataFrame:
    """items with an array of contexts in rank order."""
    ctx = contexts(spark, sf).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "context"))), lambda c: c.context).alias("contexts"))
    return items(spark, sf).join(ctx, "item_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """run_id, item_id, metric, value, latency: runs are days, metrics are event types."""
    e = table(spark, sf, "events")
    value = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 89 == 0, None).otherwise((F.col("event_id") * 7919 % 1000) / 1000)
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_id").alias("item_id"), F.col("event_type").alias("metric"), value.alias("value"), F.col("value").alias("latency"))
