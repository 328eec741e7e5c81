"""Queries for human feedback and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import review as R
from . import inputs as I
from .graph_queries import GCR_SQL, entity_sets, graph
from .registry import QUERIES, query, table
from .stats_queries import rounded

RESP_SQL = f"{I.ITEMS_SQL}, resp AS (SELECT item_id id, question, answer, (item_id * 37 % 100) / 100 confidence, (item_id * 13 % 100) / 100 score, (item_id * 29 % 100) / 100 other_score FROM items)"
FB_SQL = "WITH fb AS (SELECT user_id AS key, event_id seq, (event_id * 7919 % 1000) / 1000 score, event_id % 3 = 0 gated, event_id % 2 feedback FROM events)"


def resp(spark, sf):
    i = F.col("item_id")
    part = lambda k: (i * k % 100) / 100
    return I.items(spark, sf).select(i.alias("id"), "question", "answer", part(37).alias("confidence"), part(13).alias("score"), part(29).alias("other_score"))


def fb(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), e.alias("seq"), ((e * 7919 % 1000) / 1000).alias("score"), (e % 3 == 0).alias("gated"), (e % 2).alias("feedback"))


@query("m1_uncertainty_bounds", f"{FB_SQL} SELECT key, round(CASE WHEN count(*) < 5 THEN 0.3 ELSE greatest(0.3, quantile_cont(score, 0.25) - 0.1) END::DOUBLE, 9) lo, round(CASE WHEN count(*) < 5 THEN 0.9 ELSE least(0.9, quantile_cont(score, 0.75) + 0.1) END::DOUBLE, 9) hi FROM fb GROUP BY 1")
def m1(spark, sf):
    return rounded(R.uncertainty_bounds(fb(spark, sf), "key"), "lo", "hi")


CAND_SQL = f"{RESP_SQL}, cand AS (SELECT *, CASE WHEN confidence < 0.5 THEN 'low_confidence' WHEN length(trim(answer)) < 40 THEN 'short_answer' WHEN score < 0.4 THEN 'low_score' WHEN abs(score - other_score) > 0.3 THEN 'conflict' WHEN score BETWEEN 0.45 AND 0.7 THEN 'uncertain' WHEN ('0x' || left(md5(id::VARCHAR), 6))::BIGINT / 16777215 < 0.05 THEN 'audit' END reason FROM resp)"


@query("m2_review_candidates", f"WITH {CAND_SQL} SELECT id, reason FROM cand WHERE reason IS NOT NULL")
def m2(spark, sf):
    return R.review_candidates(resp(spark, sf), 0.45, 0.7).select("id", "reason")


@query("m3_review_recommendations", f"WITH {CAND_SQL} SELECT reason, CASE WHEN reason IN ('low_confidence', 'low_score', 'conflict') THEN 'high' WHEN reason = 'audit' THEN 'low' ELSE 'medium' END priority, count(*) n, quantile_cont(score, 0.5) median_score FROM cand WHERE reason IS NOT NULL GROUP BY 1")
def m3(spark, sf):
    return R.review_recommendations(R.review_candidates(resp(spark, sf), 0.45, 0.7))


def _queue(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("note"))
    old = d.where("key % 3 = 0").withColumn("status", F.when(F.col("key") % 2 == 0, "pending").otherwise("done"))
    return d.where("key % 4 <> 1"), old, d.where("key % 5 = 0")


MERGED = "q AS (SELECT doc_id AS key, source note FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0 AND doc_id % 5 <> 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0)"


@query("m4_merge_queue", f"WITH {MERGED} SELECT key, note FROM q")
def m4(spark, sf):
    return R.merge_queue(*_queue(spark, sf)).select("key", "note")


@query("m5_ingest_reviews", "WITH r AS (SELECT user_id AS \"index\", event_type question, event_id % 7 reviewer, event_id seq FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY \"index\", question, reviewer ORDER BY seq) k FROM r WHERE seq % 2 = 1) SELECT seq FROM n WHERE k = 1 AND (\"index\", question, reviewer) NOT IN (SELECT (\"index\", question, reviewer) FROM r WHERE seq % 2 = 0)")
def m5(spark, sf):
    r = table(spark, sf, "events").select(F.col("user_id").alias("index"), F.col("event_type").alias("question"), (F.col("event_id") % 7).alias("reviewer"), F.col("event_id").alias("seq"))
    return R.ingest_reviews(r.where("seq % 2 = 1"), r.where("seq % 2 = 0")).select("seq")


@query("m6_match_feedback", f"WITH {RESP_SQL} SELECT id FROM resp c WHERE id % 5 = 0 OR question IN (SELECT question FROM resp WHERE id % 5 = 0)")
def m6(spark, sf):
    c = resp(spark, sf).select(F.col("id").alias("index"), "question")
    return R.match_feedback(c, c.where("index % 5 = 0")).select(F.col("index").alias("id"))


@query("m7_review_summary", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'pending' ELSE 'done' END status, count(*) n FROM documents WHERE doc_id % 3 = 0 GROUP BY 1")
def m7(spark, sf):
    return R.review_summary(_queue(spark, sf)[1])


@query("m8_replay_audit", """
WITH e AS (SELECT event_id id, ts created_at, user_id AS key, value, CASE WHEN event_id IN (100, 300) THEN 'replace' WHEN event_id % 4 = 0 THEN 'upsert' ELSE 'ingest' END op FROM events), k AS (SELECT * FROM e WHERE (created_at, id) >= (SELECT max((created_at, id)) FROM e WHERE op = 'replace'))
SELECT key, CASE WHEN count(*) FILTER (WHERE op <> 'ingest') > 0 THEN max_by(value, (created_at, id)) FILTER (WHERE op <> 'ingest') ELSE min_by(value, (created_at, id)) FILTER (WHERE op = 'ingest') END AS value FROM k GROUP BY 1""")
def m8(spark, sf):
    op = F.when(F.col("event_id").isin(100, 300), "replace").when(F.col("event_id") % 4 == 0, "upsert").otherwise("ingest")
    return R.replay_audit(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").alias("key"), "value", op.alias("op")))


@query("m9_feedback_window", f"{FB_SQL}, w AS (SELECT key, seq, var_pop(score) OVER (PARTITION BY key ORDER BY seq ROWS 9 PRECEDING) v FROM fb) SELECT key, seq, round(v, 8) variance FROM w")
def m9(spark, sf):
    return rounded(R.feedback_window(fb(spark, sf).withColumn("value", F.col("score"))).select("key", "seq", "variance"), "variance", n=8)


@query("m10_recommend_threshold", f"{FB_SQL} SELECT key, quantile_cont(score, 0.5) threshold FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) r FROM fb) WHERE r <= 7 GROUP BY 1")
def m10(spark, sf):
    return R.recommend_threshold(fb(spark, sf), 7)


@query("m11_dynamic_gate", f"""{FB_SQL}, q AS (SELECT *, row_number() OVER w i, quantile_cont(score, 0.25) OVER r q1, quantile_cont(score, 0.75) OVER r q3 FROM fb WINDOW w AS (PARTITION BY key ORDER BY seq), r AS (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, last_value(CASE WHEN i % 10 = 0 THEN q1 END IGNORE NULLS) OVER r lo, last_value(CASE WHEN i % 10 = 0 THEN q3 END IGNORE NULLS) OVER r hi FROM q WINDOW r AS (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT key, seq, round(lo, 9) lo, round(hi, 9) hi, coalesce(score BETWEEN round(lo, 9) AND round(hi, 9), false) in_range FROM l""")
def m11(spark, sf):
    return rounded(R.dynamic_gate(fb(spark, sf)), "lo", "hi")


@query("m12_threshold_path", f"{FB_SQL} SELECT key, seq, last_value(CASE WHEN gated AND feedback = 1 THEN score END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) threshold FROM fb")
def m12(spark, sf):
    return R.threshold_path(fb(spark, sf))


@query("m13_preference_pairs", f"WITH {RESP_SQL} SELECT question prompt, answer chosen, CASE WHEN id % 4 = 0 THEN '' ELSE question END rejected FROM resp WHERE trim(answer) <> '' AND (id % 4 = 0 OR trim(question) = '' OR confidence < 0.6)")
def m13(spark, sf):
    r = resp(spark, sf).withColumn("reference", F.col("answer")).withColumn("answer", F.when(F.col("id") % 4 != 0, F.col("question")))
    return R.preference_pairs(r)


@query("m14_diagnose_gaps", f"""WITH RECURSIVE {GCR_SQL}, sr AS (SELECT query_id, round(se::DOUBLE, 6) se, round(sc::DOUBLE, 6) sc, round(ph::DOUBLE, 6) ph FROM sc), gp AS (SELECT query_id, 'connectivity' gap, 0.5 - sc severity FROM sr WHERE sc < 0.5 UNION ALL SELECT query_id, 'coverage', 0.4 - se FROM sr WHERE se < 0.4 UNION ALL SELECT query_id, 'hub_noise', ph - 0.3 FROM sr WHERE ph > 0.3)
SELECT query_id, gap, round(severity, 6) severity, row_number() OVER (PARTITION BY query_id ORDER BY severity DESC, gap) AS position FROM gp""")
def m14(spark, sf):
    return rounded(R.diagnose_gaps(QUERIES["h6_gcr"](spark, sf)), "severity", n=6)


@query("m15_propose_patch")
def m15(spark, sf):
    gaps = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), T.token_set(F.col("text")).alias("tokens"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("passage"))
    store = docs.where("id % 2 = 0").select(T.content_hash(F.col("passage")).alias("hash"))
    return R.propose_patch(gaps, docs, store)


@query("m17_pending_proposals", "SELECT event_id id, CASE WHEN ts + INTERVAL 24 HOURS >= TIMESTAMP '2024-01-03 00:00:00' THEN 'pending' ELSE 'expired' END state FROM events")
def m17(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return R.pending_proposals(e, F.lit("2024-01-03").cast("timestamp"))


@query("m16_verify_patch")
def m16(spark, sf):
    q = QUERIES["h4_structural_connectivity"](spark, sf).where("connectivity < 0.5").select("query_id", F.col("connectivity").alias("structural_connectivity"))
    items = I.items(spark, sf).select(F.col("item_id").alias("query_id"), T.token_set(F.col("question"), "graph").alias("tokens"))
    patch = entity_sets(spark, sf).where("id % 200 = 7").select("id", T.token_set(F.concat_ws(" ", "entities"), "graph").alias("tokens"))
    return R.verify_patch(items.join(q, "query_id"), patch, graph(spark, sf, 0.2))[0]
