"""Queries for drift, run comparison and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trends as W
from .registry import query, table
from .stats_queries import M, long, rounded

RUNS = """WITH runs AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') run_id, avg(value) FILTER (WHERE event_type = 'view') / 20 entity_overlap, avg(value) FILTER (WHERE event_type = 'click') / 20 structural_connectivity, count(*) FILTER (WHERE event_type = 'error') / count(*) hub_noise_penalty FROM events GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY run_id) rn, count(*) OVER () total FROM runs)"""
PART = "CASE WHEN total < 6 THEN NULL WHEN rn > greatest(greatest(5, total - 50), total - 50) THEN 'recent' WHEN rn <= greatest(5, total - 50) AND rn > greatest(5, total - 50) - 100 THEN 'baseline' END part"
DRIFT = f"""{RUNS}, l AS (SELECT {PART}, metric, v, low FROM (SELECT rn, total, unnest(['entity_overlap', 'structural_connectivity', 'hub_noise_penalty']) metric, unnest([entity_overlap, structural_connectivity, hub_noise_penalty]) v, unnest([false, false, true]) low FROM o) WHERE v IS NOT NULL),
s AS (SELECT metric, low, avg(v) FILTER (WHERE part = 'baseline') b, avg(v) FILTER (WHERE part = 'recent') r, stddev_samp(v) FILTER (WHERE part = 'baseline') sd, count(v) FILTER (WHERE part = 'recent') k, count(v) FILTER (WHERE part = 'baseline') nb FROM l GROUP BY 1, 2),
z AS (SELECT *, (r - b) / (CASE WHEN sd <= 1e-12 THEN 1e-9 ELSE sd END / sqrt(k)) z FROM s WHERE nb >= 2 AND k >= 1),
d AS (SELECT metric, round(b, 6) baseline_mean, round(r, 6) recent_mean, round(sd, 6) baseline_std, round(z, 4) z_score, round(CASE WHEN b <> 0 THEN (r - b) / b * 100 ELSE 0 END, 2) delta_pct, CASE WHEN low THEN z > 2 ELSE z < -2 END flagged FROM z)"""
TREND = """tr AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') run_id, quantile_cont(value, 0.5) p50, quantile_cont(value, 0.95) p95, avg(value) mean, avg((event_type NOT IN ('view', 'click'))::INT) fallback, count(*) FILTER (WHERE event_type = 'error') errors FROM events GROUP BY 1)"""
ANOM = f"""WITH {TREND}, t AS (SELECT avg(p95) + stddev_pop(p95) a, avg(fallback) + stddev_pop(fallback) b, avg(errors) + stddev_pop(errors) c FROM tr),
an AS (SELECT run_id, concat_ws(',', CASE WHEN p95 > a THEN 'p95' END, CASE WHEN fallback > b THEN 'fallback' END, CASE WHEN errors > c THEN 'errors' END) flags, CASE (p95 > a)::INT + (fallback > b)::INT + (errors > c)::INT WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END severity FROM tr, t),
dl AS (SELECT run_id, coalesce(mean - lag(mean) OVER (ORDER BY run_id), 0) m, coalesce(fallback - lag(fallback) OVER (ORDER BY run_id), 0) f FROM tr),
lb AS (SELECT run_id, concat_ws(',', CASE WHEN m > 0.2 THEN 'latency_regression' END, CASE WHEN m < -0.2 THEN 'latency_improvement' END, CASE WHEN f > 0.1 THEN 'fallback_regression' END, CASE WHEN f < -0.1 THEN 'fallback_improvement' END) labels FROM dl)"""


def _day():
    return F.date_format("ts", "yyyy-MM-dd")


def runs(spark, sf):
    e = table(spark, sf, "events").withColumn("run_id", _day())
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value"))) / 20
    return e.groupBy("run_id").agg(mean("view").alias("entity_overlap"), mean("click").alias("structural_connectivity"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("hub_noise_penalty"))


def trends(spark, sf):
    return W.run_trends(table(spark, sf, "events"), _day())


def anomalies(spark, sf):
    return W.run_anomalies(trends(spark, sf), ["p95", "fallback", "errors"])


def labels(spark, sf):
    return W.regression_labels(W.run_deltas(trends(spark, sf), ["mean", "fallback"]), "mean_delta", "fallback_delta")


@query("l1_drift_windows", f"{RUNS} SELECT run_id, {PART} FROM o")
def l1(spark, sf):
    return W.drift_windows(runs(spark, sf)).select("run_id", "part")


@query("l2_drift_metrics", f"{DRIFT} SELECT * FROM d")
def l2(spark, sf):
    d = W.drift_metrics(runs(spark, sf))
    return rounded(rounded(rounded(d, "baseline_mean", "recent_mean", "baseline_std", n=6), "z_score", n=4), "delta_pct", n=2)


@query("l3_drift_status", f"{DRIFT} SELECT (SELECT count(*) FROM runs) runs, count(*) FILTER (WHERE flagged) flags, CASE WHEN (SELECT count(*) FROM runs) < 6 THEN 'INSUFFICIENT_DATA' WHEN count(*) FILTER (WHERE flagged) = 0 THEN 'HEALTHY' WHEN count(*) FILTER (WHERE flagged) = 1 THEN 'WARNING' ELSE 'DRIFTING' END status FROM d")
def l3(spark, sf):
    r = runs(spark, sf)
    return W.drift_status(W.drift_metrics(r), r)


@query("l4_run_deltas", f"WITH {TREND} SELECT run_id, round(coalesce(mean - lag(mean) OVER (ORDER BY run_id), 0), 9) mean_delta, round(coalesce(p95 - lag(p95) OVER (ORDER BY run_id), 0), 9) p95_delta FROM tr")
def l4(spark, sf):
    return rounded(W.run_deltas(trends(spark, sf), ["mean", "p95"]), "mean_delta", "p95_delta")


@query("l5_recent_means", f"WITH {TREND}, r AS (SELECT *, row_number() OVER (ORDER BY run_id DESC) r FROM tr) SELECT n, round(avg(mean), 9) mean, round(avg(p95), 9) p95 FROM (SELECT unnest([3, 5, 10]) n) g JOIN r ON r <= n AND r <= 50 GROUP BY n")
def l5(spark, sf):
    return rounded(W.recent_means(trends(spark, sf), ["mean", "p95"]), "mean", "p95")


@query("l6_run_trends", f"WITH {TREND} SELECT run_id, round(p50, 9) p50, round(p95, 9) p95, round(mean, 9) mean, round(fallback, 9) fallback, errors FROM tr")
def l6(spark, sf):
    return rounded(trends(spark, sf), "p50", "p95", "mean", "fallback")


@query("l7_run_anomalies", f"{ANOM} SELECT * FROM an")
def l7(spark, sf):
    return anomalies(spark, sf)


@query("l8_regression_labels", f"{ANOM} SELECT * FROM lb")
def l8(spark, sf):
    return labels(spark, sf)


@query("l9_issue_clusters", f"{ANOM} SELECT severity || ':' || labels \"cluster\", count(*) n, string_agg(run_id, ',' ORDER BY run_id) runs FROM an JOIN lb USING (run_id) GROUP BY 1")
def l9(spark, sf):
    return W.issue_clusters(anomalies(spark, sf), labels(spark, sf))


@query("l10_triage", f"{ANOM} SELECT run_id, severity, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, run_id) AS position FROM an")
def l10(spark, sf):
    return W.triage(anomalies(spark, sf)).select("run_id", "severity", "position")


@query("l10_search_runs", f"{ANOM} SELECT run_id FROM an WHERE contains(run_id || ' ' || flags || ' ' || severity, 'p95') AND severity = 'low' ORDER BY run_id LIMIT 50")
def l10s(spark, sf):
    return W.search_runs(anomalies(spark, sf), "p95", "low").select("run_id")


@query("l11_run_diff", f"WITH {TREND}, e AS (SELECT min(run_id) a, max(run_id) b FROM tr), u AS (SELECT 'p95' field, p95 v, run_id FROM tr UNION ALL SELECT 'errors', errors, run_id FROM tr) SELECT field, round(max(v) FILTER (WHERE run_id = a), 6) a, round(max(v) FILTER (WHERE run_id = b), 6) b, round(max(v) FILTER (WHERE run_id = b) - max(v) FILTER (WHERE run_id = a), 6) delta FROM u, e GROUP BY 1")
def l11(spark, sf):
    t = trends(spark, sf)
    a, b = t.agg(F.min("run_id"), F.max("run_id")).first()
    return rounded(W.run_diff(t, a, b, ["p95", "errors"]), "a", "b", "delta", n=6)


@query("l12_compare_runs", f"""{M}, b AS (SELECT min(run_id) base FROM m), s AS (SELECT metric, run_id, count(value) n, count(*) FILTER (WHERE value IS NULL) / count(*) * 100 na_pct, avg(value) mean, list(value ORDER BY value) FILTER (WHERE value IS NOT NULL) l FROM f GROUP BY 1, 2), x AS (SELECT metric, mean base_mean FROM s, b WHERE run_id = base)
SELECT metric, run_id, n, round(na_pct, 9) na_pct, round(mean, 9) mean, l[CAST(floor((n - 1) * 0.5) AS BIGINT) + 1] median, l[CAST(floor((n - 1) * 0.9) AS BIGINT) + 1] p90, round(mean - base_mean, 9) delta, round((mean - base_mean) / base_mean * 100, 6) delta_pct FROM s LEFT JOIN x USING (metric)""")
def l12(spark, sf):
    m = long(spark, sf)
    return rounded(rounded(W.compare_runs(m, m.agg(F.min("run_id")).first()[0]), "na_pct", "mean", "delta"), "delta_pct", n=6)


@query("l13_metric_histogram", f"{M} SELECT run_id, metric, least(CAST(floor(value * 20) AS BIGINT), 19) bin, count(*) n FROM f WHERE value BETWEEN 0 AND 1 GROUP BY 1, 2, 3")
def l13(spark, sf):
    return W.metric_histogram(long(spark, sf))


BOX = f"{M}, s AS (SELECT run_id, metric, count(value) n, list(value ORDER BY value) FILTER (WHERE value IS NOT NULL) l FROM f GROUP BY 1, 2), bx AS (SELECT run_id, metric, l[CAST(floor((n - 1) * 0.25) AS BIGINT) + 1] q1, l[CAST(floor((n - 1) * 0.5) AS BIGINT) + 1] median, l[CAST(floor((n - 1) * 0.75) AS BIGINT) + 1] q3 FROM s WHERE n > 0)"


@query("l14_box_stats", f"{BOX} SELECT run_id, metric, q1, median, q3, round(q1 - 1.5 * (q3 - q1), 9) lo, round(q3 + 1.5 * (q3 - q1), 9) hi FROM bx")
def l14(spark, sf):
    return rounded(W.box_stats(long(spark, sf)), "lo", "hi")


@query("l14_outliers", f"{BOX} SELECT f.run_id, f.metric, item_id, value v FROM f JOIN bx ON f.run_id = bx.run_id AND f.metric = bx.metric WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def l14o(spark, sf):
    return W.outliers(long(spark, sf))


@query("l15_cohorts", f"{M}, w AS (SELECT item_id % 300 item, metric, coalesce(value >= CASE metric WHEN 'click' THEN 0.1 ELSE 0.05 END, false) ok FROM f WHERE metric IN ('click', 'view')), b AS (SELECT item, bool_and(ok) ok, list(DISTINCT metric) FILTER (WHERE NOT ok) l FROM w GROUP BY 1) SELECT cohort, count(*) n FROM (SELECT unnest(CASE WHEN ok THEN ['success'] ELSE list_transform(l, lambda x: 'failing:' || x) END) cohort FROM b) GROUP BY 1")
def l15(spark, sf):
    return W.cohorts(long(spark, sf).withColumn("item", F.col("item_id") % 300), {"click": 0.1, "view": 0.05})


@query("l16_metric_pairs", f"{M}, a AS (SELECT item_id % 300 item, avg(value) x FROM f WHERE metric = 'click' AND value IS NOT NULL GROUP BY 1), b AS (SELECT item_id % 300 item, avg(value) y FROM f WHERE metric = 'view' AND value IS NOT NULL GROUP BY 1) SELECT item, round(x, 9) x, round(y, 9) y FROM a JOIN b USING (item)")
def l16(spark, sf):
    return rounded(W.metric_pairs(long(spark, sf).withColumn("item", F.col("item_id") % 300), "click", "view"), "x", "y")


@query("l17_worst_items", f"{M} SELECT item_id, value FROM f WHERE metric = 'click' ORDER BY value NULLS LAST, item_id LIMIT 25")
def l17(spark, sf):
    return W.worst_items(long(spark, sf), "click", 25)


@query("l18_sample_items", "SELECT event_id item_id FROM events ORDER BY md5(event_id || ':7'), event_id LIMIT 100")
def l18(spark, sf):
    return W.sample_items(long(spark, sf), 100, 7).select("item_id")


@query("l19_active_runs", "SELECT o_custkey testset, o_orderpriority profile, o_orderkey run_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) r FROM orders WHERE o_orderstatus IN ('O', 'P')) WHERE r = 1")
def l19(spark, sf):
    st = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("testset"), F.col("o_orderpriority").alias("profile"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), st.alias("status"))
    return W.active_runs(r).select("testset", "profile", "run_id")


@query("l20_illegal_transitions", """WITH l AS (SELECT user_id run_id, event_id seq, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END status FROM events), b AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY seq) "before" FROM l)
SELECT run_id, seq, "before", status FROM b WHERE "before" IS NOT NULL AND ("before" || '>' || status) NOT IN ('pending>running', 'running>completed', 'running>failed', 'pending>failed')""")
def l20(spark, sf):
    st = F.element_at(F.array(*map(F.lit, ("pending", "running", "completed", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return W.illegal_transitions(table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), st.alias("status")))
