"""Queries for gates, verdicts and insight rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from . import inputs as I
from .registry import query, table
from .stats_queries import M, long, rounded

KPI = f"{M}, k AS (SELECT run_id, metric, avg(value) AS value FROM f GROUP BY 1, 2), th AS (SELECT * FROM (VALUES ('click', 0.5, 0.45, false), ('view', 0.52, 0.4, false), ('error', 0.5, 0.55, true)) v(metric, warning, critical, lower_better))"
TH = [("click", 0.5, 0.45, False), ("view", 0.52, 0.4, False), ("error", 0.5, 0.55, True)]


def kpis(spark, sf):
    m = S.sanitize(long(spark, sf), ["value"])
    return m.groupBy("run_id", "metric").agg(F.avg("value").alias("value"))


def thresholds(spark):
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(w).alias("warning"), F.lit(c).alias("critical"), F.lit(low).alias("lower_better")) for m, w, c, low in TH])
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.*")


@query("k1_gate_rates", f"{M}, b AS (SELECT metric, item_id % 500 item, avg(value) v FROM f GROUP BY 1, 2) SELECT metric, round(avg(v), 9) mean, round(avg((v >= 0.7)::INT), 9) pass_rate FROM b WHERE v IS NOT NULL GROUP BY 1")
def k1(spark, sf):
    return rounded(S.gate_rates(long(spark, sf).withColumn("item", F.col("item_id") % 500)), "mean", "pass_rate")


def _gates(spark, sf):
    return S.gate_rates(long(spark, sf).withColumn("item", F.col("item_id") % 500), 0.5).select(F.col("metric").alias("gate"), F.col("mean").alias("score"), F.length("metric").alias("weight"), (F.col("pass_rate") >= 0.5).alias("passed"))


GATES = f"{M}, b AS (SELECT metric, item_id % 500 item, avg(value) v FROM f GROUP BY 1, 2), g AS (SELECT metric gate, avg(v) score, length(metric) weight, avg((v >= 0.5)::INT) >= 0.5 passed FROM b WHERE v IS NOT NULL GROUP BY 1)"


@query("k2_combine_gates", f"""{GATES} SELECT 'weighted' AS mode, round((sum(score * weight) / sum(weight))::DOUBLE, 9) score, sum(score * weight) / sum(weight) >= 0.6 passed FROM g UNION ALL SELECT 'all', round(min(score), 9), bool_and(passed) FROM g UNION ALL SELECT 'any', round(max(score), 9), bool_or(passed) FROM g UNION ALL SELECT 'majority', round(avg(passed::INT), 9), avg(passed::INT) >= 0.5 FROM g""")
def k2(spark, sf):
    g, out = _gates(spark, sf), None
    for mode in ("weighted", "all", "any", "majority"):
        one = S.combine_gates(g, mode).select(F.lit(mode).alias("mode"), F.round("score", 9).alias("score"), "passed")
        out = one if out is None else out.union(one)
    return out


@query("k3_adjust_thresholds", "WITH f AS (SELECT event_type gate, avg(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) b FROM events GROUP BY 1) SELECT gate, round(greatest(0, least(1, length(gate) / 10 + 0.05 * b))::DOUBLE, 9) threshold FROM f")
def k3(spark, sf):
    e = table(spark, sf, "events")
    g = e.select(F.col("event_type").alias("gate")).distinct().withColumn("threshold", F.length("gate") / 10)
    return rounded(S.adjust_thresholds(g, e.select(F.col("event_type").alias("gate"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("vote"))), "threshold")


BADGE = "CASE WHEN value IS NULL THEN 'unknown' WHEN lower_better THEN CASE WHEN value > critical THEN 'error' WHEN value > warning THEN 'warn' ELSE 'ok' END WHEN value < critical THEN 'error' WHEN value < warning THEN 'warn' ELSE 'ok' END"


@query("k4_verdict", f"{KPI}, b AS (SELECT run_id, metric, {BADGE} b FROM k JOIN th USING (metric)) SELECT run_id, CASE WHEN count(*) FILTER (WHERE b = 'error') > 0 THEN 'Blocked' WHEN count(*) FILTER (WHERE b = 'warn') > 0 THEN 'At Risk' ELSE 'Ready' END verdict, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE b IN ('error', 'warn')), '') failing FROM b GROUP BY 1")
def k4(spark, sf):
    return S.verdict(kpis(spark, sf), thresholds(spark))


@query("k5_badge", f"{KPI} SELECT run_id, metric, {BADGE} badge FROM k JOIN th USING (metric)")
def k5(spark, sf):
    j = kpis(spark, sf).join(thresholds(spark), "metric")
    return j.select("run_id", "metric", S.badge(F.col("value"), F.col("warning"), F.col("critical"), F.col("lower_better")).alias("badge"))


@query("k6_validate_thresholds", "SELECT c_custkey, CASE WHEN NOT (c_acctbal / 5000 BETWEEN 0 AND 1) OR NOT (c_nationkey / 20 BETWEEN 0 AND 1) THEN 'out of range' WHEN c_nationkey / 20 > c_acctbal / 5000 THEN 'critical above warning' END reason FROM customer")
def k6(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 5000).alias("warning"), (F.col("c_nationkey") / 20).alias("critical"))
    return S.validate_thresholds(t).select("c_custkey", "reason")


@query("k7_rank_by_gap", f"{KPI}, z AS (SELECT run_id, metric, CASE WHEN value < critical THEN 0 WHEN value < warning THEN 1 ELSE 2 END AS zone, value - CASE WHEN value < critical THEN critical ELSE warning END gap FROM k JOIN th USING (metric)) SELECT run_id, metric, zone, round(gap, 6) gap, row_number() OVER (PARTITION BY run_id ORDER BY zone, gap, metric) rank FROM z")
def k7(spark, sf):
    return rounded(S.rank_by_gap(kpis(spark, sf), thresholds(spark)), "gap", n=6)


@query("k8_insights", f"""{KPI}, w AS (SELECT run_id, avg(value) FILTER (WHERE metric = 'click') a, avg(value) FILTER (WHERE metric = 'view') b, avg(value) FILTER (WHERE metric = 'error') c FROM k GROUP BY 1),
r AS (SELECT run_id, 1 o, 'hallucination_risk' rule FROM w WHERE a < 0.49 UNION ALL SELECT run_id, 2, 'keyword_low' FROM w WHERE b < 0.5 UNION ALL SELECT run_id, 3, 'relevancy_grounding_gap' FROM w WHERE c - a > 0.02)
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY o) - 1 AS INTEGER) rank, rule FROM r""")
def k8(spark, sf):
    w = kpis(spark, sf).groupBy("run_id").pivot("metric", ["click", "view", "error"]).agg(F.avg("value")).toDF("run_id", "faithfulness", "keyword", "relevancy")
    return S.insights(w, {"faithfulness": 0.49, "keyword": 0.5, "gap": 0.02})


@query("k9_sla_check", "WITH p AS (SELECT event_type, quantile_cont(value, 0.95) p95 FROM events GROUP BY 1) SELECT event_type, round(p95, 9) p95, length(event_type)::DOUBLE * 6 budget, p95 <= length(event_type) * 6 ok FROM p")
def k9(spark, sf):
    e = table(spark, sf, "events")
    b = e.select("event_type").distinct().withColumn("budget", F.length("event_type").cast("double") * 6)
    return rounded(S.sla_check(e, "event_type", "value", b), "p95")


@query("k10_regressions", "WITH a AS (SELECT o_custkey::VARCHAR name, avg(o_totalprice) v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey::VARCHAR name, avg(o_totalprice) v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT name, round(a.v, 4) now, round(b.v, 4) \"before\" FROM a JOIN b USING (name) WHERE a.v > b.v * 1.1")
def k10(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("name"), (F.col("o_orderkey") % 2).alias("half")).agg(F.avg("o_totalprice").alias("value"))
    return rounded(S.regressions(o.where("half = 0").drop("half"), o.where("half = 1").drop("half")), "now", "before", n=4)


@query("k11_export_summary", f'{M} SELECT metric name, round(avg(value), 9) mean, quantile_cont(value, 0.5) p50, quantile_cont(value, 0.95) p95, count(value) "count" FROM f GROUP BY 1')
def k11(spark, sf):
    return rounded(S.kpi_distribution(long(spark, sf)).select(F.col("metric").alias("name"), F.col("average").alias("mean"), "p50", "p95", "count"), "mean")


@query("k12_recommendations", f"{M}, r AS (SELECT CASE WHEN metric = 'click' THEN 'overall' ELSE metric END AS name, avg((value >= 0.35)::INT) rate FROM f GROUP BY 1) SELECT name, CASE WHEN name = 'overall' THEN CASE WHEN rate < 0.5 THEN 'rework' WHEN rate < 0.7 THEN 'improve' END WHEN rate < 0.6 THEN 'focus' END advice FROM r WHERE (name = 'overall' AND rate < 0.7) OR (name <> 'overall' AND rate < 0.6)")
def k12(spark, sf):
    v = S.finite(F.col("value"))
    r = long(spark, sf).groupBy(F.when(F.col("metric") == "click", "overall").otherwise(F.col("metric")).alias("name")).agg(F.avg((v >= 0.35).cast("int")).alias("rate"))
    return S.recommendations(r)
