"""Queries for aggregates and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from . import inputs as I
from .registry import query, table

M = f"WITH {I.METRICS_SQL}, f AS (SELECT run_id, item_id, metric, CASE WHEN isnan(value) THEN NULL ELSE value END AS value, latency FROM m)"
LONG = "wide AS (SELECT event_id id, value / 50 a, (event_id * 31 % 100) / 100 b, (event_id * 17 % 100) / 100 + value / 1000 c, event_type, user_id FROM events)"


def long(spark, sf):
    return I.metrics(spark, sf)


def wide(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(e.alias("id"), (F.col("value") / 50).alias("a"), ((e * 31 % 100) / 100).alias("b"), ((e * 17 % 100) / 100 + F.col("value") / 1000).alias("c"), "event_type", "user_id")


def rounded(df, *cols, n=9):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("j1_sanitize", f"{M} SELECT item_id, value FROM f")
def j1(spark, sf):
    return S.sanitize(long(spark, sf), ["value"]).select("item_id", "value")


@query("j2_kpi_distribution", f'{M} SELECT metric, count(value) "count", min(value) "min", max(value) "max", round(avg(value), 9) average, quantile_cont(value, 0.5) p50, quantile_cont(value, 0.95) p95 FROM f GROUP BY metric')
def j2(spark, sf):
    return rounded(S.kpi_distribution(long(spark, sf)), "average")


@query("j3_kpi_counts", f'{M} SELECT count(DISTINCT item_id) records, count(DISTINCT metric) metrics, count(value) "values", count(DISTINCT item_id) * count(DISTINCT metric) - count(value) missing FROM f')
def j3(spark, sf):
    return S.kpi_counts(long(spark, sf))


@query("j4_robust_stats", f'{M} SELECT metric, round(avg(value), 9) mean, round(stddev_pop(value), 9) std, min(value) "min", max(value) "max", count(value) valid, count(*) total FROM f GROUP BY metric')
def j4(spark, sf):
    return rounded(S.robust_stats(long(spark, sf)), "mean", "std")


@query("j5_nan_tolerance", f"{M} SELECT item_id, seq, round(coalesce(value, avg(value) OVER (PARTITION BY item_id), 0), 9) AS value FROM (SELECT item_id // 4 item_id, item_id seq, value FROM f)")
def j5(spark, sf):
    records = long(spark, sf).select(F.lit("all").alias("run_id"), F.floor(F.col("item_id") / 4).alias("item_id"), F.col("item_id").alias("seq"), "metric", "value")
    return rounded(S.nan_tolerance(records, "mean"), "value").select("item_id", "seq", "value")


@query("j6_latency_stats", "SELECT event_type metric, round(avg(value), 9) avg, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.9) p90, quantile_disc(value, 0.99) p99 FROM events GROUP BY 1")
def j6(spark, sf):
    return rounded(S.latency_stats(long(spark, sf), "metric"), "avg")


@query("j7_filtered_kpis", f"{M} SELECT metric, count(value) n, round(avg(value), 9) mean FROM f WHERE latency BETWEEN 5 AND 40 AND (metric <> 'click' OR coalesce(value BETWEEN 0.2 AND 0.9, false)) GROUP BY metric")
def j7(spark, sf):
    return rounded(S.filtered_kpis(long(spark, sf), (5, 40), {"click": (0.2, 0.9)}), "mean")


@query("j8_timing_stats", 'SELECT event_type, round(sum(value), 6) "sum", min(value) "min", max(value) "max", round(avg(value), 9) mean, round(quantile_cont(value, 0.5), 9) p50, round(quantile_cont(value, 0.95), 9) p95, round(quantile_cont(value, 0.99), 9) p99 FROM events GROUP BY 1')
def j8(spark, sf):
    return rounded(rounded(S.timing_stats(table(spark, sf, "events"), "event_type", "value"), "mean", "p50", "p95", "p99"), "sum", n=6)


@query("j9_evaluation_summary", f'{M} SELECT metric, round(avg(value), 9) mean, round(stddev_samp(value), 9) std, min(value) "min", max(value) "max", round(avg((value >= 0.7)::INT), 9) pass_rate FROM f GROUP BY metric')
def j9(spark, sf):
    return rounded(S.evaluation_summary(long(spark, sf)), "mean", "std", "pass_rate")


@query("j10_describe_scores", f'{M} SELECT metric, count(value) "count", round(avg(value), 9) mean, round(stddev_samp(value), 9) std, min(value) "min", quantile_cont(value, 0.25) q25, quantile_cont(value, 0.5) q50, quantile_cont(value, 0.75) q75, max(value) "max" FROM f GROUP BY metric')
def j10(spark, sf):
    return rounded(S.describe_scores(long(spark, sf)), "mean", "std")


@query("j11_correlation_matrix", f"""WITH {LONG}, r AS (SELECT 'a' a, 'b' b, corr(a, b) r FROM wide UNION ALL SELECT 'a', 'c', corr(a, c) FROM wide UNION ALL SELECT 'b', 'c', corr(b, c) FROM wide)
SELECT a, b, round(r, 8) r, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) < 0.3 THEN 'weak' ELSE 'moderate' END strength FROM r""")
def j11(spark, sf):
    return rounded(S.correlation_matrix(wide(spark, sf), ["a", "b", "c"]), "r", n=8)


@query("j12_suggest_thresholds", f"{M}, t AS (SELECT metric, quantile_cont(value, 0.7) threshold FROM f GROUP BY 1) SELECT metric, round(threshold, 9) threshold, round(avg((value >= threshold)::INT), 9) pass_rate FROM f JOIN t USING (metric) GROUP BY 1, threshold")
def j12(spark, sf):
    return rounded(S.suggest_thresholds(long(spark, sf)), "threshold", "pass_rate")


@query("j13_performance_by", 'SELECT o_orderpriority, round(avg(o_totalprice), 4) mean, round(stddev_samp(o_totalprice), 4) std, count(o_totalprice) "count", round(avg((o_totalprice >= 100000)::INT), 9) pass_rate FROM orders GROUP BY ROLLUP (o_orderpriority)')
def j13(spark, sf):
    return rounded(rounded(S.performance_by(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", 100000), "pass_rate"), "mean", "std", n=4)


@query("j14_pass_fail", f"WITH {LONG} SELECT 'a' criterion, count(*) FILTER (WHERE a >= 0.3) passed, count(*) FILTER (WHERE NOT coalesce(a >= 0.3, false)) failed FROM wide UNION ALL SELECT 'b', count(*) FILTER (WHERE b >= 0.5), count(*) FILTER (WHERE NOT coalesce(b >= 0.5, false)) FROM wide")
def j14(spark, sf):
    return S.pass_fail(wide(spark, sf), {"a": 0.3, "b": 0.5})


@query("j15_composition_stats", "SELECT 'c_mktsegment' \"dimension\", c_mktsegment AS value, count(*) n FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY 2")
def j15(spark, sf):
    return S.composition_stats(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


@query("j16_federated_mean", "WITH e AS (SELECT 't' || c_nationkey % 4 tenant, c_custkey samples, c_acctbal score, c_custkey % 6 = 0 forged FROM customer) SELECT round((sum(score * samples) FILTER (WHERE tenant IN ('t0', 't1') AND NOT forged) / sum(samples) FILTER (WHERE tenant IN ('t0', 't1') AND NOT forged))::DOUBLE, 6) mean, count(*) FILTER (WHERE tenant IN ('t0', 't1') AND NOT forged) accepted, count(*) FILTER (WHERE NOT (tenant IN ('t0', 't1') AND NOT forged)) rejected FROM e")
def j16(spark, sf):
    e = table(spark, sf, "customer").select(F.concat(F.lit("t"), F.col("c_nationkey") % 4).alias("tenant"), F.col("c_custkey").alias("samples"), F.col("c_acctbal").alias("score"))
    sig = F.sha2(F.concat_ws("|", "tenant", F.col("samples").cast("string"), F.lit("key")), 256)
    e = e.withColumn("signature", F.when(F.col("samples") % 6 == 0, "forged").otherwise(sig))
    return rounded(S.federated_mean(e, ["t0", "t1"], "key"), "mean", n=6)


@query("j17_profile_values", """WITH u AS (SELECT 'p_brand' "column", p_brand AS value FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part), c AS (SELECT "column", value, count(*) n FROM u GROUP BY 1, 2)
SELECT *, try_cast(value AS DOUBLE) IS NOT NULL "numeric" FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) rank FROM c) WHERE rank <= 5""")
def j17(spark, sf):
    return S.profile_values(table(spark, sf, "part"), ["p_brand", "p_size"])


@query("j18_pivot_scores", f"{M} SELECT item_id % 500 item, round(avg(value) FILTER (WHERE metric = 'click'), 9) click, round(avg(value) FILTER (WHERE metric = 'view'), 9) AS view FROM f GROUP BY 1")
def j18(spark, sf):
    return rounded(S.pivot_scores(long(spark, sf).withColumn("item", F.col("item_id") % 500), ["click", "view"]), "click", "view")


@query("j19_normalize_items", f"""
WITH {LONG}, i AS (SELECT CASE WHEN id % 3 <> 0 THEN id::VARCHAR ELSE event_type END id, CASE WHEN id % 2 = 0 THEN user_id ELSE b * 100 END::DOUBLE latency_ms, a, b, c FROM wide)
SELECT id, latency_ms, 'Faithfulness' metric, a AS value FROM i UNION ALL SELECT id, latency_ms, 'b', b FROM i WHERE b BETWEEN 0 AND 1 UNION ALL SELECT id, latency_ms, 'c', c FROM i WHERE c BETWEEN 0 AND 1 UNION ALL SELECT id, latency_ms, 'nested', (a + b) / 2 FROM i WHERE (a + b) / 2 BETWEEN 0 AND 1""")
def j19(spark, sf):
    w, i = wide(spark, sf), F.col("id")
    nested = F.create_map(F.lit("b"), F.lit(0.5), F.lit("nested"), (F.col("a") + F.col("b")) / 2)
    return S.normalize_items(w.select(F.when(i % 3 != 0, i).alias("index"), F.col("event_type").alias("sample_id"), F.col("a").alias("faithfulness"), "b", "c", F.when(i % 2 == 0, F.col("user_id")).alias("latency_ms"), (F.col("b") * 100).alias("latency"), nested.alias("scores")))


@query("j20_metric_coverage", f"WITH {LONG}, s AS (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE a END a, b FROM wide ORDER BY id LIMIT 1000) SELECT 'a' metric, count(a) / count(*) coverage FROM s UNION ALL SELECT 'b', count(b) / count(*) FROM s")
def j20(spark, sf):
    w = wide(spark, sf).select("id", F.when(F.col("id") % 3 != 0, F.col("a")).alias("a"), "b")
    return S.metric_coverage(w, ["a", "b"], 1000)


@query("j21_failure_breakdown", f"WITH {LONG} SELECT 'a' criterion, count(*) n FROM wide WHERE NOT coalesce(a >= 0.3, false) UNION ALL SELECT 'b', count(*) FROM wide WHERE NOT coalesce(b >= 0.5, false)")
def j21(spark, sf):
    return S.failure_breakdown(wide(spark, sf), {"a": 0.3, "b": 0.5})


@query("j22_synthesizer_usage", f"WITH {I.ITEMS_SQL}, s AS (SELECT item_id id, 'syn' || conv_id % 4 synthesizer, question FROM items), r AS (SELECT *, row_number() OVER (PARTITION BY synthesizer ORDER BY id) r FROM s) SELECT synthesizer, count(*) n, string_agg(question, ' | ' ORDER BY r) FILTER (WHERE r <= 3) examples FROM r GROUP BY 1")
def j22(spark, sf):
    return S.synthesizer_usage(I.items(spark, sf).select(F.col("item_id").alias("id"), F.concat(F.lit("syn"), F.col("conv_id") % 4).alias("synthesizer"), "question"))
