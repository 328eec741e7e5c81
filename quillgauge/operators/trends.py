"""Windows over runs: drift, deltas, anomalies, comparison and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import quantiles, with_quantiles

#: Metrics that drift is tested on, with their better direction (fixed values).
DIRECTIONS = {"entity_overlap": "higher", "structural_connectivity": "higher", "hub_noise_penalty": "lower"}


def drift_windows(runs: DataFrame, recent: int = 50, baseline: int = 100, least: int = 5) -> DataFrame:
    """runs (run_id, metrics) with part: baseline, recent or null; null for all of fewer than least + 1 runs.

    Run records are one row a run, so their order is a window over all of them.
    """
    n = F.row_number().over(Window.orderBy("run_id"))
    rows = runs.withColumn("rn", n)
    size = runs.agg(F.count("*").alias("total"))
    split = F.greatest(F.lit(least), F.col("total") - recent)
    part = F.when(F.col("total") < least + 1, None).when(F.col("rn") > F.greatest(split, F.col("total") - recent), "recent").when((F.col("rn") <= split) & (F.col("rn") > split - baseline), "baseline")
    return rows.join(F.broadcast(size)).withColumn("part", part).drop("rn")  # one row


def drift_metrics(runs: DataFrame, directions: dict[str, str] = DIRECTIONS, z_at: float = 2.0) -> DataFrame:
    """metric, baseline_mean, recent_mean, baseline_std (sample; 1e-9 for zero), z_score, delta_pct, flagged."""
    w = drift_windows(runs)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v"), F.lit(d == "lower").alias("low")) for m, d in directions.items()])).alias("p")
    long = w.select("part", pairs).select("part", "p.*").where("v is not null and not isnan(v) and part is not null")
    base, rec = F.when(F.col("part") == "baseline", F.col("v")), F.when(F.col("part") == "recent", F.col("v"))
    s = long.groupBy("metric", "low").agg(F.avg(base).alias("b"), F.avg(rec).alias("r"), F.stddev_samp(base).alias("s"), F.count(base).alias("nb"), F.count(rec).alias("k")).where("nb >= 2 and k >= 1")
    sd = F.when(F.col("s") <= 1e-12, F.lit(1e-9)).otherwise(F.col("s"))
    z = (F.col("r") - F.col("b")) / (sd / F.sqrt("k"))
    return s.select(
        "metric", F.col("b").alias("baseline_mean"), F.col("r").alias("recent_mean"), sd.alias("baseline_std"), z.alias("z_score"),
        F.when(F.col("b") != 0, (F.col("r") - F.col("b")) / F.col("b") * 100).otherwise(0.0).alias("delta_pct"), F.when(F.col("low"), z > z_at).otherwise(z < -z_at).alias("flagged"),
    )


def drift_status(metrics: DataFrame, runs: DataFrame, least: int = 5) -> DataFrame:
    flags = metrics.agg(F.count_if("flagged").alias("flags"))
    n = runs.agg(F.count("*").alias("runs"))
    status = F.when(F.col("runs") < least + 1, "INSUFFICIENT_DATA").when(F.col("flags") == 0, "HEALTHY").when(F.col("flags") == 1, "WARNING").otherwise("DRIFTING")
    return n.join(F.broadcast(flags)).select("runs", "flags", status.alias("status"))  # one row each


def run_deltas(runs: DataFrame, cols: list[str]) -> DataFrame:
    w = Window.orderBy("run_id")
    return runs.select("run_id", *[F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)).alias(f"{c}_delta") for c in cols])


def recent_means(runs: DataFrame, cols: list[str], ns=(3, 5, 10), keep: int = 50) -> DataFrame:
    r = runs.withColumn("r", F.row_number().over(Window.orderBy(F.desc("run_id")))).where(F.col("r") <= keep)
    grid = r.select(F.explode(F.array(*map(F.lit, ns))).alias("n"), "r", *cols).where("r <= n")
    return grid.groupBy("n").agg(*[F.avg(c).alias(c) for c in cols])


def run_trends(events: DataFrame, by: Column) -> DataFrame:
    """run_id, p50, p95 (linear), mean latency, share of fallbacks, errors."""
    e = events.withColumn("run_id", by)
    s = e.groupBy("run_id").agg(F.avg("value").alias("mean"), F.avg((~F.col("event_type").isin("view", "click")).cast("int")).alias("fallback"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return with_quantiles(s, quantiles(e, "run_id", F.col("value"), {"p50": 0.5, "p95": 0.95}), "run_id")


def run_anomalies(trends: DataFrame, cols: list[str]) -> DataFrame:
    """run_id, flags (names), severity: above the mean plus the population deviation of all runs."""
    stats = trends.agg(*[(F.avg(c) + F.stddev_pop(c)).alias(f"{c}_t") for c in cols])
    j = trends.join(F.broadcast(stats))  # one row
    flags = F.array_compact(F.array(*[F.when(F.col(c) > F.col(f"{c}_t"), F.lit(c)) for c in cols]))
    sev = F.when(F.size("flags") == 0, "none").when(F.size("flags") == 1, "low").when(F.size("flags") == 2, "medium").otherwise("high")
    return j.withColumn("flags", flags).select("run_id", F.array_join("flags", ",").alias("flags"), sev.alias("severity"))


def regression_labels(deltas: DataFrame, latency: str, fallback: str) -> DataFrame:
    lab = F.array_compact(F.array(
        F.when(F.col(latency) > 0.2, "latency_regression"), F.when(F.col(latency) < -0.2, "latency_improvement"), F.when(F.col(fallback) > 0.1, "fallback_regression"), F.when(F.col(fallback) < -0.1, "fallback_improvement"),
    ))
    return deltas.select("run_id", F.array_join(lab, ",").alias("labels"))


def issue_clusters(anomalies: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster (severity:labels), n, runs."""
    j = anomalies.join(labels, "run_id")
    return j.groupBy(F.concat_ws(":", "severity", "labels").alias("cluster")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("run_id")), ",").alias("runs"))


SEVERITY = {"high": 0, "medium": 1, "low": 2, "none": 3}


def triage(anomalies: DataFrame) -> DataFrame:
    order = F.coalesce(*[F.when(F.col("severity") == s, F.lit(n)) for s, n in SEVERITY.items()])
    return anomalies.withColumn("position", F.row_number().over(Window.orderBy(order, "run_id")))


def search_runs(anomalies: DataFrame, text: str = "", severity: str | None = None, k: int = 50) -> DataFrame:
    hit = F.concat_ws(" ", "run_id", "flags", "severity").contains(text)
    if severity:
        hit = hit & (F.col("severity") == severity)
    return anomalies.where(hit).orderBy("run_id").limit(k)


def run_diff(wide: DataFrame, a: str, b: str, cols: list[str]) -> DataFrame:
    """field, a, b, delta."""
    one = wide.where(F.col("run_id").isin(a, b)).agg(*[F.max(F.when(F.col("run_id") == r, F.col(c))).alias(f"{c}_{s}") for c in cols for r, s in ((a, "a"), (b, "b"))])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_a").cast("double").alias("a"), F.col(f"{c}_b").cast("double").alias("b")) for c in cols])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("delta", F.col("b") - F.col("a"))


def floor_index(values: Column, q: float) -> Column:
    """The value at index floor(q·(n−1)) of a sorted array."""
    return F.get(values, F.floor((F.size(values) - 1) * q).cast("int"))


def compare_runs(long: DataFrame, base: str) -> DataFrame:
    """metric, run_id, n, na_pct, mean, median, p90 (floor index), delta and delta_pct to the base run."""
    from .stats import finite

    v = finite(F.col("value"))
    rows = long.withColumn("of", F.struct("metric", "run_id"))
    s = rows.groupBy("of").agg(F.count(v).alias("n"), (F.count_if(v.isNull()) / F.count("*") * 100).alias("na_pct"), F.avg(v).alias("mean"))
    s = with_quantiles(s, quantiles(rows, "of", v, {"median": 0.5, "p90": 0.9}, "floor"), "of").select("of.metric", "of.run_id", "n", "na_pct", "mean", "median", "p90")
    b = s.where(F.col("run_id") == base).select("metric", F.col("mean").alias("base_mean"))
    j = s.join(b, "metric", "left").withColumn("delta", F.col("mean") - F.col("base_mean"))
    return j.withColumn("delta_pct", F.when(F.col("base_mean") != 0, F.col("delta") / F.col("base_mean") * 100)).drop("base_mean")


def metric_histogram(long: DataFrame, bins: int = 20) -> DataFrame:
    from .stats import finite

    v = finite(F.col("value"))
    return long.where(v.between(0, 1)).groupBy("run_id", "metric", F.least(F.floor(v * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def box_stats(long: DataFrame) -> DataFrame:
    """run_id, metric, q1, median, q3 (floor index), lo, hi fences at 1.5 IQR."""
    from .stats import finite

    rows = long.withColumn("of", F.struct("run_id", "metric"))
    s = quantiles(rows, "of", finite(F.col("value")), {"q1": 0.25, "median": 0.5, "q3": 0.75}, "floor").select("of.run_id", "of.metric", "q1", "median", "q3")
    iqr = F.col("q3") - F.col("q1")
    return s.withColumns({"lo": F.col("q1") - 1.5 * iqr, "hi": F.col("q3") + 1.5 * iqr})


def outliers(long: DataFrame) -> DataFrame:
    from .stats import finite

    rows = long.withColumn("v", finite(F.col("value"))).where("v is not null")
    return rows.join(box_stats(long), ["run_id", "metric"]).where((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))).select("run_id", "metric", "item_id", "v")


def cohorts(long: DataFrame, warnings: dict[str, float]) -> DataFrame:
    """cohort, n items: success (all metrics at their warning level) or each failing metric."""
    from .stats import finite

    t = F.coalesce(*[F.when(F.col("metric") == m, F.lit(w)) for m, w in warnings.items()])
    ok = F.coalesce(finite(F.col("value")) >= t, F.lit(False))
    by = long.where(t.isNotNull()).groupBy("item").agg(F.bool_and(ok).alias("ok"), F.collect_set(F.when(~ok, F.col("metric"))).alias("failing"))
    kinds = F.when(F.col("ok"), F.array(F.lit("success"))).otherwise(F.transform("failing", lambda m: F.concat(F.lit("failing:"), m)))
    return by.select(F.explode(kinds).alias("cohort")).groupBy("cohort").agg(F.count("*").alias("n"))


def metric_pairs(long: DataFrame, x: str, y: str) -> DataFrame:
    """item, x, y of items that have both metrics (means where an item has several values)."""
    from .stats import finite

    v = long.withColumn("v", finite(F.col("value"))).where("v is not null")
    side = lambda m, name: v.where(F.col("metric") == m).groupBy("item").agg(F.avg("v").alias(name))
    return side(x, "x").join(side(y, "y"), "item")


def worst_items(long: DataFrame, metric: str, k: int) -> DataFrame:
    from .stats import finite

    return long.where(F.col("metric") == metric).select("item_id", finite(F.col("value")).alias("value")).orderBy(F.asc_nulls_last("value"), "item_id").limit(k)


def sample_items(df: DataFrame, n: int, seed: int, key: str = "item_id") -> DataFrame:
    """n rows, the same for the same seed: the first by a hash."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def active_runs(runs: DataFrame) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("testset", "profile").orderBy(F.desc("created_at"), F.desc("run_id")))
    return runs.where(F.col("status").isin("pending", "running")).withColumn("r", r).where("r = 1").drop("r")


ALLOWED = [("pending", "running"), ("running", "completed"), ("running", "failed"), ("pending", "failed")]


def illegal_transitions(log: DataFrame) -> DataFrame:
    """run_id, seq, before, status of steps that are not allowed."""
    before = F.lag("status").over(Window.partitionBy("run_id").orderBy("seq"))
    j = log.withColumn("before", before).where("before is not null")
    ok = F.concat_ws(">", "before", "status").isin(*[f"{a}>{b}" for a, b in ALLOWED])
    return j.where(~ok).select("run_id", "seq", "before", "status")
