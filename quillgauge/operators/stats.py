"""Aggregates over long metrics (run_id, item_id, metric, value), gates and verdicts.

The quantile rule is named in each docstring: *linear* interpolates, *nearest
rank* is the smallest value with at least that share of the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import settle


def finite(c: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def sanitize(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in cols})


#: Where a quantile lies between 0 and n - 1, by rule: interpolated, the smallest value with that share of the values, or the value at the index rounded down.
RULES = {
    "linear": lambda n, q: (n - 1) * F.lit(q),
    "nearest": lambda n, q: F.greatest(F.ceil(n * F.lit(q)), F.lit(1)) - 1,
    "floor": lambda n, q: F.floor((n - 1) * F.lit(q)),
}


def quantiles(rows: DataFrame, by: str, value: Column, wanted: dict[str, float], rule: str = "linear") -> DataFrame:
    """by, and an exact quantile of each group's values under each wanted name.

    Equal values of a group are counted first, and the counts sorted into
    ranges of like size whatever the values are, so no task holds a group's
    values and an outlier has no range to itself.  Sums over the ranges tell
    which of them hold the wanted ranks; only these are looked at again.  NaN
    and null values are left out; groups without values have no row.
    """
    v = rows.select(F.col(by).alias("g"), finite(value.cast("double")).alias("v")).where("v is not null")
    counted = v.groupBy("g", "v").agg(F.count("*").alias("c"))
    placed = settle(counted.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "counted")
    per = placed.groupBy("g", "part").agg(F.sum("c").alias("c"))
    ranges = Window.partitionBy("g")  # a row a range
    before = F.coalesce(F.sum("c").over(ranges.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumns({"before": before, "n": F.sum("c").over(ranges)})
    at = [RULES[rule](F.col("n"), q) for q in wanted.values()]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in at])))
    needed = per.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("c")))).where(F.size("ranks") > 0)
    needed = needed.select(F.col("g").alias("g2"), F.col("part").alias("part2"), "before", "n", "ranks")
    values = placed.join(needed, F.col("g").eqNullSafe(F.col("g2")) & (F.col("part") == F.col("part2")))
    upto = F.sum("c").over(Window.partitionBy("g", "part").orderBy("v")) + F.col("before")
    found = values.withColumn("upto", upto).select("g", "n", "v", F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("c")))).alias("rank"))
    known = found.groupBy("g", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))  # two values a wanted one
    out = []
    for name, p in zip(wanted, at, strict=True):
        lo, hi = F.col("m")[F.floor(p)], F.col("m")[F.ceil(p)]
        out.append(F.when(F.floor(p) == F.ceil(p), lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi).alias(name))
    return known.select(F.col("g").alias(by), *out)


def with_quantiles(stats: DataFrame, q: DataFrame, by: str) -> DataFrame:
    """stats with the quantiles of its groups, null where a group has none."""
    return stats.join(q.withColumnRenamed(by, "__g"), F.col(by).eqNullSafe(F.col("__g")), "left").drop("__g")


def kpi_distribution(long: DataFrame) -> DataFrame:
    """metric, count, min, max, average, p50, p95 (linear); metrics without a value are left out."""
    v = finite(F.col("value"))
    out = long.groupBy("metric").agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("average"))
    return with_quantiles(out.where("`count` > 0"), quantiles(long, "metric", v, {"p50": 0.5, "p95": 0.95}), "metric")


def kpi_counts(long: DataFrame) -> DataFrame:
    """records, metrics, values, missing: an absent value counts as missing."""
    v = finite(F.col("value"))
    c = long.agg(F.count_distinct("item_id").alias("records"), F.count_distinct("metric").alias("metrics"), F.count(v).alias("values"))
    return c.withColumn("missing", F.col("records") * F.col("metrics") - F.col("values"))


def robust_stats(long: DataFrame, fallback: float = 0.0, least: int = 1) -> DataFrame:
    """metric, mean, std (population), min, max, valid, total; the fallback where there are too few values."""
    v = finite(F.col("value"))
    s = long.groupBy("metric").agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("valid"), F.count("*").alias("total"))
    ok = F.col("valid") >= least
    use = lambda c, alias: F.when(ok, F.col(c)).otherwise(fallback).alias(alias)
    return s.select("metric", use("m", "mean"), use("s", "std"), use("lo", "min"), use("hi", "max"), "valid", "total")


def nan_tolerance(long: DataFrame, mode: str) -> DataFrame:
    """Missing values skipped, set to 0, or set to the mean of the record's other metrics (0 where none is valid)."""
    v = finite(F.col("value"))
    if mode == "skip":
        return long.withColumn("value", v).where("value is not null")
    if mode == "zero":
        return long.withColumn("value", F.coalesce(v, F.lit(0.0)))
    if mode == "mean":
        return long.withColumn("value", F.coalesce(v, F.avg(v).over(Window.partitionBy("run_id", "item_id")), F.lit(0.0)))
    raise ValueError(f"unknown mode {mode!r}")


def latency_stats(items: DataFrame, by: str, col: str = "latency") -> DataFrame:
    """avg, p50, p90, p99 (nearest rank) of a latency column."""
    s = items.where(F.col(col).isNotNull()).groupBy(by).agg(F.avg(col).alias("avg"))
    return with_quantiles(s, quantiles(items, by, F.col(col), {"p50": 0.5, "p90": 0.9, "p99": 0.99}, "nearest"), by)


def filtered_kpis(long: DataFrame, latency: tuple[float, float], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """metric, n, mean of the values whose latency and metric are in range; a null fails a range."""
    ok = F.col("latency").between(*latency)
    v = finite(F.col("value"))
    for m, (a, b) in ranges.items():
        ok = ok & ((F.col("metric") != m) | F.coalesce(v.between(a, b), F.lit(False)))
    return long.where(ok).groupBy("metric").agg(F.count(v).alias("n"), F.avg(v).alias("mean"))


def timing_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """sum, min, max, mean, median, p95, p99 (linear)."""
    s = df.groupBy(by).agg(F.sum(col).alias("sum"), F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"))
    return with_quantiles(s, quantiles(df, by, F.col(col), {"p50": 0.5, "p95": 0.95, "p99": 0.99}), by)


def evaluation_summary(long: DataFrame, t: float = 0.7) -> DataFrame:
    """metric, mean, std (sample), min, max, pass_rate."""
    v = finite(F.col("value"))
    return long.groupBy("metric").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg((v >= t).cast("int")).alias("pass_rate"))


def describe_scores(long: DataFrame) -> DataFrame:
    v = finite(F.col("value"))
    s = long.groupBy("metric").agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return with_quantiles(s, quantiles(long, "metric", v, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "metric")


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, r, strength for each pair of columns, in one aggregate; pairs with a null are skipped."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    label = F.when(F.abs("r") > 0.7, "strong").when(F.abs("r") < 0.3, "weak").otherwise("moderate")
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("strength", label)


def suggest_thresholds(long: DataFrame, q: float = 0.7) -> DataFrame:
    """metric, threshold (linear quantile), pass_rate of it."""
    v = finite(F.col("value"))
    t = quantiles(long, "metric", v, {"threshold": q})
    return long.join(t, "metric").groupBy("metric", "threshold").agg(F.avg((v >= F.col("threshold")).cast("int")).alias("pass_rate"))


def performance_by(df: DataFrame, key: str, col: str, t: float) -> DataFrame:
    """key, mean, std (sample), count, pass_rate, with a row for all."""
    return df.rollup(key).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.count(col).alias("count"), F.avg((F.col(col) >= t).cast("int")).alias("pass_rate"))


def pass_fail(wide: DataFrame, gates: dict[str, float]) -> DataFrame:
    """criterion, passed, failed of a wide table."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), (finite(F.col(c)) >= t).alias("ok")) for c, t in gates.items()])).alias("r")
    return wide.select(rows).groupBy("r.criterion").agg(F.count_if("r.ok").alias("passed"), F.count_if(~F.coalesce("r.ok", F.lit(False))).alias("failed"))


def composition_stats(df: DataFrame, dims: list[str]) -> DataFrame:
    """dimension, value, n for each dimension on its own, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("p")
    return df.select(pairs).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def federated_mean(env: DataFrame, tenants: list[str], secret: str) -> DataFrame:
    """mean weighted by samples over trusted, correctly signed envelopes; accepted, rejected."""
    good = F.col("tenant").isin(*tenants) & (F.col("signature") == F.sha2(F.concat_ws("|", "tenant", F.col("samples").cast("string"), F.lit(secret)), 256))
    good = F.coalesce(good, F.lit(False))
    return env.agg((F.sum(F.when(good, F.col("score") * F.col("samples"))) / F.sum(F.when(good, F.col("samples")))).alias("mean"), F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"))


def profile_values(df: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """column, value, n, rank, numeric of the most frequent values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("p")
    counts = df.select(pairs).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", r).where(F.col("rank") <= k).withColumn("numeric", F.expr("try_cast(value as double) is not null"))


def pivot_scores(long: DataFrame, metrics: list[str]) -> DataFrame:
    """item key and a column for each metric with its mean."""
    return long.withColumn("value", finite(F.col("value"))).groupBy("item").pivot("metric", metrics).agg(F.avg("value"))


METRIC_ALIASES = {
    "context_precision": "ContextPrecision", "context_recall": "ContextRecall", "faithfulness": "Faithfulness", "answer_relevancy": "AnswerRelevancy",
    "answer_similarity": "AnswerSimilarity", "contextual_keyword_mean": "ContextualKeywordMean",
}
#: Names of an item's id, its latency, and columns that hold metrics by name, each in the order they are tried (fixed values).
ID_NAMES = ("id", "index", "sample_id", "row_id", "question_id")
LATENCY_NAMES = ("latencyMs", "latency_ms", "latency", "response_time_ms", "inference_latency_ms")
NESTED_NAMES = ("metrics", "scores", "kpis")


def first_of(df: DataFrame, names: tuple[str, ...], kind: str) -> Column:
    """The first value that is there and can be read as the type."""
    there = [n for n in names if n in df.columns]
    return F.coalesce(*[F.expr(f"try_cast(`{n}` as {kind})") for n in there], F.lit(None).cast(kind))


def normalize_items(df: DataFrame, aliases: dict[str, str] = METRIC_ALIASES) -> DataFrame:
    """id, latency_ms, metric, value of every metric of an item.

    Known names and their aliases keep any number; other numeric columns and
    the entries of nested maps count where they lie in [0, 1].  Of a metric
    found twice the first stays: known names, aliases, columns, maps.
    """
    kinds = dict(df.dtypes)
    entry = lambda name, v, sure: F.struct(F.lit(name).alias("metric"), finite(v.cast("double")).alias("value"), F.lit(sure).alias("sure"))
    known = [entry(m, F.expr(f"try_cast(`{c}` as double)"), True) for c, m in [*((m, m) for m in aliases.values()), *aliases.items()] if c in kinds]
    reserved = {*ID_NAMES, *LATENCY_NAMES, *NESTED_NAMES, *aliases, *aliases.values()}
    others = [entry(c, F.col(f"`{c}`"), False) for c, t in df.dtypes if c not in reserved and (t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal"))]
    nested = [F.transform(F.map_entries(c), lambda e: F.struct(e.key.alias("metric"), finite(e.value.try_cast("double")).alias("value"), F.lit(False).alias("sure"))) for c in NESTED_NAMES if kinds.get(c, "").startswith("map<")]
    found = F.concat(F.array(*known, *others), *[F.coalesce(n, F.array().cast("array<struct<metric:string,value:double,sure:boolean>>")) for n in nested])
    found = F.filter(found, lambda x: x.value.isNotNull() & (x.sure | x.value.between(0, 1)))
    rows = df.select(F.coalesce(first_of(df, ID_NAMES, "string"), F.lit("")).alias("id"), first_of(df, LATENCY_NAMES, "double").alias("latency_ms"), found.alias("f"))
    first = F.filter("f", lambda x, i: F.array_position(F.transform("f", lambda y: y.metric), x.metric) == i + 1)
    return rows.select("id", "latency_ms", F.explode(first).alias("r")).select("id", "latency_ms", "r.metric", "r.value")


def metric_coverage(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    """metric, coverage: share of values among the first n rows by the first column (the sample is the feature)."""
    some = df.orderBy(df.columns[0]).limit(n)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), finite(F.col(c).cast("double")).alias("v")) for c in cols])).alias("r")
    return some.select(rows).groupBy("r.metric").agg((F.count("r.v") / F.count("*")).alias("coverage"))


def failure_breakdown(wide: DataFrame, gates: dict[str, float]) -> DataFrame:
    """criterion, n among items that fail at least one."""
    fails = F.filter(F.array(*[F.when(~F.coalesce(F.col(c) >= t, F.lit(False)), F.lit(c)) for c, t in gates.items()]), lambda x: x.isNotNull())
    return wide.select(F.explode(fails).alias("criterion")).groupBy("criterion").agg(F.count("*").alias("n"))


def synthesizer_usage(samples: DataFrame, k: int = 3) -> DataFrame:
    """synthesizer, n, first questions joined."""
    r = F.row_number().over(Window.partitionBy("synthesizer").orderBy("id"))
    first = samples.withColumn("r", r).where(F.col("r") <= k).groupBy("synthesizer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "question"))), lambda x: x.question), " | ").alias("examples"))
    return samples.groupBy("synthesizer").agg(F.count("*").alias("n")).join(first, "synthesizer")


# gates and verdicts


def gate_rates(long: DataFrame, t: float = 0.7) -> DataFrame:
    """metric, mean, pass_rate: averaged by item first, then the share of items that reach t."""
    by_item = long.withColumn("value", finite(F.col("value"))).groupBy("metric", "item").agg(F.avg("value").alias("v")).where("v is not null")
    return by_item.groupBy("metric").agg(F.avg("v").alias("mean"), F.avg((F.col("v") >= t).cast("int")).alias("pass_rate"))


def combine_gates(gates: DataFrame, mode: str, pass_at: float = 0.6) -> DataFrame:
    """One row score, passed, from gates (gate, score, weight, passed)."""
    w = F.sum(F.col("score") * F.col("weight")) / F.sum("weight")
    share = F.avg(F.col("passed").cast("int"))
    modes = {"weighted": (w, w >= pass_at), "all": (F.min("score"), F.min("passed")), "any": (F.max("score"), F.max("passed")), "majority": (share, share >= 0.5)}
    if mode not in modes:
        raise ValueError(f"unknown gate mode {mode!r}")
    score, ok = modes[mode]
    return gates.agg(score.alias("score"), ok.alias("passed"))


def adjust_thresholds(gates: DataFrame, feedback: DataFrame, step: float = 0.05) -> DataFrame:
    """gate, threshold raised or lowered by the balance of its feedback, within 0 and 1."""
    f = feedback.groupBy("gate").agg(F.avg("vote").alias("balance"))
    return gates.join(f, "gate", "left").select("gate", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("threshold") + step * F.coalesce("balance", F.lit(0.0)))).alias("threshold"))


def badge(value: Column, warning: Column, critical: Column, lower_better: Column) -> Column:
    v, w, c = (F.when(lower_better, -x).otherwise(x) for x in (value, warning, critical))
    return F.when(value.isNull(), "unknown").when(v < c, "error").when(v < w, "warn").otherwise("ok")


def verdict(kpis: DataFrame, thresholds: DataFrame, direction_aware: bool = True) -> DataFrame:
    """run_id, verdict, failing; kpis: run_id, metric, value; thresholds: metric, warning, critical, lower_better."""
    low = F.col("lower_better") if direction_aware else F.lit(False)
    j = kpis.join(thresholds, "metric").withColumn("b", badge(F.col("value"), F.col("warning"), F.col("critical"), low))
    out = j.groupBy("run_id").agg(F.count_if(F.col("b") == "error").alias("e"), F.count_if(F.col("b") == "warn").alias("w"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("b").isin("error", "warn"), F.col("metric")))), ",").alias("failing"))
    return out.select("run_id", F.when(F.col("e") > 0, "Blocked").when(F.col("w") > 0, "At Risk").otherwise("Ready").alias("verdict"), "failing")


def validate_thresholds(df: DataFrame) -> DataFrame:
    bad = F.when(~F.col("warning").between(0, 1) | ~F.col("critical").between(0, 1), "out of range").when(F.col("critical") > F.col("warning"), "critical above warning")
    return df.withColumn("reason", bad).withColumn("ok", F.col("reason").isNull())


def rank_by_gap(kpis: DataFrame, thresholds: DataFrame) -> DataFrame:
    """run_id, metric, zone, gap, rank: critical first, then warning, each by how far below."""
    j = kpis.join(thresholds, "metric")
    zone = F.when(F.col("value") < F.col("critical"), 0).when(F.col("value") < F.col("warning"), 1).otherwise(2)
    gap = F.col("value") - F.when(zone == 0, F.col("critical")).otherwise(F.col("warning"))
    r = F.row_number().over(Window.partitionBy("run_id").orderBy("zone", "gap", "metric"))
    return j.select("run_id", "metric", zone.alias("zone"), gap.alias("gap")).withColumn("rank", r)


def sla_check(df: DataFrame, by: str, col: str, budgets: DataFrame) -> DataFrame:
    """by, p95 (linear), budget, ok."""
    p = quantiles(df, by, F.col(col), {"p95": 0.95})
    return p.join(budgets, by).withColumn("ok", F.col("p95") <= F.col("budget"))


def regressions(cur: DataFrame, base: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """name, now, before of benchmarks that grew by more than the tolerance."""
    j = cur.withColumnRenamed("value", "now").join(base.withColumnRenamed("value", "before"), "name")
    return j.where(F.col("now") > F.col("before") * (1 + tolerance))


def recommendations(rates: DataFrame) -> DataFrame:
    """name, advice for pass rates: the overall one below 0.5 or 0.7, others below 0.6."""
    overall = F.col("name") == "overall"
    advice = F.when(overall & (F.col("rate") < 0.5), "rework").when(overall & (F.col("rate") < 0.7), "improve").when(~overall & (F.col("rate") < 0.6), "focus")
    return rates.withColumn("advice", advice).where("advice is not null").select("name", "advice")


def insights(kpis: DataFrame, thresholds: dict[str, float], k: int = 3) -> DataFrame:
    """run_id, rule, rank from a wide table of faithfulness, keyword, relevancy."""
    gap = F.col("relevancy") - F.col("faithfulness")
    rules = F.array(
        F.struct(F.lit(1).alias("o"), F.when(F.col("faithfulness") < thresholds["faithfulness"], "hallucination_risk").alias("rule")),
        F.struct(F.lit(2).alias("o"), F.when(F.col("keyword") < thresholds["keyword"], "keyword_low").alias("rule")),
        F.struct(F.lit(3).alias("o"), F.when(gap > thresholds["gap"], "relevancy_grounding_gap").alias("rule")),
    )
    hit = kpis.select("run_id", F.posexplode(F.slice(F.filter(rules, lambda r: r.rule.isNotNull()), 1, k)).alias("rank", "r"))
    return hit.select("run_id", "rank", "r.rule")
