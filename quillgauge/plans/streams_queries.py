"""Queries for the streaming operators: the events table as a stream where the operator is one, else as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.trends import drift_metrics, drift_status
from ..streaming import envelopes as V
from ..streaming import events as E
from ..streaming import stateful as S
from .io_queries import _folder
from .registry import ORACLE_SQL, query, table
from .trends_queries import runs

DRIFT_STATUS_SQL = ORACLE_SQL["l3_drift_status"]

NAMES = ("document.ingested", "document.processed", "testset.created", "run.completed", "report.completed")
NAME_SQL = "CASE event_id % 5 WHEN 0 THEN 'document.ingested' WHEN 1 THEN 'document.processed' WHEN 2 THEN 'testset.created' WHEN 3 THEN 'run.completed' ELSE 'report.completed' END"


def named(e):
    return e.select("event_id", "user_id", "ts", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 5 + 1).cast("int")).alias("event"), "value")


def stream(spark, sf):
    """The events table as a stream of its files, copied to a folder of their own."""
    path = _folder(spark, sf, "stream")
    table(spark, sf, "events").write.parquet(path)
    return spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 4).parquet(path)


@query("s1_valid_envelopes", f"SELECT {NAME_SQL} AS event, event_id seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_id % 10 NOT IN (3, 7)")
def s1(spark, sf):
    e = named(table(spark, sf, "events"))
    seq = F.when(F.col("event_id") % 10 == 3, -1).otherwise(F.col("event_id"))
    raw = e.select(F.when(F.col("event_id") % 10 == 7, "no envelope").otherwise(F.to_json(F.struct("event", seq.alias("seq"), F.col("ts").alias("timestamp")))).alias("value"))
    return E.valid_envelopes(raw).select("event", "seq", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("s2_topic_filter", f"SELECT event_id FROM events WHERE {NAME_SQL} LIKE 'document.%' OR {NAME_SQL} LIKE 'run.%'")
def s2(spark, sf):
    return E.topic_filter(named(table(spark, sf, "events")), ["document", "run"]).select("event_id")


GAPS_SQL = "WITH k AS (SELECT user_id source, (event_id // 50) seq FROM events), r AS (SELECT source, min(seq) a, max(seq) b FROM k GROUP BY 1), s AS (SELECT source, unnest(range(a, b + 1)) seq FROM r) SELECT source, seq missing FROM s WHERE (source, seq) NOT IN (SELECT (source, seq) FROM k)"


@query("s3_sequence_gaps", GAPS_SQL)
def s3(spark, sf):
    return E.sequence_gaps(table(spark, sf, "events").select(F.col("user_id").alias("source"), F.floor(F.col("event_id") / 50).alias("seq")))


@query("s3_stream_sequence_gaps", GAPS_SQL)
def s3s(spark, sf):
    """What the stream told: the numbers of its gaps that were not filled later."""
    e = stream(spark, sf).select(F.col("user_id").alias("source"), F.floor(F.col("event_id") / 50).alias("seq"), F.col("ts").cast("timestamp").alias("timestamp"))
    told = E.run_to_end(spark, E.stream_sequence_gaps(e), _folder(spark, sf, "gaps"), _folder(spark, sf, "state"))
    return E.open_numbers(told)


@query("s4_stale_sources", """
WITH e AS (SELECT event_type source, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) b FROM events), g AS (SELECT *, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 30 SECONDS THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM e)
SELECT source, count(*) n FROM g GROUP BY source, s""")
def s4(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("timestamp"))
    return E.stale_sources(e).select("source", "n")


@query("s5_stream_items", "SELECT event_id, value FROM events")
def s5(spark, sf):
    path = _folder(spark, sf, "items")
    E.stream_items(stream(spark, sf).select("event_id", "value"), path, _folder(spark, sf, "state")).awaitTermination()
    return spark.read.parquet(path)


@query("s6_stream_kpis", "SELECT user_id % 10 run_id, event_type metric, count(value) n, min(value) \"min\", max(value) \"max\" FROM events GROUP BY date_trunc('hour', ts), 1, 2")
def s6(spark, sf):
    v = table(spark, sf, "events").select((F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("metric"), "value", F.col("ts").alias("timestamp"))
    return E.stream_kpis(v).select("run_id", "metric", "n", "min", "max")


@query("s7_stream_dedup", "SELECT count(DISTINCT event_id // 2) n FROM events")
def s7(spark, sf):
    e = stream(spark, sf).select(F.floor(F.col("event_id") / 2).alias("checksum"), F.col("ts").cast("timestamp").alias("timestamp"))
    out = E.run_to_end(spark, E.stream_dedup(e, late="1 hour"), _folder(spark, sf, "dedup"), _folder(spark, sf, "state"))
    return out.agg(F.count("*").alias("n"))


@query("s8_stream_drift", DRIFT_STATUS_SQL)
def s8(spark, sf):
    src, seen = _folder(spark, sf, "runs"), []
    runs(spark, sf).write.parquet(src)
    r = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    E.stream_drift(r, _folder(spark, sf, "history"), _folder(spark, sf, "state"), seen.append).awaitTermination()
    none = runs(spark, sf).where("false")  # the status where no batch came
    return seen[-1] if seen else drift_status(drift_metrics(none), none)


@query("s9_stage_funnel", f"""
WITH e AS (SELECT event_id // 5 id, {NAME_SQL} AS event, min(epoch_us(ts)) t FROM events GROUP BY 1, 2), w AS (SELECT id, max(t) FILTER (WHERE event = 'document.ingested') a, max(t) FILTER (WHERE event = 'document.processed') b, max(t) FILTER (WHERE event = 'testset.created') c, max(t) FILTER (WHERE event = 'run.completed') d, max(t) FILTER (WHERE event = 'report.completed') f FROM e GROUP BY 1)
SELECT 'document.ingested' stage, count(a) n, NULL::DOUBLE mean_lag FROM w UNION ALL SELECT 'document.processed', count(b), round(avg((b - a) / 1e6), 4) FROM w UNION ALL SELECT 'testset.created', count(c), round(avg((c - b) / 1e6), 4) FROM w UNION ALL SELECT 'run.completed', count(d), round(avg((d - c) / 1e6), 4) FROM w UNION ALL SELECT 'report.completed', count(f), round(avg((f - d) / 1e6), 4) FROM w""")
def s9(spark, sf):
    e = named(table(spark, sf, "events")).select(F.floor(F.col("event_id") / 5).alias("id"), "event", F.col("ts").cast("timestamp").alias("timestamp"))
    return E.stage_funnel(e).withColumn("mean_lag", F.round("mean_lag", 4))


def timed(spark, sf):
    """The events table with the columns that the streams read."""
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("timestamp"), F.floor(F.col("event_id") / 50).alias("seq"))


def in_order(e):
    """Three batches in the order of time."""
    t = F.col("timestamp")
    return [e.where(t < "2024-01-11"), e.where((t >= "2024-01-11") & (t < "2024-01-21")), e.where(t >= "2024-01-21")]


REASON_SQL = f"""CASE WHEN event_id % 13 = 1 THEN 'not an object' WHEN event_id % 13 = 2 THEN 'missing seq' WHEN event_id % 13 = 3 THEN 'kind of seq' WHEN event_id % 13 = 4 THEN 'value of seq'
WHEN event_id % 13 = 5 THEN 'unknown field in envelope' WHEN event_id % 13 = 6 AND {NAME_SQL} = 'document.processed' THEN 'value of payload.profile_hash' ELSE 'valid' END"""


@query("s1_stream_reasons", f"SELECT {REASON_SQL} AS reason, count(*) n FROM events GROUP BY 1")
def s1s(spark, sf):
    """A stream of envelopes, some broken by rule; what its query observed while it ran."""
    k = F.col("event_id") % 13
    text = F.col("event_id").cast("string")
    document = F.struct(text.alias("document_id"), (F.col("event_id") % 9).alias("chunk_count"), F.when(k == 6, "short").otherwise(F.md5(text)).alias("profile_hash"))
    report = F.struct(text.alias("report_id"), text.alias("run_id"))
    payload = F.when(F.col("event") == "document.processed", F.to_json(document)).when(F.col("event") == "report.completed", F.to_json(report)).otherwise("{}")
    seq = F.when(k == 3, F.concat(F.lit('"'), text, F.lit('"'))).when(k == 4, "-1").otherwise(text)
    fields = [F.concat(F.lit('"event":"'), F.col("event"), F.lit('"')), F.when(k != 2, F.concat(F.lit('"seq":'), seq)), F.concat(F.lit('"timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"')),
              F.concat(F.lit('"payload":'), payload), F.when(k == 5, '"more":0')]
    raw = named(table(spark, sf, "events")).select(F.when(k == 1, "no envelope").otherwise(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))).alias("value"))
    path = _folder(spark, sf, "envelopes")
    raw.write.parquet(path)
    files = max(4, spark.sparkContext.defaultParallelism)  # a batch of fewer files than cores leaves some idle
    valid, counts = V.run_counted(V.counted_envelopes(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", files).parquet(path)))
    counts.pop("seen", None)
    told = spark.createDataFrame([(r, n) for r, n in counts.items() if n], "reason string, n long")  # a row a reason
    return told.union(valid.agg(F.lit("valid").alias("reason"), F.count("*").alias("n")).where("n > 0"))


@query("s3_stream_resync", """
WITH k AS (SELECT DISTINCT user_id source, event_id // 50 seq FROM events)
SELECT source, min(seq) "first", max(seq) "last", count(*) seen, max(seq) - min(seq) + 1 > count(*) resync FROM k GROUP BY 1""")
def s3r(spark, sf):
    """The last status of each source after three batches, the third with numbers that were missed before."""
    e = timed(spark, sf).withColumnRenamed("user_id", "source").select("source", "seq", "timestamp", "event_id")
    missed = F.col("event_id") % 7 == 0
    batches = [*(b.where(~missed) for b in in_order(e)[:2]), in_order(e)[2].union(e.where(missed & (F.col("timestamp") < "2024-01-21")))]
    told = S.fed(spark, batches, lambda x: S.follow_sequences(x, late="100 days"), "sequences").where("kind = 'status'")
    return told.groupBy("source").agg(F.max_by(F.struct("first", "last", "seen", "resync"), "seen").alias("s")).select("source", "s.*")


@query("s4_stream_silent_sources", """
WITH e AS (SELECT user_id source, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) nxt, max(ts) OVER () ended FROM events)
SELECT source, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') last_seen FROM e WHERE coalesce(nxt, ended - INTERVAL 1 HOUR) >= ts + INTERVAL 12 HOURS""")
def s4s(spark, sf):
    """Silences of twelve hours, told by timers: also of sources that never came back before the watermark passed."""
    e = timed(spark, sf).withColumnRenamed("user_id", "source")
    out = S.fed(spark, in_order(e), lambda x: S.watch_sources(x, beat_seconds=6 * 3600, late="1 hour"), "silent")
    return out.select("source", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_seen"))


@query("s6_stream_sliding_kpis", """
WITH e AS (SELECT user_id % 10 run_id, event_type metric, "value" v, ts, unnest([0, 1]) back FROM events), w AS (SELECT *, epoch(ts)::BIGINT // 10800 * 10800 - back * 10800 s FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM e)), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS closed FROM events)
SELECT run_id, metric, s window_start, count(v) n, min(v) "min", max(v) "max" FROM w, m WHERE make_timestamp((s + 21600) * 1000000) <= closed GROUP BY 1, 2, 3""")
def s6s(spark, sf):
    """Windows of six hours every three, each given out once the watermark has closed it."""
    v = timed(spark, sf).select((F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("metric"), "value", "timestamp")
    out = S.fed(spark, in_order(v), lambda x: S.live_kpis(x, "1 hour", "6 hours", "3 hours"), "kpis")
    return out.select("run_id", "metric", F.unix_seconds("window_start").alias("window_start"), "n", "min", "max")


@query("s9_stream_funnel", f"""
WITH e AS (SELECT event_id // 5 id, {NAME_SQL} AS event, epoch_us(ts) t FROM events), p AS (SELECT * FROM (VALUES ('document.ingested', 'document.processed'), ('document.processed', 'testset.created'), ('testset.created', 'run.completed'), ('run.completed', 'report.completed')) v(x, y))
SELECT 'document.ingested' stage, count(*) n, NULL::DOUBLE mean_lag FROM e WHERE event = 'document.ingested'
UNION ALL SELECT y, count(*), round(avg(CASE WHEN abs(b.t - a.t) <= 2400000000 THEN (b.t - a.t) / 1e6 END), 4) FROM p JOIN e b ON b.event = y LEFT JOIN e a ON a.event = x AND a.id = b.id GROUP BY y""")
def s9s(spark, sf):
    """The funnel from pairs of streams joined within 40 minutes; a last batch moves all watermarks behind the data."""
    e = named(table(spark, sf, "events")).select(F.floor(F.col("event_id") / 5).alias("id"), "event", F.col("ts").cast("timestamp").alias("timestamp"))
    end = e.agg((F.max("timestamp") + F.expr("interval 30 days")).alias("timestamp")).select(F.lit(-1).cast("long").alias("id"), F.explode(F.array(*map(F.lit, E.STAGES))).alias("event"), "timestamp")
    lags = S.fed(spark, [e, end], lambda x: S.stage_lags(x, E.STAGES, "40 minutes"), "funnel").where("id >= 0")
    return S.lag_funnel(lags, E.STAGES).withColumn("mean_lag", F.round("mean_lag", 4))
