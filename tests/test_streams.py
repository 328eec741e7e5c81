"""Stateful streams fed batch by batch: late fillers, silent sources, late rows and unmatched ids."""

import time

import pytest
from pyspark.sql import functions as F

from quillgauge.functions.session import fresh_path
from quillgauge.streaming import envelopes as V
from quillgauge.streaming import events as E
from quillgauge.streaming import stateful as S


def rows(spark, data, columns="source string, seq long, at string"):
    return spark.createDataFrame(data, columns).withColumn("timestamp", F.to_timestamp("at")).drop("at")


def day(clock):
    return f"2024-01-01 {clock}"


def test_gaps_fillers_and_an_expired_source(spark):
    batches = [
        rows(spark, [("a", 1, day("00:00:00")), ("a", 2, day("00:00:01")), ("a", 5, day("00:00:02")), ("b", 1, day("00:00:03")), ("b", None, day("00:00:03"))]),
        rows(spark, [("a", 4, day("00:00:05")), ("a", 4, day("00:00:05")), ("a", 9, day("00:05:05"))]),
        rows(spark, [("a", 3, day("01:00:00"))]),
    ]
    told = S.fed(spark, batches, lambda x: S.follow_sequences(x, late="1 minute"), "t").collect()
    of = lambda kind: sorted((r.source, r["first"], r["last"], r.seen, r.resync) for r in told if r.kind == kind)
    assert of("gap") == [("a", 3, 4, 3, True), ("a", 6, 8, 5, True)]
    assert ("a", 4, 4, 5, False) in of("filled")
    # b never came back, and the third batch moved the watermark past its ten minutes
    assert of("expired") == [("b", 1, 1, 1, False)]
    assert of("status") == [("a", 1, 5, 3, True), ("a", 1, 9, 5, True), ("a", 1, 9, 6, True), ("b", 1, 1, 1, False)]


def test_a_filler_within_the_idle_time_closes_the_gap(spark):
    batches = [rows(spark, [("a", 1, day("00:00:00")), ("a", 3, day("00:00:02"))]), rows(spark, [("a", 2, day("00:00:04"))])]
    told = S.fed(spark, batches, lambda x: S.follow_sequences(x, late="1 minute"), "t").where("kind = 'status'").orderBy("seen").collect()
    assert [(r["last"], r.seen, r.resync) for r in told] == [(3, 2, True), (3, 3, False)]


def run_until(spark, batch, run, enough, seconds=60):
    """Rows of a stream in processing time, which never runs out of batches, once there are enough."""
    source, sink, state = (fresh_path(spark, x) for x in ("source", "sink", "state"))
    batch.write.parquet(source)
    with S.rocksdb(spark):
        out = run(spark.readStream.schema(batch.schema).parquet(source))
        q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(processingTime="1 second").start()
    told, end = [], time.time() + seconds
    while len(told) < enough and time.time() < end:
        time.sleep(2)
        told = spark.read.schema(out.schema).parquet(sink).collect() if q.lastProgress else []
    q.stop()
    return told


def test_idle_sources_in_processing_time_with_ttl(spark):
    batch = rows(spark, [("a", 1, day("00:00:00")), ("a", 3, day("00:00:02")), ("b", 2, day("00:00:04"))])
    told = run_until(spark, batch, lambda x: S.follow_sequences(x, idle_seconds=2, ttl_seconds=3600), 5)
    assert sorted((r.source, r.kind) for r in told) == [("a", "expired"), ("a", "gap"), ("a", "status"), ("b", "expired"), ("b", "status")]


def test_a_silent_source_is_told_by_the_timer(spark):
    batches = [
        rows(spark, [("a", 1, day("00:00:00")), ("b", 1, day("00:00:10")), ("a", 2, day("00:00:20"))]),
        rows(spark, [("a", 3, day("00:00:40")), ("a", 4, day("00:01:00")), ("a", 5, day("00:01:20")), ("a", 6, day("00:03:00"))]),
    ]
    told = S.fed(spark, batches, lambda x: S.watch_sources(x, late="1 minute"), "t").collect()
    assert sorted((r.source, str(r.last_seen)[11:], str(r.stale_from)[11:]) for r in told) == [("a", "00:01:20", "00:01:50"), ("b", "00:00:10", "00:00:40")]


def test_silence_of_all_sources_in_processing_time(spark):
    batch = rows(spark, [("a", 1, day("00:00:00")), ("b", 1, day("00:00:00"))])
    told = run_until(spark, batch, lambda x: S.watch_sources(x, beat_seconds=1, event_time=False), 2)
    assert sorted(r.source for r in told) == ["a", "b"]  # no row came after the first batch


def test_live_kpis_take_late_rows_until_the_window_closes(spark):
    v = lambda data: rows(spark, data, "run_id string, metric string, value double, at string")
    batches = [
        v([("r", "m", 1.0, day("00:05:00")), ("r", "m", 2.0, day("00:30:00"))]),
        v([("r", "m", 3.0, day("00:25:00")), ("r", "m", 9.0, day("02:00:00"))]),  # late, but its windows are open
        v([("r", "m", 50.0, day("00:06:00")), ("r", "m", float("nan"), day("05:00:00"))]),  # too late: its windows are given out
    ]
    got = S.fed(spark, batches, lambda x: S.live_kpis(x, "10 minutes", "1 hour", "30 minutes"), "t").collect()
    assert sorted((str(r.window_start)[11:16], r.n, r.mean, r.min, r.max) for r in got) == [
        ("00:00", 3, 2.0, 1.0, 3.0), ("00:30", 1, 2.0, 2.0, 2.0), ("01:30", 1, 9.0, 9.0, 9.0), ("02:00", 1, 9.0, 9.0, 9.0), ("23:30", 2, 2.0, 1.0, 3.0),
    ]


def test_stage_pairs_match_within_the_bound_and_drop_the_rest(spark):
    e = lambda data: rows(spark, data, "id long, event string, at string")
    batches = [
        e([(1, "x", day("00:00:00")), (2, "x", day("00:00:00")), (3, "x", day("00:00:00"))]),
        e([(1, "y", day("00:30:00")), (2, "y", day("03:00:00")), (4, "y", day("00:10:00"))]),
        e([(-1, "x", "2024-01-09 00:00:00"), (-1, "y", "2024-01-09 00:00:00")]),
    ]
    got = S.fed(spark, batches, lambda x: S.stage_lags(x, ("x", "y"), "1 hour"), "t").where("id > 0")
    clock = lambda t: t and str(t)[11:16]
    found = {(r.id, clock(r.at_before), clock(r.at_after)) for r in got.collect()}
    assert found == {(1, "00:00", "00:30"), (2, "00:00", None), (2, None, "03:00"), (3, "00:00", None), (4, None, "00:10")}
    assert {r.stage: (r.n, r.mean_lag) for r in S.lag_funnel(got, ("x", "y")).collect()} == {"x": (3, None), "y": (3, 1800.0)}


GOOD = '{"event":"a.b","seq":1,"timestamp":"2024-01-01T00:00:00Z","payload":{"z":1}}'
ENVELOPES = [
    (GOOD, None), ("nope", "not an object"), ("[1]", "not an object"), (None, "not an object"), ("", "not an object"), ('{"event":"a.b"}', "missing seq"),
    (GOOD.replace('"seq":1', '"seq":"1"'), "kind of seq"), (GOOD.replace('"seq":1', '"seq":true'), "kind of seq"), (GOOD.replace('"seq":1', '"seq":1.5'), "kind of seq"),
    (GOOD.replace('"seq":1', '"seq":-1'), "value of seq"), (GOOD.replace("2024-01-01T00:00:00Z", "yesterday"), "value of timestamp"), (GOOD.replace('{"z":1}', "[]"), "kind of payload"),
    (GOOD.replace("{", '{"more":0,', 1), "unknown field in envelope"), (GOOD.replace('"a.b"', "null"), "kind of event"), (GOOD.replace("a.b", "document.processed"), "missing payload.document_id"),
    (GOOD.replace("a.b", "document.processed").replace('"z":1', '"document_id":"d","chunk_count":2,"profile_hash":"12345678"'), None),
    (GOOD.replace("a.b", "document.processed").replace('"z":1', '"document_id":"d","chunk_count":2,"profile_hash":"1234567"'), "value of payload.profile_hash"),
    (GOOD.replace("a.b", "report.completed").replace('"z":1', '"report_id":"d","run_id":"r","format":"doc"'), "value of payload.format"),
]


def test_reasons(spark):
    raw = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(ENVELOPES)], "k int, value string")
    got = {r.k: r.reason for r in V.judge_envelopes(raw).collect()}
    assert [got[k] for k in range(len(ENVELOPES))] == [r for _, r in ENVELOPES]


def test_messages(spark):
    data = [('{"type":"data","seq":0,"ts":1.5,"topic":"kg"}', None), ('{"type":"other","seq":0,"ts":1}', "value of type"), ('{"type":"data","seq":0,"ts":0}', "value of ts"), ('{"type":"data","seq":0}', "missing ts"), ('{"type":"data","seq":0,"ts":1,"topic":7}', "kind of topic")]
    raw = spark.createDataFrame([(t, r) for t, r in data], "value string, want string")
    assert V.judge_envelopes(raw, fields=V.MESSAGE).where("not (reason <=> want)").count() == 0


def test_counts_are_read_while_the_stream_runs(spark):
    raw = spark.createDataFrame([(t,) for t, _ in ENVELOPES], "value string")
    path = fresh_path(spark, "raw")
    for _ in range(3):
        raw.write.mode("append").parquet(path)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(path)
    valid, counts = V.run_counted(V.counted_envelopes(stream))
    bad = [r for _, r in ENVELOPES if r]
    assert valid.count() == 3 * sum(r is None for _, r in ENVELOPES) and counts["seen"] == 3 * len(ENVELOPES)
    assert {k: n for k, n in counts.items() if n and k != "seen"} == {r: 3 * bad.count(r) for r in set(bad)}


@pytest.mark.parametrize("name", ["s4_stream_silent_sources"])
def test_empty_table(spark, name, tmp_path):
    from quillgauge.plans import registry

    registry.load()
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_open_numbers_are_the_gaps_less_what_filled_them(spark):
    told = [(1, 5, 9, "gap"), (1, 20, 20, "gap"), (1, 30, 34, "gap"), (1, 5, 5, "filled"), (1, 7, 7, "filled"), (1, 20, 20, "filled"), (1, 34, 34, "filled"), (2, 3, 4, "gap")]
    out = E.open_numbers(spark.createDataFrame(told, "source long, first long, last long, kind string"))
    assert sorted(map(tuple, out.collect())) == [(1, 6), (1, 8), (1, 9), (1, 30), (1, 31), (1, 32), (1, 33), (2, 3), (2, 4)]
    assert "hashpartitioning(source" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "missing" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_keys_of_an_envelope_are_taken_once(spark):
    judged = V.judge_envelopes(spark.createDataFrame([(v,) for v, _ in ENVELOPES], "value string"))
    assert str(judged._jdf.queryExecution().optimizedPlan()).count("jsonObjectKeys") == 2  # its own and those of its payload


def test_sources_of_a_bucket_keep_their_own_silences(spark):
    beat, start = 15, 1_704_067_200
    events = sorted((start + k * 37 % 900, None if k % 31 == 0 else (k * k) % 31) for k in range(300))
    cut = [events[:90], events[90:200], events[200:], [(start + 900 + 90, 99)]]
    frame = lambda part: spark.createDataFrame(part, "at long, source long").select("source", F.timestamp_seconds("at").alias("timestamp"))
    told = S.fed(spark, [frame(p) for p in cut], lambda x: S.watch_sources(x, beat_seconds=beat, late="1 minute", buckets=3), "t")
    want = []
    for source in {s for _, s in events}:
        own = [t for t, s in events if s == source]
        want += [(source, a) for a, b in zip(own, [*own[1:], start + 2000]) if b - a >= 2 * beat]
    got = [(r.source, r.at) for r in told.select("source", F.unix_seconds("last_seen").alias("at")).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_stages_of_an_id_share_one_state_and_keep_every_pair(spark):
    stages, within = ("x", "y", "z"), 600
    draw = [(k * 7 % 23 if k % 19 else None, "xyzw"[k * k % 4 if k % 5 else k % 3], 1_704_067_200 + k * 211 % 5400) for k in range(200)]
    frame = lambda part: spark.createDataFrame(part, "id long, event string, at long").select("id", "event", F.timestamp_seconds("at").alias("timestamp"))
    end = [(-1, "x", 1_704_067_200 + 90_000)]
    streams = []
    got = S.fed(spark, [frame(draw), frame(end)], lambda x: streams.append(S.stage_lags(x, stages, "10 minutes")) or streams[-1], "t").where("id is null or id >= 0")
    assert "Join" not in streams[0]._jdf.queryExecution().analyzed().toString()
    want = []
    for before, after in (("x", "y"), ("y", "z")):
        a, b = ([(i, t) for i, e, t in draw if e == s] for s in (before, after))
        both = [(i, s, t) for i, s in a for j, t in b if i is not None and i == j and abs(s - t) <= within]
        want += [(after, *p) for p in both] + [(after, i, s, None) for i, s in a if (i, s) not in {p[:2] for p in both}] + [(after, i, None, t) for i, t in b if (i, t) not in {(p[0], p[2]) for p in both}]
    rows_ = [(r.stage, r.id, r.a, r.b) for r in got.select("stage", "id", F.unix_seconds("at_before").alias("a"), F.unix_seconds("at_after").alias("b")).collect()]
    assert sorted(rows_, key=str) == sorted(want, key=str)
