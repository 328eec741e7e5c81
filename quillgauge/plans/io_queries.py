"""Queries for readers and sinks: what is read back is derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import fresh_path
from ..operators import chunks as C
from ..operators import stats as S
from ..sources import files as A
from . import inputs as I
from .registry import query, table
from .stats_queries import M as METRIC_SQL
from .stats_queries import rounded


def _folder(spark, sf, name):
    """A fresh folder in the shared one."""
    return fresh_path(spark, name)


@query("a1_read_csv_docs", "SELECT p_partkey::VARCHAR p_partkey, p_name, p_type FROM part")
def a1(spark, sf):
    path = _folder(spark, sf, "csv")
    A.export_csv(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), path)
    return A.read_csv_docs(spark, [path], ["p_name"])


def _json(spark, sf):
    d = F.col("doc_id") % 3
    return table(spark, sf, "documents").select(
        "doc_id", F.when(d == 0, F.to_json(F.struct("text"))).when(d == 1, F.to_json(F.struct(F.col("source").alias("display"), F.col("text").alias("cause"), F.col("lang").alias("remedy")))).otherwise(F.col("text")).alias("raw")
    )


@query("a2_extract_json_content", "SELECT doc_id, content FROM (SELECT doc_id, trim(CASE WHEN doc_id % 3 = 1 THEN source || chr(10) || text || chr(10) || lang ELSE text END) content FROM documents) WHERE length(content) >= 20")
def a2(spark, sf):
    return A.extract_json_content(_json(spark, sf), "raw").select("doc_id", "content")


@query("a3_render_json_template", "SELECT event_id, 'k=' || coalesce(props ->> '$.k', '') || ' z=' AS rendered FROM events")
def a3(spark, sf):
    return table(spark, sf, "events").select("event_id", A.render_json_template(F.col("props"), "k={k} z={z}", ["k", "z"]).alias("rendered"))


def _objects(spark, sf):
    """A folder of text files, one for each item of the benchmark."""
    path = _folder(spark, sf, "text")
    table(spark, sf, "benchmark").write.partitionBy("item_id").text(path)
    return path


def _item(path="path"):
    return F.regexp_extract(path, "item_id=([0-9]+)", 1).cast("long").alias("item_id")


@query("a4_read_text_docs", "SELECT item_id, text FROM benchmark")
def a4(spark, sf):
    return A.read_text_docs(spark, _objects(spark, sf)).select(_item(), F.regexp_replace("text", "\n$", "").alias("text"))


@query("a5_read_objects", "SELECT item_id, strlen(text) + 1 size, sha256(text || chr(10)) sha256, 'text/plain' mime FROM benchmark")
def a5(spark, sf):
    return A.read_objects(spark, _objects(spark, sf)).select(_item(), "size", "sha256", "mime")


@query("a6_rows_to_documents", "SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || ' | n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey doc FROM nation")
def a6(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", A.rows_to_documents(n).alias("doc"))


@query("a11_chunk_manifest", "SELECT doc_id, count(*) FILTER (WHERE i % 5 <> 0) chunks, count(*) FILTER (WHERE i % 7 <> 0) embeddings, count(*) FILTER (WHERE (i % 5 = 0) <> (i % 7 = 0)) mismatched, count(*) FILTER (WHERE (i % 5 = 0) <> (i % 7 = 0)) = 0 ok FROM (SELECT doc_id, unnest(range(1, 1 + CAST(n_chars // 500 AS BIGINT) + 1)) i FROM documents) WHERE i % 35 <> 0 GROUP BY 1")
def a11(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("n_chars") / 500) + 1)).alias("sequence_index"))
    return A.chunk_manifest(rows.where("sequence_index % 5 <> 0"), rows.where("sequence_index % 7 <> 0"))


@query("a7_read_eval_items", f"WITH {I.ITEMS_SQL} SELECT item_id, question, answer FROM items")
def a7(spark, sf):
    """Files of many shapes: arrays, arrays below a usual key or one deeper, and below any other key."""
    path = _folder(spark, sf, "eval")
    item = F.struct("item_id", "question", "answer")
    shape = F.col("conv_id") % 4
    grouped = I.items(spark, sf).groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("l"))
    wrapped = F.when(shape == 0, F.to_json("l")).when(shape == 1, F.to_json(F.struct(F.lit(3).alias("count"), F.col("l").alias("results")))).when(shape == 2, F.to_json(F.struct(F.struct(F.lit("x").alias("note"), F.col("l").alias("items")).alias("data")))).otherwise(F.to_json(F.struct(F.lit("y").alias("name"), F.col("l").alias("anything"))))
    grouped.select("conv_id", wrapped.alias("value")).write.partitionBy("conv_id").text(path)
    return A.read_eval_items(spark, path, T.StructType.fromDDL("item_id long, question string, answer string"))


def _runs(spark, sf):
    """The distribution of each metric by run, and counts by run."""
    long = I.metrics(spark, sf)
    v = S.finite(F.col("value"))
    kpis = long.groupBy("run_id", "metric").agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("average"), F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.95).alias("p95"))
    counts = long.groupBy("run_id").agg(F.count("*").alias("items"), F.count(v).alias("values"))
    return kpis, counts


@query("a8_load_run_kpis", f"{METRIC_SQL} SELECT CASE WHEN CAST(right(run_id, 2) AS INTEGER) % 2 = 0 THEN run_id ELSE 'folder=' || run_id END run_id, metric, round(avg(value), 9) average FROM f GROUP BY run_id, metric HAVING count(value) > 0")
def a8(spark, sf):
    """Every second run lacks its id and is named by its folder."""
    path = _folder(spark, sf, "kpis")
    kpis, counts = _runs(spark, sf)
    A.write_kpis(kpis, counts.withColumn("folder", F.col("run_id")), path, by="folder")
    plain = spark.read.text(path, wholetext=True).where("value <> ''")
    other = _folder(spark, sf, "kpis")
    odd = F.substring("folder", -2, 2).cast("int") % 2 == 1
    plain.select(F.when(odd, F.regexp_replace("value", r'"run_id":"[^"]*",', "")).otherwise(F.col("value")).alias("value"), "folder").write.partitionBy("folder").text(other)
    got = A.load_run_kpis(spark, other, "part-*")
    return rounded(got.select("run_id", F.explode("metrics").alias("metric", "average")).where("average is not null"), "average")


@query("a9_load_run_telemetry", "WITH r AS (SELECT user_id % 40 run, count(*) n, max(event_id) latest FROM events GROUP BY 1) SELECT 'run=' || run run_id, n, CASE WHEN run % 3 <> 0 THEN '{\"latest\":' || latest || '}' END evaluation_metadata FROM r")
def a9(spark, sf):
    path = _folder(spark, sf, "telemetry")
    r = table(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("run")).agg(F.count("*").alias("n"), F.max("event_id").alias("latest"))
    pick = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    files = F.array_compact(F.array(pick("telemetry", F.to_json(F.struct("n"))), F.when(F.col("run") % 3 != 0, pick("metadata", F.to_json(F.struct("latest"))))))
    r.select("run", F.explode(files).alias("f")).select("run", "f.*").write.partitionBy("run", "kind").text(path)
    got = A.load_run_telemetry(spark, path, "run_id string, n long", "run=*/kind=telemetry/part-*", "run=*/kind=metadata/part-*")
    return got.select("run_id", "n", F.trim(F.regexp_replace("evaluation_metadata", r"\s+$", "")).alias("evaluation_metadata"))


@query("a10_write_chunks", r"""
SELECT doc_id, CAST(i AS INTEGER) sequence_index, chunk AS text, sha256(chunk) checksum, 'size=1000' profile_hash FROM (SELECT doc_id, i, substring(text, CAST(i * 800 + 1 AS BIGINT), 1000) chunk FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 1, 0) // 800) + 1)) i FROM documents)) WHERE length(chunk) >= 100""")
def a10(spark, sf):
    path = _folder(spark, sf, "chunks")
    chunks = C.chunk_chars(table(spark, sf, "documents")).select("doc_id", F.col("pos").alias("sequence_index"), F.col("chunk").alias("text"), F.lit("size=1000").alias("profile_hash"))
    A.write_chunks(chunks, path)
    return spark.read.schema("doc_id long, sequence_index int, text string, checksum string, profile_hash string").json(path)


@query("a12_item_manifest", """
WITH j AS (SELECT *, '{' || concat_ws(',', '"doc_id":' || doc_id, '"quality":' || quality, '"toxic":' || toxic, '"ok":' || (quality = 1)) || '}' j FROM labels)
SELECT count(*) items, count(*) FILTER (WHERE quality = 1) successes, count(*) FILTER (WHERE quality <> 1) failures, CAST(sum(strlen(j)) AS BIGINT) bytes, CAST(sum(('0x' || left(sha256(j), 12))::BIGINT) AS VARCHAR) checksum FROM j""")
def a12(spark, sf):
    rows = table(spark, sf, "labels").withColumn("ok", F.col("quality") == 1)
    return A.item_manifest(rows, "ok")


@query("a13_write_kpis", f"{METRIC_SQL}, n AS (SELECT run_id, count(*) items, count(value) \"values\" FROM f GROUP BY 1) SELECT f.run_id, any_value(n.items) items, any_value(n.\"values\") \"values\", metric, count(value) n, round(avg(value), 9) average, quantile_cont(value, 0.5) p50, quantile_cont(value, 0.95) p95 FROM f JOIN n ON n.run_id = f.run_id GROUP BY f.run_id, metric")
def a13(spark, sf):
    path = _folder(spark, sf, "kpis")
    A.write_kpis(*_runs(spark, sf), path)
    got = spark.read.schema("run_id string, counts struct<items: long, values: long>, metrics map<string, struct<count: long, average: double, p50: double, p95: double>>").json(path)
    out = got.select("run_id", "counts.*", F.explode("metrics").alias("metric", "d")).select("run_id", "items", "values", "metric", F.col("d.count").alias("n"), "d.average", "d.p50", "d.p95")
    return rounded(out, "average")


@query("a14_artifact_manifest", "WITH e AS (SELECT lang IN (SELECT lang FROM documents WHERE doc_id % 2 = 0) there, lang, CAST(sum(strlen(text) + 1) FILTER (WHERE doc_id % 2 = 0) AS BIGINT) size FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT lang || '.txt' name, there \"exists\", size FROM e UNION ALL SELECT 'missing.txt', false, NULL")
def a14(spark, sf):
    path = _folder(spark, sf, "artifacts")
    docs = table(spark, sf, "documents").where("lang is not null")
    docs.where("doc_id % 2 = 0").select("lang", "text").repartition("lang").write.partitionBy("lang").text(path)
    expected = [f"{r.lang}.txt" for r in docs.select("lang").distinct().collect()] + ["missing.txt"]  # a row a language
    have = A.read_objects(spark, path)
    return A.match_artifacts(have.withColumn("name", F.concat(F.regexp_extract("path", "lang=([^/]+)/", 1), F.lit(".txt"))), spark, expected).select("name", "exists", "size")


@query("a15_write_kg", "SELECT 'node' kind, doc_id source, NULL::BIGINT target, lang AS type FROM documents UNION ALL SELECT 'relationship', a.doc_id, b.doc_id, 'next' FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def a15(spark, sf):
    path = _folder(spark, sf, "kg")
    nodes = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    following = nodes.select(F.col("id").alias("target"))
    A.write_kg(nodes, nodes.join(following, F.col("target") == F.col("id") + 1).select(F.col("id").alias("source"), "target", F.lit("next").alias("type")), path)
    n, e = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/relationships")
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("source"), F.lit(None).cast("long").alias("target"), F.col("lang").alias("type")).union(e.select(F.lit("relationship"), "source", "target", "type"))


@query("a16_export_csv", "SELECT c_custkey, c_name || ', \"' || c_mktsegment || '\"' || chr(10) || 'x' AS c_name, c_nationkey, c_acctbal FROM customer")
def a16(spark, sf):
    """Names with quotes, commas and line ends."""
    path = _folder(spark, sf, "export")
    A.export_csv(table(spark, sf, "customer").withColumn("c_name", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\nx'))), path)
    got = A.read_csv_docs(spark, [path], ["c_name"])
    return got.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query("a17_restore_types", "SELECT p_partkey, 'it''s ' || p_brand || '|' || p_type || '|7' items, try_cast(CASE WHEN p_partkey % 4 = 0 THEN 'bad' ELSE p_size::VARCHAR END AS DOUBLE) p_size FROM part")
def a17(spark, sf):
    k = F.col("p_partkey")
    brand = F.when(k % 2 == 0, F.concat(F.lit('"it\'s '), "p_brand", F.lit('"'))).otherwise(F.concat(F.lit("'it\\'s "), "p_brand", F.lit("'")))
    raw = table(spark, sf, "part").select(k, F.concat(F.lit("["), brand, F.lit(", '"), "p_type", F.lit("', 7]")).alias("l"), F.when(k % 4 == 0, "bad").otherwise(F.col("p_size").cast("string")).alias("p_size"))
    return A.restore_types(raw, ["l"], [], ["p_size"], []).select("p_partkey", F.array_join("l", "|").alias("items"), "p_size")
