"""Readers and sinks over files; schemas are given or checked, never inferred from data in production."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVAL_KEYS = ("items", "results", "evaluations", "records", "rows", "data")
KPI_SCHEMA = "run_id string, metrics map<string, struct<average: double>>"


def read_csv_docs(spark: SparkSession, paths: list[str], required: list[str], sep: str = ",", quote: str = '"', encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; blank rows dropped; a missing required column is an error."""
    df = spark.read.csv(paths, header=True, sep=sep, quote=quote, escape=quote, encoding=encoding, multiLine=True)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.dropna("all")


def extract_json_content(df: DataFrame, col: str, least: int = 20) -> DataFrame:
    """df with content and metadata: ``text``, or display, cause and remedy joined, or the column itself if it is no JSON."""
    get = lambda p: F.get_json_object(col, f"$.{p}")
    parts = F.concat_ws("\n", get("display"), get("cause"), get("remedy"))
    text = F.coalesce(get("text"), F.when(F.length(parts) > 0, parts), F.col(col))
    return df.withColumn("content", F.trim(text)).withColumn("metadata", F.when(get("text").isNotNull(), get("metadata"))).where(F.length("content") >= least)


def render_json_template(json: Column, template: str, fields: list[str]) -> Column:
    """The template with each {field} replaced by the JSON field, missing ones by nothing."""
    out = F.lit(template)
    for f in fields:
        out = F.replace(out, F.lit("{" + f + "}"), F.coalesce(F.get_json_object(json, f"$.{f}"), F.lit("")))
    return out


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file below a folder."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256, mime: PDF by its mark, else by extension, else text if few of the first 1024 bytes are unprintable."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    head = F.substring("content", 1, 1024)
    odd = F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[\x09\x0A\x0D\x20-\x7E\x80-\xFF]", ""))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.coalesce(*[F.when(ext == e, F.lit(m)) for e, m in (("txt", "text/plain"), ("md", "text/markdown"), ("html", "text/html"), ("json", "application/json"), ("csv", "text/csv"))])
    mime = F.when(F.substring("content", 1, 4) == F.lit(b"%PDF"), "application/pdf").otherwise(F.coalesce(known, F.when(odd * 10 < F.greatest(F.length(head), F.lit(1)), "text/plain").otherwise("application/octet-stream")))
    return df.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), mime.alias("mime"))


def rows_to_documents(df: DataFrame) -> Column:
    """``k: v | k: v`` of the columns that are not null."""
    return F.concat_ws(" | ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in df.columns])


def read_eval_items(spark: SparkSession, path: str, item: T.StructType) -> DataFrame:
    """Items of JSON files that are an array, or hold one below a usual key (one level deeper too), or else their first array."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    entries = lambda c: F.from_json(c, "map<string,string>")
    is_array = lambda c: F.when(F.ltrim(c).startswith("["), c)
    top = text.select(F.col("value"), F.when(F.ltrim("value").startswith("{"), entries(F.col("value"))).alias("top"))
    deeper = [F.when(F.ltrim(F.col("top")[k]).startswith("{"), entries(F.col("top")[k])).alias(f"in_{k}") for k in EVAL_KEYS]
    top = top.select("value", "top", *deeper)
    found = [c for k in EVAL_KEYS for c in (is_array(F.col("top")[k]), *[is_array(F.col(f"in_{k}")[kk]) for kk in EVAL_KEYS])]
    first = F.get(F.filter(F.map_values("top"), lambda v: F.ltrim(v).startswith("[")), F.lit(0))
    array = F.coalesce(is_array(F.col("value")), *found, first)
    return top.select(F.explode(F.from_json(array, T.ArrayType(item))).alias("i")).where("i is not null").select("i.*")


def load_run_kpis(spark: SparkSession, root: str, name: str = "kpis.json") -> DataFrame:
    """path, run_id (else the folder's name), metrics of every file of that name below a root; bad files are left out."""
    df = spark.read.schema(KPI_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    path = F.col("_metadata.file_path")
    return df.select(path.alias("path"), F.coalesce("run_id", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).alias("run_id"), F.transform_values("metrics", lambda _, v: v.average).alias("metrics"))


def load_run_telemetry(spark: SparkSession, root: str, schema: str, telemetry: str = "*/telemetry/pipeline_run_*.json", metadata: str = "*/metadata/evaluation_metadata_*.json") -> DataFrame:
    """run_path, run_id (else the run folder's name), the telemetry's other fields, and the latest metadata file of the run as text."""
    path = F.col("_metadata.file_path")
    run = F.regexp_extract(path, r"^(.*)/[^/]+/[^/]+$", 1).alias("run_path")
    folders = lambda pattern: f"{root}/{pattern.rpartition('/')[0]}"
    t = spark.read.option("pathGlobFilter", telemetry.rpartition("/")[2]).schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(folders(telemetry)).select(run, "*")
    m = spark.read.option("pathGlobFilter", metadata.rpartition("/")[2]).text(folders(metadata), wholetext=True).select(run, path.alias("p"), "value").groupBy("run_path").agg(F.max_by("value", "p").alias("evaluation_metadata"))
    name = F.regexp_extract("run_path", r"([^/]+)$", 1)
    out = t.join(m, "run_path", "left")
    return out.withColumn("run_id", F.coalesce("run_id", name)) if "run_id" in out.columns else out.withColumn("run_id", name)


def write_chunks(chunks: DataFrame, path: str, fmt: str = "json") -> None:
    """Chunks by profile, with a checksum of their text."""
    chunks.withColumn("checksum", F.sha2("text", 256)).write.mode("overwrite").partitionBy("profile_hash").format(fmt).save(path)


def chunk_manifest(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """doc_id, chunks, embeddings, mismatched, ok: indexes that one side lacks are mismatches."""
    c = chunks.select("doc_id", "sequence_index", F.lit(True).alias("c"))
    e = embeddings.select("doc_id", "sequence_index", F.lit(True).alias("e"))
    g = c.join(e, ["doc_id", "sequence_index"], "full").groupBy("doc_id").agg(F.count("c").alias("chunks"), F.count("e").alias("embeddings"), F.count_if(F.col("c").isNull() | F.col("e").isNull()).alias("mismatched"))
    return g.withColumn("ok", F.col("mismatched") == 0)


def item_manifest(items: DataFrame, success: str) -> DataFrame:
    """items, successes, failures, bytes, checksum; the checksum does not depend on the order of rows."""
    row = F.to_json(F.struct(*items.columns))
    part = F.conv(F.substring(F.sha2(row, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return items.agg(F.count("*").alias("items"), F.count_if(success).alias("successes"), F.count_if(~F.col(success)).alias("failures"), F.sum(F.octet_length(row)).alias("bytes"), F.sum(part).cast("string").alias("checksum"))


def write_kpis(kpis: DataFrame, counts: DataFrame, path: str, by: str | None = None) -> None:
    """{run_id, counts, metrics} as JSON, one row a run; Spark's commit makes it whole or absent.

    kpis: run_id, metric and the distribution; counts: run_id and any numbers;
    with ``by``, a column of counts, each run goes to a folder of its own.
    """
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("count", "min", "max", "average", "p50", "p95")))))
    c = counts.select("run_id", F.struct(*[x for x in counts.columns if x not in ("run_id", by)]).alias("counts"), *([by] if by else []))
    out = c.join(kpis.groupBy("run_id").agg(m.alias("metrics")), "run_id", "left").write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)


def match_artifacts(have: DataFrame, spark: SparkSession, expected: list[str]) -> DataFrame:
    """name, exists, size, sha256 of each expected name."""
    want = spark.range(1).select(F.explode(F.array(*map(F.lit, expected))).alias("name"))
    return want.join(have, "name", "left").select("name", F.col("size").isNotNull().alias("exists"), "size", "sha256")


def artifact_manifest(spark: SparkSession, folder: str, expected: list[str]) -> DataFrame:
    """name, exists, size, sha256 of files expected in a folder; the missing ones are those that do not exist."""
    return match_artifacts(read_objects(spark, folder).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)), spark, expected)


def write_kg(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/relationships")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=False)


#: An item of a list literal: quoted either way with backslash escapes, or bare.
LIST_ITEM = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^\s,\[\]'"]+"""


def list_literal(text: Column) -> Column:
    """The items of a list written as text, as Python or JSON writes it; empty where it is none."""
    items = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LIST_ITEM), F.lit(0))
    inner = lambda x: F.when(x.rlike("^['\"]"), F.regexp_replace(F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("\\n"), F.lit("\n")), r"\\(.)", "$1")).otherwise(x)
    return F.when(F.trim(text).rlike(r"(?s)^\[.*\]$"), F.transform(items, inner)).otherwise(F.array().cast("array<string>"))


def restore_types(df: DataFrame, lists: list[str], lines: list[str], numbers: list[str], dates: list[str]) -> DataFrame:
    """Columns of a table read from text: list literals and newline-joined texts to arrays, numbers, timestamps."""
    out = df
    for c in lists:
        out = out.withColumn(c, list_literal(F.col(c)))
    for c in lines:
        out = out.withColumn(c, F.filter(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    for c in numbers:
        out = out.withColumn(c, F.expr(f"try_cast(`{c}` as double)"))
    for c in dates:
        out = out.withColumn(c, F.expr(f"try_to_timestamp(`{c}`)"))
    return out
