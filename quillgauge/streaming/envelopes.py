"""Event envelopes checked against their schemas, field by field, in expressions over VARIANT values.

An envelope is a JSON object; the first rule that it breaks is its reason.
Valid envelopes go on, the others are dropped and counted by reason in the
metrics that the query observes batch by batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import fresh_path


@dataclass(frozen=True)
class Field:
    """A field of an object: its kind (string, integer, number, object, time), and bounds where it has any."""

    name: str
    kind: str
    required: bool = True
    least: float | None = None
    above: float | None = None
    length: int | None = None
    choices: tuple[str, ...] = ()


# The published schemas of the envelopes and of two payloads.
EVENT = (Field("event", "string"), Field("seq", "integer", least=0), Field("timestamp", "time"), Field("payload", "object"))
MESSAGE = (
    Field("type", "string", choices=("welcome", "heartbeat", "data", "error")), Field("seq", "integer", least=0), Field("ts", "number", above=0),
    Field("topic", "string", required=False), Field("payload", "object", required=False),
)
PAYLOADS = {
    "document.processed": (
        Field("document_id", "string"), Field("chunk_count", "integer", least=0), Field("profile_hash", "string", length=8),
        Field("embedding_count", "integer", required=False, least=0), Field("manifest_key", "string", required=False, length=1), Field("duration_ms", "integer", required=False, least=0),
    ),
    "report.completed": (Field("report_id", "string"), Field("run_id", "string"), Field("format", "string", required=False, choices=("html", "pdf"))),
}

#: How a kind looks in the schema of a variant.
KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*\))$", "object": "^OBJECT", "time": "^STRING$"}
TIME = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def keys_of(value: Column) -> Column:
    return F.json_object_keys(F.to_json(value))


def first_broken(value: Column, keys: Column, fields: tuple[Field, ...], at: str = "") -> list[tuple[Column, str]]:
    """(condition, reason) of the rules of an object with these keys, in the order in which they are put: presence, kind, bounds, unknown fields."""
    get = lambda f, kind="variant": F.try_variant_get(value, f"$.{f.name}", kind)
    rules = [(~F.array_contains(keys, f.name), f"missing {at}{f.name}") for f in fields if f.required]
    for f in fields:
        there = F.array_contains(keys, f.name)
        rules.append((there & ~F.coalesce(F.schema_of_variant(get(f)).rlike(KINDS[f.kind]), F.lit(False)), f"kind of {at}{f.name}"))
        bad = []
        if f.kind == "time":
            bad.append(~get(f, "string").rlike(TIME) | F.expr("false"))
        if f.least is not None:
            bad.append(get(f, "double") < f.least)
        if f.above is not None:
            bad.append(get(f, "double") <= f.above)
        if f.length is not None:
            bad.append(F.length(get(f, "string")) < f.length)
        if f.choices:
            bad.append(~get(f, "string").isin(*f.choices))
        rules += [(there & b, f"value of {at}{f.name}") for b in bad]
    known = F.array(*[F.lit(f.name) for f in fields])
    return [*rules, (F.size(F.array_except(keys, known)) > 0, f"unknown field in {at or 'envelope'}".rstrip("."))]


def judge_envelopes(raw: DataFrame, col: str = "value", fields: tuple[Field, ...] = EVENT, payloads: dict[str, tuple[Field, ...]] | None = None) -> DataFrame:
    """raw with ``envelope`` (variant) and ``reason``, null where all rules hold; a null text is no object.

    Payloads are checked by the schema of their event; those of events without
    one may hold anything.
    """
    # what many rules ask for are columns of their own, so that a row has them computed once
    parts = {"envelope": F.try_parse_json(col), "__keys": keys_of(F.col("envelope"))}
    rules = [(~F.coalesce(F.schema_of_variant(F.col("envelope")).startswith("OBJECT"), F.lit(False)), "not an object")]
    rules += first_broken(F.col("envelope"), F.col("__keys"), fields)
    if fields is EVENT:
        schemas = PAYLOADS if payloads is None else payloads
        parts["__name"] = F.try_variant_get("envelope", "$.event", "string")
        parts["__payload"] = F.try_variant_get("envelope", "$.payload", "variant")
        parts["__own"] = F.when(F.col("__name").isin(*schemas), keys_of(F.col("__payload")))
        for event, own in schemas.items():
            rules += [((F.col("__name") == event) & c, r) for c, r in first_broken(F.col("__payload"), F.col("__own"), own, "payload.")]
    out = raw
    for name, c in parts.items():
        out = out.withColumn(name, c)
    return out.withColumn("reason", F.coalesce(*[F.when(c, F.lit(r)) for c, r in rules])).drop(*[c for c in parts if c != "envelope"])


def reasons(fields: tuple[Field, ...] = EVENT, payloads: dict[str, tuple[Field, ...]] | None = None) -> list[str]:
    """All reasons there can be."""
    some = F.lit(None).cast("array<string>")
    out = ["not an object", *[r for _, r in first_broken(some, some, fields)]]
    if fields is EVENT:
        out += [r for own in (PAYLOADS if payloads is None else payloads).values() for _, r in first_broken(some, some, own, "payload.")]
    return list(dict.fromkeys(out))


def counted_envelopes(raw: DataFrame, name: str = "envelopes", col: str = "value", fields: tuple[Field, ...] = EVENT) -> DataFrame:
    """event, seq, timestamp, payload (JSON) of valid envelopes; the query observes ``seen`` and a count for each reason under ``name``."""
    judged = judge_envelopes(raw, col, fields)
    counts = [F.count("*").alias("seen"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons(fields)]]
    ok = judged.observe(name, *counts).where("reason is null")
    get = lambda f, kind: F.try_variant_get("envelope", f"$.{f}", kind)
    first, at = ("event", F.to_timestamp(get("timestamp", "string"))) if fields is EVENT else ("type", F.timestamp_micros((get("ts", "double") * 1_000_000).cast("long")))
    return ok.select(get(first, "string").alias(first), get("seq", "long").alias("seq"), at.alias("timestamp"), F.to_json(get("payload", "variant")).alias("payload"))


def run_counted(stream: DataFrame, name: str = "envelopes", wait: float = 0.5) -> tuple[DataFrame, dict[str, int]]:
    """Drain what is available now to Parquet; the rows, and the observed counts summed over all batches.

    Progress is read while the query runs, as a query remembers its last
    batches only; batches are told apart by number.
    """
    spark: SparkSession = stream.sparkSession
    sink = fresh_path(spark, name)
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", fresh_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    batches: dict[int, dict[str, int]] = {}
    running = True
    while running:
        running = not q.awaitTermination(wait)
        for p in q.recentProgress:
            if name in p.observedMetrics:
                batches[p.batchId] = p.observedMetrics[name].asDict()
    total: dict[str, int] = {}
    for counts in batches.values():
        for k, n in counts.items():
            total[k] = total.get(k, 0) + (n or 0)
    return spark.read.schema(stream.schema).parquet(sink), total
