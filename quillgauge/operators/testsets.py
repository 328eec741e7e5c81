"""Test sets as table transforms with deterministic templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.session import number_rows
from .chunks import split_sentences

TEMPLATES = ["What does the text say about {}?", "Explain: {}", "How is this described: {}"]
STRATEGIES = ["configured", "baseline"]
SCENARIOS = [("base-lookup", "look up"), ("base-compare", "compare"), ("base-explain", "explain"), ("base-apply", "apply")]
#: Concepts that make a persona when a node's text has them (fixed values).
PERSONAS = [("engineer", "system|process|error"), ("analyst", "data|report|rate"), ("operator", "step|machine|line"), ("auditor", "rule|standard|license")]


def make_drafts(chunks: DataFrame, total: int, seed: int, per_chunk: int | None = None) -> DataFrame:
    """draft_id, id, question, answer, strategy: sentence, template and strategy picked by hash.

    chunks: id, text.  n samples a chunk are given or total // chunks, capped at ``total`` in all.
    """
    n = F.lit(per_chunk) if per_chunk else F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("n_chunks")).cast("int"))
    size = chunks.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_chunks"))
    rows = chunks.join(F.broadcast(size)).select("id", "text", F.explode(F.sequence(F.lit(1), n)).alias("i"), split_sentences(F.col("text")).alias("s")).where("size(s) > 0")  # one row
    pick = lambda salt, size: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id", "i"), size) + 1).cast("int")
    sentence = F.element_at("s", pick("s", F.size("s")))
    template = F.element_at(F.array(*map(F.lit, TEMPLATES)), pick("t", F.lit(len(TEMPLATES))))
    strategy = F.element_at(F.array(*map(F.lit, STRATEGIES)), pick("g", F.lit(len(STRATEGIES))))
    answer = F.when(F.length("text") > 320, F.concat(F.substring("text", 1, 320), F.lit("…"))).otherwise(F.col("text"))
    out = rows.select("id", "i", F.replace(template, F.lit("{}"), sentence).alias("question"), answer.alias("answer"), strategy.alias("strategy"))
    return out.orderBy("i", "id").limit(total).withColumn("draft_id", F.concat_ws("-", "id", "i"))


def focus(chunks: DataFrame, by: str) -> DataFrame:
    """by, focus: up to two topics and two sections, else the first id; chunks: by, id, topic, section."""
    some = lambda c: F.slice(F.array_sort(F.collect_set(F.col(c))), 1, 2)
    s = chunks.groupBy(by).agg(some("topic").alias("t"), some("section").alias("s"), F.min("id").cast("string").alias("first"))
    both = F.concat("t", "s")
    return s.select(by, F.when(F.size(both) > 0, F.array_join(both, ", ")).otherwise(F.col("first")).alias("focus"))


def scenario_table(extras: list[tuple[str, str]] = (), target: int = 0) -> list[tuple[str, str]]:
    """The base scenarios and the extras, cloned with numbers behind their ids until there are ``target``."""
    base = [*SCENARIOS, *extras]
    return base + [(f"{base[k % len(base)][0]}-{k // len(base) + 1}", base[k % len(base)][1]) for k in range(len(base), target)]


def assign_scenarios(drafts: DataFrame, scenarios: list[tuple[str, str]] = SCENARIOS, order: str = "draft_id") -> DataFrame:
    """drafts with scenario_id and verb, round robin over all of them in order."""
    table = F.array(*[F.struct(F.lit(a).alias("scenario_id"), F.lit(b).alias("verb")) for a, b in scenarios])
    numbered = number_rows(drafts, order, name="__n")
    return numbered.withColumn("__sc", F.element_at(table, (F.col("__n") % len(scenarios) + 1).cast("int"))).select(*drafts.columns, "__sc.scenario_id", "__sc.verb")


def inject_persona(df: DataFrame, persona: str, most: int = 256) -> DataFrame:
    return df.withColumn("question", F.substring(F.concat_ws("\n", "question", F.lit(f"(asked by: {persona})")), 1, most))


def generate_testset(chunks: DataFrame, total: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The samples, and one row generated, filtered_length, dropped_duplicates."""
    from .quality import length_filter, near_dedup

    drafts = inject_persona(assign_scenarios(make_drafts(chunks, total, seed)), "auditor")
    long = length_filter(drafts)
    text = long.select(F.col("draft_id").alias("id"), F.concat_ws(" ", "question", "answer", "scenario_id").alias("text"))
    kept = long.join(near_dedup(text).select(F.col("id").alias("draft_id")), "draft_id", "left_semi")
    count = lambda d, name: d.agg(F.count("*").alias(name))
    stats = count(drafts, "generated").join(F.broadcast(count(long, "long_enough"))).join(F.broadcast(count(kept, "kept")))  # one row each
    return kept, stats


def personas_from_kg(nodes: DataFrame, most: int = 4) -> DataFrame:
    """persona of the concepts that occur in any node's text."""
    hit = nodes.agg(*[F.bool_or(F.lower("text").rlike(p)).alias(n) for n, p in PERSONAS])
    rows = F.array(*[F.struct(F.lit(n).alias("persona"), F.col(n).alias("ok")) for n, _ in PERSONAS])
    return hit.select(F.explode(F.slice(F.filter(rows, lambda r: r.ok), 1, most)).alias("r")).select("r.persona")


QUESTION = {"procedural": "What are the steps of {}?", "requirement": "What is required of {}?", "explanatory": "Why does {} matter?", "factual": "What is {}?"}


def template_qa(docs: DataFrame, answer: int = 300) -> DataFrame:
    """doc_id, question, answer: main topic is the first line if it is short, else the first long word."""
    line = F.trim(F.split("text", "\n")[0])
    topic = F.when(F.length(line).between(1, 60), line).otherwise(F.regexp_extract("text", r"[\p{L}]{5,}", 0))
    kind = T.first_marker(F.col("text"), T.CONTENT_TYPES, "factual")
    template = F.coalesce(*[F.when(kind == k, F.lit(q)) for k, q in QUESTION.items()])
    return docs.select("doc_id", F.replace(template, F.lit("{}"), topic).alias("question"), F.substring("text", 1, answer).alias("answer"))
