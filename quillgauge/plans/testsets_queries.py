"""Queries for test sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import testsets as N
from .registry import query, table
from .text_queries import sql_marker


def _chunks(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("topic"), "source")


@query("n1_make_drafts")
def n1(spark, sf):
    return N.make_drafts(_chunks(spark, sf), 2000, 7)


@query("n2_focus", "SELECT source, array_to_string(list_concat(list_sort(list(DISTINCT lang))[1:2], list_sort(list(DISTINCT doc_id % 3)::VARCHAR[])[1:2]), ', ') focus FROM documents GROUP BY 1")
def n2(spark, sf):
    c = _chunks(spark, sf).withColumn("section", (F.col("id") % 3).cast("string"))
    return N.focus(c, "source")


SCENARIO_TABLE = N.scenario_table([("own-audit", "audit")], 7)


@query("n3_assign_scenarios", f"SELECT draft_id, ([{', '.join(repr(a) for a, _ in SCENARIO_TABLE)}])[CAST((row_number() OVER (ORDER BY draft_id) - 1) % {len(SCENARIO_TABLE)} AS INTEGER) + 1] scenario_id FROM (SELECT doc_id::VARCHAR draft_id FROM documents)")
def n3(spark, sf):
    return N.assign_scenarios(_chunks(spark, sf).select(F.col("id").cast("string").alias("draft_id")), SCENARIO_TABLE).select("draft_id", "scenario_id")


@query("n4_inject_persona", "SELECT conv_id, turn, left(text || chr(10) || '(asked by: auditor)', 256) question FROM conversations WHERE role = 'user'")
def n4(spark, sf):
    q = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return N.inject_persona(q, "auditor")


@query("n5_generate_testset")
def n5(spark, sf):
    return N.generate_testset(_chunks(spark, sf), 500, 7)[1]


@query("n6_personas_from_kg", " UNION ALL ".join(f"SELECT '{n}' persona FROM (SELECT bool_or(regexp_matches(lower(text), '{p}')) ok FROM documents) WHERE ok" for n, p in N.PERSONAS))
def n6(spark, sf):
    return N.personas_from_kg(_chunks(spark, sf))


@query("n7_template_qa", rf"""
WITH d AS (SELECT doc_id, text, trim(string_split(text, chr(10))[1]) line, {sql_marker('text', T.CONTENT_TYPES, 'factual')} kind FROM documents)
SELECT doc_id, replace(CASE kind WHEN 'procedural' THEN 'What are the steps of {{}}?' WHEN 'requirement' THEN 'What is required of {{}}?' WHEN 'explanatory' THEN 'Why does {{}} matter?' ELSE 'What is {{}}?' END, '{{}}', CASE WHEN length(line) BETWEEN 1 AND 60 THEN line ELSE regexp_extract(text, '[\p{{L}}]{{5,}}') END) question, left(text, 300) answer FROM d""")
def n7(spark, sf):
    return N.template_qa(table(spark, sf, "documents"))
