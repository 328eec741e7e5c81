"""Queries for text cleaning and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table

Q = r"SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _questions(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def sql_marker(col: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({col}), '{'|'.join(m)}') THEN '{n}'" for n, m in rules) + f" ELSE '{default}' END"


@query("b1_normalize_text", r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x{200b}-\x{200d}\x{feff}]', '', 'g'), '[ \t\f\v]+', ' ', 'g') t FROM documents)
SELECT doc_id, clean_text FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) clean_text FROM a)
WHERE length(clean_text) >= 20""")
def b1(spark, sf):
    return _docs(spark, sf).select("doc_id", T.normalize_text(F.col("text")).alias("clean_text")).where(F.length("clean_text") >= 20)


@query("b2_strip_markup", r"""
SELECT page_id, trim(replace(regexp_replace(regexp_replace(coalesce(html, ''), '\s+', ' ', 'g'), '<[^>]+>', '', 'g'), '\"', '"')) plain FROM pages""")
def b2(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_markup(F.col("html")).alias("plain"))


@query("b3_bound_length", r"""
SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END bounded FROM documents
WHERE length(text) >= 20 AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 3""")
def b3(spark, sf):
    text = F.col("text")
    return _docs(spark, sf).where((F.length(text) >= 20) & (F.size(T.words(text)) >= 3)).select("doc_id", T.bound_length(text, 2000).alias("bounded"))


@query("b4_filter_documents", r"""
SELECT doc_id, plain FROM (SELECT doc_id, source, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s.,!?;:]', '', 'g')) plain FROM documents)
WHERE length(plain) >= CASE WHEN source = 'src0' THEN 10 ELSE 100 END""")
def b4(spark, sf):
    least = F.when(F.col("source") == "src0", 10).otherwise(100)
    return _docs(spark, sf).withColumn("plain", T.plain_text(F.col("text"))).where(F.length("plain") >= least).select("doc_id", "plain")


@query("b5_content_hash", r"SELECT doc_id, left(sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')), 32) hash FROM documents")
def b5(spark, sf):
    return _docs(spark, sf).select("doc_id", T.content_hash(F.col("text")).alias("hash"))


def _sql_redact() -> str:
    out = "text"
    for p, to in T.REDACTIONS:
        flag, p = ("gi", p[4:]) if p.startswith("(?i)") else ("g", p)
        out = f"regexp_replace({out}, '{p}', '{to.replace('$1', chr(92) + '1')}', '{flag}')"
    return out


@query("b6_redact", f"SELECT doc_id, {_sql_redact()} redacted FROM documents")
def b6(spark, sf):
    return _docs(spark, sf).select("doc_id", T.redact(F.col("text")).alias("redacted"))


def _sql_hits() -> str:
    parts, inner = [], "text"
    for i, (p, to) in enumerate(T.REDACTIONS):
        flag, q = ("gi", p[4:]) if p.startswith("(?i)") else ("g", p)
        parts.append(f"SELECT {i} AS rule, CAST(sum(len(regexp_extract_all({inner}, '{p}'))) AS BIGINT) hits FROM documents")
        inner = f"regexp_replace({inner}, '{q}', '{to.replace('$1', chr(92) + '1')}', '{flag}')"
    return " UNION ALL ".join(parts)


@query("b6_redaction_report", _sql_hits())
def b6_report(spark, sf):
    hits = _docs(spark, sf).select(F.posexplode(T.redaction_hits(F.col("text"))).alias("rule", "n"))
    return hits.groupBy("rule").agg(F.sum("n").alias("hits"))


@query("b7_detect_script", r"""
SELECT doc_id, CASE WHEN a > 0 AND z / greatest(a, 1) > 0.3 THEN 'chinese' ELSE 'english' END script FROM
(SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]')) a, len(regexp_extract_all(text, '[㐀-䶿一-鿿]')) z FROM documents)""")
def b7(spark, sf):
    return _docs(spark, sf).select("doc_id", T.detect_script(F.col("text")).alias("script"))


@query("b8_script_distribution", r"""
SELECT doc_id, CASE WHEN t = 0 THEN 0.0::DOUBLE ELSE z / t END chinese, CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE e / t END english, CASE WHEN t = 0 THEN 0.0::DOUBLE ELSE (t - z - e) / t END other FROM
(SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]')) z, len(regexp_extract_all(text, '[A-Za-z]')) e, len(regexp_extract_all(text, '\p{L}')) t FROM documents)""")
def b8(spark, sf):
    return _docs(spark, sf).select("doc_id", T.script_shares(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("b9_complexity", r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') w FROM documents),
n AS (SELECT doc_id, text, len(w) n, len(list_distinct(list_transform(w, lambda x: lower(x)))) u, list_sum(list_transform(w, lambda x: length(x))) l, len(string_split(text, '.')) s FROM w)
SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 WHEN n < 10 THEN 0.3 ELSE least(1.0, u / n * 0.4 + least(1.0, l / n / 8) * 0.3 + least(1.0, n / greatest(s, 1) / 20) * 0.3) END::DOUBLE, 9) complexity FROM n""")
def b9(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(T.complexity(F.col("text")), 9).alias("complexity"))


@query("b10_domain_density", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) w FROM documents),
terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) term FROM benchmark)
SELECT doc_id, count(*) n_words, count(term) n_terms, least(1.0, count(term) / count(*) * 5)::DOUBLE specificity FROM w LEFT JOIN terms ON w = term GROUP BY doc_id""")
def b10(spark, sf):
    from ..operators.keywords import domain_density

    terms = table(spark, sf, "benchmark").select(F.explode(T.token_set(F.col("text"))).alias("term")).distinct()
    return domain_density(_docs(spark, sf), terms)


@query("b11_script_mixing", r"""
SELECT doc_id, CASE WHEN length(regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z一-鿿]', '', 'g'), '[A-Za-z]+', 'a', 'g'), '[一-鿿]+', 'z', 'g')) > 1 THEN 1.0 ELSE 0.0 END::DOUBLE mixing FROM documents""")
def b11(spark, sf):
    return _docs(spark, sf).select("doc_id", T.script_mixing(F.col("text")).alias("mixing"))


@query("b12_classify_question", f"SELECT conv_id, turn, {sql_marker('text', T.QUESTION_TYPES, 'general')} question_type FROM ({Q})")
def b12(spark, sf):
    return _questions(spark, sf).select("conv_id", "turn", T.first_marker(F.col("text"), T.QUESTION_TYPES, "general").alias("question_type"))


@query("b13_classify_content", f"SELECT doc_id, {sql_marker('text', T.CONTENT_TYPES, 'factual')} content_type FROM documents")
def b13(spark, sf):
    return _docs(spark, sf).select("doc_id", T.first_marker(F.col("text"), T.CONTENT_TYPES, "factual").alias("content_type"))


@query("b14_infer_persona", f"""
SELECT conv_id, turn, {sql_marker('text', T.PERSONAS, 'general_user')} persona,
CASE WHEN conv_id % 3 = 0 THEN 'complex_reasoning' WHEN conv_id % 3 = 1 THEN 'direct_factual' ELSE 'mixed' END AS style,
CASE WHEN n <= 10 THEN 'short' WHEN n <= 20 THEN 'medium' ELSE 'long' END AS length_class
FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) n FROM ({Q}))""")
def b14(spark, sf):
    synth = F.element_at(F.array(*map(F.lit, ("multi_hop_abstract", "single_hop_specific", "custom"))), (F.col("conv_id") % 3 + 1).cast("int"))
    q = F.col("text")
    return _questions(spark, sf).select("conv_id", "turn", T.first_marker(q, T.PERSONAS, "general_user").alias("persona"), T.style_of(synth).alias("style"), T.length_class(q).alias("length_class"))


@query("c1_token_sets", r"""
SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_一-鿿]+'))) graph_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) word_tokens,
len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) plain_tokens, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_\-]+'))) dashed_tokens FROM documents""")
def c1(spark, sf):
    n = lambda kind: F.size(T.token_set(F.col("text"), kind)).cast("long").alias(f"{kind}_tokens")
    return _docs(spark, sf).select("doc_id", *[n(k) for k in T.TOKENS])
