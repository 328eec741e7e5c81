"""Queries for entities, keyphrases and keyword fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keywords as K
from . import inputs as I
from .registry import query, table

WEIGHTS, SOURCES = {"keybert": 0.6, "yake": 0.4}, {"query": 0.5, "contexts": 0.3, "answer": 0.2}
TERMS_SQL = r"terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) term FROM benchmark)"


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("d1_entities", f"WITH {I.ENTITIES_SQL} SELECT doc_id, token, n, rank FROM ent")
def d1(spark, sf):
    return K.extract_entities(_docs(spark, sf)).select("doc_id", "token", "n", "rank")


@query("d2_keyphrases", f"WITH {I.ENTITIES_SQL}, {I.PHRASES_SQL} SELECT doc_id, token, n, rank FROM ph")
def d2(spark, sf):
    return K.extract_keyphrases(_docs(spark, sf)).select("doc_id", "token", "n", "rank")


@query("d3_domain_entities", rf"""
WITH {TERMS_SQL}, tok AS (SELECT doc_id, unnest(l) token, unnest(range(len(l))) pos FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[一-鿿]{{2,}}|[a-z]{{3,}}'), lambda w: w NOT IN ({I.STOP_SQL})) l FROM documents)),
c AS (SELECT doc_id, token, n, f, term IS NOT NULL "domain" FROM (SELECT doc_id, token, count(*) n, min(pos) f FROM tok GROUP BY 1, 2) LEFT JOIN terms ON token = term),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, "domain" ORDER BY n DESC, f) own FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "domain" DESC, n DESC, f) rank FROM o WHERE NOT "domain" OR own <= 5)
SELECT doc_id, token, "domain", n, rank FROM r WHERE rank <= 10""")
def d3(spark, sf):
    return K.extract_domain_entities(_docs(spark, sf), I.terms(spark, sf))


@query("d4_phrase_candidates")
def d4(spark, sf):
    return K.phrase_candidates(_docs(spark, sf))


@query("d5_simple_keywords", rf"""
WITH t AS (SELECT doc_id, w, min(pos) f FROM (SELECT doc_id, unnest(l) w, unnest(range(len(l))) pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') l FROM documents)) WHERE length(w) > 3 AND w NOT IN ({I.STOP_SQL}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f) rank FROM t)
SELECT d.doc_id, coalesce(k, '') keywords FROM documents d LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY rank) k FROM r WHERE rank <= 10 GROUP BY doc_id) USING (doc_id)""")
def d5(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(K.simple_keywords(F.col("text"), 10), " ").alias("keywords"))


@query("d6_top_words", f"WITH {I.TOP_WORDS_SQL} SELECT doc_id, token, n, rank FROM top WHERE rank <= 8 AND n >= 2")
def d6(spark, sf):
    return K.top_words(_docs(spark, sf), 8, least=2).select("doc_id", "token", "n", "rank")


@query("d7_combine_method_scores", f"""
WITH {I.KW_SQL}, {TERMS_SQL}
SELECT sample_id, k keyword, round(s + CASE WHEN term IS NULL THEN 0 ELSE 0.1 END, 9) score, round(a, 9) avg_score, methods FROM
(SELECT sample_id, lower(keyword) k, sum(score * CASE method WHEN 'keybert' THEN 0.6 ELSE 0.4 END) s, avg(score) a, count(DISTINCT method) methods FROM kw WHERE try_cast(keyword AS DOUBLE) IS NULL GROUP BY 1, 2) LEFT JOIN terms ON k = term""")
def d7(spark, sf):
    out = K.combine_method_scores(I.kw(spark, sf), WEIGHTS, I.terms(spark, sf))
    return out.withColumns({"score": F.round("score", 9), "avg_score": F.round("avg_score", 9)})


@query("d8_fuse_sources", f"""
WITH {I.KW_SQL}, w AS (SELECT *, CASE source WHEN 'query' THEN 0.5 WHEN 'contexts' THEN 0.3 ELSE 0.2 END w FROM kw),
t AS (SELECT sample_id, sum(w) total FROM (SELECT DISTINCT sample_id, source, w FROM w) GROUP BY 1)
SELECT sample_id, lower(keyword) keyword, round(sum(score * w / total)::DOUBLE, 9) score FROM w JOIN t USING (sample_id) GROUP BY 1, 2""")
def d8(spark, sf):
    return K.fuse_sources(I.kw(spark, sf), SOURCES).withColumn("score", F.round("score", 9))


@query("d9_select_keywords", f"""
WITH {I.KW_SQL} SELECT sample_id, keyword, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, keyword) rank FROM
(SELECT sample_id, keyword, max(score) score FROM kw WHERE score >= 0.2 GROUP BY 1, 2)) WHERE rank <= 5""")
def d9(spark, sf):
    return K.select_keywords(I.kw(spark, sf))


def _stems(spark, sf):
    """Keywords in several spellings, for the dedup operators."""
    kw = I.kw(spark, sf)
    return kw.union(kw.select("sample_id", "source", "method", F.concat(F.initcap("keyword"), F.lit("s")).alias("keyword"), F.col("score") / 2)).union(kw.select("sample_id", "source", "method", F.upper("keyword"), F.col("score") / 4))


STEMS_SQL = I.KW_SQL + """,
st AS (SELECT * FROM kw UNION ALL SELECT sample_id, source, method, upper(keyword[1]) || keyword[2:] || 's', score / 2 FROM kw UNION ALL SELECT sample_id, source, method, upper(keyword), score / 4 FROM kw)"""


@query("d10_dedup_exact", f"""
WITH {STEMS_SQL} SELECT sample_id, source, method, keyword, score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, trim(lower(keyword)) ORDER BY score DESC, keyword, source, method) r FROM st) WHERE r = 1""")
def d10(spark, sf):
    return K.dedup_exact(_stems(spark, sf))


@query("d11_dedup_substring", f"""
WITH {STEMS_SQL} SELECT * FROM st a WHERE NOT EXISTS (SELECT 1 FROM st b WHERE a.sample_id = b.sample_id AND length(b.keyword) > length(a.keyword) AND contains(b.keyword, a.keyword))""")
def d11(spark, sf):
    return K.dedup_substring(_stems(spark, sf))


@query("d12_dedup_variants", rf"""
WITH {STEMS_SQL} SELECT sample_id, source, method, keyword, score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id,
regexp_replace(trim(regexp_replace(regexp_replace(lower(keyword), '^(the|a|an)\s+', ''), '[^\p{{L}}\p{{N}}_\s]', '', 'g')), '([^s]{{3,}})s$', '\1') ORDER BY score DESC, keyword, source, method) r FROM st) WHERE r = 1""")
def d12(spark, sf):
    return K.dedup_variants(_stems(spark, sf))


@query("d13_dedup_semantic")
def d13(spark, sf):
    kw = I.kw(spark, sf)
    n = table(spark, sf, "embeddings").count()
    words = kw.select("keyword").distinct().withColumn("vec_id", F.pmod(F.xxhash64("keyword"), F.lit(n)))
    vectors = words.join(table(spark, sf, "embeddings"), "vec_id").select("keyword", "embedding")
    return K.dedup_semantic(kw, vectors, 0.3).select("sample_id", "keyword", "score")


@query("d14_keyword_presence", rf"""
WITH {I.ITEMS_SQL}, k AS (SELECT item_id, w, min(pos) f FROM (SELECT item_id, unnest(l) w, unnest(range(len(l))) pos FROM (SELECT item_id, regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+') l FROM items)) WHERE length(w) > 3 AND w NOT IN ({I.STOP_SQL}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY f) rank FROM k)
SELECT i.item_id, CASE WHEN count(w) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE contains(lower(answer), w)) / count(w), 3) END::DOUBLE presence FROM items i LEFT JOIN (SELECT * FROM r WHERE rank <= 10) k ON i.item_id = k.item_id GROUP BY i.item_id""")
def d14(spark, sf):
    kws = K.simple_keywords(F.col("question"), 10)
    return I.items(spark, sf).select("item_id", K.keyword_presence(kws, F.col("answer")).alias("presence"))


@query("d15_keyword_stats", f"""
WITH {I.KW_SQL} SELECT method, count(DISTINCT sample_id) samples, count(*) keywords, count(DISTINCT keyword) unique_keywords, count(*) / count(DISTINCT sample_id) per_sample FROM kw GROUP BY ROLLUP (method)""")
def d15(spark, sf):
    return K.keyword_stats(I.kw(spark, sf))
