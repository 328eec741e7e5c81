"""Queries for similarity joins, near-duplicates and table quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keywords as K
from ..operators import quality as Q
from ..operators import simjoin as S
from . import inputs as I
from .registry import query, table

ENT_SQL = f"{I.ENTITIES_SQL}, e AS (SELECT doc_id id, token FROM ent), en AS (SELECT id, count(*) n FROM e GROUP BY id)"
PAIRS_SQL = "pr AS (SELECT a.id i, b.id j, na.n ni, nb.n nj, count(*) c FROM {t} a JOIN {t} b ON a.token = b.token AND a.id < b.id JOIN {n} na ON na.id = a.id JOIN {n} nb ON nb.id = b.id GROUP BY 1, 2, 3, 4)"
PHR_SQL = f"{I.ENTITIES_SQL}, {I.PHRASES_SQL}, p AS (SELECT doc_id id, token FROM ph), pn AS (SELECT id, count(*) n FROM p GROUP BY id)"
#: Vectors in double precision, as Spark computes with them.
VEC_SQL = "v AS (SELECT vec_id, embedding::DOUBLE[] embedding FROM embeddings)"
COS = "list_cosine_similarity(a.embedding, b.embedding)"


def entity_sets(spark, sf):
    return I.entities(spark, sf).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("token").alias("entities"))


def phrase_sets(spark, sf):
    return K.extract_keyphrases(table(spark, sf, "documents")).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("token").alias("keyphrases"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query("e1_jaccard_join", f"WITH {ENT_SQL}, {PAIRS_SQL.format(t='e', n='en')} SELECT i, j, c common, c / (ni + nj - c) score FROM pr WHERE c / (ni + nj - c) >= 0.1")
def e1(spark, sf):
    return S.set_join(entity_sets(spark, sf), "entities", 0.1)


@query("e1_jaccard_join_prefix", f"WITH {ENT_SQL}, {PAIRS_SQL.format(t='e', n='en')} SELECT i, j, c common, c / (ni + nj - c) score FROM pr WHERE c / (ni + nj - c) >= 0.6")
def e1p(spark, sf):
    return S.set_join(entity_sets(spark, sf), "entities", 0.6)


@query("e2_overlap_join", f"WITH {PHR_SQL}, {PAIRS_SQL.format(t='p', n='pn')} SELECT i, j, c common, c / least(ni, nj) score FROM pr WHERE c / least(ni, nj) >= 0.05")
def e2(spark, sf):
    return S.set_join(phrase_sets(spark, sf), "keyphrases", 0.05, "overlap")


@query("e3_cosine_join", f"WITH {VEC_SQL} SELECT a.vec_id i, b.vec_id j, round({COS}, 4) score FROM v a, v b WHERE a.vec_id < b.vec_id AND {COS} >= 0.5")
def e3(spark, sf):
    return S.cosine_join(vectors(spark, sf), "embedding", 0.5).withColumn("score", F.round("score", 4))


@query("e3_cosine_join_strong", f"WITH {VEC_SQL} SELECT a.vec_id i, b.vec_id j, round({COS}, 4) score FROM v a, v b WHERE a.vec_id < b.vec_id AND {COS} >= 0.7")
def e3s(spark, sf):
    return S.cosine_join(vectors(spark, sf), "embedding", 0.7).withColumn("score", F.round("score", 4))


@query("e3_missing_vectors", "SELECT count(*) FILTER (WHERE embedding IS NULL) missing, count(*) total FROM embeddings")
def e3m(spark, sf):
    return S.missing_vectors(vectors(spark, sf), "embedding")


@query("e4_cosine_topk", f"""
WITH {VEC_SQL} SELECT qid, id, round(score, 4) score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) rank FROM
(SELECT a.vec_id qid, b.vec_id id, {COS} score FROM v a, v b WHERE a.vec_id % 20 = 0)) WHERE rank <= 5""")
def e4(spark, sf):
    v = vectors(spark, sf).withColumnRenamed("embedding", "v")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "qid")
    return S.cosine_topk(q, v, 5).select("qid", "id", F.round("score", 4).alias("score"), "rank")


@query("e5_edges_by_type", f"""
WITH {PHR_SQL}, {VEC_SQL}, e AS (SELECT doc_id id, token FROM ent), en AS (SELECT id, count(*) n FROM e GROUP BY id),
a AS (WITH {PAIRS_SQL.format(t='e', n='en')} SELECT * FROM pr WHERE c / (ni + nj - c) >= 0.1), b AS (WITH {PAIRS_SQL.format(t='p', n='pn')} SELECT * FROM pr WHERE c / least(ni, nj) >= 0.05)
SELECT 'jaccard_similarity' AS type, count(*) n FROM a UNION ALL SELECT 'overlap_score', count(*) FROM b UNION ALL SELECT 'cosine_similarity', count(*) FROM v a, v b WHERE a.vec_id < b.vec_id AND {COS} >= 0.7 HAVING count(*) > 0""")
def e5(spark, sf):
    nodes = entity_sets(spark, sf).join(phrase_sets(spark, sf), "id", "full").join(vectors(spark, sf), "id", "full")
    return S.count_by_type(S.build_edges(nodes, tallied=True))


@query("e6_summary_overlap", f"WITH {ENT_SQL}, {PAIRS_SQL.format(t='e', n='en')} SELECT i, j, c common, c / greatest(ni, nj) score FROM pr WHERE c / greatest(ni, nj) > 0.1")
def e6(spark, sf):
    return S.set_join(entity_sets(spark, sf), "entities", 0.1, "max", strict=True)


@query("e7_entity_overlap", f"""
WITH {ENT_SQL}, pr AS (SELECT a.id i, b.id j, na.n ni, nb.n nj, count(*) c, string_agg(a.token, ' ' ORDER BY a.token) shared FROM e a JOIN e b ON a.token = b.token AND a.id < b.id JOIN en na ON na.id = a.id JOIN en nb ON nb.id = b.id GROUP BY 1, 2, 3, 4)
SELECT i, j, c common, c / least(ni, nj) score, shared FROM pr WHERE c / least(ni, nj) > 0.2""")
def e7(spark, sf):
    return S.set_join(entity_sets(spark, sf), "entities", 0.2, "overlap", strict=True, shared=True).withColumn("shared", F.array_join("shared", " "))


def _parts(spark, sf):
    ent = I.entities(spark, sf)
    terms = I.terms(spark, sf)
    e = ent.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("token").alias("words"))
    t = ent.join(terms, F.lower("token") == F.col("term"), "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.lower("token")).alias("terms"))
    p = phrase_sets(spark, sf).withColumnRenamed("keyphrases", "phrases")
    return e.join(p, "id", "full").join(t, "id", "full")


@query("e8_content_similarity", f"""
WITH {PHR_SQL}, e AS (SELECT doc_id id, token FROM ent), en AS (SELECT id, count(*) n FROM e GROUP BY id),
terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) term FROM benchmark), t AS (SELECT DISTINCT doc_id id, lower(token) token FROM ent WHERE lower(token) IN (SELECT term FROM terms)), tn AS (SELECT id, count(*) n FROM t GROUP BY id),
a AS (WITH {PAIRS_SQL.format(t='e', n='en')} SELECT i, j, c / (ni + nj - c) * 0.4 s FROM pr), b AS (WITH {PAIRS_SQL.format(t='p', n='pn')} SELECT i, j, c / (ni + nj - c) * 0.3 s FROM pr), d AS (WITH {PAIRS_SQL.format(t='t', n='tn')} SELECT i, j, c / (ni + nj - c) * 0.3 s FROM pr),
u AS (SELECT i, j, sum(s) score FROM (FROM a UNION ALL FROM b UNION ALL FROM d) GROUP BY 1, 2 HAVING sum(s) > 0.2)
SELECT i source, j target, round(score, 9) score FROM u UNION ALL SELECT j, i, round(score, 9) FROM u""")
def e8(spark, sf):
    return S.content_similarity_join(_parts(spark, sf), 0.2).withColumn("score", F.round("score", 9))


@query("e9_threshold_sweep", f"""
WITH {ENT_SQL}, {PAIRS_SQL.format(t='e', n='en')}, s AS (SELECT c / (ni + nj - c) score FROM pr), g AS (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.8])::DOUBLE threshold)
SELECT threshold, count(score) edges, round(coalesce(avg(score), 0), 9) avg_score FROM g LEFT JOIN s ON score >= threshold GROUP BY 1""")
def e9(spark, sf):
    return S.threshold_sweep(S.set_join(entity_sets(spark, sf), "entities", 0.1, tallied=True), [0.1, 0.2, 0.3, 0.5, 0.8]).withColumn("avg_score", F.round("avg_score", 9))


@query("e10_lexical_search", r"""
WITH q AS (SELECT item_id id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) token FROM benchmark), qn AS (SELECT id, count(*) n FROM q GROUP BY 1),
p AS (SELECT doc_id id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) token FROM documents), pn AS (SELECT id, count(*) n FROM p GROUP BY 1),
s AS (SELECT q.id qid, p.id, count(*) c FROM q JOIN p USING (token) GROUP BY 1, 2), r AS (SELECT qid, s.id, c / (qn.n + pn.n - c) score FROM s JOIN qn ON qn.id = qid JOIN pn ON pn.id = s.id)
SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) rank FROM r WHERE score >= 0.05) WHERE rank <= 3""")
def e10(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), T.token_set(F.col("text")).alias("tokens"))
    p = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.token_set(F.col("text")).alias("tokens"))
    return S.lexical_search(q, p)


@query("e11_filter_new", r"SELECT doc_id, left(sha256(trim(text)), 32) hash FROM documents WHERE doc_id % 2 = 1 AND left(sha256(trim(text)), 32) NOT IN (SELECT left(sha256(trim(text)), 32) FROM documents WHERE doc_id % 2 = 0)")
def e11(spark, sf):
    h = table(spark, sf, "documents").select("doc_id", F.substring(F.sha2(F.trim("text"), 256), 1, 32).alias("hash"))
    return S.filter_new(h.where("doc_id % 2 = 1"), h.where("doc_id % 2 = 0"), "hash").select("doc_id", "hash")


CATALOG = ("customer", "documents", "events", "orders", "part")


@query("e12_column_affinity", f"""
WITH c AS ({' UNION ALL '.join(f"SELECT '{t}' AS tb, column_name cn FROM (DESCRIBE {t})" for t in CATALOG)}), k AS (SELECT DISTINCT tb, cn, unnest(list_filter(string_split_regex(lower(cn), '[^a-z0-9]+'), lambda x: x <> '')) token FROM c),
p AS (SELECT a.tb || '.' || a.cn source, b.tb || '.' || b.cn target, count(*) n FROM k a JOIN k b USING (token) WHERE (a.tb, a.cn) < (b.tb, b.cn) AND a.tb <> b.tb GROUP BY 1, 2)
SELECT source, target, least(0.95, 0.45 + 0.25 * n)::DOUBLE score FROM p ORDER BY score DESC, source, target LIMIT 10""")
def e12(spark, sf):
    cols = [F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name")) for t in CATALOG for c in table(spark, sf, t).columns]
    return S.column_affinity(spark.range(1).select(F.explode(F.array(*cols)).alias("c")).select("c.*"))


@query("e12_column_affinity_catalog", """
WITH c AS (SELECT p_brand tb, p_partkey || '_' || replace(p_name, ' ', '_') cn FROM part), k AS (SELECT DISTINCT tb, cn, unnest(list_filter(string_split_regex(lower(cn), '[^a-z0-9]+'), lambda x: x <> '')) token FROM c),
p AS (SELECT a.tb || '.' || a.cn source, b.tb || '.' || b.cn target, count(*) n FROM k a JOIN k b USING (token) WHERE (a.tb, a.cn) < (b.tb, b.cn) AND a.tb <> b.tb GROUP BY 1, 2)
SELECT source, target, least(0.95, 0.45 + 0.25 * n)::DOUBLE score FROM p ORDER BY score DESC, source, target LIMIT 25""")
def e12c(spark, sf):
    """A catalog that is a table: parts as columns of the table that their brand is."""
    name = F.concat_ws("_", F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return S.column_affinity(table(spark, sf, "part").select(F.col("p_brand").alias("table_name"), name.alias("column_name")), 25)


@query("e13_multi_hop_edges", f"""
WITH {ENT_SQL}, n AS (SELECT vec_id id, embedding::DOUBLE[] embedding FROM embeddings), x AS (SELECT * FROM e WHERE id IN (SELECT id FROM n)), xn AS (SELECT id, count(*) n FROM x GROUP BY id), {PAIRS_SQL.format(t='x', n='xn')}
SELECT 'summary' AS type, count(*) n, round(sum(list_cosine_similarity(a.embedding, b.embedding)), 1) total FROM n a, n b WHERE a.id < b.id AND list_cosine_similarity(a.embedding, b.embedding) > 0.3
UNION ALL SELECT 'entity', count(*), round(sum(c / (ni + nj - c)), 1) FROM pr UNION ALL SELECT 'content', count(*), round(sum(c / (ni + nj - c)), 1) FROM pr WHERE c / (ni + nj - c) > 0.2 AND c > 5""")
def e13(spark, sf):
    nodes = vectors(spark, sf).join(entity_sets(spark, sf), "id", "left").withColumn("words", F.col("entities"))
    return S.multi_hop_edges(nodes, tallied=True).groupBy("type").agg(F.sum("pairs").alias("n"), F.round(F.sum("total"), 1).alias("total"))


@query("f1_dedup_ingest", """
WITH RECURSIVE r AS (SELECT doc_id % 50 km_id, doc_id // 50 AS version, md5(text) checksum, doc_id arrival FROM documents), o AS (SELECT * FROM r WHERE arrival % 3 = 0), n AS (SELECT km_id, version - version % 2 AS version, checksum, arrival FROM r WHERE arrival % 3 <> 0),
f AS (SELECT *, row_number() OVER (ORDER BY arrival) i FROM n WHERE (km_id, version) NOT IN (SELECT (km_id, version) FROM o) AND checksum NOT IN (SELECT checksum FROM o)),
p(i, keep, docs, sums) AS (SELECT 0::BIGINT, false, []::VARCHAR[], []::VARCHAR[] UNION ALL
SELECT f.i, k, CASE WHEN k THEN list_append(docs, d) ELSE docs END, CASE WHEN k THEN list_append(sums, checksum) ELSE sums END
FROM p JOIN (SELECT *, km_id || '/' || version d FROM f) f ON f.i = p.i + 1, LATERAL (SELECT NOT list_contains(docs, d) AND NOT list_contains(sums, checksum) k))
SELECT km_id, version, checksum, arrival FROM f JOIN p USING (i) WHERE keep""")
def f1(spark, sf):
    r = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("km_id"), F.floor(F.col("doc_id") / 50).alias("version"), F.md5(F.col("text")).alias("checksum"), F.col("doc_id").alias("arrival"))
    new = r.where("arrival % 3 <> 0").withColumn("version", F.col("version") - F.col("version") % 2)
    return Q.dedup_ingest(new, r.where("arrival % 3 = 0")).select("km_id", "version", "checksum", "arrival")


SHINGLE_SQL = r"""
t AS (SELECT doc_id id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) token FROM t)"""


@query("f2_shingles", f"WITH {SHINGLE_SQL} SELECT id, count(*) n FROM s GROUP BY id")
def f2(spark, sf):
    return Q.shingle_sets(table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), F.col("text")).select("id", F.size("s").cast("long").alias("n"))


@query("f3_near_dedup_edges", f"WITH {SHINGLE_SQL}, sn AS (SELECT id, count(*) n FROM s GROUP BY id), {PAIRS_SQL.format(t='s', n='sn')} SELECT i, j, c common, c / (ni + nj - c) score FROM pr WHERE c / (ni + nj - c) >= 0.82")
def f3e(spark, sf):
    return S.set_join(Q.shingle_sets(table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), F.col("text")), "s", 0.82)


@query("f3_near_dedup")
def f3(spark, sf):
    return Q.near_dedup(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")).select("id")


@query("f4_length_filter", f"WITH {I.ITEMS_SQL} SELECT item_id FROM items WHERE length(trim(question)) BETWEEN 12 AND 360 AND length(trim(answer)) >= 8")
def f4(spark, sf):
    return Q.length_filter(I.items(spark, sf)).select("item_id")


@query("f5_fuzzy_dedup")
def f5(spark, sf):
    return Q.fuzzy_dedup(I.items(spark, sf).select(F.col("item_id").alias("id"), "question")).select("id")


@query("f6_semantic_dedup", f"WITH {VEC_SQL} SELECT vec_id id FROM v b WHERE NOT EXISTS (SELECT 1 FROM v a WHERE a.vec_id < b.vec_id AND {COS} > 0.8)")
def f6(spark, sf):
    return Q.semantic_dedup(vectors(spark, sf), "embedding").select("id")


RAW_SQL = "raw AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS p_name, CASE WHEN p_partkey % 7 = 0 THEN '  ' WHEN p_partkey % 5 = 0 THEN 'x' ELSE p_type END AS p_type, CASE WHEN p_partkey % 6 = 0 THEN 'n.a.' ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part)"


def _raw(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k, F.when(k % 11 == 0, None).otherwise(F.col("p_name")).alias("p_name"), F.when(k % 7 == 0, "  ").when(k % 5 == 0, "x").otherwise(F.col("p_type")).alias("p_type"),
        F.when(k % 6 == 0, "n.a.").otherwise(F.col("p_size").cast("string")).alias("p_size"),
    )


@query("f7_clean_table", f"""
WITH {RAW_SQL}, c AS (SELECT DISTINCT p_partkey, trim(p_name) p_name, CASE WHEN p_type IS NULL OR trim(p_type) = '' THEN '[Missing p_type]' ELSE trim(p_type) END AS p_type, coalesce(try_cast(p_size AS DOUBLE), 0) p_size FROM raw WHERE p_name IS NOT NULL),
v AS (SELECT *, length(p_type) < 10 short FROM c WHERE p_type NOT LIKE '[Missing%')
SELECT p_partkey, p_name, p_type, p_size FROM v WHERE NOT short OR (SELECT avg(short::INT) FROM v) > 0.5""")
def f7(spark, sf):
    return Q.clean_table(_raw(spark, sf).withColumn("p_name", F.trim("p_name")), ["p_name"], ["p_type"], ["p_size"], ["p_type"])


@query("f8_quality_report", f"""
WITH {RAW_SQL}, u AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {c}::VARCHAR v FROM raw" for c in ('p_name', 'p_type', 'p_size'))})
SELECT col "column", count(*) "rows", count(*) FILTER (WHERE v IS NULL OR trim(v) = '') nulls, count(*) FILTER (WHERE v IS NULL OR trim(v) = '') / count(*) null_share, count(*) FILTER (WHERE try_cast(v AS DOUBLE) IS NOT NULL) / count(*) numeric_share, count(DISTINCT v) distinct_values FROM u GROUP BY col""")
def f8(spark, sf):
    return Q.quality_report(_raw(spark, sf), ["p_name", "p_type", "p_size"])


SAMPLES_SQL = f"{I.ITEMS_SQL}, smp AS (SELECT item_id, conv_id % 10 batch, CASE WHEN item_id % 9 = 0 THEN NULL WHEN item_id % 8 = 0 THEN 'N/A' WHEN item_id % 7 = 0 THEN 'ab' ELSE question END AS question, CASE WHEN item_id % 5 = 0 THEN '[Missing answer]' ELSE answer END AS answer FROM items)"
VALID_SQL = r"""val AS (SELECT *, CASE WHEN question IS NULL THEN 'missing question' WHEN regexp_matches(trim(question), '(?i)^\s*(\[missing.*|n/?a|none|null|todo|tbd|placeholder)\s*$') THEN 'placeholder question' WHEN length(trim(question)) < 5 THEN 'short question'
WHEN answer IS NULL THEN 'missing answer' WHEN regexp_matches(trim(answer), '(?i)^\s*(\[missing.*|n/?a|none|null|todo|tbd|placeholder)\s*$') THEN 'placeholder answer' WHEN length(trim(answer)) < 5 THEN 'short answer' END AS reason FROM smp)"""


def samples(spark, sf):
    i = F.col("item_id")
    q = F.when(i % 9 == 0, None).when(i % 8 == 0, "N/A").when(i % 7 == 0, "ab").otherwise(F.col("question"))
    return I.items(spark, sf).select("item_id", (F.col("conv_id") % 10).alias("batch"), q.alias("question"), F.when(i % 5 == 0, "[Missing answer]").otherwise(F.col("answer")).alias("answer"))


@query("f9_validate_samples", f"WITH {SAMPLES_SQL}, {VALID_SQL} SELECT item_id, reason IS NULL AS valid, reason FROM val")
def f9(spark, sf):
    return Q.validate_samples(samples(spark, sf), ["question", "answer"]).select("item_id", "valid", "reason")


@query("f10_map_sample_fields", f"WITH {SAMPLES_SQL} SELECT item_id, question user_input, answer response, NULL::VARCHAR reference, CASE WHEN answer IS NULL THEN 0 ELSE 1 END::INTEGER n_contexts FROM smp")
def f10(spark, sf):
    out = Q.map_sample_fields(samples(spark, sf).withColumn("context", F.col("answer")))
    return out.select("item_id", "user_input", "response", "reference", F.size("retrieved_contexts").alias("n_contexts"))


@query("f11_validation_summary", f"""
WITH {SAMPLES_SQL}, {VALID_SQL} SELECT batch, count(*) "input", count(*) FILTER (WHERE reason IS NULL) valid_rows, count(*) FILTER (WHERE reason IS NOT NULL) rejected, count(*) FILTER (WHERE reason IS NULL) / count(*) success_rate,
CASE WHEN count(*) FILTER (WHERE reason IS NULL) / count(*) < 0.8 THEN 'FAILED' ELSE 'PASSED' END AS status FROM val GROUP BY batch""")
def f11(spark, sf):
    return Q.validation_summary(Q.validate_samples(samples(spark, sf), ["question", "answer"]), "batch")
