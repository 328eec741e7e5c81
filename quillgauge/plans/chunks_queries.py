"""Queries for sentences, chunks and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from .registry import query, table

PIECES = r"""[^\n.?!。？！；]*[.?!。？！；]["''”’」』）)\]]*|[^\n.?!。？！；]+"""


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("c2_sentences", rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{PIECES}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') s FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) pos, s[i] sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) i FROM s)""")
def c2(spark, sf):
    return C.sentences(_docs(spark, sf)).select("doc_id", "pos", "sentence")


@query("c3_split_sentences", r"""
SELECT doc_id, trim(s) sentence FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([。！？.!?])\s*', '\1' || chr(1), 'g'), chr(1))) s FROM documents) WHERE trim(s) <> ''""")
def c3(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(C.split_sentences(F.col("text"))).alias("sentence"))


@query("c4_chunk_documents")
def c4(spark, sf):
    return C.chunk_documents(_docs(spark, sf))


@query("c5_chunk_histogram", r"""
WITH c AS (SELECT substring(text, CAST(i * 800 + 1 AS BIGINT), 1000) chunk FROM (SELECT text, unnest(range(0, (greatest(length(text) - 1, 0) // 800) + 1)) i FROM documents)),
w AS (SELECT len(list_filter(regexp_split_to_array(chunk, '\s+'), lambda x: x <> '')) n FROM c WHERE length(chunk) >= 100)
SELECT (((n - 1) // 100) * 100) || '-' || (((n - 1) // 100) * 100 + 100) bucket, count(*) chunks, CAST(sum(n) AS BIGINT) tokens FROM w WHERE n > 0 GROUP BY 1""")
def c5(spark, sf):
    from ..functions.text import words

    chunks = C.chunk_chars(_docs(spark, sf)).select(F.size(words(F.col("chunk"))).alias("token_count")).where("token_count > 0")
    return C.chunk_histogram(chunks)


@query("c6_chunk_chars", r"""
SELECT doc_id, CAST(i AS INTEGER) pos, chunk FROM (SELECT doc_id, i, substring(text, CAST(i * 800 + 1 AS BIGINT), 1000) chunk FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 1, 0) // 800) + 1)) i FROM documents)) WHERE length(chunk) >= 100""")
def c6(spark, sf):
    return C.chunk_chars(_docs(spark, sf))


@query("c6_chunk_chars_at_breaks")
def c6b(spark, sf):
    return C.chunk_chars_at_breaks(_docs(spark, sf))


@query("c7_pack_passages")
def c7(spark, sf):
    return C.pack_passages(_docs(spark, sf))


@query("c8_aggregate_documents")
def c8(spark, sf):
    return C.aggregate_documents(_docs(spark, sf), "source", 3000, 500, 6000)


@query("c9_multi_hop_groups", r"""
WITH r AS (SELECT source, doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) n, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 3 grp FROM documents),
t AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY source, doc_id ROWS UNBOUNDED PRECEDING) total FROM r)
SELECT grp, count(*) docs, CAST(sum(n) AS BIGINT) tokens FROM t WHERE total <= 6000 GROUP BY grp HAVING sum(n) >= 2800""")
def c9(spark, sf):
    return C.multi_hop_groups(_docs(spark, sf), 4000)


@query("c10_corpus_stats", r"""
SELECT lang, source, count(*) docs, CAST(sum(w) AS BIGINT) words, CAST(sum(c) AS BIGINT) chars, sum(w) / count(*) avg_words FROM
(SELECT lang, source, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) w, length(text) c FROM documents) GROUP BY ROLLUP (lang, source)""")
def c10(spark, sf):
    return C.corpus_stats(_docs(spark, sf))
