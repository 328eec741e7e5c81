"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, flac, langid, neardup, packing, phrases, quality, repair, token_files, toxicity, url_filter, warc
from .shared import fresh_path, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_conversations(chat.as_events(rows.union(probe))))


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_features(flac.media_table(table(spark, sf_dir, "documents")), fresh_path(spark, "pcm")).drop("error")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    profiles = langid.train(docs.where(~out))
    return langid.identify(docs, profiles).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "ids")
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), BYTE_BPE, folder, end_id=2), folder)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(rows), rows)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_toxicity, op3_chat, op4_flac, op5_packing, op6_language_id, op7_warc, op8_bpe, op9_quality, op10_near_duplicates,
        op11_token_files, op12_conversation_repair, op13_phrases,
    )
}


def _quality_sql() -> str:
    """The counts, the sketches and the fences of op9 in SQL."""
    metrics = [f.metric for f in quality.FENCES]
    hi = {m: f"(b.{m}90 + {quality.REACH} * (b.{m}90 - b.{m}50) + b.{m}90 // {quality.BUCKET_ERROR})" for m in metrics}
    lo = {m: f"(b.{m}10 - {quality.REACH} * (b.{m}50 - b.{m}10) - b.{m}10 // {quality.BUCKET_ERROR})" for m in metrics}
    rules = []
    for f in quality.FENCES:
        rule = f"r.{f.metric} > {hi[f.metric]}"
        if f.count:
            rule += f" AND pow((r.{f.count} * 1000 - {hi[f.metric]} * r.n_words)::DOUBLE, 2) > r.{f.count}::DOUBLE * {quality.ERRORS**2 * f.unit * 1_000_000}.0"
        rules.append(f"({rule} OR r.{f.metric} < {lo[f.metric]})" if f.low else f"({rule})")
    broken = " OR ".join(rules)
    at = lambda p: f"min(bucket) FILTER (WHERE rn * 100 >= n * {p})"
    pick = ", ".join(f"max(CASE WHEN metric = '{m}' THEN (o.n * o.a{q} + {quality.POOL_WEIGHT} * p.a{q}) // (o.n + {quality.POOL_WEIGHT}) END) {m}{q}" for m in metrics for q in (10, 50, 90))
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) i FROM w)), rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i, i + 8)) p FROM rep) GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (SELECT w.doc_id, lang, source, len(w)::BIGINT n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols, coalesce(dup.n, 0) n_dup_lines, coalesce(cov.n, 0) n_repeat_words FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, floor(word_chars * 1000 / greatest(n_words, 1))::BIGINT word_len, floor(n_symbols * 1000 / greatest(n_words, 1))::BIGINT symbols, floor(n_dup_lines * 1000 / greatest(n_words, 1))::BIGINT dup_lines, floor(n_repeat_words * 1000 / greatest(n_words, 1))::BIGINT repeats FROM s),
l AS (SELECT lang, source, metric, v - v % CAST(pow(2, greatest(length(bin(v)) - 5, 0)) AS BIGINT) bucket FROM ({' UNION ALL '.join(f"SELECT lang, source, '{m}' metric, {m} v FROM r" for m in metrics)})),
o AS (SELECT lang, source, metric, any_value(n) n, {at(10)} a10, {at(50)} a50, {at(90)} a90 FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, metric ORDER BY bucket) rn, count(*) OVER (PARTITION BY lang, source, metric) n FROM l) GROUP BY ALL),
p AS (SELECT metric, {at(10)} a10, {at(50)} a50, {at(90)} a90 FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY bucket) rn, count(*) OVER (PARTITION BY metric) n FROM l) GROUP BY 1),
b AS (SELECT lang, source, {pick} FROM o JOIN p USING (metric) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR n_repeat_words * 100 > n_words * 30) base_failed, NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND NOT ({broken}) kept
FROM r JOIN b ON r.lang IS NOT DISTINCT FROM b.lang AND r.source IS NOT DISTINCT FROM b.source"""


def _repair_sql() -> str:
    """The damage, the faults and the cheapest edits of op12, row by row."""
    entry = lambda v, cost, edit, text: f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + {cost}, 'a': {v}.a || '{edit}', 't': {v}.t || {text}}} END"
    least = lambda *options: f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"
    put = lambda v, name, n=1: entry(v, 2 * n, "I" * n, f"chr(10) || '{name}'")
    both = "user:' || chr(10) || 'assistant:"
    closed = [
        "{0}0 {1}0", "{0}1 {1}1",
        least("{0}2", put("{0}0", "user:"), put("{0}1", "user:"), put("{0}3", "user:")) + " {1}2",
        least("{0}3", put("{0}2", "assistant:"), put("{0}0", both, 2), put("{0}1", both, 2)) + " {1}3",
    ]
    fill = lambda parts, v, name: ", ".join(p.replace("{0}", v).replace("{1}", name) for p in parts)
    keep = lambda v, role: f"CASE WHEN NOT gone AND ini = '{role}' THEN {entry(v, 'extra', 'K', 'chr(10) || own')} END"
    said = lambda name: f"chr(10) || '{name}:' || text"
    rerole = lambda v, name: f"CASE WHEN NOT gone THEN {entry(v, '2 + extra', 'R', said(name))} END"
    drop = lambda v: entry(v, 3, "D", "''")
    into = [
        drop("c0"),
        least(drop("c1"), keep("c0", "s")),
        least(drop("c2"), *[f(v, x) for v in ("c0", "c1", "c3") for f, x in ((keep, "u"), (rerole, "user"))]),
        least(drop("c3"), keep("c2", "a"), rerole("c2", "assistant")),
    ]
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') key FROM conversations),
z AS (SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(key, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) ELSE xor(h >> 1, (h & 1) * 3988292384) END), 4294967295) % 20 kind FROM k),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) copy FROM z WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) r FROM d),
f AS (SELECT *, left(role, 1) ini, role || ':' || text own, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END fault,
lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY r) || left(role, 1) AS pair FROM n),
g AS (SELECT *, fault IN ('blank', 'duplicate') gone, (fault = 'truncated')::BIGINT extra FROM f),
rec AS (SELECT conv_id, 0::BIGINT r, {{'c': 0::BIGINT, 'a': '', 't': ''}} v0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) v1, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) v2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) v3 FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT conv_id, r, {', '.join(into)} FROM (SELECT g.conv_id, g.r, g.gone, g.extra, g.ini, g.own, g.text, {fill(closed, 'v', 'c')} FROM rec JOIN g ON rec.conv_id IS NOT DISTINCT FROM g.conv_id AND g.r = rec.r + 1)),
o AS (SELECT conv_id, {least('c0', 'c3')} best FROM (SELECT conv_id, {fill(closed, 'v', 'c')} FROM rec QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY r DESC) = 1)),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (WHERE fault = 'blank') blank, count(*) FILTER (WHERE fault = 'duplicate') duplicate, count(*) FILTER (WHERE fault = 'truncated') truncated, count(*) FILTER (WHERE r > 1 AND pair NOT IN ('su', 'ua', 'au')) illegal FROM f GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0)::BIGINT blank, coalesce(duplicate, 0)::BIGINT duplicate, coalesce(truncated, 0)::BIGINT truncated, coalesce(illegal, 0)::BIGINT illegal, best.c AS cost, best.a audit, sha256(substr(best.t, 2)) repaired_sha256 FROM o LEFT JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id"""


_ESC = r"replace(replace(replace({}, '\', '\\'), '<|', '\<'), chr(10), '\n')"
ORACLE_SQL: dict[str, str] = {
    "op3_chat": rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') t FROM conversations UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (SELECT conv_id, count(*) n_turns, string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn) s, coalesce(string_agg(t, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') l, string_agg('<|im_start|>' || {_ESC.format('role')} || chr(10) || {_ESC.format('t')} || '<|im_end|>' || chr(10), '' ORDER BY turn) f FROM c GROUP BY 1)
SELECT conv_id, n_turns, sha256(s) turns_sha256, length(l) loss_chars, sha256(l) loss_sha256, length(f) formatted_chars FROM g""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages), f AS (SELECT sha256(h) d, min(page_id) least FROM p WHERE strlen(h) >= 100 GROUP BY 1)
SELECT page_id, strlen(h) payload_bytes, sha256(h) payload_digest, CASE WHEN least <> page_id THEN 'revisit' ELSE 'response' END record_type, CASE WHEN least <> page_id THEN least END refers_to FROM p LEFT JOIN f ON sha256(h) = d""",
    "op9_quality": _quality_sql(),
    "op12_conversation_repair": _repair_sql(),
    "op13_phrases": rf"""
WITH p AS (SELECT coalesce(lang, 'und') lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') w FROM documents),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) phrase FROM p, (SELECT unnest([1, 2, 3, 4]) size)),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT f FROM g GROUP BY ALL HAVING count(*) >= {phrases.LEAST}), t AS (SELECT lang, sum(len(w))::BIGINT n FROM p GROUP BY 1),
c AS (SELECT lang, size, phrase, f a, string_split(phrase, ' ') w, unnest(range(1, size)) k FROM f WHERE size > 1),
s AS (SELECT c.lang, c.phrase, c.a, k, x.f l, y.f r, {phrases.SCALE} * c.a // (x.f + y.f) score FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ') QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
b AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') phrase, max(a) around FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) i FROM (SELECT lang, w, a, size, unnest(range(2, size)) m FROM c WHERE k = 1)) GROUP BY 1, 2)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a::BIGINT a, l::BIGINT l, r::BIGINT r, n, score::BIGINT score
FROM s JOIN t ON t.lang = s.lang LEFT JOIN b ON b.lang = s.lang AND b.phrase = s.phrase WHERE around IS NULL OR 100 * around < {phrases.INSIDE} * s.a QUALIFY rank <= {phrases.TOP}""",
}
