"""Queries for item-level metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from . import inputs as I
from .registry import query, table

W = r"'[\p{L}\p{N}_]+'"
TOK_SQL = f"{I.ITEMS_SQL}, cc AS (SELECT item_id, string_agg(context, ' ' ORDER BY rank) c FROM ctx GROUP BY 1), tk AS (SELECT item_id, conv_id, question, answer, list_distinct(regexp_extract_all(lower(question), {W})) q, list_distinct(regexp_extract_all(lower(answer), {W})) a, list_distinct(regexp_extract_all(lower(coalesce(c, '')), {W})) c FROM items LEFT JOIN cc USING (item_id))"
KWS_SQL = f"{I.ITEMS_SQL}, kws AS (SELECT item_id, answer, list_sort(list_distinct(regexp_extract_all(lower(question), {W}))) k FROM items)"


def r_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len({a}) END::DOUBLE"


def toks(spark, sf):
    return M.with_tokens(I.full_items(spark, sf))


def kws(spark, sf):
    """item_id, text, keywords: all words of the question; those of more than three letters are the mandatory ones where roles count."""
    return I.items(spark, sf).select("item_id", F.col("answer").alias("text"), F.array_sort(T.token_set(F.col("question"))).alias("keywords"))


@query("i1_faithfulness", f"WITH {TOK_SQL} SELECT item_id, {r_sql('a', 'c')} v FROM tk")
def i1(spark, sf):
    return toks(spark, sf).select("item_id", M.faithfulness().alias("v"))


@query("i2_answer_relevancy", f"WITH {TOK_SQL} SELECT item_id, {r_sql('a', 'q')} v FROM tk")
def i2(spark, sf):
    return toks(spark, sf).select("item_id", M.answer_relevancy().alias("v"))


@query("i3_context_precision", f"WITH {TOK_SQL} SELECT item_id, {r_sql('c', 'a')} v FROM tk")
def i3(spark, sf):
    return toks(spark, sf).select("item_id", M.context_precision().alias("v"))


@query("i4_keyword_gate", f"""
WITH {KWS_SQL}, r AS (SELECT item_id, lower(answer) t, list_filter(k, lambda x: length(x) > 3) m, list_filter(k, lambda x: length(x) <= 3) o FROM kws), s AS (SELECT item_id, CASE WHEN len(m) = 0 THEN 0.0 ELSE len(list_filter(m, lambda x: contains(t, x))) / len(m) END * 0.8 + CASE WHEN len(o) = 0 THEN 1.0 ELSE len(list_filter(o, lambda x: contains(t, x))) / len(o) END * 0.2 s FROM r)
SELECT item_id, round(s::DOUBLE, 9) score, s >= 0.6 passed FROM s""")
def i4(spark, sf):
    g = M.keyword_gate(F.filter("keywords", lambda k: F.length(k) > 3), F.filter("keywords", lambda k: F.length(k) <= 3), F.col("text"))
    return kws(spark, sf).select("item_id", g.alias("g")).select("item_id", F.round("g.score", 9).alias("score"), "g.passed")


SYN = [("de", "der"), ("la", "las"), ("the", "that")]
MATCH_SQL = f"""{KWS_SQL}, kk AS (SELECT item_id, lower(answer) t, regexp_extract_all(lower(answer), {W}) w, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) keyword FROM kws), sy AS (SELECT * FROM (VALUES ('de', 'der'), ('la', 'las'), ('the', 'that')) v(keyword, synonym)),
o AS (SELECT kk.item_id, kk.keyword, CASE WHEN contains(t, kk.keyword) OR contains(t, replace(kk.keyword, ' ', '')) OR (synonym IS NOT NULL AND contains(t, synonym)) THEN 1.0 ELSE 0.75 * len(list_filter(string_split(kk.keyword, ' '), lambda x: list_contains(w, x))) / len(string_split(kk.keyword, ' ')) END one FROM kk LEFT JOIN sy ON sy.keyword = kk.keyword),
km AS (SELECT i.item_id, coalesce(avg(one), 1.0)::DOUBLE score, count(*) FILTER (WHERE one >= 0.5) matched, count(keyword) total, coalesce(string_agg(keyword, '|' ORDER BY keyword) FILTER (WHERE one < 0.5), '') missing FROM items i LEFT JOIN o USING (item_id) GROUP BY 1)"""


def _match(spark, sf, fuzzy=False):
    syn = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("keyword"), F.lit(b).alias("synonym")) for a, b in SYN])).alias("s")).select("s.*")
    k = F.col("keywords")
    pairs = F.zip_with(F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0))), F.slice(k, 2, F.greatest(F.size(k), F.lit(1))), lambda x, y: F.concat_ws(" ", x, y))
    words = kws(spark, sf).withColumn("keywords", F.concat(k, pairs))
    return M.keyword_match(words, syn, fuzzy)


@query("i5_keyword_match", f"WITH {MATCH_SQL} SELECT item_id, round(score, 9) score, matched, total, missing FROM km")
def i5(spark, sf):
    return _match(spark, sf).withColumns({"score": F.round("score", 9), "missing": F.array_join("missing", "|")})


@query("i5_keyword_match_fuzzy")
def i5f(spark, sf):
    return _match(spark, sf, fuzzy=True)


@query("i6_keyword_summary", f"WITH {MATCH_SQL} SELECT count(*) items, round(avg(score), 9) mean_score, count(*) FILTER (WHERE score >= 0.6) passed, count(*) FILTER (WHERE score < 0.6) failed, round(avg((score >= 0.6)::INT), 9) pass_rate FROM km")
def i6(spark, sf):
    return M.keyword_summary(_match(spark, sf)).withColumns({"mean_score": F.round("mean_score", 9), "pass_rate": F.round("pass_rate", 9)})


@query("i7_fuzzy_keywords", f"""
WITH {I.ITEMS_SQL}, kws AS (SELECT item_id, answer, list_sort(list_distinct(regexp_extract_all(lower(question), '[a-z0-9_]+'))) k FROM items), p AS (SELECT item_id, unnest(k) k, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9_]+')) w FROM kws), b AS (SELECT item_id, coalesce(list_max(list_transform(w, lambda x: 1 - levenshtein(x, k) / greatest(length(x), length(k)))), 0) best FROM p)
SELECT item_id, count(*) FILTER (WHERE best >= 0.8) / count(*) match_rate FROM b GROUP BY 1""")
def i7(spark, sf):
    k = F.array_sort(T.token_set(F.col("question"), "plain"))
    return M.fuzzy_keywords(I.items(spark, sf).select("item_id", F.col("answer").alias("text"), k.alias("keywords")), kind="plain")


METHODS = {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}


@query("i8_combine_methods", """
WITH s AS (SELECT user_id item_id, chr(CAST(97 + event_id % 4 AS INTEGER)) AS method, max(value) / 40 score FROM events WHERE user_id % 3 <> event_id % 4 GROUP BY 1, 2), w AS (SELECT *, CASE method WHEN 'a' THEN 0.4 WHEN 'b' THEN 0.3 WHEN 'c' THEN 0.2 ELSE 0.1 END w FROM s),
c AS (SELECT item_id, (sum(score * w) / sum(w))::DOUBLE score, max_by(method, (score, w)) best FROM w GROUP BY 1)
SELECT item_id, round(score, 9) score, best, 0.6 - CASE WHEN item_id % 2 = 0 THEN 0.05 ELSE 0 END - CASE WHEN item_id % 5 = 0 THEN 0.05 ELSE 0 END threshold, score >= 0.6 - CASE WHEN item_id % 2 = 0 THEN 0.05 ELSE 0 END - CASE WHEN item_id % 5 = 0 THEN 0.05 ELSE 0 END passes FROM c""")
def i8(spark, sf):
    e = table(spark, sf, "events").where("user_id % 3 <> event_id % 4")
    s = e.groupBy(F.col("user_id").alias("item_id"), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("event_id") % 4 + 1).cast("int")).alias("method")).agg((F.max("value") / 40).alias("score"))
    i = F.col("item_id")
    t = s.select("item_id").distinct().select("item_id", M.adaptive_threshold(F.when(i % 2 == 0, "chinese").otherwise("english"), F.when(i % 5 == 0, "technical").otherwise("general")).alias("threshold"))
    return M.combine_methods(s, METHODS, t).withColumns({"score": F.round("score", 9), "threshold": F.round("threshold", 9)})


@query("i9_domain_rule_score", f"WITH {I.ITEMS_SQL} SELECT item_id, (contains(lower(answer), 'the')::INT + contains(lower(answer), 'de ')::INT + regexp_matches(answer, '[A-Z][a-z]+ing')::INT) / 3 score FROM items")
def i9(spark, sf):
    return I.items(spark, sf).select("item_id", M.domain_rule_score(F.col("answer"), ["the", "de "], ["[A-Z][a-z]+ing"]).alias("score"))


@query("i10_weighted_domain_score", f"""
WITH {I.METRICS_SQL}, a AS (SELECT run_id, metric, avg(value) m FROM m WHERE NOT isnan(value) AND value IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, CASE metric WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.5 ELSE 0 END w FROM a)
SELECT run_id, round((sum(m * w) / sum(w))::DOUBLE, 9) score FROM w GROUP BY 1""")
def i10(spark, sf):
    m = I.metrics(spark, sf).where("value is not null and not isnan(value)")
    return M.weighted_domain_score(m, {"click": 0.5, "view": 0.5}).withColumn("score", F.round("score", 9))


@query("i11_tool_metrics", r"""
WITH t AS (SELECT user_id item_id, list(event_type ORDER BY event_id) used, list(value > 5 ORDER BY event_id) ok FROM events GROUP BY 1)
SELECT item_id, len(list_intersect(['click', 'view', 'refund'], used)) / 3 accuracy, round(len(list_filter(ok, lambda x: x)) / len(used) * (len(list_distinct(used)) / len(used)), 9) efficiency FROM t""")
def i11(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("event_id", "event_type", (F.col("value") > 5).alias("ok"))))
    t = table(spark, sf, "events").groupBy(F.col("user_id").alias("item_id")).agg(rows.alias("r"))
    t = t.select("item_id", F.array(*map(F.lit, ("click", "view", "refund"))).alias("expected"), F.transform("r", lambda x: x.event_type).alias("used"), F.transform("r", lambda x: x.ok).alias("ok"))
    return M.tool_metrics(t).withColumn("efficiency", F.round("efficiency", 9))


D = r"'[A-Za-z0-9_\-]+'"


@query("i12_multimodal_metrics", rf"""
WITH {I.ITEMS_SQL}, mm AS (SELECT i.item_id, list_distinct(regexp_extract_all(any_value(question), {D})) q, list_distinct(regexp_extract_all(any_value(answer), {D})) a, list_distinct(flatten(list(regexp_extract_all(context, {D})))) c, count(*) n,
count(*) FILTER (WHERE len(list_intersect(regexp_extract_all(context, {D}), regexp_extract_all(answer, {D}))) > 0) used, count(DISTINCT rank % 2) k FROM items i JOIN ctx USING (item_id) GROUP BY 1)
SELECT item_id, {r_sql('a', 'c')} faithfulness, {r_sql('a', 'q')} relevance, used / n coverage, k n_modalities FROM mm""")
def i12(spark, sf):
    kind = F.when(F.col("rank") % 2 == 0, "image").otherwise("text")
    ctx = I.contexts(spark, sf).groupBy("item_id").agg(F.collect_list(F.struct(kind.alias("type"), F.col("context").alias("text"))).alias("contexts"))
    return M.multimodal_metrics(I.items(spark, sf).join(ctx, "item_id")).withColumn("n_modalities", F.col("n_modalities").cast("long"))


def _rule_sql(kind: str) -> str:
    marks = ", ".join(f"'{x}'" for x in M.RULES[kind])
    q, a = "regexp_extract_all(lower(question), '[a-z0-9_]+')", "regexp_extract_all(lower(answer), '[a-z0-9_]+')"
    return f"CASE WHEN len(list_intersect([{marks}], {q})) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect([{marks}], {q}), {a})) / len(list_intersect([{marks}], {q})) END::DOUBLE {kind}"


@query("i13_rule_scores", f"WITH {I.ITEMS_SQL} SELECT item_id, {', '.join(map(_rule_sql, M.RULES))} FROM items")
def i13(spark, sf):
    return I.items(spark, sf).select("item_id", *[M.rule_score(F.col("question"), F.col("answer"), k).alias(k) for k in M.RULES])


THREE_SQL = f"{TOK_SQL}, th AS (SELECT item_id, {r_sql('a', 'c')} f, {r_sql('a', 'q')} r, {r_sql('c', 'a')} p FROM tk)"


def three(spark, sf):
    return toks(spark, sf).select("item_id", M.faithfulness().alias("f"), M.answer_relevancy().alias("r"), M.context_precision().alias("p"))


@query("i14_panel_verdicts", f"""
WITH {THREE_SQL}, v AS (SELECT item_id, f >= 0.2 a, r >= 0.1 b, p >= 0.05 c FROM th)
SELECT item_id, a::INT + b::INT + c::INT approvals, greatest(a::INT + b::INT + c::INT, 3 - (a::INT + b::INT + c::INT)) / 3 agreement, concat_ws(',', CASE WHEN NOT a THEN 'grounding' END, CASE WHEN NOT b THEN 'relevance' END, CASE WHEN NOT c THEN 'precision' END) dissent FROM v""")
def i14(spark, sf):
    return M.panel_verdicts(three(spark, sf), [("grounding", "f", 0.2), ("relevance", "r", 0.1), ("precision", "p", 0.05)])


@query("i15_composite_pass", f"WITH {THREE_SQL} SELECT item_id, round((0.3 * f + 0.4 * r + 0.3 * p)::DOUBLE, 9) score, ((f >= 0.2)::INT + (r >= 0.1)::INT + (p >= 0.05)::INT) >= 2 passed FROM th")
def i15(spark, sf):
    out = M.composite_pass(three(spark, sf), {"f": 0.3, "r": 0.4, "p": 0.3}, {"f": 0.2, "r": 0.1, "p": 0.05}, "majority")
    return out.select("item_id", F.round("score", 9).alias("score"), "passed")


@query("i16_capture_contexts", f"WITH {I.ITEMS_SQL} SELECT i.item_id, CASE WHEN i.item_id % 4 = 0 THEN 0 ELSE count(c.rank) END::INTEGER context_count, CASE WHEN i.item_id % 4 = 0 THEN 1 ELSE count(c.rank) END::INTEGER rows_after FROM items i LEFT JOIN ctx c USING (item_id) GROUP BY 1")
def i16(spark, sf):
    it = I.full_items(spark, sf).withColumn("contexts", F.when(F.col("item_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("contexts")))
    return M.capture_contexts(it).select("item_id", "context_count", F.size("contexts").alias("rows_after"))


@query("i17_metric_plugins", f"WITH {THREE_SQL} SELECT item_id, 'faithfulness' metric, '1' AS version, f AS value FROM th UNION ALL SELECT item_id, 'answer.relevancy', '2', r FROM th UNION ALL SELECT item_id, 'answer.length', '2', length(answer)::DOUBLE FROM items")
def i17(spark, sf):
    specs = [
        M.MetricSpec("faithfulness", "1", lambda: {"": M.faithfulness()}), M.MetricSpec("answer", "2", lambda: {"relevancy": M.answer_relevancy(), "length": F.length("answer")}),
        M.MetricSpec("broken", "1", lambda: {"": F.col("no_such_column")}),
    ]
    return M.apply_metrics(toks(spark, sf), specs)[0]


@query("i18_ngram_overlap", rf"""
WITH {I.ITEMS_SQL}, t AS (SELECT item_id, regexp_extract_all(lower(answer), {W}) a, regexp_extract_all(lower(question), {W}) r FROM items),
x AS (SELECT item_id, g, count(*) x FROM (SELECT item_id, unnest(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) g FROM t) GROUP BY 1, 2), y AS (SELECT item_id, g, count(*) y FROM (SELECT item_id, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) g FROM t) GROUP BY 1, 2),
s AS (SELECT item_id, sum(least(coalesce(x, 0), coalesce(y, 0))) hit, sum(coalesce(x, 0)) nx, sum(coalesce(y, 0)) ny FROM x FULL JOIN y USING (item_id, g) GROUP BY 1)
SELECT item_id, CASE WHEN nx > 0 THEN hit / nx ELSE 0 END::DOUBLE "precision", CASE WHEN ny > 0 THEN hit / ny ELSE 0 END::DOUBLE recall, round(CASE WHEN nx >= ny THEN 1 WHEN nx = 0 THEN 0 ELSE exp(1 - ny / nx) END::DOUBLE, 9) brevity FROM s""")
def i18(spark, sf):
    t = I.items(spark, sf).select("item_id", T.tokens(F.col("answer")).alias("at"), T.tokens(F.col("question")).alias("rt"))
    return M.ngram_overlap(t, 2).withColumn("brevity", F.round("brevity", 9))


@query("b15_highlight_matches", r"""
WITH """ + I.ITEMS_SQL + r""", w AS (SELECT item_id, answer, CASE WHEN item_id % 2 = 0 THEN list_filter(regexp_extract_all(question, '[A-Z][a-z]{3,}'), lambda x: x <> '') ELSE [] END e FROM items),
a AS (SELECT item_id, unnest(l) t, unnest(range(len(l))) p FROM (SELECT item_id, list_filter(string_split_regex(answer, '[\s,.;:!?、。，！？·\-–—/\\()\[\]{}\"「」『』【】《》〈〉]+'), lambda x: length(x) >= 4) l FROM w WHERE len(e) = 0)),
r AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY length(t) DESC, p) n FROM (SELECT item_id, t, min(p) p FROM a GROUP BY 1, 2)),
terms AS (SELECT item_id, t, 'entity' tier FROM (SELECT item_id, unnest(e) t FROM w) UNION ALL SELECT item_id, t, 'overlap' FROM r WHERE n <= 12)
SELECT c.item_id, c.rank - 1 pos, coalesce(any_value(tier), 'none') tier, CAST(coalesce(sum((length(context) - length(replace(lower(context), lower(t), ''))) // length(t)), 0) AS BIGINT) matches FROM (SELECT item_id, context, row_number() OVER (PARTITION BY item_id ORDER BY rank) rank FROM ctx) c LEFT JOIN terms t ON t.item_id = c.item_id GROUP BY c.item_id, c.rank""")
def b15(spark, sf):
    i = I.full_items(spark, sf)
    entities = F.when(F.col("item_id") % 2 == 0, F.regexp_extract_all("question", F.lit("[A-Z][a-z]{3,}"), F.lit(0)))
    return M.highlight_matches(i.withColumn("entities", entities)).withColumn("pos", F.col("pos").cast("long"))
