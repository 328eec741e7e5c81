"""Item-level answer metrics; items: item_id, question, answer, contexts (array)."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def ratio(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a|, 0 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def with_tokens(items: DataFrame) -> DataFrame:
    """items with token sets q, a, c of question, answer and all contexts."""
    return items.withColumns({"q": T.token_set(F.col("question")), "a": T.token_set(F.col("answer")), "c": T.token_set(F.concat_ws(" ", "contexts"))})


def faithfulness() -> Column:
    return ratio(F.col("a"), F.col("c"))


def answer_relevancy() -> Column:
    return ratio(F.col("a"), F.col("q"))


def context_precision() -> Column:
    return ratio(F.col("c"), F.col("a"))


def keyword_gate(mandatory: Column, optional: Column, text: Column, pass_at: float = 0.6) -> Column:
    """struct(score, passed): 0.8 of the mandatory share and 0.2 of the optional one, which is full if there are none."""
    low = F.lower(text)
    share = lambda k, empty: F.when(F.size(k) == 0, F.lit(empty)).otherwise(F.size(F.filter(k, lambda x: low.contains(F.lower(x)))) / F.greatest(F.size(k), F.lit(1)))
    score = share(mandatory, 0.0) * 0.8 + share(optional, 1.0) * 0.2
    return F.struct(score.alias("score"), (score >= pass_at).alias("passed"))


#: Pairs of forms and words that are bounded at a time, and characters of those whose bound is their longest common subsequence.
PAIRS, LETTERS = 1 << 18, 64


@lru_cache(1 << 17)
def ratio_of(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def in_common(forms: list[str], words: list[str], f: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of each pair forms[f], words[w], none of which has more than LETTERS characters.

    A bit for each character of a form, all pairs side by side.
    """
    points = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    nf, nw = (np.array([len(x) for x in texts], np.int64) for texts in (forms, words))
    letters, code = np.unique(points(forms), return_inverse=True)
    masks = np.zeros((len(forms), len(letters) + 1), np.uint64)  # the last for letters that no form has
    row = np.repeat(np.arange(len(forms)), nf)
    np.bitwise_or.at(masks, (row, code), np.uint64(1) << (np.arange(len(row)) - (np.cumsum(nf) - nf)[row]).astype(np.uint64))
    spelled = points(words)
    at = np.minimum(np.searchsorted(letters, spelled), len(letters) - 1)
    spelled = np.where(letters[at] == spelled, at, len(letters))
    start = (np.cumsum(nw) - nw)[w]
    order = np.argsort(-nw[w], kind="stable")  # pairs whose words go on come first
    f, start, n = f[order], start[order], nw[w][order]
    v = np.full(len(order), ~np.uint64(0))
    for k in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -k))
        u = v[:m] & masks[f[:m], spelled[start[:m] + k]]
        v[:m] = (v[:m] + u) | (v[:m] - u)
    out = np.empty(len(order), np.int64)
    width = nf[f].astype(np.uint64)
    out[order] = np.bitwise_count(~v & (~np.uint64(0) >> (np.uint64(LETTERS) - width)))
    return out


def best_likeness(forms: pa.ListArray, words: pa.ListArray, texts: pa.Array, least: np.ndarray) -> np.ndarray:
    """For each row the best ratio of difflib of a form to a word, or ``least`` if that is more.

    Forms without a letter, and those of rows without words, are held against
    the text; ideographic ones against nothing.  What matches is a common
    subsequence, so the longest one bounds the ratio, and a row's pairs are
    looked at from the highest bound down to its best ratio.
    """
    out = least.copy()
    of, ow = (x.offsets.to_numpy() - x.offsets[0].as_py() for x in (forms, words))
    ef, ew = (x.flatten().dictionary_encode() for x in (forms, words))
    fs, ws = ef.dictionary.to_pylist(), ew.dictionary.to_pylist()
    ef, ew = (x.indices.to_numpy(zero_copy_only=False) for x in (ef, ew))
    row = np.repeat(np.arange(len(forms)), np.diff(of))
    many = np.diff(ow)[row]
    told = np.array([not re.search("[一-鿿]", x) for x in fs], bool)[ef]
    worded = np.array([bool(re.search(r"\w", x)) for x in fs], bool)[ef] & (many > 0)
    for e in np.flatnonzero(told & ~worded).tolist():
        out[row[e]] = max(out[row[e]], difflib.SequenceMatcher(None, fs[ef[e]], texts[int(row[e])].as_py()).ratio())
    entries = np.flatnonzero(told & worded)
    lf, lw = (np.array([len(x) for x in texts_], np.int64) for texts_ in (fs, ws))
    ends, at = np.cumsum(many[entries]), 0
    while at < len(entries):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        here = entries[at:to]
        n = many[here]
        e = np.repeat(here, n)
        w = ew[ow[row[e]] + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)]
        f, r = ef[e], row[e]
        common = np.minimum(lf[f], lw[w])
        some = np.flatnonzero(2.0 * common / (lf[f] + lw[w]) > out[r])
        f, w, r, common = f[some], w[some], r[some], common[some]
        short = np.flatnonzero((lf[f] <= LETTERS) & (lw[w] <= LETTERS))
        if len(short):
            uf, cf = np.unique(f[short], return_inverse=True)
            uw, cw = np.unique(w[short], return_inverse=True)
            common[short] = in_common([fs[k] for k in uf.tolist()], [ws[k] for k in uw.tolist()], cf, cw)
        bound = 2.0 * common / (lf[f] + lw[w])
        some = np.flatnonzero(bound > out[r])
        some = some[np.lexsort((-bound[some], r[some]))]
        decided = -1
        for x, b, i, j in zip(r[some].tolist(), bound[some].tolist(), f[some].tolist(), w[some].tolist(), strict=True):
            if x == decided:
                continue
            if b <= out[x]:
                decided = x  # the others of this row have lower bounds
                continue
            ratio_ = ratio_of(fs[i], ws[j]) if max(len(fs[i]), len(ws[j])) <= LETTERS else difflib.SequenceMatcher(None, fs[i], ws[j]).ratio()
            out[x] = max(out[x], ratio_)
        at = to
    return out


def keyword_match(items: DataFrame, synonyms: DataFrame, fuzzy: bool = False, weight: float = 0.75) -> DataFrame:
    """item_id, score, matched, total, missing; items: item_id, keywords, text; synonyms: keyword, synonym.

    A keyword scores 1 if it, a synonym or the keyword without its blanks
    occurs; else ``weight`` times the best share of these: of an ideographic
    one the share of characters that occur, of others the share of words that
    are words of the text and, with ``fuzzy``, the best ratio of difflib to one
    of them.  It is matched from 0.5 up; no keywords score 1.
    """
    texts = items.select("item_id", "keywords", F.lower("text").alias("t")).withColumn("w", T.token_set(F.col("t")))  # once a text, not once a keyword
    k = texts.select("item_id", "t", "w", F.explode_outer(F.transform("keywords", lambda x: F.lower(F.trim(x)))).alias("keyword"))
    s = synonyms.groupBy(F.lower("keyword").alias("keyword")).agg(F.collect_set(F.lower("synonym")).alias("syn"))
    k = k.join(s, "keyword", "left")
    forms = F.array_distinct(F.filter(F.concat(F.array("keyword", F.replace("keyword", F.lit(" "), F.lit(""))), F.coalesce("syn", F.array().cast("array<string>"))), lambda f: f != ""))
    k = k.withColumn("forms", forms)
    present = F.exists("forms", lambda f: F.col("t").contains(f))

    def share(form: Column) -> Column:
        signs = F.filter(F.split(form, ""), lambda c: F.trim(c) != "")
        toks = F.filter(F.split(form, r"[^\p{L}\p{N}_]+"), lambda c: c != "")
        of = lambda found, all_: F.size(found) / F.greatest(F.size(all_), F.lit(1))
        words = F.filter(toks, lambda x: F.array_contains("w", x))
        return F.when(form.rlike("[一-鿿]"), of(F.filter(signs, lambda c: F.col("t").contains(c)), signs)).otherwise(of(words, toks))

    best = F.coalesce(F.array_max(F.transform("forms", share)), F.lit(0.0))
    if fuzzy:

        @F.arrow_udf("double")
        def likeness(open_: pa.Array, best: pa.Array, forms: pa.Array, words: pa.Array, texts: pa.Array) -> pa.Array:
            out = best.to_numpy(zero_copy_only=False).copy()
            rows = np.flatnonzero(open_.to_numpy(zero_copy_only=False))
            some = pa.array(rows)
            out[rows] = best_likeness(forms.take(some), words.take(some), texts.take(some), out[rows])
            return pa.array(out)

        best = likeness(F.coalesce(~present, F.lit(False)), best, "forms", "w", F.coalesce("t", F.lit("")))
    one = F.when(F.col("keyword").isNull(), None).when(F.coalesce(present, F.lit(False)), 1.0).otherwise(best * weight)
    k = k.withColumn("one", one)
    missing = F.array_sort(F.collect_list(F.when(F.col("one") < 0.5, F.col("keyword"))))
    return k.groupBy("item_id").agg(F.coalesce(F.avg("one"), F.lit(1.0)).alias("score"), F.count_if(F.col("one") >= 0.5).alias("matched"), F.count("keyword").alias("total"), missing.alias("missing"))


def keyword_summary(scores: DataFrame, pass_at: float = 0.6) -> DataFrame:
    return scores.agg(F.count("*").alias("items"), F.avg("score").alias("mean_score"), F.count_if(F.col("score") >= pass_at).alias("passed"), F.count_if(F.col("score") < pass_at).alias("failed"), F.avg((F.col("score") >= pass_at).cast("int")).alias("pass_rate"))


def fuzzy_keywords(items: DataFrame, t: float = 0.8, kind: str = "word") -> DataFrame:
    """item_id, match_rate: share of keywords that some word of the text resembles by edit distance."""
    k = items.select("item_id", F.explode("keywords").alias("keyword"), T.token_set(F.col("text"), kind).alias("w"))
    best = F.array_max(F.transform("w", lambda x: 1 - F.levenshtein(x, F.lower("keyword")) / F.greatest(F.length(x), F.length("keyword"))))
    return k.withColumn("best", F.coalesce(best, F.lit(0.0))).groupBy("item_id").agg((F.count_if(F.col("best") >= t) / F.count("*")).alias("match_rate"))


def adaptive_threshold(language: Column, domain: Column, base: float = 0.6) -> Column:
    """The base, lower by 0.05 each for Chinese and for technical texts, 0.1 at least."""
    less = F.when(language == "chinese", 0.05).otherwise(0.0) + F.when(domain == "technical", 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.lit(base) - less)


def combine_methods(scores: DataFrame, weights: dict[str, float], thresholds: DataFrame | None = None) -> DataFrame:
    """item_id, score, best, and with thresholds (item_id, threshold) whether the score passes.

    Weights are renormalised over the methods that an item has a score of; of
    equal scores the best is that of the method named first.
    """
    w = F.coalesce(*[F.when(F.col("method") == m, F.lit(x)) for m, x in weights.items()], F.lit(0.0))
    place = F.coalesce(*[F.when(F.col("method") == m, F.lit(-k)) for k, m in enumerate(weights)], F.lit(-len(weights)))
    rows = scores.where(F.col("score").isNotNull())
    out = rows.groupBy("item_id").agg(F.coalesce(F.sum(F.col("score") * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0)).alias("score"), F.max_by("method", F.struct(F.col("score"), place)).alias("best"))
    return out if thresholds is None else out.join(thresholds, "item_id", "left").withColumn("passes", F.col("score") >= F.col("threshold"))


def domain_rule_score(text: Column, terms: list[str], patterns: list[str]) -> Column:
    rules = [F.lower(text).contains(t.lower()) for t in terms] + [text.rlike(p) for p in patterns]
    return sum((r.cast("int") for r in rules), F.lit(0)) / len(rules) if rules else F.lit(1.0)


def weighted_domain_score(metrics: DataFrame, weights: dict[str, float]) -> DataFrame:
    """run_id, score from metric means; a plain mean without weights."""
    means = metrics.groupBy("run_id", "metric").agg(F.avg("value").alias("m"))
    w = F.coalesce(*[F.when(F.col("metric") == k, F.lit(x)) for k, x in weights.items()], F.lit(0.0)) if weights else F.lit(1.0)
    return means.where("m is not null").groupBy("run_id").agg((F.sum(F.col("m") * w) / F.sum(w)).alias("score"))


def tool_metrics(df: DataFrame) -> DataFrame:
    """item_id, accuracy, efficiency; df: item_id, expected, used, ok (arrays, ok parallel to used)."""
    total = F.greatest(F.size("used"), F.lit(1))
    eff = F.when(F.size("used") == 0, F.lit(0.0)).otherwise(F.size(F.filter("ok", lambda x: x)) / total * (F.size(F.array_distinct("used")) / total))
    return df.select("item_id", ratio(F.array_distinct("expected"), F.col("used")).alias("accuracy"), eff.alias("efficiency"))


def multimodal_metrics(items: DataFrame) -> DataFrame:
    """item_id, faithfulness, relevance, coverage, n_modalities; contexts: array of struct(type, text)."""
    c = T.token_set(F.concat_ws(" ", F.transform("contexts", lambda x: x.text)), "dashed")
    a, q = T.token_set(F.col("answer"), "dashed"), T.token_set(F.col("question"), "dashed")
    used = F.filter("contexts", lambda x: F.size(F.array_intersect(T.token_set(x.text, "dashed"), T.token_set(F.col("answer"), "dashed"))) > 0)
    kinds = F.array_distinct(F.transform("contexts", lambda x: x.type))
    cover = F.when(F.size("contexts") == 0, F.lit(0.0)).otherwise(F.size(used) / F.greatest(F.size("contexts"), F.lit(1)))
    return items.select("item_id", ratio(a, c).alias("faithfulness"), ratio(a, q).alias("relevance"), cover.alias("coverage"), F.size(kinds).alias("n_modalities"))


#: Markers of the rule families (fixed values).
RULES = {"symbolic": ("if", "then", "all", "not"), "spatial": ("left", "right", "above", "below", "near"), "temporal": ("before", "after", "during", "then"), "intent": ("want", "need", "how", "help")}


def rule_score(question: Column, answer: Column, kind: str) -> Column:
    """Share of the family's markers in the question that the answer has too; 1 if the question has none."""
    marks = F.array(*map(F.lit, RULES[kind]))
    asked = F.array_intersect(marks, T.token_set(question, "plain"))
    return F.when(F.size(asked) == 0, F.lit(1.0)).otherwise(ratio(asked, T.token_set(answer, "plain")))


def panel_verdicts(scores: DataFrame, experts: list[tuple[str, str, float]]) -> DataFrame:
    """item_id, approvals, agreement, dissent; experts: name, metric column, least value."""
    votes = F.array(*[F.struct(F.lit(n).alias("expert"), (F.col(m) >= t).alias("ok")) for n, m, t in experts])
    yes = F.size(F.filter(votes, lambda v: v.ok))
    agree = F.greatest(yes, len(experts) - yes) / len(experts)
    return scores.select("item_id", yes.alias("approvals"), agree.alias("agreement"), F.array_join(F.transform(F.filter(votes, lambda v: ~v.ok), lambda v: v.expert), ",").alias("dissent"))


def composite_pass(df: DataFrame, weights: dict[str, float], gates: dict[str, float], criteria: str = "all") -> DataFrame:
    """df with score, passed: all, the majority or any of the gates."""
    if criteria not in ("all", "majority", "any"):
        raise ValueError(f"unknown criteria {criteria!r}")
    n = sum((F.coalesce(F.col(c) >= t, F.lit(False)).cast("int") for c, t in gates.items()), F.lit(0))
    need = {"all": len(gates), "majority": len(gates) // 2 + 1, "any": 1}[criteria]
    return df.withColumn("score", sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))).withColumn("passed", n >= need)


def capture_contexts(items: DataFrame) -> DataFrame:
    """items with a fallback context where there is none, and context_count of the real ones."""
    empty = F.size("contexts") == 0
    return items.withColumn("context_count", F.when(empty, 0).otherwise(F.size("contexts"))).withColumn("contexts", F.when(empty, F.array(F.lit(""))).otherwise(F.col("contexts")))


@dataclass(frozen=True)
class MetricSpec:
    """A named, versioned metric: an expression over the columns of the items, or several by key."""

    name: str
    version: str
    values: Callable[[], dict[str, Column]]


def apply_metrics(items: DataFrame, specs: list[MetricSpec], key: str = "item_id") -> tuple[DataFrame, dict[str, str]]:
    """Long rows (key, metric, version, value) and the metrics that failed; one that fails does not stop the others."""
    rows, failed = [], {}
    for s in specs:
        try:
            for k, c in s.values().items():
                items.select(c)  # resolves the expression without running it
                rows.append(F.struct(F.lit(f"{s.name}.{k}" if k else s.name).alias("metric"), F.lit(s.version).alias("version"), c.cast("double").alias("value")))
        except Exception as e:  # a plugin may fail in any way
            failed[s.name] = type(e).__name__
    return items.select(key, F.explode(F.array(*rows)).alias("m")).select(key, "m.*"), failed


def ngram_overlap(items: DataFrame, n: int) -> DataFrame:
    """item_id, precision, recall of clipped n-gram counts of answer against reference, and the brevity penalty."""
    grams = lambda c, side: items.select("item_id", F.explode(T.ngrams(F.col(c), n)).alias("g")).groupBy("item_id", "g").agg(F.count("*").alias(side))
    both = grams("at", "x").join(grams("rt", "y"), ["item_id", "g"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    s = both.groupBy("item_id").agg(F.sum(F.least(zero("x"), zero("y"))).alias("hit"), F.sum(zero("x")).alias("nx"), F.sum(zero("y")).alias("ny"))
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return s.select("item_id", div("hit", "nx").alias("precision"), div("hit", "ny").alias("recall"), F.when(F.col("nx") >= F.col("ny"), 1.0).when(F.col("nx") == 0, 0.0).otherwise(F.exp(1 - F.col("ny") / F.col("nx"))).alias("brevity"))


#: What parts the words of an answer for highlighting (fixed value).
HIGHLIGHT_BREAKS = r"[\s,.;:!?、。，！？·\-–—/\\()\[\]{}\"「」『』【】《》〈〉]+"


def highlight_matches(items: DataFrame, least: int = 4, most: int = 12) -> DataFrame:
    """item_id, pos, tier, matches: how often an item's terms occur in each of its contexts, whatever the case.

    items: item_id, answer, entities, contexts.  Terms are the entities if
    there are any (tier entity), else the longest words of the answer (overlap).
    """
    words = F.filter(F.split(F.coalesce("answer", F.lit("")), HIGHLIGHT_BREAKS), lambda w: F.length(w) >= least)
    ranked = F.array_sort(F.transform(F.array_distinct(words), lambda w, i: F.named_struct(F.lit("n"), -F.length(w), F.lit("i"), i, F.lit("w"), w)))
    own = F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: e != "")
    terms = F.when(F.size(own) > 0, own).otherwise(F.transform(F.slice(ranked, 1, most), lambda x: x.w))
    tier = F.when(F.size(own) > 0, "entity").when(F.size("terms") > 0, "overlap").otherwise("none")
    rows = items.select("item_id", F.posexplode("contexts").alias("pos", "context"), terms.alias("terms"), F.col("entities"))
    low = F.lower(F.coalesce("context", F.lit("")))
    hits = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + ((F.length(low) - F.length(F.replace(low, F.lower(t), F.lit("")))) / F.length(t)).cast("long"))
    return rows.select("item_id", "pos", tier.alias("tier"), hits.alias("matches"))
