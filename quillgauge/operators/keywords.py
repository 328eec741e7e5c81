"""Entities, keyphrases and keyword fusion: top-k by group as counts and ranks.

Ties of frequency go to what occurs first in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.session import settle

#: What counts as an entity (fixed value).
ENTITY = "[一-鿿]{2,}|[A-Za-z]{3,}"
#: Stop words that keyword lists leave out (fixed values).
STOP = ("the", "and", "for", "that", "with", "this", "are", "was", "is", "in", "on", "of", "to", "a", "an", "it", "be", "as", "at", "by", "or", "from")


def top_tokens(docs: DataFrame, toks: Column, k: int, key: str = "doc_id") -> DataFrame:
    """key, token, n, first, rank for the k most frequent tokens of each row.

    A row's tokens are counted where it lies; only where rows share a key are
    they brought together.
    """
    kind = dict(docs.dtypes)[key]
    if not docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rows = docs.select(key, F.posexplode(toks).alias("pos", "token"))
        counts = rows.groupBy(key, "token").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
        return counts.withColumn("rank", rank).where(F.col("rank") <= k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).fill_null([])
            words = lists.flatten().dictionary_encode()
            v, offsets = max(1, len(words.dictionary)), lists.offsets.to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(offsets))
            pair, at, n = np.unique(row * v + words.indices.to_numpy(), return_index=True, return_counts=True)
            order = np.lexsort((at, -n, pair // v))  # ties in order of occurrence
            pair, at, n = pair[order], at[order], n[order]
            row = pair // v
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            best = rank <= k
            row, first = row[best], (at[best] - (offsets[row[best]] - offsets[0])).astype(np.int32)
            columns = [b.column(0).take(pa.array(row)), words.dictionary.take(pa.array(pair[best] % v)), pa.array(n[best]), pa.array(first), pa.array(rank[best].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [key, "token", "n", "first", "rank"])

    return docs.select(key, toks.alias("tokens")).mapInArrow(count, f"`{key}` {kind}, token string, n long, first int, rank int")


def extract_entities(docs: DataFrame, k: int = 30) -> DataFrame:
    return top_tokens(docs, F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)), k)


def extract_keyphrases(docs: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent pairs of neighbouring entities."""
    return top_tokens(docs, T.ngrams(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)), 2), k)


def extract_domain_entities(docs: DataFrame, terms: DataFrame, stop=STOP, k: int = 10, domain_k: int = 5) -> DataFrame:
    """Domain terms first, at most ``domain_k``, then other frequent words, ``k`` in all."""
    toks = F.regexp_extract_all(F.lower("text"), F.lit("[一-鿿]{2,}|[a-z]{3,}"), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(toks).alias("pos", "token")).where(~F.col("token").isin(*stop))
    counts = rows.groupBy("doc_id", "token").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    marked = counts.join(terms.select(F.col("term").alias("token"), F.lit(True).alias("d")).distinct(), "token", "left").withColumn("domain", F.coalesce("d", F.lit(False)))
    own = F.row_number().over(Window.partitionBy("doc_id", "domain").orderBy(F.desc("n"), "first"))
    some = marked.withColumn("own", own).where(~F.col("domain") | (F.col("own") <= domain_k))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("domain"), F.desc("n"), "first"))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "token", "domain", "n", "rank")


def phrase_candidates(docs: DataFrame, k: int = 10) -> DataFrame:
    """Phrases of the first five sentences: three Latin words of 6 to 59 letters in all, ideographs by two to six."""
    from .chunks import split_sentences

    def of(s: Column) -> Column:
        latin = F.filter(T.ngrams(F.regexp_extract_all(s, F.lit("[A-Za-z]+"), F.lit(0)), 3), lambda p: (F.length(p) >= 6) & (F.length(p) <= 59))
        runs = F.regexp_extract_all(s, F.lit("[一-鿿]{2,6}"), F.lit(0))
        return F.concat(latin, runs)

    found = F.flatten(F.transform(F.slice(split_sentences(F.col("text")), 1, 5), of))
    return docs.select("doc_id", F.posexplode(F.slice(F.array_distinct(found), 1, k)).alias("pos", "phrase"))


def simple_keywords(text: Column, k: int, stop=STOP) -> Column:
    """Distinct lower-case alphanumeric words of more than three letters, in order of occurrence."""
    w = F.filter(T.tokens(text), lambda t: F.length(t) > 3)
    return F.slice(F.array_except(w, F.array(*map(F.lit, stop))), 1, k)


def top_words(docs: DataFrame, k: int = 8, least: int = 1, stop=STOP) -> DataFrame:
    toks = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(*stop))
    return top_tokens(docs, toks, k).where(F.col("n") >= least)


def domain_density(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, n_words, n_terms, specificity: five times the share of domain terms, at most 1."""
    rows = docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("w")).join(terms, F.col("w") == F.col("term"), "left")
    n, hits = F.count("*"), F.count("term")
    return rows.groupBy("doc_id").agg(n.alias("n_words"), hits.alias("n_terms"), F.least(F.lit(1.0), hits / n * 5).alias("specificity"))


def combine_method_scores(kw: DataFrame, weights: dict[str, float], domain: DataFrame, boost: float = 0.1) -> DataFrame:
    """sample_id, keyword, score (weighted sum and a boost for domain terms), avg_score, methods; numbers are dropped."""
    weight = F.coalesce(*[F.when(F.col("method") == m, F.lit(w)) for m, w in weights.items()], F.lit(0.1))
    rows = kw.where(F.expr("try_cast(keyword as double)").isNull()).select("sample_id", F.lower("keyword").alias("keyword"), "method", "score", weight.alias("w"))
    sums = rows.groupBy("sample_id", "keyword").agg(F.sum(F.col("score") * F.col("w")).alias("s"), F.avg("score").alias("avg_score"), F.count_distinct("method").alias("methods"))
    marked = sums.join(domain.select(F.col("term").alias("keyword"), F.lit(boost).alias("b")).distinct(), "keyword", "left")
    return marked.select("sample_id", "keyword", (F.col("s") + F.coalesce("b", F.lit(0.0))).alias("score"), "avg_score", "methods")


def fuse_sources(kw: DataFrame, weights: dict[str, float]) -> DataFrame:
    """sample_id, keyword, score: weights normalised over the sources that a sample has."""
    weight = F.coalesce(*[F.when(F.col("source") == m, F.lit(w)) for m, w in weights.items()], F.lit(0.0))
    there = kw.select("sample_id", "source").distinct().groupBy("sample_id").agg(F.sum(weight).alias("total"))
    rows = kw.join(there, "sample_id").where("total > 0")
    return rows.groupBy("sample_id", F.lower("keyword").alias("keyword")).agg(F.sum(F.col("score") * weight / F.col("total")).alias("score"))


def select_keywords(kw: DataFrame, least: float = 0.2, k: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("score"), "keyword"))
    best = kw.where(F.col("score") >= least).groupBy("sample_id", "keyword").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def dedup_exact(kw: DataFrame) -> DataFrame:
    """The best of each case-folded keyword of a sample."""
    cleaned = F.trim(F.lower("keyword"))
    rank = F.row_number().over(Window.partitionBy("sample_id", cleaned).orderBy(F.desc("score"), "keyword", "source", "method"))
    return kw.withColumn("r", rank).where("r = 1").drop("r")


def dedup_substring(kw: DataFrame) -> DataFrame:
    """Keywords that no longer keyword of their sample contains."""
    other = kw.select(F.col("sample_id").alias("s"), F.col("keyword").alias("longer")).distinct()
    on = (F.col("sample_id") == F.col("s")) & (F.length("longer") > F.length("keyword")) & F.col("longer").contains(F.col("keyword"))
    return kw.join(other, on, "left_anti")


def root_of(keyword: Column) -> Column:
    """Articles and punctuation gone, a plain plural ending stripped."""
    t = F.regexp_replace(F.lower(keyword), r"^(the|a|an)\s+", "")
    t = F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", ""))
    return F.regexp_replace(t, "([^s]{3,})s$", "$1")


def dedup_variants(kw: DataFrame) -> DataFrame:
    """The best keyword of each root."""
    rank = F.row_number().over(Window.partitionBy("sample_id", root_of(F.col("keyword"))).orderBy(F.desc("score"), "keyword", "source", "method"))
    return kw.withColumn("r", rank).where("r = 1").drop("r")


#: Keywords of a sample that is decided in one task, rows that a task decides at a time, and pairs whose vectors are held at a time.
SAMPLE_ROWS, ROWS, PAIRS = 2000, 16_384, 1 << 16


def cosines(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows a and b of v, summed in the order of the numbers, as a fold over an array does."""
    xy, xx, yy = (np.zeros(len(a)) for _ in range(3))
    for d in range(v.shape[1]):
        x, y = v[a, d], v[b, d]
        xy, xx, yy = xy + x * y, xx + x * x, yy + y * y
    with np.errstate(divide="ignore", invalid="ignore"):
        return xy / (np.sqrt(xx) * np.sqrt(yy))


def pass_over_samples(sample: np.ndarray, v: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows, given sample by sample and best first, no kept row before them resembles."""
    ends = np.searchsorted(sample, sample, side="right")
    many = ends - np.arange(len(sample)) - 1
    upto, gone, at = np.cumsum(many), np.zeros(len(sample), bool), 0
    while at < len(sample):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        n = many[at:to]
        a = np.repeat(np.arange(at, to), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = cosines(v, a, b) >= threshold
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):  # when x comes, all rows before it are decided
            if not gone[x]:
                gone[y] = True
        at = to
    return ~gone


def dedup_semantic(kw: DataFrame, vectors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """sample_id, keyword, score of keywords that no kept better one of their sample resembles; vectors: keyword, embedding.

    Better is a higher score, then a longer keyword, then the first in order.
    Samples are brought together with their vectors once and passed over in
    their order; those of more than SAMPLE_ROWS keywords go by their pairs.
    """
    from .quality import greedy_keep
    from .simjoin import cosine

    best = [F.desc("score"), F.desc(F.length("keyword")), F.col("keyword")]
    kinds = dict(kw.dtypes)
    large = settle(kw.groupBy("sample_id").agg(F.count("*").alias("n")).where(F.col("n") > SAMPLE_ROWS).select("sample_id"), "large")
    some = not large.isEmpty()
    rows = kw.select("sample_id", "keyword", "score").join(vectors.select("keyword", "embedding"), "keyword")
    small = rows.join(large, "sample_id", "left_anti") if some else rows

    def decide(t: pa.Table) -> pa.Table:
        ids = t["sample_id"].combine_chunks()
        codes = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0)
        run = np.cumsum(np.append(True, codes[1:] != codes[:-1]) | np.asarray(ids.is_null()))  # a null sample is like no other
        lists = t["embedding"].combine_chunks()
        width = np.asarray(pa.compute.list_value_length(lists).fill_null(0))
        v = np.full((len(t), max(1, int(width.max(initial=0)))), np.nan)
        whole = np.flatnonzero(width == v.shape[1])
        v[whole] = lists.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)
        return t.select(["sample_id", "keyword", "score"]).filter(pa.array(pass_over_samples(run, v, threshold))).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n < ROWS:
                continue
            t = pa.Table.from_batches(held)
            last = t["sample_id"][-1]
            open_ = pa.compute.equal(t["sample_id"], last).fill_null(False) if last.is_valid else t["sample_id"].is_null()
            cut = len(t) - int(pa.compute.sum(open_).as_py())  # the last sample may go on
            if cut:
                yield from decide(t.slice(0, cut)).to_batches()
                held, n = t.slice(cut).combine_chunks().to_batches(), len(t) - cut
        if held:
            yield from decide(pa.Table.from_batches(held)).to_batches()

    ordered = small.repartition("sample_id").sortWithinPartitions("sample_id", *best)
    out = ordered.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("sample_id", "keyword", "score")))
    if not some:
        return out
    rows = rows.join(large, "sample_id", "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("sample_id").orderBy(*best)))
    rows = settle(rows.withColumn("id", F.struct("sample_id", "pos")), "rows")
    a, b = rows.alias("a"), rows.alias("b")
    near = a.join(b, (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.pos") < F.col("b.pos"))).where(cosine(F.col("a.embedding"), F.col("b.embedding")) >= threshold)
    edges = near.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    return out.unionByName(greedy_keep(rows.select("id", "sample_id", "keyword", "score"), edges).drop("id"))


def keyword_presence(kws: Column, context: Column) -> Column:
    """Share of the keywords that the context holds, three digits; 0 without keywords."""
    hits = F.size(F.filter(kws, lambda k: F.lower(context).contains(F.lower(k))))
    return F.when(F.size(kws) == 0, F.lit(0.0)).otherwise(F.round(hits / F.greatest(F.size(kws), F.lit(1)), 3))


def keyword_stats(kw: DataFrame) -> DataFrame:
    """By method: samples, keywords, distinct keywords, keywords a sample; the row without a method is the total."""
    agg = kw.rollup("method").agg(F.count_distinct("sample_id").alias("samples"), F.count("*").alias("keywords"), F.count_distinct("keyword").alias("unique_keywords"))
    return agg.withColumn("per_sample", F.col("keywords") / F.col("samples"))
