"""Quality rules with adaptive thresholds.

Word, symbol and repetition counts are taken from each whole text.  A few
integer ratios of these are summarised for each language and source in
mergeable quantile sketches: bucket counts in which a bucket keeps the five
leading bits of a value, so the relative error is at most 1/16 and adding up
counts merges sketches.  Fences derived from the deciles and the median of a
group replace fixed cutoffs: a fence lies as many times the distance between
median and outer decile beyond that decile as ``REACH`` says, and the error of
its bucket.  The documents are then joined with the fences of their group.

A document breaks the fence of a count only where more lies beyond it than
chance gives a text of its length: three times the square root of its count of
symbols, lines, or repeated windows.  So where nine in ten documents have none
at all, a fence is 0 and a few still do no harm.

Edge cases: a null text has no words and fails the base rules; a very long
text is counted whole; a document on a fence is kept; null language or source
is a group of its own; repeated ids and rows give a row each; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import settle

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Fence:
    """Bounds of one ratio (per mille), and the count behind it, where it is one, that comes in units of so many words."""

    metric: str
    count: str | None = None
    unit: int = 1
    low: bool = False


FENCES = (Fence("word_len", low=True), Fence("symbols", "n_symbols"), Fence("dup_lines", "n_dup_lines"), Fence("repeats", "n_repeat_words", unit=8))
#: Distances between median and decile from the decile to the fence, and the share of a value that its bucket may hide.
REACH, BUCKET_ERROR = 3, 16
#: Standard errors by which a count must pass its fence.
ERRORS = 3
#: Documents that the sketches of all groups together count for in each group.
POOL_WEIGHT = 50
MIN_WORDS = 20
MAX_REPEAT_PCT = 30


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of ``width`` words that occur at least twice; windows are compared exactly."""
    n = len(words)
    if n <= width:
        return 0
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(code) == n:
        return 0
    ids = np.fromiter(map(code.__getitem__, words), np.int64, n)
    kinds, span = len(code), 1
    while span < width:  # ids of windows twice as wide, until the width is reached
        step = min(span, width - span)
        pairs = ids[:-step] * kinds + ids[step:]
        uniq, ids = np.unique(pairs, return_inverse=True)
        kinds, span = len(uniq), span + step
        if kinds == len(ids):
            return 0
    starts = np.flatnonzero(np.bincount(ids, minlength=kinds)[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def count_text(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of one text, in the order of COUNTS."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    blanks = sum(raw.count(c) for c in BLANKS)
    symbols = sum(raw.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words)


def text_counts(text: Column) -> Column:
    """struct of the five counts."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_text(t) for t in texts], columns=COUNTS)

    return counts(text)


def bucket(v: Column) -> Column:
    """The value with all but its five leading bits cleared."""
    unit = F.pow(F.lit(2), F.greatest(F.length(F.bin(v)) - 5, F.lit(0))).cast("long")
    return v - v % unit


def ratios(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    per_mille = lambda c: F.floor(F.col(c) * 1000 / words).cast("long")
    return df.withColumns({"word_len": per_mille("word_chars"), "symbols": per_mille("n_symbols"), "dup_lines": per_mille("n_dup_lines"), "repeats": per_mille("n_repeat_words")})


def sketches(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Bucket counts of each metric in each group; partial counts are merged before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in metrics]))
    return df.select(*keys, pairs.alias("p")).groupBy(*keys, "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], shares: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """keys, metric, docs, and q10, q50, ...: the smallest bucket up to which that share of the rows lies."""
    by = Window.partitionBy(*keys, "metric")
    cum = F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    s = sketch.withColumns({"cum": cum, "docs": F.sum("n").over(by)})
    at = lambda pct: F.min(F.when(F.col("cum") * 100 >= F.col("docs") * pct, F.col("bucket"))).alias(f"q{pct}")
    return s.groupBy(*keys, "metric").agg(F.max("docs").alias("docs"), *map(at, shares))


def fence_table(stats: DataFrame, fences=FENCES, reach: int = REACH, weight: int = POOL_WEIGHT) -> DataFrame:
    """lang, source and for each metric its low and high bound.

    A group's quantiles are drawn to those of all groups' sketches merged, as
    if these were ``weight`` documents more: the more a group has, the less.
    """
    metrics, shares = [f.metric for f in fences], (10, 50, 90)
    fine = sketches(stats, ["lang", "source"], metrics)
    own = quantiles(fine, ["lang", "source"], shares)
    pooled = quantiles(merge(fine, []), [], shares).drop("docs").withColumnsRenamed({"metric": "m"} | {f"q{p}": f"p{p}" for p in shares})
    both = own.join(pooled, F.col("metric") == F.col("m"))
    both = both.select("lang", "source", "metric", *[F.expr(f"(docs * q{p} + {weight} * p{p}) div (docs + {weight})").alias(f"d{p}") for p in shares])
    bounds = []
    for f in fences:
        mine = F.col("metric") == f.metric
        bounds.append(F.max(F.when(mine, F.expr(f"d90 + {reach} * (d90 - d50) + d90 div {BUCKET_ERROR}"))).alias(f"{f.metric}_hi"))
        if f.low:
            bounds.append(F.max(F.when(mine, F.expr(f"d10 - {reach} * (d50 - d10) - d10 div {BUCKET_ERROR}"))).alias(f"{f.metric}_lo"))
    return both.groupBy("lang", "source").agg(*bounds)


def breaks(f: Fence) -> Column:
    """Whether a document with its fences breaks one."""
    high = F.col(f"{f.metric}_hi")
    out = F.col(f.metric) > high
    if f.count:
        beyond = (F.col(f.count) * 1000 - high * F.col("n_words")).cast("double")
        out = out & (beyond * beyond > F.col(f.count).cast("double") * (ERRORS * ERRORS * f.unit * 1_000_000.0))
    return out | (F.col(f.metric) < F.col(f"{f.metric}_lo")) if f.low else out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)


def quality_rules(docs: DataFrame, fences=FENCES) -> DataFrame:
    """doc_id, the counts, the ratios, base_failed, failed_rules (names) and kept."""
    got = docs.select("doc_id", "lang", "source", text_counts(F.coalesce("text", F.lit(""))).alias("c"))
    stats = settle(ratios(got.select("doc_id", "lang", "source", "c.*")), "quality-stats")
    bounds = fence_table(stats, fences).withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    joined = stats.join(bounds, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    broken = [F.when(breaks(f), F.lit(f.metric)) for f in fences]
    rules = F.array_compact(F.array(*broken))
    return joined.select(
        "doc_id", *COUNTS, *[f.metric for f in fences], base_failed().alias("base_failed"), rules.alias("failed_rules"), (~base_failed() & (F.size(rules) == 0)).alias("kept")
    )
