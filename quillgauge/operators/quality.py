"""Near-duplicate removal and table quality."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.session import discard, hot_join, settle
from .graph import component_roots
from .simjoin import PREFIX_ROWS, cosine_join, counted_pairs, distinct_pairs, pair_tokens, set_join, token_sets


def dedup_ingest(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New documents of which neither (km_id, version) nor the checksum is taken, as a pass in the order of arrival finds them.

    A document that is turned away claims neither of its keys; a null key is
    like no other.  Arrivals must differ.  Documents that share a key with no other are kept at once; of the
    rest each round decides those that are first in both their keys among the
    undecided: they stay, and what shares a key with them goes.
    """
    fresh = new.join(existing.select("km_id", "version").distinct(), ["km_id", "version"], "left_anti").join(existing.select("checksum").distinct(), "checksum", "left_anti")
    own = lambda c: F.concat(F.lit("?"), F.col("arrival").cast("string")) if c is None else F.coalesce(c, own(None))
    document = F.concat(F.col("km_id").cast("string"), F.lit("\x1f"), F.col("version").cast("string"))
    undecided = settle(fresh.select("arrival", own(document).alias("a"), own(F.col("checksum").cast("string")).alias("b")), "undecided")
    kept = None
    while n := undecided.count():
        first = undecided
        for c in ("a", "b"):
            least = undecided.groupBy(c).agg(F.min("arrival").alias(f"least_{c}"), F.count("*").alias("n"))
            first = hot_join(first, least, c, n)
        first = settle(first.where("arrival = least_a and arrival = least_b").select("arrival", "a", "b"), "first")
        kept = first.select("arrival") if kept is None else kept.union(first.select("arrival"))
        left = settle(undecided.join(first.select("a"), "a", "left_anti").join(first.select("b"), "b", "left_anti").select("arrival", "a", "b"), "undecided")
        discard(undecided)
        undecided = left
    return fresh.where("false") if kept is None else fresh.join(kept, "arrival", "left_semi").select(*new.columns)


def shingle_sets(df: DataFrame, text: Column, k: int = 4, key: str = "id") -> DataFrame:
    """key, s: distinct runs of k lower-case words; a shorter text is one shingle."""
    w = df.select(key, T.tokens(text).alias("w"))
    w = w.select(key, "w", T.ngrams(F.col("w"), k).alias("g"))
    return w.select(key, F.when(F.size("w") < k, F.array(F.array_join("w", " "))).otherwise(F.array_distinct("g")).alias("s"))


#: Edges of a component that is decided in one task; rounds between two looks at the components of what is left.
COMPONENT_EDGES, ROUNDS = 200_000, 8


def pass_over(f: pd.DataFrame) -> pd.DataFrame:
    """What a pass in the order of ids drops, given all edges of some components: each edge's later end, if the earlier one stays."""
    plain = lambda v: tuple(v.values()) if isinstance(v, dict) else v
    gone: dict = {}
    for x, y, later in sorted(zip(map(plain, f["x"]), map(plain, f["y"]), range(len(f)), strict=True)):  # when x comes, all edges into it have been met
        if x not in gone:
            gone.setdefault(y, later)
    return pd.DataFrame({"x": pd.Series([f["y"].iloc[k] for k in gone.values()], dtype=object)})


def greedy_keep(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows that a pass in the order of ``id`` keeps, dropping each that is linked to a kept earlier one.

    Edges are (x earlier, y later).  Components of up to COMPONENT_EDGES edges,
    however long their chains are, are passed over in one task each.  Larger ones
    are taken down in rounds, in which every undecided row without undecided
    earlier neighbours stays and its later neighbours go, until they have
    fallen apart: what is left is looked at anew every ROUNDS rounds.
    """
    edges = settle(edges.select("x", "y"), "edges")
    kind = dict(edges.dtypes)["x"]
    removed = None
    while not edges.isEmpty():
        roots = settle(component_roots(edges), "roots")
        sized = roots.join(edges.groupBy("x").agg(F.count("*").alias("e")), F.col("id") == F.col("x")).groupBy("root").agg(F.sum("e").alias("e"), F.count("*").alias("n"))
        total = edges.count()
        of_edge = hot_join(edges, roots.join(edges.groupBy("x").agg(F.count("*").alias("n")), F.col("id") == F.col("x")).select("x", "root", "n"), "x", total)
        marked = settle(hot_join(of_edge, sized.select("root", "e", F.col("e").alias("n")), "root", total), "marked")
        bucket = F.pmod(F.xxhash64("root"), F.lit(-(-total // COMPONENT_EDGES)))  # whole components, about COMPONENT_EDGES edges together
        small = marked.where(F.col("e") <= COMPONENT_EDGES).groupBy(bucket.alias("bucket"))
        gone = settle(small.applyInPandas(pass_over, f"x {kind}"), "gone")
        removed = gone if removed is None else removed.union(gone)
        left = settle(marked.where(F.col("e") > COMPONENT_EDGES).select("x", "y"), "edges")
        discard(edges, roots, marked)
        edges = left
        for _ in range(ROUNDS):
            if edges.isEmpty():
                break
            heads = edges.select("x").distinct().join(edges.select(F.col("y").alias("x")).distinct(), "x", "left_anti")
            gone = settle(edges.join(heads, "x").select(F.col("y").alias("x")).distinct(), "gone")
            removed = removed.union(gone)
            # what a head removed and edges into it are decided; a head without edges left has no neighbours to be asked
            rest = edges.join(heads, "x", "left_anti").join(gone, "x", "left_anti").join(gone.select(F.col("x").alias("y")), "y", "left_anti")
            left = settle(rest.select("x", "y"), "edges")
            discard(edges)
            edges = left
    return rows if removed is None else rows.join(removed.withColumnRenamed("x", "id"), "id", "left_anti")


def near_dedup(samples: DataFrame, t: float = 0.82, k: int = 4) -> DataFrame:
    """Samples (id, text) that are not similar to a kept earlier one.

    What drops the first of several equal sets, or that one itself, drops the
    others, so only the first takes part in the pass.
    """
    sets = shingle_sets(samples, F.col("text"), k)
    if t < 0.5:
        return greedy_keep(samples, set_join(sets, "s", t).select(F.col("i").alias("x"), F.col("j").alias("y")))
    pairs, copies = distinct_pairs(settle(token_sets(sets, "s"), "sets"), t)
    firsts = samples.join(copies.where("id <> rep").select("id"), "id", "left_anti")
    return greedy_keep(firsts, pairs.select(F.col("i").alias("x"), F.col("j").alias("y")))


def length_filter(samples: DataFrame, least: int = 12, most: int = 360, answer: int = 8) -> DataFrame:
    n = F.length(F.trim("question"))
    return samples.where((n >= least) & (n <= most) & (F.length(F.trim("answer")) >= answer))


def normalized(question: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}_]+", " "))


def ratio_candidates(texts: DataFrame, t: float) -> DataFrame:
    """i, j of all pairs i < j of different texts (id, norm) that can reach the ratio t of difflib.

    A ratio 2m / s of s characters in all means a common subsequence of m >= t s / 2
    characters.  Each character outside it costs a text three trigrams, or two
    where it stands in the other one, so the texts share 5 m - 2 s - 2 trigrams
    or more, counted with repeats; texts of n characters at most differ so that
    s >= 2 n / (2 - t).  Trigrams are numbered by occurrence and the rare prefix
    of each text that this bound leaves is joined, or, where prefixes meet too
    often, whole texts are counted in blocks, which shuffle no pair.  Trigrams
    go by 64-bit hashes.  Where s is so small that the bound asks for no trigram,
    pairs are joined by their lengths.
    """
    need = lambda s: F.ceil((2.5 * t - 2) * s - 2 - 1e-9)
    n = F.length("norm")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda k: F.substring(F.col("norm"), k, F.lit(3)))
    rows = texts.select("id", n.alias("n"), F.posexplode(grams).alias("pos", "gram"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("id", "gram").orderBy("pos"))).select("id", "n", F.xxhash64("gram", "k").alias("gram"))
    df = rows.groupBy("gram").agg(F.count("*").alias("df")).hint("merge")  # Spark takes the trigrams to be as small as the texts, and would broadcast them
    sets = settle(rows.join(df, "gram").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g")).select("id", "n", F.transform("g", lambda x: x.gram).alias("g")), "grams")
    least = F.greatest(need(2 * F.col("n") / (2 - t)), F.lit(1))
    index = sets.select("id", "n", F.explode(F.slice("g", 1, F.greatest(F.size("g") - least + 1, F.lit(0)).cast("int"))).alias("g"))
    fits = 2 * F.least("ni", "nj") >= t * (F.col("ni") + F.col("nj")) - 1e-9
    met = index.groupBy("g").agg((F.count("*") * (F.count("*") - 1.0)).alias("p")).agg(F.sum("p")).first()[0] or 0
    if met > sets.count() * PREFIX_ROWS:

        def least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            a, b = a.astype(np.float64) + 2, b.astype(np.float64) + 2  # characters; a text of one or two counts as one of three, which asks for less or no more than the one shared trigram
            return np.where(2 * np.minimum(a, b) >= t * (a + b) - 1e-3, (2.5 * t - 2) * (a + b) - 2, np.inf)

        lists = sets.select("id", F.col("g").alias("tokens"), F.size("g").alias("n"))
        out = counted_pairs(lists, least_shared).select("i", "j")
    else:
        cand = pair_tokens(index.withColumnRenamed("g", "token")).where(fits).select("i", "j", "ni", "nj").distinct()
        both = cand.join(sets.select(F.col("id").alias("i"), F.col("g").alias("gi")).hint("merge"), "i").join(sets.select(F.col("id").alias("j"), F.col("g").alias("gj")).hint("merge"), "j")
        out = both.where(F.size(F.array_intersect("gi", "gj")) >= need(F.col("ni") + F.col("nj"))).select("i", "j")
    most = 3 / (2.5 * t - 2) if t > 0.8 else float("inf")
    if most * (1 - t) <= 1:
        return out  # different texts of so few characters miss the ratio
    lengths = texts.select("id", n.alias("n")).hint("merge")
    x = lengths.select(F.col("id").alias("i"), F.col("n").alias("ni"), F.explode(F.sequence(F.floor(F.col("n") * t / (2 - t)), F.ceil(F.col("n") * (2 - t) / t))).alias("nj"))
    short = x.join(lengths.select(F.col("id").alias("j"), F.col("n").cast("long").alias("nj")), "nj").where("i < j").where(fits)
    return out.union(short.where(F.col("ni") + F.col("nj") < most).select("i", "j")).distinct()


def fuzzy_dedup(samples: DataFrame, t: float = 0.92) -> DataFrame:
    """Samples (id, question) without an earlier kept one of the same normalised text or a ratio of at least t.

    The ratio is that of difflib, of the later text to the earlier one, batch
    by batch on all pairs that can reach it.
    """
    rows = samples.withColumn("norm", normalized(F.col("question")))
    first = rows.groupBy("norm").agg(F.min("id").alias("id"))
    base = rows.join(first.select("id").hint("merge"), "id", "left_semi")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    text = settle(base.select("id", "norm"), "texts")
    cand = ratio_candidates(text, t)
    side = lambda i, a: text.select(F.col("id").alias(i), F.col("norm").alias(a)).hint("merge")
    both = cand.join(side("i", "a"), "i").join(side("j", "b"), "j")
    edges = both.where(ratio("b", "a") >= t).select(F.col("i").alias("x"), F.col("j").alias("y"))
    return greedy_keep(base, edges).drop("norm")


def semantic_dedup(samples: DataFrame, col: str, t: float = 0.8) -> DataFrame:
    """Samples without any earlier neighbour above t; a removed neighbour counts too."""
    near = cosine_join(samples, col, t, strict=True).select(F.col("j").alias("id")).distinct()
    return samples.join(near, "id", "left_anti")


def clean_table(df: DataFrame, critical: list[str], important: list[str], numeric: list[str], text: list[str], short: int = 10) -> DataFrame:
    """Rows with all critical fields; blanks of text become ``[Missing X]``, bad numbers 0; duplicates go.

    Rows without any valid important field go, and rows whose texts are all
    short, unless more than half of the rows are like that.
    """
    out = df.dropna(subset=critical)
    for c in text:
        t = F.trim(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "\\x00", ""), r"[\r\n]+", " "))
        out = out.withColumn(c, F.when(F.col(c).isNull() | (t == ""), F.lit(f"[Missing {c}]")).otherwise(t))
    for c in numeric:
        out = out.withColumn(c, F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)))
    out = out.dropDuplicates()
    if important:
        valid = F.greatest(*[~F.col(c).cast("string").startswith("[Missing") for c in important], F.lit(False))
        out = out.where(valid)
    if text:
        is_short = F.least(*[F.length(c) < short for c in text], F.lit(True))
        share = out.agg(F.avg(is_short.cast("int")).alias("short_share"))
        out = out.withColumn("short", is_short).join(F.broadcast(share)).where(~F.col("short") | (F.col("short_share") > 0.5)).drop("short", "short_share")  # one row
    return out


def quality_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, nulls, null_share, numeric_share, distinct_values in one pass."""
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        s = F.col(c).cast("string")
        blank = s.isNull() | (F.trim(s) == "")
        aggs += [F.count_if(blank).alias(f"{c}__nulls"), F.count_if(F.expr(f"try_cast(cast(`{c}` as string) as double) is not null")).alias(f"{c}__num"), F.count_distinct(s).alias(f"{c}__dist")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"{c}__nulls").alias("nulls"), (F.col(f"{c}__nulls") / F.col("rows")).alias("null_share"), (F.col(f"{c}__num") / F.col("rows")).alias("numeric_share"), F.col(f"{c}__dist").alias("distinct_values")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


PLACEHOLDER = r"(?i)^\s*(\[missing.*|n/?a|none|null|todo|tbd|placeholder)\s*$"


def validate_samples(df: DataFrame, required: list[str], least: int = 5, most_placeholders: float = 0.3) -> DataFrame:
    """All rows with ``valid`` and ``reason``: the first rule broken."""
    reason = F.lit(None).cast("string")
    share = sum((F.coalesce(F.col(c).rlike(PLACEHOLDER), F.lit(True)).cast("int") for c in required), F.lit(0)) / len(required)
    reason = F.when(share > most_placeholders, "placeholders").otherwise(reason)
    for c in reversed(required):
        t = F.trim(F.coalesce(F.col(c), F.lit("")))
        reason = F.when(F.col(c).isNull(), f"missing {c}").when(t.rlike(PLACEHOLDER), f"placeholder {c}").when(F.length(t) < least, f"short {c}").otherwise(reason)
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


ALIASES = {"user_input": ("user_input", "question", "query"), "response": ("response", "answer", "rag_answer"), "reference": ("reference", "ground_truth", "expected_answer")}


def map_sample_fields(df: DataFrame) -> DataFrame:
    """Columns of the evaluation sample from whatever aliases the table has; a scalar context becomes an array."""
    pick = lambda names: F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns], F.lit(None).cast("string"))
    kinds = dict(df.dtypes)
    ctx = next((c for c in ("retrieved_contexts", "contexts", "context") if c in df.columns), None)
    contexts = F.array().cast("array<string>") if ctx is None else F.col(ctx) if kinds[ctx].startswith("array") else F.when(F.col(ctx).isNotNull(), F.array(ctx)).otherwise(F.array().cast("array<string>"))
    extra = [c for c in ("id", "item_id") if c in df.columns]
    return df.select(*extra, *[pick(v).alias(k) for k, v in ALIASES.items()], contexts.alias("retrieved_contexts"))


def validation_summary(validated: DataFrame, by: str, least_rate: float = 0.8) -> DataFrame:
    """by, input, valid, rejected, success_rate, status."""
    s = validated.groupBy(by).agg(F.count("*").alias("input"), F.count_if("valid").alias("valid_rows"))
    rate = F.col("valid_rows") / F.col("input")
    return s.select(by, "input", "valid_rows", (F.col("input") - F.col("valid_rows")).alias("rejected"), rate.alias("success_rate"), F.when(rate < least_rate, "FAILED").otherwise("PASSED").alias("status"))
