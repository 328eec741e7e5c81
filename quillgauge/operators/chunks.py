"""Sentences, chunks and passages: order-dependent folds stay inside one document."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.session import hot_join, number_rows, settle

#: Between the documents of a unit.
SEPARATOR = "\n\n--- Document ---\n\n"
ENDINGS, QUOTES = ".?!。？！；", "\"'”’」』）)]"


def sentence_texts(text: Column) -> Column:
    """Sentences in order: broken at newlines and behind end marks with the quotes that follow them, trimmed."""
    found = F.regexp_extract_all(text, F.lit(r"[^\n.?!。？！；]*[.?!。？！；][\"'”’」』）)\]]*|[^\n.?!。？！；]+"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, sentence, start, end: offsets in code points, found by the running length of all pieces."""
    pieces = F.regexp_extract_all("text", F.lit(r"[^\n.?!。？！；]*[.?!。？！；][\"'”’」』）)\]]*|[^\n.?!。？！；]+|\n"), F.lit(0))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), pieces.alias("p")).select("doc_id", "row", F.posexplode("p").alias("raw", "s"))
    order = Window.partitionBy("row").orderBy("raw")
    at = F.coalesce(F.sum(F.length("s")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    lead = F.length(F.regexp_extract("s", r"^\s*", 0))
    trimmed = F.regexp_replace("s", r"^\s+|\s+$", "")
    rows = rows.select("doc_id", "row", "raw", trimmed.alias("sentence"), (at + lead).alias("start")).where("sentence <> ''")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "sentence", "start", (F.col("start") + F.length("sentence")).alias("end"))


def split_sentences(text: Column) -> Column:
    """Split behind end marks, blank parts dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？.!?])\s*"), lambda s: F.trim(s)), lambda s: s != "")


def chunk_bounds(counts: Column, target: int, hard_max: int, overlap: int, trim: bool = False) -> Column:
    """array of struct(start, end) over the tokens of a document from the token counts of its segments.

    Tokens are added segment by segment; a chunk ends when it has ``target``
    tokens, and the next begins ``overlap`` tokens earlier.  A segment that
    would exceed ``hard_max`` first closes the chunk at hand; with ``trim`` the
    leading tokens of the buffer are given up instead.  Only counts are folded.
    """
    kind = "struct<lo:int,hi:int,fresh:boolean,out:array<struct<start:int,end:int>>>"
    start = F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(False).alias("fresh"), F.array().cast("array<struct<start:int,end:int>>").alias("out")).cast(kind)

    def step(acc: Column, n: Column) -> Column:
        over = (acc.hi - acc.lo + n) > hard_max
        if trim:
            lo, out = F.when(over, acc.hi + n - hard_max).otherwise(acc.lo), acc.out
            lo = F.least(lo, acc.hi)
        else:
            flush = over & acc.fresh
            out = F.when(flush, F.concat(acc.out, F.array(F.struct(acc.lo.alias("start"), acc.hi.alias("end"))))).otherwise(acc.out)
            kept = F.greatest(acc.hi + n - hard_max, acc.hi - overlap, acc.lo)
            lo = F.when(over, F.least(kept, acc.hi)).otherwise(acc.lo)
        hi = acc.hi + n
        full = (hi - lo) >= target
        out = F.when(full, F.concat(out, F.array(F.struct(lo.alias("start"), hi.alias("end"))))).otherwise(out)
        return F.struct(F.when(full, F.greatest(hi - overlap, lo)).otherwise(lo).alias("lo"), hi.alias("hi"), (~full).alias("fresh"), out.alias("out")).cast(kind)

    def finish(acc: Column) -> Column:
        rest = acc.fresh & (acc.hi > acc.lo)
        return F.when(rest, F.concat(acc.out, F.array(F.struct(acc.lo.alias("start"), acc.hi.alias("end"))))).otherwise(acc.out)

    return F.aggregate(counts, start, step, finish)


def chunk_documents(docs: DataFrame, target: int = 512, hard_max: int = 800, overlap: int = 50, overflow: str = "flush") -> DataFrame:
    """doc_id, sequence_index, token_count, text; one narrow stage, tokens being words between white space."""
    per = F.transform(sentence_texts(F.col("text")), lambda s: T.words(s))
    d = docs.select("doc_id", per.alias("s")).select("doc_id", F.flatten("s").alias("tokens"), F.transform("s", lambda x: F.size(x)).alias("sizes"))
    slices = lambda n: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / hard_max).cast("int")), lambda i: F.least(n - i * hard_max, F.lit(hard_max)))
    sizes = F.flatten(F.transform(F.filter("sizes", lambda n: n > 0), slices))
    d = d.withColumn("bounds", chunk_bounds(sizes, target, hard_max, overlap, overflow == "trim"))
    d = d.select("doc_id", "tokens", F.posexplode("bounds").alias("sequence_index", "b"))
    n = F.col("b.end") - F.col("b.start")
    return d.select("doc_id", "sequence_index", n.alias("token_count"), F.array_join(F.slice("tokens", F.col("b.start") + 1, n), " ").alias("text"))


def chunk_histogram(chunks: DataFrame, width: int = 100) -> DataFrame:
    """bucket label, chunks, tokens."""
    lo = (F.floor((F.col("token_count") - 1) / width) * width).cast("int")
    return chunks.groupBy(lo.alias("lo")).agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens")).select(F.concat_ws("-", "lo", F.col("lo") + width).alias("bucket"), "chunks", "tokens")


def chunk_chars(docs: DataFrame, size: int = 1000, overlap: int = 200, least: int = 100) -> DataFrame:
    """doc_id, pos, chunk: windows of a fixed stride."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(stride))
    rows = docs.select("doc_id", "text", F.posexplode(starts).alias("pos", "at"))
    return rows.select("doc_id", "pos", F.expr(f"substring(text, at + 1, {size})").alias("chunk")).where(F.length("chunk") >= least)


def chunk_chars_at_breaks(docs: DataFrame, size: int = 1000, overlap: int = 200, least: int = 100, search: int = 50) -> DataFrame:
    """As chunk_chars, but a window ends at the last sentence end within its last characters; each depends on the one before."""

    def run(frames):
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["text"], strict=True):
                at, pos = 0, 0
                while text and at < len(text):
                    end = min(at + size, len(text))
                    if end < len(text) and (cut := max(text.rfind(c, end - search, end) for c in ".!?\n")) > at:
                        end = cut + 1
                    if end - at >= least:
                        rows.append((doc_id, pos, text[at:end]))
                        pos += 1
                    at = end if end >= len(text) else max(end - overlap, at + 1)
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, pos int, chunk string")


def pack_passages(docs: DataFrame, most: int = 500, least: int = 60) -> DataFrame:
    """doc_id, pos, passage: sentences joined while the passage is short, folded over their lengths."""
    kind = "struct<n:int,i:int,first:int,out:array<struct<a:int,b:int>>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(0).alias("first"), F.array().cast("array<struct<a:int,b:int>>").alias("out")).cast(kind)

    def step(acc, size):
        n = acc.n + size + F.when(acc.i > acc.first, 1).otherwise(0)
        full = n >= most
        out = F.when(full, F.concat(acc.out, F.array(F.struct(acc.first.alias("a"), (acc.i + 1).alias("b"))))).otherwise(acc.out)
        return F.struct(F.when(full, 0).otherwise(n).alias("n"), (acc.i + 1).alias("i"), F.when(full, acc.i + 1).otherwise(acc.first).alias("first"), out.alias("out")).cast(kind)

    finish = lambda acc: F.when(acc.i > acc.first, F.concat(acc.out, F.array(F.struct(acc.first.alias("a"), acc.i.alias("b"))))).otherwise(acc.out)
    d = docs.select("doc_id", split_sentences(F.col("text")).alias("s"))
    d = d.select("doc_id", "s", F.posexplode(F.aggregate(F.transform("s", lambda x: F.length(x)), start, step, finish)).alias("pos", "r"))
    return d.select("doc_id", "pos", F.array_join(F.slice("s", F.col("r.a") + 1, F.col("r.b") - F.col("r.a")), " ").alias("passage")).where(F.length("passage") >= least)


def unit_saves(ahead: np.ndarray, starts: np.ndarray, target: int, least: int, most: int) -> np.ndarray:
    """For each start, the first document before which a unit is saved; len(ahead) - 1 if there is none.

    ``ahead`` are the running token counts, 0 first; a start is the running
    count at which its unit is empty.  A unit is saved before a document if it
    has tokens and would pass ``most``, or has ``least`` and would pass
    ``target``; both only come true once as counts run on.
    """
    over = np.maximum(np.searchsorted(ahead, starts, "right"), np.searchsorted(ahead, starts + most, "right") - 1)
    full = np.maximum(np.searchsorted(ahead, starts + least, "left"), np.searchsorted(ahead, starts + target, "right") - 1)
    return np.minimum(np.minimum(over, full), len(ahead) - 1)


def aggregate_documents(docs: DataFrame, key: str, target: int, least: int, most: int, overlap: int = 0, ids: int = 1000) -> DataFrame:
    """key, unit, doc_id, tokens: documents of a category in order, joined into units of tokens.

    A unit is saved before a document that takes it over ``most``, or over
    ``target`` once it has ``least``; only the last rest of a category is
    dropped, if below ``least``.  With an overlap a unit begins with the last
    4 * ``overlap`` characters of the one before, whose tokens count.

    Token counts are folded in blocks of document ids.  After the first unit
    that a block saves, its fold does not depend on the blocks before; so each
    block tells its outcome for every document that can be the first to be
    saved before, a pass over these finds the tokens that enter each block,
    and the blocks are folded with them.  An overlap depends on texts of the
    blocks before, so a category is one block then.
    """
    if not 0 < least <= target <= most:
        raise ValueError("needs 0 < least <= target <= most")
    last = F.expr(f"right(text, {4 * overlap})") if overlap else F.lit("")
    block = F.lit(0).cast("long") if overlap else F.floor(F.col("doc_id") / ids)
    rows = settle(docs.select(F.col(key).alias("k"), block.alias("block"), "doc_id", F.greatest(F.size(T.words(F.col("text"))), F.lit(0)).cast("long").alias("n"), F.coalesce(last, F.lit("")).alias("tail")), "units")

    def ordered(f: pd.DataFrame) -> pd.DataFrame:
        return f.sort_values(["doc_id", "n", "tail"])

    def outcomes(f: pd.DataFrame) -> pd.DataFrame:
        n = ordered(f)["n"].to_numpy(dtype=np.int64)
        ahead = np.concatenate([[0], np.cumsum(n)])
        saves, out, units = unit_saves(ahead, ahead[:-1], target, least, most), [0] * len(n), [0] * len(n)
        for p in range(len(n) - 1, -1, -1):
            q = saves[p]
            out[p], units[p] = (int(ahead[-1] - ahead[p]), 0) if q == len(n) else (out[q], units[q] + 1)
        k = int(unit_saves(ahead, np.array([0]), target, least, most)[0]) + 1  # any unit that has tokens is saved by then
        return pd.DataFrame([(f["k"].iloc[0], f["block"].iloc[0], ahead[: k + 1].tolist(), out[:k], units[:k], int(ahead[-1]))], columns=["k", "block", "ahead", "out", "units", "total"])

    def enter(f: pd.DataFrame) -> pd.DataFrame:
        got, tokens, unit = [], 0, 0
        for b in f.sort_values("block").itertuples(index=False):
            got.append((b.k, b.block, tokens, unit))
            ahead = np.asarray(b.ahead, dtype=np.int64)
            p = int(unit_saves(ahead, np.array([-tokens]), target, least, most)[0])
            if p < len(b.out):
                tokens, unit = int(b.out[p]), unit + 1 + int(b.units[p])
            else:
                tokens += int(b.total)
        out = pd.DataFrame(got, columns=["k", "block", "tokens_in", "unit_in"])
        return out.assign(dropped=unit if tokens < least else -1)

    def fold(f: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        out, tokens, unit, dropped = [], int(at["tokens_in"].iloc[0]), int(at["unit_in"].iloc[0]), int(at["dropped"].iloc[0])
        carried, text, empty = 0, "", True
        for doc_id, n, tail in ordered(f)[["doc_id", "n", "tail"]].itertuples(index=False):
            if tokens and (tokens + n > most or tokens >= least and tokens + n > target):
                text = text[-4 * overlap :] if overlap else ""
                tokens = carried = len(text.split())
                unit, empty = unit + 1, not text
            if overlap:
                text = (text if empty else text + SEPARATOR) + tail
                text, empty = text[-4 * overlap :], not text
            tokens += n
            out.append((f["k"].iloc[0], unit, doc_id, n, carried))
        if overlap and tokens >= least:
            dropped = -1
        elif overlap:
            dropped = unit
        got = pd.DataFrame(out, columns=["k", "unit", "doc_id", "n", "carried"])
        return got[got["unit"] != dropped]

    kind = dict(rows.dtypes)["k"]
    told = rows.groupBy("k", "block").applyInPandas(outcomes, f"k {kind}, block long, ahead array<long>, out array<long>, units array<long>, total long")
    entries = told.groupBy("k").applyInPandas(enter, f"k {kind}, block long, tokens_in long, unit_in long, dropped long")
    got = rows.groupBy("k", "block").cogroup(entries.groupBy("k", "block")).applyInPandas(fold, f"k {kind}, unit long, doc_id long, n long, carried long")
    tokens = F.sum("n").over(Window.partitionBy("k", "unit")) + F.col("carried")
    return got.select(F.col("k").alias(key), "unit", "doc_id", tokens.alias("tokens"))


def multi_hop_groups(docs: DataFrame, budget: int, per: int = 3) -> DataFrame:
    """Groups of ``per`` documents of each source, kept within 1.5 budgets while they reach 0.7."""
    rows = docs.select("source", "doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n"))
    rows = settle(number_rows(rows, "source", "doc_id"), "numbered")
    first = rows.groupBy(F.col("source").alias("s")).agg(F.min("number").alias("first"), F.count("*").alias("n"))
    rows = hot_join(rows.withColumnRenamed("source", "s"), first, "s", rows.count())
    rows = rows.select("s", "doc_id", "n", F.floor((F.col("number") - F.col("first")) / per).alias("grp"))
    run = F.sum("n").over(Window.partitionBy("grp").orderBy("s", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("total", run).where(F.col("total") <= budget * 1.5)
    return kept.groupBy("grp").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).where(F.col("tokens") >= budget * 0.7)


def corpus_stats(docs: DataFrame) -> DataFrame:
    """docs, words, characters, average words by language and source, with totals."""
    rows = docs.select("lang", "source", F.size(T.words(F.col("text"))).cast("long").alias("w"), F.length("text").cast("long").alias("c"))
    return rows.rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("w").alias("words"), F.sum("c").alias("chars"), (F.sum("w") / F.count("*")).alias("avg_words"))
