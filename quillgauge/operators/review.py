"""Human feedback and repair data flows: review queues, thresholds, preference pairs, gaps."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.session import hot_join, number_rows, settle
from .neighbourhoods import neighbourhood_connectivity
from .simjoin import SetGraph
from .stats import quantiles, with_quantiles


def uncertainty_bounds(scores: DataFrame, by: str) -> DataFrame:
    """by, lo, hi: max(0.3, Q1 - 0.1), min(0.9, Q3 + 0.1); the widest bounds below five scores in [0, 1]."""
    ok = scores.where(F.col("score").between(0, 1))
    s = with_quantiles(ok.groupBy(by).agg(F.count("*").alias("n")), quantiles(ok, by, F.col("score"), {"q1": 0.25, "q3": 0.75}), by)
    few = F.col("n") < 5
    return s.select(by, F.when(few, 0.3).otherwise(F.greatest(F.lit(0.3), F.col("q1") - 0.1)).alias("lo"), F.when(few, 0.9).otherwise(F.least(F.lit(0.9), F.col("q3") + 0.1)).alias("hi"))


def review_candidates(resp: DataFrame, lo: float, hi: float, audit: float = 0.05) -> DataFrame:
    """resp with the first reason that fits; resp: id, confidence, answer, score, other_score."""
    hashed = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 6), 16, 10).cast("double") / float(0xFFFFFF)
    reason = (
        F.when(F.col("confidence") < 0.5, "low_confidence").when(F.length(F.trim("answer")) < 40, "short_answer").when(F.col("score") < 0.4, "low_score")
        .when(F.abs(F.col("score") - F.col("other_score")) > 0.3, "conflict").when(F.col("score").between(lo, hi), "uncertain").when(hashed < audit, "audit")
    )
    return resp.withColumn("reason", reason).where("reason is not null")


PRIORITY = {"low_confidence": "high", "low_score": "high", "conflict": "high", "short_answer": "medium", "uncertain": "medium", "audit": "low"}


def review_recommendations(candidates: DataFrame) -> DataFrame:
    """reason, priority, n, median_score."""
    p = F.coalesce(*[F.when(F.col("reason") == r, F.lit(x)) for r, x in PRIORITY.items()])
    return candidates.groupBy("reason").agg(F.count("*").alias("n"), F.percentile("score", 0.5).alias("median_score")).select("reason", p.alias("priority"), "n", "median_score")


def merge_queue(new: DataFrame, queue: DataFrame, results: DataFrame, key: str = "key") -> DataFrame:
    """Pending entries not yet reviewed, and new ones that are neither queued nor reviewed."""
    done = results.select(key).distinct()
    fresh = new.join(queue.select(key).distinct(), key, "left_anti").withColumn("status", F.lit("pending"))
    return queue.where(F.col("status") == "pending").unionByName(fresh.select(*queue.columns)).join(done, key, "left_anti")


def ingest_reviews(new: DataFrame, old: DataFrame) -> DataFrame:
    """New reviews once for each (index, question, reviewer)."""
    keys = ["index", "question", "reviewer"]
    r = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    return new.withColumn("r", r).where("r = 1").drop("r").join(old.select(*keys).distinct(), keys, "left_anti")


def match_feedback(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates with a result of their index or their question: the union of two semi joins."""
    a = candidates.join(results.select("index").distinct(), "index", "left_semi")
    b = candidates.join(results.select("question").distinct(), "question", "left_semi").select(*candidates.columns)
    return a.unionByName(b).distinct()


def review_summary(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("n"))


def replay_audit(events: DataFrame) -> DataFrame:
    """key, value of the final state: a replace resets all before it, upserts overwrite, ingests do not."""
    order = F.struct("created_at", "id")
    reset = events.where("op = 'replace'").agg(F.max(order).alias("reset"))
    e = events.withColumn("o", order).join(F.broadcast(reset)).where(F.col("reset").isNull() | (F.col("o") >= F.col("reset")))  # one row
    strong = F.when(F.col("op") != "ingest", F.col("o"))
    s = e.groupBy("key").agg(F.max_by("value", strong).alias("upserted"), F.max(strong).alias("at"), F.min_by("value", F.when(F.col("op") == "ingest", F.col("o"))).alias("ingested"))
    return s.select("key", F.when(F.col("at").isNotNull(), F.col("upserted")).otherwise(F.col("ingested")).alias("value"))


def feedback_window(fb: DataFrame, alpha: float = 0.3, size: int = 10) -> DataFrame:
    """key, seq, ema, variance (population) of the last ``size`` values, window between 3 and 10 by the variance."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(-(size - 1), 0)
    vals = F.collect_list("value").over(w)
    ema = F.aggregate(F.slice("vals", 2, F.lit(size)), F.col("vals")[0], lambda a, x: a * (1 - alpha) + x * alpha)
    out = fb.withColumns({"vals": vals, "variance": F.var_pop("value").over(w)}).withColumn("ema", ema)
    return out.withColumn("window", F.greatest(F.lit(3), F.least(F.lit(10), F.round(10 - F.col("variance") * 28).cast("int")))).drop("vals")


def recommend_threshold(scores: DataFrame, w: int) -> DataFrame:
    """key, threshold: median of the last w scores."""
    r = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return scores.withColumn("r", r).where(F.col("r") <= w).groupBy("key").agg(F.percentile("score", 0.5).alias("threshold"))


#: Renewals of the quartiles in a block of steps, and values of a range of ranks.
RENEWALS, RANGE = 800, 8000


def order_places(steps: pd.DataFrame, before: np.ndarray, every: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the quartiles of a block's renewals stand.

    ``steps`` (p, rank) are in order, ``before`` counts the values of earlier
    blocks in each range of ranks.  Gives the steps of the renewals, how many
    steps of the block lie up to each, the fraction between neighbours, and for
    (renewal, quartile, neighbour) the range and the place in it.
    """
    p, rank = steps["p"].to_numpy(), steps["rank"].to_numpy()
    at = np.flatnonzero((p + 1) % every == 0)
    ranges = np.where(rank >= 0, rank // width, -1)
    local = np.zeros((len(at), len(before)), np.int64)
    for k, (a, b) in enumerate(pairwise([0, *(at + 1)])):
        new = ranges[a:b]
        local[k] = np.bincount(new[new >= 0], minlength=len(before))
    upto = np.cumsum(before + np.cumsum(local, axis=0), axis=1)
    held = upto[:, -1]
    at, upto, held = at[held > 0], upto[held > 0], held[held > 0]
    place = (held[:, None] - 1) * np.array([0.25, 0.75])
    both = np.stack([np.floor(place), np.ceil(place)], axis=2).astype(np.int64)
    which = (upto[:, None, None, :] <= both[..., None]).sum(axis=3)
    ahead = np.concatenate([np.zeros((len(at), 1), np.int64), upto], axis=1)
    return p[at], at + 1, place - np.floor(place), which, both - ahead[np.arange(len(at))[:, None, None], which]


def counts_before(f: pd.DataFrame) -> np.ndarray:
    """Counts of earlier values by range from rows (range, n)."""
    own = f[f["n"].notna()]
    out = np.zeros(int(own["range"].max()) + 1 if len(own) else 1, np.int64)
    out[own["range"].to_numpy(dtype=np.int64)] = own["n"].to_numpy(dtype=np.int64)
    return out


def dynamic_gate(scores: DataFrame, every: int = 10, renewals: int = RENEWALS, width: int = RANGE) -> DataFrame:
    """key, seq, lo, hi, in_range: quartiles of all scores so far, renewed every tenth step.

    A key's steps are cut into blocks and its values, by their ranks, into
    ranges.  Counts of the values in each block and range, added up over the
    blocks, tell each block in which few ranges its quartiles lie; the earlier
    values of these alone are brought to it.  A task holds a block of steps and
    a few ranges of a key of any length.  Steps of the same seq are ordered by
    score; null scores are steps without a value.
    """
    kinds = dict(scores.dtypes)
    size = every * renewals
    v = F.when(~F.isnan(F.col("score").cast("double")), F.col("score").cast("double"))
    rows = number_rows(scores.select(F.struct("key").alias("of"), "seq", v.alias("score")), "of", F.asc_nulls_first("seq"), F.asc_nulls_first("score"), name="p")
    own = lambda df, number: df.groupBy("of").agg(F.min(number).alias("start"), F.count("*").alias("n"))
    total = rows.count()
    steps = hot_join(rows, own(rows, "p"), "of", total).withColumn("p", F.col("p") - F.col("start")).drop("start")
    valued = number_rows(steps.where("score is not null"), "of", "score", "p", name="rank")
    valued = settle(hot_join(valued, own(valued, "rank"), "of", total).withColumn("rank", F.col("rank") - F.col("start")).drop("start"), "ranked")
    block, part = F.floor((F.col("p") + 1) / size).alias("block"), F.floor(F.col("rank") / width).alias("range")
    steps = valued.unionByName(steps.where("score is null").withColumn("rank", F.lit(-1).cast("long"))).select("of", "seq", "score", "p", "rank", block)
    cells = valued.select("of", block, part).groupBy("of", "block", "range").agg(F.count("*").alias("c"))
    blocks, parts = steps.select("of", "block").distinct(), cells.select("of", "range").distinct()
    grid = blocks.join(parts, "of").join(cells, ["of", "block", "range"], "left")  # blocks times ranges of a key
    sofar = Window.partitionBy("of", "range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = settle(grid.select("of", "block", "range", F.coalesce(F.sum("c").over(sofar), F.lit(0)).alias("n")), "cells")

    def find(key: tuple, f: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(counts):
            return pd.DataFrame({"of": pd.Series([], dtype=object), "block": [], "range": []})
        which = np.unique(order_places(f.sort_values("p"), counts_before(counts), every, width)[3])
        return pd.DataFrame({"of": pd.Series([key[0]] * len(which), dtype=object), "block": key[1], "range": which})

    of = f"of struct<key: {kinds['key']}>"
    needed = steps.select("of", "block", "p", "rank").groupBy("of", "block").cogroup(before.groupBy("of", "block")).applyInPandas(find, f"{of}, block long, range long")
    earlier = valued.select("of", block.alias("from"), part, "rank", "score").join(needed, ["of", "range"]).where(F.col("from") < F.col("block"))
    more = before.select("of", "block", "range", "n", F.lit(None).cast("long").alias("rank"), F.lit(None).cast("double").alias("score"))
    more = more.unionByName(earlier.select("of", "block", "range", F.lit(None).cast("long").alias("n"), "rank", "score"))

    def gate(key: tuple, f: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("p", ignore_index=True)
        lo, hi = np.full(len(f), np.nan), np.full(len(f), np.nan)
        v, rank = f["score"].to_numpy(dtype=float), f["rank"].to_numpy()
        if len(known):
            at, upto, share, which, place = order_places(f, counts_before(known), every, width)
            old = known[known["rank"].notna()]
            pools = {r: (g["rank"].to_numpy(dtype=np.int64), g["score"].to_numpy()) for r, g in old.groupby("range")}
            none = (np.zeros(0, np.int64), np.zeros(0))
            inside = {r: np.flatnonzero((rank >= 0) & (rank // width == r)) for r in np.unique(which)}
            for k in range(len(at)):
                ends = np.empty((2, 2))
                for q in range(2):
                    for side in range(2):
                        r = int(which[k, q, side])
                        mine = inside[r][inside[r] < upto[k]]
                        ranks = np.concatenate([pools.get(r, none)[0], rank[mine]])
                        values = np.concatenate([pools.get(r, none)[1], v[mine]])
                        ends[q, side] = values[np.argpartition(ranks, place[k, q, side])[place[k, q, side]]]
                quart = ends[:, 0] + (ends[:, 1] - ends[:, 0]) * share[k]
                a = upto[k] - 1
                lo[a : a + every], hi[a : a + every] = round(quart[0], 9), round(quart[1], 9)
        return pd.DataFrame({"of": pd.Series([key[0]] * len(f), dtype=object), "seq": f["seq"], "lo": lo, "hi": hi, "in_range": (v >= lo) & (v <= hi)})

    out = steps.groupBy("of", "block").cogroup(more.groupBy("of", "block")).applyInPandas(gate, f"{of}, seq {kinds['seq']}, lo double, hi double, in_range boolean")
    return out.select("of.key", "seq", "lo", "hi", "in_range")


def threshold_path(scores: DataFrame) -> DataFrame:
    """key, seq, threshold: the score of the last gated step with positive feedback."""
    run = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return scores.select("key", "seq", F.last(F.when(F.col("gated") & (F.col("feedback") == 1), F.col("score")), ignorenulls=True).over(run).alias("threshold"))


def preference_pairs(resp: DataFrame, least: float = 0.6) -> DataFrame:
    """prompt, chosen, rejected where a reference is there and the answer is empty or unsure."""
    weak = (F.trim(F.coalesce("answer", F.lit(""))) == "") | (F.col("confidence") < least)
    return resp.where(F.col("reference").isNotNull() & (F.trim("reference") != "") & weak).select(F.col("question").alias("prompt"), F.col("reference").alias("chosen"), F.coalesce("answer", F.lit("")).alias("rejected"))


def diagnose_gaps(gcr: DataFrame) -> DataFrame:
    """query_id, gap, severity, position from scores of graph context relevance."""
    gaps = F.filter(F.array(
        F.struct(F.lit("connectivity").alias("gap"), F.when(F.col("structural_connectivity") < 0.5, 0.5 - F.col("structural_connectivity")).alias("severity")),
        F.struct(F.lit("coverage").alias("gap"), F.when(F.col("entity_overlap") < 0.4, 0.4 - F.col("entity_overlap")).alias("severity")),
        F.struct(F.lit("hub_noise").alias("gap"), F.when(F.col("hub_noise_penalty") > 0.3, F.col("hub_noise_penalty") - 0.3).alias("severity")),
    ), lambda g: g.severity.isNotNull())
    rows = gcr.select("query_id", F.explode(gaps).alias("g")).select("query_id", "g.*")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("severity"), "gap")))


def propose_patch(gaps: DataFrame, passages: DataFrame, store: DataFrame, k: int = 2) -> DataFrame:
    """id, passage, hash, score: the best passages for each gap (id, tokens) whose hash is not stored yet."""
    from .simjoin import filter_new, lexical_search

    hits = lexical_search(gaps, passages.select("id", T.token_set(F.col("passage")).alias("tokens")), k)
    p = passages.select(F.col("id").alias("pid"), "passage", T.content_hash(F.col("passage")).alias("hash"))
    return filter_new(hits.join(p, F.col("id") == F.col("pid")).select("qid", "pid", "passage", "hash", "score"), store, "hash")


def pending_proposals(df: DataFrame, now: Column, ttl_hours: int = 24) -> DataFrame:
    """id, state: pending or expired."""
    return df.select("id", F.when(F.col("created_at") + F.expr(f"interval {ttl_hours} hours") >= now, "pending").otherwise("expired").alias("state"))


def verify_patch(queries: DataFrame, patch: DataFrame, edges: DataFrame | SetGraph, least_gain: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """query_id, old, new, gain of connectivity for each query, and one row mean_gain, passed.

    queries: query_id, tokens, structural_connectivity; patch: id, tokens of
    the proposed nodes; edges (source, target) of the graph with the proposed
    ones, or a ``SetGraph``, of which only links between proposed nodes are
    found.  A query's set are the proposed nodes that share a token with it and
    their neighbours; one that shares none takes all proposed nodes, which are
    looked at once.  Edges that stay in the set join its members.
    """
    from .gcr import structural_connectivity

    queries = settle(queries.select("query_id", "tokens", "structural_connectivity"), "queries")
    if isinstance(edges, SetGraph):
        new = settle(neighbourhood_connectivity(queries, patch, edges), "connectivity")
    else:
        tokens = lambda df, key: df.select(F.col(key), F.explode(F.array_distinct("tokens")).alias("token"))
        shared = tokens(queries, "query_id").join(tokens(patch, "id"), "token").select("query_id", "id").distinct()
        everything = patch.select(F.lit(None).cast(dict(queries.dtypes)["query_id"]).alias("query_id"), "id").distinct()
        seeds = settle(shared.union(everything).select(F.struct("query_id").alias("query_id"), "id"), "seeds")
        both = edges.select("source", "target").union(edges.select("target", "source")).toDF("source", "target").where("source <> target").distinct()
        reached = seeds.join(both, F.col("id") == F.col("source")).select("query_id", F.col("target").alias("id"))
        members = settle(seeds.union(reached).distinct(), "members")
        graph = both.where("source < target").select(F.col("source").alias("x"), F.col("target").alias("y"))
        new = settle(structural_connectivity(members, graph).select("query_id.query_id", "connectivity"), "connectivity")
    rest = new.where("query_id is null").select(F.col("connectivity").alias("all_new"))
    old = F.coalesce("structural_connectivity", F.lit(0.0))
    out = queries.select("query_id", old.alias("old")).join(new, "query_id", "left").join(F.broadcast(rest), how="left")  # one row at most
    out = out.select("query_id", "old", F.coalesce("connectivity", "all_new", "old").alias("new"))
    out = out.withColumn("gain", F.greatest(F.lit(0.0), F.col("new") - F.col("old")))
    mean = F.round(F.coalesce(F.avg("gain"), F.lit(0.0)), 4)
    return out, out.agg(mean.alias("mean_gain")).withColumn("passed", F.col("mean_gain") >= least_gain)
