"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of distinct word shingles.  Documents with equal sets
form a class, whose smallest id represents it.  Representatives are then
branched recursively: a node of a tree chooses minwise tokens (positions of a
signature, drawn from the node's own path), and a document goes to the child
that its token at that position names.  With two branches a node and a
similarity of 0.8 a pair stays together in at least 94 % of the trees however
deep they are, and independent trees are repeated until the recall aimed at is
reached.  Small nodes are compared exhaustively on 128-bit sketches; of the
similar pairs a node hands on a spanning forest only.

The components of these candidate pairs hold every link.  Within each of them
links are confirmed on the full sets.  Components that are too large for one
task are cut into blocks; a few leaders at a time are compared with all blocks,
until every document outside the largest confirmed component has been a leader,
so that no link between components can be missed.

Edge cases: a null or empty text has no shingles and is linked with nothing;
texts of fewer words than a shingle has are one shingle, the whole sequence; a
very long text is hashed whole, with all its shingles; a row without an id is
linked with nothing and kept; rows that share an id give a row each and count
as one document where both are compared; of equal texts the smallest id stands
for all; an empty table gives an empty result; other columns, whatever their
names, are ignored.  The many copies of one text, or the members of one large
component, are never gathered: their class's row is brought to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import component_roots
from .shared import discard, hot_join, settle

#: Default width of a shingle in words, and least similarity in per cent.
WIDTH, PERCENT = 5, 80
POSITIONS = 128
BRANCHES = 2
RECALL = 0.9999
#: Depth of the first nodes that are counted, and of those that are not branched further.
FIRST_DEPTH, LAST_DEPTH = 2, 7
#: Documents of a node that is compared exhaustively.
NODE_LIMIT = 512
#: A large node with this share of its parent's documents holds mostly similar ones and is not branched further.
ALIKE = 0.6
#: Documents and shingles of a candidate component that one task confirms, documents of a block, leaders of a round.
GROUP_DOCS, GROUP_SHINGLES, BLOCK_DOCS, LEADERS = 8000, 4_000_000, 2000, 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = words_of(text) if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, width)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[j : n - k + 1 + j]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 32, POSITIONS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, POSITIONS, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each position a byte that names the minwise shingle."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(least, ((low[i : i + 1024, None] ^ _B) * _A).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def describe(text: Column, width: int) -> Column:
    """struct(n_shingles, h0, h1: hash of the set, sig, s0, s1: sketch)."""

    @F.pandas_udf("n_shingles long, h0 long, h1 long, sig binary, s0 long, s1 long")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingle_set(t, width)
            digest = xxhash.xxh3_128_digest(s.tobytes())
            sig = signature(s)
            rows.append((len(s), *np.frombuffer(digest, np.int64).tolist(), sig.tobytes(), *np.packbits(sig & 1).view(np.int64).tolist()))
        return pd.DataFrame(rows, columns=["n_shingles", "h0", "h1", "sig", "s0", "s1"])

    return run(text)


def trees_for(recall: float, percent: int = PERCENT, branches: int = BRANCHES, depth: int = LAST_DEPTH) -> int:
    """Trees after which a pair of just this similarity has met with the probability ``recall``.

    All trees draw from the same signature, so they are independent only given
    the share of its positions at which the pair agrees: the loss is averaged
    over that share.
    """

    def lost(share: float) -> float:
        out = 0.0
        for _ in range(depth):
            out = (1 - share * (1 - out)) ** branches
        return out

    p, agree = percent / 100, np.arange(POSITIONS + 1)
    weight = np.array([math.comb(POSITIONS, k) * p**k * (1 - p) ** (POSITIONS - k) for k in agree])
    each = np.array([lost(k / POSITIONS) for k in agree])
    trees = 1
    while (weight * each**trees).sum() > 1 - recall:
        trees += 1
    return trees


def children(key: Column, sig: Column) -> list[Column]:
    """Keys of a document's children below a node: by the tokens at two positions that the node's key draws."""
    first = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(POSITIONS))
    step = F.pmod(F.xxhash64(key, F.lit(2)), F.lit(POSITIONS - 1)) + 1
    return [F.xxhash64(key, F.lit(j), F.substring(sig, (F.pmod(first + j * step, F.lit(POSITIONS)) + 1).cast("int"), F.lit(1))) for j in range(BRANCHES)]


def descend(nodes: list[Column], sig: Column, levels: int) -> list[Column]:
    for _ in range(levels):
        nodes = [c for key in nodes for c in children(key, sig)]
    return nodes


def far_bits(percent: int) -> int:
    """Differing sketch bits up to which a pair counts as a candidate: 4.5 standard deviations above the mean."""
    p = (1 - percent / 100) / 2
    return math.ceil(POSITIONS * p + 4.5 * math.sqrt(POSITIONS * p * (1 - p)))


class Forest:
    """Union by index, with the smaller index as the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class Parts:
    """Components with the label of every member at hand; a join relabels the smaller one."""

    def __init__(self, n: int):
        self.label, self.members, self.largest = np.arange(n), {i: [i] for i in range(n)}, 0

    def join(self, i: int, j: int) -> None:
        i, j = int(self.label[i]), int(self.label[j])
        if i != j:
            if len(self.members[i]) < len(self.members[j]):
                i, j = j, i
            moved = self.members.pop(j)
            self.label[moved] = i
            self.members[i] += moved
            if len(self.members[i]) > len(self.members.get(self.largest, ())):
                self.largest = i


def by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys (the first column); a run is never parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0
        if cut or (held and held[-1].column(0)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def compare_nodes(far: int):
    """Rows (key, rep, s0, s1) sorted by key -> edges (x, y): a spanning forest of the similar pairs of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches):
            key, rep, s0, s1 = (t.column(i).to_numpy() for i in range(4))
            s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
            at, lag, pairs = np.arange(len(key)), 0, []
            forest, root = None, np.arange(len(key))
            while True:
                lag += 1
                at = at[at + lag < len(key)]
                at = at[key[at] == key[at + lag]]
                if not len(at):
                    break
                off = np.bitwise_count(s0[at] ^ s0[at + lag]) + np.bitwise_count(s1[at] ^ s1[at + lag])
                hit = at[off <= far]
                hit = hit[root[hit] != root[hit + lag]]
                if len(hit):
                    forest = forest or Forest(len(key))
                    pairs += [(i, i + lag) for i in hit.tolist() if forest.join(i, i + lag)]
                    if lag < 4 or lag & (lag - 1) == 0:  # now and then, so that pairs joined already fall away above
                        root = np.array([forest.find(i) for i in range(len(key))])
            if pairs:
                x, y = rep[np.array(pairs)].T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])

    return run


def candidate_pairs(reps: DataFrame, percent: int, recall: float, node_limit: int = NODE_LIMIT, last_depth: int = LAST_DEPTH) -> DataFrame:
    """Edges (x, y) whose components hold all pairs of the given similarity, up to the recall."""
    trees = trees_for(recall, percent, depth=last_depth)
    roots = [F.xxhash64(F.lit("tree"), F.lit(r)) for r in range(trees)]
    sig = F.col("sig")
    nodes = reps.select(F.explode(F.array(*descend(roots, sig, FIRST_DEPTH))).alias("key"), "rep", "sig", "s0", "s1", F.lit(None).cast("long").alias("above"))
    depth, found = FIRST_DEPTH, []
    while True:
        large = nodes.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least"), F.max("above").alias("above")).where(F.col("n") > node_limit)
        alike = F.coalesce(F.col("n") >= F.col("above") * ALIKE, F.lit(False)) if depth < last_depth else F.lit(True)
        large = settle(large.select("key", "n", "least", alike.alias("alike")), "large-nodes")
        leaves = nodes.join(large.select("key"), "key", "left_anti").select("key", "rep", "s0", "s1")
        leaves = leaves.repartition("key").sortWithinPartitions("key", "rep")
        found.append(settle(leaves.mapInArrow(compare_nodes(far_bits(percent)), "x long, y long").distinct(), "pairs"))
        if large.isEmpty():
            break
        # documents that shared so many tokens are taken together as they are
        whole = nodes.join(large.where("alike").select("key", "least"), "key").where(F.col("rep") != F.col("least"))
        found.append(settle(whole.select(F.col("least").alias("x"), F.col("rep").alias("y")).distinct(), "pairs"))
        deeper = nodes.drop("above").join(large.where("not alike").select("key", F.col("n").alias("above")), "key")
        below = settle(deeper.select(F.explode(F.array(*children(F.col("key"), sig))).alias("key"), "rep", "sig", "s0", "s1", "above"), "nodes")
        discard(nodes, large)
        nodes = below
        depth += 1
        if nodes.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return settle(out.distinct(), "candidates")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the exact similarity of two sorted sets reaches the threshold."""
    la, lb = len(a), len(b)
    if 100 * min(la, lb) < percent * max(la, lb):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (la + lb - shared)


class Index:
    """Which of some sets hold each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])
        owner, flat = np.repeat(np.arange(len(sets)), self.sizes), np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def central(self) -> np.ndarray:
        """How widely spread a set's shingles are, on average."""
        df = np.searchsorted(self.flat, self.flat, side="right") - np.searchsorted(self.flat, self.flat)
        return np.bincount(self.owner, weights=df, minlength=len(self.sets)) / np.maximum(self.sizes, 1)

    def links(self, q: int, percent: int) -> list[int]:
        """All sets whose exact similarity to set q reaches the threshold."""
        lo = np.searchsorted(self.flat, self.sets[q])
        n = np.searchsorted(self.flat, self.sets[q], side="right") - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.sets))
        return np.flatnonzero((shared > 0) & (100 * shared >= percent * (self.sizes + self.sizes[q] - shared))).tolist()


def confirm(sets: list[np.ndarray], percent: int) -> Parts:
    """Components of the exact links between the sets.

    One set after the other, the most central first, is compared with all,
    until all sets outside the largest component have been.
    """
    m, parts = len(sets), Parts(len(sets))
    if m == 2:
        if linked(*sets, percent):
            parts.join(0, 1)
        return parts
    index = Index(sets)
    score = index.central()
    while (waiting := (score >= 0) & (parts.label != parts.largest)).any():
        q = int(np.argmax(np.where(waiting, score, -1.0)))
        for j in index.links(q, percent):
            parts.join(q, j)
        score[q] = -1.0  # asked
    return parts


def confirm_groups(width: int, percent: int):
    """Rows (comp, rep, text) sorted by comp -> (id, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches):
            comp, reps = t.column(0).to_numpy(), t.column(1).to_pylist()
            edge = [0, *(np.flatnonzero(np.diff(comp)) + 1).tolist(), len(comp)]
            out = []
            for a, b in zip(edge, edge[1:], strict=False):
                parts = confirm([shingle_set(x, width) for x in t.column(2).slice(a, b - a).to_pylist()], percent)
                first: dict[int, int] = {}
                for i, r in enumerate(reps[a:b]):
                    parts.join(first.setdefault(r, i), i)
                best = {k: min(reps[a + i] for i in members) for k, members in parts.members.items()}
                out += [(r, best[k]) for r, k in zip(reps[a:b], parts.label.tolist(), strict=True)]
            ids, roots = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], names=["id", "root"])

    return run


def compare_leaders(width: int, percent: int):
    """Rows (block, rep, text, leads) sorted by block, leaders first -> links (x: leader, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches):
            block, reps, leads = t.column(0).to_numpy(), t.column(1).to_pylist(), t.column(3).to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            out = []
            for a, b in zip(edge, edge[1:], strict=False):
                sets = [shingle_set(x, width) for x in t.column(2).slice(a, b - a).to_pylist()]
                index = Index(sets)
                for q in np.flatnonzero(leads[a:b]).tolist():
                    out += [(reps[a + q], reps[a + j]) for j in index.links(q, percent) if reps[a + j] != reps[a + q]]
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    return run


def centrality(members: DataFrame) -> DataFrame:
    """comp, rep, size, score: positions at which a document's signature has its component's most frequent token."""
    rows = members.select("comp", "rep", "size", "sig").distinct()
    each = rows.select("comp", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(POSITIONS)), lambda i: F.substring("sig", i, 1))).alias("p", "b"))
    modes = each.groupBy("comp", "p", "b").count().groupBy("comp", "p").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
    usual = rows.groupBy("comp").agg(F.count("*").alias("n")).join(modes.groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "b"))), lambda x: x.b).alias("usual")), "comp")
    hits = F.filter(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda i: F.substring("sig", i + 1, F.lit(1)) == F.get("usual", i))
    return hot_join(rows, usual, "comp", rows.count()).select("comp", "rep", "size", F.size(hits).alias("score"))


def confirm_large(members: DataFrame, width: int, percent: int, block_docs: int = BLOCK_DOCS, leaders: int = LEADERS) -> DataFrame:
    """id, root for the components too large for one task; members: comp, rep, text, sig, size (shingles), n, all (documents and shingles of comp)."""
    members = settle(members, "members")
    ids = settle(centrality(members), "centrality")
    asked = links = None
    while True:
        if links is None:
            waiting, most = ids, leaders // 32
        else:
            roots = component_roots(links)
            labelled = settle(ids.join(roots, ids.rep == roots.id, "left").select("comp", "rep", "size", "score", F.coalesce("root", "rep").alias("root")), "labelled")
            sizes = labelled.groupBy("comp", "root").count().groupBy("comp").agg(F.max_by("root", F.struct("count", "root")).alias("root"))
            waiting, most = labelled.join(sizes, ["comp", "root"], "left_anti").join(asked, "rep", "left_anti"), leaders
        # the most central first; Spark keeps no more than these of each partition before it gathers them
        rank = F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("score"), "rep"))
        first = waiting.select("comp", "rep", "size", rank.alias("rank")).where(F.col("rank") <= most)
        held = F.sum("size").over(Window.partitionBy("comp").orderBy("rank"))
        picked = settle(first.withColumn("held", held).where((F.col("held") <= GROUP_SHINGLES // 2) | (F.col("rank") == 1)).select("rep"), "leaders")
        if picked.isEmpty():
            return labelled.select(F.col("rep").alias("id"), "root")
        asked = picked if asked is None else settle(asked.union(picked), "asked")
        blocks = F.ceil(F.greatest(F.col("n") / block_docs, F.col("all") * 2 / GROUP_SHINGLES)).cast("int")
        rows = members.select(F.xxhash64("comp", F.pmod(F.xxhash64("rep"), blocks)).alias("block"), "rep", "text", F.lit(False).alias("leads"))
        lead = members.join(picked, "rep", "left_semi").select("comp", "rep", "text", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b"))
        rows = rows.union(lead.select(F.xxhash64("comp", F.col("b").cast("long")), "rep", "text", F.lit(True)))
        new = rows.repartition("block").sortWithinPartitions("block", F.desc("leads"), "rep").mapInArrow(compare_leaders(width, percent), "x long, y long")
        links = settle(new if links is None else links.union(new), "links")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, recall: float = RECALL, group_docs: int = GROUP_DOCS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (is that id)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = settle(texts.select("doc_id", describe(F.col("text"), width).alias("d")).select("doc_id", "d.*"), "sets")
    some = sets.where("n_shingles > 0 and doc_id is not null")
    reps = some.groupBy("h0", "h1").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "sig", "s0", "s1")])
    reps = settle(reps, "classes")
    pairs = candidate_pairs(reps, percent, recall, node_limit)
    if pairs.isEmpty():
        roots = pairs.select(F.col("x").alias("id"), F.col("y").alias("root"))
    else:
        comps = settle(component_roots(pairs).select(F.col("id").alias("rep"), F.col("root").alias("comp")), "components")
        sized = comps.join(reps.select("rep", "n_shingles"), "rep").groupBy("comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all"))
        sized = settle(sized.select("comp", "n", F.col("n").alias("docs"), "all", ((F.col("n") > group_docs) | (F.col("all") > GROUP_SHINGLES)).alias("big")), "sizes")
        members = hot_join(comps, sized, "comp", comps.count()).join(texts, F.col("rep") == F.col("doc_id")).select("comp", "rep", "text", F.col("docs").alias("n"), "all", "big")
        fits = members.where(~F.col("big")).select("comp", "rep", "text").repartition("comp").sortWithinPartitions("comp", "rep")
        roots = settle(fits.mapInArrow(confirm_groups(width, percent), "id long, root long").distinct(), "roots")
        if not sized.where("big").isEmpty():
            large = members.where("big").join(reps.select("rep", "sig", F.col("n_shingles").alias("size")), "rep").select("comp", "rep", "text", "sig", "size", "n", "all")
            roots = roots.union(confirm_large(large, width, percent))
    moved = roots.where("id <> root")
    named = reps.join(moved, F.col("rep") == F.col("id"), "left").select(F.struct("h0", "h1").alias("h"), "n", F.coalesce("root", "rep").alias("component"))
    key = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.struct("h0", "h1")).alias("h")
    left = sets.select("doc_id", "n_shingles", key)
    linked_ = hot_join(left.where("h is not null"), named, "h", sets.count())
    out = linked_.drop("h").unionByName(left.where("h is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))
