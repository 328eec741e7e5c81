"""Hand-made fixtures for single operators."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgauge.functions.session import number_rows
from quillgauge.operators import chunks, gcr, graph, keywords, quality, review, simjoin, stats, vectors
from quillgauge.sources import files


def test_set_joins(spark):
    n = spark.createDataFrame([("doc1", ["steel", "plate", "surface"]), ("doc2", ["steel", "quality", "check"]), ("doc3", ["conveyor", "belt", "speed"])], "id string, e array<string>")
    (r,) = simjoin.set_join(n, "e", 0.1).collect()
    assert (r.i, r.j, r.score) == ("doc1", "doc2", 0.2)


def test_prefix_join_equals_counting(spark):
    n = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: ((F.col("id") * 7 % 11 + k * (F.col("id") % 3 + 1)) % 30).cast("string")).alias("e"))
    a = {(r.i, r.j, round(r.score, 9)) for r in simjoin.set_join(n, "e", 0.5).collect()}
    b = {(r.i, r.j, round(r.score, 9)) for r in simjoin.set_join(n, "e", 0.1).where("score >= 0.5").collect()}
    assert a == b and a


def test_chunks_lose_nothing(spark):
    text = " ".join(f"Sentence {i} has exactly six words." for i in range(6))
    d = spark.createDataFrame([(1, text), (2, " ".join(f"word{i}" for i in range(25))), (3, "")], "doc_id long, text string")
    c = chunks.chunk_documents(d, 10, 12, 3).orderBy("doc_id", "sequence_index").collect()
    assert all(r.token_count <= 12 for r in c)
    assert {w for r in c if r.doc_id == 1 for w in r.text.split()} == set(text.split())
    flat = chunks.chunk_documents(d.where("doc_id = 2"), 10, 12, 0).collect()
    assert len(flat) == 3 and sum(r.token_count for r in flat) == 25


def test_greedy_keep_is_the_sequential_pass(spark):
    edges = [(1, 2), (2, 3), (3, 4), (1, 5), (4, 6)]
    kept = []
    for i in range(1, 8):
        if not any(y == i and x in kept for x, y in edges):
            kept.append(i)
    rows = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    got = quality.greedy_keep(rows, spark.createDataFrame(edges, "x long, y long"))
    assert sorted(r.id for r in got.collect()) == kept


def test_hub_and_components(spark):
    ids = ["hub", "h1", "h2", "h3", *[f"n{i}" for i in range(10)]]
    e = [("h1", "h2"), ("h2", "h3"), ("h1", "h3")] + [("hub", x) for x in ids[1:]]
    nodes = spark.createDataFrame([(i, f"steel {i}") for i in ids], "id string, text string")
    edges = spark.createDataFrame([(*p, "t", 1.0) for p in e], "source string, target string, type string, score double")
    r = spark.createDataFrame([("q", "steel", "", k, i) for k, i in enumerate(["hub", "h1", "h2", "h3", "unknown"])] + [("none", "x", "", 0, "unknown")], "query_id string, question string, expected_answer string, rank int, id string")
    got = {x.query_id: x for x in gcr.gcr(r, nodes, edges).collect()}
    assert got["q"].hub_noise_penalty == 0.25 and got["q"].structural_connectivity == 1.0 and got["q"].n_hubs == 1
    assert got["none"].score == 0.0 and got["none"].retrieved_count == 0
    alone = graph.component_summary(nodes, edges.where("false")).first()
    assert alone.components == 14 and alone.largest == 1


def test_quantile_rules(spark):
    d = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "metric string, item_id int, value double")
    r = stats.kpi_distribution(d).first()
    assert (r["count"], r.average, r.p50, round(r.p95, 9)) == (4, 2.5, 2.5, 3.85)
    lat = spark.createDataFrame([(float(v), "a") for v in (10, 20, 30, 40, 50)], "latency double, k string")
    r = stats.latency_stats(lat, "k").first()
    assert (r.avg, r.p50, r.p90, r.p99) == (30, 30, 50, 50)


def test_verdicts(spark):
    th = spark.createDataFrame([("A", 0.9, 0.8, False), ("B", 0.5, 0.4, False)], "metric string, warning double, critical double, lower_better boolean")
    k = spark.createDataFrame([("r1", "A", 0.95), ("r1", "B", 0.5), ("r2", "A", 0.85), ("r2", "B", 0.6), ("r3", "A", 0.75), ("r3", "B", 0.6)], "run_id string, metric string, value double")
    assert {r.run_id: r.verdict for r in stats.verdict(k, th).collect()} == {"r1": "Ready", "r2": "At Risk", "r3": "Blocked"}


def fold_documents(docs, target, least, most, overlap=0):
    """The reference's balanced aggregation of (doc_id, text): unit numbers and tokens of documents."""
    out, unit, text, tokens, k = [], [], "", 0, 0

    def save():
        out.extend((k, d, tokens) for d in unit)

    for doc_id, content in docs:
        n = len(content.split())
        if text and (tokens > 0 and tokens + n > most or tokens >= least and tokens + n > target):
            save()
            k, unit, text = k + 1, [], text[-overlap * 4 :] if overlap else ""
            tokens = len(text.split())
        text += ("\n\n--- Document ---\n\n" if text else "") + content
        tokens += n
        unit.append(doc_id)
    if tokens >= least:
        save()
    return out


@pytest.mark.parametrize("overlap", [0, 5])
def test_aggregate_documents_is_the_sequential_fold(spark, overlap):
    rng = random.Random(5)
    sizes = {"a": lambda: rng.choice([0, 1, 3, 9, 40, 130]), "b": lambda: rng.randint(0, 2), "few": lambda: 4, "long": lambda: rng.choice([2, 90, 300])}
    docs = [(i, s, " ".join(f"w{rng.randint(0, 9)}" for _ in range(sizes[s]()))) for i in range(400) for s in sizes if s != "few" or i % 90 == 0]
    got = chunks.aggregate_documents(spark.createDataFrame(docs, "doc_id long, source string, text string"), "source", 60, 15, 100, overlap, ids=7).collect()
    want = [(s, *r) for s in sizes for r in fold_documents([(i, t) for i, x, t in docs if x == s], 60, 15, 100, overlap)]
    assert sorted((r.source, r.unit, r.doc_id, r.tokens) for r in got) == sorted(want)
    assert {"few", "long"} <= {r.source for r in got} and any(r.tokens < 15 for r in got)


@pytest.mark.parametrize("t", [0.92, 0.85, 0.7])
def test_fuzzy_dedup_is_the_sequential_pass(spark, t):
    rng = random.Random(4)
    letters = "abcdefgh "
    texts = ["".join(rng.choice(letters) for _ in range(n)).strip() for n in (3, 6, 7, 12, 30, 60, 100, 100, 240)] + ["na" * 40, "what is the highest surface temperature that the steel plate may reach before it is checked"]
    rows = []
    for x in texts:
        rows.append(x)
        for share in (0.02, 0.1, 0.17, 0.3):
            y = list(x)
            for at in sorted(rng.sample(range(len(x)), max(1, int(len(x) * share))), reverse=True):
                y.insert(at, rng.choice("xyz"))
            rows += ["".join(y), x[: len(x) // 2] + x[len(x) // 2 + 1 :]]
    rows = [" ".join(x.split()) for x in rows]
    kept = []
    for i, x in enumerate(rows):
        if not any(x == rows[k] or difflib.SequenceMatcher(None, x, rows[k]).ratio() >= t for k in kept):
            kept.append(i)
    got = quality.fuzzy_dedup(spark.createDataFrame(list(enumerate(rows)), "id long, question string"), t)
    assert sorted(r.id for r in got.collect()) == kept


@pytest.mark.parametrize("t", [0.92, 0.7])
def test_fuzzy_dedup_in_blocks_is_the_same_pass(spark, monkeypatch, t):
    monkeypatch.setattr(quality, "PREFIX_ROWS", -1)
    monkeypatch.setattr(simjoin, "SETS", 16)
    test_fuzzy_dedup_is_the_sequential_pass(spark, t)


def test_hot_tokens_meet_in_slices(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "SLICE", 7)
    rng = random.Random(3)
    sets = [(i, ["hot", *(f"t{rng.randint(0, 40)}" for _ in range(rng.randint(0, 5))), None]) for i in range(90)]
    n = spark.createDataFrame(sets, "id long, e array<string>")
    for t in (0.1, 0.5):
        want = set()
        for i, a in sets:
            for j, b in sets:
                x, y = set(a) - {None}, set(b) - {None}
                c = len(x & y)
                if i < j and c and c / (len(x) + len(y) - c) >= t:
                    want.add((i, j, c))
        assert {(r.i, r.j, r.common) for r in simjoin.set_join(n, "e", t).collect()} == want
    shared = simjoin.set_join(n, "e", 0.5, shared=True).collect()
    assert shared and all("hot" in r.shared and len(r.shared) == r.common for r in shared)


@pytest.mark.parametrize("block", [5, 1000])
def test_cosines_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = random.Random(1)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(4)] if i % 9 else None) for i in range(40)] + [(40, [0.0] * 4)]
    v = spark.createDataFrame(vecs, "id long, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    some = [(i, a) for i, a in vecs if a and any(a)]
    want = {(i, j) for i, a in some for j, b in some if i < j and cos(a, b) >= 0.6}
    assert {(r.i, r.j) for r in simjoin.cosine_join(v, "v", 0.6).collect()} == want
    top = {}
    for r in simjoin.cosine_topk(v.where("id % 5 = 1").withColumnRenamed("id", "qid"), v, 3).orderBy("qid", "rank").collect():
        top.setdefault(r.qid, []).append(r.id)
    assert top == {i: [j for _, j in sorted((-cos(a, b), j) for j, b in some)][:3] for i, a in some if i % 5 == 1}


def test_cells_out_of_reach_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    data = np.repeat(centres, 60, axis=0) + rng.normal(size=(720, 16)) * 0.05
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "id long, v array<double>")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    cos = unit @ unit.T
    want = {(i, j) for i, j in zip(*np.nonzero(cos >= 0.9), strict=True) if i < j}
    assert {(r.i, r.j) for r in simjoin.cosine_join(v, "v", 0.9).collect()} == want
    cells = vectors.cells_of(vectors.units(v, "id", "v"))
    told = vectors.pruning(cells, 0.9).first()
    assert told.blocks >= 12 and told.met < told.pairs / 3 and told.copies < 720 * told.blocks / 10
    assert vectors.pruning(cells, -1.0).first().met == told.pairs  # nothing to skip
    top = simjoin.cosine_topk(v.where("id % 90 = 7").withColumnRenamed("id", "qid"), v, 5).collect()
    for q in {r.qid for r in top}:
        assert [r.id for r in sorted((r for r in top if r.qid == q), key=lambda r: r.rank)] == sorted(range(720), key=lambda j: (-cos[q, j], j))[:5]


@pytest.mark.parametrize("nearest", [False, True])
def test_quantiles_are_exact(spark, nearest):
    rng = random.Random(2)
    groups = {"a": [rng.random() for _ in range(101)], "b": [1.5] * 4, None: [rng.choice([1.0, 2.0, 900.0]) for _ in range(30)], "c": [7.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("empty", None)]
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in stats.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", F.col("v"), wanted, "nearest" if nearest else "linear").collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        s = sorted(vs)
        for name, q in wanted.items():
            at = max(-(-len(s) * q // 1), 1) - 1 if nearest else (len(s) - 1) * q
            lo, hi = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
            assert got[g][name] == pytest.approx(lo + (hi - lo) * (at - int(at)))


def test_quantiles_beside_extreme_outliers(spark):
    values = [1 + i / 10_000 for i in range(5000)] + [1e300, -1e300, 5e-324]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double").repartition(4)
    s = sorted(values)
    got = stats.quantiles(df, "g", F.col("v"), {"p50": 0.5, "p0": 0.0, "p100": 1.0}, "floor").first()
    assert (got.p0, got.p50, got.p100) == (s[0], s[(len(s) - 1) // 2], s[-1])


@pytest.mark.parametrize("most", [200_000, 40])
def test_greedy_keep_over_long_chains(spark, monkeypatch, most):
    """Paths of linked rows, and one of stars that hold many edges: in one task, or taken down in rounds."""
    monkeypatch.setattr(quality, "COMPONENT_EDGES", most)
    n = 10_000 if most > 1000 else 60
    edges = [(i, i + 1) for i in range(n)] + [(20_000 + i, 20_000 + j) for i in range(6) for j in range(i + 1, 30)]
    rows = spark.createDataFrame([(i,) for i in {v for e in edges for v in e}], "id long")
    kept = {r.id for r in quality.greedy_keep(rows, spark.createDataFrame(edges, "x long, y long")).collect()}
    gone = set()
    for x, y in sorted(edges):
        if x not in gone:
            gone.add(y)
    assert kept == {v for e in edges for v in e} - gone


@pytest.mark.parametrize(("renewals", "width"), [(800, 8000), (3, 17)])
def test_expanding_quartiles_in_blocks(spark, renewals, width):
    rng = random.Random(5)
    keys = {"long": 900, "short": 7, None: 65, "none": 25}
    rows = [(k, i, None if k == "none" or rng.random() < 0.1 else rng.choice([0.5, round(rng.random(), 3), i / 900])) for k, n in keys.items() for i in range(n)]
    got = {(r.key, r.seq): (r.lo, r.hi, r.in_range) for r in review.dynamic_gate(spark.createDataFrame(rows, "key string, seq long, score double").repartition(3), 10, renewals, width).collect()}
    assert len(got) == len(rows)
    for key in keys:
        seen, lo, hi = [], None, None
        for k, i, score in rows:
            if k != key:
                continue
            seen += [] if score is None else [score]
            if (i + 1) % 10 == 0 and seen:
                lo, hi = (float(np.quantile(seen, q)) for q in (0.25, 0.75))
            told = got[key, i]
            assert (told[0] is None) == (lo is None) and (lo is None or (told[0], told[1]) == pytest.approx((lo, hi), abs=1e-8))
            assert told[2] == (lo is not None and score is not None and told[0] <= score <= told[1])


def test_rows_are_numbered_over_ranges(spark):
    d = spark.range(5000).repartition(6).select((F.col("id") * 7919 % 5003).alias("k"))
    got = [(r.k, r.number) for r in number_rows(d, "k").collect()]
    assert sorted(got) == [(k, i) for i, k in enumerate(sorted(r.k for r in d.collect()))]


def test_list_literals(spark):
    texts = ["['a', 'b']", '["it\'s", "x, y"]', r"['it\'s', 'a\\b']", "[1, 2.5, None]", "[]", "no list", None, "['two\nlines']"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(files.list_literal(F.col("t")).alias("l"))
    assert [r.l for r in d.collect()] == [["a", "b"], ["it's", "x, y"], ["it's", "a\\b"], ["1", "2.5", "None"], [], [], [], ["two\nlines"]]


def test_top_tokens_are_counted_where_their_row_lies(spark):
    texts = [(1, "beta alpha beta gamma alpha delta"), (2, None), (3, ""), (4, "x " * 5000 + "one two two")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    words = F.split("text", " ")
    top = keywords.top_tokens(d, words, 3)
    got = {(r.doc_id, r["rank"]): (r.token, r.n, r["first"]) for r in top.where("token <> ''").collect()}
    assert got == {(1, 1): ("beta", 2, 0), (1, 2): ("alpha", 2, 1), (1, 3): ("gamma", 1, 3), (4, 1): ("x", 5000, 0), (4, 2): ("two", 2, 5001), (4, 3): ("one", 1, 5000)}
    assert "Exchange" not in top._jdf.queryExecution().executedPlan().toString()
    twice = keywords.top_tokens(d.union(spark.createDataFrame([(1, "gamma gamma")], d.schema)), words, 1).where("doc_id = 1").collect()
    assert [(r.token, r.n) for r in twice] == [("gamma", 3)]


@pytest.mark.parametrize("sets", [7, 4096])
def test_block_join_counts_every_pair_where_it_lies(spark, monkeypatch, sets):
    monkeypatch.setattr(simjoin, "SETS", sets)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    bags = {f"n{i}": set(rng.sample(words[: 1 + i % 40], min(1 + i % 9, 1 + i % 40))) for i in range(60)} | {"none": set()}
    n = spark.createDataFrame([(i, sorted(b)) for i, b in bags.items()], "id string, e array<string>")
    score = {"jaccard": lambda a, b: len(a & b) / len(a | b), "overlap": lambda a, b: len(a & b) / min(len(a), len(b)), "max": lambda a, b: len(a & b) / max(len(a), len(b))}
    for measure, f in score.items():
        want = {(i, j, len(bags[i] & bags[j]), round(f(bags[i], bags[j]), 9)) for i in bags for j in bags if i < j and bags[i] & bags[j] and f(bags[i], bags[j]) >= 0.2}
        out = simjoin.set_join(n, "e", 0.2, measure)
        assert {(r.i, r.j, r.common, round(r.score, 9)) for r in out.collect()} == want and want
        assert "hashpartitioning(i" not in out._jdf.queryExecution().executedPlan().toString()  # pairs are not shuffled
    shared = simjoin.set_join(n, "e", 0.2, "overlap", strict=True, shared=True).collect()
    assert all(r.shared == sorted(bags[r.i] & bags[r.j]) and r.score > 0.2 for r in shared) and shared
    few = n.where("id < 'n2'")
    best = simjoin.lexical_search(few.withColumnRenamed("e", "tokens"), n.withColumnRenamed("e", "tokens"), 3, 0.05).collect()
    for q in (r.id for r in few.collect()):
        ranked = sorted((-score["jaccard"](bags[q], b), i) for i, b in bags.items() if bags[q] & b)
        assert [r.id for r in sorted(best, key=lambda r: r["rank"]) if r.qid == q] == [i for s, i in ranked if s <= -0.05][:3]
    monkeypatch.setattr(simjoin, "PREFIX_ROWS", -1)
    want = {(i, j) for i in bags for j in bags if i < j and bags[i] & bags[j] and score["jaccard"](bags[i], bags[j]) >= 0.6}
    assert {(r.i, r.j) for r in simjoin.set_join(n, "e", 0.6).collect()} == want and want


def test_blocks_of_vectors_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 2)
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(400)], "id long, v array<double>")
    cells = vectors.cells_of(vectors.units(v, "id", "v"))
    assert cells.parts.sum() < 32 + 64 and cells.size.sum() == 400
