"""Queries that SQL cannot express, or not on whole tables, against plain versions on the smallest tables."""

import difflib
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgauge.operators import graph, metrics, quality
from quillgauge.operators import testsets as samples
from quillgauge.plans import inputs, registry
from quillgauge.streaming import events

SF = "/root/testdata/sf0.001"
registry.load()


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in registry.table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def pairs(spark, texts):
    """Every pair of documents whose top thirty entities have a Jaccard of 0.1 or more."""
    sets = {}
    for i, t in texts.items():
        found = re.findall("[一-鿿]{2,}|[A-Za-z]{3,}", t or "")
        top = sorted(Counter(found).items(), key=lambda x: (-x[1], found.index(x[0])))[:30]
        sets[i] = {w for w, _ in top}
    out = {}
    for i in sets:
        for j in sets:
            if i < j and (c := len(sets[i] & sets[j])) and c / len(sets[i] | sets[j]) >= 0.1:
                out[i, j] = c
    return sets, out


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return {i: find(i) for i in root}


def test_all_entities_are_joined(spark, pairs):
    assert {(r.i, r.j): r.common for r in run(spark, "e1_jaccard_join")} == pairs[1]


def test_components_of_all_edges(spark, pairs):
    assert {r.id: r.component for r in run(spark, "g11_components")} == components(pairs[0], pairs[1])


def test_components_of_a_large_star(spark):
    edges = [(9000, i) for i in range(3000)] + [(i, i + 1) for i in range(9001, 9060)] + [(2999, 9001)]
    d = spark.createDataFrame(edges, "x long, y long")
    got = {r.id: r.root for r in graph.component_roots(d).collect()}
    assert got == components({i for e in edges for i in e}, edges)


def test_chunks(spark, texts):
    def chunk(text):
        buf, fresh, out = [], False, []
        for s in re.findall(r"[^\n.?!。？！；]*[.?!。？！；][\"'”’」』）)\]]*|[^\n.?!。？！；]+", text or ""):
            w = s.split()
            for seg in (w[k : k + 800] for k in range(0, len(w), 800)):
                if len(buf) + len(seg) > 800:
                    out += [buf] if fresh else []
                    keep = max(0, min(50, 800 - len(seg)))
                    buf = buf[len(buf) - keep :] if keep < len(buf) else buf
                buf = buf + seg
                if fresh := len(buf) < 512:
                    continue
                out.append(buf)
                buf = buf[-50:]
        return out + ([buf] if fresh else [])

    want = {(i, k, len(c), " ".join(c)) for i, t in texts.items() for k, c in enumerate(chunk(t))}
    assert {(r.doc_id, r.sequence_index, r.token_count, r.text) for r in run(spark, "c4_chunk_documents")} == want


def test_windows_at_breaks_and_passages(spark, texts):
    got = defaultdict(list)
    for r in sorted(run(spark, "c6_chunk_chars_at_breaks"), key=lambda r: r.pos):
        got[r.doc_id].append(r.chunk)
    for i, t in texts.items():
        at, want = 0, []
        while at < len(t or ""):
            end = min(len(t), at + 1000)
            if end < len(t) and (m := [k for k in range(max(at + 1, end - 50), end) if t[k] in ".!?\n"]):
                end = m[-1] + 1
            want += [t[at:end]] if end - at >= 100 else []
            at = end if end == len(t) else max(end - 200, at + 1)
        assert got[i] == want
    packed = defaultdict(list)
    for r in sorted(run(spark, "c7_pack_passages"), key=lambda r: r.pos):
        packed[r.doc_id].append(r.passage)
    for i, t in texts.items():
        out, buf = [], ""
        for s in (x.strip(" ") for x in re.split(r"(?<=[。！？.!?])\s*", t or "")):
            if s:
                buf = f"{buf} {s}" if buf else s
                if len(buf) >= 500:
                    out, buf = [*out, buf], ""
        assert packed[i] == [p for p in [*out, buf] if len(p) >= 60]


def test_phrase_candidates(spark, texts):
    got = defaultdict(list)
    for r in sorted(run(spark, "d4_phrase_candidates"), key=lambda r: r.pos):
        got[r.doc_id].append(r.phrase)
    for i, t in texts.items():
        want = []
        for s in [x for x in re.split(r"(?<=[。！？.!?])\s*", t or "") if x.strip(" ")][:5]:
            w = re.findall("[A-Za-z]+", s)
            want += [p for p in (" ".join(w[k : k + 3]) for k in range(len(w) - 2)) if 6 <= len(p) <= 59] + re.findall("[一-鿿]{2,6}", s)
        assert got[i] == list(dict.fromkeys(want))[:10]


def test_semantic_keyword_dedup(spark):
    n = registry.table(spark, SF, "embeddings").count()
    vec = {r.vec_id: np.array(r.embedding, float) for r in registry.table(spark, SF, "embeddings").collect()}
    rows = inputs.kw(spark, SF).withColumn("v", F.pmod(F.xxhash64("keyword"), F.lit(n))).collect()
    by, want = defaultdict(list), []
    for r in rows:
        if r.v in vec:
            by[r.sample_id].append(r)
    for sample, group in by.items():
        kept = []
        for r in sorted(group, key=lambda r: (-r.score, -len(r.keyword), r.keyword)):
            cos = lambda a, b: a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
            if not any(cos(vec[k.v], vec[r.v]) >= 0.3 for k in kept):
                kept.append(r)
        want += [(sample, r.keyword) for r in kept]
    assert sorted((r.sample_id, r.keyword) for r in run(spark, "d13_dedup_semantic")) == sorted(want)


def test_near_duplicate_samples(spark, texts):
    kept = {}
    for i in sorted(texts):
        w = re.findall(r"\w+", (texts[i] or "").lower())
        s = {" ".join(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {" ".join(w)}
        if not any(len(s & o) >= 0.82 * len(s | o) for o in kept.values()):
            kept[i] = s
    assert sorted(r.id for r in run(spark, "f3_near_dedup")) == sorted(kept)


def test_sampled_subgraph(spark, pairs):
    near = defaultdict(set)
    for i, j in pairs[1]:
        near[i].add(j)
        near[j].add(i)
    depth, todo = {0: 0}, [0]
    for i in todo:
        for j in near[i] - depth.keys():
            depth[j] = depth[i] + 1
            todo.append(j)
    assert {r.id: r.depth for r in run(spark, "g10_sample_subgraph")} == depth
    nodes = spark.createDataFrame([(i,) for i in pairs[0]], "id long")
    edges = spark.createDataFrame(list(pairs[1]), "source long, target long")
    seen, _, cut = graph.sample_subgraph(nodes, edges, nodes.where("id = 0"), 20)
    got = {r.id: r.depth for r in seen.collect()}
    assert len(got) == min(20, len(depth)) and cut == (len(depth) > 20)
    assert all(depth[i] == d for i, d in got.items()) and max(got.values()) <= min((d for i, d in depth.items() if i not in got), default=99)


def test_fuzzy_keyword_match(spark):
    rows = [
        (1, ["steel plate", "rust", "温度计", "colour"], "The steal plates rusted; 温度 is high. Color!"), (2, [], "x"), (3, ["a b", "??"], None), (4, ["Heat Treatment"], "heattreatment"),
        (5, ["automobile", "von neumann"], "A car of Neuman"),
    ]
    syn = {"automobile": ["car"]}
    items = spark.createDataFrame(rows, "item_id long, keywords array<string>, text string")
    table = spark.createDataFrame([("automobile", "car")], "keyword string, synonym string")
    got = {r.item_id: r for r in metrics.keyword_match(items, table, fuzzy=True).collect()}
    for i, keywords, text in rows:
        t, scores = (text or "").lower(), []
        words = list(dict.fromkeys(re.findall(r"\w+", t)))
        for k in (x.strip().lower() for x in keywords):
            forms = list(dict.fromkeys([k, k.replace(" ", ""), *syn.get(k, [])]))
            if text is not None and any(f in t for f in forms):
                scores.append(1.0)
                continue
            best = 0.0
            for f in forms:
                if re.search("[一-鿿]", f):
                    best = max(best, sum(c in t for c in f) / len(f))
                else:
                    own = re.findall(r"\w+", f)
                    best = max(best, sum(w in words for w in own) / max(len(own), 1), *(difflib.SequenceMatcher(None, f, w).ratio() for w in (words if own and words else [t])))
            scores.append(best * 0.75)
        assert got[i].total == len(keywords) and got[i].matched == sum(s >= 0.5 for s in scores)
        assert got[i].score == pytest.approx(sum(scores) / len(scores) if scores else 1.0)


def test_proposed_patch(spark, texts):
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    digest = lambda t: hashlib.sha256(re.sub(r"^\s+|\s+$", "", t).encode()).hexdigest()[:32]
    stored = {digest(t) for i, t in texts.items() if i % 2 == 0}
    sets, want = {i: words(t) for i, t in texts.items()}, set()
    for q in registry.table(spark, SF, "benchmark").collect():
        a = words(q.text)
        score = {i: len(a & s) / len(a | s) for i, s in sets.items() if a & s}
        best = sorted(((-s, i) for i, s in score.items() if s >= 0.05))[:2]
        want |= {(q.item_id, i) for _, i in best if digest(texts[i]) not in stored}
    assert {(r.qid, r.pid) for r in run(spark, "m15_propose_patch")} == want


def test_patch_gain(spark, pairs):
    tok = lambda s: set(re.findall("[a-z0-9_一-鿿]+", s.lower()))
    edges = [(i, j) for (i, j), c in pairs[1].items() if c / len(pairs[0][i] | pairs[0][j]) >= 0.2]
    patch = {i: tok(" ".join(s)) for i, s in pairs[0].items() if i % 200 == 7 and s}
    near = defaultdict(set)
    for i, j in edges:
        near[i].add(j)
        near[j].add(i)
    old = {r.query_id: r.connectivity for r in run(spark, "h4_structural_connectivity") if r.connectivity < 0.5}
    q = {r.item_id: tok(r.question) for r in inputs.items(spark, SF).collect() if r.item_id in old}
    got = {r.query_id: r for r in run(spark, "m16_verify_patch")}
    assert got.keys() == old.keys() and patch
    for i, tokens in q.items():
        seeds = {p for p, t in patch.items() if t & tokens} or set(patch)
        some = seeds | {n for p in seeds for n in near[p]}
        size = Counter(components(some, [e for e in edges if e[0] in some and e[1] in some]).values())
        new = max(size.values()) / len(some)
        assert got[i].new == pytest.approx(new) and got[i].gain == pytest.approx(max(0.0, new - old[i]))


def test_drafts_and_generated_testset(spark, texts):
    rows = run(spark, "n1_make_drafts")
    per = max(1, 2000 // len(texts))
    assert len(rows) <= 2000 and max(Counter(r.id for r in rows).values()) <= per
    assert len(rows) == min(2000, per * sum(bool((t or "").strip()) for t in texts.values())) and len({r.draft_id for r in rows}) == len(rows)
    for r in rows:
        assert r.answer == (texts[r.id][:320] + "…" if len(texts[r.id]) > 320 else texts[r.id])
        assert any(s in r.question for s in re.split(r"(?<=[。！？.!?])\s*", texts[r.id]))
    chunks = spark.createDataFrame(sorted(texts.items()), "id long, text string")
    kept, stats = samples.generate_testset(chunks, 100, 7)
    s, ids = stats.first(), [r.draft_id for r in kept.select("draft_id").collect()]
    assert s.generated == 100 and s.kept == len(ids) == len(set(ids)) <= s.long_enough <= 100


def ingest(rows, taken=()):
    docs, sums, kept = {t[0] for t in taken}, {t[1] for t in taken}, []
    for a, (doc, checksum) in enumerate(rows):
        if (doc is None or doc not in docs) and (checksum is None or checksum not in sums):
            kept.append(a)
            docs.add(doc)
            sums.add(checksum)
    return kept


def test_ingest_is_the_sequential_pass(spark):
    rng = np.random.default_rng(2)
    cases = [[("k1", "c1"), ("k2", "c1"), ("k2", "c2")], [(None, "c"), (None, "d"), ("k", None), ("l", None)]]
    cases += [[(f"k{a}", f"c{b}") for a, b in rng.integers(0, 12, (60, 2))] for _ in range(3)]
    schema = "km_id string, version int, checksum string, arrival int"
    for rows in cases:
        new = spark.createDataFrame([(k, 1, c, a) for a, (k, c) in enumerate(rows)], schema)
        old = spark.createDataFrame([("k3", 1, "c9", -1)], schema)
        got = quality.dedup_ingest(new, old)
        assert sorted(r.arrival for r in got.collect()) == ingest(rows, [("k3", "c9")])


def test_gaps_stay_open_until_they_are_filled():
    rng = np.random.default_rng(7)
    for _ in range(200):
        numbers, low, high, gaps, seen, told = rng.permutation(rng.integers(0, 40, 25)), None, None, [], set(), Counter()
        for part in np.array_split(numbers, int(rng.integers(1, 6))):
            some = np.unique(part)
            if not len(some):
                continue
            low, high = (int(some[0]), int(some[0])) if low is None else (low, high)
            low, high, gaps, out = events.follow_gaps(low, high, gaps, some)
            for a, b, kind in out:
                told.update({x: 1 if kind == "gap" else -1 for x in range(a, b + 1)})
            seen |= set(some.tolist())
            missing = set(range(min(seen), max(seen) + 1)) - seen
            assert {x for a, b in gaps for x in range(a, b + 1)} == missing == {x for x, n in told.items() if n}


@pytest.mark.parametrize("pairs", [1 << 18, 7])
def test_best_likeness_bounds_leave_no_better_word_out(monkeypatch, pairs):
    monkeypatch.setattr(metrics, "PAIRS", pairs)
    draw = random.Random(5)
    word = lambda most: "".join(draw.choice("abcdeé ") for _ in range(draw.randint(1, most)))
    rows = [([word(12) for _ in range(draw.randint(0, 3))], [word(9).replace(" ", "") or "x" for _ in range(draw.randint(0, 40))], word(30), draw.choice([0.0, 0.5])) for _ in range(150)]
    rows += [(["?!", "温 度", "a" * 70], ["b" * 80 + "a" * 60, "温"], "a?!", 0.0), (["a" * 64], ["a" * 64, "b" * 63 + "a"], "", 0.25)]
    likeness = lambda f, w: difflib.SequenceMatcher(None, f, w).ratio()
    calls = []
    monkeypatch.setattr(metrics, "ratio_of", lambda f, w: calls.append(1) or likeness(f, w))
    lists = lambda k: pa.array([r[k] for r in rows], pa.list_(pa.string()))
    got = metrics.best_likeness(lists(0), lists(1), pa.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
    for (forms, words, text, least), best in zip(rows, got, strict=True):
        told = [f for f in forms if not re.search("[一-鿿]", f)]
        assert best == max([least] + [likeness(f, w) for f in told for w in (words if words and re.search(r"\w", f) else [text])])
    assert len(calls) < sum(len(r[0]) * len(r[1]) for r in rows) / 3
