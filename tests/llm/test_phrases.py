"""Phrase mining against plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillgauge.llm import phrases as P


def plain(docs, least, top=2000, longest=4):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    rows = []
    for (lang, p), a in good.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in good.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        rows.append((lang, score, a, " ".join(p), left, right))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))[:top]
        out += [(lang, k + 1, p, a, x, y, n[lang], score) for k, (_, score, a, p, x, y) in enumerate(own)]
    return sorted(out)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "of", "the", "delta", "é", "x" * 40, "#1"]
    docs = []
    for _ in range(n):
        text = "".join(rng.choice([" of the big house", " a-b c", " New York City hall", *(" " + w for w in words)]) + rng.choice(["", "", "", ".", "\n", ", ", "\t"]) for _ in range(40))
        docs.append((rng.choice(["en", "en", None, "de"]), text))
    return [*docs, ("en", None), ("en", ""), ("de", "...;;\n\x0b"), ("fr", "one two")]


@pytest.mark.parametrize("entries", [P.ENTRIES, 200])
def test_counts_and_scores(spark, entries):
    docs = corpus()
    df = spark.createDataFrame([(i, lang, t, 9) for i, (lang, t) in enumerate(docs)], "doc_id long, lang string, text string, word long").repartition(3)
    got = sorted(tuple(r) for r in P.collocations(df, least=12, top=40, entries=entries).collect())
    assert got == plain(docs, 12, 40) and len(got) > 30


def test_empty_and_too_rare(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert P.collocations(none).count() == 0
    assert P.collocations(spark.createDataFrame([("en", "one two three")], "lang string, text string")).count() == 0


def test_trie_bursts_and_counts():
    rng = np.random.default_rng(0)
    trie, want = P.Trie(4, burst=5), Counter()
    for _ in range(30):
        rows = Counter(map(tuple, rng.integers(1, 5, (200, 4)).tolist()))
        want.update(rows)
        keys = sorted(rows)
        packed = [(b << 2 * P.WIDTH) | (c << P.WIDTH) | d for _, b, c, d in keys]
        trie.add(np.array([k[0] for k in keys]), np.array(packed), np.array([rows[k] for k in keys]))
    assert any(isinstance(n, P.Node) for n in trie.root.values()) and trie.entries() == len(want)
    got = Counter()
    for columns, counts in trie.pop(list(trie.root), 100):
        got.update(dict(zip(zip(*(c.tolist() for c in columns), strict=True), counts.tolist(), strict=True)))
    assert got == want


def test_full_bit_table_changes_nothing(spark):
    docs = corpus(2, 40)
    got = P.collocations(spark.createDataFrame(docs, "lang string, text string"), least=8, bits=6)  # every place is taken
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 8)
