"""Held-out accuracy of the models, and the pipeline against plain versions of its stages."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillgauge.llm import langid, neardup, toxicity, url_filter
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def quality_of(rows):
    """Precision and recall of rows (truth, told)."""
    hit = sum(t and p for t, p in rows)
    return hit / max(sum(p for _, p in rows), 1), hit / max(sum(t for t, _ in rows), 1)


def test_toxicity_held_out(spark):
    """All languages, a quarter of the labels held out; the chain holds no category that speaks against a later one."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = langid.held_out(F.col("doc_id"))
    chain = toxicity.train(docs, labels.where(~held))
    assert all(w >= 0 for row in chain.earlier for w in row) and max(chain.earlier[-1]) > 0.5
    truth = labels.where(held & F.col("toxic").isNotNull()).join(docs.select("doc_id", "lang"), "doc_id")
    told = toxicity.score(docs, chain).select("doc_id", "is_toxic").join(truth, "doc_id").collect()
    precision, recall = quality_of([(r.toxic > 0, r.is_toxic) for r in told])
    print(precision, recall, {x: quality_of([(r.toxic > 0, r.is_toxic) for r in told if r.lang == x]) for x in ("en", "de", "fr", "es")})
    assert len(told) > 900 and precision >= 0.9 and recall >= 0.8


def test_categories_of_a_fold_do_not_see_its_labels():
    """Labels of a fold turned around change nothing in what is found without it."""
    rng = np.random.default_rng(2)
    toxic = np.arange(400) % 4 == 0
    found = [np.sort(np.concatenate([rng.choice(np.arange(2, 30), 5, replace=False), [i // 4 % 2] if t else []])).astype(np.int64) for i, t in enumerate(toxic)]
    bags, fold = toxicity.Bags(found, 30), np.arange(400) % 5
    one = toxicity.weak_categories(bags, toxic.astype(float), 2, fold != 1)
    other = toxicity.weak_categories(bags, np.where(fold == 1, ~toxic, toxic).astype(float), 2, fold != 1)
    assert all((a == b).all() for a, b in zip(one, other, strict=True)) and one[0].sum() > 20
    swapped = toxicity.matched(one[::-1], one)
    assert all((a == b).all() for a, b in zip(swapped, one, strict=True))


def test_toxicity_learns_inflected_words_it_has_not_met(spark):
    """Two languages of invented words: the toxic ones share stems, and hardly a toxic word is seen twice."""
    rng = np.random.default_rng(8)
    letters = "abdeghiklmnoprstu"
    word = lambda n: "".join(rng.choice(list(letters), n))
    rows, truth = [], []
    for i in range(1600):
        words = [word(int(rng.integers(3, 9))) for _ in range(30)] + [str(w) for w in rng.choice([f"common{k}" for k in range(40)], 8)]
        toxic = i % 8 == 0
        if toxic:
            words += [("vrakolt" if i % 16 else "zimpuz") + word(3) for _ in range(3)]
        rows.append((i, " ".join(words)))
        truth.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(truth, "doc_id long, toxic int")
    chain = toxicity.train(d, lab.where("doc_id < 1200"))
    got = {r.doc_id: r for r in toxicity.score(d.where("doc_id >= 1200"), chain).collect()}
    precision, recall = quality_of([(t > 0, got[i].is_toxic) for i, t in truth if i >= 1200])
    assert precision >= 0.95 and recall >= 0.9
    first = [got[i].category_1 for i, t in truth if i >= 1200 and t and i % 16]
    second = [got[i].category_2 for i, t in truth if i >= 1200 and t and i % 16 == 0]
    assert (np.mean(first) > 0.5 and np.mean(second) > 0.5) or (np.mean([got[i].category_2 for i, t in truth if i >= 1200 and t and i % 16]) > 0.5)
    assert all(len(w) == k for k, w in enumerate(chain.earlier))


def plain_profile(text, size):
    grams = Counter()
    t = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            g = t[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " ") and g != "  ":
                grams[g] += 1
    return grams


def test_language_held_out_and_out_of_place(spark, docs):
    profiles = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    told = langid.identify(docs, profiles).join(docs.where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang", "text"), "doc_id").collect()
    right = sum(r.lang_pred == r.lang for r in told)
    assert len(told) > 200 and right >= 0.98 * len(told)
    grams = {langid.unpack(int(k)): i for i, k in enumerate(profiles.keys)}
    for r in told[:40]:
        keys, counts = langid.ngrams(r.text)
        ranked = [langid.unpack(int(k)) for k in langid.ranked(keys, counts, profiles.size)]
        assert ranked == [g for g, _ in sorted(zip(map(langid.unpack, map(int, keys)), counts, strict=True), key=lambda x: (-x[1], [ord(c) for c in x[0].rjust(3, "\0")]))][: profiles.size]
        far = []
        for j in range(len(profiles.langs)):
            place = [int(profiles.place[grams[g], j]) if g in grams else -1 for g in ranked]
            far.append(sum(profiles.size if p < 0 else abs(p - i) for i, p in enumerate(place)))
        assert r.lang_pred == profiles.langs[int(np.argmin(far))] and r.score == pytest.approx(1 - min(far) / (profiles.size * len(ranked)))


def test_url_model_on_words_it_has_not_seen(spark):
    """Held out by word: no word of a fold is in another one.  Hosts of unseen words are told by their paths, and neutral hosts let through."""
    table = url_filter.labelled_urls(spark)
    words = {(r.fold, w) for r in table.select("fold", "host").distinct().collect() for w in (url_filter.UNWANTED + url_filter.ORDINARY) if r.host.split(".")[-2 if ".co." not in r.host else -3] == w}
    assert len({w for _, w in words}) == len(words) > 100
    models, data = url_filter.fit(table)
    rows = [(r.y > 0, r.margin > 0) for r in url_filter.unseen_margins(models, data).collect()]
    precision, recall = quality_of(rows)
    assert len(rows) > 600 and precision >= 0.85 and recall >= 0.8
    model = url_filter.train(table)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    told = url_filter.judge(pages, rules={}, model=model).select("host", "verdict").collect()
    unwanted = lambda host: any(w in host for w in (*url_filter.UNWANTED, "pills", "track", "casino"))
    neutral = [r.verdict for r in told if not unwanted(r.host)]
    blocked = [r.host for r in told if r.verdict == url_filter.BLOCK]
    assert len(neutral) > 100 and neutral.count(url_filter.BLOCK) <= 0.02 * len(neutral)
    assert blocked and sum(map(unwanted, blocked)) > 0.5 * len(blocked)  # they are few


def test_near_duplicate_links_are_found(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for width in (2, 5):
        want, sizes = brute_components(rows, width, 80)
        got = {r.doc_id: r for r in neardup.near_duplicates(docs, width=width).collect()}
        linked = [i for i, c in want.items() if i != c]
        assert len(linked) > 50 and sum(got[i].component_id == want[i] for i in linked) >= 0.99 * len(linked)
        assert all(got[i].component_id >= want[i] and got[i].n_shingles == sizes[i] for i in want)


def test_pipeline_is_its_stages_in_plain(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = table.collect()
    model = toxicity.train(table, spark.read.parquet(f"{sf}/labels.parquet")).indexed()
    rows = [r for r in rows if model.predict(r.text)[-1] < toxicity.THRESHOLD]
    kept = spark.createDataFrame(rows, table.schema)
    profiles = langid.train(kept.where(~langid.held_out(F.col("doc_id"))))
    told = [(r, *profiles.nearest(r.text)) for r in rows]
    medians = {}
    for lang in profiles.langs:
        own = sorted(s for r, p, s in told if p == lang == r.lang)
        medians[lang] = own[(len(own) + 1) // 2 - 1] if own else 0.0
    rows = [r for r, p, s in told if p != langid.UNKNOWN and s >= 0.5 * medians.get(p, 0.0)]
    groups, _ = brute_components([(r.doc_id, r.text) for r in rows], 5, 80)
    want = {r.doc_id: r.text for r in rows if groups[r.doc_id] == r.doc_id}
    got = corpus_pipeline.run(spark, sf).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    assert spans.keys() == want.keys()
    for i, t in want.items():
        assert sorted(spans[i]) == list(range(len(lib.encode(t, add_special_tokens=False).ids) + 1))
