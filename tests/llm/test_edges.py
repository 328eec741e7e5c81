"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillgauge.llm import bpe, chat, flac, langid, neardup, packing, quality, toxicity, url_filter, warc
from quillgauge.llm.shared import fresh_path

SF = "/root/testdata/sf0.001"
BASE = "doc_id long, text string, lang string, source string"
CLASH = ["score", "kept", "row", "p", "media", "toxic", "fold", "found", "key", "n", "rep", "comp", "root", "h", "number", "lang_pred", "sequence_id", "blocks", "host", "path", "rule", "verdict", "digest", "payload", "first", "seq", "op", "at", "alive"]
LONG = "lorem ipsum dolor " * 60_000
ROWS = [
    (1, "the same words here and there again today", "en", "s"), (2, "the same words here and there again today", "en", "s"), (2, "the same words here and there again today", "en", "s"), (3, None, None, None),
    (None, "no id but words all the same", "en", None), (4, "", "de", "s"), (5, " \t\n\x0b ", "en", "s"), (6, LONG, "en", "s"), (7, "x" * 6_000, None, "t"), (8, "12345 !!", "fr", "t"),
    (9, "ünïcödé 日本語 😀 <|endoftext|> a\x00b", "fr", "t"), (3, "another text of id three", "de", "s"), (10, "one", "de", "s"), (11, "one", "de", "t"),
]


def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, None), (None, 1), (6, 0), (77, 1)], "doc_id long, toxic int")


def words_of(docs):
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


DOCS = {
    "op2": lambda d: toxicity.score(d, toxicity.train(d, labels(d.sparkSession))),
    "op4": lambda d: flac.media_features(flac.media_table(d), fresh_path(d.sparkSession, "pcm")),
    "op5": words_of,
    "op6": lambda d: langid.identify(d, langid.train(d)),
    "op8": lambda d: bpe.encode_digests(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN),
    "op9": quality.quality_rules,
    "op10": neardup.near_duplicates,
}
STAGES = dict(corpus_pipeline.STAGES)


def with_clashes(df):
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in have])


def rows(df):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.asDict().items())) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, BASE).coalesce(1)


@pytest.mark.parametrize("name", DOCS)
def test_documents(spark, docs, name):
    op = DOCS[name]
    got = op(docs)
    plain = rows(got)
    assert rows(op(with_clashes(docs))) == plain
    assert op(docs.where("false")).collect() == []
    if name != "op5":
        assert sum(plain.values()) == len(ROWS)
        same = [tuple((k, str(v)) for k, v in r.asDict().items() if k not in ("doc_id", "component_id", "kept")) for r in got.where("doc_id in (1, 2)").collect()]
        assert len(set(same)) == 1, "equal texts, equal values"


def test_documents_values(docs):
    packed = words_of(docs).collect()
    spans = Counter()
    for r in packed:
        spans[r.doc_id] += r.length
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i in {r[0] for r in ROWS}:
        assert spans[i] == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for j, t, *_ in ROWS if j == i)
    near = Counter((r.doc_id, r.component_id, r.kept) for r in DOCS["op10"](docs).collect())
    assert near[(2, 1, False)] == 2 and near[(1, 1, True)] == 1 and near[(None, None, True)] == 1 and near[(11, 10, False)] == 1 and near[(4, 4, True)] == 1
    told = {r.doc_id: r for r in DOCS["op6"](docs).collect()}
    assert told[4].lang_pred == told[5].lang_pred == told[8].lang_pred == "und"
    media = {r.doc_id: r for r in DOCS["op4"](docs).collect()}
    assert media[4].n_bytes == 0 and media[4].payload_bytes == 192 and media[6].payload_sha256 == hashlib.sha256(flac.payload(LONG)).hexdigest()
    failed = {r.doc_id: r.base_failed for r in DOCS["op9"](docs).collect()}
    assert failed[4] and failed[6] and failed[7]


@pytest.mark.parametrize("name", STAGES)
def test_stages(spark, docs, name):
    stage = STAGES[name]
    odd = with_clashes(docs)
    got = stage(spark, odd, SF)
    if name != "packing":
        assert got.columns == odd.columns
        assert rows(got.select(*docs.columns)) == rows(stage(spark, docs, SF))
    assert stage(spark, docs.where("false"), SF).collect() == []


def test_near_duplicate_stage_keeps_every_different_text(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    table = spark.createDataFrame([(7, a), (7, b), (3, a), (9, b), (9, b), (None, a), (8, ""), (8, "")], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, table, SF).collect())
    assert got == sorted([(3, a), (7, b), (8, ""), (8, "")])


def test_pages_and_conversations(spark):
    big = "<p>" + "word " * 200_000
    pages = [(1, "http://org/x", big), (2, None, None), (2, None, None), (3, "http://a.B.org/y", big), (None, "nothing", big), (4, "https://" + "h" * 20_000 + ".net/p", ""), (5, "http://", "t")]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    judged = url_filter.judge(p)
    assert sum(rows(judged).values()) == len(pages) and rows(url_filter.judge(with_clashes(p.drop("html")))) == rows(judged)
    assert url_filter.judge(p.where("false")).collect() == []

    def archived(d):
        return warc.read_archives(*warc.archive_pages(spark, d))

    got = rows(archived(p))
    assert got == rows(archived(with_clashes(p))) and sum(got.values()) == len(pages) and archived(p.where("false")).collect() == []
    assert Counter(r.record_type for r in archived(p).collect()) == {"response": 5, "revisit": 2}
    c = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "x" * 100_000), (None, 2, "user", "y"), (2, 5, "assistant", ""), (2, 5, "user", "b\\<|")]
    conv = spark.createDataFrame(c, "conv_id long, turn long, role string, text string")
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_conversations(chat.as_events(conv)).collect()}
    assert turns == {1: [("", ""), ("user", "a"), ("user", "a")], None: [("assistant", "x" * 100_000), ("user", "y")], 2: [("assistant", ""), ("user", "b\\<|")]}
    assert rows(chat.digests(chat.format_conversations(chat.as_events(with_clashes(conv))))) == rows(chat.digests(chat.format_conversations(chat.as_events(conv))))
    assert chat.format_conversations(chat.as_events(conv.where("false"))).collect() == []


def test_regenerations_of_a_null_conversation_and_of_many_turns(spark):
    e = [(None, 1, 0, "start", "user", None), (None, 2, 0, "delta", None, "bad"), (None, 3, 0, "regenerate", None, None), (None, 4, 0, "delta", None, "good"), (None, 5, 9, "unknown", None, "z")]
    rng = np.random.default_rng(3)
    seq, messages = 0, {}
    for _ in range(400):
        turn, op = int(rng.integers(0, 12)), str(rng.choice(["start", "delta", "delta", "delta", "edit", "regenerate"]))
        text, seq = f"t{seq} ", seq + 1
        e.append((1, seq, turn, op, f"r{seq}", text))
        if op == "regenerate":
            messages = {t: m for t, m in messages.items() if t < turn}
        elif op != "start":
            messages[turn] = (messages.get(turn, "") if op == "delta" else "") + text
        else:
            messages.setdefault(turn, "")
    got = chat.fold(spark.createDataFrame(e, "conv_id long, seq long, turn long, op string, role string, text string")).collect()
    assert {r.turn: r.text for r in got if r.conv_id == 1} == messages
    assert [(r.turn, r.role, r.text) for r in got if r.conv_id is None] == [(0, "user", "good")]


def test_an_attempt_that_runs_again_neither_loses_nor_doubles_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"payload {i} " * 30) for i in range(50)], "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/w"
    records = warc.with_revisits(pages)
    one = warc.write_archives(records, b"", folder, archive_bytes=2000)
    left = set((tmp_path / "w").iterdir())
    manifest = one.collect()
    again = warc.write_archives(warc.with_revisits(pages.repartition(2)), b"", folder, archive_bytes=3000)
    assert left < set((tmp_path / "w").iterdir()) and {r.path for r in again.collect()}.isdisjoint(r.path for r in manifest)
    assert sorted(r.page_id for r in warc.read_archives(again, folder).collect()) == list(range(50))
