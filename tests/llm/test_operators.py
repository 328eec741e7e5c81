"""The operators against plain versions, exact round trips and held-out accuracy, with nulls, ties and empty tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quillgauge.llm import bpe, chat, flac, langid, neardup, packing, quality, toxicity, url_filter, warc

ODD = ["", " ", "one", "a b", "  a  b\n c ", "<|endoftext|> a<|endoftext|>", "don't 've \t x", "é é 日本語 😀", "x" * 3000, "word " * 400, "A b\r\nc\x0bd\x85 e"]
DOC = "doc_id long, text string, lang string, source string, score double, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = list(rng.choice(words, 80))
        rows.append((i, " ".join(base), "en" if i % 2 else "fr", "s0"))
        if i % 5 == 0:
            base[int(rng.integers(80))] = "changed"
            rows.append((100 + i, " ".join(base), "en", "s1"))
            rows.append((200 + i, " ".join(base), None, None))
    rows += [(300 + i, t, "en", "s0") for i, t in enumerate(ODD)] + [(None, "no id here", "en", "s0"), (400, None, None, None), (400, None, None, None), (1, rows[3][1], "en", "s0")]
    return spark.createDataFrame([(*r, 0.5, "clash") for r in rows], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()
        sets[i] = s
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            c = len(sets[i] & sets[j])
            if i < j and c and 100 * c >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("limits", [{}, {"node_limit": 4, "group_docs": 2}])
def test_near_duplicates(spark, docs, none, limits):
    got = neardup.near_duplicates(docs, width=2, **limits).collect()
    assert len(got) == docs.count()
    want, sizes = brute_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], 2, 80)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], r.doc_id == want[r.doc_id])
    assert neardup.near_duplicates(none).collect() == []


def test_bpe_matches_the_library(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    out = {r.doc_id: r for r in bpe.encode_digests(docs, path, public_tokenizers.PATTERN).collect()}
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert out[r.doc_id].n_tokens == len(ids)
        assert out[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[r.doc_id].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(none, path, public_tokenizers.PATTERN).collect() == []


def test_packing_places_every_token_once(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=256).collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = {}
    for r in rows:
        ids = np.array([*lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        spans.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    copies = {d: docs.where(F.col("doc_id").eqNullSafe(d)).count() for d in (1, 400, 5)}
    for d, n in copies.items():
        assert len(spans[d]) == n * len(set(spans[d]))
    assert packing.pack_documents(none, path).collect() == []


def test_language_profiles(spark, none):
    en, de = "the thing that they think with there other then this", "und nicht auch sich eine werden können über schon durch"
    rows = [(i, " ".join(np.random.default_rng(i).permutation((en if i % 2 else de).split())), "en" if i % 2 else "de") for i in range(80)]
    d = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", None), (902, "", "de")], "doc_id long, text string, lang string")
    p = langid.train(d.where(~langid.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in langid.identify(d, p).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.identify(d, empty).collect()} == {"und"}


def test_toxicity_chain(spark, none):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(200):
        words = [f"w{k}" for k in rng.integers(0, 50, 30)]
        if i % 4 == 0:
            words[5] = ["idiot", "scum", "trash", "moron"][i // 4 % 4]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    d = spark.createDataFrame([*rows, (999, None)], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    chain = toxicity.train(d, lab)
    got = {r.doc_id: r for r in toxicity.score(d, chain).collect()}
    assert all(got[i].is_toxic == bool(t) for i, t in labels) and not got[999].is_toxic
    assert {"idiot", "scum", "trash", "moron"} <= set(chain.features)
    assert chain.categories[-1] == toxicity.FINAL and all(len(w) == k for k, w in enumerate(chain.earlier))
    nothing = toxicity.train(d, lab.where("false"))
    assert not any(r.is_toxic for r in toxicity.score(d, nothing).collect())


def brute_quality(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {p for i, x in enumerate(win) if win.count(x) > 1 for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_counts_and_verdicts(spark, docs, none):
    for t in [*ODD, "a\na\n\n \n a\nb", "# * | <x>", "a b c d e f g h i " * 3, None]:
        assert quality.count_text(t) == brute_quality(t)
    got = quality.quality_rules(docs).collect()
    assert len(got) == docs.count() and all(not (r.base_failed and r.kept) for r in got)
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 60)
    assert quality.quality_rules(none).collect() == []


def test_flac_round_trip_and_damage():
    rng = np.random.default_rng(0)
    payloads = [b"", b"a", b"x" * 1000, bytes(range(256)) * 3, flac.payload("né" * 400), rng.integers(0, 256, 5000, np.uint8).tobytes(), b"\0" * 192]
    media = flac.encode_batch(payloads)
    for p, (x, blocks) in zip(payloads, flac.decode_batch(media), strict=True):
        assert (x + 128).astype(np.uint8).tobytes() == p
        assert [a for a, _ in blocks] == list(range(0, len(p), flac.BLOCK))
    m = media[4]
    st = flac.Stream.parse(m)
    bare = b"fLaC" + flac.metadata(0, m[8:42], True) + m[st.start :]
    assert (flac.decode_batch([bare])[0][0] + 128).astype(np.uint8).tobytes() == payloads[4]
    for at in (st.start + 3, len(m) - 10, len(m) - 1):
        bad = bytearray(m)
        bad[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            flac.decode_batch([bytes(bad)])


def test_flac_tables(spark, docs, none, tmp_path):
    media = flac.media_table(docs)
    got = flac.media_features(media, f"file://{tmp_path}/pcm").collect()
    want = {(r.doc_id, len((r.text or "").encode()), hashlib.sha256(flac.payload(r.text)).hexdigest(), zlib.crc32(flac.payload(r.text)[-16:])) for r in docs.collect()}
    assert {(r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got} == want and not any(r.error for r in got)
    assert flac.media_features(flac.media_table(none), f"file://{tmp_path}/none").collect() == []
    odd = [F.lit(b"junk"), F.lit(None).cast("binary"), F.lit(b"fLaC"), F.expr("substring(media, 1, 300)")]
    broken = media.where("doc_id = 303")
    for k, m in enumerate(odd):
        broken = broken.unionByName(media.where("doc_id = 309").withColumn("media", m).withColumn("doc_id", F.lit(-k).cast("long")))
    rows = {r.doc_id: r for r in flac.pcm_table(broken.coalesce(1)).collect()}
    assert rows[0].error and rows[-2].error and rows[-3].error and not any(rows[-k].blocks for k in range(4))
    assert rows[-1].error is None and rows[-1].media_sha256 is None and rows[303].blocks
    pcm = spark.read.parquet(f"file://{tmp_path}/pcm").where("doc_id = 309")
    blocks = pcm.first().blocks
    assert [b.first_sample for b in blocks] == list(range(0, 2112, flac.BLOCK))
    (cut,) = pcm.select(flac.samples_at(pcm, F.lit(150).cast("long"), F.lit(400).cast("long")).alias("x")).first()
    assert bytes(b ^ 0x80 for b in cut) == flac.payload("word " * 400)[150:550]


class Writer:
    """Bits of a stream put together one value at a time."""

    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> (width - 1 - i) & 1 for i in range(width)]

    def rice(self, value, k):
        u = -2 * value - 1 if value < 0 else 2 * value
        self.bits += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)

    def frame(self, number, block):
        head = bytes([0xFF, 0xF8, 0x70, 0x02, number]) + (block - 1).to_bytes(2, "big")
        body = head + bytes([self.crc(head, 8, 0x07)]) + np.packbits(self.bits).tobytes()
        return body + self.crc(body, 16, 0x8005).to_bytes(2, "big")

    @staticmethod
    def crc(data, width, poly):
        c = 0
        for b in data:
            c ^= b << (width - 8)
            for _ in range(8):
                c = (c << 1 ^ (poly if c >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
        return c


def written_frame(rng, number, block, x, order, weights, shift, precision, method, parts, escaped):
    w = Writer()
    w.put(31 + order if weights else 8 + order, 7)
    w.put(0, 1)
    for v in x[:order]:
        w.put(int(v) & 0xFF, 8)
    use = weights or flac.FIXED[order]
    if weights:
        w.put(precision - 1, 4)
        w.put(shift, 5)
        for a in weights:
            w.put(a & ((1 << precision) - 1), precision)
    w.put(method, 2)
    w.put(parts.bit_length() - 1, 4)
    for p in range(parts):
        wide, lo, hi = 4 + method, max(order, p * block // parts), (p + 1) * block // parts
        rest = [int(x[i]) - (sum(a * int(x[i - 1 - j]) for j, a in enumerate(use)) >> (shift if weights else 0)) for i in range(lo, hi)]
        if p in escaped:
            bits = max((max(v, -v - 1).bit_length() + 1 for v in rest), default=0) if any(rest) else 0
            w.put((1 << wide) - 1, wide)
            w.put(bits, 5)
            for v in rest:
                w.put(v & ((1 << bits) - 1), bits)
        else:
            k = int(rng.integers(0, 7 if method == 0 else 20))
            w.put(k, wide)
            for v in rest:
                w.rice(v, k)
    return w.frame(number, block)


@pytest.mark.parametrize("seek", [True, False])
def test_flac_decodes_what_another_encoder_may_write(seek):
    """Linear predictors of several orders, scales and precisions, both codings of parameters, partitions, escapes, long runs of zeros."""
    rng, block = np.random.default_rng(9), 64
    ways = [(1, None, 0, 0, 0, 1, ()), (3, None, 0, 0, 1, 4, (1,)), (4, None, 0, 0, 0, 2, (0, 1)), (0, None, 0, 0, 0, 8, (7,))]
    ways += [(2, [7, -3], 2, 5, 0, 1, ()), (5, [20, -9, 3, 1, -2], 4, 7, 1, 8, (0, 3)), (1, [1], 0, 2, 0, 4, (2,)), (8, [60, -30, 9, 0, 1, -4, 2, -1], 6, 12, 0, 1, ())]
    frames, samples = [], []
    for number, (order, weights, shift, precision, method, parts, escaped) in enumerate(ways):
        x = np.clip(np.cumsum(rng.integers(-9, 10, block)), -128, 127)
        if number % 3 == 0:
            x[40:] = rng.integers(-128, 128, 24)
        frames.append(written_frame(rng, number, block, x, order, weights, shift, precision, method, parts, escaped))
        samples.append(x)
    constant, verbatim = Writer(), Writer()
    constant.put(0, 8)
    constant.put(-5 & 0xFF, 8)
    verbatim.put(2, 8)
    samples += [np.full(block, -5), rng.integers(-128, 128, block)]
    for v in samples[-1]:
        verbatim.put(int(v) & 0xFF, 8)
    frames += [constant.frame(8, block), verbatim.frame(9, block)]
    x = np.concatenate(samples).astype(np.int8)
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(x.tobytes()).digest()
    table = b"".join((i * block).to_bytes(8, "big") + sum(map(len, frames[:i])).to_bytes(8, "big") + block.to_bytes(2, "big") for i in range(len(frames)))
    stream = b"fLaC" + flac.metadata(0, info, not seek) + (flac.metadata(3, table, True) if seek else b"") + b"".join(frames)
    ((got, blocks),) = flac.decode_batch([stream])
    assert got.astype(np.int8).tobytes() == x.tobytes() and [a for a, _ in blocks] == list(range(0, len(x), block))


def test_flac_encoder_uses_every_kind_of_subframe():
    rng, t = np.random.default_rng(1), np.arange(flac.BLOCK)
    waves = [100 * np.sin(t / 3 + p) * np.exp(-t / 400) for p in range(9)]
    rows = [np.zeros(flac.BLOCK), rng.integers(-128, 128, flac.BLOCK), *waves, np.where(t < 48, rng.integers(-90, 90, flac.BLOCK), rng.integers(-1, 2, flac.BLOCK)), t // 2 - 40, rng.integers(-3, 4, flac.BLOCK), np.cumsum(rng.integers(-2, 3, flac.BLOCK))]
    x = np.array(rows).astype(np.int64)
    kinds, parts = set(), set()
    for frame in flac.encode_frames(x, np.arange(len(x))):
        kind = frame[6] >> 1
        kinds.add(kind)
        if kind >= 8:
            order = kind - 31 if kind >= 32 else kind - 8
            at = 7 * 8 + 8 * order + (9 + flac.PRECISION * order if kind >= 32 else 0)
            parts.add(int("".join(f"{b:08b}" for b in frame)[at + 2 : at + 6], 2))
    assert {0, 1, 31 + flac.LPC_ORDER} <= kinds and len(kinds) >= 5 and parts == {0, 2}
    ((got, _),) = flac.decode_batch(flac.encode_batch([(x.ravel() + 128).astype(np.uint8).tobytes()]))
    assert (got == x.ravel()).all()


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "same text " * 40 + "</p>"
    rows = [(5, "http://a/ b\n", big), (3, "http://b/", big), (9, None, big), (4, "http://c/", "tiny"), (6, "http://d/", "tiny"), (7, "u", None), (8, "u", ""), (3, "http://b/", big), (None, "x", big)]
    rows += [(100 + i, f"http://h/{i}", f"<html>page {i} " + "body " * (50 + i)) for i in range(40)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    manifest, folder = warc.archive_pages(spark, pages, f"file://{tmp_path}/w")
    got = warc.read_archives(manifest, folder, payloads=True).collect()
    assert len(got) == len(rows)
    texts = {(i, h or "") for i, _, h in rows}
    for r in got:
        if r.record_type == "response":
            assert (r.page_id, r.payload.decode()) in texts
        else:
            assert r.refers_to == 3 and r.payload_bytes == len(big)
    assert sorted(str(r.page_id) for r in got if r.record_type == "revisit") == ["5", "9", "None"]
    head = open(manifest.first().path, "rb").read(4)
    assert head in (b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd")
    assert warc.read_archives(warc.write_archives(warc.with_revisits(pages.where("false")), b"", f"file://{tmp_path}/e"), f"file://{tmp_path}/e").collect() == []


def test_url_rules_and_model(spark):
    urls = ["http://A.Example.org/es/1", "http://example.org/en/12", "https://x.org/en/12", "ftp://y.com/fr/", "http://y.com/de/x?q", "no scheme", None, "http://org", "http://m.casino-roulette77.biz/bonus/3", "http://therine.example.net/en/3", "http://e.net" + "/x" * 5000]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(rows).collect()}
    assert [got[i].rule for i in range(8)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None]
    assert [got[i].verdict for i in range(5)] == ["block", "block", "allow", "allow", "block"]
    assert (got[0].host, got[0].path, got[5].host, got[6].path) == ("a.example.org", "/es/1", "", "")
    assert got[8].verdict == "block" and got[9].verdict == "allow"


def test_chat_folding_and_read_back(spark):
    e = [
        (1, 1, 0, "start", "user", None), (1, 2, 0, "delta", None, "Hel"), (1, 3, 0, "delta", None, "lo \\ <|im_end|>\n\\n"), (1, 4, 1, "start", "assistant", None), (1, 5, 1, "delta", None, "bad"),
        (1, 6, 2, "start", "user", None), (1, 7, 2, "delta", None, "gone"), (1, 8, 1, "regenerate", "assistant", None), (1, 9, 1, "start", "assistant", None), (1, 10, 1, "delta", None, "good"), (1, 11, 0, "edit", None, "edited <|x"),
        (1, 12, 0, "delta", None, "!"), (2, 1, 0, "start", "us\ner", None), (2, 2, 0, "delta", None, None),
    ]
    events = spark.createDataFrame(e, "conv_id long, seq long, turn long, op string, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_conversations(events).collect()}
    assert got == {1: [("user", "edited <|x!"), ("assistant", "good")], 2: [("us\ner", "")]}
    assert chat.format_conversations(events.where("false")).collect() == []


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
    kept = {r.doc_id for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").count()
    assert before * 0.7 < len(kept) <= before - labels * 0.5
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == kept and isinstance(docs.schema["doc_id"].dataType, T.LongType)


def test_dictionary_learns_from_different_payloads_and_their_ends(spark):
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    common = " ".join(noise(9) for _ in range(60))
    rows = [(i, None, noise(40_000) + common) for i in range(40)]
    copies = [(100 + i, None, "hot " + "page " * 40) for i in range(400)]
    dictionary = warc.train_dictionary(spark.createDataFrame(rows + copies, "page_id long, url string, html string"), records=41)
    assert common[100:200].encode() in dictionary


def test_toxicity_keeps_every_word_and_finds_its_categories(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(2400):
        words = [f"w{k}" for k in rng.integers(0, 50, 20)]
        if i % 2 == 0:
            words[5] = f"vile{i // 2 % 100}"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 2 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(d, chain).collect()}
    assert all(got[i].is_toxic == bool(t) for i, t in labels)
    assert {f"vile{k}" for k in range(100)} <= set(chain.features)
    assert all((got[i].category_1 > 0.5) == bool(t) for i, t in labels)


def test_packing_ids_match_the_library():
    import random

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, rng = packing.WordTokens(path), random.Random(5)
    signs = "aBcs'st'S.,!&-_ 019 \n\t\r\x0b\x00\x1c\x85\xa0×÷éÉßŸÿÞ\u0301İΣςªµº½²日語한😀\u200b\u2003“’<|>|"
    whole = ["<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", "don't", "it'S", "''s", "'.s", "x'll've", "1's", "é'd", "'\u0301s", "s\u0301", "İ", "", "x" * 100_000]
    texts = whole + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [" ".join(rng.choice(whole[:12]) for _ in range(5)) for _ in range(200)]
    for t, raw in zip(texts, tok.ids(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.tok.encode(t, add_special_tokens=False).ids


def test_packing_takes_the_cheapest_sequence_with_room():
    rng = np.random.default_rng(4)
    for _ in range(30):
        pieces = [(k, 0, int(n)) for k, n in enumerate(rng.integers(1, 60, int(rng.integers(1, 40))))]
        rooms = packing.powers(sum(n for _, _, n in pieces), 64)
        room, spent, want = list(rooms), [0.0] * len(rooms), []
        for k, start, n in sorted(pieces, key=lambda p: -p[2]):
            while n:
                fit = [s for s in range(len(rooms)) if room[s] >= n] or [s for s in range(len(rooms)) if room[s]]
                s = min(fit, key=lambda s: (spent[s], s))
                m = min(n, room[s])
                want.append((k, start, m, s, rooms[s] - room[s]))
                room[s], spent[s], start, n = room[s] - m, spent[s] + packing.cost(m), start + m, n - m
        assert packing.pack(pieces, rooms) == want and not any(room)


def test_packing_balances_cost_and_wastes_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs.coalesce(1), public_tokenizers.path("word_bpe_49k.json")).collect()
    size, cost, cut = {}, {}, set()
    for r in rows:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
        cost[r.sequence_id] = cost.get(r.sequence_id, 0) + packing.cost(r.length)
        if r.length == packing.CAPACITY:
            cut.add(r.sequence_id)
    assert all(n & (n - 1) == 0 for n in size.values()) and sum(n < packing.CAPACITY for n in size.values()) <= 11
    mixed = [c for s, c in cost.items() if size[s] == packing.CAPACITY and s not in cut]
    in_order = np.add.reduceat([packing.cost(r.length) for r in rows], np.arange(0, len(rows), 3))
    assert np.std(mixed) / np.mean(mixed) < np.std(in_order) / np.mean(in_order)
