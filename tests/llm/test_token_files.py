"""Token files against the tokenizers library, damaged files, and reads of single documents."""

import glob
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from quillgauge.llm import token_files as tf
from quillgauge.llm.shared import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "one two", "two  blanks\t\ttabs\n\n lines \n", "a<|endoftext|>b it's we'll", "x" * 5000, "naïve café　日本語 1234.5 !?", "one two", "\n", " lead and trail ", "word " * 30_000]


def expected(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_whole_table_ties_and_nulls(spark):
    rows = [(None if i == 3 else 7 if i in (2, 7) else i, t, "clash") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    folder = fresh_path(spark, "ids")
    manifest = tf.write_token_files(docs, PATH, folder, 2, file_bytes=0)
    assert manifest.count() == len(TEXTS)
    got = sorted(tf.read_token_files(manifest, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    want = sorted((-1 if d is None else d, expected(t)) for d, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in got) == want
    some = tf.read_token_files(manifest, folder, [7, 6, 999]).collect()
    assert sorted(tuple(r) for r in some) == sorted(tuple(r)[:4] for r in got if r.doc_id in (6, 7))


def test_empty_table(spark):
    folder = fresh_path(spark, "ids")
    manifest = tf.write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, folder, 2)
    assert manifest.count() == 0 and tf.read_token_files(manifest, folder).count() == 0


def one_file(frame_ids=64):
    out = io.BytesIO()
    w = tf.FileWriter(out, 2, frame_ids)
    docs = [(i, np.arange(i % 50 if i != 20 else 1000, dtype="<u2")) for i in range(40)]
    for i, ids in docs:
        w.add(i, ids.tobytes())
    w.finish()
    return out.getvalue(), docs


def test_reads_only_the_frames_asked_for():
    raw, docs = one_file()
    r = tf.FileReader(io.BytesIO(raw))
    assert len(r.packed) > 20
    [(doc, start, ids)] = r.documents([7])
    assert (doc, list(ids)) == (7, list(range(7))) and start == sum(len(x) for _, x in docs[:7]) and r.decompressed == 1
    r = tf.FileReader(io.BytesIO(raw))
    assert [list(x) for _, _, x in r.documents()] == [list(x) for _, x in docs]
    assert r.decompressed == len(r.packed)  # each frame once, though documents share them


def test_any_zstandard_reader_gives_all_ids():
    raw, docs = one_file()
    out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert out == b"".join(x.tobytes() for _, x in docs)


def test_damage_is_noticed():
    raw, _ = one_file()
    for place in (-1, -5, 6):
        bad = bytearray(raw)
        bad[place] ^= 0x55
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(tf.FileReader(io.BytesIO(bytes(bad))).documents())
    r = tf.FileReader(io.BytesIO(raw))
    r.checksums[0] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(r.documents([1]))


def test_ids_are_the_library_s_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r.text or "" for r in rows]
    got = list(tf.ByteTokens(PATH).ids_in_chunks(texts))
    want = Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [w.ids for w in want]
