"""Fences of the quality rules: groups with different habits, and documents on a fence."""

from pyspark.sql import functions as F

from quillgauge.llm import quality as Q


def text(words, marks=0):
    return " ".join(f"ordinary{i}" + "#" * len(range(i, marks, words)) for i in range(words))


def test_groups_with_different_habits_get_different_fences(spark):
    rows = []
    for i in range(400):
        rows.append((i, text(60, 20 + i % 9), "en", "code"))  # symbols are what this source writes
        rows.append((1000 + i, text(60), "en", "prose"))
    rows += [(5000, text(60, 25), "en", "prose"), (5001, text(60, 25), "en", "code"), (5002, text(60, 3), "en", "prose"), (5003, text(60, 200), "en", "code")]
    got = Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r.doc_id: r.kept for r in got.where("doc_id >= 5000").collect()}
    assert kept == {5000: False, 5001: True, 5002: True, 5003: False}
    assert got.where("doc_id < 5000 and not kept").count() == 0
    stats = Q.ratios(got.select("doc_id", *Q.COUNTS, F.lit("en").alias("lang"), F.when(F.col("doc_id") < 1000, "code").otherwise("prose").alias("source")))
    fences = {r.source: r for r in Q.fence_table(stats).collect()}
    assert fences["code"].symbols_hi > 400 and fences["prose"].symbols_hi < 100


def test_every_fence_moves_with_its_group(spark):
    rows = []
    for i in range(300):
        lines = "\n".join(["the same line here"] * (i % 4)) + "\n" + text(50)
        rows.append((i, lines, "de", "lists"))
        rows.append((1000 + i, text(50), "de", "plain"))
    got = Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    stats = Q.ratios(got.select("doc_id", *Q.COUNTS, F.lit("de").alias("lang"), F.when(F.col("doc_id") < 1000, "lists").otherwise("plain").alias("source")))
    fences = {r.source: r for r in Q.fence_table(stats).collect()}
    assert fences["lists"].dup_lines_hi > 2 * fences["plain"].dup_lines_hi


def test_a_document_on_a_fence_is_kept(spark):
    row = lambda hi, n: (hi, n, 100, n * 10)
    data = [row(500, 50), row(499, 50), row(100, 50), row(440, 50)]
    df = spark.createDataFrame(data, "symbols_hi long, n_symbols long, n_words long, symbols long")
    fence = next(f for f in Q.FENCES if f.metric == "symbols")
    # 50 of 100 words: on the fence; one part in a thousand beyond it is chance, as is 440; 100 is not
    assert [r.b for r in df.select(Q.breaks(fence).alias("b")).collect()] == [False, False, True, False]
    low = spark.createDataFrame([(3000, 9000, 3000), (3000, 9000, 9000), (3000, 9000, 2999), (3000, 9000, 9001)], "word_len_lo long, word_len_hi long, word_len long")
    assert [r.b for r in low.select(Q.breaks(Q.FENCES[0]).alias("b")).collect()] == [False, False, True, True]
