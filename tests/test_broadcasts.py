"""What grows with a table is joined by a shuffle, however small the planner takes it to be."""

from quillgauge.functions.session import settle
from quillgauge.operators import quality as Q


def test_trigrams_and_texts_are_not_broadcast(spark, monkeypatch):
    plans = {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return settle(df, name)

    monkeypatch.setattr(Q, "settle", seen)
    texts = [(k, f"how many {w} are there in the {k % 5} boxes of the old store") for k, w in enumerate(("apples", "apple", "pears", "pear", "plums", "plum", "figs"))]
    kept = Q.fuzzy_dedup(spark.createDataFrame([*texts, (9, texts[0][1])], "id long, question string"), 0.92)
    assert {r.id for r in kept.collect()} <= {k for k, _ in texts}
    assert "SortMergeJoin" in plans["grams"] and not any("BroadcastHashJoin" in plans[k] for k in ("texts", "grams", "edges"))
