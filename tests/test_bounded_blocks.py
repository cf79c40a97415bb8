"""What a worker holds of pairs doesn't grow with blocks or batches."""

import numpy as np

from lodestack.operators import similar


def test_products_come_in_few_rows():
    v = np.random.default_rng(0).normal(size=(700, 4))
    q, c = (np.arange(700), v, {}), (np.arange(700), v, {})
    sizes = [s.shape for _, s in similar._cosines(q, c)]
    assert max(n for n, _ in sizes) <= 64 and sum(n for n, _ in sizes) == 700


def test_tokens_are_looked_up_for_few_documents_at_a_time(spark, monkeypatch):
    from lodestack.operators import bm25

    seen = spark.sparkContext.accumulator(0)
    places = bm25._Asked.places

    class Counted(bm25._Asked):
        def places(self, tokens):
            seen.add(max(0, len(tokens) - 256))  # rows beyond what a step may have
            return places(self, tokens)

    monkeypatch.setattr(bm25, "_Asked", Counted)
    docs = spark.range(2000, numPartitions=1).selectExpr("id AS doc_id", "array('a', 'b' || id % 7) AS tokens")
    asked = spark.createDataFrame([(1, ["a", "b3"]), (2, ["b1"])], "query_id int, tokens array<string>")
    assert bm25.bm25(asked, docs, every=True).count() == 4000 and seen.value == 0
    best = bm25.top_k(bm25.bm25(asked, docs, top=2), 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in best] == [(1, 3), (1, 10), (2, 1), (2, 8)]
