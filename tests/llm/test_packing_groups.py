"""Packing of groups as large as in production."""

import random

from lodestack.llm import packing


def test_whole_group_beats_best_fit():
    rng = random.Random(0)
    sizes = [rng.randint(150, 1200) for _ in range(3000)]
    bins, proven = packing.pack(sizes)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= packing.CAPACITY for b in bins)
    assert len(bins) < len(packing.best_fit(sizes, packing.CAPACITY))
    assert proven and len(bins) == packing.lower_bound(sizes, packing.CAPACITY)


def test_report_agrees_with_packing(spark):
    docs = spark.createDataFrame([(i, "one two three " * (i % 17)) for i in range(300)], "doc_id bigint, text string")
    found = packing.report(docs, capacity=40, group=100).collect()
    assert len(found) == 3 and all(r["bound"] <= r["bins"] <= r["best_fit"] for r in found)
    small = [r for r in packing.packed(docs, capacity=40, group=100).collect() if r["bin"] is not None]
    full = sum(r["n_tokens"] == 40 and r["place"] == 0 for r in small)
    assert len({r["bin"] for r in small}) == sum(r["bins"] for r in found) + full


def test_rows_all_alike_are_dealt_to_all_groups(spark):
    docs = spark.createDataFrame([(1, "one two three")] * 900 + [(k, "other " * k) for k in range(2, 100)], "doc_id bigint, text string").repartition(4)
    found = packing.report(docs, group=100).collect()
    assert len(found) == 10 and max(r["pieces"] for r in found) < 150 and sum(r["pieces"] for r in found) == 998
    rows = packing.packed(docs, group=100).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 900 and all(r["bin"] is not None for r in rows)
