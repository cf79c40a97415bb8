"""The line store: documents that aren't held, are held twice, or are deleted twice; batches; filters that overflow."""

import random

import numpy as np
import pytest

from lodestack.llm import linededup
from lodestack.llm.linededup import LineStore

SCHEMA = "doc_id bigint, text string"


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(store):
    return sorted((r["h"], r["n"]) for r in store.refs.collect()), sorted(((r["id"], r["th"]) for r in store.held.collect()), key=str)


def lost(change):
    return sorted((r["id"], r["at"]) for r in change[1].collect())


def test_deleting_what_is_not_held_changes_nothing(spark):
    one = made(spark, [(1, "shared line\nown line")])
    two = made(spark, [(2, "shared line"), (None, "shared line"), (3, None)])
    assert LineStore.empty().deleted(one).refs is None
    store, _ = LineStore.empty(2).inserted(one)
    assert state(store.deleted(two)) == state(store)
    assert lost(store.deleted(two).inserted(made(spark, [(2, "shared line")]))) == [(2, 0)]
    # the same id with another text is another document
    assert state(store.deleted(made(spark, [(1, "shared line")]))) == state(store)


def test_deleting_and_inserting_twice(spark):
    one, two = made(spark, [(1, "a\nb"), (1, "a\nb")]), made(spark, [(2, "b\nc")])
    store = LineStore.empty(2).inserted(one)[0].inserted(two)[0]
    assert sorted(n for _, n in state(store)[0]) == [1, 1, 2]
    again, gone = store.inserted(two)
    assert state(again) == state(store) and sorted((r["id"], r["at"]) for r in gone.collect()) == [(2, 0), (2, 1)]
    less = store.deleted(two)
    assert state(less) == state(LineStore.empty(2).inserted(one)[0]) == state(less.deleted(two))
    assert state(store.deleted(made(spark, [(2, "b\nc"), (2, "b\nc")]))) == state(less)
    assert state(store.deleted(one).deleted(two)) == ([], [])


def brute(rows):
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        kept = []
        for line in (text or "").split("\n"):
            if line.strip(" ") and line.strip(" ") in seen:
                continue
            seen.add(line.strip(" "))
            kept.append(line)
        out[d] = None if text is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_give_what_one_pass_gives(spark, batches):
    rng = random.Random(batches)
    rows = [(d, "\n".join(rng.choice(["", " x ", *map(str, range(60))]) for _ in range(rng.randint(0, 9))) if rng.random() < 0.9 else None) for d in [None, *range(-20, 60)]]
    got = linededup.deduplicated(made(spark, rows).repartition(3), batches=batches)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute(rows)
    assert all((r["n_lost"] > 0) == (r["text"] != dict(rows)[r["doc_id"]]) for r in got.collect() if r["text"] is not None)


def test_shards_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_LINES", 20)
    rng = random.Random(1)
    rows = [(d, "\n".join(str(rng.randrange(500)) for _ in range(8))) for d in range(80)]
    store = LineStore.empty()
    for k in range(0, 80, 20):
        store, _ = store.inserted(made(spark, rows[k : k + 20]))
    held = {line for _, t in rows for line in t.split("\n")}
    assert store.shards > 8 and store.refs.count() == len(held)
    filters = {r["shard"]: linededup.CuckooFilter.from_bytes(r["payload"]) for r in store.filters.collect()}
    for r in store.refs.collect():
        assert r["shard"] == r["h"] % store.shards and filters[r["shard"]].may_have(np.array([r["h"]], np.int64).view(np.uint64)).all()
    assert {r["doc_id"]: r["text"] for r in linededup.deduplicated(made(spark, rows), batches=3).collect()} == brute(rows)


def test_a_filter_that_overflows_is_made_anew(spark):
    few, many = made(spark, [(1, "a\nb\nc")]), made(spark, [(2, "\n".join(map(str, range(3000))))])
    store, _ = LineStore.empty(1).inserted(few)
    small = store.filters.first()["payload"]
    store, _ = store.inserted(many)
    row = store.filters.collect()
    assert len(row) == 1 and len(row[0]["payload"]) > len(small)
    h = np.array([r["h"] for r in store.refs.collect()], np.int64).view(np.uint64)
    assert len(h) == 3003 and linededup.CuckooFilter.from_bytes(row[0]["payload"]).may_have(h).all()


def test_many_rows_alike_lose_their_lines_once(spark):
    docs = made(spark, [(5, "a\nb\nc")] * 300 + [(1, "b"), (9, "c\nd")]).repartition(3)
    plan = [r for r in linededup.deduplicated(docs, n_lost="gone").groupBy("doc_id", "text", "gone").count().collect()]
    assert {(r["doc_id"], r["text"], r["gone"], r["count"]) for r in plan} == {(5, "a\nc", 1, 300), (1, "b", 0, 1), (9, "d", 1, 1)}
