"""Small cases derived by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import spans
from lodestack.functions import text as T
from lodestack.operators import bm25, chunk, features, graph, ingest, parse, rank, select
from lodestack.sources import code


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f("s").alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, "DataLoader.train_step", T.normalized) == ["dataloader.train_step", "dataloader", "train_step", "dataloader.train", "step"]
    assert one(spark, "save model.", T.normalized) == ["save", "model.", "model"]
    assert one(spark, "Foo bar_1 9x", T.identifiers) == ["foo", "bar_1", "x"]
    assert set(one(spark, "train steps", T.expanded)) == {"train", "steps", "step", "trainer", "training", "fit", "optimize"}
    assert one(spark, None, T.normalized) == [] and one(spark, None, T.expanded) == []
    words = spark.createDataFrame([(w,) for w in ("training", "loaders", "stories", "class")], "s string")
    assert [r[0] for r in words.select(T.stemmed(F.col("s"))).collect()] == ["train", "load", "stor", "clas"]


def test_bm25_by_hand(spark):
    q = spark.createDataFrame([(1, ["a", "b"])], "query_id int, tokens array<string>")
    d = spark.createDataFrame([("x", ["a", "b"]), ("y", ["a", "a", "c"]), ("z", ["c"])], "doc_id string, tokens array<string>")
    raw = {r["doc_id"]: r["score"] for r in bm25.bm25(q, d, normalise=False).collect()}
    assert raw == pytest.approx({"x": 1.450833, "y": 0.566580}, abs=1e-6)
    assert {r["doc_id"]: round(r["score"], 6) for r in bm25.bm25(q, d).collect()} == {"x": 1, "y": 0.390520}
    none = d.limit(0)
    assert bm25.bm25(q, none).count() == 0 and bm25.okapi(q, none).count() == 0


def test_base_score_and_ranks(spark):
    row = spark.createDataFrame([(50, 5, 1.0, 1.5, 1.0, 0.4)], "loc int, cc int, pr double, tfidf double, struct double, api double")
    assert row.select(features.base_score()).first()[0] == 0.6525
    lists = spark.createDataFrame([(1, "a", 0)], "q int, key string, rank int")
    assert rank.reciprocal_ranks(lists, ["q"]).first()["score"] == pytest.approx(1 / 61)


def test_budgets(spark):
    items = spark.createDataFrame([(1, "a", 6.0, 6), (1, "b", 6.3, 7), (1, "c", 2.4, 3)], "q int, key string, benefit double, cost int")
    assert [r["key"] for r in select.knapsack(items, ["q"], 10).orderBy("pos").collect()] == ["a", "c"]
    sized = spark.createDataFrame([(1, 0, 5), (1, 1, 4), (1, 2, 1)], "q int, r int, size int")
    assert [r["r"] for r in select.prefix(sized, ["q"], 8, ["r"]).collect()] == [0]


def count100(raw):
    return sum(int(p) for p in raw.decode().replace("#", "").split())


def test_split_counts_prefixes_and_merge_fits():
    raw = b"\n\n".join(b"x" * 398 for _ in range(20)) + b"\n\n"
    count = chunk.counter("bytes4")
    pieces = chunk.split_spans(raw, [(0, len(raw))], 1200, count)
    assert [b - a for a, b in pieces] == [1600] * 5  # 400 tokens each: whole prefixes add up
    assert [(b - a) // 4 for a, b in chunk.merged_spans(raw, pieces, 1800, count)] == [1600, 400]
    raw = b"a" * 398 + b"\n\n" + b"b" * 19998 + b"\n\n" + b"c" * 400
    assert [(b - a) // 4 for a, b in chunk.split_spans(raw, [(0, len(raw))], 1200, count)] == [100, 5000, 100]


def test_splits_cover_and_stay_at_fences():
    rng = random.Random(0)
    count = chunk.counter("bytes4")
    for _ in range(300):
        raw = "".join(rng.choice(["a", "bb ", "\n", "\n\n", "é"]) for _ in range(rng.randint(0, 80))).encode()
        spans_ = chunk.split_spans(raw, [(0, len(raw))], 5, count)
        assert spans_[0][0] == 0 and spans_[-1][1] == len(raw)
        assert all(x[1] == y[0] for x, y in zip(spans_, spans_[1:]))
        ok = {0, *spans.cuts(raw, 0, len(raw))}
        assert {a for a, _ in spans_} <= ok
        merged = chunk.merged_spans(raw, spans_, 8, count)
        assert b"".join(raw[a:b] for a, b in merged) == raw


def test_lines(spark):
    starts = spark.createDataFrame([("ab\ncd",)], "s string").select(spans.line_starts("s").alias("x"))
    assert starts.select(spans.line_of(F.col("x"), F.lit(5)), spans.line_of_with_end(F.col("x"), F.lit(5), F.lit(5))).first()[:] == (2, 3)


SOURCE = '''"""Módulo é."""
import os, a.b as c
from .x import (y,
    z)

@wrap(1)
def f(a: C, b="(", *, k: List[D] = 1) -> E:
    """doc"""
    return g.h(a)

class K(Base, m=1):
    x: Q = 1

    async def m(self):
        if a and b: pass
        elif c: f(f(1))
if __name__ == "__main__":
    f(1)
if True:
    def f(): pass
'''


def test_parser():
    row = parse.parsed_file("m.py", "m.py", SOURCE.encode())
    by = {}
    for s in row["symbols"]:
        by.setdefault(s["qname"], []).append(s)
    assert list(by) == ["m.py::f", "m.py::K", "m.py::K::m"] and len(by["m.py::f"]) == 2
    f, k, m = by["m.py::f"][0], by["m.py::K"][0], by["m.py::K::m"][0]
    assert f["signature"] == 'f(a: C, b="(", *, k: List[D] = 1)' and f["decorators"] == ["wrap(1)"] and f["calls"] == ["h"]
    assert f["is_wrapper"] and f["wrapper_targets"] == ["g.h"] and f["docstring"] == "doc" and not by["m.py::f"][1]["direct"]
    raw = SOURCE.encode()
    assert raw[f["start_byte"] :].startswith(b"def f(a") and raw[m["start_byte"] : m["end_byte"]].startswith(b"async def m")
    assert m["cc"] == 4 and m["calls"] == ["f", "f"] and k["bases"] == "Base, m=1"
    assert f["identifiers"].count("h") == 2 and f["identifiers"].count("g") == 1
    assert {(i["local"], i["full"]) for i in row["imports"]} == {("os", "os"), ("c", "a.b"), ("y", ".x.y"), ("z", ".x.z")}
    assert {a["type_name"] for a in row["annotations"]} == {"C", "List", "D", "E", "Q"}
    assert row["main_calls"] == ["f"] and row["exports"] == []
    bad = parse.parsed_file("b.py", "b.py", b"def f(:\n")
    assert bad["parse_error"] and bad["symbols"] == []
    assert parse.parsed_file("e.py", "e.py", None)["symbols"] == []
    assert parse.parsed_file("l.py", "l.py", b"x = '\xff'\r\ndef g():\r\n    return 1\r\n")["symbols"][0]["lineno"] == 2


def test_last_definition_wins_in_the_first_place(spark):
    files = spark.createDataFrame([("m.py", "m.py", SOURCE.encode())], "path string, module string, src binary")
    rows = parse.symbols(parse.parsed(files), "function").filter("name = 'f'").collect()
    assert len(rows) == 1 and rows[0]["signature"] == "f()" and rows[0]["ord"] == 0


def test_scan_leaves_folders_out(spark, tmp_path):
    for p in ("a.py", "d/b.py", "d/__init__.py", ".git/c.py", "d/venv/e.py", "d/.f.py", "g.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert {r["path"] for r in code.scan(spark, str(tmp_path)).collect()} == {"a.py", "d/b.py", "d/__init__.py", "d/.f.py"}


def test_pagerank_sums_to_one_and_walk_overshoots(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "qname string")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("a", "c", 1)], "src string, dst string, weight int")
    ranks = {r["qname"]: r["rank"] for r in graph.pagerank(nodes, edges).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-6) and ranks["c"] > ranks["b"] > ranks["d"]
    seeds = spark.createDataFrame([(1, "s", 1)], "query_id int, qname string, pos int")
    out = spark.createDataFrame([("s", f"c{i}", i, f"c{i}") for i in range(4)], "src string, dst string, ord int, callee string")
    assert graph.expanded(seeds, out, 1, 2).count() == 5
    assert graph.expanded(seeds, out, 1, 2, strict=True).count() == 3
    assert graph.expanded(seeds, out, 1, 0).count() == 1


def test_ingestion(spark):
    text = 'tests/a.py::TestX::test_y fails\nFile "/x/y.py", line 12, in train_steps\n+++ b/src/z.py\nlib/q.py:3: see lib/q.py'
    r = ingest.signals(spark.createDataFrame([(1, text), (2, '{"title": "Bad Loader", "tests": ["t.py::f", "u"], "n": 3}'), (3, None)], "query_id int, raw string")).orderBy("query_id").collect()
    assert {"tests/a.py", "/x/y.py", "src/z.py", "lib/q.py"} <= set(r[0]["files"]) and r[0]["diffs"] == ["src/z.py"]
    assert "tests/a.py::TestX::test_y" in r[0]["nodeids"] and r[0]["stack_hits"][0][:] == ("/x/y.py", 12, "train_steps")
    assert r[1]["raw"] == "Bad Loader\nt.py::f\nu" and "Loader" in r[1]["classes"] and "load" in r[1]["keywords"]
    assert r[2]["raw"] == "" and r[2]["files"] == []


def test_api_over_files(spark, tmp_path):
    import json

    from lodestack import api

    (tmp_path / "m.py").write_text("class A:\n    pass\n\ndef load_data(x: A):\n    return helper(x)\n\ndef helper(x):\n    return x\n\ndef other():\n    return 1\n")
    (tmp_path / "__init__.py").write_text("")
    got = json.loads(api.select_from_file(spark, str(tmp_path / "m.py"), "load_data", top_k=1).first()["payload"])
    assert [n["name"] for n in got["nodes"]] == ["load_data", "helper"] and "score" not in got["nodes"][1]
    assert got["code"] == "def load_data(x: A):\n    return helper(x)\ndef helper(x):\n    return x"
    repo = json.loads(api.build_payload_from_repo(spark, str(tmp_path), True, 1, 1, "load_data").first()["payload"])
    assert repo["selected"]["functions"] == ["m.py::load_data"] and [c["name"] for c in repo["classes"]] == ["A"] and repo["code"].startswith("class A:")
    with pytest.raises(ValueError):
        api.select_from_file(spark, str(tmp_path), "x", hard_cap=0)
