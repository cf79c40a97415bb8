"""Vectors in the plans, widened seeds, odd sources, and the command line."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import api, cli
from lodestack.operators import bm25, embed, graph, parse
from lodestack.plans import payload
from lodestack.sources import code

SOURCE = '''import os

LIMIT = 3


class Loader(Base):
    """Holds data."""

    def load(self, path: str):
        return read(path)


def read(path):
    """Reads a file."""
    if path and os:
        return open(path)


def train_step(batch: Loader):
    return read(batch)
'''


def parsed_of(spark, *files):
    rows = spark.createDataFrame([(p, p, s if isinstance(s, bytes) else s.encode()) for p, s in files], "path string, module string, src binary")
    return parse.parsed(rows), rows


def test_a_mark_before_the_text_moves_nothing_but_bytes(spark):
    plain, _ = parsed_of(spark, ("a.py", SOURCE))
    marked, _ = parsed_of(spark, ("a.py", b"\xef\xbb\xbf" + SOURCE.encode()))
    cols = ["qname", "lineno", "end_lineno", "signature", "docstring", "code", "identifiers", "calls"]
    one, two = ({r["qname"]: r for r in parse.symbols(p).collect()} for p in (plain, marked))
    assert len(one) == 4 and all(one[q][c] == two[q][c] for q in one for c in cols)
    assert all(two[q]["start_byte"] == one[q]["start_byte"] + 3 for q in one)
    first, _ = parsed_of(spark, ("a.py", b"\xef\xbb\xbfdef f(): return g()\n"))
    assert [(r["start_byte"], r["end_byte"], r["code"]) for r in parse.symbols(first).collect()] == [(3, 22, "def f(): return g()")]


def test_statements_that_parse_are_kept(spark):
    broken = SOURCE.replace("def read(path):", "def read(path:").replace("LIMIT = 3", "LIMIT = = 3")
    p, _ = parsed_of(spark, ("a.py", broken), ("b.py", "def (:\n"), ("c.py", "    x = 1\n  y\n"), ("d.py", "@wrap\ndef f(\n    a,\n):\n    try:\n        g()\nexcept E:\n    pass\n"))
    rows = {r["path"]: r for r in p.collect()}
    assert [s["name"] for s in rows["a.py"]["symbols"]] == ["Loader", "load", "train_step"] and "SyntaxError" in rows["a.py"]["parse_error"]
    whole, _ = parsed_of(spark, ("a.py", SOURCE))
    want = {s["name"]: s["lineno"] for s in whole.first()["symbols"]}
    assert all(s["lineno"] == want[s["name"]] and broken.encode()[s["start_byte"] : s["end_byte"]].decode() == s["code"] for s in rows["a.py"]["symbols"])
    assert all(rows[x]["symbols"] == [] and rows[x]["parse_error"] for x in ("b.py", "c.py", "d.py"))


def test_last_definition_in_the_first_ones_place(spark):
    p, _ = parsed_of(spark, ("a.py", "def f(): return 1\ndef g(): pass\ndef f(): return 2\nclass f: pass\n"))
    found = [(r["kind"], r["name"], r["ord"], r["lineno"]) for r in parse.symbols(p).orderBy("ord", "kind").collect()]
    assert found == [("function", "f", 0, 3), ("function", "g", 1, 2), ("class", "f", 3, 4)]
    assert "Exchange" not in parse.symbols(p)._jdf.queryExecution().executedPlan().toString()


def test_docstrings_as_written_and_operators_flag(spark):
    p, _ = parsed_of(spark, ("a.py", "def f(a, b):\n    r'''raw \\d'''\n    if a and b or a:\n        pass\n"))
    one = parse.symbols(p).first()
    assert one["body_docstring"] == "r'''raw \\d" and one["docstring"] == "raw \\d" and one["cc"] == 4
    assert parse.parsed_file("a.py", "a.py", b"def f(a, b):\n    if a and b:\n        pass\n", operators=False)["symbols"][0]["cc"] == 2


def test_scan_goes_on_in_tasks(spark, tmp_path):
    for i in range(7):
        for j in range(3):
            d = tmp_path / f"p{i}" / f"q{j}"
            d.mkdir(parents=True)
            (d / "__init__.py").write_text(f"x = {i * 10 + j}\n")
    (tmp_path / "top.py").write_text("y = 1\n")
    (tmp_path / "p1" / ".git").mkdir()
    (tmp_path / "p1" / ".git" / "no.py").write_text("")
    for wide in (1, 5, 64):
        found = {r["path"]: bytes(r["src"]).decode() for r in code.scan(spark, str(tmp_path), wide=wide).collect()}
        assert found == {"top.py": "y = 1\n"} | {f"p{i}/q{j}/__init__.py": f"x = {i * 10 + j}\n" for i in range(7) for j in range(3)}
    langs = spark.createDataFrame([("a.py",), ("a.rs",)], "p string").select(code.language(F.col("p"))).collect()
    assert [r[0] for r in langs] == ["python", None]


def test_query_source(tmp_path, monkeypatch):
    (tmp_path / "q.txt").write_text("from a file")
    assert code.read_query(str(tmp_path / "q.txt")) == "from a file" and code.read_query("as given") == "as given" and code.read_query("x" * 9999) == "x" * 9999
    monkeypatch.setattr("sys.stdin", io.StringIO("from standard input"))
    assert code.read_query("-") == "from standard input"


def test_encoders_and_similarities(spark):
    encode = embed.encoder("hash-64")
    assert encode is embed.ENCODERS["hash-64"] and embed.encoder(None) is None
    with pytest.raises(ValueError):
        embed.encoder("none such")
    rows = spark.createDataFrame([("a", "load data"), ("b", None), ("c", "train step " * 400)], "key string, text string")
    v = {r["key"]: np.array(r["v"]) for r in embed.embedded(rows, "key", "text", encode).collect()}
    assert set(v) == {"a", "b", "c"} and np.linalg.norm(v["a"]) == pytest.approx(1, abs=1e-6) and not v["b"].any()
    asked = spark.createDataFrame([(1, "load data"), (2, ""), (3, "train")], "query_id int, query string")
    got = {(r["query_id"], r["key"]): r["similarity"] for r in embed.similarities(embed.embedded(rows, "key", "text", encode), asked, encode).collect()}
    q = embed.normalised(encode(["load data", "train"]))
    assert got == pytest.approx({(i, k): float(q[j] @ v[k]) for j, i in enumerate((1, 3)) for k in v}, abs=1e-6) and got[1, "a"] == pytest.approx(1, abs=1e-6)
    text = spark.range(1).select(embed.document_text(F.lit("m::f"), F.lit("f()"), F.lit(None), F.encode(F.lit("x" * 3000), "UTF-8"))).first()[0]
    assert text == "m::f\nf()\n\n" + "x" * 1200


def meaning(texts):
    """An encoder that knows one word."""
    return np.array([[1.0, 0.0] if "train" in t else [0.0, 1.0] for t in texts])


def test_rerank_by_meaning_in_single_files(spark):
    p, rows = parsed_of(spark, ("m.py", SOURCE))
    asked = spark.createDataFrame([(1, "read train")], "query_id int, query string")
    plain = json.loads(payload.from_files(p, rows, asked, top_k=2, depth=0).first()["payload"])
    ranked = json.loads(payload.from_files(p, rows, asked, top_k=2, depth=0, encode=meaning).first()["payload"])
    docs = payload.file_documents(p)
    raw = {r["doc_id"]: r["score"] for r in bm25.top_k(bm25.okapi(asked.select("query_id", F.split("query", " ").alias("tokens")), docs, every=True), 9).collect()}
    name = {r["doc_id"]: r["name"] for r in docs.collect()}
    want = sorted(((0.5 * s + 0.5 * (name[d] == "train_step"), name[d]) for d, s in raw.items()), reverse=True)
    assert [n["name"] for n in ranked["nodes"]] == [n for _, n in want[:2]] and ranked["nodes"][0]["score"] == pytest.approx(want[0][0], abs=1e-6)
    assert {n["name"] for n in plain["nodes"]} <= {"read", "train_step", "Loader"}
    more = json.loads(payload.from_files(p, rows, spark.createDataFrame([(1, "limit")], "query_id int, query string"), top_k=1, depth=0, variables=True).first()["payload"])
    assert [(n["type"], n["name"]) for n in more["nodes"]] == [("variable", "LIMIT")]


def test_meaning_is_a_channel_of_the_fusion(spark):
    p, _ = parsed_of(spark, ("m.py", SOURCE))
    asked = spark.createDataFrame([(1, "train"), (2, "")], "query_id int, query string")
    base = spark.createDataFrame([(q, 0.0) for q in ("m.py::Loader::load", "m.py::read", "m.py::train_step")], "qname string, base double")
    one, two = ({(r["query_id"], r["key"]): r for r in payload.hybrid_candidates(p, base, asked, 1.0, encode=e).collect()} for e in (None, meaning))
    for (q, k), r in two.items():
        lexical = 1 / (61 + one[q, k]["lex_rank"])
        dense = {"m.py::train_step": 0, "m.py::Loader::load": 1, "m.py::read": 2}[k]
        assert one[q, k]["final"] == pytest.approx(lexical) and r["final"] == pytest.approx(lexical + (1 / (61 + dense) if q == 1 else 0))


def brute_seeds(scores, codes, terms, near, top_k, depth, least):
    order = sorted(scores, key=lambda x: (-scores[x], x))
    seeds = [x for x in order if not terms or sum(t in codes[x].lower() for t in terms) / len(terms) >= least][:top_k]
    seen, level = set(seeds), seeds
    for _ in range(depth):
        level = [v for u in level for v in near.get(u, ()) if v not in seen]
        seen |= set(level)
    return seeds, sorted(seen, key=lambda x: (-scores.get(x, 0.0), x))[:top_k]


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_seeds_are_gated_widened_and_ranked_again(spark, depth):
    rng = np.random.default_rng(depth)
    names = [f"n{i}" for i in range(30)]
    codes = {n: " ".join(rng.choice(["naïve", "loader", "step", "x"], 3)) for n in names}
    scores = {n: float(rng.integers(0, 9)) / 9 for n in names}
    pairs = sorted({tuple(map(str, rng.choice(names, 2, replace=False))) for _ in range(40)})
    edges = graph.both_ways(spark.createDataFrame(pairs, "src string, dst string"))
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    asked = spark.createDataFrame([(1, "Naïve step step"), (2, "")], "query_id int, query string")
    functions = spark.createDataFrame(list(codes.items()), "qname string, code string")
    scored = asked.select("query_id").crossJoin(spark.createDataFrame(list(scores.items()), "qname string, final double"))
    seeds, wide = payload.seeds_and_expanded(scored, functions, asked, edges, 5, depth, 0.6)
    for q, terms in ((1, ["naïve", "step", "step"]), (2, [])):
        want = brute_seeds(scores, codes, terms, near, 5, depth, 0.6)
        assert [r["qname"] for r in seeds.filter(F.col("query_id") == q).orderBy("pos").collect()] == want[0]
        assert [r["qname"] for r in wide.filter(F.col("query_id") == q).orderBy("pos").collect()] == want[1]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    assert cli.main([str(tmp_path / "none.py"), "x"]) == 2 and "error" in json.loads(capsys.readouterr().out)
    (tmp_path / "m.py").write_text(SOURCE)
    assert cli.main([str(tmp_path / "m.py"), "x", "--hard-cap", "0"]) == 2 and "error" in json.loads(capsys.readouterr().out)
    assert cli.main([str(tmp_path / "m.py"), "train step", "--top-k", "1", "--depth", "1"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert [n["name"] for n in found["nodes"]] == ["train_step", "read"] and found["summary"]["total_functions"] == 2 and "def train_step" in found["code"]


def test_structural_context_and_hybrid_entry_point(spark, tmp_path):
    (tmp_path / "m.py").write_text(SOURCE)
    rows = spark.createDataFrame([("m.py", SOURCE)], "path string, text string")
    assert api.build_structural_context(rows).first()["outline"].startswith("Imports:\n  import os\nClasses:\n  class Loader(Base)")
    found = json.loads(api.hybrid_context(spark, str(tmp_path), "train step", top_k=2, encode="hash-64", max_tokens=100).first()["payload"])
    assert {n["name"] for n in found["nodes"]} == {"read", "train_step"} and "def train_step" in found["code"]
