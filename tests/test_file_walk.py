"""Single-file retrieval where names are defined many times: what is sent, and what comes of it."""

import json

import numpy as np
from pyspark.sql import functions as F

from lodestack.operators import chunk, graph, parse
from lodestack.plans import payload


def walked(roots, out, depth, most):
    """The list as one fold over all edges makes it; out: src to [matches of a callee, in order]."""
    order, level, cap = list(roots), list(roots), len(roots) + most
    for _ in range(depth):
        new = []
        for src in level:
            for matches in out.get(src, []):
                for dst in matches:
                    if dst not in order:
                        order.append(dst)
                        new.append(dst)
                    if len(order) >= cap:
                        break
        level = new
        if not level or len(order) >= cap:
            break
    return order


def test_walk_over_many_matches(spark):
    rng = np.random.default_rng(1)
    names = [f"n{i:02}" for i in range(40)]
    rows = sorted({(s, names[d], int(c), f"c{c}") for s in names for c in rng.choice(6, 3) for d in rng.choice(40, 25)})
    edges = spark.createDataFrame(rows, "src string, dst string, ord int, callee string")
    out = {}
    for s, d, c, _ in rows:
        out.setdefault(s, {}).setdefault(c, []).append(d)
    out = {s: [sorted(m) for _, m in sorted(x.items())] for s, x in out.items()}
    roots = {1: ["n03", "n01"], 2: ["n30"], 3: ["n07", "n08", "n09", "n10"]}
    seeds = spark.createDataFrame([(q, n, i) for q, ns in roots.items() for i, n in enumerate(ns)], "query_id int, qname string, pos int")
    for depth, most in ((1, 1), (1, 5), (2, 3), (2, 30), (3, 100)):
        found = graph.expanded(seeds, edges, depth, most)
        assert "dense_rank" in found._jdf.queryExecution().toString()  # the fold is sent no more than it looks at
        got = {}
        for r in found.orderBy("pos").collect():
            got.setdefault(r["query_id"], []).append(r["qname"])
        assert got == {q: walked(r, out, depth, most) for q, r in roots.items()}


def test_a_name_defined_often_joins_no_pairs(spark):
    source = "".join(f"def f(a):\n    return g(a, {i})\n\ndef g(a):\n    return f(a, {i})\n\n" for i in range(200))
    files = spark.createDataFrame([("m.py", "m.py", source.encode())], "path string, module string, src binary")
    asked = spark.createDataFrame([(1, "f")], "query_id int, query string")
    found = json.loads(payload.from_files(parse.parsed(files), files, asked, top_k=2, max_add=3).first()["payload"])
    assert [(n["name"], n["lineno"]) for n in found["nodes"]] == [("g", 4), ("g", 10), ("f", 1), ("f", 7), ("f", 13)]
    assert found["code"].count("def ") == 5 and found["code"].startswith("def f(a):\n    return g(a, 0)\ndef g(a):")


def test_code_of_spans_is_that_of_the_file(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):
        raw = "".join(rng.choice(["a", "bb ", "\n", "\n\n", "é"], int(rng.integers(1, 300)))).encode()
        ends = sorted({0, *(i + 1 for i in range(len(raw)) if raw[i : i + 1] == b"\n"), len(raw)})
        spans = [(a, b) for a, b in zip(ends, ends[1:]) if rng.random() < 0.7] + ([(0, 0)] if k % 5 == 0 else [])
        if spans:
            rows.append((str(k), raw, [(a, b, raw[a:b].decode()) for a, b in rng.permutation(spans).tolist()]))
    df = spark.createDataFrame(rows, "path string, src binary, spans array<struct<start:int,end:int,text:string>>")
    for caps in ((5, 8), (3, 3), (1000, 2000)):
        cut = chunk.chunked(df.withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), *caps).join(df.select("path", "src"), "path")
        want = {r[0]: r[1] for r in cut.select("path", chunk.stitched(F.col("src"), F.col("pieces")).alias("code")).collect()}
        assert {r["path"]: r["code"] for r in chunk.code_of(df, ["path"], *caps).collect()} == want


def test_words_far_into_a_text_are_found(spark):
    source = "def f(a):\n" + "".join(f"    x_{i} = y_{i}\n" for i in range(400)) + "\ndef g(b):\n    return b\n"
    files = spark.createDataFrame([("m.py", "m.py", source.encode())], "path string, module string, src binary")
    docs = {r["name"]: r["tokens"] for r in payload.file_documents(parse.parsed(files)).collect()}
    assert {f"{c}_{i}" for c in "xy" for i in range(400)} <= set(docs["f"])
