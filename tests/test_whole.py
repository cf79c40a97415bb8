"""Rankings and similarities against brute force, and ranks and budgets at any size of a group."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import rank, select, similar
from lodestack.queries import queries

DIR = "/root/testdata/sf0.001"


def cosines(v):
    n = np.sqrt((v * v).sum(1)) + 1e-12
    return (v @ v.T) / n[:, None] / n


def test_every_vector_is_a_query(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties and zero vectors
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, v array<double>")
    got = {}
    for r in similar.cosine_top(df, 5, block=16).collect():
        got[r["query_id"], r["rank"]] = (r["doc_id"], round(r["score"], 6))
    s = np.floor(cosines(v) * 1e6 + 0.5) / 1e6
    assert len(got) == 60 * 5
    for i in range(60):
        want = sorted((j for j in range(60) if j != i), key=lambda j: (-s[i, j], j))[:5]
        assert [s[i, got[i, k + 1][0]] for k in range(5)] == pytest.approx([s[i, j] for j in want], abs=2e-6)
    scaled = {(r["query_id"], r["vec_id"]): r["similarity"] for r in similar.cosine_min_max(df, block=16).collect()}
    assert len(scaled) == 60 * 59
    c = cosines(v)
    for i in range(60):
        o = np.delete(c[i], i)
        width = (o.max() - o.min()) or 1.0
        assert [scaled[i, j] for j in range(60) if j != i] == pytest.approx((o - o.min()) / width, abs=1e-9)


def test_stated_queries_meet_all_vectors(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(70)], "vec_id bigint, v array<double>")
    some = df.filter("vec_id % 7 = 0")
    every = {tuple(r) for r in similar.cosine_top(df, 4, block=16).collect()}
    assert {tuple(r) for r in similar.cosine_top(df, 4, some, block=16).collect()} == {r for r in every if r[0] % 7 == 0}
    scaled = {(r[0], r[1]): r[2] for r in similar.cosine_min_max(df, block=16).collect()}
    assert {(r[0], r[1]): r[2] for r in similar.cosine_min_max(df, some, block=16).collect()} == pytest.approx({k: v for k, v in scaled.items() if k[0] % 7 == 0})


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of 170 documents and 3 passages, one of them with no word that a document has; the documents and passages."""
    at = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(5)
    docs = []
    for i in range(170):
        words = [f"w{x}" for x in rng.zipf(1.5, rng.integers(1, 60)) if x < 400] or ["none"]
        docs.append((i, " ".join((["needle"] if i < 150 else []) + words)))
    # no passage's word, but the largest: beyond lexical rank 100 of every passage
    docs.append((170, "huge " * 700))
    asked = [(0, "Needle w1 w2 w3"), (1, "w7 w7 foo_1 needle"), (2, "zzz")]
    spark.createDataFrame([(*d, "en", "x", len(d[1])) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(asked, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, asked


def half_up(x, digits):
    return math.floor(x * 10**digits + 0.5) / 10**digits


def words(text):
    return re.findall(r"[a-z_][a-z0-9_]*", text.lower())


def lexical(docs, query):
    """{document: score}, all of them."""
    counts = {d: Counter(words(t)) for d, t in docs}
    size = {d: max(1, len(words(t))) for d, t in docs}
    mean = sum(size.values()) / len(docs)
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log((len(docs) - n + 0.5) / (n + 0.5) + 1) for w, n in df.items()}
    raw = {d: sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[d] / mean)) for w in words(query) if c[w]) for d, c in counts.items()}
    top = max(raw.values()) or 1.0
    return {d: half_up(x / top, 6) for d, x in raw.items()}


def order(scores):
    return sorted(scores, key=lambda d: (-scores[d], d))


def test_fusion_takes_full_rankings(spark, tables):
    at, docs, asked = tables
    run = {name: queries()[name](spark, at).collect() for name in ("rrf_two_channel", "choose_roots", "hybrid_scores", "blend_topk", "knapsack_budget")}
    most = max(len(t) for _, t in docs)
    base = {d: len(t) / most for d, t in docs}
    st = {d: r for r, d in enumerate(order({d: half_up(x, 9) for d, x in base.items()}))}
    for q, text in asked:
        got = {name: [r for r in rows if r["query_id"] == q] for name, rows in run.items()}
        score = lexical(docs, text)
        lex = order(score)
        fused = {d: 1 / (61 + r) + 1 / (61 + st[d]) for r, d in enumerate(lex)}
        assert {r["key"]: r["score"] for r in got["rrf_two_channel"]} == pytest.approx(fused, abs=2e-9)
        roots = list(dict.fromkeys([*lex[:5], *order({d: half_up(x, 12) for d, x in fused.items()})]))[:10]
        assert [r["key"] for r in sorted(got["choose_roots"], key=lambda r: r["pos"])] == roots
        assert {r["key"]: r["fused"] for r in got["hybrid_scores"]} == pytest.approx({d: 61 / (61 + r) for r, d in enumerate(lex)}, abs=2e-9)
        assert {r["retrieve"] for r in got["hybrid_scores"]} == {max(score.values()) >= 0.05}
        blend = {d: half_up(0.5 * base[d] + 0.5 * score[d], 6) for d in base}
        assert [r["key"] for r in sorted(got["blend_topk"], key=lambda r: r["rank"])] == order(blend)[:10]
        room, taken = 20000, []
        for d in sorted(blend, key=lambda d: (-blend[d] / len(docs[d][1]), -blend[d], len(docs[d][1]), d)):
            if len(docs[d][1]) <= room:
                room -= len(docs[d][1])
                taken.append(d)
        assert [r["key"] for r in sorted(got["knapsack_budget"], key=lambda r: r["pos"])] == taken
    assert lexical(docs, asked[0][1])[170] == 0 and order(lexical(docs, asked[0][1])).index(170) >= 100
    assert 170 in {r["key"] for r in run["blend_topk"] if r["query_id"] == 0}  # structural rank 0 alone


def test_rank_of_a_whole_table(spark):
    rows = spark.createDataFrame([(k, s) for k, s in enumerate([3.0, 1.0, None, 3.0, 2.0, None])], "key bigint, s double")
    assert {r["key"]: r["rank"] for r in rank.ranked_whole(rows, [], score="s").collect()} == {0: 0, 3: 1, 4: 2, 1: 3, 2: 4, 5: 5}
    assert rank.ranked_whole(rows.limit(0), [], score="s").count() == 0


def test_ranks_of_groups_that_cross_tasks(spark):
    rng = np.random.default_rng(7)
    rows = [(g, k, float(rng.integers(0, 5))) for g in (None, 1, 2) for k in range(1500 if g == 1 else 40)]
    df = spark.createDataFrame(rows, "g int, key bigint, score double").repartition(5)
    want = {}
    for g in (None, 1, 2):
        want |= {(g, k): i for i, (_, k, _) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])))}
    assert {(r["g"], r["key"]): r["rank"] for r in rank.ranked_whole(df, ["g"]).collect()} == want


def test_knapsack_leaves_out_only_what_never_fits(spark):
    rng = np.random.default_rng(9)
    items = [(q, k, float(rng.integers(1, 40)), int(rng.integers(0, 12))) for q in (1, 2) for k in range(400)]
    df = spark.createDataFrame(items, "q int, key bigint, benefit double, cost int")
    got = {}
    for r in select.knapsack(df, ["q"], 60).orderBy("pos").collect():
        got.setdefault(r["q"], []).append(r["key"])
    for q in (1, 2):
        room, want = 60, []
        for _, k, b, c in sorted((x for x in items if x[0] == q), key=lambda x: (-x[2] / max(1, x[3]), -x[2], max(1, x[3]), x[1])):
            if max(1, c) <= room:
                room -= max(1, c)
                want.append(k)
        assert got[q] == want


@pytest.mark.parametrize("kind", ["norm", "okapi"])
def test_a_pruned_report_is_the_whole_one(spark, monkeypatch, kind):
    from lodestack.operators import bm25

    monkeypatch.setattr(bm25, "QUERIES", 2)
    monkeypatch.setattr(bm25, "AT_ONCE", 5)
    rng = np.random.default_rng(2)
    words = lambda n: [f"w{x % 30}" for x in rng.zipf(1.4, n)]
    docs = spark.createDataFrame([(d, words(int(rng.integers(0, 12)))) for d in range(700)], "doc_id bigint, tokens array<string>").repartition(3)
    asked = spark.createDataFrame([(q, words(3) if q else []) for q in range(8)], "query_id int, tokens array<string>")
    score = bm25.bm25 if kind == "norm" else bm25.okapi
    whole = bm25.top_k(score(asked, docs), 5).collect()
    assert sorted(map(tuple, bm25.top_k(score(asked, docs, top=5), 5).collect())) == sorted(map(tuple, whole)) and len(whole) == 35
    assert score(asked, docs, every=True).count() == 8 * 700


def test_gate_sees_all_pairs(spark, tables):
    at, docs, asked = tables
    most = max(len(t) for _, t in docs)
    run = {name: queries()[name](spark, at).collect() for name in ("lexical_score", "lexical_coverage", "lexical_gate", "seeds_gated")}
    share = lambda wanted, text: sum(t in text.lower() for t in wanted) / len(wanted)
    assert {(r["query_id"], r["key"]): r["coverage"] for r in run["lexical_score"]} == {(q, d): half_up(share(set(words(a)), t), 9) for q, a in asked for d, t in docs}
    assert {(r["query_id"], r["key"]): r["coverage"] for r in run["lexical_coverage"]} == {(q, d): half_up(share(words(a), t), 9) for q, a in asked for d, t in docs}
    gate = {(q, d) for q, a in asked for d, t in docs if share(set(words(a)), t) >= 0.6}
    assert {(r["query_id"], r["key"]) for r in run["lexical_gate"]} == gate and sum(q == 0 for q, _ in gate) > 10
    for q, a in asked:
        lex = order(lexical(docs, a))
        final = {d: half_up(0.5 * len(docs[d][1]) / most + 0.5 / (61 + r), 9) for r, d in enumerate(lex)}
        first = [d for d in lex if (q, d) in gate][:4]
        rest = [d for d in order(final) if (q, d) in gate] or order(final)
        assert [r["key"] for r in sorted((r for r in run["seeds_gated"] if r["query_id"] == q), key=lambda r: r["pos"])] == list(dict.fromkeys([*first, *rest]))[:6]


def test_empty_queries_and_texts(spark):
    from lodestack.operators import cover

    texts = spark.createDataFrame([(1, None), (2, "xx_Data9 y")], "key bigint, text string")
    asked = spark.createDataFrame([(1, []), (2, ["data", "q"])], "query_id bigint, tokens array<string>")
    assert {tuple(r) for r in cover.coverage(texts, asked).collect()} == {(2, 1, 0.0), (2, 2, 0.5)}
    assert {tuple(r)[:2] for r in cover.coverage(texts, asked, least=0.5).collect()} == {(1, 1), (1, 2), (2, 2)}


def test_ranks_of_a_few_documents_among_all(spark):
    from lodestack.operators import bm25

    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(d, [f"w{x % 9}" for x in rng.zipf(1.5, int(rng.integers(0, 5)))]) for d in range(-150, 350)], "doc_id bigint, tokens array<string>").repartition(3)
    asked = spark.createDataFrame([(q, [f"w{q}", "w1", "none"]) for q in range(4)] + [(9, []), (10, ["none"])], "query_id int, tokens array<string>")
    some = docs.filter("doc_id % 7 = 0").select("doc_id")
    whole = bm25.bm25(asked, docs, every=True).withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)
    want = {(r["query_id"], r["doc_id"]): (r["score"], r["rank"]) for r in rank.ranked_whole(whole, ["query_id"], key="doc_id").join(some, "doc_id").collect()}
    got = {(r["query_id"], r["doc_id"]): (r["score"], r["rank"]) for r in bm25.ranks_of(asked, docs, some).collect()}
    assert got == want and len(got) == 6 * some.count()
    assert bm25.ranks_of(asked, docs.limit(0), some).count() == 0
