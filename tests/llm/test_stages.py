"""The pipeline's stages against brute force, and op5's scores against a slow reading of them."""

import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodestack.llm import ngramjoin, packing, toxicity
from lodestack.llm.common import word_gram_hashes, words_of

SMALL = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def word_weight(model, word):
    """The mean weight of a marked word's 3- to 5-grams and of the word itself."""
    marked, found = [ord(c) for c in f"<{word}>"], []
    for n in toxicity.LENGTHS:
        for i in range(len(marked) - n + 1):
            h = n
            for c in marked[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + c) & MASK
            found.append(mix(h))
    found.append(mix(sum((c + 1) * mix(i + 77) for i, c in enumerate(marked)) & MASK))
    return float(np.mean([model.weights[h % len(model.weights)] for h in found]))


def slow_score(model, text):
    for m in toxicity.MARKS:
        text = (text or "").replace(m, " ")
    counts = Counter(text.lower().split())
    if not counts:
        return None
    weights = {w: 1 + math.log(n) for w, n in counts.items()}
    n = sum(weights.values())
    total = sum(word_weight(model, w) * x for w, x in weights.items()) + max(toxicity.LEAST_WORDS - n, 0) * word_weight(model, toxicity.FILLER)
    return 1 / (1 + math.exp(-(total / max(n, toxicity.LEAST_WORDS) + model.bias)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


def test_toxic_documents_go(spark, docs, rows):
    model = toxicity.fitted(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    score = {r["doc_id"]: slow_score(model, r["text"]) for r in rows}
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.scored(docs, model).collect()}
    assert got == pytest.approx(score, abs=1e-6)
    cut = sorted(x for x in score.values() if x is not None)[len(score) // 2]
    half = toxicity.Model(model.weights, model.bias, cut + 1e-9)
    flags = {r["doc_id"] for r in toxicity.scored(docs, half).filter("toxic").collect()}
    assert flags == {d for d, x in score.items() if x is not None and x >= half.threshold} and 0 < len(flags) < len(score)
    kept = corpus_pipeline.without_toxic(spark, docs, SMALL)
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if score[r["doc_id"]] is None or score[r["doc_id"]] < model.threshold)


def test_repeated_lines_go_and_documents_that_had_nothing_else(spark, docs, rows):
    seen, want = set(), {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        kept = []
        for line in (r["text"] or "").split("\n"):
            if not line.strip(" ") or line.strip(" ") not in seen:
                seen.add(line.strip(" "))
                kept.append(line)
        text = "\n".join(kept)
        if text == r["text"] or text.strip():
            want[r["doc_id"]] = r | {"text": text, "n_chars": r["n_chars"] if text == r["text"] else len(text)}
    got = {r["doc_id"]: r.asDict() for r in corpus_pipeline.without_repeated_lines(spark, docs, SMALL).collect()}
    assert got == want and len(want) < len(rows) and any(want[d]["text"] != r["text"] for d, r in ((r["doc_id"], r) for r in rows) if d in want)


def test_one_document_of_each_class_stays(spark, docs, rows):
    sets = {r["doc_id"]: set(word_gram_hashes(r["text"], ngramjoin.GRAM).tolist()) for r in rows}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= ngramjoin.THRESHOLD * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    got = corpus_pipeline.without_near_copies(spark, docs, SMALL).collect()
    assert sorted(map(repr, got)) == sorted(repr(r) for r in docs.collect() if top(r["doc_id"]) == r["doc_id"]) and len(got) < len(rows)


def test_copies_and_sequences_hold_what_they_say(spark, docs, rows):
    mixed = corpus_pipeline.in_target_mixture(spark, docs, SMALL)
    copies, whole = Counter(map(repr, mixed.collect())), {repr(r): r for r in docs.collect()}
    assert set(copies) <= set(whole)
    count = {r["doc_id"]: words_of(packing.TOKENIZER).count(r["text"]) for r in rows}
    share = Counter()
    for x, n in copies.items():
        share[whole[x]["source"]] += n * count[whole[x]["doc_id"]]
    have = Counter()
    for r in rows:
        have[r["source"]] += count[r["doc_id"]]
    want = {s: n**0.7 for s, n in have.items()}
    assert all(abs(share[s] / sum(share.values()) - want[s] / sum(want.values())) < 0.08 for s in have)
    places, used = Counter(), Counter()
    for r in corpus_pipeline.into_sequences(spark, mixed, SMALL).collect():
        places[r["doc_id"]] += r["n_tokens"]
        used[r["bin"]] += r["n_tokens"]
    assert places == Counter({d: n for d, n in ((whole[x]["doc_id"], copies[x] * count[whole[x]["doc_id"]]) for x in copies)})
    assert max(n for b, n in used.items() if b is not None) <= packing.CAPACITY
