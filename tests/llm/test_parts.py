"""Parts of the operators that the other tests don't reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import common, fingerprint, langid, toxicity, wavelet


@pytest.mark.parametrize("n", [1, 63, 64, 65, 511, 512, 513, 262_143, 262_144, 262_145, 600_000])
def test_wavelet_at_the_ends_of_words_steps_and_blocks(n):
    rng = np.random.default_rng(n)
    ids = rng.choice(np.array([0, 1, 5, 7], np.uint16), n, p=[0.5, 0.3, 0.15, 0.05])
    lengths = np.array([n // 2, 0, n - n // 2])
    w = wavelet.WaveletShard(wavelet.build(ids, [1, 2, 3], lengths))
    some = sorted({i for i in (0, 1, 62, 63, 64, 65, 510, 511, 512, 513, 262_142, 262_143, 262_144, n // 2, n - 2, n - 1) if 0 <= i < n})
    assert [w.access(i) for i in some] == ids[some].tolist()
    for t in (0, 1, 5, 7, 3, 9):
        at = np.flatnonzero(ids == t)
        assert [w.rank(t, i) for i in [*some, n, n + 5]] == [int((at < i).sum()) for i in [*some, n, n + 5]]
        if len(at):
            ks = sorted({0, len(at) // 3, len(at) // 2, len(at) - 1})
            assert [w.select(t, k) for k in ks] == at[ks].tolist()
    assert (w.document(0) == ids[: n // 2]).all() and len(w.document(1)) == 0 and (w.document(2) == ids[n // 2 :]).all()
    with pytest.raises(IndexError):
        w.select(3, 0)
    with pytest.raises(IndexError):
        w.access(n)


def test_a_long_text_is_scored_in_parts(monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 1000)
    scorer = langid.Scorer(langid.grown({"u": ["some words of one language " * 20], "v": ["andere Wörter, größer " * 20]}, least=1))
    text = "words größer " * 700
    assert (scorer.lengths([text])[0] == scorer._long(text.encode())).all()
    monkeypatch.setattr(langid, "CHUNK", 1 << 20)
    assert (scorer.lengths([text])[0] == scorer._long(text.encode())).all()
    assert langid.Scorer(langid.grown({})).lengths(["x", None]).shape == (2, 0)


def test_rare_contexts_are_left_out_and_coded_in_the_next_shorter_one():
    """Code lengths at the production bound: brute force over trees without the order-3 contexts seen too seldom."""
    samples = {"u": ["the cat and the hat and the bat " * 3], "v": ["der Hut und der Hund und die Hand " * 2]}
    scorer = langid.Scorer(langid.grown(samples))
    seen: dict[bytes, int] = {}
    trees = {}
    for lang, texts in samples.items():
        data = langid.START + langid.START.join(t.encode() for t in texts)
        trees[lang] = {}
        for i in range(3, len(data)):
            seen[data[i - 3 : i]] = seen.get(data[i - 3 : i], 0) + 1
            for k in range(4):
                c = trees[lang].setdefault(data[i - k : i], {})
                c[data[i]] = c.get(data[i], 0) + 1
    assert min(seen.values()) < langid.LEAST <= max(seen.values())
    for text in ("the hut", "und that xyz"):
        got = scorer.lengths([text])[0] / langid.UNIT
        for j, lang in enumerate(scorer.languages):
            raw, total = langid.START + text.encode(), 0.0
            for i in range(3, len(raw)):
                out, p = set(), 1.0
                for k in (3, 2, 1, 0):
                    context = raw[i - k : i]
                    if k == 3 and seen.get(context, 0) < langid.LEAST:
                        continue
                    c = {b: n for b, n in trees[lang].get(context, {}).items() if b not in out}
                    n, q = sum(c.values()), len(c)
                    if not n:
                        continue
                    full = q == 256 - len(out)
                    if raw[i] in c:
                        p *= c[raw[i]] / (n + (0 if full else q))
                        break
                    p *= 0 if full else q / (n + q)
                    out |= set(c)
                else:
                    p /= 256 - len(out)
                total -= np.log2(p)
            assert abs(got[j] - total) < 0.02


def test_training_texts_are_bounded_in_all(spark, monkeypatch):
    held = []
    monkeypatch.setattr(toxicity, "fitted_on", lambda texts, labels, seed=7: held.append((texts, labels)))
    docs = spark.createDataFrame([(i, "w" * (10 + i)) for i in range(50)] + [(7, "z" * 900)] * 200, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, toxic int")
    toxicity.fitted(docs, labels, chars=1000)
    toxicity.fitted(docs, labels)
    (few, _), (every, y) = held
    assert 500 < sum(map(len, few)) <= 1000 and set(few) < set(every) and len(every) == 51 and set(y) == {0, 1}


def test_training_leaves_the_driver_alone(spark, monkeypatch):
    """The texts are trained on in a task, and the model is the one that their sorted list gives."""
    words = ["".join(chr(97 + (i * j) % 26) for j in range(3, 8)) for i in range(1, 60)]
    rows = [(i, " ".join(words[(i * k) % 59] for k in range(1, 30)) + (" vile" * 3 if i % 3 == 0 else "")) for i in range(120)] + [(5, "said twice")] * 2
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    sample = sorted({(i, int(i % 3 == 0), t) for i, t in rows})
    want = toxicity.fitted_on([t for _, _, t in sample], [y for _, y, _ in sample])

    def here(*_, **__):
        raise AssertionError("trained by the driver")

    monkeypatch.setattr(toxicity, "train", here)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = toxicity.fitted(docs.repartition(3), labels)
    assert np.allclose(got.weights, want.weights, atol=1e-6) and (got.bias, got.threshold) == pytest.approx((want.bias, want.threshold))  # BLAS has other threads there
    with pytest.raises(AssertionError, match="trained by the driver"):
        toxicity.fitted_on([t for _, _, t in sample], [y for _, y, _ in sample])
    monkeypatch.undo()
    none = toxicity.fitted(docs.limit(0), labels)
    assert none.bias == -10.0 and not none.weights.any()


def test_a_written_table_can_be_forgotten(spark):
    import os

    df = common.written(spark.range(3), "x")
    assert df.count() == 3 and os.path.exists(df.written_to.removeprefix("file:"))
    common.forget(df)
    assert not os.path.exists(df.written_to.removeprefix("file:"))


def test_without_a_shared_folder(spark, monkeypatch):
    class Other:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Other.conf)
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        common.shared_dir(Other)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter(F.length("text") > 60)
    found = langid.identified(docs.filter("doc_id % 2 = 1"), langid.fitted(docs.filter("doc_id % 2 = 0"))).collect()
    assert sum(r["lang"] == r["lang_found"] for r in found) / len(found) > 0.95


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_containment_by_rare_hashes_loses_no_pair(spark, least):
    rng = np.random.default_rng(int(least * 10))
    common_part = list(range(12))  # in all of the large ones
    large = {i: sorted({*common_part, *rng.integers(100, 400, rng.integers(0, 60)).tolist()}) for i in range(40)}
    small = {i: sorted({*common_part[: rng.integers(0, 5)], *rng.choice(large[i % 40], rng.integers(0, 9)).tolist(), *rng.integers(400, 450, rng.integers(0, 6)).tolist()}) for i in range(60)}
    frame = lambda d, n: spark.createDataFrame(list(d.items()), f"{n} int, sketch array<bigint>")
    got = {(r["s"], r["l"]): (r["shared"], r["containment"]) for r in fingerprint.containment(frame(small, "s"), frame(large, "l"), "s", "l", least).collect()}
    want = {(i, j): (len({*x} & {*y}), len({*x} & {*y}) / len(x)) for i, x in small.items() for j, y in large.items() if x and len({*x} & {*y}) >= least * len(x)}
    assert got == want and want
    rows = fingerprint.merged_rows(frame(large, "l").withColumn("g", F.col("l") % 3), "g").collect()
    assert sorted((r["g"], r["hash"]) for r in rows) == sorted({(i % 3, h) for i, x in large.items() for h in x})
