"""The ten operators against brute force, exact round trips and held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import ann, chat, common, fingerprint, langid, linededup, mixing, ngramjoin, packing, toxicity, wavelet
from lodestack.llm.common import word_gram_hashes, words_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("n", [0, 1, 7, 300_000])
def test_wavelet_matrix_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(max=50_000).astype(np.uint16)
    lengths = np.array([n // 3, 0, n - n // 3])
    w = wavelet.WaveletShard(wavelet.build(ids, [5, None, 6], lengths))
    assert (w.tokens() == ids).all()
    for i in range(0, n, max(1, n // 40)):
        assert w.access(i) == ids[i]
    for t in [*set(ids[:5].tolist()), 49_999, 60_000]:
        at = np.flatnonzero(ids == t)
        assert w.count(t) == len(at) and w.rank(t, n // 2) == (at < n // 2).sum()
        assert [w.select(t, k) for k in range(min(5, len(at)))] == at[:5].tolist()


def test_wavelet_shards_count_and_find_tokens(spark, docs, texts):
    shards = wavelet.wavelet_shards(docs.repartition(3), shard_tokens=20_000)
    want, places = Counter(), Counter()
    for d, t in texts.items():
        ids = words_of(wavelet.TOKENIZER).ids(t).tolist()
        want.update(ids)
        places.update((x, d, i) for i, x in enumerate(ids))
    some = [x for x, _ in want.most_common(3)] + [x for x, n in want.items() if n == 1][:3]
    assert {r["token"]: r["n"] for r in wavelet.token_counts(shards, some).collect()} == {x: want[x] for x in some}
    got = {(r["token"], r["doc_id"], r["place"]) for r in wavelet.token_places(shards, some[3:]).collect()}
    assert got == {p for p in places if p[0] in some[3:]}


def fewest(sizes, capacity):
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in {b for b in bins if b + sizes[i] <= capacity}:
            k = bins.index(room)
            bins[k] += sizes[i]
            go(i + 1, bins)
            bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_bin_completion_is_optimal():
    rng, beaten = random.Random(1), 0
    for _ in range(400):
        capacity = rng.choice([20, 50, 100])
        sizes = [rng.randint(max(1, capacity // 8), capacity * 2 // 3) for _ in range(rng.randint(0, 13))]
        bins, proven = packing.pack(sizes, capacity, 100_000)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
        assert proven and len(bins) == fewest(sizes, capacity)
        beaten += len(packing.best_fit(sizes, capacity)) > len(bins)
    assert beaten > 5


def test_packing_holds_every_token_once(docs, texts):
    rows = packing.packed(docs, capacity=256, group=64).collect()
    tokens, used = Counter(), Counter()
    for r in rows:
        tokens[r["doc_id"]] += r["n_tokens"]
        used[r["bin"]] += r["n_tokens"]
    assert tokens == {d: words_of(packing.TOKENIZER).count(t) for d, t in texts.items()}
    assert max(n for b, n in used.items() if b is not None) <= 256
    assert len([b for b in used if b is not None]) <= sum(tokens.values()) / 256 * 1.03 + 4


def test_sketch_of_a_union_and_containment(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    d = spark.createDataFrame([(1, " ".join(words), "g"), (2, " ".join(words[5000:9000]), "g"), (3, " ".join(words[100:300]), "h")], "doc_id bigint, text string, g string")
    s = fingerprint.sketches(d).join(d.select("doc_id", "g"), "doc_id").cache()
    by = {r["doc_id"]: r for r in s.collect()}
    assert abs(len(by[1]["sketch"]) / by[1]["n_shingles"] - fingerprint.FRACTION) < 0.01
    merged = {r["g"]: r["sketch"] for r in fingerprint.merge(s, "g").collect()}
    assert merged["g"] == sorted(set(by[1]["sketch"]) | set(by[2]["sketch"]))
    got = fingerprint.containment(s.filter("doc_id > 1"), s.filter("doc_id = 1"), "doc_id", "doc_id").collect()
    assert {(r["doc_id"], r["containment"]) for r in got} == {(2, 1.0), (3, 1.0)}


def true_neighbours(ids, x, k=10):
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sims = np.round(x @ x.T, ann.DECIMALS)
    np.fill_diagonal(sims, -2)
    return {d: ids[np.lexsort((ids, -sims[i]))[:k]].tolist() for i, d in enumerate(ids.tolist())}


def recall_of(got, want):
    found = {}
    for r in got.collect():
        found.setdefault(r["vec_id"], []).append(r["neighbour"])
    assert all(len(v) == 10 for v in found.values())
    return found, np.mean([len(set(want[d]) & set(v)) / 10 for d, v in found.items()])


def test_neighbours_recall(spark):
    for sf, every in (("0.001", 1), ("0.1", 50)):
        e = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
        rows = e.collect()
        ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
        found, recall = recall_of(ann.neighbours(e, every=every), true_neighbours(ids, x))
        assert set(found) == {d for d in ids.tolist() if d % every == 0} and recall >= 0.94


def test_neighbours_where_vectors_lie_in_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres[rng.integers(0, 40, 2000)] + 0.1 * rng.normal(size=(2000, 16)), np.repeat(centres[:1], 1000, 0)]).astype(np.float32)  # a third are copies
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(5)
    found, recall = recall_of(ann.neighbours(e, block=128), true_neighbours(np.arange(3000), x.astype(float)))
    assert len(found) == 60 and recall >= 0.94
    table = ann.units(e, "vec_id", "embedding")
    tree = ann.grown(table, 3000)
    assert ann.calibrated(table.select(F.lit(0).alias("leaf"), "id", "v"), table, 3000, ann.Tree(tree.branches[:1], tree.leaves[:1], np.array([0, 1])), 10, 0.95, 50) == 1


def test_best_bin_first_visits_all_leaves_in_order_of_a_queue():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    tree = ann.Tree(x[:4], x[4:20], np.array([0, 4, 8, 12, 16]))
    of, order = tree.visits(x[100:110], 16)
    order = order.reshape(10, 16)
    assert (of == np.repeat(np.arange(10), 16)).all() and (np.sort(order, 1) == np.arange(16)).all()
    assert (tree.visits(x[100:110], 5)[1].reshape(10, 5) == order[:, :5]).all()
    held = np.arange(16)
    of, some = tree.visits(x[100:110], 2, held, 20)
    for i in range(10):
        n = (of == i).sum()
        assert some[of == i].tolist() == order[i, :n].tolist() and n >= 2 and held[order[i, :n]].sum() >= 20 and (n == 2 or held[order[i, : n - 1]].sum() < 20)
    # by brute force: of all nodes whose parent is open, the nearest
    for i in range(10):
        d = lambda c, q=x[100 + i]: float(((c - q) ** 2).sum())
        open_nodes, want = {("b", b): d(tree.branches[b]) for b in range(4)}, []
        while open_nodes:
            kind, at = min(open_nodes, key=open_nodes.get)
            del open_nodes[kind, at]
            if kind == "b":
                open_nodes |= {("l", j): d(tree.leaves[j]) for j in range(tree.first[at], tree.first[at + 1])}
            else:
                want.append(at)
        assert order[i].tolist() == want


def test_toxicity_held_out_and_misspelled(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = d.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").orderBy("doc_id").collect()
    train, held = [r for i, r in enumerate(rows) if i % 4], rows[::4]
    m = toxicity.train([r["text"] for r in train], [r["toxic"] for r in train], epochs=10)
    p = m.probabilities([r["text"] for r in held])
    y = [r["toxic"] for r in held]
    pos, neg = [a for a, b in zip(p, y) if b and a is not None], [a for a, b in zip(p, y) if not b and a is not None]
    auc = np.mean([[a > b for b in neg] for a in pos])
    assert auc > 0.9
    rng = random.Random(2)
    plain = ["the cat sat on a warm mat in the sunny garden today", "we read long books about rivers and old stone bridges"]
    bad = ["you horrible stinkmonster go away", "what a stinkmonster this horrible person is"]
    texts = [" ".join(rng.sample(t.split(), min(6, len(t.split())))) for t in (plain + bad) * 60]
    m = toxicity.train(texts, [0, 0, 1, 1] * 60)
    low, seen, unseen = m.probabilities(["the sunny garden", "stinkmonster", "stinkmonsterr"])
    assert low < unseen and low < seen and unseen - low > 0.5 * (seen - low)


def test_mixture_meets_targets_with_least_entropy(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "word " * int(rng.integers(1, 400)), ["a", "b", "c"][int(rng.choice(3, p=[0.7, 0.2, 0.1]))], ["x", "y"][int(rng.integers(2))]) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    share, lang = {"a": 0.4, "b": 0.3, "c": 0.3}, {"x": 0.5, "y": 0.5}
    got = mixing.mixture(d, source_share=share, lang_share=lang).toPandas()
    read = got.n_tokens * got.rate
    total = got.n_tokens.sum()
    for col, want in (("source", share), ("lang", lang)):
        for k, p in want.items():
            assert abs(read[got[col] == k].sum() / total - p) < 2e-3
            assert abs((got.n_tokens * got.copies)[got[col] == k].sum() / total - p) < 0.03
    assert abs(got.copies - got.rate).max() < 1
    # the optimum's form: log rates are a source's number plus a language's plus a multiple of log length
    z = np.stack([*(got.source == k for k in share), *(got.lang == k for k in lang), np.log(got.n_tokens)], 1).astype(float)
    fit = np.linalg.lstsq(z, np.log(got.rate), rcond=None)[0]
    assert abs(z @ fit - np.log(got.rate)).max() < 1e-6
    none = mixing.mixture(d, source_share={"a": 1.0}).toPandas()
    assert none[none.source != "a"].copies.sum() == 0
    copies = mixing.mixed_copies(d, source_share=share, lang_share=lang).groupBy("doc_id").count().toPandas()
    assert dict(zip(copies.doc_id, copies["count"])) == dict(zip(got[got.copies > 0].doc_id, got[got.copies > 0].copies))


def lines_kept(texts, known=()):
    """Brute force: the texts without lines seen before."""
    seen, out = set(known), {}
    for d in sorted(texts):
        kept = []
        for line in texts[d].split("\n"):
            if line.strip(" ") and line.strip(" ") in seen:
                continue
            seen.add(line.strip(" "))
            kept.append(line)
        out[d] = "\n".join(kept)
    return out, seen


def test_cuckoo_filter_never_forgets_what_it_holds():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    f = linededup.CuckooFilter.from_bytes(linededup.filter_of(h[:15_000]).to_bytes())
    assert f.may_have(h[:15_000]).all() and f.may_have(h[15_000:]).mean() < 0.01
    f.drop(h[:5000])
    assert f.may_have(h[5000:15_000]).all() and f.may_have(h[:5000]).mean() < 0.01
    f.add(h[:5000])
    assert f.may_have(h[:15_000]).all()


def test_line_dedup_in_batches_and_back(spark, docs, texts):
    texts = {d: t or "" for d, t in texts.items()}
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicated(docs).collect()}
    assert got == lines_kept(texts)[0]
    cut = sorted(texts)[len(texts) // 2]
    first, second = docs.filter(F.col("doc_id") <= cut), docs.filter(F.col("doc_id") > cut)
    store, _ = linededup.LineStore.empty(3).inserted(first)
    both, lost = store.inserted(second)
    got = {r["doc_id"]: r["text"] for r in linededup.without_lines(second, lost).collect()}
    assert got == {d: t for d, t in lines_kept(texts)[0].items() if d > cut}
    # a document that goes takes its lines along: the next one keeps them
    again = both.deleted(second)
    assert sorted(map(tuple, again.refs.select("h", "n").collect())) == sorted(map(tuple, store.refs.select("h", "n").collect()))
    _, lost = again.inserted(second)
    assert {r["doc_id"]: r["text"] for r in linededup.without_lines(second, lost).collect()} == got
    gone = both.deleted(first)
    _, lost = gone.inserted(first)
    left = {r["doc_id"]: r["text"] for r in linededup.without_lines(first, lost).collect()}
    seen = {line.strip(" ") for d, t in texts.items() if d > cut for line in t.split("\n") if line.strip(" ")}
    assert left == lines_kept({d: t for d, t in texts.items() if d <= cut}, seen)[0]


def test_chat_round_trip_of_anything():
    rng = random.Random(3)
    parts = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "\n", "\\n", "\\\\n", "\\", "a", "<", "|", "user", "|>", ""]
    escaped = 0
    for _ in range(20_000):
        turns = [("".join(rng.choices(parts, k=rng.randint(0, 4))), "".join(rng.choices(parts, k=rng.randint(0, 5)))) for _ in range(rng.randint(0, 4))]
        text, n, _ = chat.rendered(turns)
        assert chat.parse(text) == turns
        escaped += n
    assert escaped > 1000
    plain = [("user", "Is 1 < 2 | 3 > 2?\nYes\\no"), ("assistant", "ok")]
    assert chat.rendered(plain)[1:] == (0, 1)


def code_length(samples, text):
    """Brute force: partial matching, order 3, escapes by method C with exclusion."""
    counts = {}
    data = langid.START + langid.START.join(s.encode() for s in samples)
    for i in range(3, len(data)):
        for k in range(4):
            counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
    raw, total = langid.START + text.encode(), 0.0
    for i in range(3, len(raw)):
        out, p = set(), 1.0
        for k in (3, 2, 1, 0):
            c = {b: n for b, n in counts.get(raw[i - k : i], {}).items() if b not in out}
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
    return total


def test_language_code_lengths_and_held_out_accuracy(spark, docs):
    trees = langid.grown({"u": ["abracadabra", "a cab"], "v": ["zürich über"]}, least=1)
    got = langid.Scorer(trees).lengths(["abra zü", "q", None, ""]) / langid.UNIT
    for j, s in enumerate((["abracadabra", "a cab"], ["zürich über"])):
        for i, t in enumerate(["abra zü", "q"]):
            assert abs(got[i, j] - code_length(s, t)) < 0.01
    assert (got[2:] == 0).all()
    train, held = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1 AND length(text) > 80")
    found = langid.identified(held, langid.fitted(train)).collect()
    assert sum(r["lang"] == r["lang_found"] for r in found) / len(found) > 0.95


def jaccard_brute(texts, n=3, least=0.5):
    sets = {d: set(word_gram_hashes(t, n).tolist()) for d, t in texts.items()}
    out = {}
    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= least * max(len(sets[a]), len(sets[b])):
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= least:
                    out[a, b] = j
    return out


def near_copies():
    rng = random.Random(9)
    out = {}
    for size in (4, 12, 40, 150, 900):
        for base in range(4):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            for copy in range(6):
                w = list(words)
                for _ in range(round(size * 0.02 * copy)):
                    w[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
                out[len(out)] = " ".join(w)
    return out


def classes_brute(texts):
    """{document: (class, copies, links)} from all pairs."""
    sets = {d: frozenset(word_gram_hashes(t, 3).tolist()) for d, t in texts.items()}
    root, links = {x: x for x in texts}, Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in jaccard_brute(texts):
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
        if sets[a] != sets[b]:
            links.update((a, b))
    copies = Counter(x for x in sets.values() if x)
    return {x: (top(x), copies[sets[x]] or 1, links[x]) for x in texts}


def found_classes(df):
    return {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in df.collect()}


def test_jaccard_join_finds_near_copies(spark, docs, texts):
    for given in (texts, near_copies()):
        d = docs if given is texts else spark.createDataFrame(list(given.items()), "doc_id bigint, text string")
        want = classes_brute(given)
        assert found_classes(ngramjoin.classes(d)) == want and any(n for _, _, n in want.values())
        assert {r["doc_id"] for r in ngramjoin.deduplicated(d).collect()} == {x for x in given if want[x][0] == x}
        pairs, members = ngramjoin.jaccard_pairs(d)
        rep = {r["doc_id"]: r["rep"] for r in members.collect()}
        wanted = {(a, b): x for (a, b), x in jaccard_brute(given).items() if rep[a] == a and rep[b] == b}
        assert {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in pairs.collect()} == pytest.approx(wanted, abs=1e-12)


def at_the_threshold(size, rng, subset):
    """Two texts of about size grams with a Jaccard index just at 0.5: one within the other, or of one size."""
    words = [f"w{rng.randrange(10**7)}" for _ in range(size + 2)]
    if subset:
        return " ".join(words), " ".join(words[: (size + 1) // 2 + 2])
    return " ".join(words), " ".join(words[: size * 2 // 3 + 3] + [f"x{rng.randrange(10**7)}" for _ in range(size // 3 - 2)])


def test_no_link_is_lost_at_the_threshold(spark):
    rng, given = random.Random(6), {}
    for size in (20, 40, 64, 100, 127, 128, 200, 255, 256, 300, 500, 511, 512, 800, 1500, 5000):
        for k in range(60 if size < 1000 else 20):
            for t in at_the_threshold(size, rng, k % 2):
                given[len(given)] = t
    sets = {d: set(word_gram_hashes(t, 3).tolist()) for d, t in given.items()}
    want = {(a, a + 1) for a in range(0, len(given), 2) if len(sets[a] & sets[a + 1]) >= 0.5 * len(sets[a] | sets[a + 1])}
    assert len(want) == len(given) // 2
    pairs, _ = ngramjoin.jaccard_pairs(spark.createDataFrame(list(given.items()), "doc_id bigint, text string"))
    found = pairs.collect()
    assert {(r["doc_a"], r["doc_b"]) for r in found} == want and max(r["jaccard"] for r in found) < 0.6


@pytest.mark.parametrize("size", [60, 400])
def test_many_alike_in_one_segment_are_compared_in_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(ngramjoin, "BLOCK", 50)
    monkeypatch.setattr(ngramjoin, "CELL", 40)
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(size)]
    given = {}
    for k in range(160):
        w = list(words)
        for _ in range(1 + k // 12):
            w[rng.randrange(size)] = f"x{k}"
        given[k] = " ".join(w)
    want = classes_brute(given)
    assert found_classes(ngramjoin.classes(spark.createDataFrame(list(given.items()), "doc_id bigint, text string"))) == want and sum(n for _, _, n in want.values()) > 3000


def test_intersections_by_pairs_and_by_one_product():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert ngramjoin.alike(sets, a, b) == pytest.approx(want) and ngramjoin.alike(sets, a[:50], b[:50]) == pytest.approx(want[:50])


def test_a_full_filter_passes_everything(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 10)
    known = common.filter_of_ids(spark.range(5000).select("id"), 5000)
    rows = spark.range(4000, 9000).withColumn("id", F.when(F.col("id") % 100 > 0, F.col("id")))
    assert {r["id"] for r in common.among(rows, known, "id").collect()} >= {x for x in range(4000, 5000) if x % 100}


def test_forest_has_the_same_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    got = {r["id"]: r["root"] for r in ngramjoin.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
