"""Toxicity: embeddings of character n-grams, averaged over a text, into a linear softmax.

A word is the bag of its character n-grams, each hashed to a row of an embedding table; a text
is the mean over its words. Table and softmax are trained jointly, in numpy, so that a
misspelling that was never seen scores like the words it shares n-grams with. As the model
is linear from n-gram to logit, scoring needs one number a bucket, and a word's is remembered.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache
from math import exp, log
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed

#: Labelled rows that are read to train on, toxic ones and clean ones: the documented bounds.
SAMPLE, CLEAN_SAMPLE = 2000, 6000
#: Characters of their texts, in all: further rows are left out whole.
SAMPLE_CHARS = 1 << 26
BUCKETS, DIM, LENGTHS = 1 << 17, 12, (3, 4, 5)
#: A text of fewer words is filled up with a word of its own, so that a few words of chance don't decide.
LEAST_WORDS, FILLER = 64, ""
#: A clean text rejected weighs as many toxic ones missed.
CLEAN_COUNTS = 5
#: Texts of which the words are counted at a time where the threshold is placed.
HELD_AT_ONCE = 100
#: Words of which the n-grams are found at a time, and rows of the table that are moved at a time.
WORDS_AT_ONCE, ROWS_AT_ONCE = 4000, 1 << 14
#: Distinct words of which a worker remembers the score.
CACHED_WORDS = 200_000
#: Punctuation that parts words like white space does.
MARKS = ".,;:!?\"()[]"

_P = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """Lower-case words."""
    if not text:
        return []
    text = text.lower()
    for m in MARKS:
        text = text.replace(m, " ")
    return text.split()


@lru_cache(maxsize=4096)
def damped(n: int) -> float:
    """The weight in a text's mean of a word that it has n times: a word said over and over doesn't make up the text."""
    return 1 + log(n)


def bags(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all the words' n-grams and of the words themselves, and the word each is of.

    Both ends of a word are marked, so that each has a gram at least.
    """
    raw = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    of = np.repeat(np.arange(len(words)), size)
    grams, who = [], []
    with np.errstate(over="ignore"):
        for n in LENGTHS:
            if len(raw) < n:
                continue
            h = np.full(len(raw) - n + 1, n, np.uint64)
            for j in range(n):
                h = h * _P + raw[j : len(raw) - n + 1 + j]
            inside = of[: len(h)] == of[n - 1 :]
            grams.append(h[inside])
            who.append(of[: len(h)][inside])
        place = np.arange(len(raw), dtype=np.uint64) - np.repeat(np.cumsum(size) - size, size).astype(np.uint64)
        starts = np.cumsum(size) - size
        grams.append(np.add.reduceat((raw + np.uint64(1)) * mixed(place + np.uint64(77)), starts) if len(words) else raw)
        who.append(np.arange(len(words)))
    return (mixed(np.concatenate(grams)) % np.uint64(buckets)).astype(np.int64), np.concatenate(who)


@dataclass(frozen=True)
class Model:
    """weights: what each bucket adds to the log odds, in the mean over a word's n-grams and a text's words."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.5

    def words(self, words: list[str]) -> np.ndarray:
        """What each word adds to the log odds, before it is divided by the number of words."""
        out = [np.empty(0)]
        for k in range(0, len(words), WORDS_AT_ONCE):
            part = words[k : k + WORDS_AT_ONCE]
            grams, who = bags(part, len(self.weights))
            out.append(np.bincount(who, self.weights[grams], len(part)) / np.bincount(who, minlength=len(part)))
        return np.concatenate(out)

    def probabilities(self, texts: list[str | None], known: dict[str, float] | None = None) -> list[float | None]:
        known = {} if known is None else known
        split = [Counter(tokens(t)) for t in texts]
        new = list(set().union(*split) - known.keys())
        values = dict(zip(new, self.words(new).tolist(), strict=True))
        if len(known) < CACHED_WORDS:
            known |= values
            get = known.__getitem__
        else:
            get = (known | values).__getitem__
        filler = float(self.words([FILLER])[0])
        out: list[float | None] = []
        for counts in split:
            weights = [*map(damped, counts.values())]
            n = sum(weights)
            margin = (sum(map(mul, map(get, counts), weights)) + max(LEAST_WORDS - n, 0) * filler) / max(n, LEAST_WORDS) + self.bias
            out.append(1 / (1 + exp(-min(max(margin, -60), 60))) if counts else None)
        return out


class Texts(Sequence[str]):
    """The texts of an Arrow column, each decoded when it is asked for: as strings they take up to four times the memory."""

    def __init__(self, column: pa.ChunkedArray):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, i: int) -> str:
        return self.column[i].as_py()


class Asked(Sequence):
    """A column of rows, in their order, that stays where Spark has it until it is asked for."""

    def __init__(self, rows: DataFrame, name: str):
        self.rows, self.name = rows, name

    @cached_property
    def values(self) -> list:
        return [r[0] for r in self.rows.select(self.name).collect()]

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, i: int):
        return self.values[i]


def train(texts: Iterable[str], labels: Iterable[int], buckets: int = BUCKETS, dim: int = DIM, epochs: int = 15, rate: float = 0.5, least_docs: int = 30, seed: int = 7) -> Model:
    """Joint training of the n-gram embeddings and the softmax by Adagrad on minibatches.

    Buckets seen in fewer than least_docs texts (fewer in small samples) stay at zero: they
    would fit chance alone. With two classes both classes' gradients are one's and its negative, so that what a bucket
    gets is a number times the difference of the output vectors, and a text's margin a sum of
    such numbers. Texts without words are left out. With one class only, the model answers that class.
    Of a text nothing is kept but the numbers of its words.
    """
    # a text is kept as numbers of words, and a word once as the buckets of its n-grams
    vocabulary: dict[str, int] = {}
    numbers, shares, ends, kept = array("i"), array("f"), [0], []
    for text, label in zip(texts, labels, strict=True):
        counts = Counter(tokens(text))
        if not counts:
            continue
        part = np.fromiter(map(damped, counts.values()), np.float32, len(counts))
        if part.sum() < LEAST_WORDS:
            counts[FILLER], part = 1, np.append(part, np.float32(LEAST_WORDS - part.sum()))
        numbers.extend(vocabulary.setdefault(w, len(vocabulary)) for w in counts)
        shares.frombytes((part / part.sum()).tobytes())
        ends.append(len(numbers))
        kept.append(int(label))
    y = np.array(kept, np.float64)
    if len(set(kept)) < 2:
        return Model(np.zeros(buckets, np.float32), 10.0 if kept and kept[0] == 1 else -10.0)
    numbers, shares, docs = np.frombuffer(numbers, np.int32), np.frombuffer(shares, np.float32), [*map(slice, ends, ends[1:])]
    words = list(vocabulary)
    del vocabulary
    size = np.array([sum(max(len(w) + 3 - n, 0) for n in LENGTHS) + 1 for w in words], np.int64)
    at = np.cumsum(size) - size
    grams = np.empty(size.sum(), np.int32)
    for k in range(0, len(words), WORDS_AT_ONCE):
        found, who = bags(words[k : k + WORDS_AT_ONCE], buckets)
        grams[at[k] : at[k] + len(found)] = found[np.argsort(who, kind="stable")]
    del words

    def spread(ids: np.ndarray) -> np.ndarray:
        """The buckets of words ids, word by word."""
        n = size[ids]
        places = np.repeat(at[ids] - np.cumsum(n) + n, n)
        places += np.arange(len(places))
        return grams[places]

    known = np.zeros(buckets, np.int64)
    for d in docs:
        known[np.unique(spread(numbers[d]))] += 1
    known = known >= max(1, min(least_docs, len(docs) // 200))
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.01, (buckets, dim)), rng.normal(0, 0.3, (dim, 2)), np.zeros(2)
    emb *= known[:, None]
    share = np.bincount(y.astype(int), minlength=2) / len(y)
    weight = 0.5 / share[y.astype(int)]
    gathered, slopes, biases = np.full(buckets, 1e-8), np.full(dim, 1e-8), 1e-8
    for epoch in range(epochs):
        step, turn = rate * (1 - epoch / epochs), rng.permutation(len(docs))
        for k in range(0, len(turn), 64):
            batch = turn[k : k + 64]
            own = [docs[i] for i in batch]
            ids = np.concatenate([numbers[d] for d in own])
            g, w = spread(ids), np.repeat(np.concatenate([shares[d] for d in own]) / size[ids], size[ids])
            length = np.add.reduceat(size[ids], np.cumsum([0, *(d.stop - d.start for d in own[:-1])]))
            toward = out[:, 1] - out[:, 0]
            margin = np.add.reduceat(w * (emb @ toward)[g], np.cumsum(length) - length) + bias[1] - bias[0]
            error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - y[batch]) * weight[batch]
            w *= np.repeat(error, length)
            pull = np.bincount(g, w, buckets) * known
            slope, lean = emb.T @ pull, error.sum()
            gathered += pull**2
            slopes += slope**2
            biases += lean**2
            moved = step * pull / np.sqrt(gathered)
            for j in range(0, buckets, ROWS_AT_ONCE):  # else a second table is held
                emb[j : j + ROWS_AT_ONCE] -= moved[j : j + ROWS_AT_ONCE, None] * toward
            out -= 0.1 * step * np.stack((-slope, slope), 1) / np.sqrt(slopes)[:, None]
            bias -= 0.1 * step * np.array([-lean, lean]) / np.sqrt(biases)
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, clean_sample: int = CLEAN_SAMPLE, seed: int = 7, chars: int = SAMPLE_CHARS) -> Model:
    """A model trained on at most `sample` toxic and `clean_sample` clean labelled rows, those with the least hashes of their ids.

    Of these only the first that have no more than `chars` characters together, and whole texts. Rows without a label, text or id don't take part; labels that contradict each other do,
    as they are. One task trains on these rows, and the driver gets the model alone.
    """
    known = labels.select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("int").alias("__y")).dropna().distinct()
    order = [F.xxhash64("__id"), "__id", "__y"]
    chosen = known.filter("__y = 0").orderBy(*order).limit(clean_sample).union(known.filter("__y = 1").orderBy(*order).limit(sample))
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t")).dropna().join(F.broadcast(chosen), "__id")
    # an id may be on any number of rows: the task that trains gets what the bound leaves
    running = F.sum(F.length("__t").cast("bigint")).over(Window.orderBy(*order, F.xxhash64("__t")).rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("__n", running).filter(F.col("__n") <= chars).select("__id", "__y", "__t").distinct().orderBy("__id", "__y", "__t").coalesce(1)
    return fitted_on(Asked(found, "__t"), Asked(found, "__y"), seed)


def fitted_in_a_task(rows: DataFrame, texts: str, labels: str, seed: int) -> Model:
    """fitted_on() of the rows of a table that is one partition, in a worker: the driver holds neither texts nor what training needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        column = pa.chunked_array([b.column(0) for b in parts], None if parts else pa.string())
        m = fitted_on(Texts(column), [y for b in parts for y in b.column(1).to_pylist()], seed)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias], pa.float64()), pa.array([m.threshold], pa.float64())], names=["weights", "bias", "threshold"])

    found = rows.select(texts, labels).mapInArrow(run, "weights binary, bias double, threshold double").first()
    if found is None:  # a table found to be empty runs no task
        return fitted_on([], [], seed)
    return Model(np.frombuffer(bytes(found["weights"]), np.float32), found["bias"], found["threshold"])


def fitted_on(texts: Sequence[str], labels: Sequence[int], seed: int = 7) -> Model:
    """train() on three quarters of the rows; the rest place the threshold.

    It makes the share of toxic texts missed and CLEAN_COUNTS times that of clean texts
    rejected least. Texts are asked for one by one, or HELD_AT_ONCE, so that they needn't be held as strings; those
    that Spark has are trained on there.
    """
    if isinstance(texts, Asked):
        return fitted_in_a_task(texts.rows, texts.name, labels.name, seed)
    order = np.random.default_rng(seed).permutation(len(texts))
    held = np.sort(order[: len(order) // 4]).tolist()
    rest = np.sort(order[len(order) // 4 :]).tolist()
    model = train((texts[i] for i in rest), (labels[i] for i in rest), seed=seed)
    odds: dict[int, list[float]] = {0: [], 1: []}
    known: dict[str, float] = {}
    for k in range(0, len(held), HELD_AT_ONCE):
        part = held[k : k + HELD_AT_ONCE]
        for i, p in zip(part, model.probabilities([texts[i] for i in part], known), strict=True):
            if p is not None:
                odds[labels[i]].append(float(np.log(max(p, 1e-12) / max(1 - p, 1e-12))))
    threshold = 0.0
    if len(odds[0]) >= 20 and len(odds[1]) >= 20:
        at = np.unique(odds[0] + odds[1])
        cuts = (at[1:] + at[:-1]) / 2
        missed = np.searchsorted(np.sort(odds[1]), cuts) / len(odds[1])
        wrong = 1 - np.searchsorted(np.sort(odds[0]), cuts) / len(odds[0])
        cost = missed + CLEAN_COUNTS * wrong
        threshold = float(np.median(cuts[cost <= cost.min() + 1e-9]))
    return Model(model.weights, model.bias, 1 / (1 + exp(-threshold)))


_known: dict[tuple, dict[str, float]] = {}


def scored(docs: DataFrame, model: Model, text_col: str = "text", score: str = "toxic_score", flag: str = "toxic") -> DataFrame:
    """docs with the probability of toxicity and whether it reaches the model's threshold.

    Every row stays, in one pass without a shuffle. A text of fewer than LEAST_WORDS words is
    scored as if filled up to that with a neutral one, in training as well. A text without words (null, empty, marks
    only) has a null score and isn't toxic. The two names replace columns that have them.
    """
    names = [c for c in docs.columns if c not in (score, flag)]
    held = docs.sparkSession.sparkContext.broadcast(model)
    key = (float(model.weights.sum(dtype=np.float64)), model.bias, model.threshold)
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(score, T.DoubleType()), T.StructField(flag, T.BooleanType())])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        if key not in _known:
            _known.clear()  # a worker serves one model at a time
        known = _known.setdefault(key, {})
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                p = m.probabilities([None if t is None else str(t) for t in part.column(at).to_pylist()], known)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64()), pa.array([x is not None and x >= m.threshold for x in p], pa.bool_())], names=[*names, score, flag])

    return docs.select(*names).mapInArrow(run, schema)
