"""Language ID by prediction by partial matching over bytes.

Each language has a tree of the byte contexts that its sample holds, up to three bytes long.
A byte is coded in the longest context there is; a byte not seen in it costs an escape (method
C: as probable as there are distinct successors) and is coded in the next shorter one, where
the successors already ruled out don't count; at the end all bytes left are alike. Statistics
are frozen after training, so that the code length of a byte depends on its context alone: all
of them are laid out in a table, and a text's exact code length is a sum of look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents read for each language: the documented bound.
SAMPLE = 400
ORDER = 3
#: A context of full length is in the trees if the samples hold it so often.
LEAST = 12
#: Code lengths are whole numbers of this part of a bit.
UNIT = 1 << 12
#: What stands before a text's first byte.
START = b"\n" * ORDER
#: Bytes that are scored at a time.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Trees:
    """contexts[k]: sorted keys of the contexts of k bytes; counts[language][k]: (context, byte, count) rows."""

    languages: tuple[str, ...]
    contexts: tuple[np.ndarray, ...]
    counts: tuple[tuple[np.ndarray, ...], ...]


def _keys(data: np.ndarray, k: int) -> np.ndarray:
    """The key of the k bytes before each place from ORDER on."""
    key = np.zeros(len(data) - ORDER, np.int64)
    for j in range(k, 0, -1):
        key = key << 8 | data[ORDER - j : len(data) - j]
    return key


def grown(samples: dict[str, list[str]], least: int = LEAST) -> Trees:
    """The trees of each language's texts."""
    languages = tuple(sorted(samples))
    pairs: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in languages:
        data = np.frombuffer(START + START.join(t.encode() for t in samples[lang]), np.uint8).astype(np.int64)
        pairs.append([np.unique(_keys(data, k) << 8 | data[ORDER:], return_counts=True) for k in range(ORDER + 1)])
    contexts = []
    for k in range(ORDER + 1):
        key = np.concatenate([p[k][0] >> 8 for p in pairs]) if pairs else np.empty(0, np.int64)
        n = np.concatenate([p[k][1] for p in pairs]) if pairs else np.empty(0, np.int64)
        found, inverse = np.unique(key, return_inverse=True)
        contexts.append(found[np.bincount(inverse, n, len(found)) >= (least if k == ORDER else 1)])
    counts = tuple(tuple(np.stack((p[k][0] >> 8, p[k][0] & 255, p[k][1]), 1) for k in range(ORDER + 1)) for p in pairs)
    return Trees(languages, tuple(contexts), counts)


class Scorer:
    """The tables of all contexts: state of each three bytes, code length of each byte in each state."""

    def __init__(self, trees: Trees):
        self.languages = trees.languages
        size = [len(c) for c in trees.contexts]
        first = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        # the state of three bytes is that of their longest end that is a context
        state = np.zeros(1, np.int64)
        for k in range(1, ORDER + 1):
            state = np.tile(state, 256)
            state[trees.contexts[k]] = first[k] + np.arange(size[k])
        self.state = state.astype(np.uint16 if first[-1] < 1 << 16 else np.int32)
        self.cost = np.empty((int(first[-1]), 256, len(trees.languages)), np.int32)
        for j, rows in enumerate(trees.counts):
            dense = []
            for k in range(ORDER + 1):
                at = np.searchsorted(trees.contexts[k], rows[k][:, 0])
                at = np.minimum(at, max(size[k] - 1, 0))
                in_it = trees.contexts[k][at] == rows[k][:, 0] if size[k] else np.zeros(len(at), bool)
                table = np.zeros((size[k], 256), np.float32)
                table[at[in_it], rows[k][in_it, 1]] = rows[k][in_it, 2]
                dense.append(table)
            for k in range(ORDER + 1):
                for lo in range(0, size[k], 2048):
                    key = trees.contexts[k][lo : lo + 2048]
                    self.cost[first[k] + lo : first[k] + lo + len(key), :, j] = self._lengths(trees, dense, k, key)

    @staticmethod
    def _lengths(trees: Trees, dense: list[np.ndarray], k: int, key: np.ndarray) -> np.ndarray:
        p = np.zeros((len(key), 256))
        seen = np.zeros((len(key), 256), bool)
        mass = np.ones(len(key))
        for i in range(k, -1, -1):
            rows = dense[i][np.searchsorted(trees.contexts[i], key & ((1 << 8 * i) - 1))] * ~seen
            here = rows > 0
            n, q = rows.sum(1), here.sum(1)
            all_left = q == 256 - seen.sum(1)  # nothing is left to escape to
            share = np.where(n > 0, mass / np.maximum(n + np.where(all_left, 0, q), 1), 0)
            p += rows * share[:, None]
            mass = np.where(n > 0, np.where(all_left, 0, q * share), mass)
            seen |= here
        left = 256 - seen.sum(1)
        p += ~seen * (mass / np.maximum(left, 1))[:, None]
        return np.rint(-np.log2(p) * UNIT).astype(np.int32)

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Code length of each text in each language, in units; 0 of null and empty ones."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        if not self.languages:
            return out
        flat = self.cost.reshape(-1, len(self.languages))
        held: list[tuple[int, bytes]] = []
        n = 0

        def score() -> None:
            data = np.frombuffer(START + START.join(b for _, b in held), np.uint8)
            key = data[:-ORDER].astype(np.int32) << 16 | data[1 : 1 - ORDER].astype(np.int32) << 8 | data[2 : 2 - ORDER]
            cost = flat[self.state[key].astype(np.int64) << 8 | data[ORDER:]]
            size = np.array([len(b) for _, b in held])
            starts = np.cumsum(size + ORDER) - size - ORDER
            bounds = np.stack((starts, starts + size), 1).ravel()[: 2 * len(held) - 1]
            for j in range(len(self.languages)):
                sums = np.add.reduceat(cost[:, j], bounds, dtype=np.int64)[::2]
                np.add.at(out[:, j], [i for i, _ in held], sums)

        for i, t in enumerate(texts):
            if not t:
                continue
            raw = t.encode("utf-8", "surrogatepass")
            # a very long text is scored in parts, each with the bytes before it
            if len(raw) > 4 * CHUNK:
                out[i] = self._long(raw)
                continue
            held.append((i, raw))
            n += len(raw)
            if n >= CHUNK:
                score()
                held, n = [], 0
        if held:
            score()
        return out

    def _long(self, raw: bytes) -> np.ndarray:
        total = np.zeros(len(self.languages), np.int64)
        flat = self.cost.reshape(-1, len(self.languages))
        raw = START + raw
        for k in range(ORDER, len(raw), CHUNK):
            data = np.frombuffer(raw[k - ORDER : k + CHUNK], np.uint8)
            key = data[:-ORDER].astype(np.int32) << 16 | data[1 : 1 - ORDER].astype(np.int32) << 8 | data[2 : 2 - ORDER]
            total += flat[self.state[key].astype(np.int64) << 8 | data[ORDER:]].sum(0, dtype=np.int64)
        return total


def fitted(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Trees:
    """Trees of at most `sample` labelled documents a language, those with the least hashes of their ids.

    Rows without a language, a text or an id don't take part. Only these rows reach the driver.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("__l"), F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t"))
    ids = rows.filter("__l IS NOT NULL AND __id IS NOT NULL AND __t <> ''").select("__l", "__id")
    order = Window.partitionBy("__l").orderBy(F.xxhash64("__id"), "__id")
    chosen = ids.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= sample).select("__l", "__id").distinct()
    found = rows.filter("__t <> ''").join(F.broadcast(chosen), ["__l", "__id"]).distinct().collect()
    samples: dict[str, list[str]] = {}
    for r in sorted((r["__l"], r["__id"], r["__t"]) for r in found):
        samples.setdefault(r[0], []).append(r[2])
    return grown(samples)


_tables: dict[object, Scorer] = {}


def identified(docs: DataFrame, trees: Trees, text_col: str = "text", out: str = "lang_found", bits: str = "bits_per_byte", margin: str = "margin_bits") -> DataFrame:
    """docs with the language of the shortest code, its bits a byte, and by how many bits in all the next one is longer.

    Every row stays, in one pass without a shuffle; ties go to the language first by name. A
    null or empty text, or trees of no language, give nulls; with one language the margin is
    null. The three names replace columns that have them.
    """
    names = [c for c in docs.columns if c not in (out, bits, margin)]
    held = docs.sparkSession.sparkContext.broadcast(trees)
    key = (trees.languages, *(int(c.sum()) for c in trees.contexts), *(int(r[:, 2].sum()) for rows in trees.counts for r in rows))
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(out, T.StringType()), T.StructField(bits, T.DoubleType()), T.StructField(margin, T.DoubleType())])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if trees_used := held.value.languages:
            if key not in _tables:
                _tables.clear()  # a worker serves one set of trees at a time
            scorer = _tables.get(key) or _tables.setdefault(key, Scorer(held.value))
        for b in batches:
            texts = [None if t is None else str(t) for t in b.column(at).to_pylist()]
            if not trees_used:
                none = [pa.nulls(len(texts), t) for t in (pa.string(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *none], names=[*names, out, bits, margin])
                continue
            n = scorer.lengths(texts)
            best = n.argmin(1)
            ordered = np.sort(n, 1)
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            row = list(zip(best.tolist(), ordered[:, 0].tolist(), (ordered[:, 1] - ordered[:, 0]).tolist() if n.shape[1] > 1 else [None] * len(n), size, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([scorer.languages[k] if s else None for k, _, _, s in row]), pa.array([x / UNIT / s if s else None for _, x, _, s in row], pa.float64()), pa.array([m / UNIT if s and m is not None else None for _, _, m, s in row], pa.float64())],
                schema=pa.schema([*b.schema, pa.field(out, pa.string()), pa.field(bits, pa.float64()), pa.field(margin, pa.float64())]),
            )

    return docs.select(*names).mapInArrow(run, schema)
