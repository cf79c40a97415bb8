"""Approximate nearest neighbours: a hierarchical k-means tree, read best bin first.

The tree has two levels of k-means, fitted on a sample of the vectors that is bounded by the
number of leaves; leaves grow with the root of the number of vectors, up to what may be broadcast.
Every vector is put into its leaf, and large leaves are dealt into blocks. A query goes down the tree
by a priority queue: the nearest node not yet opened is next, be it a branch or a leaf, so that
leaves come in the order in which they are promising, and only the leaves of opened branches are
looked at. How many leaves every query visits is widened until the recall of a calibration
sample of the queries, measured against an exact search of all vectors, reaches its target.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Neighbours of each query; which ids are queries; recall that the calibration sample must reach, and its size (a documented bound).
K, EVERY, RECALL, CALIBRATION = 10, 50, 0.95, 512
#: Lloyd iterations a level; leaves relative to the root of the number of vectors; their most, and so the bound of what is broadcast.
ROUNDS, LEAVES, MOST_LEAVES = 8, 0.5, 1 << 16
#: Vectors that the tree is fitted on, for each leaf; those of a branch relative to its even share (documented bounds); vectors of a leaf that are searched at a time.
FITTED, MOST_FITTED, BLOCK = 32, 4, 1 << 14
#: Decimals of a similarity by which neighbours are ordered, ties by id.
DECIMALS = 6
#: What the hashes that choose samples are compared with.
_HASHES = 1 << 30


@dataclass
class Tree:
    """branches: centres of the first level; leaves: centres of the second; first[b]: where branch b's leaves begin."""

    branches: np.ndarray
    leaves: np.ndarray
    first: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that holds each vector: the nearest branch's nearest leaf."""
        b = nearest(x, self.branches)
        out = np.empty(len(x), np.int64)
        for k in np.unique(b):
            own = b == k
            out[own] = self.first[k] + nearest(x[own], self.leaves[self.first[k] : self.first[k + 1]])
        return out

    def order(self, q: np.ndarray, to_branch: np.ndarray) -> Iterator[int]:
        """The leaves, best bin first; a branch's leaves are looked at when the queue opens it. to_branch: distances to the branches."""
        queue = [(d, -1, b) for b, d in enumerate(to_branch.tolist())]
        heapq.heapify(queue)
        opened: dict[int, tuple[list[float], list[int]]] = {}
        while queue:
            _, at, b = heapq.heappop(queue)
            if at < 0:
                lo, hi = self.first[b], self.first[b + 1]
                d = distances(q[None], self.leaves[lo:hi])[0]
                by = np.argsort(d, kind="stable")
                opened[b] = (d[by].tolist(), (by + lo).tolist())
            else:
                yield opened[b][1][at]
            # of an opened branch the nearest leaf that is left waits in the queue
            if at + 1 < len(opened[b][0]):
                heapq.heappush(queue, (opened[b][0][at + 1], at + 1, b))

    def visits(self, x: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf): the first `most` leaves of each query, and more until they hold `least` vectors; held: how many each leaf has."""
        of, out = [], []
        to_branch = distances(x, self.branches)
        for i in range(len(x)):
            met = 0
            for n, leaf in enumerate(self.order(x[i], to_branch[i])):
                if n >= most and (held is None or met >= least):
                    break
                met += 0 if held is None else held[leaf]
                of.append(i)
                out.append(leaf)
        return np.array(of, np.int64), np.array(out, np.int64)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * (x @ centres.T), 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = distances(x[k : k + 4096], centres).argmin(1)
    return out


def centred(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k centres of vectors by Lloyd's iterations, from the first distinct ones."""
    _, first = np.unique(x, axis=0, return_index=True)
    c = x[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def units(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: vectors of length 1 as 32-bit numbers, written.

    Left out are null ids, null and empty vectors, those with a null or a number that isn't
    finite, and those with another than the most common number of dimensions among the rows left (ties: the
    larger). A zero vector stays zero. Of rows that share an id the first by vector counts.
    """
    one = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND size(v) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls come as nan
            size = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(size) - size
            bad = np.add.reduceat(~np.isfinite(flat), starts) > 0 if len(size) else np.empty(0, bool)
            scale = np.abs(np.where(np.isfinite(flat), flat, 0))
            top = np.maximum.reduceat(scale, starts) if len(size) else np.empty(0)
            flat = flat / np.repeat(np.where(top > 0, top, 1), size)  # so that squares neither vanish nor overflow
            norm = np.sqrt(np.add.reduceat(flat**2, starts)) if len(size) else np.empty(0)
            flat = (flat / np.repeat(np.where(norm > 0, norm, 1), size)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, size.sum()), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "v"]).filter(pa.array(~bad))

    made = written(one.mapInArrow(run, "id bigint, v array<float>"), "vectors-read")
    dims = made.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return written(made.filter(F.size("v") == (dims["d"] if dims else 0)).groupBy("id").agg(F.min("v").alias("v")), "vectors")


def _part(salt: int):
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(_HASHES))


def _sample(table: DataFrame, n: int, wanted: int, salt: int) -> DataFrame:
    """About `wanted` of a table's n rows, by the hashes of their ids; all if it has no more."""
    return table if wanted >= n else table.filter(_part(salt) < int(_HASHES * wanted / n))


def _first(rows: DataFrame, most: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of at most `most` rows, those with the least hashes."""
    t = rows.select("id", "v").orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(most).toArrow()
    return t.column("id").to_numpy(), _matrix(t.column("v")) if len(t) else np.empty((0, 0))


def grown(table: DataFrame, n: int, rounds: int = ROUNDS, leaves: float = LEAVES, most: int = MOST_LEAVES) -> Tree:
    """The tree of a table of n vectors.

    Branches are fitted on the driver on at most 2 x FITTED vectors each, their leaves by tasks, on FITTED
    vectors a leaf and no more than MOST_FITTED times that for a branch that holds more than its share.
    A branch has leaves in proportion to its share.
    """
    wanted = max(1, min(most, round(leaves * n**0.5)))
    some = _sample(table, n, FITTED * wanted, 1)
    b = max(1, round(wanted**0.5))
    branches = centred(_first(_sample(some, min(n, FITTED * wanted), 3 * FITTED * b, 2), 2 * FITTED * b, 2)[1], b, rounds)

    def dealt(batches: Iterator[pa.RecordBatch], keep: dict[int, float] | None = None) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = nearest(_matrix(x.column(1)), branches) if x.num_rows else np.empty(0, np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), x.column(0), x.column(1)], names=["b", "h", "v"])
            yield out if keep is None else out.filter(pa.array(x.column(0).to_numpy() < np.array([keep[k] for k in at.tolist()]) * _HASHES))

    hashed = some.select(_part(4).alias("h"), "v")
    share = {r["b"]: r["count"] for r in hashed.mapInArrow(dealt, "b int, h bigint, v array<float>").groupBy("b").count().collect()}
    total = sum(share.values())
    per = {k: max(1, round(wanted * c / total)) for k, c in share.items()}
    keep = {k: MOST_FITTED * FITTED * wanted / b / c for k, c in share.items()}

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h", kind="stable")
        c = centred(np.stack(rows["v"].tolist()).astype(np.float64), per[key[0]], rounds)
        return pd.DataFrame({"b": [key[0]] * len(c), "c": c.tolist()})

    kept = hashed.mapInArrow(lambda x: dealt(x, keep), "b int, h bigint, v array<float>")
    made = kept.groupBy("b").applyInPandas(fit, "b int, c array<double>").toArrow()
    of, centres = made.column("b").to_numpy(), _matrix(made.column("c"))
    parts = [centres[of == k] if (of == k).any() else branches[k : k + 1] for k in range(len(branches))]
    return Tree(branches, np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))))


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row of similarities: most similar first, ties by id; ids ascend."""
    if sims.shape[1] > 4 * k:
        # what may be among the best after rounding, ties included; few columns are left in all
        cut = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
        some = sims >= cut[:, None]
        most = int(some.sum(1).max())
        if most <= 4 * k:
            near = np.argsort(~some, axis=1, kind="stable")[:, :most]
            order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")[:, :k]
            return np.take_along_axis(near, order, 1)
    return np.argsort(-sims, axis=1, kind="stable")[:, :k]


def _similar(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, neighbour, similarity of the k best of x for each query, themselves left out; ids ascend."""
    sims = np.round(q @ x.T, DECIMALS)
    sims[q_ids[:, None] == ids[None]] = -np.inf
    top = _best(ids, sims, k)
    s = np.take_along_axis(sims, top, 1)
    ok = s > -np.inf
    return np.repeat(q_ids, top.shape[1]).reshape(top.shape)[ok], ids[top][ok], s[ok]


def exact(leaved: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> pa.Table:
    """query, neighbour, similarity, leaf: the true neighbours of a few queries, from all vectors (leaf, id, v).

    A task keeps the best that it has met so far for each query, and gives them at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.int64),) * 3 + (np.empty(0),)]
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                by = np.argsort(part.column(1).to_numpy(), kind="stable")
                ids, leaf, x = part.column(1).to_numpy()[by], part.column(0).to_numpy()[by], _matrix(part.column(2))[by]
                qi, di, s = _similar(q_ids, q, ids, x, k)
                held.append((qi, di, leaf[np.searchsorted(ids, di)].astype(np.int64), s))
                if len(held) > 16:
                    held = [best_of(held)]
        made = best_of(held)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["query", "neighbour", "leaf", "similarity"])

    def best_of(parts: list[tuple]) -> tuple:
        qi, di, leaf, s = (np.concatenate(c) for c in zip(*parts, strict=True))
        by = np.lexsort((di, -s, qi))
        qi, di, leaf, s = qi[by], di[by], leaf[by], s[by]
        start = np.flatnonzero(np.concatenate(([True], qi[1:] != qi[:-1]))) if len(qi) else np.empty(0, np.int64)
        place = np.arange(len(qi)) - np.repeat(start, np.diff(np.append(start, len(qi))))
        return qi[place < k], di[place < k], leaf[place < k], s[place < k]

    near = leaved.mapInArrow(run, "query bigint, neighbour bigint, leaf bigint, similarity double")
    return _nearest_rows(near, "query", k).toArrow()


def _nearest_rows(near: DataFrame, query: str, k: int) -> DataFrame:
    """The k best rows of each query with their rank from 1; all but k a partition are dropped before anything is sent."""
    order = Window.partitionBy(query).orderBy(F.desc("similarity"), "neighbour")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def calibrated(leaved: DataFrame, queries: DataFrame, n_queries: int, tree: Tree, k: int, recall: float, sample: int) -> int:
    """The least number of leaf visits at which the recall of a sample of the queries reaches the target."""
    q_ids, q = _first(_sample(queries, n_queries, 2 * sample, 5), sample, 5)
    if not len(q_ids):
        return 1
    truth = exact(leaved, q_ids, q, k)
    wanted: dict[int, list[int]] = {}
    for i, leaf in zip(truth.column("query").to_pylist(), truth.column("leaf").to_pylist(), strict=True):
        wanted.setdefault(i, []).append(leaf)
    hits = np.zeros(len(tree.leaves) + 1)
    to_branch = distances(q, tree.branches)
    for i, d in enumerate(q_ids.tolist()):
        left = dict.fromkeys(wanted.get(d, []), 0)
        for leaf in wanted.get(d, []):
            left[leaf] += 1
        for place, leaf in enumerate(tree.order(q[i], to_branch[i]) if left else ()):
            hits[place] += left.pop(leaf, 0)
            if not left:
                break
    return int(np.searchsorted(np.cumsum(hits) / hits.sum(), recall - 1e-12)) + 1 if hits.sum() else 1


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, recall: float = RECALL, calibration: int = CALIBRATION, leaves: float = LEAVES, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """vec_id, neighbour, rank (from 1), similarity (cosine): the k nearest others, among all vectors, of every query.

    Queries are the vectors whose id is divisible by `every`; 1 makes every vector one. Neighbours are in the
    order of similarity, ties by id. Which rows take part, units() says; a
    zero vector is as similar (0) to all others. Fewer than k others give fewer rows; an empty
    table, or one without a query, none. Other columns are left aside.
    """
    spark = vectors.sparkSession
    table = units(vectors, id_col, vector_col)
    n = table.count()
    asked = table.filter(F.pmod("id", F.lit(every)) == 0)
    n_queries = asked.count()
    if n < 2 or not n_queries:
        return spark.createDataFrame([], "vec_id bigint, neighbour bigint, rank int, similarity double")
    held = spark.sparkContext.broadcast(grown(table, n, leaves=leaves))  # at most MOST_LEAVES leaves

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = held.value.leaf_of(_matrix(b.column(1))) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0), b.column(1)], names=["leaf", "id", "v"])

    leaved = written(table.mapInArrow(put, "leaf int, id bigint, v array<float>"), "leaves")
    visits = calibrated(leaved, asked, n_queries, held.value, k, recall, calibration)
    sizes = np.zeros(len(held.value.leaves), np.int64)
    for r in leaved.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    blocks = -(-sizes // block)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                q, leaf = held.value.visits(_matrix(part.column(1)), visits, sizes, k + 1)
                times = blocks[leaf]  # a leaf in blocks is asked block by block
                first = np.repeat(np.cumsum(times) - times, times)
                index = pa.array(np.repeat(q, times))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(leaf, times).astype(np.int32)), pa.array((np.arange(times.sum()) - first).astype(np.int32)), pa.array(np.ones(int(times.sum()), np.int32)), part.column(0).take(index), part.column(1).take(index)], names=["leaf", "block", "kind", "id", "v"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(1).to_numpy() % blocks[b.column(0).to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array(np.zeros(len(at), np.int32)), b.column(2), b.column(3)], names=["leaf", "block", "kind", "id", "v"])

    schema = "leaf int, block int, kind int, id bigint, v array<float>"
    rows = leaved.select("leaf", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("h"), "id", "v").mapInArrow(deal, schema).union(asked.mapInArrow(ask, schema))
    rows = rows.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, xs, x = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            mark = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(3)], 1)
            cut = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(1)) + 1).tolist(), len(mark)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                part = b.slice(lo, hi - lo)
                now = tuple(mark[lo, :2].tolist())
                if now != at:
                    at, ids, xs, x = now, [], [], None
                own, v = part.column(3).to_numpy(), _matrix(part.column(4))
                if not mark[lo, 2]:
                    ids.append(own)
                    xs.append(v)
                    continue
                if not ids:
                    continue
                if x is None:
                    held_ids, x = np.concatenate(ids), np.concatenate(xs)
                for k0 in range(0, len(v), 256):
                    made = _similar(own[k0 : k0 + 256], v[k0 : k0 + 256], held_ids, x, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["vec_id", "neighbour", "similarity"])

    near = rows.mapInArrow(search, "vec_id bigint, neighbour bigint, similarity double")
    return _nearest_rows(near, "vec_id", k).select("vec_id", "neighbour", F.col("rank").cast("int").alias("rank"), "similarity")
