"""Lexical scores of a table of queries against a table of documents.

Queries and documents are (key, array of tokens). Queries are a stated set: they are collected and
held in blocks, and documents pass them where they lie. A pass that counts the queries' terms comes first,
one row a term and task; then a batch of documents against a block of queries is one matrix product.
No posting is sent anywhere, and of a top-k report only what may be in it leaves a task.
A single query is a table of one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import rounded

#: Queries that a pass over the documents takes; of a block; documents of a matrix product.
AT_ONCE, QUERIES, DOCS = 4096, 256, 256


class _Asked:
    """The terms of some queries, and how often each query has them."""

    def __init__(self, rows: list[tuple]):
        self.keys = [k for k, _ in rows]
        self.terms = list(dict.fromkeys(t for _, ts in rows for t in ts))
        self.values = pa.array(self.terms, pa.string())
        of = {t: i for i, t in enumerate(self.terms)}
        self.blocks = []
        for lo in range(0, len(rows), QUERIES):
            own = [[of[t] for t in ts] for _, ts in rows[lo : lo + QUERIES]]
            used = np.unique(np.array([t for ts in own for t in ts], np.int64))
            times = np.zeros((len(used), len(own)))
            for q, ts in enumerate(own):
                np.add.at(times, (np.searchsorted(used, ts), q), 1)
            self.blocks.append((lo, used, times))

    def places(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row's tokens that are terms, the row and the term; the number of tokens of each row. For DOCS rows at a time: the numbers take more room than the texts."""
        n = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        term = pc.index_in(tokens.flatten(), value_set=self.values.cast(tokens.type.value_type)).fill_null(-1).to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        return row[term >= 0], term[term >= 0].astype(np.int64), n

    def products(self, row: np.ndarray, term: np.ndarray, n: np.ndarray, lo: int, hi: int, idf: np.ndarray, average: float, k1: float, b: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block: its first query, and of the rows lo to hi the terms' counts, the queries' and the scores."""
        i, j = np.searchsorted(row, (lo, hi))
        length = np.maximum(n[lo:hi], 1)
        for first, used, times in self.blocks:
            at = np.searchsorted(used, term[i:j])
            mine = at < len(used)
            mine[mine] = used[at[mine]] == term[i:j][mine]
            tf = np.bincount((row[i:j][mine] - lo) * len(used) + at[mine], minlength=(hi - lo) * len(used)).reshape(hi - lo, len(used)).astype(float)
            part = idf[used] * tf * (k1 + 1) / (tf + (k1 * (1 - b + b * length / average))[:, None])
            yield first, tf, times, part @ times

    def scores(self, *given) -> Iterator[tuple[int, np.ndarray]]:
        return ((first, score) for first, _, _, score in self.products(*given))


def _asked(queries: DataFrame, query_key: str, tokens: str, every: bool) -> list[_Asked]:
    rows = [(r[0], r[1] or []) for r in queries.select(query_key, tokens).collect()]
    rows = [r for r in rows if r[1] or every]
    return [_Asked(rows[i : i + AT_ONCE]) for i in range(0, len(rows), AT_ONCE)]


def _counted(docs: DataFrame, asked: _Asked, tokens: str) -> tuple[np.ndarray, int, float, float]:
    """In how many documents each term is; the number of documents; their mean length, and that where empty ones count 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, totals = np.zeros(len(asked.terms), np.int64), np.zeros(3, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, DOCS):
                row, term, n = asked.places(b.column(0).slice(lo, DOCS))
                pairs = np.unique(row * len(asked.terms) + term)
                df += np.bincount(pairs % max(1, len(asked.terms)), minlength=len(df))
                totals += (len(n), n.sum(), np.maximum(n, 1).sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, [-1, -2, -3]))), pa.array(np.concatenate((df[at], totals)))], names=["t", "n"])

    found = {r["t"]: r["n"] for r in docs.select(tokens).mapInArrow(run, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(len(asked.terms))
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    n = found.get(-1, 0)
    return df, n, found.get(-2, 0) / max(n, 1), found.get(-3, 0) / max(n, 1)


def _scored(docs: DataFrame, asked: _Asked, idf: np.ndarray, average: float, k1: float, b: float, names: tuple[str, str], kind: T.DataType, tokens: str, keep: list[str], every: bool, top: int | None, slack: np.ndarray | None, over: np.ndarray | None) -> DataFrame:
    """query key, doc key, keep, score of the pairs that share a term, or of all; with top, what may be among each query's best, given how far scores may move.

    over: each query's number that its scores are divided by.
    """
    query_key, doc_key = names
    columns = [doc_key, *keep]
    schema = T.StructType([T.StructField(query_key, kind), *(docs.schema[c] for c in columns), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pa.array(asked.keys, to_arrow_type(kind))
        held: list[tuple[np.ndarray, list[pa.Array], np.ndarray]] = []
        many, kth = 0, np.full(len(asked.keys), -np.inf)

        def batch(q: np.ndarray, docs_of: list[pa.Array], s: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys.take(pa.array(q)), *docs_of, pa.array(s)], names=[query_key, *columns, "score"])

        def pruned() -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
            q, s = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
            docs_of = [pa.concat_arrays([h[1][c] for h in held]) for c in range(len(columns))]
            by = np.lexsort((-s, q))
            start = np.flatnonzero(np.concatenate(([True], q[by][1:] != q[by][:-1])))
            last = np.minimum(start + top, np.append(start[1:], len(q))) - 1
            full = last - start == top - 1
            kth[q[by][start[full]]] = s[by][last[full]]
            ok = s >= kth[q] - slack[q]
            if every:
                # pairs without a common term are all alike: the first keys among them are enough
                place_of, none = np.empty(len(s), np.int64), s == 0
                place_of[pc.sort_indices(docs_of[0]).to_numpy()] = np.arange(len(s))
                by = np.lexsort((place_of, q, ~none))[: none.sum()]
                start = np.flatnonzero(np.concatenate(([True], q[by][1:] != q[by][:-1])))
                place = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
                ok[by[place >= top]] = False
            ok = np.flatnonzero(ok)
            return q[ok], [c.take(pa.array(ok)) for c in docs_of], s[ok]

        for x in batches:
            for lo in range(0, x.num_rows, DOCS):
                row, term, n = asked.places(x.column(len(columns)).slice(lo, DOCS))
                for first, tf, times, score in asked.products(row, term, n, 0, len(n), idf, average, k1, b):
                    some = np.ones(score.shape, bool) if every else (tf > 0).astype(np.float32) @ (times > 0).astype(np.float32) > 0
                    if over is not None:
                        score = score / over[first : first + score.shape[1]]
                    if top is not None:
                        mine_q = slice(first, first + score.shape[1])
                        some &= score >= (kth - slack)[mine_q]
                    d, q = np.nonzero(some)
                    if not len(d):
                        continue
                    made = (q + first, [x.column(c).take(pa.array(d + lo)) for c in range(len(columns))], score[d, q])
                    if top is None:
                        yield batch(*made)
                        continue
                    held.append(made)
                    many += len(d)
                    if many > 4 * top * len(asked.keys) + (1 << 16):
                        held = [pruned()]
                        many = len(held[0][0])
        if held:
            yield batch(*pruned())

    return docs.select(*columns, tokens).mapInArrow(run, schema)


def _united(parts: list[DataFrame], queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, keep: list[str]) -> DataFrame:
    if not parts:
        schema = T.StructType([queries.schema[query_key], *(docs.schema[c] for c in (doc_key, *keep)), T.StructField("score", T.DoubleType())])
        return queries.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        parts[0] = parts[0].union(p)
    return parts[0]


def bm25(queries: DataFrame, docs: DataFrame, query_key: str = "query_id", doc_key: str = "doc_id", k1: float = 1.2, b: float = 0.75, normalise: bool = True, tokens: str = "tokens", keep: list[str] | None = None, every: bool = False, top: int | None = None, digits: int = 6) -> DataFrame:
    """query key, doc key, keep, score: BM25 with idf ln((N - df + 0.5) / (df + 0.5) + 1), over the query's best score if normalise.

    Documents without a term of the query, empty queries and empty corpora have no rows (score
    0); with every, all pairs have one. keep: columns of docs that come along. With top, rows that can't be among the `top` best of
    their query are left out, also if scores are rounded to `digits`.
    """
    keep, parts = keep or [], []
    for asked in _asked(queries, query_key, tokens, every):
        df, n, _, average = _counted(docs, asked, tokens)
        if not n:
            continue
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
        most = np.zeros(len(asked.keys))
        for first, used, times in asked.blocks:
            most[first : first + times.shape[1]] = (idf[used] * (k1 + 1)) @ times
        one = lambda every, top, slack, over: _scored(docs, asked, idf, average, k1, b, (query_key, doc_key), queries.schema[query_key].dataType, tokens, keep, every, top, slack, over)  # noqa: B023, E731
        over = None
        if normalise and top is None:
            best = {r[0]: r[1] for r in one(False, 1, np.zeros(len(most)), None).groupBy(query_key).agg(F.max("score")).collect()}
            over = np.array([best.get(k) or 1.0 for k in asked.keys])
        # no score is over `most`, so that rounding moves none by more than this part of it
        found = one(every, top, None if top is None else 1.1 * 10.0**-digits * (np.maximum(most, 1e-300) if normalise else np.ones(len(most))), over)
        if normalise and top is not None:
            best = F.max("score").over(Window.partitionBy(query_key))
            found = found.withColumn("score", F.when(best > 0, F.col("score") / best).otherwise(0.0))
        parts.append(found)
    return _united(parts, queries, docs, query_key, doc_key, keep)


def ranks_of(queries: DataFrame, docs: DataFrame, chosen: DataFrame, query_key: str = "query_id", doc_key: str = "doc_id", k1: float = 1.2, b: float = 0.75, tokens: str = "tokens", digits: int = 6) -> DataFrame:
    """query key, doc key, score, rank: where chosen documents (doc key: whole numbers, a list that the driver may hold) stand among all in each query's ranking.

    Ranks count from 0, by normalised BM25 rounded to `digits`, ties by key, documents without a common term among them. A pass scores the chosen
    ones, and another counts for each how many go before it: no ranking is put together.
    """
    scale, kind = 10.0**digits, queries.schema[query_key].dataType
    schema = T.StructType([queries.schema[query_key], docs.schema[doc_key], T.StructField("score", T.DoubleType()), T.StructField("rank", T.LongType())])
    out = []
    for asked in _asked(queries, query_key, tokens, True):
        df, n, _, average = _counted(docs, asked, tokens)
        if not n:
            continue
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
        one = lambda docs, every, top, slack: _scored(docs, asked, idf, average, k1, b, (query_key, doc_key), kind, tokens, [], every, top, slack, None)  # noqa: B023, E731
        best = {r[0]: r[1] for r in one(docs, False, 1, np.zeros(len(asked.keys))).groupBy(query_key).agg(F.max("score")).collect()}
        over = np.array([best.get(k) or 1.0 for k in asked.keys])
        at = {k: i for i, k in enumerate(asked.keys)}
        marks: list[tuple[np.ndarray, np.ndarray]] = []
        rows = one(docs.join(F.broadcast(chosen.select(doc_key)), doc_key, "left_semi").select(doc_key, tokens), True, None, None).toArrow()
        q = np.array([at[k] for k in rows.column(0).to_pylist()], np.int64)
        key, whole = rows.column(1).to_numpy(), np.floor(rows.column(2).to_numpy() / over[q] * scale + 0.5).astype(np.int64)
        for i in range(len(asked.keys)):
            own = np.flatnonzero(q == i)
            own = own[np.lexsort((key[own], -whole[own]))]
            marks.append((-whole[own], key[own]))

        def count(batches: Iterator[pa.RecordBatch], asked=asked, idf=idf, average=average, over=over, marks=marks) -> Iterator[pa.RecordBatch]:
            before = [np.zeros(len(m[0]) + 1, np.int64) for m in marks]
            for x in batches:
                ids = x.column(0).to_numpy()
                for lo in range(0, x.num_rows, DOCS):
                    row, term, size = asked.places(x.column(1).slice(lo, DOCS))
                    for first, score in asked.scores(row, term, size, 0, len(size), idf, average, k1, b):
                        whole = -np.floor(score / over[first : first + score.shape[1]] * scale + 0.5).astype(np.int64)
                        for j in range(whole.shape[1]):
                            values, keys = marks[first + j]
                            own, key = whole[:, j], ids[lo : lo + DOCS]
                            place, end = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                            tied = np.flatnonzero(place < end)  # of marks with the same score those with a larger key come after
                            for v in np.unique(own[tied]).tolist():
                                some = tied[own[tied] == v]
                                place[some] += np.searchsorted(keys[place[some[0]] : end[some[0]]], key[some], "right")
                            before[first + j] += np.bincount(place, minlength=len(values) + 1)
            for i, (n, m) in enumerate(zip(before, marks, strict=True)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m[1]), i)), pa.array(m[1].astype(np.int64)), pa.array(np.cumsum(n)[:-1])], names=["q", "key", "n"])

        found = docs.select(doc_key, tokens).mapInArrow(count, "q bigint, key bigint, n bigint").groupBy("q", "key").agg(F.sum("n").alias("n"))
        known = queries.sparkSession.createDataFrame([(asked.keys[i], i, int(k), -int(v) / scale) for i, (vs, ks) in enumerate(marks) for v, k in zip(vs, ks, strict=True)], T.StructType([queries.schema[query_key], T.StructField("q", T.LongType()), T.StructField("key", T.LongType()), T.StructField("score", T.DoubleType())]))
        out.append(found.join(known, ["q", "key"]).select(query_key, F.col("key").cast(docs.schema[doc_key].dataType).alias(doc_key), "score", F.col("n").alias("rank")))
    if not out:
        return queries.sparkSession.createDataFrame([], schema)
    for p in out[1:]:
        out[0] = out[0].union(p)
    return out[0]


def okapi(queries: DataFrame, docs: DataFrame, query_key: str = "query_id", doc_key: str = "doc_id", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, tokens: str = "tokens", keep: list[str] | None = None, every: bool = False, top: int | None = None, digits: int = 6) -> DataFrame:
    """query key, doc key, keep, score: Okapi BM25; a term in over half of the documents weighs epsilon times the mean idf of all terms.

    every, keep and top are those of bm25().
    """
    keep, parts, mean = keep or [], [], None
    for asked in _asked(queries, query_key, tokens, every):
        df, n, average, _ = _counted(docs, asked, tokens)
        if not n or not average:
            continue
        idf = np.log(n - df + 0.5) - np.log(df + 0.5)
        if mean is None:
            every_term = docs.select(F.explode(F.array_distinct(tokens)).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
            mean = every_term.agg(F.avg(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0] or 0.0
        idf = np.where(idf < 0, epsilon * mean, idf)
        parts.append(_scored(docs, asked, idf, average, k1, b, (query_key, doc_key), queries.schema[query_key].dataType, tokens, keep, every, top, None if top is None else np.full(len(asked.keys), 1.1 * 10.0**-digits), None))
    return _united(parts, queries, docs, query_key, doc_key, keep)


def top_k(scores: DataFrame, k: int, query_key: str = "query_id", doc_key: str = "doc_id", score: str = "score", digits: int = 6) -> DataFrame:
    """The k best of each query with their rank from 1; scores are rounded first, ties go by key."""
    order = Window.partitionBy(query_key).orderBy(F.desc(score), F.asc(doc_key))
    return scores.withColumn(score, rounded(F.col(score), digits)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
