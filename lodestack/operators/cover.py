"""How much of each query every text covers, term by term as substrings.

Terms are identifiers, so a term lies in a text where it lies in one of the text's runs of word
characters. A worker looks up the substrings of each distinct run once; a batch of texts against
a block of queries is then one matrix product. All pairs come out, also those that cover nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries of a block, texts of a step, runs whose terms a worker remembers.
QUERIES, TEXTS, REMEMBERED = 256, 256, 1 << 18
_RUN = re.compile("[a-z0-9_]+")


class Terms:
    """The terms of a block of queries."""

    def __init__(self, queries: list[tuple[int, list[str]]], distinct: bool):
        self.ids = np.array([q for q, _ in queries], np.int64)
        wanted = [list(dict.fromkeys(t)) if distinct else t for _, t in queries]
        self.of = {t: i for i, t in enumerate(dict.fromkeys(t for ts in wanted for t in ts))}
        self.sizes = sorted({len(t) for t in self.of})
        self.n = np.array([len(t) for t in wanted])
        self.times = np.zeros((len(self.of), len(queries)), np.float32)
        for k, ts in enumerate(wanted):
            for t in ts:
                self.times[self.of[t], k] += 1
        self.known: dict[str, tuple[int, ...]] = {}

    def within(self, run: str) -> tuple[int, ...]:
        found = self.known.get(run)
        if found is None:
            found = tuple({i for m in self.sizes if m <= len(run) for k in range(len(run) - m + 1) if (i := self.of.get(run[k : k + m])) is not None})
            if len(self.known) < REMEMBERED:
                self.known[run] = found
        return found

    def covered(self, texts: list[str | None]) -> np.ndarray:
        """texts x queries: the share of each query's terms; 0 for queries without terms."""
        has = np.zeros((len(texts), len(self.of)), np.float32)
        for row, text in zip(has, texts, strict=True):
            for run in set(_RUN.findall(text or "")):
                row[list(self.within(run))] = 1
        return (has @ self.times).astype(np.float64) / np.maximum(self.n, 1)


def coverage(texts: DataFrame, queries: DataFrame, distinct: bool = True, least: float | None = None) -> DataFrame:
    """query_id, key, coverage of every text (key, text) by every query (query_id, tokens) that has tokens.

    With least, the pairs that pass the gate instead: covered to at least that, or of a query
    without tokens. Queries are collected; texts are read once and not sent anywhere.
    """
    asked = [(r["query_id"], r["tokens"]) for r in queries.select("query_id", "tokens").collect()]
    if least is None:
        asked = [x for x in asked if x[1]]
    held = texts.sparkSession.sparkContext.broadcast([asked[i : i + QUERIES] for i in range(0, len(asked), QUERIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Terms(x, distinct) for x in held.value]
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                keys, low = b.column(0).slice(i, TEXTS), b.column(1).slice(i, TEXTS).to_pylist()
                for block in blocks:
                    share = block.covered(low)
                    d, q = np.nonzero((share >= least) | (block.n == 0) if least is not None else np.ones_like(share, bool))
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), keys.take(pa.array(d)), pa.array(share[d, q])], names=["query_id", "key", "coverage"])

    return texts.select(F.col("key").cast("bigint").alias("key"), F.lower("text").alias("text")).mapInArrow(run, "query_id bigint, key bigint, coverage double")
