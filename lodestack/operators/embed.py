"""Vectors of texts by an encoder that the caller gives, and their similarity to queries.

An encoder takes a list of texts and gives a matrix, a row a text. It runs in tasks, a batch of texts at a time; ENCODERS
holds those that come along, by name. A model served elsewhere, or one on the worker's disk, is an encoder as
well; vectors that a table has already need none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[list[str]], np.ndarray]
#: Bytes of code that a document's text holds; texts that are encoded at a time; queries that are held.
SHOWN, TEXTS, QUERIES = 1200, 256, 4096


def hashed(dim: int = 64) -> Encoder:
    """An encoder that is no model: words and their letter trigrams, hashed to signed places."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                for gram in {word, *(f"<{word}>"[i : i + 3] for i in range(len(word)))}:
                    h = crc32(gram.encode("utf-8", "surrogatepass"))
                    row[h % dim] += 1 if h >> 16 & 1 else -1
        return out

    return encode


ENCODERS: dict[str, Encoder] = {"hash-64": hashed(64), "hash-256": hashed(256)}


def encoder(given: str | Encoder | None) -> Encoder | None:
    """An encoder by its name, or as it is."""
    if isinstance(given, str):
        if given not in ENCODERS:
            raise ValueError(f"no encoder {given!r}; there are {', '.join(sorted(ENCODERS))}")
        return ENCODERS[given]
    return given


def document_text(qname: Column, signature: Column, docstring: Column, code: Column) -> Column:
    """What is encoded of a symbol: its name, signature and docstring, a line each, and the first bytes of its code (binary)."""
    return F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in (qname, signature, docstring)), F.coalesce(F.decode(F.substring(code, F.lit(1), F.lit(SHOWN)), "UTF-8"), F.lit("")))


def normalised(v: np.ndarray) -> np.ndarray:
    """Rows over their lengths as 32-bit numbers; zero rows stay."""
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(n > 0, n, 1)).astype(np.float32)


def embedded(rows: DataFrame, key: str, text: str, encode: Encoder) -> DataFrame:
    """key, v: each row's vector of length 1; null texts count as empty ones."""
    schema = T.StructType([rows.schema[key], T.StructField("v", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part = b.slice(lo, TEXTS)
                v = normalised(np.asarray(encode([t or "" for t in part.column(1).to_pylist()])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel()))], names=[key, "v"])

    return rows.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


def similarities(vectors: DataFrame, queries: DataFrame, encode: Encoder, query_key: str = "query_id", query: str = "query", key: str = "key") -> DataFrame:
    """query_id, key, similarity of every query that isn't empty to all vectors (key, v), which stay where they lie.

    Queries are a stated set; they are collected, encoded once and held, QUERIES at a time.
    """
    asked = [(r[0], r[1]) for r in queries.select(query_key, query).collect() if r[1]]
    schema = T.StructType([queries.schema[query_key], vectors.schema[key], T.StructField("similarity", T.DoubleType())])
    out = queries.sparkSession.createDataFrame([], schema)
    for i in range(0, len(asked), QUERIES):
        some = asked[i : i + QUERIES]
        q = normalised(np.asarray(encode([t for _, t in some]))).astype(np.float64)

        def run(batches: Iterator[pa.RecordBatch], q=q, names=[k for k, _ in some]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, TEXTS):
                    part = b.slice(lo, TEXTS)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    s = q @ x.T
                    at = np.tile(np.arange(part.num_rows), len(names))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(names)), part.num_rows)).cast(pa.int64()), part.column(0).take(pa.array(at)), pa.array(s.ravel())], names=["q", key, "similarity"])

        found = vectors.select(key, "v").mapInArrow(run, T.StructType([T.StructField("q", T.LongType()), *schema.fields[1:]]))
        names = queries.sparkSession.createDataFrame([(j, k) for j, (k, _) in enumerate(some)], T.StructType([T.StructField("q", T.LongType()), queries.schema[query_key]]))
        out = out.union(found.join(F.broadcast(names), "q").select(query_key, key, "similarity"))
    return out
