"""What several operators share: written intermediate tables, tokenisation, rolling hashes."""

from __future__ import annotations

import base64
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter of ids: what is broadcast has at most this size.
FILTER_BITS = 1 << 28
#: The default vocabulary; every operator that tokenises takes another path as a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split of text before byte-pair merges that the vocabularies were made for.
SPLIT = r"""'(?:[sdmt]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one on one machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        found = tempfile.mkdtemp(prefix="lodestack-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a written() table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Words:
    """Byte-pair tokens of whole texts; a text that holds a special token's name is ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.n_ids = max(ranks.values()) + 1
        self.kind, self.dtype = ("H", np.dtype("u2")) if self.n_ids <= 1 << 16 else ("I", np.dtype("u4"))
        self.encode = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(array(self.kind, self.encode(text) if text else ()), self.dtype)

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) if text else 0


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    """One per Python worker and vocabulary."""
    return Words(path)


def with_token_counts(df: DataFrame, text_col: str, out: str, tokenizer: str = TOKENIZER, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all but the text by default) and the exact number of tokens of text_col; null and empty texts have 0."""
    from pyspark.sql import types as T

    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = words_of(tokenizer).count
        for b in batches:
            n = pa.array([count(t.as_py()) for t in b.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, out])

    return df.select(*keep, df[text_col].cast("string").alias("__text")).mapInArrow(run, schema)


def token_count(text_col: str, tokenizer: str = TOKENIZER) -> Column:
    """The exact number of tokens of a column beside others that needn't reach Python; null and empty texts have 0."""
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        count = words_of(tokenizer).count
        return pa.array([count(t.as_py()) for t in texts], pa.int64())

    return run(F.col(text_col).cast("string"))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalising bit mixer of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64))


def word_gram_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams.

    Words are runs without white space, in lower case. A text of fewer than n words has one
    gram, of all its words; a text without words has none. Hashes of byte ranges come from
    one running polynomial sum, so that the cost doesn't depend on n.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    raw = np.frombuffer((" ".join(words) + " ").encode(), np.uint8)
    ends = np.flatnonzero(raw == 32)
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    n = min(n, len(ends))
    size = 1 << max(16, int(len(raw)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_byte_values()[raw] * up[: len(raw)], out=total[1:])
        a, b = starts[: len(starts) - n + 1], ends[n - 1 :]
        return np.unique(mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)))


def filter_of_ids(ids: DataFrame, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """For numbers that tasks see, which of them may be among ids (id, n of them): a Bloom filter of 16 bits an id, FILTER_BITS at most.

    It saves what a join after it would send, and decides nothing. From about 20 million ids on
    it lets more through, and in the end all: what it stands before is then shuffled whole, once.
    """
    words = 1 << max(4, min(FILTER_BITS.bit_length() - 1, (16 * max(n, 1)).bit_length()) - 6)

    def places(c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = mixed(c.astype(np.int64).view(np.uint64) + np.uint64(97))
            return np.stack([mixed(h + np.uint64(k)) & np.uint64(words * 64 - 1) for k in range(4)])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = places(b.column(0).to_numpy()).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["w", "b"])

    found = ids.select("id").mapInArrow(bits, "w int, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(words, np.uint64)
    table[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    held = ids.sparkSession.sparkContext.broadcast(table)

    def may_be(c: np.ndarray) -> np.ndarray:
        at = places(c)
        return ((held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(0)

    return may_be


def among(df: DataFrame, known: Callable[[np.ndarray], np.ndarray], col: str) -> DataFrame:
    """The rows of df whose col a filter_of_ids() lets through; nulls don't pass."""

    @F.arrow_udf("boolean")
    def may_be(c: pa.Array) -> pa.Array:
        return pa.array(known(c.fill_null(0).to_numpy(zero_copy_only=False)) & c.is_valid().to_numpy(zero_copy_only=False))

    return df.filter(may_be(F.col(col)))
