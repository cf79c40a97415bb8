"""Token IDs as wavelet matrices: one compressed file per shard with access, counting and occurrence lookup.

A wavelet matrix keeps a sequence of ids as one bit-plane per bit of the largest id. At each
plane the sequence is split stably into those with a 0 and those with a 1, so that walking the
planes with rank gives any token back, and counts or finds one token's places, in as many
steps as there are planes. Planes are stored in blocks that are compressed on their own, each
with the number of ones before it and, within it, a directory of the ones before every 512 bits: a
lookup unpacks one block a plane, and counts the ones of eight words at most.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER, words_of

MAGIC = b"WVM2"
#: Bytes of a plane that are compressed together; bits between two entries of a block's directory.
BLOCK, STEP = 1 << 15, 512
SCHEMA = "shard string, n_docs bigint, n_tokens bigint, n_bytes bigint, payload binary"


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, level: int = 1) -> bytes:
    """The file of one shard: ids of all its documents in a row."""
    pack = zstandard.ZstdCompressor(level=level).compress
    planes = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    parts, zeros, sizes, ones = [], [], [], []
    for bit in range(planes - 1, -1, -1):
        on = (ids & ids.dtype.type(1 << bit)) != 0
        raw = np.packbits(on, bitorder="little")
        at, own = 0, []
        for k in range(0, len(raw), BLOCK):
            own.append(at)
            words = _words(raw[k : k + BLOCK])
            steps = np.add.reduceat(np.bitwise_count(words).astype(np.int64), np.arange(0, len(words), STEP // 64))
            at += int(steps.sum())
            before = (np.cumsum(steps) - steps).astype("<u4")
            parts.append(pack(before.tobytes() + words.tobytes()))
            sizes.append(len(parts[-1]))
        ones.append(own)
        zeros.append(len(ids) - at)
        ids = np.concatenate((ids[~on], ids[on]))
    nulls = [i for i, d in enumerate(doc_ids) if d is None]
    head = json.dumps({"n": len(ids), "planes": planes, "zeros": zeros, "ones": ones, "docs": len(doc_ids), "nulls": nulls}).encode()
    tables = [pack(x) for x in (head, np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.asarray(lengths, "<u4").tobytes(), np.array(sizes, "<u4").tobytes())]
    return b"".join((MAGIC, struct.pack("<4I", *map(len, tables)), *tables, *parts))


def _words(raw: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, filled up with zeros."""
    return np.frombuffer(raw.tobytes().ljust(-(-len(raw) // 8) * 8, b"\0"), "<u8")


class WaveletShard:
    """One shard's file, opened: nothing but the blocks that a lookup touches is unpacked."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        unpack = zstandard.ZstdDecompressor().decompress
        at, tables = 20, []
        for n in struct.unpack("<4I", payload[4:20]):
            tables.append(unpack(payload[at : at + n]))
            at += n
        head = json.loads(tables[0])
        self.n, self.planes, self.zeros, self._ones = head["n"], head["planes"], head["zeros"], head["ones"]
        nulls = set(head["nulls"])
        self.doc_ids = [None if i in nulls else int(d) for i, d in enumerate(np.frombuffer(tables[1], "<i8"))]
        self.starts = np.concatenate(([0], np.cumsum(np.frombuffer(tables[2], "<u4").astype(np.int64))))
        ends = np.cumsum(np.frombuffer(tables[3], "<u4").astype(np.int64)) + at
        self._blocks = np.concatenate(([at], ends))
        self._payload, self._unpack, self._kept = payload, unpack, {}

    def _block(self, plane: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ones before every STEP bits of a block, and its words."""
        key = plane * len(self._ones[0]) + k
        if key not in self._kept:
            raw = self._unpack(self._payload[self._blocks[key] : self._blocks[key + 1]])
            n = min(BLOCK * 8, self.n - k * BLOCK * 8)
            steps = -(-(-(-n // 64)) // (STEP // 64))
            self._kept[key] = np.frombuffer(raw, "<u4", steps), np.frombuffer(raw, "<u8", offset=4 * steps)
        return self._kept[key]

    def _bit(self, plane: int, i: int) -> int:
        k, rest = divmod(i, BLOCK * 8)
        return int(self._block(plane, k)[1][rest >> 6]) >> (rest & 63) & 1

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the plane's first i bits."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        k, rest = divmod(i, BLOCK * 8)
        before, words = self._block(plane, k)
        at, whole = rest // STEP, rest >> 6
        found = self._ones[plane][k] + int(before[at]) + int(np.bitwise_count(words[at * (STEP // 64) : whole]).sum())
        return found + (int(words[whole]) & ((1 << (rest & 63)) - 1)).bit_count() if rest & 63 else found

    def _walked(self, plane: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits at many places, and the ones before each."""
        bits, ones = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        block, rest = at // (BLOCK * 8), at % (BLOCK * 8)
        for k in np.unique(block).tolist():
            own = block == k
            words, r = self._block(plane, k)[1], rest[own]
            count = np.bitwise_count(words).astype(np.int64)
            low = words[r >> 6] & ((np.uint64(1) << (r & 63).astype(np.uint64)) - np.uint64(1))
            bits[own] = (words[r >> 6] >> (r & 63).astype(np.uint64)) & np.uint64(1)
            ones[own] = self._ones[plane][k] + (np.cumsum(count) - count)[r >> 6] + np.bitwise_count(low)
        return bits, ones

    def _tokens_at(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), np.uint32)
        for p in range(self.planes):
            bits, ones = self._walked(p, at)
            value = value * np.uint32(2) + bits.astype(np.uint32)
            at = np.where(bits == 1, self.zeros[p] + ones, at - ones)
        return value

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            on, r = self._bit(p, i), self._rank1(p, i)
            value = value * 2 + on
            i = self.zeros[p] + r if on else i - r
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the last plane's successor holds the token's occurrences before place i."""
        if token < 0 or token >> self.planes:
            return 0, 0
        a, b = 0, min(i, self.n)
        for p in range(self.planes):
            ra, rb = self._rank1(p, a), self._rank1(p, b)
            on = token >> (self.planes - 1 - p) & 1
            a, b = (self.zeros[p] + ra, self.zeros[p] + rb) if on else (a - ra, b - rb)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often the token occurs before place i."""
        a, b = self._range(token, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, plane: int, on: int, k: int) -> int:
        """The place of the k-th (from 0) bit that equals on."""
        ones = self._ones[plane]
        before = np.array(ones) if on else np.arange(len(ones)) * BLOCK * 8 - np.array(ones)
        j = int(np.searchsorted(before, k, side="right")) - 1
        k -= int(before[j])
        steps, words = self._block(plane, j)
        steps = steps.astype(np.int64) if on else np.arange(len(steps)) * STEP - steps
        at = int(np.searchsorted(steps, k, side="right")) - 1
        k -= int(steps[at])
        bits = np.unpackbits(words[at * (STEP // 64) : (at + 1) * (STEP // 64)].view(np.uint8), bitorder="little")
        return j * BLOCK * 8 + at * STEP + int(np.flatnonzero(bits == on)[k])

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(self.planes - 1, -1, -1):
            on = token >> (self.planes - 1 - p) & 1
            i = self._select_bit(p, on, i - self.zeros[p] if on else i)
        return i

    def occurrences(self, token: int) -> list[tuple[int | None, int]]:
        """(document, place in it) of each occurrence."""
        at = np.array([self.select(token, k) for k in range(self.count(token))], np.int64)
        doc = np.searchsorted(self.starts, at, side="right") - 1
        return [(self.doc_ids[d], int(i - self.starts[d])) for d, i in zip(doc, at, strict=True)]

    def tokens(self) -> np.ndarray:
        """The whole sequence, plane by plane."""
        return self._tokens_at(np.arange(self.n))

    def document(self, j: int) -> np.ndarray:
        """The tokens of the j-th document, all of them plane by plane."""
        return self._tokens_at(np.arange(self.starts[j], self.starts[j + 1]))


def wavelet_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, shard_tokens: int = 1 << 21, level: int = 1) -> DataFrame:
    """Every document's tokens as wavelet-matrix shards: shard, n_docs, n_tokens, n_bytes, payload.

    One pass without a shuffle: a task closes a shard at the first document end past
    shard_tokens, so that documents are never cut and a very long one makes its shard larger.
    Null and empty texts have no tokens but are listed; a null id stays null; repeated rows
    are each kept; other columns are left aside; an empty table gives no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = words_of(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, held, n, seq
            payload = build(np.concatenate(held), doc_ids, np.array([len(x) for x in held]), level)
            row = [[f"{part:06d}-{seq:04d}"], [len(doc_ids)], [n], [len(payload)], [payload]]
            doc_ids, held, n, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "n_docs", "n_tokens", "n_bytes", "payload"])

        for b in batches:
            texts = b.column(1)
            for j, d in enumerate(b.column(0).to_pylist()):
                ids = words.ids(texts[j].as_py())
                doc_ids.append(d)
                held.append(ids)
                n += len(ids)
                if n >= shard_tokens:
                    yield close()
        if doc_ids:
            yield close()

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: how often each token occurs in all shards, by rank alone; 0 for one that none has, no rows without shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column(0):
                w = WaveletShard(payload.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([w.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return shards.select("payload").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def token_places(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, doc_id, place: each occurrence of each token, by select alone; documents without an id have a null one, repeated rows each their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column(0):
                w = WaveletShard(payload.as_py())
                for t in tokens:
                    found = w.occurrences(t)
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(found), pa.int64()), pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], names=["token", "doc_id", "place"])

    return shards.select("payload").mapInArrow(run, "token bigint, doc_id bigint, place bigint")
