"""Reversible line dedup: cuckoo filters, one a shard, backed by exact reference counts.

State is three tables. `held` has the documents that are in; `refs` has each line's hash and how many of them
hold it; `filters` has, for each shard of the hash range, a cuckoo filter of the hashes in refs. A
batch's lines probe their shard's filter: what it doesn't know is new without a look at refs, and
what it may know is settled by a join with refs. Filters can forget: when a document is deleted,
its lines' counts go down, and a line that none holds any more leaves the filter, so that its next
document keeps it again. A table is deduplicated in batches, each against the state that the ones before it left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, filter_of_ids, mixed, written

#: Entries of a filter's bucket; its load before it is made twice as large; lines a shard is meant to have.
SLOTS, LOAD, SHARD_LINES = 4, 0.85, 1 << 16
#: Parts in which a table is deduplicated.
BATCHES = 2
#: Lines with fewer characters, spaces at the ends left aside, are kept wherever they are.
SHORTEST = 1


class CuckooFilter:
    """A set of 64-bit hashes, kept as 16-bit prints in buckets of four, that answers "no" or "maybe" and can forget.

    A print lies in one of two buckets, either found from the other and the print. Work is
    done on whole arrays; what an array holds twice goes in once.
    """

    def __init__(self, capacity: int = 1024):
        n = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / LOAD / SLOTS))))
        self.table = np.zeros((n, SLOTS), np.uint16)

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.table = np.frombuffer(raw, "<u2").reshape(-1, SLOTS).copy()
        return out

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mixed(h.astype(np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        a = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, a, self._other(a, prints)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ (mixed(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def may_have(self, h: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(h)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)

    def add(self, h: np.ndarray) -> None:
        """Adds hashes that aren't in it; raises OverflowError, and is then of no more use, if they find no room."""
        h = np.unique(h.astype(np.uint64))
        prints, at, _ = self._places(h)
        rng = np.random.default_rng(len(h))
        for turn in range(200):
            if turn % 2 == 1:
                at = self._other(at, prints)
            # one newcomer a bucket at a time goes to its first free slot
            left = np.ones(len(prints), bool)
            for _ in range(SLOTS):
                idx = np.flatnonzero(left)
                _, first = np.unique(at[idx], return_index=True)
                idx = idx[first]
                free = self.table[at[idx]] == 0
                has = free.any(1)
                idx, slot = idx[has], free.argmax(1)[has]
                self.table[at[idx], slot] = prints[idx]
                left[idx] = False
                if not len(idx):
                    break
            prints, at = prints[left], at[left]
            if not len(prints):
                return
            if turn >= 1:
                # of the rest, one a bucket turns a sitting print out to its other bucket
                _, first = np.unique(at, return_index=True)
                slot = rng.integers(0, SLOTS, len(first))
                out = self.table[at[first], slot]
                self.table[at[first], slot] = prints[first]
                prints[first] = out
        raise OverflowError(len(prints))

    def drop(self, h: np.ndarray) -> None:
        """Removes hashes that are in it, one entry each."""
        h = np.unique(h.astype(np.uint64))
        prints, a, b = self._places(h)
        left = np.ones(len(h), bool)
        for at in (a, b):
            while True:
                idx = np.flatnonzero(left)
                hit = self.table[at[idx]] == prints[idx][:, None]
                idx, slot = idx[hit.any(1)], hit.argmax(1)[hit.any(1)]
                if not len(idx):
                    break
                _, first = np.unique(at[idx] * SLOTS + slot, return_index=True)
                self.table[at[idx[first]], slot[first]] = 0
                left[idx[first]] = False


def filter_of(h: np.ndarray) -> CuckooFilter:
    """A filter of distinct hashes, as large as it takes."""
    size = max(64, len(h))
    while True:
        try:
            out = CuckooFilter(size)
            out.add(h)
            return out
        except OverflowError:
            size *= 2


def _keys(id_col: str, text_col: str) -> list:
    """What names a row: its id, and the hash of its text for rows that share an id."""
    return [F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th")]


def lines_of(docs: DataFrame, id_col: str, text_col: str, shortest: int = SHORTEST) -> DataFrame:
    """id, th, at, h: each line that takes part, by row, place and hash; null texts have none."""
    one = docs.select(*_keys(id_col, text_col), F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("at", "line"))
    return one.withColumn("line", F.trim("line")).filter(F.length("line") >= shortest).select("id", "th", "at", F.xxhash64("line").alias("h"))


class LineStore:
    """The state: held (id, th), refs (shard, h, n) and filters (shard, payload), written tables that each change replaces.

    Without a number of shards, the first batch's lines make as many as keep filters at about
    SHARD_LINES of them; where refs outgrow their shards twofold, there are twice as many.
    """

    def __init__(self, held: DataFrame | None, refs: DataFrame | None, filters: DataFrame | None, shards: int | None):
        self.held, self.refs, self.filters, self.shards = held, refs, filters, shards

    @classmethod
    def empty(cls, shards: int | None = None) -> LineStore:
        return cls(None, None, None, shards)

    def probed(self, hashes: DataFrame) -> DataFrame:
        """hashes (distinct shard, h) with maybe: whether the shard's filter may know it."""
        if self.filters is None:
            return hashes.select("shard", "h", F.lit(False).alias("maybe"))
        both = hashes.select("shard", "h", F.lit(None).cast("binary").alias("payload")).union(self.filters.select("shard", F.lit(None).cast("bigint"), "payload"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for b in batches:
                shard, payload = b.column(0).to_numpy(), b.column(2)
                cut = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    if lo == hi:
                        continue
                    if shard[lo] != at:
                        at, held = shard[lo], None
                    while lo < hi and payload[lo].is_valid:
                        held, lo = CuckooFilter.from_bytes(payload[lo].as_py()), lo + 1
                    part = b.slice(lo, hi - lo)
                    h = part.column(1).to_numpy().view(np.uint64)
                    maybe = held.may_have(h) if held is not None else np.zeros(len(h), bool)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(maybe)], names=["shard", "h", "maybe"])

        # a shard's filter comes before its lines
        return both.repartition("shard").sortWithinPartitions("shard", F.col("payload").isNull()).mapInArrow(run, "shard int, h bigint, maybe boolean")

    def _known(self, lines: DataFrame) -> DataFrame:
        """lines with fresh: whether their document is not held."""
        if self.held is None:
            return lines.withColumn("fresh", F.lit(True))
        held = self.held.select(F.col("id").alias("__i"), F.col("th").alias("__t"), F.lit(False).alias("fresh"))
        return lines.join(held, F.col("id").eqNullSafe(F.col("__i")) & (F.col("th") == F.col("__t")), "left").select(*lines.columns, F.coalesce("fresh", F.lit(True)).alias("fresh"))

    @staticmethod
    def _by_line(lines: DataFrame, shards: int) -> DataFrame:
        """shard, h, first (the first place), n (fresh rows that hold it), times (places)."""
        one = lines.groupBy("h", "id", "th").agg(F.min("at").alias("at"), F.count("*").alias("times"), F.max("fresh").cast("int").alias("fresh"))
        found = one.groupBy("h").agg(F.min(F.struct("id", "th", "at")).alias("first"), F.sum("fresh").alias("n"), F.sum("times").alias("times"))
        return found.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))

    def inserted(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, more: int = 0) -> tuple[LineStore, DataFrame]:
        """The state with these documents, and the lines (id, th, at) that they lose; null texts have no lines.

        A line goes if a document of the state holds it, or one before it in the batch (by id,
        hash of the text, place; a null id is first). The filters rule out most lines of a
        batch before refs is read, and take in its new ones. A document is a row's id and text: one that is held already counts once,
        and loses every line like another copy. more: as many lines again are to come, times this.
        """
        lines = written(self._known(lines_of(docs, id_col, text_col, shortest)), "lines")
        shards = self.shards or max(1, -(-lines.count() * (1 + more) // SHARD_LINES))
        by = written(self._by_line(lines, shards), "line-batch")
        new, known = by.select("shard", "h"), None
        if self.refs is not None:
            known = written(self.probed(new).filter("maybe").join(self.refs.select("h"), "h", "left_semi").select("shard", "h"), "line-known")
            new = new.join(known.select("h"), "h", "left_anti")
        again = by.filter("times > 1").select("h", "first")
        lost = lines.join(again, "h").filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("at") == F.col("first.at")))).select("id", "th", "at")
        if known is not None:
            lost = lost.union(lines.join(known.select("h"), "h", "left_semi").select("id", "th", "at")).distinct()
        held = lines.select("id", "th").distinct()
        counts = by.filter("n > 0").select("shard", "h", "n")
        refs = written(counts if self.refs is None else self.refs.union(counts).groupBy("shard", "h").agg(F.sum("n").alias("n")), "line-refs")
        held = written(held if self.held is None else held.union(self.held).distinct(), "line-documents")
        if refs.count() > 2 * SHARD_LINES * shards:
            shards *= 2
            refs = written(refs.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int")), "line-refs")
            return LineStore(held, refs, written(filters_of(refs), "line-filters"), shards), lost
        return LineStore(held, refs, self._grown(new, refs), shards), lost

    def _grown(self, new: DataFrame, refs: DataFrame) -> DataFrame:
        """The filters with new hashes; those that would overflow are made anew, and larger, from refs."""
        if self.filters is None:
            return written(filters_of(refs), "line-filters")

        def take_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = []
                for payload, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if payload is not None and h:
                        f = CuckooFilter.from_bytes(payload)
                        try:
                            f.add(np.array(h, np.int64).view(np.uint64))
                            payload = f.to_bytes()
                        except OverflowError:
                            payload = None
                    made.append(payload)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["shard", "payload"])

        lists = new.groupBy("shard").agg(F.collect_list("h").alias("h"))
        tried = written(self.filters.join(lists, "shard", "full").select("shard", "payload", "h").mapInArrow(take_in, "shard int, payload binary"), "line-filters")
        over = tried.filter("payload IS NULL").select("shard")
        return written(tried.filter("payload IS NOT NULL").union(filters_of(refs.join(over, "shard", "left_semi"))), "line-filters")

    def deleted(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> LineStore:
        """The state without these documents, given with their texts as they were.

        Documents that aren't held, by id and text, change nothing: none that was never inserted or is deleted already, nor null texts.
        """
        if self.held is None:
            return self
        lines = written(self._known(lines_of(docs, id_col, text_col, shortest)).filter("NOT fresh").withColumn("fresh", F.lit(True)), "lines")
        gone = self._by_line(lines, self.shards).select("shard", "h", (-F.col("n")).alias("n"))
        refs = written(self.refs.union(gone).groupBy("shard", "h").agg(F.sum("n").alias("n")), "line-refs")
        ids = lines.select(F.col("id").alias("__i"), F.col("th").alias("__t")).distinct()
        held = written(self.held.join(ids, F.col("id").eqNullSafe(F.col("__i")) & (F.col("th") == F.col("__t")), "left_anti"), "line-documents")
        out = refs.filter("n <= 0").groupBy("shard").agg(F.collect_list("h").alias("h"))

        def forget(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = []
                for payload, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    f = CuckooFilter.from_bytes(payload)
                    if h:
                        f.drop(np.array(h, np.int64).view(np.uint64))
                    made.append(f.to_bytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["shard", "payload"])

        filters = self.filters.join(out, "shard", "left").select("shard", "payload", "h").mapInArrow(forget, "shard int, payload binary")
        return LineStore(held, refs.filter("n > 0"), written(filters, "line-filters"), self.shards)


def filters_of(refs: DataFrame) -> DataFrame:
    """shard, payload: the filter of each shard's hashes."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": rows["shard"][:1], "payload": [filter_of(rows["h"].to_numpy().view(np.uint64)).to_bytes()]})

    return refs.select("shard", "h").groupBy("shard").applyInPandas(build, "shard int, payload binary")


def without_lines(docs: DataFrame, lost: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str | None = None, n_lost: str | None = None) -> DataFrame:
    """docs with the lost lines (id, th, at) cut from their texts; counts of lines before and lost where columns are named for them.

    Only texts that may lose lines are sent anywhere: those whose hash a filter of the hashes of those that do lets
    through. Null texts lose none; rows alike in id and text lose the same lines.
    """
    places = written(lost.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set("at").alias("__lost")), "line-places")
    known = filter_of_ids(places.select(F.col("__th").alias("id")), places.count())
    rows = docs.select(F.struct(*docs.columns).alias("d"), *_keys(id_col, text_col))
    same = among(rows, lambda c: ~known(c), "th").withColumn("__lost", F.lit(None).cast("array<int>")).select("d", "__lost")
    found = among(rows, known, "th").join(places, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left").select("d", "__lost")
    lines = F.split(F.col(f"d.{text_col}").cast("string"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("__lost"))
    text = F.when(F.col("__lost").isNull(), F.col(f"d.{text_col}")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    kept = [F.col(f"d.{c}").alias(c) if c != text_col else text.alias(c) for c in docs.columns if c not in (n_lines, n_lost)]
    if n_lines:
        kept.append(F.coalesce(F.when(F.col(f"d.{text_col}").isNotNull(), F.size("lines")), F.lit(0)).cast("bigint").alias(n_lines))
    if n_lost:
        kept.append(F.coalesce(F.size("__lost"), F.lit(0)).cast("bigint").alias(n_lost))
    return same.union(found).withColumn("lines", lines).select(*kept)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, n_lines: str | None = "n_lines", n_lost: str | None = "n_lost", batches: int = BATCHES) -> DataFrame:
    """docs without the lines that an earlier row holds or that stand earlier in the same text.

    The rows are inserted into an empty store in `batches` parts of about the same size, in the order of their ids.
    Lines are compared by a 64-bit hash without the spaces at their ends; those with fewer than
    `shortest` characters (blank ones) always stay. Rows come in the order of their ids (integers), null
    first, those that share an id in that of their texts' hashes; rows alike in both are one
    document and lose the same lines. Every row stays, if with an empty text; null texts stay
    null. n_lines and n_lost (lines before, lines lost) replace columns of these names.
    """
    ends = [None, None]
    if batches > 1:
        cuts = docs.agg(F.percentile_approx(F.col(id_col), [k / batches for k in range(1, batches)])).first()[0] or []
        ends = [None, *sorted(set(cuts)), None]
    store, lost = LineStore.empty(), None
    for k, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        part = docs
        if low is not None:
            part = part.filter(F.col(id_col) > low)
        if high is not None:
            part = part.filter(F.col(id_col).isNull() | (F.col(id_col) <= high))
        store, own = store.inserted(part, id_col, text_col, shortest, len(ends) - 2 - k)
        lost = own if lost is None else lost.union(own)
    return without_lines(docs, lost, id_col, text_col, n_lines, n_lost)
