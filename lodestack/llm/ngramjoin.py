"""N-gram Jaccard join by parity sketches: which documents have sets of word n-grams that are alike.

Documents with the same set are one class, and one row stands for it. Sets are put in bands of
size by powers of 1 / threshold, so that a pair's sets are in the same band or in neighbours;
a document takes part in its own band and, as the smaller one, in the next. Grams are XORed into
a band's sketch twice, in large bands only those below a hash bound:

* as bits, one a gram: the Hamming distance of two sketches is at most the symmetric difference
  of the sets, so that a pair farther apart than the threshold allows is dropped unread;
* as 64-bit words, one a segment: a pair within the threshold differs in few places, and by the
  pigeonhole principle leaves some segments alike. Equal segments make candidates.

The least sets have a segment a gram; up to 255 grams a band has more segments than a pair within
the threshold can differ in; larger ones share 14 or more segments of two grams each on average at
the threshold 0.5, so that none is shared once in about a million pairs, and less often above it.
Segments are counted before their members are sent anywhere, which only those do that two
documents share. Candidates that pass the Hamming bound are verified on the whole sets, in cells
of a bounded number of documents of a cluster, to which a text is sent only if a pair asks for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, filter_of_ids, forget, mixed, word_gram_hashes, written

GRAM, THRESHOLD = 3, 0.5
#: Grams that a band's least set is thinned to before it gives segments, and before it gives bits; the most segments; bits.
THINNED, THINNED_BITS, SEGMENTS, BITS = 256, 64, 172, 512
#: Sets of fewer grams have a segment for each gram.
SMALL = 32
#: Members of a segment from which candidates are compared by their sketches, block by block, before they are listed.
LISTED = 48
#: Documents that are compared with each other at a time, by sketches and on whole sets.
BLOCK, CELL = 2048, 512
#: Texts whose signatures a task holds at a time.
PART = 1000
#: Standard deviations that thinning may add to a symmetric difference.
SLACK = 3.5

SIGNATURES = "doc_id bigint, h binary, size int, own array<bigint>, up array<bigint>, own_bits binary, up_bits binary, own_n int, up_n int"


def band(size: int, threshold: float) -> int:
    """Sets a, b with a Jaccard index of at least threshold are at most one band apart."""
    return int(np.floor(np.log(size + 1e-9) / -np.log(threshold)))


def segments(least: float, threshold: float) -> int:
    """More than the largest symmetric difference of a pair of sets under least / threshold, but no more than SEGMENTS."""
    return min(SEGMENTS, int(2 * (1 - threshold) / (1 + threshold) * least / threshold) + 1)


def sketch(grams: np.ndarray, j: int, threshold: float) -> tuple[np.ndarray, bytes, int]:
    """Keys of the segments, parity bits and number of grams among the bits in the sketch of band j; grams ascend."""
    least = threshold**-j

    def thinned(to: int) -> np.ndarray:
        return grams[: np.searchsorted(grams, np.uint64(min(2**64 - 1, int(to / least * 2.0**64))))] if least > to else grams

    few = thinned(THINNED_BITS)
    bits = np.bincount((mixed(few ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(7)).astype(np.int64) % BITS, minlength=BITS) & 1
    h = mixed(thinned(THINNED) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    if least < SMALL:
        keys = h
    else:
        n = segments(least, threshold)
        seg = ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        words = np.zeros(n, np.uint64)
        np.bitwise_xor.at(words, seg, mixed(h))
        # where segments are fewer than differences, single grams aren't needed, which may be as common as function words
        used = np.bincount(seg, minlength=n) >= (2 if n == SEGMENTS and least > THINNED // 2 else 1)
        keys = mixed(words[used] ^ mixed(np.flatnonzero(used).astype(np.uint64) + np.uint64(1)))
    with np.errstate(over="ignore"):
        keys = mixed(keys + np.uint64(j + 1) * np.uint64(0xD6E8FEB86659FD93))
    return keys.view(np.int64), np.packbits(bits.astype(np.uint8)).tobytes(), len(few)


def most_apart(a, b, thinned, threshold: float):
    """The largest Hamming distance that leaves a pair of a and b sketched grams possible."""
    d = (1 - threshold) / (1 + threshold) * (a + b)
    return np.where(thinned, d + SLACK * np.sqrt(d + 1), d)


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> DataFrame:
    """A row for each document that has an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, PART) for b in batches for k in range(0, b.num_rows, PART)):
            rows = []
            ids = batch.column(0).to_pylist()
            for d, t in zip(ids, batch.column(1), strict=True):
                grams = word_gram_hashes(t.as_py(), n)
                if d is None or not len(grams):
                    continue
                j = band(len(grams), threshold)
                (k0, b0, n0), (k1, b1, n1) = sketch(grams, j, threshold), sketch(grams, j + 1, threshold)
                rows.append((d, blake2b(grams.tobytes(), digest_size=16).digest(), len(grams), k0, k1, b0, b1, n0, n1))
            if rows:
                c = list(zip(*rows, strict=True))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in c[k]]))), pa.int32()), pa.array(np.concatenate(c[k]), pa.int64())) for k in (3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.int32()), *lists, pa.array(c[5], pa.binary()), pa.array(c[6], pa.binary()), pa.array(c[7], pa.int32()), pa.array(c[8], pa.int32())], names=[x.split()[0] for x in SIGNATURES.split(", ")])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, SIGNATURES)


def _compared(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b that the Hamming bound leaves; columns x_* and y_* hold both signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            bits = [np.frombuffer(b"".join(col[c].to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("x_bits", "y_bits")]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1)
            size = [col[c].to_numpy() for c in ("x_n", "y_n")]
            ok = apart <= most_apart(*size, col["thinned"].to_numpy(zero_copy_only=False), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.mapInArrow(run, "a bigint, b bigint")


class _Block:
    """Pairs of a group's members in two blocks; a pair found alike in many segments is compared once in each band."""

    MOST = 4 * BLOCK

    def __init__(self, same: bool):
        self.same = same
        self.at: tuple[dict[int, int], dict[int, int]] = ({}, {})
        self.tried: dict[int, np.ndarray] = {}

    def places(self, ids: np.ndarray, side: int) -> np.ndarray:
        at = self.at[0 if self.same else side]
        return np.array([at.setdefault(i, len(at)) for i in ids.tolist()], np.int64)

    def new(self, band: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Which of rows x cols haven't been tried in this band; they are from now on."""
        if max(map(len, self.at)) > self.MOST:
            self.__init__(self.same)
            return np.ones((len(rows), len(cols)), bool)
        i, j = self.places(rows, 0), self.places(cols, 1)
        held = self.tried.get(band, np.zeros((0, 0), bool))
        if held.shape[0] <= i.max() or held.shape[1] <= j.max():
            grown = np.zeros((max(held.shape[0] * 2, int(i.max()) + 1), max(held.shape[1] * 2, int(j.max()) + 1)), bool)
            grown[: held.shape[0], : held.shape[1]] = held
            held = self.tried[band] = grown
        fresh = ~held[np.ix_(i, j)]
        held[np.ix_(i, j)] = True
        return fresh


def _near_in_segment(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of the members of one segment that the Hamming bound and the sizes leave, block against block.

    members: least, bi, bj, key, band, side (0 where in block bi), id, size, bits, n; sorted by the first four.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = block = None

        def compare() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            ids, size, n, side = (t.column(c).to_numpy() for c in ("id", "size", "n", "side"))
            rows = np.flatnonzero(side == 0)
            cols = rows if block.same else np.flatnonzero(side == 1)
            if not len(rows) or not len(cols):
                return
            j = t.column("band")[0].as_py()
            fresh = block.new(j, ids[rows], ids[cols])
            some = fresh.any(1)
            rows, fresh = rows[some], fresh[some]
            if not len(rows):
                return
            bits = np.unpackbits(np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32)
            ones, thin = bits.sum(1), threshold**-j > THINNED_BITS
            for k in range(0, len(rows), 512):
                r = rows[k : k + 512]
                apart = ones[r][:, None] + ones[cols][None] - 2 * (bits[r] @ bits[cols].T)
                low, high = np.minimum(size[r][:, None], size[cols][None]), np.maximum(size[r][:, None], size[cols][None])
                ok = fresh[k : k + 512] & (low >= threshold * high) & (apart <= most_apart(n[r][:, None], n[cols][None], thin, threshold))
                x, y = np.nonzero(ok)
                a, b = ids[r][x], ids[cols][y]
                keep = (a < b) if block.same else (a != b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], 1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                now = tuple(key[lo].tolist())
                if at != now:
                    if held:
                        yield from compare()
                    held = []
                    if at is None or at[:3] != now[:3]:
                        block = _Block(now[1] == now[2])
                    at = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from compare()

    return members.mapInArrow(run, "a bigint, b bigint")


def _blocks(df: DataFrame, n: str, of: str) -> DataFrame:
    """df with a row for each pair of blocks that one of n's blocks (by hash of `of`) takes part in: bi <= bj, side."""
    mine = F.pmod(F.xxhash64(F.col(of)), F.col(n)).cast("int")
    other = df.withColumn("__m", mine).withColumn("__o", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)))
    return other.withColumns({"bi": F.least("__m", "__o"), "bj": F.greatest("__m", "__o"), "side": F.when(F.col("__m") <= F.col("__o"), 0).otherwise(1)}).drop("__m", "__o")


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of representatives with a segment alike that the Hamming bound leaves.

    Counting combines on the map side, so that a segment that many share is a few rows; members
    are then listed for small groups, and dealt by block for large ones: none is gathered whole.
    """
    both = F.concat("own", "up")
    shared = reps.select("id", F.explode(both).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1")
    shared = written(shared, "segments")
    known = filter_of_ids(shared.select(F.col("key").alias("id")), shared.count())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, c in ((True, 2), (False, 3)):
                keys = b.column(c).flatten().to_numpy()
                of = np.repeat(np.arange(b.num_rows), b.column(c).value_lengths().to_numpy())
                at = np.flatnonzero(known(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), b.column(0).take(pa.array(of[at])), b.column(1).take(pa.array(of[at])), pa.array(np.full(len(at), own))], names=["key", "id", "size", "own"])

    members = reps.select("id", "size", "own", "up").mapInArrow(found, "key bigint, id bigint, size int, own boolean").join(shared, "key")
    # near copies share most segments, and mostly the same least member: put together by it, a pair that is found in many segments is counted out before it is sent on
    groups = members.filter(F.col("n") <= LISTED).groupBy("key", "least").agg(F.collect_list(F.struct("id", "size", "own")).alias("m")).repartition("least")
    few = groups.select(F.explode("m").alias("x"), "m")
    few = few.select("x", F.explode(F.filter("m", lambda y: (y["id"] > F.col("x.id")) & (F.least(y["size"], F.col("x.size")) >= threshold * F.greatest(y["size"], F.col("x.size"))) & (y["own"] | F.col("x.own")))).alias("y"))
    few = few.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    thin = -np.log(threshold)
    side = lambda s: reps.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("size", "own_bits", "up_bits", "own_n", "up_n")), F.floor(F.log(F.col("size") + 1e-9) / thin).alias(f"{s}_band"))
    both = few.join(side("a"), "a").join(side("b"), "b")
    up_a, up_b = F.col("a_band") < F.col("b_band"), F.col("b_band") < F.col("a_band")
    pick = lambda s, up, c: F.when(up, F.col(f"{s}_up_{c}")).otherwise(F.col(f"{s}_own_{c}"))
    top = F.greatest("a_band", "b_band")
    few = _compared(both.select("a", "b", pick("a", up_a, "bits").alias("x_bits"), pick("b", up_b, "bits").alias("y_bits"), pick("a", up_a, "n").alias("x_n"), pick("b", up_b, "n").alias("y_n"), (F.pow(F.lit(1 / threshold), top) > THINNED_BITS).alias("thinned")), threshold)
    many = members.filter(F.col("n") > LISTED).withColumn("n_blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n", "size")
    many = many.join(reps.drop("own", "up"), "id")
    j = F.floor(F.log(F.col("size") + 1e-9) / thin) + F.when(F.col("own"), 0).otherwise(1)
    many = many.withColumns({"band": j, "bits": F.when(F.col("own"), F.col("own_bits")).otherwise(F.col("up_bits")), "n": F.when(F.col("own"), F.col("own_n")).otherwise(F.col("up_n"))})
    many = _blocks(many, "n_blocks", "id").repartition("least", "bi", "bj").select("least", "bi", "bj", "key", "band", "side", "id", "size", "bits", "n").sortWithinPartitions("least", "bi", "bj", "key")
    return few.union(_near_in_segment(many, threshold)).distinct()


class _Up:
    """Union by the least node."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def forest(edges: DataFrame) -> DataFrame:
    """u, v (u < v): edges with the same components, at most one for each node in a partition; edges: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _Up()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree.join(a, b)
        if tree.up:
            nodes = list(tree.up)
            yield pa.RecordBatch.from_arrays([pa.array([tree.root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["u", "v"])

    return edges.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, root: every node of the edges with the least node that it is connected to.

    Each partition's edges are first cut to a forest, so that what is sent on grows with the
    nodes, not with the pairs. Then large-star and small-star steps alternate, in rounds that
    grow with the logarithm of the largest component; each round's edges are a written table.
    A node's least neighbour is a minimum that is combined on the map side and joined back, so
    that the many neighbours of a hot node are rows of a join, never one list.
    """
    now = written(forest(edges.select(F.col(a).cast("bigint"), F.col(b).cast("bigint"))).distinct(), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("v").alias("id"), F.col("u").alias("root")).union(now.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
        seen = mark
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").filter("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        before, now = now, written(small.union(least.select(F.col("m").alias("u"), "v")).distinct(), "edges")
        forget(before)


def alike(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Jaccard index of sets a[i] and b[i], sorted and not empty; many pairs of few sets are one matrix product."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(a) <= 4 * len(sets):
        both = np.empty(len(a), np.int64)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = (sets[x], sets[y]) if size[x] <= size[y] else (sets[y], sets[x])
            p = np.searchsorted(y, x)
            both[i] = (y[np.minimum(p, len(y) - 1)] == x).sum()
    else:
        _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        kept = n[code] > 1  # what one set alone has is in no other
        code, of = code[kept], np.repeat(np.arange(len(sets)), size)[kept]
        order = np.argsort(code, kind="stable")
        code, of = code[order], of[order]
        column = np.cumsum(np.concatenate(([0], code[1:] != code[:-1]))) if len(code) else code
        total = np.zeros((len(sets), len(sets)))
        for lo in range(0, int(column[-1]) + 1 if len(code) else 0, 4096):
            i, j = np.searchsorted(column, (lo, lo + 4096))
            held = np.zeros((len(sets), 4096), np.float32)
            held[of[i:j], column[i:j] - lo] = 1
            total += held @ held.T
        both = total[a, b].astype(np.int64)
    return both / (size[a] + size[b] - both)


def _verified(docs: DataFrame, pairs: DataFrame, weights: DataFrame, n: int, threshold: float, id_col: str, text_col: str, out, schema: str) -> DataFrame:
    """What out(ids, weights, a, b, jaccard) makes of the pairs of each cell that reach the threshold on their whole sets.

    pairs: a, b; weights: id, w for all that occur in pairs; docs may have other rows too. A cluster of
    candidates is dealt into blocks of at most about CELL documents, and a pair of blocks is a cell; a text goes to
    the cells in which a pair asks for it.
    """
    clusters = written(components(pairs), "clusters")
    size = clusters.groupBy("root").agg(F.ceil(F.count("*") / CELL).cast("int").alias("n_blocks"))
    known = filter_of_ids(clusters.select("id"), clusters.count())
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    block = lambda c: F.pmod(F.xxhash64(F.col(c)), F.col("n_blocks")).cast("int")
    asked = written(pairs.join(clusters.join(size, "root").withColumnRenamed("id", "a"), "a").select("root", F.least(block("a"), block("b")).alias("bi"), F.greatest(block("a"), block("b")).alias("bj"), "a", "b"), "asked")
    cell = ["root", "bi", "bj"]
    wanted = asked.select("a", *cell).union(asked.select("b", *cell)).toDF("id", *cell).distinct().join(weights, "id")
    texts = among(rows, known, "id").join(wanted, "id").select(*cell, F.lit(0).alias("kind"), F.col("id").alias("a"), F.col("w").alias("b"), "text")
    cells = texts.union(asked.select(*cell, F.lit(1), "a", "b", F.lit(None).cast("string"))).repartition(*cell).sortWithinPartitions(*cell, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, grams, weight, left, right = None, {}, {}, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if left:
                ids = np.array(sorted(grams), np.int64)
                a, b = (np.searchsorted(ids, np.concatenate(x)) for x in (left, right))
                jaccard = alike([grams[i] for i in ids.tolist()], a, b)
                ok = jaccard >= threshold
                if ok.any():
                    yield out(ids, np.array([weight[i] for i in ids.tolist()], np.int64), a[ok], b[ok], jaccard[ok])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], 1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            a, b = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                now = tuple(key[lo, :3].tolist())
                if now != at:
                    yield from close()
                    at, grams, weight, left, right = now, {}, {}, [], []
                if key[lo, 3]:
                    left.append(a[lo:hi])
                    right.append(b[lo:hi])
                    continue
                for k in range(lo, hi):
                    new, d = word_gram_hashes(batch.column(6)[k].as_py(), n), int(a[k])
                    old = grams.get(d)
                    # rows that share an id: the one whose set is the class's, see classes(); those without words have no signature
                    if len(new) and (old is None or blake2b(new.tobytes(), digest_size=16).digest() < blake2b(old.tobytes(), digest_size=16).digest()):
                        grams[d], weight[d] = new, int(b[k])
        yield from close()

    return cells.mapInArrow(run, schema)


def _classed(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, rep) of every document with words; (id, w) of the representatives and how many they stand for; candidates a, b."""
    signed = written(signatures(docs, id_col, text_col, n, threshold), "signatures")
    one = signed.groupBy("doc_id").agg(F.min("h").alias("h"), F.count("*").alias("rows"))
    reps = one.groupBy("h").agg(F.min("doc_id").alias("id"), F.count("*").alias("w"))
    members = written(one.join(reps, "h").select("doc_id", F.col("id").alias("rep"), "h", "w", "rows"), "members")
    # only rows that may not be their class's are sent to be compared with it
    odd = members.filter("doc_id <> rep OR rows > 1").select(F.col("doc_id").alias("id"))
    known = filter_of_ids(odd, odd.count())
    sure = among(signed, lambda c: ~known(c), "doc_id").drop("h")
    other = among(signed, known, "doc_id").join(members.filter("doc_id = rep").select("doc_id", F.col("h").alias("__h")), "doc_id").filter("h = __h").drop("h", "__h").dropDuplicates(["doc_id"])
    chosen = written(sure.union(other).withColumnRenamed("doc_id", "id"), "representatives")
    forget(signed)
    return members.select("doc_id", "rep"), members.filter("doc_id = rep").select(F.col("doc_id").alias("id"), "w"), written(candidates(chosen, threshold), "candidates")


def jaccard_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_a, doc_b, jaccard), (doc_id, rep): pairs doc_a < doc_b of representatives that reach the threshold, and whom they stand for.

    Rows are taken as in classes().
    """
    members, weights, pairs = _classed(docs, id_col, text_col, n, threshold)

    def out(ids: np.ndarray, _, a: np.ndarray, b: np.ndarray, jaccard: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(jaccard)], names=["doc_a", "doc_b", "jaccard"])

    return _verified(docs, pairs, weights, n, threshold, id_col, text_col, out, "doc_a bigint, doc_b bigint, jaccard double"), members


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_copies, n_links of every document that has an id.

    n_links counts the documents with another set of word n-grams whose Jaccard index with
    this one's is at least threshold, n_copies those with the same set, itself among them;
    class_id is the least id that a chain of such links and copies leads to. Pairs aren't listed: a cell's
    task counts the links that it verifies.

    Words are lower-case runs without white space; a text of fewer than n words has one gram, of
    all of them. Documents without words (null, empty, blank texts) are a class of their own,
    with one copy and no links. Rows that share an id are one document, of the text whose set
    comes first by hash. Rows without an id and other columns are left aside; an empty table gives no rows.
    """
    members, weights, pairs = _classed(docs, id_col, text_col, n, threshold)

    def out(ids: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray, _) -> pa.RecordBatch:
        tree = _Up()
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            tree.join(x, y)
        v = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[[tree.root(x) for x in v.tolist()]]), pa.array(ids[v]), pa.array(links[v])], names=["u", "v", "n"])

    found = written(_verified(docs, pairs, weights, n, threshold, id_col, text_col, out, "u bigint, v bigint, n bigint"), "links")
    roots = components(found.filter("u <> v"), "u", "v")
    links = found.groupBy(F.col("v").alias("id")).agg(F.sum("n").alias("n_links")).join(roots, "id")
    known = weights.join(links, "id", "left").select(F.col("id").alias("rep"), F.coalesce("root", "id").alias("class_id"), F.col("w").alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = members.join(known, "rep").drop("rep")
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    return ids.join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """docs without near copies: of each class of classes() the document with the least id stays.

    Documents in no pair, without words or without an id stay as they are. Of rows that are
    alike in all columns and share an id one stays.
    """
    gone = classes(docs, id_col, text_col, n, threshold).filter("doc_id > class_id").select(F.col("doc_id").alias("__gone"))
    kept = docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
    again = kept.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).count().filter("count > 1").select("__again")
    once = kept.join(again, kept[id_col] == F.col("__again"), "left_anti")
    return once.union(kept.join(again, kept[id_col] == F.col("__again"), "left_semi").dropDuplicates())
