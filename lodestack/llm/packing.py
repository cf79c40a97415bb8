"""Best-fit packing of documents into training sequences by bin completion.

Documents are dealt by hash into groups of bounded size, and each group is packed on its own:
first by best fit, largest document first, which is the incumbent. If that takes more
sequences than the lower bounds allow, one dive completes the largest document left by the
tightest filling of its sequence, again and again, and the better of both is the incumbent. If
that doesn't meet the bounds either, a branch and bound looks for better: the largest
document left is completed by each undominated filling of what remains of its sequence, tightest
first, and a branch ends where its waste is more than an improvement on the incumbent can
afford. Every new best packing becomes the incumbent. Where the search of a whole group is
stopped, it is run again on the sequences that waste most, as long as that saves one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER, with_token_counts, written

#: Tokens of a sequence; pieces that are packed together; fillings that a group's search may look at.
CAPACITY, GROUP, NODES = 2048, 4096, 4000
#: Sequences that waste most, packed again together where the search of the whole group is stopped.
WORST = 12
SCHEMA = "doc_id bigint, piece int, start bigint, n_tokens int, bin bigint, place int"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: largest first, each into the fullest bin that has room (ties: the oldest)."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free - sizes[i]:
            insort(room, (free - sizes[i], b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The larger of the bound by volume and Martello and Toth's, which leaves out waste that large items force."""
    if not sizes:
        return 0
    s = np.sort(np.array(sizes))[::-1]
    total = np.concatenate(([0], np.cumsum(s)))
    best = -(-int(total[-1]) // capacity)
    for k in [0, *np.unique(s[s <= capacity // 2]).tolist()]:
        large = int((s > capacity - k).sum())
        half = int((s > capacity // 2).sum())
        upto = int((s >= k).sum()) if k else len(s)
        free = (half - large) * capacity - int(total[half] - total[large])
        best = max(best, half + max(0, -(-(int(total[upto] - total[half]) - free) // capacity)))
    return best


def dive(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: the largest left is completed to the largest sum that fits, by as large others as can be.

    Sums are the bits of one number; items join it from the largest until the bin can be full.
    """
    left = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    while left:
        chosen, room = [left[0]], capacity - sizes[left[0]]
        mask, sums, steps = (1 << (room + 1)) - 1, 1, []
        at = bisect_left(left, -room, 1, key=lambda i: -sizes[i])
        while at < len(left) and not sums >> room:
            new = (sums | sums << sizes[left[at]]) & mask
            if new != sums:
                steps.append((left[at], sums))
                sums = new
            at += 1
        target = sums.bit_length() - 1
        for i, before in reversed(steps):
            if not before >> target & 1:
                chosen.append(i)
                target -= sizes[i]
        bins.append(chosen)
        gone = set(chosen)
        left = [i for i in left if i not in gone]
    return bins


def fillings(sizes: list[int], counts: dict[int, int], room: int, need: int, budget: list[int]) -> list[tuple[int, ...]]:
    """The undominated multisets of sizes (descending) that fit into room and take at least need of it, tightest first.

    A set is dominated if an item outside could take the place of some of its items (or of
    none) and fit, and those items lie in the space of that one.
    """
    out: list[tuple[int, ...]] = []
    left_over = [0] * (len(sizes) + 1)
    for k in range(len(sizes) - 1, -1, -1):
        left_over[k] = left_over[k + 1] + sizes[k] * counts[sizes[k]]

    def undominated(chosen: tuple[int, ...], free: int) -> bool:
        used: dict[int, int] = {}
        for x in chosen:
            used[x] = used.get(x, 0) + 1
        outside = [x for x in sizes if counts[x] > used.get(x, 0)]
        if outside and outside[-1] <= free:
            return False
        sums = {(0, 0)}
        for x in chosen:
            sums |= {(s + x, min(n + 1, 2)) for s, n in sums}
        for s, n in sums:
            if n:
                # the least item outside that is at least s (larger than it, if s is one item)
                at = bisect_left(ascending, s + (n == 1))
                while at < len(ascending) and ascending[at] <= s + free:
                    if counts[ascending[at]] > used.get(ascending[at], 0):
                        return False
                    at += 1
        return True

    ascending = sizes[::-1]

    def go(k: int, chosen: tuple[int, ...], free: int) -> None:
        if budget[0] <= 0:
            return
        budget[0] -= 1
        while k < len(sizes) and sizes[k] > free:
            k += 1
        if k == len(sizes):
            if room - free >= need and undominated(chosen, free):
                out.append(chosen)
            return
        if room - free + min(free, left_over[k]) < need:
            return
        x = sizes[k]
        for n in range(min(counts[x], free // x), -1, -1):
            go(k + 1, chosen + (x,) * n, free - n * x)

    go(0, (), room)
    return sorted(out, key=lambda c: (-sum(c), len(c), [-x for x in c]))


def pack(sizes: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[list[int]], bool]:
    """(bins of indices, whether they are proven to be as few as can be).

    Sizes lie between 1 and capacity. A search stops after `nodes` steps and then returns the
    best packing so far, which never takes more bins than best fit.
    """
    incumbent = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(incumbent) <= bound:
        return incumbent, True
    incumbent = min(incumbent, dive(sizes, capacity), key=len)
    incumbent, proven = completed(sizes, capacity, nodes, incumbent, bound)
    while not proven:
        incumbent.sort(key=lambda b: sum(sizes[i] for i in b))
        worst, rest = incumbent[:WORST], incumbent[WORST:]
        some = [i for b in worst for i in b]
        own = [sizes[i] for i in some]
        better = min(dive(own, capacity), completed(own, capacity, nodes, best_fit(own, capacity), lower_bound(own, capacity))[0], key=len)
        if len(better) >= len(worst):
            break
        incumbent = rest + [[some[i] for i in b] for b in better]
        proven = len(incumbent) <= bound
    return incumbent, proven


def completed(sizes: list[int], capacity: int, nodes: int, incumbent: list[list[int]], bound: int) -> tuple[list[list[int]], bool]:
    """pack() by branch and bound from an incumbent."""
    if len(incumbent) <= bound:
        return incumbent, True
    counts: dict[int, int] = {}
    for x in sizes:
        counts[x] = counts.get(x, 0) + 1
    total = sum(sizes)
    best: list[tuple[int, ...]] | None = None
    best_n = len(incumbent)
    budget = [nodes]
    done: list[tuple[int, ...]] = []
    # a stack of choices instead of recursion: groups have more bins than Python has frames
    stack: list[tuple[list[tuple[int, ...]], int]] = []
    waste = 0

    def descend() -> bool:
        """Opens the next bin; False if nothing is left to pack or the branch can't improve."""
        nonlocal best, best_n
        present = sorted((x for x, n in counts.items() if n), reverse=True)
        if not present:
            if len(done) < best_n:
                best, best_n = list(done), len(done)
            return False
        allowed = (best_n - 1) * capacity - total - waste
        if allowed < 0 or len(done) + 1 >= best_n:
            return False
        top = present[0]
        counts[top] -= 1
        rest = [x for x in present if counts[x] and x <= capacity - top]
        found = fillings(rest, counts, capacity - top, max(0, capacity - top - allowed), budget)
        if not found:
            counts[top] += 1
            return False
        stack.append(([(top, *c) for c in found], -1))
        return True

    def undo(chosen: tuple[int, ...]) -> None:
        nonlocal waste
        done.pop()
        waste -= capacity - sum(chosen)
        for x in chosen[1:]:
            counts[x] += 1

    descend()
    while stack and budget[0] > 0 and best_n > bound:
        options, k = stack.pop()
        if k >= 0:
            undo(options[k])
        k += 1
        if k == len(options) or waste + capacity - sum(options[k]) > (best_n - 1) * capacity - total:
            counts[options[0][0]] += 1
            continue
        chosen = options[k]
        for x in chosen[1:]:
            counts[x] -= 1
        done.append(chosen)
        waste += capacity - sum(chosen)
        stack.append((options, k))
        descend()
    proven = best_n <= bound or budget[0] > 0
    if best is None:
        return incumbent, proven
    of: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), reverse=True):
        of.setdefault(sizes[i], []).append(i)
    return [[of[x].pop() for x in chosen] for chosen in best], proven


def _groups(docs: DataFrame, id_col: str, text_col: str, group: int, tokenizer: str) -> tuple[DataFrame, Column]:
    """(doc_id, h, r, n tokens) of each row, and the group that a row is in; r numbers rows, so that many alike are dealt to all groups."""
    one = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(id_col, text_col).alias("h"), F.monotonically_increasing_id().alias("r"), F.col(text_col).alias("text"))
    counted = written(with_token_counts(one, "text", "n", tokenizer, ["doc_id", "h", "r"]), "packing-sizes")
    return counted, F.pmod(F.xxhash64("h", "r"), F.lit(max(1, -(-counted.count() // group)))).alias("g")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP, nodes: int = NODES, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin, place: where each part of each row's tokens lies.

    A text of more than capacity tokens is cut into pieces of that many, each a bin's whole
    content, and a rest that is packed with the others; nothing is left out or cut otherwise.
    Null and empty texts have one row with 0 tokens and no bin. Each row is packed on its own:
    repeated rows and rows that share an id or have none take part like any other. Other
    columns are left aside. The text itself is read once, for its number of tokens.
    """
    counted, group_of = _groups(docs, id_col, text_col, group, tokenizer)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "h", "r"], ascending=[False, True, True], kind="stable")
        ids, n = rows["doc_id"].tolist(), rows["n"].to_numpy()
        out: list[tuple] = []
        base, b = int(key[0]) << 32, 0
        small: list[tuple] = []
        for d, size in zip(ids, n.tolist(), strict=True):
            d = None if pd.isna(d) else int(d)
            if not size:
                out.append((d, 0, 0, 0, None, None))
            for p in range(size // capacity):
                out.append((d, p, p * capacity, capacity, base + b, 0))
                b += 1
            if size % capacity:
                small.append((d, size // capacity, size - size % capacity, size % capacity))
        for members in pack([x[3] for x in small], capacity, nodes)[0]:
            out += [(*small[i], base + b, k) for k, i in enumerate(members)]
            b += 1
        made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "n_tokens", "bin", "place"])
        return made.astype({"doc_id": "Int64", "bin": "Int64", "place": "Int32"})

    return counted.groupBy(group_of).applyInPandas(run, SCHEMA)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP, nodes: int = NODES, tokenizer: str = TOKENIZER) -> DataFrame:
    """g, pieces, best_fit, bound, bins, proven: what packed() reaches in each group, without the bins of whole pieces."""
    counted, group_of = _groups(docs, id_col, text_col, group, tokenizer)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = [n % capacity for n in rows.sort_values(["n", "h", "r"], ascending=[False, True, True], kind="stable")["n"].tolist() if n % capacity]
        bins, proven = pack(sizes, capacity, nodes)
        return pd.DataFrame([(int(key[0]), len(sizes), len(best_fit(sizes, capacity)), lower_bound(sizes, capacity), len(bins), proven)], columns=["g", "pieces", "best_fit", "bound", "bins", "proven"])

    return counted.groupBy(group_of).applyInPandas(run, "g bigint, pieces int, best_fit int, bound int, bins int, proven boolean")
