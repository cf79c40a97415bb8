"""Lines and bytes of texts as column expressions. Offsets are bytes of UTF-8, from 0; lines count from 1.

Offsets of all lines of a text are found in Arrow batches: folding them up inside the JVM would
copy the list for every line, in time that grows with the square of a long text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def _offsets(found: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in found])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *found]), pa.int32()))


def line_starts(text: Column | str) -> Column:
    """The byte at which each line starts; a last line break starts one more."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return _offsets([np.append(0, np.flatnonzero(np.frombuffer(t.encode(), np.uint8) == 10) + 1) for t in texts.to_pylist()])

    return run(_text(text))


def line_of(starts: Column, at: Column) -> Column:
    """The line that holds a byte."""
    return F.size(F.filter(starts, lambda s: s <= at))


def line_of_with_end(starts: Column, at: Column, size: Column) -> Column:
    """The same, but the byte after the last one is on a line of its own."""
    return line_of(starts, at) + F.when(at >= size, 1).otherwise(0)


def cuts(raw: bytes, start: int, end: int) -> list[int]:
    """Where raw[start:end] may be cut: after blank lines, or if there are none after lines; its end included."""
    for mark in (b"\n\n", b"\n"):
        out, at = [], raw.find(mark, start, end)
        while at != -1:
            out.append(at + len(mark))
            at = raw.find(mark, at + len(mark), end)
        if out:
            break
    return out if out and out[-1] == end else [*out, end]


def boundaries(text: Column | str) -> Column:
    """cuts() of whole texts."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return _offsets([np.array(cuts(raw := t.encode(), 0, len(raw)), np.int64) for t in texts.to_pylist()])

    return run(_text(text))
