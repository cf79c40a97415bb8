r"""Chat formatting with a grammar round trip.

A conversation is rendered as turns, each `<|im_start|>role`, a line break, the content and
`<|im_end|>` with a line break. The grammar is deterministic: a marker is a marker wherever it
stands, and backslashes between `<` and `|` of what would be a marker make it text with one
backslash less; in a role `\n`, `\|` and `\\` stand for a line break, a bar and a backslash. Rendered text is parsed again and its turns are compared with the source's; the
turns that came back otherwise (or that took others with them) are escaped by one level, and so
on until what is recovered is identical. Most conversations hold nothing in conflict and are
rendered as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import ranked_whole
from .common import written

START, END = "<|im_start|>", "<|im_end|>"
MARKER = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
SCHEMA = "conv_id bigint, part int, text string, n_turns int, n_escaped int, rounds int"
#: Turns of a conversation that are rendered together.
PART = 1 << 16

Turn = tuple[str, str]


def escaped(content: str) -> str:
    """Content whose markers, and texts that look like escaped ones, have one backslash more."""
    return MARKER.sub(r"<\\\1|\2|>", content)


def _plain(content: str) -> str:
    """Content as the parser gives it: one backslash less in each escaped marker."""
    return MARKER.sub(lambda m: f"<{m[1][1:]}|{m[2]}|>" if m[1] else m[0], content)


def _role_escaped(role: str) -> str:
    """A role has escapes of its own, as it ends with its line."""
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\|")


def _role_plain(role: str) -> str:
    return re.sub(r"\\([\\n|])", lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[Turn], escape: set[int] | frozenset[int] = frozenset()) -> str:
    """The text of a conversation, with the turns in escape escaped."""
    return "".join(f"{START}{_role_escaped(r) if i in escape else r}\n{escaped(c) if i in escape else c}{END}\n" for i, (r, c) in enumerate(turns))


def parse(text: str) -> list[Turn] | None:
    """The turns of a rendered text, or None if it isn't of the grammar. One pass, no backtracking."""
    out: list[Turn] = []
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            return None
        at += len(START)
        end = None
        for m in MARKER.finditer(text, at):
            if not m[1]:
                end = m
                break
        if end is None or end[2] != "im_end":
            return None
        body = text[at : end.start()]
        role, line, content = body.partition("\n")
        if not line or not text.startswith("\n", end.end()):
            return None
        out.append((_role_plain(role), _plain(content)))
        at = end.end() + 1
    return out


def rendered(turns: list[Turn]) -> tuple[str, int, int]:
    """(text, turns escaped, rounds): what parses back to exactly these turns."""
    escape: set[int] = set()
    rounds = 0
    while True:
        rounds += 1
        text = render(turns, escape)
        found = parse(text)
        if found == turns:
            return text, len(escape), rounds
        # a turn is in conflict if it doesn't come back when it stands alone
        wrong = {i for i, t in enumerate(turns) if i not in escape and parse(render([t])) != [t]}
        if not wrong:
            raise AssertionError("an escaped turn didn't come back")
        escape |= wrong


def chat_texts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """conv_id, part, text, n_turns, n_escaped, rounds: each conversation, rendered so that parsing gives its turns back.

    Turns are in the order of turn_col, null first, ties by role and text. A null role or text
    is rendered, and comes back, as an empty one; repeated rows are turns like others; rows
    without a conversation's id are one conversation, with a null id. A conversation of more than `part` turns is
    in parts of that many, from 0, whose texts in a row are its text: its turns are ranked across tasks and none has all
    of them. Other columns are left aside; an empty table gives no rows.
    """
    order = ["turn", "role", "text"]
    one = turns.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    large = written(one.groupBy("conv_id").count().filter(F.col("count") > part).select(F.col("conv_id").alias("__c")), "long-conversations")
    rows = one.withColumn("part", F.lit(0))
    if large.count():
        same = F.col("conv_id").eqNullSafe(F.col("__c"))
        ranked = ranked_whole(one.join(large, same, "left_semi"), ["conv_id"], within=[F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")])
        rows = one.join(large, same, "left_anti").withColumn("part", F.lit(0)).union(ranked.select(*one.columns, F.floor(F.col("rank") / part).cast("int")))
    whole = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("t")).select("conv_id", "part", F.transform("t", lambda t: t["role"]).alias(order[1]), F.transform("t", lambda t: t["text"]).alias(order[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(*rendered(list(zip(r, t, strict=True))), len(r)) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            text, n_escaped, rounds, n_turns = (list(x) for x in zip(*made, strict=True)) if made else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(n_turns, pa.int32()), pa.array(n_escaped, pa.int32()), pa.array(rounds, pa.int32())], names=["conv_id", "part", "text", "n_turns", "n_escaped", "rounds"])

    return whole.mapInArrow(run, SCHEMA)


def turns_of(chats: DataFrame, conv_col: str = "conv_id", text_col: str = "text") -> DataFrame:
    """conv_id, turn (from 0 in each row's text), role, text: the turns that rendered texts parse to; none for null texts and those outside the grammar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, i, r, t) for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, (r, t) in enumerate((parse(x) if x is not None else None) or [])]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["conv_id", "turn", "role", "text"])

    return chats.select(F.col(conv_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "conv_id bigint, turn int, role string, text string")
