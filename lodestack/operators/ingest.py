"""What a free-text query names: files, test ids, functions, classes, stack frames, diffs, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keywords

TEXT_KEYS = ("title", "body", "message", "error", "trace", "description", "hint", "prompt", "query", "task")
LIST_KEYS = ("tests", "test_list", "hints", "files", "patch", "diff")


def unwrapped(raw: str) -> Column:
    """The texts of a JSON object's known keys, a line each; other texts as they are. Items of lists that aren't texts are given as JSON."""
    v = f"try_parse_json({raw})"

    def kind(k: str) -> str:
        return f"coalesce(schema_of_variant(variant_get({v}, '$.{k}')), '')"

    texts = [F.expr(f"case when {kind(k)} = 'STRING' then array(variant_get({v}, '$.{k}', 'string')) else array() end") for k in TEXT_KEYS]
    lists = [F.expr(f"case when {kind(k)} = 'STRING' then array(variant_get({v}, '$.{k}', 'string')) when {kind(k)} like 'ARRAY%' then transform(variant_get({v}, '$.{k}', 'array<variant>'), x -> cast(x as string)) else array() end") for k in LIST_KEYS]
    found = F.concat(*texts, *lists)
    is_object = F.expr(f"coalesce(schema_of_variant({v}), '') like 'OBJECT%'")
    return F.when(is_object & (F.size(found) > 0), F.array_join(found, "\n")).otherwise(F.coalesce(F.col(raw), F.lit("")))


def signals(queries: DataFrame, key: str = "query_id", raw: str = "raw") -> DataFrame:
    """key, raw, keywords, files, nodeids, functions, classes, stack_hits, diffs; sets are sorted.

    The first token of every line that isn't blank counts as a test id and a file, as the
    pattern for test ids fits any token.
    """
    one = queries.select(key, unwrapped(raw).alias("raw")).withColumn("lines", F.split(F.regexp_replace("raw", "\r\n?", "\n"), "\n"))
    node = r"([^:\s]+)(?:::([\w.]+))?(?:::([\w.]+))?"
    frame = r'File "([^"]+)", line (\d+), in (\w+)'
    diff = r"^(?:\+\+\+ b/(.+)|--- a/(.+))$"
    some = lambda a: F.filter(a, lambda x: x != "")
    ids = F.flatten(F.transform("lines", lambda x: F.regexp_extract_all(x, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))))
    hits = F.transform(F.filter("lines", lambda x: x.rlike(frame)), lambda x: F.struct(F.regexp_extract(x, frame, 1).alias("file"), F.regexp_extract(x, frame, 2).cast("int").alias("line"), F.regexp_extract(x, frame, 3).alias("func")))
    diffs = some(F.transform("lines", lambda x: F.concat(F.regexp_extract(x, diff, 1), F.regexp_extract(x, diff, 2))))
    like_path = F.filter("lines", lambda x: (F.contains(x, F.lit("/")) | F.contains(x, F.lit("\\"))) & (F.endswith(x, F.lit(".py")) | F.contains(x, F.lit(".py:"))))
    heads = some(F.transform(like_path, lambda x: F.regexp_extract(x, r"^\s*([^:\s]*)", 1)))
    sets = lambda *a: F.array_sort(F.array_distinct(F.concat(*a)))
    return one.select(
        key,
        "raw",
        F.array_sort(keywords("raw")).alias("keywords"),
        sets(some(F.transform("lines", lambda x: F.regexp_extract(x, node, 1))), F.transform(hits, lambda h: h["file"]), diffs, heads).alias("files"),
        sets(some(F.transform("lines", lambda x: F.regexp_extract(x, node, 0)))).alias("nodeids"),
        sets(F.filter(ids, lambda x: ~x.rlike("^[A-Z]"))).alias("functions"),
        sets(F.filter(ids, lambda x: x.rlike("^[A-Z]"))).alias("classes"),
        hits.alias("stack_hits"),
        sets(diffs).alias("diffs"),
    )
