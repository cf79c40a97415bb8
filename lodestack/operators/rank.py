"""Ranks, their fusion, and what is kept of them.

Ranked lists are rows (query, channel, key, rank) with ranks from 0. Every choice is a total
order: score first, then key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rounded
from .tables import cut


def ranked(scores: DataFrame, by: list[str], key: str = "key", score: str = "score") -> DataFrame:
    """scores with rank from 0 within by."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))) - 1)


def reciprocal_ranks(lists: DataFrame, by: list[str], key: str = "key", k: int = 60) -> DataFrame:
    """by, key, score: the sum over channels of 1 / (k + rank + 1)."""
    return lists.groupBy(*by, key).agg(F.sum(1 / (F.lit(k) + F.col("rank") + 1)).alias("score"))


def fused_ranks(*ranks: Column, k: int = 60) -> Column:
    """reciprocal_ranks() of a pair whose ranks in all channels lie in one row."""
    return sum((1 / (F.lit(k) + r + 1) for r in ranks[1:]), 1 / (F.lit(k) + ranks[0] + 1))


def ranked_whole(scores: DataFrame, by: list[str], key: str = "key", score: str = "score", within: list[Column] | None = None) -> DataFrame:
    """ranked() at any size of a group: rows are sorted across tasks, and a task's ranks start where the ones before it end.

    Without by, the whole table is one group. Null scores come last; within is another order. Only a row a task and group is sent for the
    starts, and these are broadcast: no more than tasks and groups together.
    """
    order = [*by, *(within or [F.desc_nulls_last(score), F.asc(key)])]
    rows = cut(scores).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__task", F.shiftrightunsigned("__at", 33)))
    starts = rows.groupBy("__task", *by).agg(F.count("*").alias("__n"), F.min("__at").alias("__from"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    same = F.col("__task") == F.col("__t")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    starts = starts.select(F.col("__task").alias("__t"), *(F.col(c).alias(f"__by_{c}") for c in by), "__from", "__before")
    return rows.join(F.broadcast(starts), same).withColumn("rank", (F.col("__at") - F.col("__from") + F.col("__before")).cast("bigint")).select(*scores.columns, "rank")


def over_max(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Scores over their maximum in each group; over 1 where that is 0."""
    top = F.max(score).over(Window.partitionBy(*by))
    return scores.withColumn(score, F.col(score) / F.when(top != 0, top).otherwise(1.0))


def min_max(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Scores moved and scaled to [0, 1] in each group."""
    w = Window.partitionBy(*by)
    low, width = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    return scores.withColumn(score, (F.col(score) - low) / F.when(width != 0, width).otherwise(1.0))


def chosen_roots(lexical: DataFrame, structural: DataFrame, by: list[str], top_k: int, key: str = "key", lexical_share: float = 0.5, k: int = 60, dense: DataFrame | None = None) -> DataFrame:
    """by, key, pos: the first ceil(top_k x lexical_share) of the lexical list, then the fused ones, without repeats.

    lexical, structural and dense hold by, key, rank. A group without a lexical list has its structural order.
    """
    if top_k <= 0:
        return structural.select(*by, key, F.lit(0).alias("pos")).limit(0)
    keep = max(0, min(top_k, math.ceil(top_k * max(0.0, min(1.0, lexical_share)))))
    asked = lexical.select(*by).distinct()
    lists = lexical.select(*by, key, "rank").union(structural.join(asked, by, "left_semi").select(*by, key, "rank"))
    if dense is not None:
        lists = lists.union(dense.select(*by, key, "rank"))
    fused = reciprocal_ranks(lists, by, key, max(1, k)).withColumn("score", rounded(F.col("score"), 12))
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key))
    order = lexical.filter(F.col("rank") < keep).select(*by, key, F.col("rank").cast("bigint").alias("o")).union(fused.select(*by, key, (pos + keep).cast("bigint").alias("o")))
    order = order.union(structural.join(asked, by, "left_anti").select(*by, key, F.col("rank").cast("bigint").alias("o")))
    one = order.groupBy(*by, key).agg(F.min("o").alias("o"))
    return one.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("o"))).filter(F.col("pos") <= top_k).drop("o")


def chosen_depth(top_k: int, k: int = 60) -> int:
    """The top_k first of a channel fuse to over 1 / (k + top_k); beyond this rank in both channels no pair reaches that."""
    return 2 * (k + top_k)


def chosen_roots_of(pairs: DataFrame, by: list[str], top_k: int, key: str = "key", lexical_share: float = 0.5, k: int = 60) -> DataFrame:
    """chosen_roots() of pairs that hold both full ranks, rank and structural, in one row: they are read once."""
    keep = max(0, min(top_k, math.ceil(top_k * max(0.0, min(1.0, lexical_share)))))
    near = pairs.filter(F.least("rank", "structural") <= chosen_depth(top_k, k)).withColumn("score", rounded(fused_ranks(F.col("rank"), F.col("structural"), k=k), 12))
    w = Window.partitionBy(*by)
    near = near.withColumn("fused", F.row_number().over(w.orderBy(F.desc("score"), key)) + keep)
    first = F.row_number().over(w.orderBy(F.when(F.col("rank") < keep, F.col("rank")).otherwise(F.col("fused"))))
    return near.withColumn("pos", first).filter(F.col("pos") <= top_k).select(*by, key, "pos")


def hybrid_scores(lexical: DataFrame, by: list[str], key: str = "key", k: int = 60, dense: DataFrame | None = None) -> DataFrame:
    """by, key, fused (fusion over its maximum), top_lexical, top_dense: what the retrieval gate looks at.

    lexical and dense hold by, key, score, rank.
    """
    lists = lexical.select(*by, key, "rank")
    if dense is not None:
        lists = lists.union(dense.select(*by, key, "rank"))
    fused = over_max(reciprocal_ranks(lists, by, key, max(1, k)), by).withColumnRenamed("score", "fused")
    tops = lexical.groupBy(*by).agg(F.max("score").alias("top_lexical"))
    tops = tops.withColumn("top_dense", F.lit(None).cast("double")) if dense is None else tops.join(dense.groupBy(*by).agg(F.max("score").alias("top_dense")), by, "left")
    return fused.join(tops, by)


def hybrid_scores_of(ranked: DataFrame, by: list[str], k: int = 60) -> DataFrame:
    """hybrid_scores() of one channel with its full ranks (rank, score), with fused and top_lexical: tops are a row a group and broadcast."""
    one = ranked.withColumn("fused", fused_ranks(F.col("rank"), k=max(1, k)))
    tops = one.groupBy(*by).agg(F.max("score").alias("top_lexical"), F.max("fused").alias("__top"))
    return one.join(F.broadcast(tops), by).withColumn("fused", F.col("fused") / F.when(F.col("__top") != 0, F.col("__top")).otherwise(1.0)).drop("__top")


def should_retrieve(query: Column, top_lexical: Column, top_dense: Column, lexical_least: float = 0.05, dense_least: float = 0.05) -> Column:
    """A query that isn't empty and has one hit at least that is good enough."""
    return (F.coalesce(query, F.lit("")) != "") & (F.coalesce(top_lexical >= lexical_least, F.lit(False)) | F.coalesce(top_dense >= dense_least, F.lit(False)))


def blended(base: Column, query_score: Column, weight: float) -> Column:
    """(1 - weight) x base + weight x query score, missing ones 0, weight held in [0, 1]."""
    w = max(0.0, min(1.0, weight))
    return (1 - w) * F.coalesce(base, F.lit(0.0)) + w * F.coalesce(query_score, F.lit(0.0))


def reranked_half(scored: DataFrame, lexical: str = "score", similarity: str = "similarity") -> Column:
    """Half the raw lexical score, half the cosine."""
    return 0.5 * F.col(lexical) + 0.5 * F.col(similarity)


def reranked_scaled(by: list[str], lexical: str = "score", similarity: str = "similarity") -> Column:
    """Half of each after division by its maximum (plus 1e-9) where that is positive."""
    w = Window.partitionBy(*by)
    scale = lambda c: F.when(F.max(c).over(w) > 0, F.col(c) / (F.max(c).over(w) + 1e-9)).otherwise(F.col(c))
    return 0.5 * scale(lexical) + 0.5 * scale(similarity)


def gated_seeds(candidates: DataFrame, by: list[str], top_k: int, least: float, key: str = "key") -> DataFrame:
    """by, key, final, pos: seeds under the lexical gate.

    candidates hold by, key, final (score), lex_rank (from 0, null if not ranked), passes. The
    first round(least x top_k) of the lexical ranking that pass come first, then those that pass
    by score until top_k; if none passes, the top_k by score. One more than top_k can't result:
    a list that is full of lexical seeds is cut to top_k. Only the first rows of each order are put together.
    """
    need = max(0, min(top_k, round(least * top_k)))
    w = Window.partitionBy(*by)
    first = candidates.filter(F.col("passes") & F.col("lex_rank").isNotNull())
    first = first.withColumn("at", F.row_number().over(w.orderBy("lex_rank", key))).filter(F.col("at") <= need)
    best = w.orderBy(F.desc("final"), key)
    passing = candidates.filter("passes").withColumn("at", F.row_number().over(best)).filter(F.col("at") <= top_k + need)
    none = candidates.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= top_k)
    none = none.join(candidates.filter("passes").select(*by).distinct(), by, "left_anti")
    rows = first.select(*by, key, "final", "at").union(passing.union(none).select(*by, key, "final", F.col("at") + need))
    one = rows.groupBy(*by, key).agg(F.min("at").alias("at"), F.max("final").alias("final"))
    return one.withColumn("pos", F.row_number().over(w.orderBy("at"))).filter(F.col("pos") <= top_k).select(*by, key, "final", "pos")
