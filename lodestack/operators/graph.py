"""The call graph: edges, PageRank, neighbours and bounded walks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .tables import cut


def call_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """src, dst, weight: a call of a name goes to all functions of that name; calls of oneself don't count.

    calls: caller, callee_symbol, cnt; functions: qname, name.
    """
    hit = calls.join(functions.select(F.col("qname").alias("dst"), F.col("name").alias("callee_symbol")), "callee_symbol")
    return hit.filter(F.col("caller") != F.col("dst")).groupBy(F.col("caller").alias("src"), "dst").agg(F.sum("cnt").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst: callers and callees of every function."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, most: int = 100, fixed: int | None = None, every: int = 3) -> DataFrame:
    """qname, rank: weighted PageRank; what nodes without edges hold is dealt to all.

    Stops when ranks move by less than tolerance in all, after `most` iterations, or after
    `fixed` ones if that is given. Edges are put by their source once and stay there: an iteration sends
    ranks and sums only. The ranks are kept in one job that also tells how far they moved, every few iterations where that isn't asked.
    """
    n = nodes.count()
    if not n:
        return nodes.select("qname", F.lit(0.0).alias("rank"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")).repartition(parts, "src"))
    now = nodes.select("qname").distinct().join(out.select(F.col("src").alias("qname"), F.lit(False).alias("dangling")), "qname", "left")
    now = cut(now.select("qname", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / n).alias("rank")).repartition(parts, "qname"))
    for k in range(1, (fixed or most) + 1):
        lost = F.broadcast(now.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost")))
        got = share.join(now.select(F.col("qname").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("qname")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        new = now.withColumnRenamed("rank", "old").join(got, "qname", "left").crossJoin(lost)
        new = new.select("qname", "dangling", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n).alias("rank"), "old")
        if fixed is not None and k % every and k < fixed:
            now = new.drop("old")
            continue
        moved = Observation()
        now = cut(new.observe(moved, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("by")).drop("old").repartition(parts, "qname"))
        if fixed is None and (moved.get["by"] or 0.0) < tolerance:
            break
    return now.select("qname", "rank")


def within_depth(seeds: DataFrame, edges: DataFrame, depth: int, by: list[str] | None = None) -> DataFrame:
    """by, qname, depth: what is reached from the seeds (by, qname) in at most depth steps, at its least depth.

    A step writes what is new and no more; it ends where nothing is.
    """
    by = by or []
    seen = level = cut(seeds.select(*by, "qname", F.lit(0).alias("depth")).distinct())
    for d in range(1, depth + 1):
        step = level.select(*by, F.col("qname").alias("src")).join(edges.select("src", "dst"), "src")
        new = step.select(*by, F.col("dst").alias("qname")).distinct()
        level = cut(new.join(seen.select(*by, "qname"), [*by, "qname"], "left_anti").select(*by, "qname", F.lit(d).alias("depth")))
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen


def _renamed(df: DataFrame) -> DataFrame:
    """df with columns of its own, for grouping it together with another table made of the same rows."""
    return df.select(*(F.col(c).alias(c, metadata={}) for c in df.columns)).toDF(*df.columns)


def expanded(seeds: DataFrame, edges: DataFrame, depth: int, most: int, strict: bool = False, by: str = "query_id") -> DataFrame:
    """by, qname, pos: seeds, then callees level by level in order, up to `most` more of them.

    seeds: by, qname, pos; edges: src, dst, ord (the order of a caller's callees; ties by dst). The
    cap is looked at within a callee's matches only, so that each callee left may add one beyond it;
    strict stops at the cap. A level is one join; the fold that keeps the order runs per query, over the calls
    of what can have its turn in it. Of a callee's matches it looks at no more than seeds and `most` together: all it looked at
    are then in the list, which is full. Others aren't sent to it.
    """
    if depth <= 0 or most <= 0:
        return seeds.select(by, "qname", "pos")
    seeds = cut(seeds.select(by, "qname", "pos"))
    reach = seeds.withColumn("level", F.lit(0))
    cap = (seeds.groupBy(by).count().agg(F.max("count")).first()[0] or 0) + most
    # what the last step adds makes none itself
    pool = within_depth(seeds, edges, depth - 1, [by]).drop("depth")
    local = pool.join(edges.withColumnRenamed("src", "qname"), "qname").select(by, "qname", "dst", "ord", "callee")
    place = F.dense_rank().over(Window.partitionBy(by, "qname", "ord", "callee").orderBy("dst"))
    local = local.withColumn("place", place).filter(F.col("place") <= cap).drop("place")

    def fold(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        roots = left.sort_values("pos")["qname"].tolist()
        out: dict[str, list[list[str]]] = {}
        for (src, _, _), rows in right.sort_values(["qname", "ord", "callee", "dst"]).groupby(["qname", "ord", "callee"], sort=True):
            out.setdefault(src, []).append(rows["dst"].tolist())
        order, seen, cap, level = list(roots), set(roots), len(roots) + most, list(roots)
        for _ in range(depth):
            new: list[str] = []
            for src in level:
                for matches in out.get(src, []):
                    for dst in matches:
                        if strict and len(order) >= cap:
                            break
                        if dst not in seen:
                            seen.add(dst)
                            order.append(dst)
                            new.append(dst)
                        if len(order) >= cap:
                            break
            level = new
            if not level or len(order) >= cap:
                break
        return pd.DataFrame({by: [key[0]] * len(order), "qname": order, "pos": range(1, len(order) + 1)})

    kind = seeds.schema[by].dataType.simpleString()
    return _renamed(reach).groupBy(by).cogroup(_renamed(local).groupBy(by)).applyInPandas(fold, f"{by} {kind}, qname string, pos int")


def fused_walk(seeds: DataFrame, edges: DataFrame, scores: DataFrame, depth: int, top_k: int, by: str = "query_id") -> DataFrame:
    """by, qname, pos: breadth first from the seeds, best neighbours first, no more than top_k in all.

    seeds: by, qname, pos; edges both ways: src, dst; scores: by, qname, final. As neighbours
    enter only while there is room, a full list of seeds stays as it is.
    """
    if depth <= 0:
        return seeds.filter(F.col("pos") <= top_k).select(by, "qname", "pos")
    w = Window.partitionBy(by)
    short = seeds.withColumn("n", F.count("*").over(w)).filter(F.col("n") < top_k).drop("n")
    full = seeds.withColumn("n", F.count("*").over(w)).filter((F.col("n") >= top_k) & (F.col("pos") <= top_k)).select(by, "qname", "pos")
    # every step of the walk takes room, so that no more than top_k steps are ever made
    pool = within_depth(short, edges, top_k, [by]).drop("depth")
    local = pool.join(edges.withColumnRenamed("src", "qname"), "qname").join(scores.select(by, F.col("qname").alias("dst"), "final"), [by, "dst"], "left").select(by, "qname", "dst", F.coalesce("final", F.lit(0.0)).alias("final"))

    def fold(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        queue = left.sort_values("pos")["qname"].tolist()
        near = {s: r.sort_values(["final", "dst"], ascending=[False, True])["dst"].tolist() for s, r in right.groupby("qname")}
        seen, order = set(queue), []
        while queue and len(order) < top_k:
            now = queue.pop(0)
            order.append(now)
            for v in near.get(now, []):
                if v not in seen and len(order) + len(queue) < top_k:
                    seen.add(v)
                    queue.append(v)
        return pd.DataFrame({by: [key[0]] * len(order), "qname": order, "pos": range(1, len(order) + 1)})

    kind = seeds.schema[by].dataType.simpleString()
    return full.union(_renamed(short).groupBy(by).cogroup(_renamed(local).groupBy(by)).applyInPandas(fold, f"{by} {kind}, qname string, pos int"))
