"""What fits into a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def knapsack(items: DataFrame, by: list[str], budget: int, key: str = "key", benefit: str = "benefit", cost: str = "cost") -> DataFrame:
    """by, key, pos: greedy by benefit per cost, then benefit, then less cost, then key; what doesn't fit is passed over.

    Costs under 1 count as 1. As room only shrinks, of the items of one cost no more can be taken than fit into
    the whole budget, and the first ones: the rest are left out before a group is put together, in
    an array of no more than budget x ln(budget) or so, over which a fold runs inside the JVM.
    """
    one = F.greatest(F.coalesce(F.col(cost), F.lit(1)), F.lit(1)).cast("bigint")
    if budget <= 0:
        return items.select(*by, key, F.lit(0).alias("pos")).limit(0)
    alike = Window.partitionBy(*by, "__cost").orderBy(F.desc(benefit), key)
    some = items.withColumn("__cost", one).filter(F.col("__cost") <= budget).withColumn("__i", F.row_number().over(alike)).filter(F.col("__i") <= budget).filter(F.col("__i") * F.col("__cost") <= budget)
    row = F.struct((-F.col(benefit) / F.col("__cost")).alias("ratio"), (-F.col(benefit)).alias("gain"), F.col("__cost").alias("cost"), F.col(key).alias("key"))
    grouped = some.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = items.schema[key].dataType.simpleString()
    zero = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(state, x):
        fits = x["cost"] <= state["left"]
        return F.struct(F.when(fits, state["left"] - x["cost"]).otherwise(state["left"]).alias("left"), F.when(fits, F.concat(state["out"], F.array(x["key"]))).otherwise(state["out"]).alias("out"))

    return grouped.select(*by, F.posexplode(F.aggregate("rows", zero, step)["out"]).alias("pos", key)).withColumn("pos", F.col("pos") + 1)


def prefix(items: DataFrame, by: list[str], max_chars: int, order: list, size: str = "size") -> DataFrame:
    """Rows in order until the first that would take the running size beyond max_chars."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= max_chars)


def first_k(items: DataFrame, by: list[str], k: int, order: list) -> DataFrame:
    """The first k rows of each group."""
    return items.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__k") <= k).drop("__k")
