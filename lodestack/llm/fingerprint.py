"""Threshold-scaled sketches: of all shingle hashes, those below a fixed fraction of the hash range.

The fraction is the same for every document, so that the sketch of a union is the union of the
sketches, and the share of a small document's sketch found in a large one's estimates
containment however unequal the two are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a shingle, and the part of the hash range that is kept.
SHINGLE, FRACTION = 5, 1 / 16
#: Hexadecimal digits of md5 that make a hash.
DIGITS = 15


def threshold(fraction: float) -> str:
    """The hexadecimal bound below which a hash is kept."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    return "g" if fraction == 1 else format(int(fraction * 16**DIGITS), f"0{DIGITS}x")


def words(text: Column) -> Column:
    """Lower-case runs without white space; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r\f\v]+"), lambda w: w != "")


def _bound(value: Column, body) -> Column:
    """body of value, with value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def kept_hashes(ws: Column, size: int, fraction: float) -> Column:
    """Sorted distinct kept hashes of the shingles of an array of words."""
    limit = threshold(fraction)
    last = F.greatest(F.size(ws) - size, F.lit(0))
    md5 = F.transform(F.sequence(F.lit(0), last), lambda i: F.md5(F.concat_ws(" ", *(F.get(ws, i + j) for j in range(size))).cast("binary")))
    kept = F.array_distinct(F.filter(md5, lambda h: h < F.lit(limit)))
    return F.array_sort(F.transform(kept, lambda h: F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("bigint")))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """id_col, n_shingles, sketch of every row, in one pass without a shuffle or Python.

    Shingles are runs of size words in lower case; a text of fewer words is one shingle, and a
    null or empty one has none and an empty sketch. Repeated rows each have a row, a null id
    stays null, and other columns are left aside. n_shingles counts shingles with repeats.
    """
    none = F.array().cast("array<bigint>")
    found = _bound(words(F.col(text_col)), lambda w: F.struct(F.when(F.size(w) == 0, 0).otherwise(F.greatest(F.size(w) - size + 1, F.lit(1))).cast("bigint").alias("n"), F.when(F.size(w) == 0, none).otherwise(kept_hashes(w, size, fraction)).alias("kept")))
    return docs.select(F.col(id_col), found.alias("__f")).select(id_col, F.col("__f.n").alias("n_shingles"), F.col("__f.kept").alias("sketch"))


def merged_rows(sketched: DataFrame, by: str, sketch_col: str = "sketch") -> DataFrame:
    """by, hash: the sketch of each group's union, a row a hash: no group is put together, whatever it holds. Empty sketches give no rows."""
    return sketched.select(F.col(by), F.explode(sketch_col).alias("hash")).distinct()


def merge(sketched: DataFrame, by: str, sketch_col: str = "sketch") -> DataFrame:
    """by, sketch: the same as an array, for groups whose sketch fits into a row; a group of empty sketches has an empty one."""
    one = sketched.select(F.col(by), F.explode_outer(sketch_col).alias("__h"))
    return one.groupBy(by).agg(F.array_sort(F.collect_set("__h")).alias("sketch"))


def containment(small: DataFrame, large: DataFrame, small_id: str, large_id: str, least: float = 0.5) -> DataFrame:
    """small_id, large_id, shared, containment: pairs of which at least `least` of the small one's sketch lies in the large one's.

    Only the hashes of a small sketch that are rarest among the large ones are joined, as many as a pair
    can't miss altogether; a passage that very many documents share makes no pairs unless a document is little
    else. Pairs found are counted on their sketches. Rows with an empty sketch are in no pair. Ids name rows: rows that
    share an id are taken as one.
    """
    whole = lambda df, i: df.select(F.col(i).alias("__i"), F.explode("sketch").alias("__h")).distinct()
    a, b = whole(small, small_id), whole(large, large_id)
    often = b.groupBy("__h").agg(F.count("*").alias("__c"))
    size = a.groupBy("__i").agg(F.count("*").alias("__n"))
    met = a.join(often, "__h").groupBy("__i").agg(F.array_sort(F.collect_list(F.struct("__c", "__h"))).alias("__m")).join(size, "__i")
    # sorted by how often the large ones have them, hashes that none has come first
    first = F.col("__n") - F.ceil(F.col("__n") * F.lit(least) - F.lit(1e-9)) + 1 - (F.col("__n") - F.size("__m"))
    some = met.select("__i", F.explode(F.slice("__m", F.lit(1), F.greatest(F.least(first, F.size("__m")), F.lit(0)).cast("int"))).alias("__x")).select(F.col("__i").alias("__a"), F.col("__x.__h").alias("__h"))
    pairs = some.join(b.select(F.col("__i").alias("__b"), "__h"), "__h").select("__a", "__b").distinct()
    lists = lambda df, i, to: df.groupBy("__i").agg(F.collect_list("__h").alias(to)).withColumnRenamed("__i", i)
    found = pairs.join(lists(a, "__a", "__s"), "__a").join(lists(b, "__b", "__l"), "__b").withColumn("shared", F.size(F.array_intersect("__s", "__l")).cast("bigint"))
    return found.select(F.col("__a").alias(small_id), F.col("__b").alias(f"in_{large_id}" if small_id == large_id else large_id), "shared", (F.col("shared") / F.size("__s")).alias("containment")).filter(F.col("containment") >= least)
