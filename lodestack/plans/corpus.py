"""A corpus of Python files rendered from tables, so that what a parser finds can be told from rows.

One file a nation: exports for its suppliers with an even key, a class with a method for every
supplier whose key 5 divides, a function for every supplier under a name that repeats across
files, with a call for each name that its line items' neighbours in their orders give.
BLOCKS is read by Spark and DuckDB alike; a file is its blocks in the order of sect, k, sub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import cut

TABLES = ("nation", "supplier", "lineitem")

BLOCKS = """
WITH s AS (
  SELECT s_suppkey AS k, s_name, s_nationkey AS n, 'f_' || CAST(s_suppkey % 17 AS STRING) AS f FROM supplier
), c AS (
  SELECT DISTINCT a.l_suppkey AS k, 'f_' || CAST(b.l_suppkey % 17 AS STRING) AS callee, b.l_suppkey % 17 AS j
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
), x AS (
  SELECT n_nationkey AS n, 0 AS sect, 0 AS k, 0 AS sub, 'head' AS kind, '' AS name, '\"\"\"Módulo of ' || n_name || '.\"\"\"' || chr(10) || 'import os' || chr(10) || 'from collections import OrderedDict as od' || chr(10) || chr(10) || '__all__ = [' AS txt FROM nation
  UNION ALL SELECT n, 1, k, 0, 'export', f, '\"' || f || '\", ' FROM s WHERE k % 2 = 0
  UNION ALL SELECT n_nationkey, 2, 0, 0, 'text', '', ']' || chr(10) || chr(10) FROM nation
  UNION ALL SELECT n_nationkey, 3, 0, 0, 'class', 'C' || CAST(n_nationkey AS STRING), 'class C' || CAST(n_nationkey AS STRING) || '(Base):' || chr(10) || '    \"\"\"Holds ' || n_name || '.\"\"\"' || chr(10) FROM nation
  UNION ALL SELECT n, 4, k, 0, 'method', 'm_' || CAST(k AS STRING), '    def m_' || CAST(k AS STRING) || '(self, a: C' || CAST(n AS STRING) || '):' || chr(10) || '        return ' || f || '(a)' || chr(10) FROM s WHERE k % 5 = 0
  UNION ALL SELECT n_nationkey, 5, 0, 0, 'text', '', chr(10) FROM nation
  UNION ALL SELECT n, 6, k, 0, 'decorator', f, '@wrap' || chr(10) FROM s WHERE k % 2 = 1
  UNION ALL SELECT n, 6, k, 1, 'def', f, 'def ' || f || '(a: C' || CAST(n AS STRING) || ', b=1):' || chr(10) || '    \"\"\"' || s_name || '.\"\"\"' || chr(10) FROM s
  UNION ALL SELECT s.n, 6, s.k, CAST(10 + c.j AS INT), 'call', c.callee, '    x = ' || c.callee || '(a)' || chr(10) FROM s JOIN c ON s.k = c.k
  UNION ALL SELECT n, 6, k, 40, 'if', f, '    if a:' || chr(10) || '        b += 1' || chr(10) FROM s WHERE k % 3 = 1
  UNION ALL SELECT n, 6, k, 40, 'ifs', f, '    if a and b:' || chr(10) || '        if b:' || chr(10) || '            b += 1' || chr(10) FROM s WHERE k % 3 = 2
  UNION ALL SELECT n, 6, k, 50, 'return', f, '    return x' || chr(10) FROM s
  UNION ALL SELECT n, 7, 0, 0, 'main', 'f_' || CAST(min(k) % 17 AS STRING), chr(10) || 'if __name__ == \"__main__\":' || chr(10) || '    f_' || CAST(min(k) % 17 AS STRING) || '(1)' || chr(10) FROM s GROUP BY n
)
SELECT 'm' || CAST(n AS STRING) || '.py' AS path, CAST(sect AS INT) AS sect, CAST(k AS BIGINT) AS k, CAST(sub AS INT) AS sub, kind, name, txt FROM x
"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, sect, k, sub, kind, name, txt."""
    text = BLOCKS
    for t in TABLES:
        for before in ("FROM", "JOIN"):
            text = text.replace(f"{before} {t} ", f"{before} {{{t}}} ").replace(f"{before} {t}\n", f"{before} {{{t}}}\n")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, module, src of the rendered files, kept in the checkpoint folder."""
    rows = blocks(spark, sf_dir).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sect", "k", "sub", "txt"))), lambda x: x["txt"]), "").alias("text"))
    return cut(rows.select("path", F.col("path").alias("module"), F.encode("text", "UTF-8").alias("src")))
