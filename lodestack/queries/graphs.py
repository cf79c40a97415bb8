"""The call graph of the rendered corpus; walks and ranks over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, parse
from ..operators.tables import cut
from ..plans import corpus

QUERIES: dict = {}
SQL: dict[str, str] = {}
ITERATIONS = 10


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def parsed(spark, sf_dir) -> DataFrame:
    return cut(parse.parsed(corpus.files(spark, sf_dir)))


#: Blocks, and what they say of symbols: fn has a row a definition with its last one marked, ca a row a call.
B = f"""bl AS ({corpus.BLOCKS}),
pl AS (SELECT *, CAST(sum(strlen(txt)) OVER w AS BIGINT) - strlen(txt) AS b0, CAST(sum(len(txt) - len(replace(txt, chr(10), ''))) OVER w AS BIGINT) - (len(txt) - len(replace(txt, chr(10), ''))) + 1 AS l0
  FROM bl WINDOW w AS (PARTITION BY path ORDER BY sect, k, sub, name ROWS UNBOUNDED PRECEDING)),
fx AS (
  SELECT path, k, min(b0) AS start_byte, max(b0 + strlen(txt)) - 1 AS end_byte, min(l0) AS lineno, max(l0) AS end_lineno, max(name) FILTER (WHERE kind = 'def') AS name, string_agg(txt, '' ORDER BY sub, name) AS code,
    count(*) FILTER (WHERE kind = 'if') + 3 * count(*) FILTER (WHERE kind = 'ifs') + 1 AS cc
  FROM pl WHERE sect = 6 AND kind <> 'decorator' GROUP BY path, k),
fd AS (
  SELECT path, 'function' AS kind, name, path || '::' || name AS qname, start_byte, end_byte, lineno, end_lineno, cc, k, 0 AS depth FROM fx
  UNION ALL SELECT path, 'function', name, path || '::C' || replace(substr(path, 2), '.py', '') || '::' || name, b0 + 4, b0 + strlen(txt) - 1, l0, l0 + 1, 1, k, 1 FROM pl WHERE kind = 'method'),
fn AS (SELECT *, row_number() OVER (PARTITION BY path, qname ORDER BY k DESC) = 1 AS stays FROM fd),
ca AS (
  SELECT a.path || '::' || d.name AS caller, a.name AS callee FROM pl a JOIN fx d ON a.path = d.path AND a.k = d.k WHERE a.kind = 'call'
  UNION ALL SELECT path || '::C' || replace(substr(path, 2), '.py', '') || '::' || name, 'f_' || CAST(k % 17 AS VARCHAR) FROM pl WHERE kind = 'method'),
cs AS (SELECT caller, callee AS callee_symbol, count(*) AS cnt FROM ca GROUP BY caller, callee),
ed AS (SELECT caller AS src, f.qname AS dst, CAST(sum(cnt) AS BIGINT) AS weight FROM cs JOIN fn f ON f.name = callee_symbol AND f.stays WHERE caller <> f.qname GROUP BY caller, f.qname)"""
# sums of whole numbers are HUGEINT in DuckDB


def edges_of(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    functions = parse.symbols(p, "function")
    return functions, graph.call_edges(parse.call_sites(p), functions)


@query(f"WITH {B} SELECT src, dst, weight FROM ed")
def call_edges(spark, sf_dir):
    return edges_of(parsed(spark, sf_dir))[1]


def ranks(most: int) -> str:
    """pr: the ranks of every function after each of the first iterations."""
    return f"""n AS (SELECT count(*) AS n FROM fn WHERE stays), ot AS (SELECT src, sum(weight) AS total FROM ed GROUP BY src),
pr AS (
  SELECT 0 AS it, qname, 1.0::DOUBLE / n AS rank FROM fn, n WHERE stays
  UNION ALL
  SELECT it + 1, qname, 0.85 * (sum(got) + max(lost) / n) + 0.15 / n FROM (
    SELECT p.it, p.qname, 0.0::DOUBLE AS got, (SELECT coalesce(sum(x.rank), 0) FROM pr x WHERE x.qname NOT IN (SELECT src FROM ot)) AS lost FROM pr p
    UNION ALL SELECT p.it, ed.dst, p.rank * ed.weight / ot.total, 0 FROM pr p JOIN ed ON ed.src = p.qname JOIN ot ON ot.src = p.qname
  ), n WHERE it < {most} GROUP BY it, qname, n
)"""


@query(f"WITH RECURSIVE {B}, {ranks(ITERATIONS)} SELECT qname, floor(rank * 1e9 + 0.5) / 1e9 AS rank FROM pr WHERE it = {ITERATIONS}")
def pagerank_fixed(spark, sf_dir):
    functions, edges = edges_of(parsed(spark, sf_dir))
    return graph.pagerank(functions.select("qname"), edges, fixed=ITERATIONS).withColumn("rank", T.rounded(F.col("rank"), 9))


@query(f"""WITH RECURSIVE {B}, {ranks(100)},
er AS (SELECT b.it, sum(abs(b.rank - a.rank)) AS moved FROM pr a JOIN pr b ON b.it = a.it + 1 AND b.qname = a.qname GROUP BY b.it),
en AS (SELECT coalesce(min(it) FILTER (WHERE moved < 1e-6), 100) AS it FROM er)
SELECT qname, floor(rank * 1e9 + 0.5) / 1e9 AS rank FROM pr JOIN en USING (it)""")
def pagerank(spark, sf_dir):
    functions, edges = edges_of(parsed(spark, sf_dir))
    return graph.pagerank(functions.select("qname"), edges).withColumn("rank", T.rounded(F.col("rank"), 9))


_NEAR = "bo AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed)"


@query(f"WITH {B}, {_NEAR} SELECT src, dst FROM bo")
def neighbors_both(spark, sf_dir):
    return graph.both_ways(edges_of(parsed(spark, sf_dir))[1])


def _seeds(functions: DataFrame) -> DataFrame:
    """A query a module: its first function by name."""
    return functions.groupBy(F.col("path").alias("query_id")).agg(F.min("qname").alias("qname"))


def _walk(depth: int, edges: str) -> str:
    return f"""go AS (
  SELECT path AS query_id, min(qname) AS qname, 0 AS depth FROM fn WHERE stays GROUP BY path
  UNION ALL SELECT DISTINCT query_id, dst, depth + 1 FROM go JOIN {edges} ON src = qname WHERE depth < {depth}
)
SELECT query_id, qname, CAST(min(depth) AS INT) AS depth FROM go GROUP BY query_id, qname"""


@query(f"WITH RECURSIVE {B}, {_walk(2, 'ed')}")
def bfs_callees(spark, sf_dir):
    functions, edges = edges_of(parsed(spark, sf_dir))
    return graph.within_depth(_seeds(functions), edges, 2, ["query_id"])


@query(f"WITH RECURSIVE {B}, {_NEAR}, {_walk(1, 'bo')}")
def slice_depth(spark, sf_dir):
    functions, edges = edges_of(parsed(spark, sf_dir))
    return graph.within_depth(_seeds(functions), graph.both_ways(edges), 1, ["query_id"])


_SEED = "se AS (SELECT path AS query_id, min(qname) AS qname FROM fn WHERE stays GROUP BY path)"


# the list is the queue: node p, its callee c; once it is full each further callee adds its first match at most
@query(f"""WITH RECURSIVE {B}, {_SEED},
gr AS (SELECT src, list(dsts ORDER BY callee) AS gs FROM (SELECT src, string_split(dst, '::')[-1] AS callee, list(dst ORDER BY dst) AS dsts FROM ed GROUP BY 1, 2) GROUP BY src),
go AS (
  SELECT query_id, [qname] AS al, 1::BIGINT AS p, 1::BIGINT AS c, 1::BIGINT AS last, 1 AS level FROM se
  UNION ALL
  SELECT query_id,
    CASE WHEN g IS NULL THEN al WHEN len(al) < 13 THEN list_concat(al, list_filter(g, lambda x: NOT list_contains(al, x))[1:13 - len(al)]) WHEN list_contains(al, g[1]) THEN al ELSE list_append(al, g[1]) END,
    CASE WHEN g IS NULL THEN p + 1 ELSE p END, CASE WHEN g IS NULL THEN 1 ELSE c + 1 END,
    CASE WHEN g IS NULL AND p = last THEN len(al) ELSE last END, CASE WHEN g IS NOT NULL OR p < last THEN level WHEN len(al) >= 13 THEN 9 ELSE level + 1 END
  FROM (SELECT go.*, gs[c] AS g FROM go LEFT JOIN gr ON gr.src = al[p]) WHERE p <= last AND level <= 2
),
en AS (SELECT query_id, arg_max(al, len(al)) AS al FROM go GROUP BY query_id)
SELECT query_id, unnest(al) AS qname, CAST(unnest(range(1, len(al) + 1)) AS INT) AS pos FROM en""")
def expand_capped(spark, sf_dir):
    functions, edges = edges_of(parsed(spark, sf_dir))
    ordered = edges.withColumns({"callee": F.element_at(F.split("dst", "::"), -1), "ord": F.lit(0)})
    return graph.expanded(_seeds(functions).withColumn("pos", F.lit(1)), ordered.select("src", "dst", "ord", "callee"), 2, 12)


@query(f"""WITH RECURSIVE {B}, {_NEAR}, {_SEED},
nb AS (SELECT src, list(dst ORDER BY f.end_lineno - f.lineno DESC, dst) AS near FROM bo JOIN fn f ON f.qname = dst AND f.stays GROUP BY src),
go AS (
  SELECT query_id, [qname] AS al, 1 AS p FROM se
  UNION ALL
  SELECT query_id, list_concat(al, list_filter(coalesce(near, []), lambda x: NOT list_contains(al, x))[1:8 - len(al)]), p + 1 FROM go LEFT JOIN nb ON nb.src = al[p] WHERE p <= len(al)
),
en AS (SELECT query_id, al FROM go WHERE p = len(al) + 1)
SELECT query_id, unnest(al) AS qname, CAST(unnest(range(1, len(al) + 1)) AS INT) AS pos FROM en""")
def walk_fused(spark, sf_dir):
    functions, edges = edges_of(parsed(spark, sf_dir))
    seeds = _seeds(functions).withColumn("pos", F.lit(1))
    scores = seeds.select("query_id").crossJoin(functions.select("qname", (F.col("loc") / 100).alias("final")))
    return graph.fused_walk(seeds, graph.both_ways(edges), scores, 1, 8)
