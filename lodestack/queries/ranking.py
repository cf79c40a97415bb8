"""Lexical scores, their fusion, gates, budgets and vector similarity: benchmark passages against documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, cover, rank, select, similar
from ..operators.tables import cut
from .texts import IDENT, documents_table, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Documents kept for each query; those that a lexical prefilter leaves to a rerank; those of a list to be packed.
K, PREFILTER, PACKED = 10, 300, 100


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _r(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def passages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), T.identifiers("text").alias("tokens"))


def documents(spark, sf_dir) -> DataFrame:
    return documents_table(spark, sf_dir).select("doc_id", T.identifiers("text").alias("tokens"))


_P = f"""
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({IDENT}) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id, len({IDENT}) AS n, {IDENT} AS t FROM documents),
p AS (SELECT doc_id, greatest(any_value(n), 1) AS dl, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) GROUP BY doc_id, term),
"""
BM = f"""{_P}
c AS (SELECT count(*) AS nd, avg(greatest(n, 1)) AS av FROM d),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, doc_id, sum(times * ln((nd - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS raw FROM p JOIN f USING (term) JOIN q USING (term), c GROUP BY query_id, doc_id),
b AS (SELECT query_id, doc_id, {_r('CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE 0 END')} AS score FROM s)"""
OKAPI = f"""{_P}
c AS (SELECT count(*) AS nd, avg(n) AS av FROM d),
f AS (SELECT term, ln(nd - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, c GROUP BY term, nd),
m AS (SELECT avg(idf) AS mean FROM f),
b AS (SELECT query_id, doc_id, {_r('sum(times * CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av)))')} AS score FROM p JOIN f USING (term) JOIN q USING (term), c, m GROUP BY query_id, doc_id)"""
TOP = "SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM b) WHERE rank <= {0}"


@query(f"WITH {BM} {TOP.format(K)}")
def bm25_norm_topk(spark, sf_dir):
    return bm25.top_k(bm25.bm25(passages(spark, sf_dir), documents(spark, sf_dir), top=K), K)


@query(f"WITH {OKAPI} {TOP.format(K)}")
def bm25_okapi_topk(spark, sf_dir):
    return bm25.top_k(bm25.okapi(passages(spark, sf_dir), documents(spark, sf_dir), top=K), K)


def _hits(spark, sf_dir, k: int) -> DataFrame:
    """query_id, key, score, rank (from 0): a lexical prefilter, as the operators have it that go by one."""
    return bm25.top_k(bm25.bm25(passages(spark, sf_dir), documents(spark, sf_dir), top=k), k).select("query_id", F.col("doc_id").alias("key"), "score", (F.col("rank") - 1).alias("rank"))


def _sized(spark, sf_dir) -> DataFrame:
    """key, text, base, cost: the structural channel here is the number of characters over its maximum."""
    docs = documents_table(spark, sf_dir)
    top = F.broadcast(docs.agg(F.max("n_chars").alias("m")))
    return docs.select(F.col("doc_id").alias("key"), "text", F.col("n_chars").alias("cost")).crossJoin(top).select("key", "text", (F.col("cost") / F.col("m")).alias("base"), "cost")


def _pairs(spark, sf_dir, docs: DataFrame, keep: list[str]) -> DataFrame:
    """query_id, key, keep, score: every passage with every document; the score is 0 without a common term."""
    found = bm25.bm25(passages(spark, sf_dir), docs.withColumn("tokens", T.identifiers("text")), doc_key="key", keep=keep, every=True)
    return found.withColumn("score", T.rounded(F.col("score")))


def _ranked(spark, sf_dir) -> DataFrame:
    """query_id, key, base, structural, score, rank: every pair with its rank in either channel; the structural one is the same for every query."""
    docs = _sized(spark, sf_dir)
    st = rank.ranked_whole(docs.select("key", T.rounded(F.col("base"), 9).alias("by")), [], score="by").select("key", F.col("rank").alias("structural"))
    return rank.ranked_whole(_pairs(spark, sf_dir, docs.join(st, "key"), ["base", "structural"]), ["query_id"])


#: Every pair with its scores and its ranks (from 0) in both channels.
HITS = f"""{BM},
z AS (SELECT doc_id AS key, n_chars AS cost, n_chars / (SELECT max(n_chars) FROM documents) AS base FROM documents),
zs AS (SELECT *, row_number() OVER (ORDER BY floor(base * 1e9 + 0.5) / 1e9 DESC NULLS LAST, key) - 1 AS structural FROM z),
ap AS (SELECT q1.item_id AS query_id, zs.key, base, structural, cost, coalesce(b.score, 0) AS score FROM benchmark q1 CROSS JOIN zs LEFT JOIN b ON b.query_id = q1.item_id AND b.doc_id = zs.key),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) - 1 AS rank FROM ap),
rf AS (SELECT query_id, key, 1.0 / (61 + rank) + 1.0 / (61 + structural) AS score FROM h)"""


@query(f"WITH {HITS} SELECT query_id, key, {_r('score', 9)} AS score FROM rf")
def rrf_two_channel(spark, sf_dir):
    fused = rank.fused_ranks(F.col("rank"), F.col("structural"))
    return _ranked(spark, sf_dir).select("query_id", "key", T.rounded(fused, 9).alias("score"))


@query(f"""WITH {HITS},
o AS (SELECT query_id, key, rank AS o FROM h WHERE rank < 5 UNION ALL SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY {_r('score', 12)} DESC, key) + 5 FROM rf),
g AS (SELECT query_id, key, min(o) AS o FROM o GROUP BY query_id, key)
SELECT * FROM (SELECT query_id, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) AS INT) AS pos FROM g) WHERE pos <= {K}""")
def choose_roots(spark, sf_dir):
    docs = _sized(spark, sf_dir)
    st = cut(rank.ranked_whole(docs.select("key", T.rounded(F.col("base"), 9).alias("by")), [], score="by").select("key", F.col("rank").alias("structural")))
    # no pair beyond these ranks in both channels is chosen: the two lists' heads, and where each stands in the other
    depth = rank.chosen_depth(K) + 1
    hits = bm25.top_k(bm25.bm25(passages(spark, sf_dir), documents(spark, sf_dir), every=True, top=depth), depth).select("query_id", F.col("doc_id").alias("key"), (F.col("rank") - 1).cast("bigint").alias("rank"))
    heads = st.filter(F.col("structural") < depth)
    found = bm25.ranks_of(passages(spark, sf_dir), docs.withColumn("tokens", T.identifiers("text")), heads, doc_key="key").select("query_id", "key", "rank")
    return rank.chosen_roots_of(hits.union(found).distinct().join(st, "key"), ["query_id"], K)


@query(f"""WITH {HITS}, w AS (SELECT query_id, key, 1.0 / (61 + rank) AS f, max(score) OVER (PARTITION BY query_id) AS top FROM h)
SELECT query_id, key, {_r('f / max(f) OVER (PARTITION BY query_id)', 9)} AS fused, top AS top_lexical, top >= 0.05 AS retrieve FROM w""")
def hybrid_scores(spark, sf_dir):
    ranked = rank.ranked_whole(_pairs(spark, sf_dir, _sized(spark, sf_dir), []), ["query_id"])
    found = rank.hybrid_scores_of(ranked, ["query_id"]).join(F.broadcast(passages(spark, sf_dir).select("query_id", "query")), "query_id")
    return found.select("query_id", "key", T.rounded(F.col("fused"), 9).alias("fused"), "top_lexical", rank.should_retrieve(F.col("query"), F.col("top_lexical"), F.lit(None).cast("double")).alias("retrieve"))


@query("SELECT item_id AS query_id, coalesce(text, '') <> '' AND item_id % 3 > 0 AS retrieve FROM benchmark")
def should_retrieve(spark, sf_dir):
    # lexical tops of 0, 0.05 and 0.1 in turn, no dense channel
    one = table(spark, sf_dir, "benchmark").withColumn("top", (F.col("item_id") % 3) * 0.05)
    return one.select(F.col("item_id").alias("query_id"), rank.should_retrieve(F.col("text"), F.col("top"), F.lit(None).cast("double")).alias("retrieve"))


_BLEND = f"{HITS}, bl AS (SELECT query_id, key, cost, {_r('0.5 * base + 0.5 * score')} AS score FROM h)"


@query(f"WITH {_BLEND} SELECT * FROM (SELECT query_id, key, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INT) AS rank FROM bl) WHERE rank <= {K}")
def blend_topk(spark, sf_dir):
    both = _pairs(spark, sf_dir, _sized(spark, sf_dir), ["base"]).withColumn("score", rank.blended(F.col("base"), F.col("score"), 0.5))
    return bm25.top_k(both.select("query_id", "key", "score"), K, doc_key="key")


def _texts(spark, sf_dir) -> DataFrame:
    return documents_table(spark, sf_dir).select(F.col("doc_id").alias("key"), "text")


_COVERED = f"""pw AS (SELECT item_id AS query_id, list_distinct({IDENT}) AS w, {IDENT} AS wn FROM benchmark), lo AS (SELECT doc_id AS key, lower(coalesce(text, '')) AS low FROM documents),
pr AS (SELECT query_id, key, w, wn, low FROM pw CROSS JOIN lo)"""
_COVER = "len(list_filter({0}, lambda t: contains(low, t))) / len({0})"


@query(f"WITH {_COVERED} SELECT query_id, key, {_r(_COVER.format('w'), 9)} AS coverage FROM pr WHERE len(w) > 0")
def lexical_score(spark, sf_dir):
    return cover.coverage(_texts(spark, sf_dir), passages(spark, sf_dir)).withColumn("coverage", T.rounded(F.col("coverage"), 9))


@query(f"WITH {_COVERED} SELECT query_id, key, {_r(_COVER.format('wn'), 9)} AS coverage FROM pr WHERE len(wn) > 0")
def lexical_coverage(spark, sf_dir):
    return cover.coverage(_texts(spark, sf_dir), passages(spark, sf_dir), distinct=False).withColumn("coverage", T.rounded(F.col("coverage"), 9))


@query(f"WITH {_COVERED} SELECT query_id, key FROM pr WHERE len(w) = 0 OR {_COVER.format('w')} >= 0.6")
def lexical_gate(spark, sf_dir):
    return cover.coverage(_texts(spark, sf_dir), passages(spark, sf_dir), least=0.6).select("query_id", "key")


@query(f"""WITH {HITS}, {_COVERED},
ca AS (SELECT h.query_id, h.key, {_r('0.5 * base + 0.5 / (61 + rank)', 9)} AS final, rank AS lex_rank, len(w) = 0 OR {_COVER.format('w')} >= 0.6 AS passes FROM h JOIN pr USING (query_id, key)),
lp AS (SELECT *, CASE WHEN passes THEN row_number() OVER (PARTITION BY query_id ORDER BY passes DESC, lex_rank, key) END AS pos0, bool_or(passes) OVER (PARTITION BY query_id) AS any_pass FROM ca),
fi AS (SELECT *, coalesce(pos0 <= 4, FALSE) AS first FROM lp WHERE passes OR NOT any_pass)
SELECT * FROM (SELECT query_id, key, final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first DESC, CASE WHEN first THEN pos0 END, final DESC, key) AS INT) AS pos FROM fi) WHERE pos <= 6""")
def seeds_gated(spark, sf_dir):
    final = T.rounded(rank.blended(F.col("base"), F.lit(1.0) / (F.col("rank") + 61), 0.5), 9)
    ranked = rank.ranked_whole(_pairs(spark, sf_dir, _sized(spark, sf_dir), ["base"]), ["query_id"])
    c = ranked.select("query_id", "key", final.alias("final"), F.col("rank").alias("lex_rank"))
    c = cut(c.join(lexical_gate(spark, sf_dir).withColumn("gate", F.lit(True)), ["query_id", "key"], "left").withColumn("passes", F.coalesce("gate", F.lit(False))).drop("gate"))
    return rank.gated_seeds(c, ["query_id"], 6, 0.6)


@query(f"""WITH RECURSIVE {_BLEND},
it AS (SELECT query_id, key, score, greatest(1, cost) AS cost FROM bl),
od AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score / cost DESC, score DESC, cost, key) AS i FROM it),
go AS (
  SELECT query_id, 0::BIGINT AS i, 20000::BIGINT AS room, NULL::BIGINT AS key, FALSE AS took, 0::BIGINT AS pos FROM (SELECT DISTINCT query_id FROM od)
  UNION ALL
  SELECT go.query_id, od.i, CASE WHEN od.cost <= room THEN room - od.cost ELSE room END, od.key, od.cost <= room, pos + CASE WHEN od.cost <= room THEN 1 ELSE 0 END FROM go JOIN od ON od.query_id = go.query_id AND od.i = go.i + 1
)
SELECT query_id, key, CAST(pos AS INT) AS pos FROM go WHERE took""")
def knapsack_budget(spark, sf_dir):
    both = _pairs(spark, sf_dir, _sized(spark, sf_dir), ["base", "cost"]).withColumn("benefit", T.rounded(rank.blended(F.col("base"), F.col("score"), 0.5)))
    return select.knapsack(both.select("query_id", "key", "benefit", "cost"), ["query_id"], 20000)


@query(f"""WITH {BM}, h AS (SELECT query_id, doc_id AS key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM b QUALIFY rank < {PACKED}),
w AS (SELECT query_id, key, rank, CAST(sum(length(d.text)) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM h JOIN documents d ON d.doc_id = h.key)
SELECT query_id, key, used FROM w WHERE used <= 7200""")
def prefix_pack(spark, sf_dir):
    # what is packed is a top-k list
    size = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.length("text").alias("size"))
    return select.prefix(_hits(spark, sf_dir, PACKED).join(size, "key"), ["query_id"], 7200, ["rank"]).select("query_id", "key", "used")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def _asked(spark, sf_dir) -> DataFrame:
    """The query vectors: those whose id is divisible by 50."""
    return vectors(spark, sf_dir).filter("vec_id % 50 = 0")


_VEC = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
si AS (SELECT a.vec_id AS query_id, e.vec_id, list_dot_product(a.v, e.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-12) * (sqrt(list_dot_product(e.v, e.v)) + 1e-12)) AS sim FROM e a, e WHERE a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id)
"""


@query(f"WITH {_VEC}, b AS (SELECT query_id, vec_id AS doc_id, {_r('sim')} AS score FROM si) {TOP.format(K)}")
def cosine_topk(spark, sf_dir):
    return similar.cosine_top(vectors(spark, sf_dir), K, _asked(spark, sf_dir))


@query(f"WITH {_VEC}, b AS (SELECT query_id, vec_id, (sim - min(sim) OVER (PARTITION BY query_id)) / (max(sim) OVER (PARTITION BY query_id) - min(sim) OVER (PARTITION BY query_id)) AS s FROM si) SELECT query_id, vec_id, {_r('s')} AS similarity FROM b")
def dense_minmax(spark, sf_dir):
    return similar.cosine_min_max(vectors(spark, sf_dir), _asked(spark, sf_dir)).withColumn("similarity", T.rounded(F.col("similarity")))


@query(f"WITH {_VEC}, n AS (SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS u FROM e) SELECT vec_id, {_r('list_sum(u)')} AS total, {_r('sqrt(list_dot_product(u, u))')} AS length FROM n")
def l2_norm(spark, sf_dir):
    one = vectors(spark, sf_dir).select("vec_id", T.unit(F.col("v")).alias("u"))
    return one.select("vec_id", T.rounded(F.aggregate("u", F.lit(0.0), lambda s, x: s + x)).alias("total"), T.rounded(T.norm(F.col("u"))).alias("length"))


def _lexical_with_vectors(spark, sf_dir) -> DataFrame:
    """The prefilter's hits of every query with the similarity of the vectors that have the passage's and the document's number; 0 where one has none."""
    v = vectors(spark, sf_dir)
    both = _hits(spark, sf_dir, PREFILTER).join(v.select(F.col("vec_id").alias("key"), F.col("v").alias("dv")), "key", "left").join(v.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id", "left")
    return both.withColumn("similarity", F.coalesce(T.cosine(F.col("qv"), F.col("dv")), F.lit(0.0))).drop("qv", "dv")


_LV = f"""{BM}, h AS (SELECT query_id, doc_id AS key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM b QUALIFY rank < {PREFILTER}), {_VEC},
lv AS (SELECT h.query_id, h.key, h.score, coalesce(list_dot_product(a.v, c.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-12) * (sqrt(list_dot_product(c.v, c.v)) + 1e-12)), 0) AS sim FROM h LEFT JOIN e a ON a.vec_id = h.key LEFT JOIN e c ON c.vec_id = h.query_id)"""


@query(f"WITH {_LV}, rr AS (SELECT query_id, key AS doc_id, {_r('0.5 * score + 0.5 * sim')} AS score FROM lv) {TOP.format(K).replace('FROM b)', 'FROM rr)')}")
def rerank_half(spark, sf_dir):
    one = _lexical_with_vectors(spark, sf_dir)
    return bm25.top_k(one.select("query_id", F.col("key").alias("doc_id"), rank.reranked_half(one).alias("score")), K)


_SCALE = "CASE WHEN max({0}) OVER (PARTITION BY query_id) > 0 THEN {0} / (max({0}) OVER (PARTITION BY query_id) + 1e-9) ELSE {0} END"


@query(f"WITH {_LV}, rr AS (SELECT query_id, key AS doc_id, {_r('0.5 * ' + _SCALE.format('score') + ' + 0.5 * ' + _SCALE.format('sim'))} AS score FROM lv) {TOP.format(K).replace('FROM b)', 'FROM rr)')}")
def rerank_maxnorm(spark, sf_dir):
    return bm25.top_k(_lexical_with_vectors(spark, sf_dir).withColumn("s", rank.reranked_scaled(["query_id"])).select("query_id", F.col("key").alias("doc_id"), F.col("s").alias("score")), K)
