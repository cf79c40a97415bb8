"""Tokens, terms, statistics of terms, lines and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as T
from ..operators import chunk, features
from ..operators.tables import spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, where every one of them is worked through."""
    return spread(table(spark, sf_dir, "documents"))


IDENT = "regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z_][A-Za-z0-9_]*')"
ALNUM = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda t: lower(t))"
#: Distinct values in the order of their first places.
FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
SYNONYM_ROWS = ", ".join(f"('{k}', '{v}')" for k, vs in T.SYNONYMS.items() for v in vs)
STEM = "lower(CASE " + " ".join(f"WHEN t LIKE '%{e}' AND length(t) > {len(e) + 2} THEN substr(t, 1, length(t) - {len(e)})" for e in T.ENDINGS) + " ELSE t END)"


@query(f"SELECT doc_id, CAST(len({IDENT}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({IDENT})) AS BIGINT) AS n_distinct FROM documents")
def tok_counts(spark, sf_dir):
    t = T.identifiers("text")
    return documents_table(spark, sf_dir).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


@query(f"WITH t AS (SELECT doc_id, unnest({IDENT}) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY token")
def tok_vocab_df(spark, sf_dir):
    one = documents_table(spark, sf_dir).select("doc_id", F.explode(T.identifiers("text")).alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return one.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


_NORM = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_.]+'), lambda t: lower(t))"
_NORM = f"flatten(list_transform({_NORM}, lambda t: list_concat([t], CASE WHEN contains(t, '.') THEN list_filter(string_split(t, '.'), lambda p: p <> '') ELSE [] END, CASE WHEN contains(t, '_') THEN list_filter(string_split(t, '_'), lambda p: p <> '') ELSE [] END)))"


@query(f"WITH a AS (SELECT item_id, {_NORM} AS a FROM benchmark) SELECT item_id, {FIRST.format('a')} AS tokens FROM a")
def normalize_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalized("text").alias("tokens"))


@query(f"SELECT conv_id, turn, role, {ALNUM} AS tokens FROM conversations")
def tokenize_alnum(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.alnum_tokens("text").alias("tokens"))


@query("SELECT conv_id, turn, role, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda t: t <> '') AS tokens FROM conversations")
def tokenize_field(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.field_tokens("text").alias("tokens"))


_TERMS = f"list_sort(list_distinct(list_concat({IDENT}, flatten(list_transform({IDENT}, lambda t: regexp_extract_all(t, '[a-z]+'))))))"


@query(f"SELECT item_id, {_TERMS} AS terms FROM benchmark")
def split_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.terms("text").alias("terms"))


def expanded_sql(key: str, of: str) -> str:
    """tt, sy, ex: the terms of `of` (key, text), the synonyms, and (key, t) of the terms that expansion gives."""
    return f"""tt AS (SELECT {key}, unnest({_TERMS}) AS t FROM {of}), sy(k, v) AS (VALUES {SYNONYM_ROWS}),
ex AS (
  SELECT {key}, t FROM tt
  UNION SELECT {key}, v FROM tt JOIN sy ON tt.t = sy.k
  UNION SELECT {key}, substr(t, 1, length(t) - 1) FROM tt WHERE t LIKE '%s'
  UNION SELECT {key}, substr(t, 1, length(t) - 3) FROM tt WHERE t LIKE '%ing'
  UNION SELECT {key}, substr(t, 1, length(t) - 2) FROM tt WHERE t LIKE '%ed'
)"""


@query(f"""WITH {expanded_sql("item_id", "benchmark")}
SELECT b.item_id, coalesce(list_sort(list(ex.t) FILTER (WHERE ex.t IS NOT NULL)), []) AS terms FROM benchmark b LEFT JOIN ex USING (item_id) GROUP BY b.item_id
""")
def expand_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.expanded("text").alias("terms"))


_PIECES = "flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*'), lambda t: list_concat([t], list_transform(regexp_extract_all(replace(regexp_replace(t, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), ' ', ' '), '[A-Z]?[a-z]+|[A-Z]+'), lambda p: lower(p)), list_filter(string_split(t, '_'), lambda p: p <> ''))))"
# capitals followed by a lower-case letter give up their last one: `[A-Z]+(?![a-z])` without look-around, see tests
_STEMS = f"list_transform({_PIECES}, lambda t: {STEM})"


@query(f"WITH a AS (SELECT item_id, {_STEMS} AS a FROM benchmark) SELECT item_id, {FIRST.format('a')} AS keywords FROM a")
def stem_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.keywords("text").alias("keywords"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in features.STOP_WORDS)
INFORMATIVE = f"length(token) >= 2 AND lower(token) NOT IN ({_STOP}) AND NOT (starts_with(token, '__') AND ends_with(token, '__')) AND replace(token, '_', '') <> ''"


@query(f"WITH t AS (SELECT unnest({IDENT}) AS token FROM documents) SELECT token, count(*) AS n FROM t WHERE {INFORMATIVE} GROUP BY token")
def informative_filter(spark, sf_dir):
    one = documents_table(spark, sf_dir).select(F.explode(T.identifiers("text")).alias("token"))
    return one.groupBy("token").agg(F.count("*").alias("n")).filter(features.informative(F.col("token")))


_IDF = f"""t AS (SELECT doc_id, unnest({IDENT}) AS token FROM documents), i AS (
  SELECT token, count(DISTINCT doc_id) AS df, ln(((SELECT count(*) FROM documents) + 1.0) / (count(DISTINCT doc_id) + 1)) + 1 AS idf FROM t GROUP BY token
)"""


def _idf(spark, sf_dir):
    rows = documents_table(spark, sf_dir).select("doc_id", F.explode(T.identifiers("text")).alias("token"))
    return rows, features.identifier_idf(rows, table(spark, sf_dir, "documents").count(), "doc_id")


@query(f"WITH {_IDF} SELECT token, df, floor(idf * 1000000 + 0.5) / 1000000 AS idf FROM i")
def token_idf(spark, sf_dir):
    return _idf(spark, sf_dir)[1].withColumn("idf", T.rounded(F.col("idf")))


@query(f"WITH {_IDF} SELECT doc_id, floor(avg(idf) * 1000000 + 0.5) / 1000000 AS tfidf FROM t JOIN i USING (token) GROUP BY doc_id")
def doc_tfidf(spark, sf_dir):
    return features.mean_idf(*_idf(spark, sf_dir), "doc_id").withColumn("tfidf", T.rounded(F.col("tfidf")))


_STARTS = "list_concat([0], list_transform(range(1, len(string_split(coalesce(text, ''), chr(10)))), lambda i: strlen(array_to_string(list_slice(string_split(coalesce(text, ''), chr(10)), 1, i), chr(10))) + 1))"


@query(f"SELECT doc_id, CAST({_STARTS} AS INT[]) AS starts FROM documents")
def line_starts(spark, sf_dir):
    return documents_table(spark, sf_dir).select("doc_id", spans.line_starts("text").alias("starts"))


@query(f"""
WITH s AS (SELECT doc_id, {_STARTS} AS starts, strlen(coalesce(text, '')) AS n FROM documents), p AS (SELECT *, unnest([0, n // 3, n // 2, n]) AS pos FROM s)
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(len(list_filter(starts, lambda s: s <= pos)) AS INT) AS line, CAST(len(list_filter(starts, lambda s: s <= pos)) + CASE WHEN pos >= n THEN 1 ELSE 0 END AS INT) AS line_with_end FROM p
""")
def byte_to_line(spark, sf_dir):
    n = F.octet_length(F.coalesce("text", F.lit("")))
    one = table(spark, sf_dir, "documents").select("doc_id", spans.line_starts("text").alias("starts"), n.alias("n"))
    one = one.withColumn("pos", F.explode(F.array(F.lit(0), F.floor(F.col("n") / 3).cast("int"), F.floor(F.col("n") / 2).cast("int"), F.col("n"))))
    return one.select("doc_id", "pos", spans.line_of(F.col("starts"), F.col("pos")).alias("line"), spans.line_of_with_end(F.col("starts"), F.col("pos"), F.col("n")).alias("line_with_end"))


def _ends(sep: str) -> str:
    parts = f"string_split(coalesce(text, ''), {sep})"
    return f"list_transform(range(1, len({parts})), lambda i: strlen(array_to_string(list_slice({parts}, 1, i), {sep})) + length({sep}))"


@query(f"""
WITH d AS (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS text, 1 AS kind FROM documents UNION ALL SELECT doc_id, text, 0 FROM documents),
e AS (SELECT doc_id, kind, {_ends("chr(10) || chr(10)")} AS blank, {_ends("chr(10)")} AS line, strlen(coalesce(text, '')) AS n FROM d),
f AS (SELECT doc_id, kind, n, CASE WHEN len(blank) > 0 THEN blank ELSE line END AS b FROM e)
SELECT doc_id, kind, CAST(CASE WHEN len(b) > 0 AND b[-1] = n THEN b ELSE list_append(b, n) END AS INT[]) AS bounds FROM f
""")
def cast_boundaries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the documents have no blank lines: once as they are, once with one after each sentence that ends a line
    both = docs.select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"), F.lit(1).alias("kind")).union(docs.select("doc_id", "text", F.lit(0)))
    return both.select("doc_id", "kind", spans.boundaries("text").alias("bounds"))


def _document_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    src = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(F.col("doc_id").cast("string").alias("path"), src.alias("src"), F.array(F.struct(F.lit(0).alias("start"), F.length(src).alias("end"))).alias("spans"))


def _pieces(df):
    return df.select(F.col("path").cast("bigint").alias("doc_id"), F.posexplode("pieces").alias("k", "p")).select("doc_id", "k", "p.start", "p.end")


#: Pieces of each document, by a fold over the places where it may be cut; tokens are a quarter of the bytes.
_SPLIT = f"""e0 AS (SELECT doc_id, {_ends("chr(10) || chr(10)")} AS blank, {_ends("chr(10)")} AS line, strlen(coalesce(text, '')) AS n FROM documents),
e1 AS (SELECT doc_id, n, CASE WHEN len(blank) > 0 THEN blank ELSE line END AS b FROM e0),
d AS (SELECT doc_id, n, CASE WHEN len(b) > 0 AND b[-1] = n THEN b ELSE list_append(b, n) END AS bounds FROM e1),
go AS (
  SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS beg, 0::BIGINT AS tok, 0::BIGINT AS safe, NULL::BIGINT AS s, NULL::BIGINT AS e FROM d WHERE (n + 3) // 4 > 1200
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN c THEN safe ELSE beg END, CASE WHEN c THEN (f - safe + 3) // 4 ELSE tok + t END, f, CASE WHEN c THEN beg END, CASE WHEN c THEN safe END
  FROM (SELECT go.*, d.bounds[i + 1] AS f, (d.bounds[i + 1] - beg + 3) // 4 AS t, i > 0 AND tok + (d.bounds[i + 1] - beg + 3) // 4 > 1200 AS c FROM go JOIN d USING (doc_id) WHERE i < len(d.bounds))
),
pc AS (
  SELECT doc_id, s, e FROM go WHERE s IS NOT NULL
  UNION ALL SELECT doc_id, beg, n FROM go JOIN d USING (doc_id) WHERE i = len(bounds)
  UNION ALL SELECT doc_id, 0, n FROM d WHERE (n + 3) // 4 <= 1200
),
pk AS (SELECT doc_id, s, e, (e - s + 3) // 4 AS t, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS k FROM pc)"""


@query(f"WITH RECURSIVE {_SPLIT} SELECT doc_id, CAST(k AS INT) AS k, CAST(s AS INT) AS start, CAST(e AS INT) AS \"end\" FROM pk")
def cast_split(spark, sf_dir):
    return _pieces(chunk.chunked(_document_spans(spark, sf_dir), merge=False))


@query(f"""WITH RECURSIVE {_SPLIT}, mg AS (
  SELECT doc_id, k, s, e, t, 0::BIGINT AS g FROM pk WHERE k = 0
  UNION ALL
  SELECT p.doc_id, p.k, CASE WHEN mg.t + p.t <= 1800 THEN mg.s ELSE p.s END, p.e, CASE WHEN mg.t + p.t <= 1800 THEN mg.t + p.t ELSE p.t END, CASE WHEN mg.t + p.t <= 1800 THEN g ELSE g + 1 END FROM mg JOIN pk p ON p.doc_id = mg.doc_id AND p.k = mg.k + 1
)
SELECT doc_id, CAST(g AS INT) AS k, CAST(min(s) AS INT) AS start, CAST(max(e) AS INT) AS "end" FROM mg GROUP BY doc_id, g""")
def cast_merge(spark, sf_dir):
    return _pieces(chunk.chunked(_document_spans(spark, sf_dir)))


@query("SELECT doc_id, rtrim(text, chr(10)) AS code FROM documents WHERE text IS NOT NULL")
def stitch_whole(spark, sf_dir):
    one = _document_spans(spark, sf_dir)
    return one.select(F.col("path").cast("bigint").alias("doc_id"), chunk.stitched(F.col("src"), F.col("spans")).alias("code"))


@query("""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, rtrim(CASE WHEN len(l) > 1 THEN l[1] || chr(10) || chr(10) || array_to_string(l[2:], chr(10)) ELSE l[1] END, chr(10)) AS code FROM p
""")
def stitch_first_line(spark, sf_dir):
    one = _document_spans(spark, sf_dir).withColumn("first", F.get(spans.line_starts(F.decode("src", "UTF-8")), F.lit(1)))
    cut = F.when(F.col("first").isNull(), F.col("spans")).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.col("first").alias("end")), F.struct(F.col("first").alias("start"), F.length("src").alias("end"))))
    return one.select(F.col("path").cast("bigint").alias("doc_id"), chunk.stitched(F.col("src"), cut).alias("code"))
