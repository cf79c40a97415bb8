"""The registered queries of the ten operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import spread
from . import ann, chat, fingerprint, langid, linededup, mixing, ngramjoin, packing, toxicity, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, over all cores also where their file has fewer splits."""
    return spread(_table(spark, sf_dir, "documents"))


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.wavelet_shards(_documents(spark, sf_dir))


def op2_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir))


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.sketches(_documents(spark, sf_dir))


def op4_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fitted(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select("doc_id", "text"), model).select("doc_id", "toxic_score", "toxic")


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(_documents(spark, sf_dir).select("doc_id", "text"))


def op8_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_texts(_table(spark, sf_dir, "conversations"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return langid.identified(docs.select("doc_id", "text"), langid.fitted(docs)).select("doc_id", "lang_found", "bits_per_byte", "margin_bits")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.classes(_documents(spark, sf_dir))


SQL_OP3 = f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - {fingerprint.SHINGLE - 1}, 1) END AS n FROM w
), h AS (
  SELECT doc_id, n, list_filter(list_transform(range(n), lambda i: md5(array_to_string(list_slice(w, i + 1, i + {fingerprint.SHINGLE}), ' '))), lambda x: x < '{fingerprint.threshold(fingerprint.FRACTION)}') AS h FROM g
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, list_sort(list_transform(list_distinct(h), lambda x: CAST('0x' || x[1:{fingerprint.DIGITS}] AS BIGINT))) AS sketch FROM h
"""


SQL_OP7 = """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), x AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM l
), k AS (
  SELECT doc_id, pos, line, trim(line, ' ') = '' OR row_number() OVER (PARTITION BY trim(line, ' ') ORDER BY doc_id, pos) = 1 AS stays FROM x
), t AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_lost, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays) AS text FROM k GROUP BY doc_id
)
SELECT l.doc_id, CASE WHEN l.text IS NOT NULL THEN coalesce(t.text, '') END AS text, CAST(coalesce(t.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(t.n_lost, 0) AS BIGINT) AS n_lost
FROM l LEFT JOIN t USING (doc_id)
"""

SQL_OP8 = r"""
WITH e AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS content,
    regexp_matches(coalesce(text, ''), '<\\*\|im_(start|end)\|>') OR regexp_matches(coalesce(role, ''), '<\\*\|im_(start|end)\|>|[\n]|\\[n|\\]') AS odd
  FROM conversations
), r AS (
  SELECT conv_id, turn, role, content, odd,
    CASE WHEN odd THEN replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '|', '\|') ELSE role END AS role_out,
    CASE WHEN odd THEN regexp_replace(content, '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g') ELSE content END AS content_out
  FROM e
)
SELECT conv_id, CAST(0 AS INT) AS part, string_agg('<|im_start|>' || role_out || chr(10) || content_out || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, content) AS text,
  CAST(count(*) AS INT) AS n_turns, CAST(count(*) FILTER (WHERE odd) AS INT) AS n_escaped, CAST(CASE WHEN bool_or(odd) THEN 2 ELSE 1 END AS INT) AS rounds
FROM r GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_wavelet_shards, op2_bestfit_packing, op3_scaled_sketch, op4_kmeans_tree_neighbours, op5_toxicity, op6_source_mixture, op7_line_dedup, op8_chat_round_trip, op9_language_id, op10_ngram_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return {"op3_scaled_sketch": SQL_OP3, "op7_line_dedup": SQL_OP7, "op8_chat_round_trip": SQL_OP8}
