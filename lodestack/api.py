"""The three entry points of the library, and what they check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import embed, parse
from .operators.tables import cut
from .plans import payload
from .sources import code
from .workers import reach


def caps(hard_cap: int, soft_cap: int) -> tuple[int, int]:
    """Both positive; a soft cap below the hard one is raised to it."""
    if hard_cap <= 0 or soft_cap <= 0:
        raise ValueError("token caps must be positive")
    return hard_cap, max(hard_cap, soft_cap)


def as_queries(spark: SparkSession, query: str | DataFrame | None) -> DataFrame:
    """A text as a table of one query; tables (query_id, query) stay."""
    return query if isinstance(query, DataFrame) else spark.createDataFrame([(0, query or "")], "query_id int, query string")


def select_from_file(spark: SparkSession, path: str, query: str | DataFrame, top_k: int = 6, prefilter: int = 300, depth: int = 1, max_add: int = 12, hard_cap: int = 1200, soft_cap: int = 1800, tokens: str = "bytes4", encode: str | embed.Encoder | None = None, variables: bool = False) -> DataFrame:
    """query_id, payload for one file, or for the files below a folder; encode: an encoder, or the name of one, to rank by meaning as well."""
    hard_cap, soft_cap = caps(hard_cap, soft_cap)
    files = cut(code.scan(reach(spark), path))
    return payload.from_files(cut(parse.parsed(files)), files, as_queries(spark, query), top_k, prefilter, depth, max_add, hard_cap, soft_cap, tokens, embed.encoder(encode), variables)


def build_payload_from_repo(spark: SparkSession, root: str, include_code: bool = False, top_k: int = 50, depth: int = 0, query: str | DataFrame | None = None, query_weight: float = 0.5) -> DataFrame:
    """query_id, payload for a repository."""
    return payload.from_repo(cut(parse.parsed(code.scan(reach(spark), root))), as_queries(spark, query), top_k, depth, query_weight, include_code)


def hybrid_context(spark: SparkSession, root: str, query: str | DataFrame, top_k: int = 8, depth: int = 1, query_weight: float = 0.5, lexical_least: float = 0.0, max_tokens: int | None = None, encode: str | embed.Encoder | None = None) -> DataFrame:
    """query_id, payload for a repository by rank fusion of words and, with an encoder, of meaning, behind a lexical gate."""
    parsed = cut(parse.parsed(code.scan(reach(spark), root)))
    return payload.from_hybrid(parsed, payload.static_scores(parsed), as_queries(spark, query), top_k, depth, query_weight, lexical_least, max_tokens, embed.encoder(encode))


def build_structural_context(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, outline of source texts in a table."""
    rows = files.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    return parse.outlines(parse.parsed(code.from_rows(rows)))
