"""From raw documents to packed training sequences.

Each stage works on all that the one before it kept, written as Parquet to the folder that the
cluster's machines share. All stages but the last return the columns of documents, and others that
came along, also such as have names that a stage uses inside. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import linededup, mixing, ngramjoin, packing, toxicity
from lodestack.llm.common import written
from lodestack.workers import reach


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, takes for toxic go.

    Null, empty and other texts without words stay, as do rows without an id that aren't toxic; repeated rows stay or go together.
    """
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, flag = "__toxic_score", "__toxic"
    return toxicity.scored(docs, model, score=score, flag=flag).filter(~F.col(flag)).drop(score, flag)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go, and with them documents that have nothing else; n_chars follows the text.

    Blank lines, and null, empty and blank texts, stay as they are. Rows without an id come first; those alike in id
    and text lose the same lines, so that all of them stay or go.
    """
    found = linededup.deduplicated(docs, n_lines=None, n_lost="__lost")
    left = found.filter((F.col("__lost") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.when(F.col("__lost") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays.

    Rows without an id and texts without words stay. Of rows alike in all columns that share an id one stays; rows
    that share an id with other texts are one document.
    """
    return ngramjoin.deduplicated(docs)


def in_target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the target weights of sources and languages ask for.

    Null and other texts without tokens have no copies; a null source or language is a group like others; rows
    alike in id and text have as many copies each.
    """
    return mixing.mixed_copies(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, and each copy of one, lies in the training sequences.

    Each row is packed on its own, repeated ones and those without an id too; one without tokens has a row without a bin.
    """
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", in_target_mixture),
    ("best-fit packing", into_sequences),
]

#: A trained classifier, a join by set similarity and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    reach(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
