"""A training-corpus pipeline: quality, near duplicates, repeated passages, mixture, packing.

Every stage takes (spark, docs, sf_dir), `docs` with the columns of `documents`,
and returns what it keeps with the same columns; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from batonflow.llm.jaccard import without_near_duplicates
from batonflow.llm.mixing import replicate
from batonflow.llm.packing import pack
from batonflow.llm.quality import THRESHOLD, score, train
from batonflow.llm.queries import WEIGHTS, table
from batonflow.llm.suffixes import without_repeats
from batonflow.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Null and empty texts get the score of no text; equal texts get equal scores, so
    repeated rows stay or go together; ids may be null. Tables with too few labelled
    texts to learn from keep all rows, an empty table is empty.
    """
    scorer = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, scorer, "_score").where(F.col("_score") >= THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Rows of one id are documents of their own.

    Texts without words are in no group; of such rows of one id one stays. Rows without
    an id stay. Ties between rows of one id go by a hash of their shingles and then of
    the row. An empty table is empty.
    """
    return without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that an earlier one has.

    Earlier is by id, then by a hash of the row, then by place. Every row stays, if need
    be without text; null and empty texts and rows without an id are left as they are.
    """
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global shuffle.

    A null source is one of its own; rows of one id are repeated equally, those without
    an id by their text. Texts don't matter otherwise. An empty table is empty.
    """
    return replicate(docs, WEIGHTS).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences.

    A null or empty text is its end id alone; repeated rows and rows without an id are
    packed each for itself. An empty table has no pieces.
    """
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packing),
]

#: Learning, links and cutting-stock programs aren't expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
