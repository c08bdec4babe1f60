"""Extraction through a cache: what was extracted from a text before is looked up, only the rest is asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from batonflow.functions.scalars import cache_key
from batonflow.sources.connectors import content_hash
from batonflow.staging import stage


def cached_extract(sources: DataFrame, cache: DataFrame | None, extract: Callable[[DataFrame], DataFrame], prompt: str, model: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(sources with key, hit and result; fresh entries (key, result) to append to the cache).

    `sources`: text and, where it has one, context_key. A key is of the text's hash, the
    versions of prompt, model and schema, and the context. `cache`: key, result, or
    None; of several entries of a key the least result counts. `extract` is given each
    missing key once, as (key, text, context_key), and returns (key, result); a key
    that it returns nothing for stays missing and is asked for again next time. It
    runs once, as its answers are written before they are joined. `hit` says that the
    key was known before.
    """
    context = F.coalesce("context_key", F.lit("")) if "context_key" in sources.columns else F.lit("")
    rows = sources.withColumn("key", cache_key(content_hash(F.col("text")), prompt, model, schema, context))
    known = sources.sparkSession.createDataFrame([], "key string, result string") if cache is None else cache.groupBy("key").agg(F.min("result").alias("result"))
    # A hot text is one key: keys are made distinct before the cache is joined.
    asked = rows.groupBy("key").agg(F.first("text").alias("text"), F.first(context).alias("context_key")).join(known, "key", "left_anti")
    fresh = stage(extract(asked).select("key", F.col("result").cast("string").alias("result")).where("result IS NOT NULL").dropDuplicates(["key"]), "extracted")
    answers = known.withColumn("hit", F.lit(True)).union(fresh.withColumn("hit", F.lit(False)))
    return rows.join(answers, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), fresh
