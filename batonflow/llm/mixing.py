"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A document of source s is repeated k times, k Poisson with the mean that brings s
to its weight. k inverts the distribution at a uniform number hashed from the
document's id, so every run and every partitioning repeats the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A mean is cut into parts of at most this size; each part has a hash of its own.
PART = 16.0
#: Terms of the inverted distribution: beyond these, a part of mean 16 has less than 1e-30.
TERMS = 96
#: Sources are broadcast up to this number; beyond it the join is shuffled.
MAX_BROADCAST_SOURCES = 10_000


# Names of columns that exist in between; a caller's columns may have any other.
_SOURCE, _PARTS, _SUMS, _COPIES = "batonflow__source", "batonflow__parts", "batonflow__sums", "batonflow__copies"


def uniform(*parts: Column) -> Column:
    """In [0, 1): the first 13 hexadecimal digits of an MD5."""
    return F.conv(F.left(F.md5(F.concat_ws(":", *parts)), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def _steps(mean: Column) -> Column:
    """Poisson cumulative sums for 0 .. TERMS - 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def more(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        return F.struct(p.alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, more, lambda a: a["sums"])


def target_rates(docs: DataFrame, weights: dict[str, float], default: float, total: float | None, source: str = "source") -> DataFrame:
    """(_source, _parts, _sums): from counts of all documents; a null source is a source of its own.

    Weights are relative; `total` (default: as many as there are) documents are
    aimed at. A source of weight 0 gets rate 0.
    """
    counts = docs.groupBy(F.col(source).alias(_SOURCE)).agg(F.count("*").alias("n"))
    weight = F.lit(float(default))
    for name, w in weights.items():
        weight = F.when(F.col(_SOURCE) == name, float(w)).otherwise(weight)
    counts = counts.withColumn("w", weight)
    all_w, all_n, sources = counts.agg(F.sum("w"), F.sum("n"), F.count("*")).first()
    aim = float(total if total is not None else all_n or 0)
    rates = (
        counts.withColumn("rate", F.lit(aim) * F.col("w") / (float(all_w or 1.0) or 1.0) / F.col("n"))
        .withColumn(_PARTS, F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
        .withColumn(_SUMS, _steps(F.col("rate") / F.col(_PARTS)))
        .select(_SOURCE, _PARTS, _SUMS)
    )
    return F.broadcast(rates) if sources <= MAX_BROADCAST_SOURCES else rates


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, total: float | None = None, seed: int = 17, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` repeated to the target weights, with copy (from 0) and shuffle_key, globally shuffled.

    Rows with one id are repeated equally. Rows with a null id are told apart by an
    MD5 of their text (null or no such column: empty), so they aren't all repeated alike. Empty and very
    long texts are rows like any other. An empty table gives an empty result. Columns
    named copy and shuffle_key are replaced. The order is by shuffle_key: ranges of
    that hash, which are of equal size by its nature, sorted within.
    """
    rates = target_rates(docs, weights or {}, default, total, source)
    said = F.coalesce(F.col(text).cast("string"), F.lit("")) if text in docs.columns else F.lit("")
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null "), F.md5(said)))
    # A number a part, each hashed once; then the terms below it are counted.
    drawn = F.transform(F.sequence(F.lit(1), F.col(_PARTS)), lambda j: uniform(F.lit(seed).cast("string"), name, j.cast("string")))
    copies = F.aggregate(drawn, F.lit(0), lambda a, u: a + F.size(F.filter(_SUMS, lambda c: c <= u)))
    marked = docs.join(rates, F.col(source).eqNullSafe(F.col(_SOURCE))).withColumn(_COPIES, copies).where(f"{_COPIES} > 0")
    out = marked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(_COPIES) - 1))).withColumn(
        "shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed} order"), name, F.col("copy").cast("string")))
    )
    # The key's first 32 bits are uniform: they name the range, and no sample of the rows has to be made first.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.expr(f"cast(conv(left(shuffle_key, 8), 16, 10) AS long) * {n}L div 4294967296L").cast("int")
    return out.drop(_SOURCE, _PARTS, _SUMS, _COPIES).repartitionById(n, at).sortWithinPartitions("shuffle_key")
