"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from batonflow.staging import clear, stage, staged


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node can reach over undirected edges.

    Alternates large-star and small-star steps, so the rounds needed grow with the
    logarithm of the longest path. Every round is one aggregation with map-side
    minimum and one join, and its edges are written to the shared folder. Loops and
    edges with a null end are ignored; a node in no edge has no row.
    """
    mark_staged = staged()
    e = stage(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v"), F.col("u")))
        # Large star: larger neighbours of u hang on the least of u and its neighbours.
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours hang on the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = (
            hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        e = stage(small, "edges")
        clear(edges.sparkSession, mark_staged, keep=1)  # the round before is read no more
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    heads = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = heads.select(F.col("component").alias("node"), "component").distinct()
    return heads.union(roots)
