"""One order of arrival over all connectors, and the load that follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from batonflow.sources import connectors
from batonflow.staging import stage

#: What is loaded before what: calls before mails, so that of two on one fact the better source is seen first.
CONNECTORS = ["drive", "call", "email", "slack"]
COUNTS = ["created", "skipped", "rejected", "jobs"]


def numbered(rows: DataFrame, by: list[str], name: str = "arrival_seq") -> DataFrame:
    """`rows` numbered from 1 without gaps in the order of `by`, nulls first, and of all other columns where those are equal.

    Rows are cut into ranges of the order, sorted and written once; a range's place is
    its rows' numbers plus the counts of the ranges before it. Only those counts, one a
    range, meet in one task. Equal rows are numbered in any order.
    """
    rest = [c for c, kind in rows.dtypes if c not in by and "map<" not in kind and "variant" not in kind]
    keys = [F.asc_nulls_first(c) for c in [*by, *rest]]
    cut = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    cut = stage(cut.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    counts = cut.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", (before - F.col("_first") + 1).alias("_plus"))
    # One row a shuffle partition.
    return cut.join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("_at") + F.col("_plus")).alias(name))


def load(sources: DataFrame, rejected: DataFrame | None = None, known: DataFrame | None = None, within: tuple[str, ...] = ("external_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of a load over all connectors.

    `sources`: tenant_id, kind and the columns of connectors.COLUMNS; `rejected`: kind
    and external_id of calls without consent; `known`: what was ingested before. Rows
    come by connector, in the order of CONNECTORS (others after these, by name), and
    within one in the order of `within`; arrival_seq numbers them without gaps, and
    was_new says whether the key (tenant, kind, id, content) is met first. counts: a
    row for each kind with created, skipped, rejected and jobs, zeros included.
    """
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CONNECTORS)), F.col("kind")), F.lit(0)), F.lit(len(CONNECTORS) + 1))
    rows = sources.withColumns({"content_hash": connectors.content_hash(F.col("text")), "_place": place})
    rows = numbered(rows, ["_place", "kind", *within]).drop("_place")
    rows = stage(connectors.ingest(rows, known), "loaded")
    seen = rows.groupBy("kind").agg(F.count_if("was_new").alias("created"), F.count_if(~F.col("was_new")).alias("skipped"), F.lit(0).cast("long").alias("rejected"), F.count_if("was_new").alias("jobs"))
    zero = F.lit(0).cast("long")
    if rejected is not None:
        seen = seen.union(rejected.groupBy("kind").agg(zero, zero, F.count("*"), zero))
    all_ = seen.union(sources.sparkSession.createDataFrame([(k,) for k in CONNECTORS], "kind string").select("kind", zero, zero, zero, zero))
    return rows, all_.groupBy("kind").agg(*(F.sum(c).alias(c) for c in COUNTS))
