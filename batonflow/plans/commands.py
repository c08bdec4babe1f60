"""Human commands, replayed as events over the current state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from batonflow import fixed
from batonflow.staging import stage


def review(objects: DataFrame, reviews: DataFrame) -> DataFrame:
    """Objects (id, status, version, attributes map) after their reviews in order of `seq`.

    confirm -> active, ignore -> ignored, mark_stale -> stale, edit merges the
    given slots; each raises the version by one. A review of no object does nothing.
    """
    by = Window.partitionBy("id").orderBy(F.desc("seq"))
    status = F.when(F.col("action") == "confirm", "active").when(F.col("action") == "ignore", "ignored").when(F.col("action") == "mark_stale", "stale")
    last = reviews.withColumn("new_status", status).where("new_status IS NOT NULL").withColumn("n", F.row_number().over(by)).where("n = 1").select("id", "new_status")
    slots = reviews.where("action = 'edit'").select("id", "seq", F.explode("changes").alias("slot", "value"))
    edits = slots.groupBy("id", "slot").agg(F.max_by("value", "seq").alias("value")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("edits"))
    steps = reviews.groupBy("id").agg(F.count("*").alias("steps"))
    rows = objects.join(last, "id", "left").join(edits, "id", "left").join(steps, "id", "left")
    kept = F.map_filter("attributes", lambda k, _: ~F.coalesce(F.map_contains_key(F.col("edits"), k), F.lit(False)))
    merged = F.when(F.col("edits").isNull(), F.col("attributes")).otherwise(F.map_concat(kept, "edits"))
    return rows.select(
        *[c for c in objects.columns if c not in ("status", "version", "attributes")], F.coalesce("new_status", "status").alias("status"),
        (F.col("version") + F.coalesce("steps", F.lit(0))).cast("int").alias("version"), merged.alias("attributes"),
    )


def resolve_conflicts(objects: DataFrame, relations: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, relations) after choices (from_id, to_id, winner; null: both are superseded).

    Only pending contradictions and duplicates can be chosen on. The winner becomes
    active and supersedes the other.
    """
    open_ = relations.where("resolved_at IS NULL AND relation IN ('contradicts', 'duplicate_of')").join(choices, ["from_id", "to_id"])
    ends = open_.select(F.explode(F.array("from_id", "to_id")).alias("id"), "winner")
    fate = ends.groupBy("id").agg(F.max(F.when(F.col("id") == F.col("winner"), "active").otherwise("superseded")).alias("fate"))
    moved = objects.join(fate, "id", "left").withColumn("_step", (F.col("fate").isNotNull() & (F.col("fate") != F.col("status"))).cast("int"))
    after = moved.withColumn("status", F.coalesce("fate", "status")).withColumn("version", (F.col("version") + F.col("_step")).cast("int")).drop("fate", "_step")
    edge = open_.where("winner IS NOT NULL").select(F.col("winner").alias("from_id"), F.when(F.col("winner") == F.col("from_id"), F.col("to_id")).otherwise(F.col("from_id")).alias("to_id"), F.lit("supersedes").alias("relation"), F.current_timestamp().alias("resolved_at"))
    done = relations.join(open_.select("from_id", "to_id", F.lit(True).alias("_now")), ["from_id", "to_id"], "left").withColumn("resolved_at", F.when(F.col("_now") & F.col("resolved_at").isNull(), F.current_timestamp()).otherwise(F.col("resolved_at"))).drop("_now")
    return after, done.select("from_id", "to_id", "relation", "resolved_at").union(edge)


def review_gaps(gaps: DataFrame, reviews: DataFrame) -> DataFrame:
    """confirm resolves a gap, anything else ignores it; the last review counts."""
    last = reviews.groupBy("gap_id").agg(F.max_by("action", "seq").alias("action"))
    status = F.when(F.col("action").isNull(), F.col("status")).when(F.col("action") == "confirm", "resolved").otherwise("ignored")
    return gaps.join(last, "gap_id", "left").withColumn("status", status).drop("action")


def reconcile_contradictions(pairs: DataFrame, near: float = fixed.NEAR_TEXT, same: float = fixed.SAME_TEXT) -> DataFrame:
    """(from_id, to_id, action): pending system contradictions whose two statements are compatible after all.

    `pairs`: from_id, to_id, created_by, resolved_at, compatible, cosine. They become
    "duplicate" from `same` on, "review" from `near` on, else "independent"; all are
    resolved. sweep() applies this.
    """
    open_ = pairs.where("resolved_at IS NULL AND compatible").where(F.col("created_by").startswith("system:lifecycle:"))
    action = F.when(F.col("cosine") >= same, "duplicate").when(F.col("cosine") >= near, "review").otherwise("independent")
    return open_.select("from_id", "to_id", action.alias("action"))


def sweep(objects: DataFrame, relations: DataFrame, now: datetime, hold: bool = True, near: float = fixed.NEAR_TEXT, same: float = fixed.SAME_TEXT) -> dict[str, DataFrame]:
    """objects, versions and relations after all contradictions that are none are resolved at once.

    `objects`: id, status, version, authority and others; `relations`: from_id, to_id,
    relation, created_by, resolved_at, and for contradictions compatible and cosine of
    the two. A pending contradiction by the lifecycle rules between compatible
    statements is resolved at `now`; from `same` on the one with less authority (equal:
    the second) is a duplicate of the other, which it supports, from `near` on a
    duplicate is left for a review. A statement in conflict is active again and one
    version further, with `hold` only if no other pending contradiction is left of it,
    else whichever are. `versions`: id, version, status of those. Edges that are there
    already are not added again.
    """
    pending = (F.col("relation") == "contradicts") & F.col("resolved_at").isNull()
    false = pending & F.coalesce(F.col("compatible"), F.lit(False)) & F.coalesce(F.col("created_by").startswith("system:lifecycle:"), F.lit(False))
    # Pairs with an end that isn't there are left alone.
    rank = objects.select("id", "authority")
    ends = relations.where(false).join(rank.select(F.col("id").alias("from_id"), F.col("authority").alias("_a")), "from_id").join(rank.select(F.col("id").alias("to_id"), F.col("authority").alias("_b")), "to_id")
    found = stage(ends.select("from_id", "to_id", "cosine", F.col("_a") >= F.col("_b"), F.lit(True).alias("_done")).toDF("from_id", "to_id", "cosine", "from_wins", "_done").distinct(), "false-contradictions")

    open_ends = lambda df: df.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    left = relations.where(pending).join(found.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    freed = open_ends(found).distinct()
    freed = freed.join(open_ends(left).distinct(), "id", "left_anti") if hold else freed
    moved = objects.join(freed.withColumn("_free", F.lit(True)), "id", "left").withColumn("_moves", F.coalesce(F.col("_free") & (F.col("status") == "conflicting"), F.lit(False)))
    moved = stage(moved.drop("_free"), "swept")
    after = moved.withColumns({"status": F.when(F.col("_moves"), "active").otherwise(F.col("status")), "version": F.col("version") + F.col("_moves").cast("int")})

    edge = lambda a, z, kind, resolved: F.struct(a.alias("from_id"), z.alias("to_id"), F.lit(kind).alias("relation"), F.lit(resolved).alias("_resolved"))
    a, z = F.col("from_id"), F.col("to_id")
    copy, canon = F.when(F.col("from_wins"), z).otherwise(a), F.when(F.col("from_wins"), a).otherwise(z)
    new = F.when(F.col("cosine") >= same, F.array(edge(copy, canon, "duplicate_of", True), edge(canon, copy, "supported_by", True))).when(F.col("cosine") >= near, F.array(edge(a, z, "duplicate_of", False)))
    made = found.select(F.explode(new).alias("e"), "cosine").select("e.*", F.round("cosine", 2).alias("confidence"))
    made = made.join(relations.select("from_id", "to_id", "relation"), ["from_id", "to_id", "relation"], "left_anti").dropDuplicates(["from_id", "to_id", "relation"])
    done = F.coalesce(F.col("_done") & pending & false, F.lit(False))
    old = relations.join(found.select("from_id", "to_id", "_done"), ["from_id", "to_id"], "left")
    at = F.lit(now).cast("timestamp")
    old = old.select("from_id", "to_id", "relation", "created_by", F.when(done, at).otherwise(F.col("resolved_at")).alias("resolved_at"))
    new_rows = made.select("from_id", "to_id", "relation", F.lit("system:dedup").alias("created_by"), F.when(F.col("_resolved"), at).alias("resolved_at"))
    return {"objects": after.drop("_moves"), "versions": after.where("_moves").select("id", "version", "status"), "relations": old.union(new_rows)}
