"""Evaluation: confusion counts, gold matching, checks and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from batonflow.operators.similar import top_similar
from batonflow.staging import grown


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per outcome and in all: tp, fp, fn, precision, recall (null without a denominator). Null outcome: the totals."""
    hit = F.col(gold).eqNullSafe(F.col(predicted))
    each = rows.select(F.explode(F.array(F.struct(F.col(gold).alias("outcome"), hit.alias("tp"), F.lit(False).alias("fp"), (~hit).alias("fn")), F.struct(F.col(predicted).alias("outcome"), F.lit(False).alias("tp"), (~hit).alias("fp"), F.lit(False).alias("fn")))).alias("x")).select("x.*").where("outcome IS NOT NULL")
    sums = each.rollup("outcome").agg(*(F.count_if(c).alias(c) for c in ("tp", "fp", "fn")))
    return sums.select("outcome", "tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))


def match_gold(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each gold case with its best prediction: same contract, account (null: any), subject part and slot; the same outcome first."""
    g = gold.alias("g")
    named, open_ = predictions.where("entity IS NOT NULL").alias("p"), predictions.where("entity IS NULL").alias("p")
    same = (F.col("g.contract") == F.col("p.contract")) & F.col("g.slot").eqNullSafe(F.col("p.slot")) & F.lower("p.subject").contains(F.lower("g.subject"))
    pick = ["g.case_id", F.col("g.outcome").alias("gold"), F.col("p.outcome").alias("predicted"), F.col("p.prediction_id")]
    # Those of an account meet by account as well; those of any account are few and meet by contract and slot.
    rows = g.join(named, same & (F.col("g.entity") == F.col("p.entity")), "left").select(pick).union(g.join(open_, same).select(pick))
    best = Window.partitionBy("case_id").orderBy(F.desc(F.coalesce(F.col("gold") == F.col("predicted"), F.lit(False))), F.asc_nulls_last("prediction_id"))
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def eval_rollup(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"))


def top_chunks(down: DataFrame, up: DataFrame, k: int = 4) -> DataFrame:
    """(down_id, rank, up_id, similarity): the k upstream chunks nearest by cosine; ties keep the order of ids.

    Chunks (block, id, vector) meet by `block`, which states what is searched by what.
    """
    return top_similar(down, up, k)


def select_sources(sources: DataFrame, asked: DataFrame) -> DataFrame:
    """(selector_id, source_id): the sources that each selector means.

    `asked`: selector_id, kind and, as its kind has it, ref (call id, message id or
    path), part (a word of the heading or of the text, any case) and channel.
    `sources`: source_id, kind, ref, heading, text, channel. Chat selectors meet
    sources by kind alone, the others by ref.
    """
    s = sources.select(F.col("kind"), "source_id", F.col("ref").alias("_ref"), F.lower("heading").alias("_heading"), F.lower("text").alias("_text"), F.col("channel").alias("_channel"))
    part = F.lower("part")
    by_ref = asked.where("kind <> 'slack'").join(s, [asked["kind"] == s["kind"], F.col("ref") == F.col("_ref")])
    by_ref = by_ref.where((asked["kind"] != "drive") | part.isNull() | F.coalesce("_heading", F.lit("")).contains(part))
    chat = asked.where("kind = 'slack'").join(s, [asked["kind"] == s["kind"], F.col("channel").isNull() | (F.col("channel") == F.col("_channel"))])
    chat = chat.where(part.isNull() | F.coalesce("_text", F.lit("")).contains(part))
    return by_ref.select("selector_id", "source_id").union(chat.select("selector_id", "source_id"))


def select_objects(objects: DataFrame, sources: DataFrame, asked: DataFrame) -> DataFrame:
    """(selector_id, id, entity_id): statements of the one source that a selector means, by its filters; null filters let all through.

    `asked` has type, suffix, contains, stance and quote beside the selector of the
    source. A selector that means no source or several selects nothing.
    """
    one = select_sources(sources, asked).groupBy("selector_id").agg(F.min("source_id").alias("source_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    rows = asked.select("selector_id", F.col("type").alias("_type"), "suffix", "contains", F.col("stance").alias("_stance"), F.lower("quote").alias("_quote")).join(one, "selector_id").join(objects, "source_id")
    free = lambda c, ok: F.col(c).isNull() | ok
    fits = free("_type", F.col("type") == F.col("_type")) & free("suffix", F.col("subject_key").endswith(F.col("suffix"))) & free("contains", F.col("subject_key").contains(F.col("contains")))
    fits &= free("_stance", F.col("stance") == F.col("_stance")) & free("_quote", F.lower(F.coalesce("evidence_quote", F.lit(""))).contains(F.col("_quote")))
    return rows.where(fits).select("selector_id", "id", "entity_id")


def run_checks(checks: DataFrame, selected: DataFrame, relations: DataFrame, fields: DataFrame, gaps: DataFrame) -> DataFrame:
    """(case_id, check_no, kind, passed): every check of every case; `passed` is null where a selector that must mean one statement doesn't.

    `checks`: case_id, check_no, kind, selectors (ids, in order), relation, either
    (null: as the relation has it), created_by, field, value, count, and entity,
    contract, suffix, contains, slot, outcome, inherited for gaps.
    `selected`: of select_objects. `relations`: relation, from_id, to_id, created_by.
    `fields`: id, field, value: the statements' fields and slots as text.
    `gaps`: those of the latest validations: entity, contract, subject_key, slot, outcome, inherited.
    """
    counts = selected.groupBy("selector_id").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("entity_id").alias("entity_id"))
    key = ["case_id", "check_no"]
    each = checks.select(*key, F.posexplode("selectors").alias("at", "selector_id")).join(counts, "selector_id", "left")
    ends = each.groupBy(*key).agg(
        F.bool_and(F.coalesce(F.col("n") == 1, F.lit(False))).alias("single"), F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.countDistinct("entity_id").alias("entities"),
        F.min(F.when(F.col("at") == 0, F.col("id"))).alias("a"), F.min(F.when(F.col("at") == 1, F.col("id"))).alias("b"),
    )
    rows = checks.join(ends, key, "left")
    either = F.when(F.col("kind") == "relation_absent", True).otherwise(F.coalesce("either", F.col("relation").isin("duplicate_of", "contradicts")))
    # A relation is looked for from each of its ends; the turned ones count where either direction does.
    linked = relations.select(F.col("relation").alias("r"), F.col("from_id").alias("x"), F.col("to_id").alias("y"), F.col("created_by").alias("by"), F.lit(False).alias("turned"))
    linked = linked.union(relations.select("relation", "to_id", "from_id", "created_by", F.lit(True)))
    met = rows.where(F.col("kind").startswith("relation")).join(linked, [F.col("relation") == F.col("r"), F.col("a") == F.col("x"), F.col("b") == F.col("y")])
    met = met.where((~F.col("turned") | either) & (F.col("kind").eqNullSafe("relation_absent") | F.col("created_by").isNull() | F.coalesce("by", F.lit("")).contains(F.col("created_by")))).select(key).distinct().withColumn("related", F.lit(True))
    held = rows.where("kind = 'object_field_equals'").join(fields.select(F.col("id").alias("a"), "field", F.col("value").alias("actual")), ["a", "field"]).select(*key, "actual")
    g = gaps.select("entity", "contract", F.col("subject_key").alias("_subject"), F.col("slot").alias("_slot"), F.col("outcome").alias("_outcome"), F.col("inherited").alias("_inherited"))
    hit = checks.where("kind = 'handoff_gap_outcome'").join(g, ["entity", "contract"])
    hit = hit.where(
        F.col("_slot").eqNullSafe(F.col("slot")) & (F.col("_outcome") == F.col("outcome")) & (F.col("inherited").isNull() | (F.col("_inherited") == F.col("inherited")))
        & (F.col("suffix").isNull() | F.col("_subject").endswith(F.col("suffix"))) & (F.col("contains").isNull() | F.col("_subject").contains(F.col("contains")))
    ).select(key).distinct().withColumn("hit", F.lit(True))
    rows = rows.join(met, key, "left").join(held, key, "left").join(hit, key, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = F.col("kind")
    passed = (
        F.when(kind == "object_count", F.coalesce("n", F.lit(0)) == F.col("count"))
        .when(kind == "handoff_gap_outcome", yes(F.col("hit")))
        .when(~yes(F.col("single")), F.lit(None).cast("boolean"))
        .when(kind == "entities_equal", F.col("entities") == 1).when(kind == "entities_distinct", F.col("entities") == 2)
        .when(kind == "relation_exists", yes(F.col("related"))).when(kind == "relation_absent", ~yes(F.col("related")))
        .when(kind == "object_field_equals", F.col("actual").eqNullSafe(F.col("value")))
    )
    return rows.select(*key, "kind", passed.alias("passed"))


def case_results(checks: DataFrame) -> DataFrame:
    """(case_id, passed): a case passes if all its checks do; one that couldn't be made counts as failed."""
    return checks.groupBy("case_id").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"))


def surprises(matched: DataFrame) -> DataFrame:
    """Of match_gold's rows: cases that were taken for contradicted and aren't, and those without a prediction."""
    kind = F.when((F.col("predicted") == "contradicted") & (F.col("gold") != "contradicted"), "contradicted").when(F.col("predicted").isNull(), "unmatched")
    return matched.withColumn("surprise", kind).where("surprise IS NOT NULL")


def slot_fill(objects: DataFrame, slots: DataFrame) -> DataFrame:
    """(type, slot, n, filled): of the statements of a type, how many have the slot set. Slots that a type never sets have no row."""
    from batonflow.functions.scalars import is_set

    totals = objects.groupBy("type").agg(F.count("*").alias("n"))
    # A statement's slots and types are sets of its own, made where the join has them anyway, so no task tells apart the ids of a slot.
    kept = slots.where(is_set(F.col("value"))).select("id", "slot").repartition("id").groupBy("id").agg(F.collect_set("slot").alias("slots"))
    kinds = objects.select("id", "type").groupBy("id").agg(F.collect_set("type").alias("types"))
    filled = kept.join(kinds, "id").select(F.explode("types").alias("type"), "slots").select("type", F.explode("slots").alias("slot"))
    filled = filled.groupBy("type", "slot").agg(F.count("*").alias("filled"))
    return filled.join(totals, "type").select("type", "slot", "n", "filled")


def match_probes(probes: DataFrame, items: DataFrame) -> DataFrame:
    """(probe_id, item_id): the item that answers a probe, null if there is none.

    `probes`: probe_id, fixture, type, capability; `items`: fixture, item_id, type,
    capability. Of the fixture's items of the capability those of the type come first,
    then those with the smaller item_id.
    """
    p = probes.select("probe_id", "fixture", "capability", F.col("type").alias("_type"))
    # The least of a pair, and of a type before: aggregates, so a fixture of any size is summed before it is shuffled.
    rank = F.struct((~F.col("type").eqNullSafe(F.col("_type"))).alias("other"), F.col("item_id").alias("i"))
    least = items.groupBy("fixture", "capability", "type").agg(F.min("item_id").alias("item_id"))
    best = p.join(grown(least), ["fixture", "capability"]).groupBy("probe_id").agg(F.min(rank).alias("m"))
    return p.join(best, "probe_id", "left").select("probe_id", F.col("m.i").alias("item_id"))


def score_probes(matched: DataFrame, expected: DataFrame, slots: DataFrame) -> DataFrame:
    """(probe_id, item_id, hits, total): how many of a probe's expected slots its item has.

    `expected`: probe_id, slot, want, where "<non-null>" is any value; `slots`: id, slot,
    value. A probe without an item hits nothing, one that expects nothing has total 0.
    """
    asked = matched.join(expected, "probe_id", "left").join(grown(slots.select(F.col("id").alias("item_id"), "slot", "value")), ["item_id", "slot"], "left")
    hit = F.col("value").isNotNull() & ((F.col("want") == "<non-null>") | (F.col("value") == F.col("want")))
    return asked.groupBy("probe_id", "item_id").agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"), F.count("slot").alias("total"))


def engine_predictions(gaps: DataFrame, objects: DataFrame, entities: DataFrame) -> DataFrame:
    """(contract, entity, subject, slot, outcome, prediction_id) of the gaps of latest validations.

    `gaps`: gap_id, contract, entity_id, upstream_id, downstream_id, slot, outcome;
    `objects`: id, subject_key; `entities`: entity_id, slug. The subject is the upstream
    statement's, else the downstream one's; a gap with neither, or of an unknown
    account, predicts nothing.
    """
    named = gaps.withColumn("_id", F.coalesce("upstream_id", "downstream_id")).join(objects.select(F.col("id").alias("_id"), F.col("subject_key").alias("subject")), "_id")
    rows = named.where("subject IS NOT NULL").join(entities.select("entity_id", F.col("slug").alias("entity")), "entity_id")
    return rows.select("contract", "entity", "subject", "slot", "outcome", F.col("gap_id").alias("prediction_id"))


def baseline_predictions(findings: DataFrame, entities: DataFrame) -> DataFrame:
    """Findings of a retrieval baseline in the form of engine_predictions().

    `findings`: finding_id, contract, entity, subject, slot, outcome. A slot that says
    none, null, n/a or nothing is no slot; an account that isn't known is any account.
    """
    none = F.lower(F.regexp_replace("slot", r"^\s+|\s+$", "")).isin("none", "null", "n/a", "") | F.col("slot").isNull()
    known = entities.select(F.col("slug").alias("entity")).distinct().withColumn("_known", F.lit(True))
    rows = findings.join(known, "entity", "left")
    return rows.select("contract", F.when(F.col("_known"), F.col("entity")).alias("entity"), "subject", F.when(~none, F.col("slot")).alias("slot"), "outcome", F.col("finding_id").alias("prediction_id"))


def gap_scores(matched: DataFrame) -> DataFrame:
    """Of match_gold's rows: per outcome and in all (null) tp, fp, fn, precision, recall; outcomes with nothing to count have no row."""
    return confusion(matched.select("gold", "predicted"), "gold", "predicted").where("tp + fp + fn > 0")


def wins(engine: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: precision and recall of both in all, and whether the engine wins: more precise, and no less complete.

    Both as gap_scores() has them. Without a precision or recall on either side nobody wins.
    """
    side = lambda df, p: df.where("outcome IS NULL").select(F.col("precision").alias(f"{p}_precision"), F.col("recall").alias(f"{p}_recall"), F.lit(1).alias("_one"))
    both = side(engine, "engine").join(side(baseline, "baseline"), "_one", "full").drop("_one")  # one row each
    won = (F.col("engine_precision") > F.col("baseline_precision")) & (F.col("engine_recall") >= F.col("baseline_recall"))
    return both.withColumn("engine_wins", F.coalesce(won, F.lit(False)))
