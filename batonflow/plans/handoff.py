"""Hand-off validation: every contract, every account, in one set-based plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from batonflow import fixed
from batonflow.functions.scalars import band, capability_of, either, is_set, nested, normalize, severity, shown
from batonflow.operators.lineage import edges, nearest_values
from batonflow.staging import grown, stage

KEY = ["tenant_id", "entity_id", "subject_key"]
FIELDS = "contract string, from_stage string, to_stage string, field string, check string, types array<string>, slots array<string>, importance string, least int, rule string"
GAP = ["tenant_id", "entity_id", "contract", "field", "subject_key", "upstream_id", "downstream_id", "slot", "outcome", "importance", "rank", "inherited", "conflict"]
#: What a gap's sentence is made of beside that: both values, a note, the superseded statement that is still cited, the rule that failed.
TOLD = ["u_val", "d_val", "note", "stale_id", "rule"]


def contract_fields(spark: SparkSession, contracts=fixed.CONTRACTS) -> DataFrame:
    """One row a field; contracts are configuration, so this is a small table."""
    rows = [(c, a, z, name, check, types, slots, weight, least, rule) for c, a, z, fields in contracts for name, check, types, slots, weight, least, rule in fields]
    return spark.createDataFrame(rows, FIELDS)


def alike(slot: Column, u: Column, d: Column) -> Column:
    """Objects are compared by one key, where their slot has one."""
    return either((slot == s) & nested(u, k).eqNullSafe(nested(d, k)) for s, k in fixed.NESTED_KEY.items())


def classify(slot: Column, subject: Column, nu: Column, nd: Column, d: Column, same_key: Column, u_precision: Column, d_precision: Column, stale: Column) -> Column:
    """The outcome of a slot whose upstream value is set, or null where it survives. The first rule that fits counts.

    `nu` and `nd` are the normal forms of both values and `same_key` is alike() of them:
    columns of a written table, as the branches would make them anew each.
    """
    capability = capability_of(subject)
    child = either((capability == c) & nu.isin(*kids) for c, kids in fixed.CAPABILITY_CHILDREN.items())
    same = either((slot == s) & nu.isin(*g) & nd.isin(*g) for s, groups in fixed.SYNONYMS.items() for g in groups)
    wider = either((nd == r) & nu.isin(*kids) for r, kids in fixed.REGION_MEMBERS.items())
    order = lambda p: F.when(p == "month", 1).when(p == "quarter", 2).otherwise(0)
    unset = F.when((slot == "protocol") & child, "generalized").when((slot == "due_date") & is_set(d_precision), "generalized").otherwise("missing")
    return (
        F.when(~is_set(d), unset)
        .when((nu == nd) | same, F.lit(None).cast("string"))
        .when(stale, "stale_reference")
        .when(slot == "protocol", F.when(nd == capability, "generalized").otherwise("contradicted"))
        .when(slot == "region", F.when(wider, "generalized").otherwise("contradicted"))
        .when(slot == "due_date", F.when(order(d_precision) > order(u_precision), "generalized").otherwise("contradicted"))
        .when(slot.isin(*fixed.NESTED_KEY), F.when(same_key, F.lit(None).cast("string")).otherwise("contradicted"))
        .otherwise("contradicted")
    )


def note_of(outcome: Column, slot: Column, subject: Column, d: Column, u_precision: Column, d_precision: Column) -> Column:
    """Why an outcome holds, where the rule says more than the values do."""
    day = lambda p: F.coalesce(F.nullif(p, F.lit("")), F.lit("day"))
    dropped = F.concat(F.lit("precision dropped from `"), day(u_precision), F.lit("` to `"), day(d_precision), F.lit("`"))
    key = F.create_map(*[F.lit(x) for kv in fixed.NESTED_KEY.items() for x in kv])[slot]
    return (
        F.when((outcome == "generalized") & ~is_set(d) & (slot == "protocol"), F.concat(F.lit("downstream targets the broader capability `"), capability_of(subject), F.lit("`")))
        .when((outcome == "generalized") & ~is_set(d) & (slot == "due_date"), F.concat(F.lit("downstream only states `"), d_precision, F.lit("` precision")))
        .when((outcome == "generalized") & (slot == "due_date"), dropped)
        .when((outcome == "contradicted") & key.isNotNull(), F.concat(F.lit("`"), key, F.lit("` differs")))
    )


def slot_names(fields: DataFrame) -> list[str]:
    """The slots that validation reads: what the fields ask for, and the due date's precision."""
    return sorted({s for r in fields.select("slots").collect() for s in r["slots"] or [] if s is not None} | {"due_date_precision"})  # contracts are configuration


def packed(objects: DataFrame, slots: DataFrame | None, names: list[str]) -> DataFrame:
    """`objects` with `values`, a struct of the slots `names`, written: slots are shuffled once, and what asks for a slot reads that column of its statement's row.

    Of a slot that is given twice the greater value counts. Without `slots`, `objects`
    is a stored table that has `values` already, and nothing is shuffled or written.
    """
    if slots is None:
        return objects
    rows = slots.where(F.col("slot").isin(names)).where("id IS NOT NULL").select("id", F.struct("slot", "value").alias("one"))
    # Only the lists are sorted: the last of a slot, by value, is its greatest, and null is the least.
    lists = rows.groupBy("id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    last = F.filter("all", lambda x, i: ~x["slot"].eqNullSafe(F.get(F.col("all"), i + 1)["slot"]))
    maps = lists.select("id", F.map_from_entries(last).alias("values"))
    return stage(objects.join(grown(maps), "id", "left").withColumn("values", F.struct(*[F.element_at("values", F.lit(n)).alias(n) for n in names])), "packed")


def _value(rows: DataFrame, slot: Column) -> Column:
    """The value of `slot` in packed() rows."""
    names = rows.schema["values"].dataType.names
    return F.coalesce(F.lit(None).cast("string"), *[F.when(slot == n, F.col("values")[n]) for n in names])


def _all_values(rows: DataFrame, names: list[str]) -> Column:
    """A generator of (slot, value) of packed() rows, for those of `names` that they have."""
    found = [n for n in names if n in rows.schema["values"].dataType.names]
    one = [F.struct(F.lit(n).alias("slot"), F.col("values")[n].alias("value")) for n in found]
    return F.inline(F.array(*one).cast("array<struct<slot: string, value: string>>"))


def _precision(rows: DataFrame) -> Column:
    return F.col("values")["due_date_precision"] if "due_date_precision" in rows.schema["values"].dataType.names else F.lit(None).cast("string")


def _asked_values(rows: DataFrame, side: str) -> DataFrame:
    """Of packed() rows that have met a field: only the values that it asks for, in the order of its slots, and the due date's precision."""
    if "values" not in rows.columns:
        return rows
    vals = F.transform("slots", lambda s: _value(rows, s))
    return rows.withColumns({f"{side}_vals": vals, f"{side}_prec": _precision(rows)}).drop("values")


def reference_picks(objects: DataFrame, fields: DataFrame) -> DataFrame:
    """The upstream statement that stands for each subject of a propagating field, and whether any is in conflict.

    Fields are configuration and go to the statements: dealt by stage, all statements would lie in as many tasks as there are stages.
    """
    up = objects.where(F.col("status").isin("active", "conflicting")).withColumnRenamed("stage", "from_stage")
    rows = up.join(F.broadcast(fields.where("check = 'propagate'")), "from_stage").where(F.array_contains("types", F.col("type")) & (F.col("authority") >= F.col("least")))
    by = ["contract", "field", *KEY]
    rows = _asked_values(rows, "own")
    best = Window.partitionBy(*by).orderBy(F.desc("authority"), F.desc("valid_from"), "id")
    rows = rows.withColumn("n", F.row_number().over(best)).withColumn("conflict", F.bool_or(F.col("status") == "conflicting").over(Window.partitionBy(*by)))
    return rows.where("n = 1").drop("n")


def counterpart_picks(objects: DataFrame, fields: DataFrame) -> DataFrame:
    """The downstream statement that answers for a subject of a field."""
    down = objects.where("status = 'active'").withColumnRenamed("stage", "to_stage")
    rows = down.join(F.broadcast(fields.where("check = 'propagate'").select("contract", "field", "to_stage", "types", "slots")), "to_stage").where(F.array_contains("types", F.col("type")))
    rows = _asked_values(rows, "d")
    told = [c for c in ("d_vals", "d_prec") if c in rows.columns]
    best = Window.partitionBy("contract", "field", *KEY).orderBy(F.desc("authority"), F.desc("valid_from"), "id")
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").select("contract", "field", *KEY, F.col("id").alias("d_id"), *told)


def propagate_gaps(known: DataFrame, relations: DataFrame, fields: DataFrame, names: list[str]) -> DataFrame:
    """Gaps of propagating fields; `known` is packed() with the slots `names`."""
    pairs = reference_picks(known, fields).join(grown(counterpart_picks(known, fields)), ["contract", "field", *KEY], "left")
    pick = [*KEY, "contract", "field", "importance", "conflict", "id", "d_id", "authority", "stage", "type", "slots", "own_vals", "own_prec", "d_vals", "d_prec"]
    pairs = stage(pairs.withColumnRenamed("from_stage", "stage").select(pick), "pairs")
    lost = pairs.where("d_id IS NULL").select(
        *KEY, "contract", "field", F.col("id").alias("upstream_id"), F.lit(None).cast("long").alias("downstream_id"), F.lit(None).cast("string").alias("slot"),
        F.lit("object_missing").alias("outcome"), "importance", F.col("authority").alias("rank"), F.lit(False).alias("inherited"), "conflict",
        *_untold(),
    )
    # Own value first, else the nearest upstream one: only what has none of its own is looked for, once for all contracts.
    asked = pairs.where("d_id IS NOT NULL").withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.size("slots"), F.lit(1))))).where("i <= size(slots)")
    at = lambda c: F.element_at(c, F.col("i"))
    asked = asked.withColumns({"slot": at("slots"), "own": at("own_vals"), "d_val": at("d_vals")}).drop("slots", "own_vals", "d_vals", "i")
    have, walk = asked.where(is_set(F.col("own"))), asked.where(~F.coalesce(is_set(F.col("own")), F.lit(False)))
    facts = have.withColumns({"walked": F.lit(False), "u_val": F.col("own"), "eff": F.col("id"), "rank": F.col("authority"), "eff_stage": F.col("stage"), "eff_type": F.col("type"), "u_prec": F.col("own_prec")})
    near = nearest_values(relations, known.select("id", "values"), walk.select(F.col("id").alias("root"), "slot"))
    heads = known.select(F.col("id").alias("owner"), F.col("authority").alias("rank"), F.col("stage").alias("eff_stage"), F.col("type").alias("eff_type"), _precision(known).alias("u_prec"))
    near = near.join(grown(heads), "owner").select(F.col("root").alias("id"), "slot", F.col("value").alias("u_val"), F.col("owner").alias("eff"), "rank", "eff_stage", "eff_type", "u_prec")
    facts = facts.select(_FACT).union(walk.join(grown(near), ["id", "slot"]).withColumn("walked", F.lit(True)).select(_FACT)).withColumn("nd", normalize(F.col("d_val")))
    old = known.where("status = 'superseded'").select("*", _all_values(known, names)).where(is_set(F.col("value")))
    old = old.select(*KEY, F.col("stage").alias("eff_stage"), F.col("type").alias("eff_type"), "slot", normalize(F.col("value")).alias("nd"), "id")
    old = old.groupBy(*KEY, "eff_stage", "eff_type", "slot", "nd").agg(F.min("id").alias("stale_id"))
    # The statement itself may be superseded; its own value is equal, which is settled before.
    facts = facts.join(grown(old), [*KEY, "eff_stage", "eff_type", "slot", "nd"], "left")
    facts = stage(facts.withColumns({"nu": normalize(F.col("u_val")), "same_key": alike(F.col("slot"), F.col("u_val"), F.col("d_val"))}), "facts")
    outcome = classify(*map(F.col, ("slot", "subject_key", "nu", "nd", "d_val", "same_key", "u_prec", "d_prec")), F.col("stale_id").isNotNull())
    note = note_of(F.col("outcome"), F.col("slot"), F.col("subject_key"), F.col("d_val"), F.col("u_prec"), F.col("d_prec"))
    kept = facts.withColumn("outcome", outcome).where("outcome IS NOT NULL").withColumn("note", note).select(
        *KEY, "contract", "field", F.col("eff").alias("upstream_id"), F.col("d_id").alias("downstream_id"), "slot", "outcome", "importance", "rank", F.col("walked").alias("inherited"), "conflict",
        "u_val", "d_val", "note", F.when(F.col("outcome") == "stale_reference", F.col("stale_id")).alias("stale_id"), F.lit(None).cast("string").alias("rule"),
    )
    return lost.select(GAP + TOLD).union(kept.select(GAP + TOLD))


_FACT = [*KEY, "contract", "field", "importance", "conflict", "d_id", "slot", "d_val", "d_prec", "walked", "u_val", "eff", "rank", "eff_stage", "eff_type", "u_prec"]


def _untold() -> list[Column]:
    return [F.lit(None).cast("long" if c == "stale_id" else "string").alias(c) for c in TOLD]


def present_gaps(known: DataFrame, relations: DataFrame, fields: DataFrame) -> DataFrame:
    """What must be there downstream and isn't: a link, a customer contact or a slot; `known` is packed()."""
    rows = known.where("status = 'active'").withColumnRenamed("stage", "to_stage").join(F.broadcast(fields.where("check = 'present'")), "to_stage").where(F.array_contains("types", F.col("type")))
    linked = relations.select(F.col("from_id").alias("id")).distinct()
    contact = known.where("type = 'dependency' AND role = 'customer'").select("tenant_id", "entity_id", F.col("stage").alias("to_stage")).distinct()
    no_link = rows.where("rule = 'has_derived_from'").join(grown(linked), "id", "left_anti").withColumn("slot", F.lit(None).cast("string"))
    no_contact = rows.where("rule = 'has_customer_contact'").join(grown(contact), ["tenant_id", "entity_id", "to_stage"], "left_anti").withColumn("slot", F.lit(None).cast("string"))
    no_slot = rows.where("rule IS NULL").withColumn("slot", F.explode("slots")).where(~F.coalesce(is_set(_value(known, F.col("slot"))), F.lit(False)))
    pick = [*KEY, "contract", "field", F.lit(None).cast("long").alias("upstream_id"), F.col("id").alias("downstream_id"), "slot", F.lit("missing").alias("outcome"), "importance", F.col("authority").alias("rank"), F.lit(False).alias("inherited"), F.lit(False).alias("conflict"), *_untold()[:-1], "rule"]
    found = no_link.select(pick).union(no_contact.select(pick)).union(no_slot.select(pick))
    return found.select(GAP + TOLD)


def validate(objects: DataFrame, slots: DataFrame | None, fields: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """All gaps of all contracts, scored, with what their sentences need. `as_of` is not a filter: validation sees the current state.

    `slots`: id, slot, value; None if `objects` has them as packed() does.
    """
    relations = edges(objects) if relations is None else relations
    names = slot_names(fields)
    known = packed(objects, slots, names)
    gaps = propagate_gaps(known, relations, fields, names).union(present_gaps(known, relations, fields))
    value = severity(F.col("importance"), F.col("rank"), F.col("outcome"))
    return gaps.withColumn("severity", value).withColumn("band", band(F.col("severity")))


def join_known(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """`rows` with what `side` has of `key`, a left join that deals rows without a key out to all tasks, not to one."""
    spread = F.when(F.col(key).isNull(), F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")])).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("_spread", spread).join(grown(side.withColumn("_spread", F.lit(0).cast("long"))), [key, "_spread"], "left").drop("_spread")


def explain(gaps: DataFrame, objects: DataFrame) -> DataFrame:
    """`gaps` of validate() with a sentence for each: what was lost, from whom, what stands there instead, which contract wants it.

    `objects` needs type, content, role, authority, stage and valid_from.
    """
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in fixed.SLOT_KIND.items() for x in kv])[F.col("slot")], F.lit("context"))
    label = (
        F.when(F.col("outcome") == "contradicted", "Contradiction").when(F.col("outcome") == "stale_reference", "Stale context in use")
        .when(F.col("outcome") == "object_missing", "Requirement dropped entirely").when(F.col("upstream_id").isNull(), "Missing evidence link")
        .when((F.col("outcome") == "generalized") & (kind == "deadline"), "Deadline generalized")
        .otherwise(F.concat(F.initcap(kind), F.when(F.col("outcome") == "generalized", " loss (generalized)").otherwise(" loss (dropped)")))
    )
    day = F.to_date("valid_from").cast("string").alias("day")
    side = lambda p: objects.select(F.col("id").alias(f"{p}stream_id"), F.struct("type", "content", "role", F.col("authority").cast("string").alias("rank"), "stage", day).alias(p))
    told = join_known(join_known(gaps, side("up"), "upstream_id"), side("down"), "downstream_id")
    told = join_known(told, objects.select(F.col("id").alias("stale_id"), F.col("content").alias("_old")), "stale_id")
    verb = F.when(F.col("outcome") == "generalized", "generalizes this to").when(F.col("outcome") == "missing", "drops this — it is absent in").when(F.col("outcome") == "contradicted", "contradicts this with").otherwise("still cites a superseded value:")
    note = F.coalesce(F.col("note"), F.concat(F.lit('matches superseded value "'), F.col("_old"), F.lit('"')))
    contract = F.format_string("Contract `%s.%s` (%s) requires this", "contract", "field", "importance")
    head = F.concat(F.lit("**"), label, F.lit("** — "))
    up = F.format_string('upstream %s "%s" (%s, authority %s, %s %s)', "up.type", "up.content", "up.role", "up.rank", "up.stage", "up.day")
    down = F.format_string('"%s" (%s %s)', "down.content", "down.stage", "down.day")
    reason = F.when(F.col("rule") == "has_derived_from", "has no `derived_from` link back to upstream evidence").when(F.col("rule") == "has_customer_contact", "has no captured customer contact").otherwise(F.format_string("is missing `%s`", "slot"))
    lost = F.concat(head, up, F.format_string(" has no counterpart in `%s` downstream. ", "field"), contract, F.lit(" to propagate."))
    absent = F.concat(head, F.lit("downstream "), F.col("down.type"), F.lit(" "), down, F.lit(" "), reason, F.lit(". "), contract, F.lit("."))
    changed = F.concat(
        head, up, F.lit(" specifies `"), F.col("slot"), F.lit(" = "), shown(F.col("u_val")), F.lit("`. downstream "), down, F.lit(" "), verb,
        F.coalesce(F.concat(F.lit(" `"), shown(F.col("d_val")), F.lit("`")), F.lit("")), F.coalesce(F.concat(F.lit(" ("), note, F.lit(")")), F.lit("")), F.lit(". "), contract, F.lit(" slot to survive."),
    )
    text = F.when(F.col("outcome") == "object_missing", lost).when(F.col("upstream_id").isNull(), absent).otherwise(changed)
    return told.withColumn("explanation", text).drop("up", "down", "_old")


def summary(gaps: DataFrame, by=("tenant_id", "entity_id", "contract")) -> DataFrame:
    """Totals of a validation: gaps, by outcome and band, inherited and original."""
    count = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return gaps.groupBy(*by).agg(
        F.count("*").alias("total"), *(count("outcome", o) for o in fixed.OUTCOME), *(count("band", b) for b in ("high", "medium", "low")),
        F.count_if("inherited").alias("inherited"), F.count_if(~F.col("inherited")).alias("origin"),
    )


def input_hash(objects: DataFrame, fields: DataFrame) -> DataFrame:
    """What a validation saw: a hash of the contract and of the ids and versions of both stages, in order of id."""
    ends = fields.select("contract", F.explode(F.array_distinct(F.array("from_stage", "to_stage"))).alias("stage")).distinct()
    rows = objects.join(F.broadcast(ends), "stage").groupBy("tenant_id", "entity_id", "contract").agg(F.sort_array(F.collect_list(F.struct("id", "version"))).alias("seen"))
    basis = F.concat(F.col("contract"), F.lit("|"), F.array_join(F.transform("seen", lambda s: F.concat_ws(":", s["id"].cast("string"), s["version"].cast("string"))), "|"))
    return rows.select("tenant_id", "entity_id", "contract", F.sha2(basis, 256).alias("input_hash"))


#: Bits of an id that one level of the tree of input_tree() takes together: a node has at most 2 ** FANOUT children.
FANOUT = 10


def input_tree(objects: DataFrame, by: list[str]) -> DataFrame:
    """(by, tree): what was seen of each `by`, as the root of a hash tree over its ids, so that no row holds them all.

    A leaf is the ids of one range of 2 ** FANOUT: SHA-256 of "id:version" in order of
    id, joined by "|". The node above is its children's hashes in order, joined and
    hashed alike; one that has a single child is that child, so the root doesn't
    depend on how many levels there are. `id` is an integer and unique.
    """
    most = objects.agg(F.max(F.greatest(F.abs("id"), F.lit(1)))).first()[0] or 1
    said = F.concat_ws(":", F.col("id").cast("string"), F.col("version").cast("string"))
    level = objects.select(*by, F.col("id").alias("at"), said.alias("hash"))
    # Between levels hashes are their 32 bytes. Leaves are shuffled by range, what is above them once more, by `by` alone.
    told = F.array_join(F.transform("kids.hash", lambda x: F.lower(F.hex(x))), "|")
    kids = F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("kids")
    up = level.groupBy(*by, F.shiftright("at", FANOUT).alias("up")).agg(kids)
    level = up.select(*by, F.col("up").alias("at"), F.unhex(F.sha2(F.array_join(F.col("kids.hash"), "|"), 256)).alias("hash")).repartition(*by)
    for _ in range(-(-int(most).bit_length() // FANOUT)):
        up = level.groupBy(*by, F.shiftright("at", FANOUT).alias("up")).agg(kids)
        node = F.when(F.size("kids") > 1, F.unhex(F.sha2(told, 256))).otherwise(F.element_at("kids.hash", 1))
        level = up.select(*by, F.col("up").alias("at"), node.alias("hash"))
    # Ids below and above 0 end in two nodes.
    roots = level.groupBy(*by).agg(kids)
    return roots.select(*by, F.when(F.size("kids") > 1, F.sha2(told, 256)).otherwise(F.lower(F.hex(F.element_at("kids.hash", 1)))).alias("tree"))


def stage_trees(objects: DataFrame, fields: DataFrame) -> DataFrame:
    """(tenant_id, entity_id, contract, input_hash): for each contract, the tree of an account's statements in both of its stages."""
    ends = fields.select("contract", F.explode(F.array_distinct(F.array("from_stage", "to_stage"))).alias("stage")).distinct()
    rows = objects.select("tenant_id", "entity_id", "stage", "id", "version").join(F.broadcast(ends), "stage")  # contracts are configuration
    tree = input_tree(rows, ["tenant_id", "entity_id", "contract"])
    return tree.select("tenant_id", "entity_id", "contract", F.sha2(F.concat_ws("|", "contract", "tree"), 256).alias("input_hash"))


def report(gaps: DataFrame) -> DataFrame:
    """The gaps of each account and contract, ranked by severity (place from 1)."""
    order = Window.partitionBy("tenant_id", "entity_id", "contract").orderBy(F.desc("severity"), "field", "subject_key", "slot", "upstream_id", "downstream_id")
    return gaps.withColumn("place", F.row_number().over(order))
