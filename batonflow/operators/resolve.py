"""Resolution of names: entities, capabilities, people."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from batonflow import fixed
from batonflow.functions.scalars import normalize_alias, person_role, similarity, slugify, speaker_role, trigrams
from batonflow.staging import stage


def resolve_entities(hints: DataFrame, aliases: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(tenant_id, hint, entity, how, near, similarity) for each distinct hint.

    `hints`: tenant_id, hint, arrival_seq; `aliases`: tenant_id, name (normalised),
    entity, the confirmed ones. Null and blank hints are "Unknown". A hint whose
    normalised name is known, or was that of an earlier hint, is that entity. Else it
    is compared with the names known by then, confirmed ones and earlier hints': the
    most similar (ties to the smaller name) gives it its entity from .85 on, or is
    noted as near from .6 on; a name that isn't linked is a new entity. `similarity`
    is null where nothing reaches .6.

    A name's most similar earlier name doesn't depend on what became of that: so all
    are found by one join on trigrams, and links are followed to their ends by
    doubling. No tenant is one task's.
    """
    named = hints.select("tenant_id", F.when(F.trim(F.coalesce("hint", F.lit(""))) == "", "Unknown").otherwise(F.col("hint")).alias("hint"), "arrival_seq")
    first = named.groupBy("tenant_id", "hint").agg(F.min("arrival_seq").alias("seq")).withColumn("name", normalize_alias(F.col("hint")))
    confirmed = aliases.groupBy("tenant_id", "name").agg(F.min("entity").alias("known"))
    first = stage(first.join(confirmed, ["tenant_id", "name"], "left"), "hints")
    asked = first.where("known IS NULL").groupBy("tenant_id", "name").agg(F.min(F.struct("seq", "hint")).alias("head"))
    names = stage(asked.select("tenant_id", "name", "head.seq", "head.hint").union(confirmed.select("tenant_id", "name", F.lit(None).cast("long"), F.lit(None).cast("string"))), "names")

    pairs = similar_pairs(names, fixed.NEAR_NAME, by=["tenant_id"])
    order = lambda c: names.select("tenant_id", F.col("name").alias(c), F.col("seq").alias(f"{c}_seq"), F.col("hint").alias(f"{c}_hint"))
    both = pairs.join(order("a"), ["tenant_id", "a"]).join(order("b"), ["tenant_id", "b"])
    earlier = lambda x, y: F.col(f"{x}_seq").isNotNull() & (F.col(f"{y}_seq").isNull() | (F.struct(f"{y}_seq", f"{y}_hint") < F.struct(f"{x}_seq", f"{x}_hint")))
    led = [both.where(earlier(x, y)).select("tenant_id", F.col(x).alias("name"), F.struct((-F.col("similarity")).alias("s"), F.col(y).alias("to")).alias("m")) for x, y in (("a", "b"), ("b", "a"))]
    best = led[0].union(led[1]).groupBy("tenant_id", "name").agg(F.min("m").alias("m")).select("tenant_id", "name", (-F.col("m.s")).alias("similarity"), F.col("m.to").alias("best"))
    rows = names.join(best, ["tenant_id", "name"], "left").join(confirmed, ["tenant_id", "name"], "left")
    linked = F.col("similarity") >= fixed.SAME_NAME
    rows = stage(rows.withColumn("entity", F.when(F.col("known").isNotNull(), F.col("known")).when(~F.coalesce(linked, F.lit(False)), slugify(F.col("hint")))).withColumn("to", F.when(F.col("entity").isNull(), F.col("best"))), "links")
    # What has no entity yet hangs on another name; each round it hangs on that one's end, so rounds grow with the logarithm of a chain.
    ends = rows.select("tenant_id", "name", "entity", "to")
    for _ in range(max_rounds):
        if ends.where("entity IS NULL").isEmpty():
            break
        ahead = ends.select("tenant_id", F.col("name").alias("to"), F.col("entity").alias("its"), F.col("to").alias("further"))
        ends = stage(ends.join(ahead, ["tenant_id", "to"], "left").select("tenant_id", "name", F.coalesce("entity", "its").alias("entity"), F.when(F.coalesce("entity", "its").isNull(), F.col("further")).alias("to")), "ends")
    else:
        raise RuntimeError("links of names did not settle")
    entity_of = ends.select("tenant_id", "name", "entity")
    found = rows.select("tenant_id", "name", "similarity", "best", F.col("hint").alias("head")).join(entity_of, ["tenant_id", "name"])
    found = found.join(entity_of.select("tenant_id", F.col("name").alias("best"), F.col("entity").alias("its")), ["tenant_id", "best"], "left").drop("best")
    out = first.select("tenant_id", "name", "hint", "known").join(found, ["tenant_id", "name"])
    exact = F.col("known").isNotNull() | (F.col("hint") != F.col("head"))
    is_linked = ~exact & F.coalesce(linked, F.lit(False))
    return out.select(
        "tenant_id", "hint", "entity", F.when(exact, "exact").when(is_linked, "linked").otherwise("new").alias("how"),
        F.when(~exact & ~is_linked, F.col("its")).alias("near"), F.when(exact, 1.0).otherwise(F.round("similarity", 3)).alias("similarity"),
    )


def similar_pairs(names: DataFrame, least: float, name: str = "name", by: list[str] | None = None) -> DataFrame:
    """(by, a, b, similarity) of names of one `by` that are at least so similar, a < b.

    Names meet by their rarest trigrams: of two that are so similar, one is among the
    first n - ceil(least * n) + 1 of either in any one order. So a trigram that most
    names have brings hardly any together.
    """
    by = by or []
    known = names.select(*by, F.col(name).alias("n")).where("n IS NOT NULL").distinct().withColumn("t", trigrams(F.col("n")))
    known = stage(known.where(F.size("t") > 0), "trigrams")
    each = known.select(*by, "n", F.size("t").alias("k"), F.explode("t").alias("g"))
    rarity = each.groupBy(*by, "g").agg(F.count("*").alias("c"))
    prefix = each.join(rarity, [*by, "g"]).groupBy(*by, "n", "k").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("order"))
    prefix = stage(prefix.select(*by, "n", "k", F.explode(F.slice("order", F.lit(1), F.col("k") - F.ceil(F.lit(least) * F.col("k") - 1e-9).cast("int") + 1)).alias("x")).select(*by, "n", "k", "x.g"), "prefix")
    side = lambda p: prefix.select(*by, "g", F.col("n").alias(p), F.col("k").alias(f"k{p}"))
    met = side("a").join(side("b"), [*by, "g"]).where("a < b").where(F.least("ka", "kb") >= F.lit(least) * F.greatest("ka", "kb") - 1e-9).select(*by, "a", "b").distinct()
    both = met.join(known.select(*by, F.col("n").alias("a"), F.col("t").alias("ta")), [*by, "a"]).join(known.select(*by, F.col("n").alias("b"), F.col("t").alias("tb")), [*by, "b"])
    return both.withColumn("similarity", similarity(F.col("ta"), F.col("tb"))).where(F.col("similarity") >= least).select(*by, "a", "b", "similarity")


def resolve_actors(statements: DataFrame, people: DataFrame, domains: DataFrame) -> DataFrame:
    """`statements` with role and person_id, by the kind of their source.

    Needs kind, stage, sender (e-mail: address, chat: user id) and label (calls: what
    the transcript calls the speaker). Calls give a role and no person, documents
    their stage as role.
    """
    asked = statements.withColumns({"email": F.when(F.col("kind") == "email", F.col("sender")), "chat_id": F.when(F.col("kind") == "slack", F.col("sender"))})
    found = resolve_people(asked.withColumnRenamed("stage", "_stage"), people, domains).withColumnRenamed("role", "_role")
    role = F.when(F.col("kind") == "call", speaker_role(F.col("label"))).when(F.col("kind").isin("email", "slack"), F.col("_role")).otherwise(F.coalesce("_stage", F.lit("other")))
    return found.select(*[F.col("_stage").alias("stage") if c == "stage" else c for c in statements.columns], role.alias("role"), F.when(F.col("kind").isin("email", "slack"), F.col("person_id")).alias("person_id"))


def resolve_people(asked: DataFrame, people: DataFrame, domains: DataFrame) -> DataFrame:
    """(…, person_id, stage, role): by e-mail, else by chat id, else by domain.

    People of outside companies and of customers' domains speak as customers to
    sales; staff by team. The directory is shuffled, not broadcast: it grows.
    """
    mail = people.select(F.lower("email").alias("m"), F.struct("person_id", "team", "external").alias("by_mail"))
    chat = people.select(F.col("chat_id").alias("c"), F.struct("person_id", "team", "external").alias("by_chat"))
    rows = asked.join(mail, F.lower("email") == F.col("m"), "left").join(chat, asked["chat_id"] == F.col("c"), "left")
    rows = rows.withColumn("domain", F.lower(F.split_part("email", F.lit("@"), F.lit(-1)))).join(domains, "domain", "left")
    p = F.coalesce("by_mail", "by_chat")
    outside = F.when(p.isNotNull(), p["external"]).otherwise(F.coalesce(~F.col("internal"), F.lit(False)))
    stage = F.when(outside, "sales").when(p.isNotNull(), p["team"])
    role = F.when(outside, "customer").when(p.isNotNull(), person_role(p["team"])).otherwise("other")
    return rows.select(*asked.columns, p["person_id"].alias("person_id"), stage.alias("stage"), role.alias("role"))


def resolve_capabilities(proposed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(proposed, slug, how, near): exact slug or synonym, else similar from .85 on, else a candidate.

    `vocabulary`: slug, synonyms, status. Only confirmed slugs are matched, as they are
    before the batch; vocabulary.resolve_in_order() lets it grow meanwhile.
    """
    from batonflow.functions.scalars import normalize_capability

    known = vocabulary.where("status = 'confirmed'").select("slug", F.explode(F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("slug"))).alias("word")).distinct()
    asked = proposed.select("proposed").distinct().withColumn("word", normalize_capability(F.col("proposed")))
    exact = asked.join(known, "word", "left").groupBy("proposed", "word").agg(F.min("slug").alias("exact"))
    # Words meet by their rarest trigrams, so that one which most words have brings hardly any together.
    open_ = exact.where("exact IS NULL").select("word")
    pairs = similar_pairs(open_.union(known.select("word")).distinct(), fixed.NEAR_NAME, "word")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("known_word"), "similarity").union(pairs.select("b", "a", "similarity"))
    scored = both.join(known.withColumnRenamed("word", "known_word"), "known_word")
    best = scored.groupBy("word").agg(F.max("similarity").alias("s"), F.min_by("slug", F.struct(-F.col("similarity"), F.col("slug"))).alias("best"))
    return exact.join(best, "word", "left").select(
        "proposed",
        F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("s") >= fixed.SAME_NAME, F.col("best")).otherwise(F.col("word")).alias("slug"),
        F.when(F.col("exact").isNotNull(), "exact").when(F.col("s") >= fixed.SAME_NAME, "linked").otherwise("candidate").alias("how"),
        F.when(F.col("exact").isNull() & (F.col("s") < fixed.SAME_NAME) & (F.col("s") >= fixed.NEAR_NAME), F.col("best")).alias("near"),
    )
