"""Domain functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from batonflow import fixed

STRIP = r"(?U)^\s+|\s+$"


def either(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def authority(kind: Column, role: Column, stage: Column, speculative: Column) -> Column:
    """0 to 4, first rule that fits: whose statement it is outranks how it is hedged."""
    return (
        F.when(role == "customer", 4)
        .when((role == "product") & (kind == "decision"), 4)
        .when((role == "leadership") & kind.isin("decision", "commitment"), 4)
        .when(speculative, 1)
        .when(role == "sales", F.when(kind == "commitment", 3).otherwise(2))
        .when(role.isin("product", "engineering", "leadership"), 3)
        .when((role == "other") & stage.isNotNull(), 3)
        .otherwise(0)
    )


def normalize_alias(name: Column) -> Column:
    """Lower case, no punctuation, no company suffix, single spaces."""
    words = F.split(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", ""), r"(?U)\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin("inc", "corp", "corporation", "llc", "ltd", "co")), " ")


def _key(text: Column, joint: str, empty: str) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")
    return F.when(F.coalesce(made, F.lit("")) == "", empty).otherwise(made)


def slugify(name: Column) -> Column:
    return _key(name, "-", "entity")


def normalize_capability(name: Column) -> Column:
    return _key(name, "_", "capability")


def trigrams(text: Column) -> Column:
    """Distinct three-letter windows of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram arrays; 0 if both are empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, F.lit(0.0)).otherwise(both.cast("double") / all_)


def subject_key(slug: Column, capability: Column, incident: Column) -> Column:
    return F.when((capability == "incident") & incident.isNotNull(), F.concat_ws(":", slug, F.lit("incident"), incident)).otherwise(F.concat_ws(":", slug, capability))


def initial_status(confidence: Column, new_capability: Column) -> Column:
    return F.when((confidence < fixed.SURE) | new_capability, "candidate").otherwise("active")


def stances_conflict(a: Column, b: Column) -> Column:
    pairs = either(((a == x) & (b == y)) | ((a == y) & (b == x)) for x, y in fixed.CONFLICTING_STANCES)
    return F.coalesce(pairs, F.lit(False))


def dates_compatible(a: Column, b: Column, pa: Column, pb: Column) -> Column:
    """Equal, or of one precision and in one month or quarter. Null precision: day."""
    pa, pb = F.coalesce(pa, F.lit("day")), F.coalesce(pb, F.lit("day"))
    same = lambda unit: (pa == unit) & (pb == unit) & (F.date_trunc(unit, a) == F.date_trunc(unit, b))
    return (a == b) | same("month") | same("quarter")


def cosine(a: Column, b: Column) -> Column:
    """0 for null or a zero norm."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when(a.isNull() | b.isNull() | (norm == 0), F.lit(0.0)).otherwise(total(a, b) / norm)


def severity(importance: Column, rank: Column, outcome: Column) -> Column:
    """Exact decimals: the product has two places."""
    pick = lambda col, table: reduce(lambda c, kv: c.when(col == kv[0], F.lit(kv[1]).cast("decimal(3,1)")), table.items(), F.when(F.lit(False), F.lit(None).cast("decimal(3,1)")))
    by_rank = F.coalesce(pick(rank, fixed.AUTHORITY), F.lit("0.1").cast("decimal(3,1)"))
    return (pick(importance, fixed.IMPORTANCE) * by_rank * pick(outcome, fixed.OUTCOME)).cast("decimal(4,2)")


def band(value: Column) -> Column:
    return F.when(value >= 2, "high").when(value >= 1, "medium").otherwise("low")


def is_set(value: Column) -> Column:
    """Slot values as text: null and the empty string, list and object are not set; '0' and 'false' are."""
    return F.coalesce(~value.isin("", "[]", "{}"), F.lit(False))


def _plain(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, STRIP, ""))


def _parsed(value: Column, start: str, schema: str) -> Column:
    """A slot's JSON text as a list or an object, null if it is neither."""
    return F.from_json(F.when(F.ltrim(value).startswith(start), value), schema)


def normalize(value: Column) -> Column:
    """What slot values are compared by: text trimmed in lower case; a list's items so and sorted; an object's so, by key."""
    items = F.array_sort(F.transform(_parsed(value, "[", "array<string>"), lambda x: F.coalesce(_plain(x), F.lit("null"))))
    pairs = F.array_sort(F.transform(F.map_entries(_parsed(value, "{", "map<string,string>")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(_plain(e["value"]), F.lit("null")))))
    put = lambda parts, a, z: F.concat(F.lit(a), F.array_join(parts, "\x01"), F.lit(z))
    return F.coalesce(put(items, "[", "]"), put(pairs, "{", "}"), _plain(value))


def shown(value: Column) -> Column:
    """A slot value in a sentence: a list's items by comma, an object's as key=value."""
    items = F.transform(_parsed(value, "[", "array<string>"), lambda x: F.coalesce(x, F.lit("null")))
    pairs = F.transform(F.map_entries(_parsed(value, "{", "map<string,string>")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return F.coalesce(F.array_join(items, ", "), F.array_join(pairs, ", "), value)


def nested(value: Column, key: str) -> Column:
    """The normalised value of one key of an object; null if it isn't an object or lacks it."""
    return normalize(F.get_json_object(F.when(F.ltrim(value).startswith("{"), value), f"$.{key}"))


def capability_of(subject: Column) -> Column:
    return F.when(F.instr(subject, ":") > 0, F.split_part(subject, F.lit(":"), F.lit(2))).otherwise(subject)


def visible(acl: Column, principals: list[str]) -> Column:
    """An access list overlaps the caller's principals or holds '*'; an empty list hides."""
    return F.coalesce(F.arrays_overlap(acl, F.array(*map(F.lit, [*principals, "*"]))), F.lit(False))


def redact(text: Column, acl: Column, principals: list[str]) -> Column:
    return F.when(visible(acl, principals), text)


def cache_key(content_hash: Column, *parts: str) -> Column:
    """Key of an extraction: content, prompt version, model, schema version, context."""
    return F.concat(F.lit("extract:"), F.sha2(F.concat_ws(":", content_hash, *map(F.lit, parts)), 256))


def evidence_start(text: Column, quote: Column) -> Column:
    """0-based start of an exact quote; null if it is empty or not there."""
    found = F.call_function("position", quote, text)
    return F.when((F.length(quote) > 0) & (found > 0), found - 1)


def person_role(team: Column) -> Column:
    return F.when(team.isin("sales", "product", "engineering", "leadership"), team).otherwise("other")


def speaker_role(label: Column) -> Column:
    """The role of a speaker as a call transcript names it; any other name is "other"."""
    known = F.create_map(*[F.lit(x) for kv in fixed.SPEAKERS.items() for x in kv])
    return F.coalesce(known[F.upper(F.regexp_replace(label, STRIP, ""))], F.lit("other"))


def command(text: Column) -> Column:
    """<mark, entity, topic, note> of a chat command, its mention and what follows it stripped. `mark` is a word of its own; note is what is marked."""
    body = F.regexp_replace(F.regexp_replace(text, r"^\s*<@[^>]+>[:,]?\s*", ""), STRIP, "")
    mark = body.rlike(r"(?i)^mark\b")
    parts = F.split(body, r"\s+", 2)
    return F.struct(
        mark.alias("mark"), F.when(~mark, F.get(parts, F.lit(0))).alias("entity"), F.when(~mark, F.get(parts, F.lit(1))).alias("topic"),
        F.when(mark, F.regexp_replace(body, r"(?is)^mark\b\s*", "")).alias("note"),
    )
