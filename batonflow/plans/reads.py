"""Read models: search, explorer, conflicts, gaps, flows, dashboard, incidents, jobs."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from batonflow import fixed
from batonflow.functions.scalars import normalize_alias, redact, visible


def zero_filled(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(column, n): counts of each listed value, 0 where there is none."""
    names = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return names.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def search(objects: DataFrame, sources: DataFrame, principals: list[str], text: str = "", status: str = "active", entity=None, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Statements that the caller may see, by authority and then time; at most 500."""
    rows = objects.where(F.col("status") == status).join(sources, "source_id").where(visible(F.col("acl"), principals))
    for name, value in (("entity_id", entity), ("type", kind)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if text:
        rows = rows.where(F.col("content").ilike(f"%{text}%"))
    return rows.orderBy(F.desc("authority"), F.desc("valid_from"), "id").limit(min(limit, 500))


def redacted(sources: DataFrame, principals: list[str], column: str) -> DataFrame:
    return sources.withColumn(column, redact(F.col(column), F.col("acl"), principals))


def source_counts(objects: DataFrame, sources: DataFrame, principals: list[str]) -> DataFrame:
    rows = objects.join(sources, "source_id").where(visible(F.col("acl"), principals))
    return rows.groupBy("entity_id", "kind").agg(F.countDistinct("source_id").alias("n_sources"))


def gap_objects(gaps: DataFrame, objects: DataFrame) -> DataFrame:
    """Gaps with each statement on either side: the OR of two keys as one exploded equi-join."""
    sides = gaps.select("gap_id", F.explode(F.array_distinct(F.array("upstream_id", "downstream_id"))).alias("id")).where("id IS NOT NULL")
    return sides.join(objects, "id")


def flow_rollup(validations: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per contract, over the latest validation of each account: accounts, open gaps by band, last run."""
    last = latest(validations, ["entity_id", "contract"], F.desc("created_at"), F.desc("validation_id"))
    open_ = gaps.where("status = 'open'").groupBy("validation_id").agg(F.count("*").alias("g"), *(F.count_if(F.col("band") == b).alias(b) for b in ("high", "medium", "low")))
    rows = last.join(open_, "validation_id", "left").fillna(0, ["g", "high", "medium", "low"])
    return rows.groupBy("contract").agg(
        F.count("*").alias("entities_validated"), F.sum("g").alias("open_gaps"), *(F.sum(b).alias(b) for b in ("high", "medium", "low")), F.max("created_at").alias("last_run")
    )


def conflict_pairs(relations: DataFrame, objects: DataFrame, sources: DataFrame, principals: list[str]) -> DataFrame:
    """Pending contradictions of which the caller may see either side, newest first."""
    side = lambda p: objects.join(sources, "source_id", "left").select(F.col("id").alias(f"{p}_id"), F.col("valid_from").alias(f"{p}_at"), F.coalesce(visible(F.col("acl"), principals), F.lit(False)).alias(f"{p}_seen"))
    rows = relations.where("resolved_at IS NULL").join(side("from"), "from_id").join(side("to"), "to_id").where("from_seen OR to_seen")
    return rows.orderBy(F.desc("from_at"), "from_id", "to_id")


def deadlines(objects: DataFrame, today: date, limit: int = 20) -> DataFrame:
    """The next due dates of active statements; overdue if before `today`."""
    rows = objects.where("status = 'active' AND due_date IS NOT NULL").withColumn("overdue", F.col("due_date") < F.lit(today))
    return rows.orderBy("due_date", "id").limit(limit)


def incident_window(confirmed: DataFrame, key: str, at: str, hours: int = fixed.INCIDENT_HOURS) -> DataFrame:
    """From `hours` before the first to `hours` after the last confirmed statement, both ends in."""
    step = F.expr(f"INTERVAL {hours} HOURS")
    return confirmed.groupBy(key).agg((F.min(at) - step).alias("lo"), (F.max(at) + step).alias("hi"))


def incident_links(incidents: DataFrame, accounts: DataFrame, objects: DataFrame, sources: DataFrame, entities: DataFrame, hours: int = fixed.INCIDENT_HOURS) -> DataFrame:
    """(incident_id, id, linked): what declaring incidents attaches to them.

    Statements that name the incident are linked. Others are candidates: subject
    ending in ":incident", of a declared account or of "Unknown", and their source's
    time within `hours` of the confirmed ones' sources, or, where those have no
    time, of the declaration. Both ends count.

    `incidents`: tenant_id, incident_id, declared_at; `accounts`: incident_id,
    entity_id; `objects` with named_incident; `sources`: source_id, source_ts.
    """
    timed = objects.join(sources.select("source_id", "source_ts"), "source_id", "left")
    named = incidents.select("tenant_id", F.col("incident_id").alias("named_incident"))
    sure = timed.join(named, ["tenant_id", "named_incident"]).select(F.col("named_incident").alias("incident_id"), "id", "source_ts")
    step = F.expr(f"INTERVAL {hours} HOURS")
    spans = sure.groupBy("incident_id").agg(F.min("source_ts").alias("a"), F.max("source_ts").alias("z"))
    spans = incidents.join(spans, "incident_id", "left").select("tenant_id", "incident_id", (F.coalesce("a", "declared_at") - step).alias("lo"), (F.coalesce("z", "declared_at") + step).alias("hi"))
    anyone = incidents.join(entities.where("name = 'Unknown'"), "tenant_id").select("incident_id", "entity_id")
    of = spans.join(accounts.select("incident_id", "entity_id").union(anyone).distinct(), "incident_id")
    near = timed.where(F.col("subject_key").endswith(":incident")).join(of, ["tenant_id", "entity_id"]).where(F.col("source_ts").between(F.col("lo"), F.col("hi")))
    near = near.select("incident_id", "id").join(sure.select("incident_id", "id"), ["incident_id", "id"], "left_anti")
    return sure.select("incident_id", "id", F.lit(True).alias("linked")).union(near.withColumn("linked", F.lit(False)))


def link_reviewed(links: DataFrame, reviews: DataFrame) -> DataFrame:
    """`links` after reviews (incident_id, id, linked, seq): a pair's last one counts, and a new pair is added."""
    last = reviews.groupBy("incident_id", "id").agg(F.max_by("linked", "seq").alias("now"))
    return links.join(last, ["incident_id", "id"], "full").select("incident_id", "id", F.coalesce("now", "linked").alias("linked"))


def incident_summaries(incidents: DataFrame, links: DataFrame, accounts: DataFrame, entities: DataFrame) -> DataFrame:
    """`incidents` with the sorted names of their accounts and the number of linked statements."""
    names = accounts.join(entities.select("entity_id", "name"), "entity_id").groupBy("incident_id").agg(F.array_sort(F.collect_set("name")).alias("entities"))
    counts = links.where("linked").groupBy("incident_id").agg(F.count("*").alias("object_count"))
    rows = incidents.join(names, "incident_id", "left").join(counts, "incident_id", "left")
    return rows.withColumns({"entities": F.coalesce("entities", F.array().cast("array<string>")), "object_count": F.coalesce("object_count", F.lit(0))})


def incident_timeline(links: DataFrame, objects: DataFrame, sources: DataFrame) -> DataFrame:
    """All statements of each incident with `at`: their source's time, else their own creation; ordered by place (from 1)."""
    rows = links.join(objects, "id").join(sources.select("source_id", "source_ts"), "source_id", "left").withColumn("at", F.coalesce("source_ts", "created_at"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("incident_id").orderBy("at", "id")))


def incident_latest(links: DataFrame, objects: DataFrame, slots: DataFrame, names=("impact", "sla_impact", "root_cause", "remediation")) -> DataFrame:
    """(incident_id, slot, id, value): the newest active statement of an incident that has the slot at all; ties to the smaller id."""
    rows = links.join(objects.where("status = 'active'").select("id", "created_at"), "id").join(slots.where(F.col("slot").isin(*names)), "id")
    return rows.groupBy("incident_id", "slot").agg(F.max_by(F.struct("id", "value"), F.struct("created_at", -F.col("id"))).alias("m")).select("incident_id", "slot", "m.*")


def incident_gaps(accounts: DataFrame, validations: DataFrame, gaps: DataFrame) -> DataFrame:
    """(incident_id, gap_id): open gaps of all validations of an incident's accounts, each pair once.

    Only a gap of several accounts can meet an incident twice, so no other pairs are told apart.
    """
    runs = gaps.where("status = 'open'").select("validation_id", "gap_id").join(validations.select("validation_id", "entity_id"), "validation_id")
    found = runs.where("entity_id IS NOT NULL").groupBy("gap_id").agg(F.collect_set("entity_id").alias("of"))
    asked = accounts.select("incident_id", "entity_id").distinct()
    own = found.where("size(of) = 1").select("gap_id", F.element_at("of", 1).alias("entity_id")).join(asked, "entity_id")
    shared = found.where("size(of) > 1").select("gap_id", F.explode("of").alias("entity_id")).join(asked, "entity_id")
    return own.select("incident_id", "gap_id").union(shared.select("incident_id", "gap_id").distinct())


def people_frequency(rows: DataFrame, label: str, role: str) -> DataFrame:
    """How often each person speaks; a missing or blank label is "Unknown"."""
    name = F.when(F.coalesce(F.col(label), F.lit("")) == "", "Unknown").otherwise(F.col(label))
    return rows.groupBy(name.alias("label"), F.col(role).alias("role")).agg(F.count("*").alias("n"))


def similar_incidents(incidents: DataFrame, limit: int = 5) -> DataFrame:
    """For each incident the latest resolved others of its accounts."""
    other = incidents.where("resolved").select("entity_id", F.col("incident_id").alias("similar_id"), F.col("declared_at").alias("at"))
    rows = incidents.select("entity_id", "incident_id").join(other, "entity_id").where("incident_id <> similar_id").select("incident_id", "similar_id", "at").distinct()
    best = Window.partitionBy("incident_id").orderBy(F.desc("at"), "similar_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def chat_reply(objects: DataFrame, sources: DataFrame, aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask_id, place, id, line): what chat commands answer, all that the caller may see.

    `asked`: ask_id, tenant_id, entity, topic (null: any), principal. An account is
    found by its normalised alias (`aliases`: tenant_id, name, entity_id; of several
    accounts the smallest), a topic in subject or content whatever the case. Highest
    authority first, then the newest.
    """
    account = aliases.groupBy("tenant_id", "name").agg(F.min("entity_id").alias("entity_id"))
    who = asked.withColumn("name", normalize_alias(F.col("entity"))).join(account, ["tenant_id", "name"]).select("ask_id", "tenant_id", "entity_id", F.lower("topic").alias("topic"), "principal")
    rows = objects.where("status = 'active'").join(sources.select("source_id", "acl"), "source_id").join(who, ["tenant_id", "entity_id"])
    about = F.col("topic").isNull() | (F.col("topic") == "") | F.lower("subject_key").contains(F.col("topic")) | F.lower("content").contains(F.col("topic"))
    seen = F.array_contains("acl", "*") | F.array_contains("acl", F.col("principal"))
    line = F.format_string("• [%s] %s (authority %d)", "type", "content", "authority")
    rows = rows.where(about & F.coalesce(seen, F.lit(False))).withColumn("place", F.row_number().over(Window.partitionBy("ask_id").orderBy(F.desc("authority"), F.desc("created_at"), "id")))
    return rows.select("ask_id", "place", "id", line.alias("line"))


def queue_after_failures(attempts: DataFrame, most: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """Status and back-off seconds of failed jobs: poison from `most` attempts on, else queued again after 2^n s or what the provider said."""
    wait = F.coalesce(F.col("retry_after").cast("double"), F.pow(F.lit(2.0), F.col("attempts")))
    poison = F.col("attempts") >= most
    return attempts.select("job_id", F.when(poison, "poison").otherwise("queued").alias("status"), F.when(~poison, wait).alias("wait_s"))


def reclaimable(jobs: DataFrame, now: datetime, seconds: int = fixed.STALE_SECONDS) -> DataFrame:
    """Jobs that have been running for longer than `seconds`: strictly before the cut."""
    return jobs.where((F.col("status") == "running") & (F.col("started_at") < F.lit(now) - F.expr(f"INTERVAL {seconds} SECONDS")))


def claimable(jobs: DataFrame, now: datetime, n: int) -> DataFrame:
    """The oldest runnable jobs."""
    return jobs.where((F.col("status") == "queued") & (F.col("run_after") <= F.lit(now))).orderBy("run_after", "job_id").limit(n)


def incident_ids(objects: DataFrame) -> DataFrame:
    """(tenant_id, incident_id): the incidents that statements name."""
    return objects.where("named_incident <> ''").select("tenant_id", F.col("named_incident").alias("incident_id")).distinct()


def newest(objects: DataFrame, by: str, n: int = 20) -> DataFrame:
    """The n newest statements of each tenant and stage, ranked."""
    order = Window.partitionBy("tenant_id", "stage").orderBy(F.desc(by), "id")
    return objects.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def count_by_type(objects: DataFrame) -> DataFrame:
    return objects.groupBy("entity_id", "type").agg(F.count("*").alias("n"))


def find_entity(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """`asked` (ref) with entity_id: by id if it is one, else by slug."""
    by_id = entities.select(F.col("entity_id").cast("string").alias("ref"), F.col("entity_id").alias("by_id"))
    by_slug = entities.select(F.col("slug").alias("ref"), F.col("entity_id").alias("by_slug"))
    return asked.join(by_id, "ref", "left").join(by_slug, "ref", "left").withColumn("entity_id", F.coalesce("by_id", "by_slug")).drop("by_id", "by_slug")


def history(versions: DataFrame, relations: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, kind, version, what, from_id, to_id): the versions of each asked statement and all edges of its supersession component.

    `versions`: id, version, status; `relations`: from_id, to_id of supersedes edges; `asked`: id.
    """
    from batonflow.operators.graph import connected_components

    of = connected_components(relations, "from_id", "to_id")
    mine = asked.select("id").distinct().join(of.withColumnRenamed("node", "id"), "id")
    edges = relations.join(of.withColumnRenamed("node", "from_id"), "from_id").select("component", "from_id", "to_id").distinct()
    none = F.lit(None).cast("long")
    own = versions.join(asked.select("id").distinct(), "id", "left_semi").select("id", F.lit("version").alias("kind"), F.col("version").cast("int").alias("version"), F.col("status").alias("what"), none.alias("from_id"), none.alias("to_id"))
    return own.union(mine.join(edges, "component").select("id", F.lit("supersedes"), F.lit(None).cast("int"), F.lit(None).cast("string"), "from_id", "to_id"))


def established_subject(objects: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, subject_key, hint): the incident that another section of a drive document established first.

    `sources`: source_id, tenant_id, kind, document_id. Only subjects with an
    incident bind; the first by created_at, then id. Two firsts of different
    sections are kept a document, so each section finds one that isn't its own.
    """
    files = sources.where("kind = 'drive' AND document_id IS NOT NULL").select("tenant_id", "document_id", "source_id")
    named = objects.where(F.col("subject_key").rlike("^.*:incident:")).select("source_id", "subject_key", "created_at", "id")
    first = files.join(named, "source_id").groupBy("tenant_id", "document_id", "source_id").agg(F.min(F.struct("created_at", "id", "subject_key")).alias("m"))
    two = first.withColumn("n", F.row_number().over(Window.partitionBy("tenant_id", "document_id").orderBy("m"))).where("n <= 2")
    two = two.select("tenant_id", "document_id", F.col("source_id").alias("other"), "m")
    best = files.join(two, ["tenant_id", "document_id"]).where("other <> source_id").groupBy("source_id").agg(F.min("m").alias("m")).select("source_id", "m.subject_key")
    parts = F.split("subject_key", ":", 3)
    bound = F.concat(F.lit('subject_capability="incident", the same incident (attributes.extra.incident_id="'), parts[2], F.lit('")'))
    return best.withColumn("hint", F.when(parts[1] == "incident", bound).otherwise(F.concat(F.lit('subject_capability="'), parts[1], F.lit('"'))))


OUTPUT = ["id", "tenant_id", "entity_id", "type", "subject_key", "content", "attributes", "actor_label", "actor_role", "stage", "authority", "confidence", "status", "valid_from", "valid_to", "source_id", "evidence_quote", "version", "created_at", "updated_at"]


def object_output(objects: DataFrame, sources: DataFrame, principals: list[str] | None) -> DataFrame:
    """Statements as they are shown: the columns of OUTPUT that there are, evidence_span as [lo, hi], and their source.

    `source`: kind, stage, source_ts and provenance, the last null unless the caller may
    see the source; null where there is no source.
    """
    seen = visible(F.col("acl"), principals or [])
    side = sources.select(F.col("source_id").alias("_source_id"), F.struct("kind", F.col("stage").alias("stage"), "source_ts", F.when(seen, F.col("provenance")).alias("provenance")).alias("source"))
    kept = [c for c in OUTPUT if c in objects.columns]
    span = [F.when(F.col("evidence_span").isNotNull(), F.array("evidence_span.lo", "evidence_span.hi")).alias("evidence_span")] if "evidence_span" in objects.columns else []
    return objects.join(side, F.col("source_id") == F.col("_source_id"), "left").select(*kept, *span, "source")


def entity_context(objects: DataFrame, sources: DataFrame, principals: list[str]) -> DataFrame:
    """What the caller may see of each account: its active statements and those in conflict, with their place.

    Active ones are placed by type and then authority, the highest first, in conflict by
    id; ties by id. `group` is the type, or "conflicts", which come last.
    """
    rows = objects.where(F.col("status").isin("active", "conflicting")).join(sources.select("source_id", "acl"), "source_id").where(visible(F.col("acl"), principals))
    active = F.col("status") == "active"
    by = Window.partitionBy("entity_id").orderBy(F.desc(active), F.when(active, F.col("type")), F.when(active, -F.col("authority")), "id")
    return rows.drop("acl").withColumns({"group": F.when(active, F.col("type")).otherwise("conflicts"), "place": F.row_number().over(by)})


def merged_statuses(objects: DataFrame, statuses: list[str], limit: int = 50) -> DataFrame:
    """Of each tenant the statements of several statuses as one list, last updated first; ties by id."""
    by = Window.partitionBy("tenant_id").orderBy(F.desc("updated_at"), "id")
    return objects.where(F.col("status").isin(*statuses)).withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit)


def scoped(objects: DataFrame, tenant_id, team: str | None = None) -> DataFrame:
    """A tenant's statements, or those of one team's stage."""
    rows = objects.where(F.col("tenant_id") == tenant_id)
    return rows if team is None else rows.where(F.col("stage") == team)


#: A personal dashboard counts gaps up to this many.
MOST_GAPS = 50


def dashboard_counts(objects: DataFrame, gaps: DataFrame, today: date) -> DataFrame:
    """One row for each tenant and team (stage), and one for the tenant as a whole (team null).

    contradictions, pending (decisions that are candidates), deadlines and overdue
    (active statements with a due date, and before `today`), incidents (distinct named
    ones), gaps: open gaps with a statement of the scope on either side, for teams
    counted up to MOST_GAPS. `objects`: id, tenant_id, stage, type, status, due_date,
    incident_id; `gaps`: gap_id, status, upstream_id, downstream_id.
    """
    is_ = lambda c, v: F.col(c) == v
    rows = objects.withColumn("team", F.explode(F.array_distinct(F.array("stage", F.lit(None).cast("string")))))
    due = is_("status", "active") & F.col("due_date").isNotNull()
    counts = rows.groupBy("tenant_id", "team").agg(
        F.count_if(is_("status", "conflicting")).alias("contradictions"), F.count_if(is_("type", "decision") & is_("status", "candidate")).alias("pending"),
        F.count_if(due).alias("deadlines"), F.count_if(due & (F.col("due_date") < F.lit(today))).alias("overdue"), F.countDistinct(F.nullif("incident_id", F.lit(""))).alias("incidents"),
    )
    met = gap_objects(gaps.where("status = 'open'"), rows.select("id", "tenant_id", "team")).groupBy("tenant_id", "team").agg(F.countDistinct("gap_id").alias("n"))
    met = met.select(F.col("tenant_id").alias("_tenant"), F.col("team").alias("_team"), F.when(F.col("team").isNull(), F.col("n")).otherwise(F.least("n", F.lit(MOST_GAPS))).alias("n"))
    both = counts.join(met, F.col("tenant_id").eqNullSafe(F.col("_tenant")) & F.col("team").eqNullSafe(F.col("_team")), "left")
    return both.select(*counts.columns, F.coalesce("n", F.lit(0)).cast("long").alias("gaps"))


def find_people(people: DataFrame, asked: DataFrame) -> DataFrame:
    """`asked` (tenant_id, email) with the person of that address, trimmed and in lower case; null if there is none."""
    side = people.select(F.col("tenant_id").alias("_tenant"), F.col("email").alias("_email"), F.struct(*[c for c in people.columns if c != "tenant_id"]).alias("person"))
    return asked.join(side, (F.col("tenant_id") == F.col("_tenant")) & (F.lower(F.regexp_replace("email", r"^\s+|\s+$", "")) == F.col("_email")), "left").drop("_tenant", "_email")


def best_covered(entities: DataFrame, counts: DataFrame) -> DataFrame:
    """(slug, entity_id): of the accounts of one slug the one with most sources in all kinds; ties to the smaller id. Null slugs are passed over."""
    total = counts.groupBy("entity_id").agg(F.sum("n_sources").alias("n"))
    rows = entities.where("slug IS NOT NULL").join(total, "entity_id", "left")
    return rows.groupBy("slug").agg(F.min_by("entity_id", F.struct(-F.coalesce("n", F.lit(0)), F.col("entity_id"))).alias("entity_id"))


def with_corrections(items: DataFrame) -> DataFrame:
    """`items` whose map `extra` holds what they correct: corrects ("true" or "false") where they correct something or hint at it, and the hint."""
    told = F.coalesce("corrects", F.lit(False)) | (F.coalesce("corrects_hint", F.lit("")) != "")
    own = F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("corrects", "corrects_hint"))
    flag = F.create_map(F.lit("corrects"), F.coalesce("corrects", F.lit(False)).cast("string"))
    hint = F.when(F.coalesce("corrects_hint", F.lit("")) != "", F.create_map(F.lit("corrects_hint"), F.col("corrects_hint"))).otherwise(F.create_map().cast("map<string,string>"))
    return items.withColumn("extra", F.when(told, F.map_concat(own, flag, hint)).otherwise(F.col("extra")))
