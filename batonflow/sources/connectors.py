"""Sources: raw files to normalised rows, ingested once.

Every connector gives kind, external_id, text, source_ts, stage, acl.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from batonflow import fixed
from batonflow.operators.text import sections

COLUMNS = ["kind", "external_id", "text", "source_ts", "stage", "acl"]


def _everyone() -> Column:
    return F.array(F.lit("*"))


def _stage_of(name: Column, stages: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in stages.items() for x in kv])[name] if stages else F.lit(None).cast("string")


def drive(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files, a source for each section; the first folder is the stage, "Last updated" the time."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    root = Path(path).name
    inside = F.regexp_extract("file", rf"/{root}/(.*)$", 1)
    folder = F.split_part(inside, F.lit("/"), F.lit(1))
    stage = F.when(folder.isin(*fixed.STAGES), folder).when(folder == "customer-success", "customer_success")
    updated = F.try_to_timestamp(F.nullif(F.regexp_extract("text", r"Last updated:\s*(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    docs = files.select("text", inside.alias("path"), stage.alias("stage"), F.coalesce(updated, F.col("modified")).alias("source_ts"))
    cut = sections(docs)
    return cut.select(F.lit("drive").alias("kind"), F.concat_ws("#", "path", "section_no").alias("external_id"), F.col("section").alias("text"), "source_ts", "stage", _everyone().alias("acl"))


def email(spark: SparkSession, path: str) -> DataFrame:
    """Thread files, a source for each message; `sender` is kept for the directory."""
    schema = "thread_id string, subject string, messages array<struct<message_id:string,`from`:string,`to`:array<string>,cc:array<string>,date:string,text:string>>"
    m = spark.read.schema(schema).option("multiLine", True).json(path).select("thread_id", F.explode("messages").alias("m"))
    return m.select(F.lit("email").alias("kind"), F.col("m.message_id").alias("external_id"), F.col("m.text").alias("text"), F.to_timestamp("m.date").alias("source_ts"), F.lit(None).cast("string").alias("stage"), _everyone().alias("acl"), F.col("m.from").alias("sender"))


def chat(spark: SparkSession, path: str, stages: dict[str, str], members: DataFrame | None = None) -> DataFrame:
    """Channel exports, a source for each plain message; private channels are for their members only.

    `members`: channel_id, members; a channel without a row is public.
    """
    schema = "workspace_id string, channels array<struct<channel_id:string,name:string,messages:array<struct<ts:string,user:string,text:string,bot_id:string,subtype:string,thread_ts:string>>>>"
    c = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("channels").alias("c"))
    m = c.select("c.channel_id", "c.name", F.explode("c.messages").alias("m")).where("m.bot_id IS NULL AND m.subtype IS NULL AND trim(m.text) <> ''")
    rows = m if members is None else m.join(members, "channel_id", "left")
    acl = _everyone() if members is None else F.coalesce("members", _everyone())
    at = F.timestamp_seconds(F.split_part("m.ts", F.lit("."), F.lit(1)).cast("long"))
    return rows.select(F.lit("slack").alias("kind"), F.concat_ws(":", "channel_id", "m.ts").alias("external_id"), F.col("m.text").alias("text"), at.alias("source_ts"), _stage_of(F.col("name"), stages).alias("stage"), acl.alias("acl"), F.col("m.user").alias("sender"))


def marked(events: DataFrame, messages: DataFrame) -> DataFrame:
    """Sources of `mark` commands: the text of the thread's parent, then what follows `mark`; commands with neither give none.

    `events`: event_id, channel_id, ts, thread_ts, text, source_ts, stage, acl;
    `messages`: channel_id, ts, text.
    """
    from batonflow.functions.scalars import command

    said = events.withColumn("c", command(F.col("text"))).where("c.mark").alias("e")
    parent = messages.select(F.col("channel_id").alias("_channel"), F.col("ts").alias("_ts"), F.col("text").alias("parent"))
    rows = said.join(parent, [F.col("e.channel_id") == F.col("_channel"), F.col("e.thread_ts") == F.col("_ts"), F.col("e.thread_ts") != F.col("e.ts")], "left")
    text = F.concat_ws("\n\n", F.nullif("parent", F.lit("")), F.nullif("c.note", F.lit("")))
    rows = rows.select(F.lit("slack").alias("kind"), F.concat(F.lit("mark:"), F.coalesce("event_id", F.concat_ws(":", "channel_id", "ts"))).alias("external_id"), text.alias("text"), "source_ts", "stage", "acl")
    return rows.where("text <> ''")


def calls(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sources, rejected): transcripts with `# key: value` headers; without given consent they are rejected and counted."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    head = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^#\s*{k}:\s*([^\n]*)$", 1)), F.lit(""))
    body = F.regexp_replace("value", r"\A(?:\s*#[^\n]*\n)*\s*", "")
    rows = files.select(
        F.lit("call").alias("kind"), F.coalesce(head("call_id"), F.regexp_replace("file", r"\.[^.]*$", "")).alias("external_id"), body.alias("text"),
        F.try_to_timestamp(head("date")).alias("source_ts"), F.lit("sales").alias("stage"), _everyone().alias("acl"), F.coalesce(F.lower(head("consent_given")) == "true", F.lit(False)).alias("ok"),
    )
    return rows.where("ok").drop("ok"), rows.where("NOT ok").select("external_id")


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def ingest(new: DataFrame, known: DataFrame | None, keys=("tenant_id", "kind", "external_id", "content_hash"), order: str = "arrival_seq") -> DataFrame:
    """`new` with was_new: the first row of each key that isn't known yet. Arriving again changes nothing."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    rows = new.withColumn("was_new", first)
    if known is None:
        return rows
    seen = known.select(*keys).distinct().withColumn("_known", F.lit(True))
    return rows.join(seen, list(keys), "left").withColumn("was_new", F.col("was_new") & F.col("_known").isNull()).drop("_known")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`table` with `rows` put over it by key; of several rows of a key the last by `order` counts."""
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return table.join(last, keys, "left_anti").unionByName(last.select(*table.columns))


def directory(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """entities, aliases (normalised, distinct), domains and people of a directory file."""
    from batonflow.functions.scalars import normalize_alias

    schema = "entities array<struct<slug:string,name:string,kind:string,aliases:array<string>>>, org_domains array<struct<domain:string,is_internal:boolean,entity_slug:string>>, people array<struct<email:string,slack_user_id:string,name:string,team:string,role:string,is_external:boolean,company_entity_slug:string>>, slack_channels map<string,string>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    e = d.select(F.explode("entities").alias("e")).select("e.*")
    names = e.select("slug", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("alias"))
    return {
        "entities": e.select("slug", "name", F.coalesce("kind", F.lit("customer")).alias("kind")),
        "aliases": names.select("slug", normalize_alias(F.col("alias")).alias("name")).where("name <> ''").distinct(),
        "domains": d.select(F.explode("org_domains").alias("x")).select(F.lower("x.domain").alias("domain"), F.col("x.is_internal").alias("internal"), F.col("x.entity_slug").alias("slug")),
        "people": d.select(F.explode("people").alias("p")).select(F.lower("p.email").alias("email"), F.col("p.slack_user_id").alias("chat_id"), "p.name", "p.team", "p.role", F.col("p.is_external").alias("external")).dropDuplicates(["email"]),
        "channels": d.select(F.explode("slack_channels").alias("channel", "stage")),
    }


def load_contracts(paths: list[str]) -> list[tuple]:
    """Contract files to the form of fixed.CONTRACTS; a list of target stages is a contract for each, its id suffixed."""
    import yaml

    out = []
    for path in sorted(paths):
        c = yaml.safe_load(Path(path).read_text())
        ends = c["to_stage"] if isinstance(c["to_stage"], list) else [c["to_stage"]]
        fields = [(f["name"], f["check"], f.get("types", []), f.get("slots", []), f["importance"], f.get("min_upstream_authority", 0), f.get("rule")) for f in c["fields"]]
        out += [(c["id"] + (f"::{end}" if len(ends) > 1 else ""), c["from_stage"], end, fields) for end in ends]
    return out


def sync_status(runs: DataFrame) -> DataFrame:
    """status of each run: failed if it saw nothing, partial if an item failed, else ok."""
    status = F.when(F.col("seen") == 0, "failed").when(F.col("failed") > 0, "partial").otherwise("ok")
    return runs.withColumn("status", status)
