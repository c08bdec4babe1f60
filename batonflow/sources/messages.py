"""Live messages: chat events as they are delivered, to sources that are ingested once.

Events are rows of a table or of a stream; a folder that event files are dropped into
is read by Spark's file stream, which keeps its own record of the files it has taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from batonflow.sources.connectors import _everyone, _stage_of, content_hash

EVENTS = "event_id string, type string, channel string, is_private boolean, ts string, thread_ts string, user string, text string, bot_id string, subtype string"
#: A message that opens like this is a command to the bot.
MENTION = r"^\s*<@[^>]+>"


def event_files(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A stream of the events in the files of a folder, one JSON object a line."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).json(path)


def live_sources(events: DataFrame, stages: dict[str, str], members: DataFrame | None = None) -> DataFrame:
    """kind, external_id, text, source_ts, stage, acl, sender, content_hash of the events that say something.

    Plain messages of people (type "message", no bot, no subtype) with text are
    sources, unless they open with a mention, which is a command. A "shortcut" is a
    message that somebody saves as context: always a source, with an id of its own, so
    that a message and its saved copy are two. Other types give none. `stages`: by
    channel id. `members`: channel_id, members; private channels are for these only, and
    for nobody where no row says who. Works on tables and streams.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    plain = (F.col("type") == "message") & F.col("bot_id").isNull() & F.col("subtype").isNull() & (text != "") & ~text.rlike(MENTION)
    rows = events.where(plain | (F.col("type") == "shortcut")).withColumn("text", text)
    at = F.concat_ws(":", "channel", "ts")
    name = F.when(F.col("type") == "shortcut", F.concat(F.lit("shortcut:"), at)).otherwise(F.coalesce("event_id", at))
    if members is None:
        known = F.lit(None).cast("array<string>")
    else:
        rows, known = rows.join(members.select(F.col("channel_id").alias("channel"), "members"), "channel", "left"), F.col("members")
    acl = F.when(F.coalesce("is_private", F.lit(False)), F.coalesce(known, F.array().cast("array<string>"))).otherwise(_everyone())
    when = F.timestamp_seconds(F.split_part("ts", F.lit("."), F.lit(1)).cast("long"))
    return rows.select(F.lit("slack").alias("kind"), name.alias("external_id"), "text", when.alias("source_ts"), _stage_of(F.col("channel"), stages).alias("stage"), acl.alias("acl"), F.col("user").alias("sender"), content_hash(F.col("text")).alias("content_hash"))


def ingest_live(sources: DataFrame, delay: str | None = None) -> DataFrame:
    """Each source of a stream once, however often its event is delivered, over restarts too.

    State has a key a source; with `delay`, how much later a delivery may be repeated,
    keys are forgotten after that, and what comes later still is dropped.
    """
    keys = ["kind", "external_id", "content_hash"]
    return sources.dropDuplicates(keys) if delay is None else sources.withWatermark("source_ts", delay).dropDuplicatesWithinWatermark(keys)
