"""Chat exports as messages: one schema for three formats.

Messages: message_id, thread_hint, reply_to, author, text, ts (seconds), is_bot, mentions,
reactions (number), attachments, importance.  Input is one export as text in a column; bad JSON
gives no messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.operators.text import anchored, orphaned, reply_roots, threads

_SLACK = "user string, username string, text string, ts string, thread_ts string, subtype string, bot_id string, reactions array<struct<name: string, count: int>>, files array<struct<name: string>>"
_DISCORD = "id string, content string, timestamp string, author struct<id: string, name: string, isBot: boolean>, reference struct<messageId: string>, reactions array<struct<emoji: struct<name: string>, count: int>>, mentions array<struct<name: string>>"
_TEAMS = "id string, body struct<contentType: string, content: string>, `from` struct<user: struct<displayName: string, id: string>, application: struct<id: string>>, createdDateTime string, replyToId string, mentions array<struct<mentioned: struct<user: struct<displayName: string>>>>, importance string, messageType string"
_DISCORD = _DISCORD.replace("mentions array<struct<name: string>>", "mentions array<struct<name: string, username: string>>, attachments array<struct<fileName: string, url: string>>")
#: Messages that only report what happened to a channel (fixed values).
SKIPPED = ("channel_join", "channel_leave", "channel_topic")


def _messages(df: DataFrame, export: str, schema: str, under: str, *keep: str) -> DataFrame:
    """A JSON array of messages, or an object that holds one."""
    plain = F.from_json(export, f"array<struct<{schema}>>")
    held = F.from_json(export, f"struct<{under}: array<struct<{schema}>>>")[under]
    starts_array = F.ltrim(export).startswith("[")
    return df.select(*keep, F.explode(F.when(starts_array, plain).otherwise(held)).alias("m"))


def seconds(iso: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(iso)) / 1e6


def _sum(reactions: Column) -> Column:
    return F.aggregate(F.coalesce(reactions, F.array()), F.lit(0), lambda s, r: s + F.coalesce(r["count"], F.lit(0)))


def _names(items: Column) -> Column:
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull())


def slack(df: DataFrame, export: str, *keep: str, users: dict[str, str] | None = None) -> DataFrame:
    """users: what user ids are called."""
    m = _messages(df, export, _SLACK, "messages", *keep).filter(~F.coalesce(F.col("m.subtype"), F.lit("")).isin(*SKIPPED))
    author = F.coalesce("m.username", "m.user", F.lit(""))
    if users:
        author = F.coalesce(F.create_map(*[F.lit(x) for pair in users.items() for x in pair])[F.col("m.user")], author)
    text = F.coalesce("m.text", F.lit(""))
    return m.select(
        *keep, F.coalesce("m.ts", F.lit("")).alias("message_id"), F.nullif("m.thread_ts", F.lit("")).alias("thread_hint"), F.when(F.col("m.thread_ts") != F.coalesce("m.ts", F.lit("")), F.col("m.thread_ts")).alias("reply_to"),
        author.alias("author"), text.alias("text"), F.coalesce(F.col("m.ts").try_cast("double"), F.lit(0.0)).alias("ts"),
        (F.coalesce(F.col("m.bot_id") != "", F.lit(False)) | (F.coalesce("m.subtype", F.lit("")) == "bot_message")).alias("is_bot"), F.regexp_extract_all(text, F.lit(r"<@(\w+)>"), F.lit(1)).alias("mentions"),
        _sum(F.col("m.reactions")).alias("reactions"), _names(F.col("m.files.name")).alias("attachments"), F.lit("normal").alias("importance"),
    )


def discord(df: DataFrame, export: str, *keep: str) -> DataFrame:
    m = _messages(df, export, _DISCORD, "messages", *keep)
    called = F.transform(F.coalesce("m.mentions", F.array()), lambda x: F.coalesce(x["name"], x["username"]))
    files = F.transform(F.coalesce("m.attachments", F.array()), lambda x: F.coalesce(x["fileName"], x["url"]))
    return m.select(
        *keep, F.col("m.id").alias("message_id"), F.lit(None).cast("string").alias("thread_hint"), F.col("m.reference.messageId").alias("reply_to"),
        F.coalesce("m.author.name", F.lit("")).alias("author"), F.coalesce("m.content", F.lit("")).alias("text"), F.coalesce(seconds(F.col("m.timestamp")), F.lit(0.0)).alias("ts"),
        F.coalesce("m.author.isBot", F.lit(False)).alias("is_bot"), _names(called).alias("mentions"), _sum(F.col("m.reactions")).alias("reactions"), _names(files).alias("attachments"), F.lit("normal").alias("importance"),
    )


def teams(df: DataFrame, export: str, *keep: str) -> DataFrame:
    m = _messages(df, export, _TEAMS, "value", *keep)
    content = F.coalesce("m.body.content", F.lit(""))
    plain = F.trim(F.regexp_replace(F.regexp_replace(content, "<[^>]+>", ""), r"\s+", " "))
    return m.select(
        *keep, F.col("m.id").alias("message_id"), F.lit(None).cast("string").alias("thread_hint"), F.col("m.replyToId").alias("reply_to"),
        F.coalesce("m.from.user.displayName", F.lit("")).alias("author"), F.when(F.col("m.body.contentType") == "html", plain).otherwise(content).alias("text"),
        F.coalesce(seconds(F.col("m.createdDateTime")), F.lit(0.0)).alias("ts"), F.col("m.from.application").isNotNull().alias("is_bot"), _names(F.col("m.mentions.mentioned.user.displayName")).alias("mentions"),
        F.lit(0).alias("reactions"), F.array().cast("array<string>").alias("attachments"), F.coalesce("m.importance", F.lit("normal")).alias("importance"),
    )


def threaded(messages: DataFrame, channel: str, window: float = 300) -> DataFrame:
    """Messages with their thread as the export names it; those without one go by blocks of ``window`` seconds, anchored on a block's first message."""
    own = messages.filter("thread_hint is not null").withColumn("thread", F.concat_ws("|", channel, "thread_hint"))
    alone = messages.filter("thread_hint is null")
    blocks = anchored(alone, channel, "ts", "message_id", window)
    return own.unionByName(alone.join(blocks, [channel, "message_id"]).withColumn("thread", F.concat_ws("#", channel, F.col("block").cast("string"))).select(*own.columns))


def replied(messages: DataFrame, channel: str) -> DataFrame:
    """Messages with their thread: the message at the root of their replies; those that only answer one another are one thread, the orphans'."""
    keyed = messages.withColumn("_key", F.concat_ws("|", channel, "message_id")).withColumn("_parent", F.when(F.col("reply_to").isNotNull(), F.concat_ws("|", channel, "reply_to")))
    roots = reply_roots(keyed, "_key", "_parent")
    rooted = keyed.join(roots, keyed["_key"] == roots["id"]).withColumn("thread", F.col("root")).select(*messages.columns, "thread")
    return rooted.unionByName(orphaned(keyed, roots, "_key").withColumn("thread", F.concat_ws("#", channel, F.lit("orphans"))).select(*rooted.columns))


def ingested(messages: DataFrame, least: int = 2, most: int = 500) -> DataFrame:
    """Threads without bots and of a bounded size, as experiences."""
    return threads(messages.filter(~F.col("is_bot")), "thread", "ts", "author", "text", least, most)
