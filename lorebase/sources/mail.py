"""E-mail and news as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line that begins a quoted answer (one line: prose that begins with "On" isn't one), and the one that begins a forwarded message.
ANSWERED = r"(?m)^On[ \t]+([^\n]+?),?[ \t]+([^\n]+?)[ \t]+wrote:[ \t]*$"
FORWARDED = r"(?im)^-{5,}\s*Forwarded message\s*-{5,}[ \t]*$"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n"))


def unfolded(raw: Column) -> Column:
    """Line ends as \\n, continued header lines joined to the line before."""
    clean = F.regexp_replace(raw, "\r\n?", "\n")
    head, body = F.split(clean, "\n\n", 2)[0], F.try_element_at(F.split(clean, "\n\n", 2), F.lit(2))
    return F.struct(F.regexp_replace(head, r"\n[ \t]+", " ").alias("head"), F.coalesce(body, F.lit("")).alias("body"))


def header(head: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*)$", 1)), F.lit(""))


_PARSED = "from_addr string, `from` string, to_addrs string, `to` string, cc_addrs string, cc string, subject string, body string, date string, message_id string, in_reply_to string, thread_id string"


def addresses(list_: Column) -> Column:
    """Addresses of a comma-separated list, or of a JSON array."""
    items = F.coalesce(F.from_json(list_, "array<string>"), F.split(F.coalesce(list_, F.lit("")), ","))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def emails(df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """Sender, recipients, copies, subject, date, ids and body of mail: a raw message, or a JSON object or array of parsed ones."""
    text = F.ltrim(F.col(raw))
    is_json = F.startswith(text, F.lit("{")) | F.startswith(text, F.lit("["))
    parsed = df.filter(is_json).select(*keep, F.explode(F.coalesce(F.from_json(raw, f"array<struct<{_PARSED}>>"), F.array(F.from_json(raw, f"struct<{_PARSED}>")))).alias("j"))
    parsed = parsed.select(
        *keep, F.coalesce("j.from_addr", "j.from", F.lit("")).alias("sender"), addresses(F.coalesce("j.to_addrs", "j.to")).alias("recipients"), addresses(F.coalesce("j.cc_addrs", "j.cc")).alias("copies"),
        F.coalesce("j.subject", F.lit("")).alias("subject"), F.col("j.date").alias("date"), F.coalesce("j.message_id", F.lit("")).alias("message_id"), F.col("j.in_reply_to").alias("reply_to"), F.coalesce("j.body", F.lit("")).alias("body"),
    )
    m = df.filter(~is_json).select(*keep, unfolded(F.col(raw)).alias("m"))
    body = stripped(F.col("m.body"))
    html = F.lower(body).rlike("<html|<body|<div")
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]+>", ""), r"\s+", " "))
    head = lambda name: F.coalesce(header(F.col("m.head"), name), F.lit(""))
    own = m.select(
        *keep, head("From").alias("sender"), addresses(head("To")).alias("recipients"), addresses(head("Cc")).alias("copies"), head("Subject").alias("subject"), header(F.col("m.head"), "Date").alias("date"),
        head("Message-ID").alias("message_id"), header(F.col("m.head"), "In-Reply-To").alias("reply_to"), F.when(html, plain).otherwise(body).alias("body"),
    )
    return own.unionByName(parsed)


def unquoted(text: Column) -> Column:
    return stripped(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.ltrim(x), r"^(?:>\s*)+", "")), "\n"))


def thread_parts(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """The messages of a mail thread, newest first: author, date and text, answers without their quoting marks.

    A body is parted at the lines that begin an answer, or, if it has none, at those that begin a
    forwarded message.  Empty parts are left out; a body without others is its own part.
    """
    part = lambda text, author, date: F.struct(author.alias("author"), date.alias("date"), text.alias("text"))
    none, text = F.lit(None).cast("string"), F.col(body)
    names, dates = (F.regexp_extract_all(text, F.lit(ANSWERED), F.lit(g)) for g in (2, 1))
    answers = F.transform(F.split(text, ANSWERED, -1), lambda x, i: F.when(i == 0, part(stripped(x), F.lit(""), none)).otherwise(part(unquoted(x), F.trim(F.get(names, i - 1)), F.trim(F.get(dates, i - 1)))))
    forwards = F.transform(F.split(text, FORWARDED, -1), lambda x: part(stripped(x), F.lit(""), none))
    parts = F.filter(F.when(text.rlike(ANSWERED), answers).when(text.rlike(FORWARDED), forwards).otherwise(F.array(part(text, F.lit(""), none))), lambda x: x["text"] != "")
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(part(text, F.lit(""), none)))
    return df.select(*keep, F.posexplode(parts).alias("part", "p")).select(*keep, "part", "p.author", "p.date", "p.text")


def articles(df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """News articles from JSON, or plain text whose first line is the title."""
    j = F.from_json(raw, "title string, body string, source_name string, source_url string, date string, author string")
    is_json = F.ltrim(raw).startswith("{")
    lines = F.split(F.col(raw), "\n", 2)
    return df.select(
        *keep, F.when(is_json, j["title"]).otherwise(F.trim(lines[0])).alias("title"), F.when(is_json, j["body"]).otherwise(F.trim(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")))).alias("body"),
        j["source_name"].alias("source_name"), j["date"].alias("date"), j["author"].alias("author"),
    )


def claim_confidence(credibility: Column, confidence: float = 0.6) -> Column:
    return F.least(F.lit(1.0), credibility * confidence)
