"""Text to rows: action items, claims, sections, transcripts, threads, entity rules."""

from __future__ import annotations

import json
import re
from bisect import bisect
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from string import Formatter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.storage import materialise, released

# What marks an action item anywhere, in chats and in mail, and what marks a
# belief in chats.  An expression with two groups names the owner first.
ACTIONS = (
    r"(?i)(?:ACTION|TODO|FIXME)\s*:\s*(.+)",
    r"([A-Z][a-zA-Z]*(?:\s[A-Z][a-zA-Z]*)?)\s+(?:will|should|needs to|is going to|has to)\s+(.+)",
)
CHAT_ACTIONS = (r"(?i)I'?ll\s+(.+?)(?:\.|$)", r"(?i)@\w+\s+(?:please|pls)\s+(.+?)(?:\.|$)", r"(?i)can someone\s+(.+?)(?:\.|$)")
MAIL_ACTIONS = (r"(?i)(?:please|can you|could you)\s+(.+?)(?:\.|$)", r"(?i)(?:by|before|deadline[:\s])\s*(.+?)(?:\.|$)")
BELIEVED = (
    r"(?i)we decided (?:to\s+)?(.+?)(?:\.|$)", r"(?i)the decision is\s+(.+?)(?:\.|$)", r"(?i)deadline (?:is|:)\s*(.+?)(?:\.|$)", r"(?i)FYI[:\s]+(.+?)(?:\.|$)",
    r"(?i)let'?s go with\s+(.+?)(?:\.|$)", r"(?i)agreed[,:]\s*(.+?)(?:\.|$)", r"(?i)confirmed[,:]\s*(.+?)(?:\.|$)",
)


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row for each line, with its number from 0."""
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def first_match(line: Column, patterns: Sequence[str]) -> Column:
    """(owner, said) by the first expression that is found in a line; null if none is."""
    out = None
    for p in patterns:
        owned = re.compile(p).groups == 2
        owner = F.trim(F.regexp_extract(line, p, 1)) if owned else F.lit(None).cast("string")
        found = F.struct(owner.alias("owner"), F.trim(F.regexp_extract(line, p, 2 if owned else 1)).alias("said"))
        out = F.when(line.rlike(p), found) if out is None else out.when(line.rlike(p), found)
    return out


def action_items(df: DataFrame, text: str, key: str, extra: Sequence[str] = ()) -> DataFrame:
    """At most one action a line, by the first expression that fits: those of the medium (extra), then the general ones."""
    l = lines(df, text, key).withColumn("line", F.trim("line")).filter("line != ''")
    found = l.select(key, "line_no", first_match(F.col("line"), [*extra, *ACTIONS]).alias("m")).filter("m is not null")
    return found.select(key, "line_no", F.col("m.said").alias("action"), F.col("m.owner").alias("owner"))


def claims(df: DataFrame, text: str, key: str, least: int = 20, most: int = 20) -> DataFrame:
    """Sentences of a text that state something: long enough, no question, no quotation; the first ``most``."""
    s = F.transform(F.split(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), r"\."), lambda x: F.trim(x))
    good = F.filter(s, lambda x: (F.length(x) >= least) & ~F.endswith(x, F.lit("?")) & ~F.startswith(x, F.lit('"')))
    return df.select(key, F.posexplode(F.slice(good, 1, most)).alias("claim_no", "claim"))


def chat_beliefs(df: DataFrame, text: str, key: str, per_thread: int = 10, least: int = 10) -> DataFrame:
    """What is decided, agreed or announced: by line the first opening that fits, if enough is said; the first ``per_thread`` of a text."""
    l = lines(df, text, key).withColumn("line", F.trim("line")).filter("line != ''")
    found = l.select(key, "line_no", first_match(F.col("line"), BELIEVED)["said"].alias("claim")).filter(F.length("claim") >= least)
    w = Window.partitionBy(key).orderBy("line_no")
    return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_thread).drop("rn")


def markdown_sections(df: DataFrame, text: str, key: str) -> DataFrame:
    """Sections by headings of level 1 to 4; what stands before the first heading is section 0 of level 0."""
    l = lines(df, text, key)
    head = r"^(#{1,4})\s+(.+)$"
    l = l.withColumns({"level": F.length(F.regexp_extract("line", head, 1)), "title": F.trim(F.regexp_extract("line", head, 2))})
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("section", F.sum((F.col("level") > 0).cast("long")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    g = l.groupBy(key, "section").agg(F.max("level").alias("level"), F.max("title").alias("title"), F.trim(body).alias("body"))
    return g.filter("section > 0 or body != ''")


def is_markdown(text: Column) -> Column:
    """Whether at least two of five marks are found: headings, bold text, lists, links, fences.

    Headings, lists and fences are marks of a line, by what the line begins with; bold text and
    links are pairs of brackets within a line.
    """
    each = F.split(text, "\n")
    word = lambda x: F.substring_index(F.ltrim(x), " ", 1)
    listed = lambda x: word(x).isin("-", "*", "+") & F.ltrim(x).contains(" ")
    heading = lambda x: F.rtrim(F.substring_index(x, " ", 1)).rlike("^#{1,6}$") & x.contains(" ")
    bold = lambda x: F.length(F.element_at(F.split(x, r"\*\*", 3), 2)) > 0
    marks = [
        F.exists(each, heading), F.exists(each, lambda x: (F.size(F.split(x, r"\*\*", 3)) == 3) & bold(x)), F.exists(each, listed),
        F.exists(each, lambda x: x.rlike(r"\[[^\]]+\]\([^)]+\)")), F.exists(each, lambda x: F.startswith(x, F.lit("```"))),
    ]
    return sum((F.coalesce(m, F.lit(False)).cast("int") for m in marks), F.lit(0)) >= 2


def plain_sections(df: DataFrame, text: str, key: str) -> DataFrame:
    """Sections of plain text: a heading is a line of capitals (three or more) or one underlined by = or -."""
    l = lines(df, text, key).withColumn("after", F.lead("line").over(Window.partitionBy(key).orderBy("line_no")))
    ruled = r"^\s*(?:={3,}|-{3,})\s*$"
    head = (F.trim("line") != "") & ~F.col("line").rlike(ruled) & (F.coalesce(F.col("after").rlike(ruled), F.lit(False)) | (F.col("line").rlike(r"[A-Z].*[A-Z].*[A-Z]") & (F.upper("line") == F.col("line"))))
    l = l.withColumn("head", head).filter(~F.col("line").rlike(ruled) & (F.trim("line") != ""))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("section", F.sum(F.col("head").cast("long")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda x: F.trim(x["line"])), "\n")
    return l.groupBy(key, "section").agg(F.max(F.when(F.col("head"), F.trim("line"))).alias("title"), body.alias("body"))


def without_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def _spoken(line: Column) -> Column:
    """A transcript's line in its parts: stamp (or null), speaker (or null), said."""
    first = F.substring_index(line, " ", 1)
    stamp = F.btrim(first, F.lit("[]"))
    rest = F.ltrim(F.substring(line, F.length(first) + 1, F.length(line)))
    timed = stamp.rlike("^[0-9]{1,2}(:[0-9]{2}){1,2}$") & rest.contains(":")
    whole = F.when(timed, rest).otherwise(line)
    speaker = F.trim(F.substring_index(whole, ":", 1))
    said = F.substring(whole, F.length(F.substring_index(whole, ":", 1)) + 2, F.length(whole))
    names = F.split(speaker, " ")
    named = (F.size(names) <= 3) & F.forall(names, lambda n: n.rlike("^[A-Z][A-Za-z]*$")) & F.startswith(said, F.lit(" "))
    good = whole.contains(":") & (F.trim(said) != "") & (speaker != "")
    kind = F.when(timed & good, "timed").when(named & good, "spoken")
    return F.struct(kind.alias("kind"), F.when(timed, stamp).alias("stamp"), speaker.alias("speaker"), F.trim(said).alias("said"))


def transcript(df: DataFrame, text: str, key: str, look: int = 20) -> DataFrame:
    """Turns of a transcript: time, speaker, text.

    The first line that fits, of the first ``look``, says what the text is: timed and spoken
    turns, spoken turns, or plain lines.  In the first two a line that doesn't fit goes on with
    the turn before.
    """
    from lorebase.functions.temporal import clock_minutes

    l = lines(df, text, key).withColumn("line", F.btrim("line", F.lit(" \t\r"))).filter("line != ''").withColumn("p", _spoken(F.col("line")))
    whole = Window.partitionBy(key)
    sign = F.min(F.when((F.col("line_no") < look) & F.col("p.kind").isNotNull(), F.struct("line_no", "p.kind"))).over(whole)["kind"]
    l = l.withColumn("sign", F.coalesce(sign, F.lit("plain")))
    new = F.coalesce(F.col("p.kind") == F.col("sign"), F.lit(False)) | (F.col("sign") == "plain")
    l = l.select(
        key, "line_no", "sign", new.alias("new"), F.when(new & (F.col("sign") == "timed"), F.col("p.stamp")).alias("stamp"),
        F.when(new & (F.col("sign") != "plain"), F.col("p.speaker")).alias("speaker"), F.when(new & (F.col("sign") != "plain"), F.col("p.said")).otherwise(F.col("line")).alias("said"),
    )
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("turn", F.sum(F.col("new").cast("long")).over(w))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda x: x["said"]), " ")
    g = l.groupBy(key, "turn").agg(F.max("sign").alias("sign"), F.max("stamp").alias("stamp"), F.max("speaker").alias("speaker"), said.alias("said"))
    return g.select(key, "turn", "sign", clock_minutes(F.col("stamp")).alias("minute"), "stamp", "speaker", "said")


def segments(turns: DataFrame, key: str, block_minutes: float = 5, least: int = 50) -> DataFrame:
    """Turns of :func:`transcript` in segments: text, distinct speakers, first and last stamp.

    Timed turns go by blocks anchored on a block's first turn, spoken ones by runs of one speaker
    (runs of fewer than ``least`` characters join the run before), plain lines are one segment.
    """
    said = F.when(F.col("speaker").isNotNull(), F.concat("speaker", F.lit(": "), "said")).otherwise(F.col("said"))
    t = turns.withColumn("text", said)
    # A turn without a stamp has the time of the turn before.
    w = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    timed = t.filter("sign = 'timed'").withColumn("at", F.coalesce(F.last("minute", ignorenulls=True).over(w), F.lit(0.0)))
    timed = timed.join(anchored(timed, key, "at", "turn", block_minutes, inclusive=True, order="turn"), [key, "turn"]).drop("at")
    runs = speaker_blocks(t.filter("sign = 'spoken'"), key, "turn", "speaker")
    length = Window.partitionBy(key, "block")
    size = F.sum(F.length("text") + 1).over(length) - 1
    runs = runs.withColumn("_n", size).withColumn("_start", (F.col("_n") >= least) | (F.col("block") == 1))
    first = F.col("_start") & (F.coalesce(F.lag("block").over(Window.partitionBy(key).orderBy("turn")), F.lit(0)) != F.col("block"))
    runs = runs.withColumn("_new", first.cast("long")).withColumn("block", F.sum("_new").over(w)).drop("_n", "_start", "_new")
    plain = t.filter("sign = 'plain'").withColumn("block", F.lit(0).cast("long"))
    every = timed.unionByName(runs).unionByName(plain)
    order = F.array_sort(F.collect_list(F.struct("turn", "text")))
    stamps = F.array_sort(F.collect_list(F.when(F.col("stamp").isNotNull(), F.struct("turn", "stamp"))))
    g = every.groupBy(key, "block").agg(F.max("sign").alias("sign"), order.alias("o"), F.array_sort(F.collect_set("speaker")).alias("speakers"), stamps.alias("s"))
    joined = F.when(F.col("sign") == "plain", F.array_join(F.transform("o", lambda x: x["text"]), " ")).otherwise(F.array_join(F.transform("o", lambda x: x["text"]), "\n"))
    return g.select(key, "block", joined.alias("text"), "speakers", F.try_element_at("s", F.lit(1))["stamp"].alias("first"), F.try_element_at("s", F.lit(-1))["stamp"].alias("last"))


def anchored(df: DataFrame, by: str, at: str, key: str, span: float, inclusive: bool = False, order: str | None = None) -> DataFrame:
    """(by, key, block): a block begins with the first row that lies more than span (inclusive: span or more) after the block's own first row.

    Such blocks depend on all before them, so rows stream by in order of (by, at), and what is
    kept of them is one block's number and time.  order: the rows' order, if not by ``at``.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block, first = None, 0, 0.0
        for batch in batches:
            out = []
            for g, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not out and group is None or g != group:
                    group, block, first = g, 0, t
                elif t - first > span or inclusive and t - first == span:
                    block, first = block + 1, t
                out.append(block)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=[by, key, "block"])

    kinds = dict(df.dtypes)
    rows = df.select(by, key, F.col(at).cast("double").alias("_at"), *([F.col(order).alias("_order")] if order else []))
    rows = rows.repartition(by).sortWithinPartitions(by, "_order" if order else "_at", key)
    return rows.mapInArrow(fold, f"{by} {kinds[by]}, {key} {kinds[key]}, block bigint")


def speaker_blocks(turns: DataFrame, key: str, at: str, speaker: str) -> DataFrame:
    """A block for each run of one speaker."""
    w = Window.partitionBy(key).orderBy(at)
    change = F.coalesce(F.lag(speaker).over(w) != F.col(speaker), F.lit(True)).cast("long")
    return turns.withColumn("_c", change).withColumn("block", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def threads(messages: DataFrame, thread: str, at: str, author: str, text: str, least: int = 2, most: int = 500) -> DataFrame:
    """Threads of a bounded size: their text in order, messages, participants.

    Messages are counted first, so that the text of none but these is put together.
    """
    sizes = messages.groupBy(thread).agg(F.count(F.lit(1)).alias("messages")).filter((F.col("messages") >= least) & (F.col("messages") <= most))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, F.concat(F.col(author), F.lit(": "), F.col(text)).alias("s")))), lambda x: x["s"]), "\n")
    fit = messages.join(sizes.select(thread), thread, "left_semi")
    return fit.groupBy(thread).agg(said.alias("thread_text"), F.count(F.lit(1)).alias("messages"), F.count_distinct(author).alias("participants"))


def reply_roots(messages: DataFrame, key: str, parent: str) -> DataFrame:
    """(id, root) of each message's chain of replies, however long; a reply to an unknown message is a root, a ring of replies has none.

    By pointer doubling: after n rounds a message knows its ancestor 2 ** n replies up.  Rounds
    end when every pointer stands still, or when none can come to an end any more (a ring).  A
    message that answers itself is a root.
    """
    pairs = messages.select(F.col(key).alias("id"), F.col(parent).alias("to"))
    ids = pairs.select(F.col("id").alias("_there")).distinct()
    known = pairs.join(ids, F.col("to") == F.col("_there"), "left")
    at = materialise(known.select("id", F.coalesce(F.when(F.col("_there") != F.col("id"), F.col("_there")), "id").alias("root"), F.coalesce(F.col("_there") == F.col("id"), F.lit(True)).alias("done")), "replies")
    n, hops = at.count(), 1
    while hops <= n and not at.filter("not done").isEmpty():
        above = at.select(F.col("id").alias("a"), F.col("root").alias("up"), F.col("done").alias("end"))
        going = at.filter("not done").join(above, F.col("root") == F.col("a")).select("id", F.col("up").alias("root"), F.col("end").alias("done"))
        before, at = at, materialise(at.filter("done").unionByName(going), "replies")
        released(before)
        hops *= 2
    return at.filter("done").select("id", "root")


def orphaned(messages: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Messages that belong to no root: they answer one another in a ring."""
    return messages.join(roots.select(F.col("id").alias(key)), key, "left_anti")


def chat_edges(messages: DataFrame, actions: DataFrame, conversation: str, author: str, channel: str) -> DataFrame:
    """(src, dst, edge_type) of conversations: who took part, who talked with whom, who is in which channel, what is to be done (80 characters)."""
    who = messages.select(conversation, F.col(author).alias("who"), channel).distinct()
    took = who.select(F.col("who").alias("src"), F.col(conversation).cast("string").alias("dst"), F.lit("participated_in").alias("edge_type"))
    talked = participant_pairs(who, conversation, "who").select(F.col("p1").alias("src"), F.col("p2").alias("dst"), F.lit("communicates_with").alias("edge_type"))
    member = who.select(F.col("who").alias("src"), F.col(channel).alias("dst"), F.lit("member_of").alias("edge_type"))
    todo = actions.filter("action != ''").select(F.col(conversation).cast("string").alias("src"), F.substring("action", 1, 80).alias("dst"), F.lit("has_action").alias("edge_type"))
    return took.unionByName(talked).unionByName(member).unionByName(todo).distinct()


def participant_pairs(messages: DataFrame, conversation: str, author: str) -> DataFrame:
    """Who talked with whom (p1 < p2), and in how many conversations."""
    from lorebase.operators.graph import cooccurrences

    return cooccurrences(messages, conversation, author).withColumnsRenamed({"a": "p1", "b": "p2", "weight": "conversations"})


# -- entities ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Detector:
    """Finds candidates by an expression; earlier detectors win where spans overlap."""

    id: str
    pattern: str
    description: str = ""


@dataclass(frozen=True)
class Extractor:
    """Turns a candidate into an entity, by a template of match, groups, case and type."""

    id: str
    entity_type: str
    pattern: str
    template: str = "{match}"
    confidence: float = 0.8
    description: str = ""


def compiled(template: str, kind: str) -> Callable[[re.Match], str]:
    """A template as a function of a match, taken apart once.

    Fields: match, match_lower, match_upper, entity_type, and group1, group2 and so on; with two
    groups or more the first is the whole name and group1 is the second.  Others stay as written.
    """
    own: list[Callable[[re.Match], str]] = []
    for text, field, _, _ in Formatter().parse(template):
        own.append(lambda _, t=text: t)
        if field is None:
            continue
        if field.startswith("group") and field[5:].isdigit():
            own.append(lambda m, i=int(field[5:]), f=field: (m[i + (len(m.groups()) > 1)] or "") if 0 < i <= len(m.groups()) - (len(m.groups()) > 1) else f"{{{f}}}")
        else:
            known = {"match": lambda m: m[0], "match_lower": lambda m: m[0].lower(), "match_upper": lambda m: m[0].upper(), "entity_type": lambda _: kind}
            own.append(known.get(field, lambda _, f=field: f"{{{f}}}"))
    return lambda m: "".join([part(m) for part in own])


def detected(df: DataFrame, key: str, text: str, detectors: list[Detector], around: int = 50) -> DataFrame:
    """Candidates of a text with their places and surroundings; no two overlap, earlier detectors first."""
    for d in detectors:
        re.compile(d.pattern)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = [(d.id, re.compile(d.pattern)) for d in detectors]
        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[text], strict=True):
                starts: list[int] = []
                taken: list[tuple[int, int, str, str]] = []  # in order of place, as none overlap
                for name, p in rules:
                    for m in p.finditer(t or ""):
                        i = bisect(starts, m.start())
                        clear = (not i or taken[i - 1][1] <= m.start()) and (i == len(taken) or m.end() <= taken[i][0])
                        if m.end() > m.start() and clear:
                            starts.insert(i, m.start())
                            taken.insert(i, (m.start(), m.end(), m[0], name))
                out += [(k, a, b, s, n, t[max(0, a - around) : b + around]) for a, b, s, n in taken]
            yield pd.DataFrame(out, columns=[key, "start", "stop", "match", "detector", "context"])

    return df.select(key, text).mapInPandas(work, f"{key} {dict(df.dtypes)[key]}, start int, stop int, match string, detector string, context string")


def extracted(candidates: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """Candidates as entities: every extractor that finds something in the match."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = [(e, re.compile(e.pattern), compiled(e.template, e.entity_type)) for e in extractors]
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                rows += [r | {"entity": name(m), "entity_type": e.entity_type, "extractor": e.id, "confidence": e.confidence} for e, p, name in rules if (m := p.search(r["match"]))]
            yield pd.DataFrame(rows, columns=[*frame.columns, "entity", "entity_type", "extractor", "confidence"])

    kept = ", ".join(f"{c} {t}" for c, t in candidates.dtypes)
    return candidates.mapInPandas(work, f"{kept}, entity string, entity_type string, extractor string, confidence double")


def normal(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def resolved(entities: DataFrame, aliases: DataFrame, *place: str) -> DataFrame:
    """One entity for each place, the most sure (the first extractor on a tie), under its canonical name if it has one."""
    w = Window.partitionBy(*place).orderBy(F.col("confidence").desc(), "extractor")
    best = entities.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    a = aliases.select(normal(F.col("alias")).alias("_a"), "canonical").dropDuplicates(["_a"])
    return best.join(a, normal(F.col("entity")) == F.col("_a"), "left").drop("_a").withColumn("canonical", F.coalesce("canonical", "entity"))


def unresolved(candidates: DataFrame, entities: DataFrame, *place: str) -> DataFrame:
    """Candidates that no extractor made anything of: what rules are still to be learned from."""
    return candidates.join(entities.select(*place).distinct(), list(place), "left_anti")


def resolved_name(names: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """Names that are known aliases (alias, canonical, entity_type), with what they stand for, at full confidence."""
    a = aliases.select(normal(F.col("alias")).alias("_a"), "canonical", "entity_type").dropDuplicates(["_a"])
    found = names.join(a, normal(F.col(name)) == F.col("_a"))
    return found.select(*names.columns, "canonical", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), F.lit(1.0).alias("confidence"))


def usable_rules(rules: list[Detector | Extractor]) -> list[Detector | Extractor]:
    """Those of proposed rules (from a language model, say) whose expression compiles, the last of each id."""
    kept = {}
    for r in rules:
        try:
            re.compile(r.pattern)
        except re.error:
            continue
        kept[r.id] = r
    return list(kept.values())


#: Long form, then its short form in brackets (a fixed value). Possessive: no stack on long runs of words.
ALIAS = r"([\p{L}\p{N}_]++(?:\s++[\p{L}\p{N}_]++)*+)\s*+\(([^)]++)\)"


def aliases_in(df: DataFrame, text: str) -> DataFrame:
    """(alias, canonical) from ``Long Form (LF)``: the shorter string is the alias."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(ALIAS), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(ALIAS), F.lit(2)).alias("b"))
    p = df.select(F.explode(pairs).alias("p")).select(F.trim("p.a").alias("a"), F.trim("p.b").alias("b"))
    short = F.length("b") < F.length("a")
    return p.select(F.when(short, F.col("b")).otherwise(F.col("a")).alias("alias"), F.when(short, F.col("a")).otherwise(F.col("b")).alias("canonical")).distinct()


# -- answers of language models ---------------------------------------------------------------


def mended(raw: str | None) -> str | None:
    """The first JSON object or array of a text, closed where it was cut off; null if there is none.

    One pass keeps the open brackets and the last place where a value was complete; if the text
    ends before the first bracket is closed, it is cut there and the brackets still open then are
    closed.
    """
    begin = min((i for i in ((raw or "").find(c) for c in "[{") if i >= 0), default=-1)
    if begin < 0:
        return None
    closing, open_, safe, string, escaped, i = {"{": "}", "[": "]"}, [], None, False, False, begin
    while i < len(raw):
        c = raw[i]
        if string:
            string, escaped = escaped or c != '"', c == "\\" and not escaped
            if not string and open_[-1] == "[":
                safe = i + 1, "".join(open_)
        elif c == '"':
            string = True
        elif c in closing:
            open_.append(c)
            safe = safe or (i + 1, "".join(open_))
        elif c in "]}":
            if not open_ or closing[open_.pop()] != c:
                return None
            safe = i + 1, "".join(open_)
            if not open_:
                break
        elif c == ",":
            safe = i, "".join(open_)
        i += 1
    end, left = safe
    out = raw[begin:end].rstrip().rstrip(",") + "".join(closing[c] for c in reversed(left))
    try:
        json.loads(out)
    except ValueError:
        return None
    return out


def lenient_json(text: Column) -> Column:
    """:func:`mended` of a column: JSON as a string, for ``from_json``."""

    @F.pandas_udf("string")
    def mend(texts: pd.Series) -> pd.Series:
        return texts.map(mended)

    return mend(text)


def reading_chunks(items: DataFrame, group: str, key: str, text: str, least: int = 50, alike: int = 200, per_chunk: int = 8, most: int = 24_000) -> DataFrame:
    """What a language model is given to read: texts by group, without short ones and those that begin alike, ``per_chunk`` at a time.

    (group, chunk, texts, chars): chars is the chunk's length, at most ``most``.
    """
    t = items.select(group, key, F.btrim(text, F.lit(" \t\r\n")).alias("t")).filter(F.length("t") >= least)
    first = Window.partitionBy(group, F.substring("t", 1, alike)).orderBy(key)
    t = t.withColumn("n", F.row_number().over(first)).filter("n = 1")
    t = t.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1) / per_chunk))
    g = t.groupBy(group, "chunk").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("t") + 7).alias("c"))
    return g.select(group, "chunk", "texts", F.least(F.col("c") - 7, F.lit(most)).alias("chars"))


def source_of(label: Column, labels: Column, default: Column) -> Column:
    """Which of a group's source labels an extraction means: the same, else the first that contains it or is contained, else the default."""
    low = F.lower(label)
    near = F.filter(labels, lambda x: F.contains(F.lower(x), low) | F.contains(low, F.lower(x)))
    return F.when(F.array_contains(labels, label), label).when(F.length(label) > 0, F.coalesce(F.try_element_at(near, F.lit(1)), default)).otherwise(default)


def snapshot_summary(context: Column, keys: Column, latest: Column, most: int = 500) -> Column:
    """A summary by rule: the task, up to ten keys of working memory, the latest experience."""
    working = F.when(F.size(keys) > 0, F.concat(F.lit("Working on: "), F.array_join(F.slice(keys, 1, 10), ", "), F.lit(".")))
    last = F.when(latest.isNotNull(), F.concat(F.lit("Latest: "), F.substring(latest, 1, 200)))
    return F.substring(F.concat_ws(" ", F.concat(F.lit("Context: "), context, F.lit(".")), working, last), 1, most)


#: What says that something is still to be done (a fixed value).
NEXT = r"(?i)(?:TODO|NEXT|FIXME|should|need to|will)\s*:?\s*(.+)"


def next_steps(text: Column, most: int = 5) -> Column:
    """What remains to be done, a line at most once, 200 characters each, the first few."""
    found = F.filter(F.split(text, "\n"), lambda x: x.rlike(NEXT))
    return F.slice(F.transform(found, lambda x: F.substring(F.trim(F.regexp_extract(x, NEXT, 1)), 1, 200)), 1, most)


def open_questions(text: Column, most: int = 5) -> Column:
    """Sentences that end with a question mark, the first few."""
    return F.slice(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]*[^.!?\s][^.!?]*\?"), F.lit(0)), lambda x: F.btrim(x, F.lit(" \t\r\n"))), 1, most)


def shortened(text: Column, most: int = 50) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
