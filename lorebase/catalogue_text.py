"""Named queries over texts: chat exports, mail, transcripts, notes, entities, answers of language models.

The raw tables hold prose.  Exports, mails and notes are put together from their rows, one for
each row or conversation of a whole table, and taken apart by the parsers; the SQL says what the
parsers should find without going through the format.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.catalogue import query
from lorebase.operators import reflection as R
from lorebase.operators import retrieval as S
from lorebase.operators import text as T
from lorebase.plans import views as V
from lorebase.plans.views import with_views
from lorebase.sources import chat, mail

# -- notes: a turn of a conversation, with an opening that says what it is ----------------------

OPENINGS = ["ACTION: ", "Maria Lopez will ", "I''ll ", "@bob please ", "we decided to ", "FYI: ", "Can you ", ""]
NOTE = "case (conv_id + turn) % 8 " + " ".join(f"when {i} then '{o}'" for i, o in enumerate(OPENINGS)) + " end || text"
#: Notes, their lines, and what the expressions of a medium find in them.
NOTES = f"notes as (select conv_id * 1000 + turn id, {NOTE} body from conversations)"
LINES = f"{NOTES}, l0 as (select id, string_split(body, chr(10)) a from notes), l as (select id, cast(line_no as int) line_no, trim(line) line from (select id, generate_subscripts(a, 1) - 1 line_no, unnest(a) line from l0) where trim(line) <> '')"


def _notes(spark, d):
    c = V.table(spark, d, "conversations")
    openings = F.array(*[F.lit(o.replace("''", "'")) for o in OPENINGS])
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.get(openings, ((F.col("conv_id") + F.col("turn")) % 8).cast("int")), "text").alias("body"))


def _found(patterns) -> str:
    """SQL of the first expression that a line matches, as owner and said."""
    def quoted(p):
        return p.replace("'", "''")

    said = " ".join(f"when regexp_matches(line, '{quoted(p)}') then trim(regexp_extract(line, '{quoted(p)}', {T.re.compile(p).groups}))" for p in patterns)
    owner = " ".join(f"when regexp_matches(line, '{quoted(p)}') then {f"trim(regexp_extract(line, '{quoted(p)}', 1))" if T.re.compile(p).groups == 2 else 'null'}" for p in patterns)
    return f"case {said} end said, case {owner} end owner_"


def _actions(name, extra):
    @query(f"{name}_actions", f"with {LINES}, f as (select id, line_no, {_found([*extra, *T.ACTIONS])} from l) select id, line_no, said action, owner_ as owner from f where said is not null")
    def run(spark, d):
        return T.action_items(_notes(spark, d), "body", "id", extra)


_actions("note", ())
_actions("chat", T.CHAT_ACTIONS)
_actions("mail", T.MAIL_ACTIONS)


@query("chat_beliefs", f"with {LINES}, f as (select id, line_no, {_found(T.BELIEVED)} from l), r as (select *, row_number() over (partition by id order by line_no) rn from f where length(said) >= 10) select id, line_no, said claim from r where rn <= 10")
def chat_beliefs(spark, d):
    return T.chat_beliefs(_notes(spark, d), "body", "id")


#: Documents with headings: a conversation's turn between two of them.
PAGES = "pages_ as (select conv_id * 1000 + turn id, 'before' || chr(10) || '# On ' || role || chr(10) || text || chr(10) || '## Next' || chr(10) || '- **one** [a](b)' body from conversations)"


def _pages(spark, d):
    c = V.table(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat_ws("\n", F.lit("before"), F.concat(F.lit("# On "), "role"), "text", F.lit("## Next"), F.lit("- **one** [a](b)")).alias("body"))


@query("markdown_sections", "with s as (select conv_id * 1000 + turn id, role, text from conversations) select id, cast(0 as bigint) section, 0 as level, '' title, 'before' body from s union all select id, 1, 1, 'On ' || role, trim(text) from s union all select id, 2, 2, 'Next', '- **one** [a](b)' from s")
def markdown_sections(spark, d):
    return T.markdown_sections(_pages(spark, d), "body", "id").withColumn("title", F.coalesce("title", F.lit("")))


@query("plain_sections", "with s as (select conv_id * 1000 + turn id, role, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) t from conversations) select id, cast(1 as bigint) section, upper(role) || ' SPOKE' title, t body from s union all select id, 2, 'Rest', 'end' from s")
def plain_sections(spark, d):
    c = V.table(spark, d, "conversations")
    body = F.concat_ws("\n", F.concat(F.upper("role"), F.lit(" SPOKE")), "text", F.lit(""), F.lit("Rest"), F.lit("----"), F.lit("end"))
    return T.plain_sections(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), body.alias("body")), "body", "id")


@query("format_detect", "select cast(n as bigint) n, kind from (values ((select count(*) from conversations), 'markdown'), ((select count(*) from documents), 'plain')) t(n, kind)")
def format_detect(spark, d):
    marked = _pages(spark, d).select("body").unionByName(V.table(spark, d, "documents").select(F.col("text").alias("body")))
    return marked.groupBy(F.when(T.is_markdown(F.col("body")), "markdown").otherwise("plain").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# -- transcripts --------------------------------------------------------------------------------

FLAT = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')"
#: A conversation in three of four is timed, of the rest one in two names its speakers.
KIND = "case when conv_id % 4 < 3 then 'timed' when conv_id % 8 = 3 then 'spoken' else 'plain' end"
STAMP = "printf('%d:%02d:00', (turn * 2) // 60, (turn * 2) % 60)"
TURNS = f"turns as (select conv_id, row_number() over (partition by conv_id order by turn) turn, {KIND} sign, case when {KIND} = 'timed' then {STAMP} end stamp, case when {KIND} <> 'plain' then upper(role[1]) || role[2:] end speaker, {FLAT} said from conversations)"


def _transcripts(spark, d):
    c = V.table(spark, d, "conversations").withColumn("speaker", F.concat(F.upper(F.substring("role", 1, 1)), F.substring("role", 2, 100)))
    minute = F.col("turn") * 2
    stamp = F.format_string("[%d:%02d:00] ", F.floor(minute / 60), minute % 60)
    line = F.when(F.col("conv_id") % 4 < 3, F.concat(stamp, "speaker", F.lit(": "), "text")).when(F.col("conv_id") % 8 == 3, F.concat("speaker", F.lit(": "), "text"))
    flat = F.concat_ws(" ", F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    c = c.withColumn("line", F.coalesce(line, flat))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("body"))


@query("transcript_turns", f"with {TURNS} select conv_id, turn, sign, case when stamp is not null then cast(split_part(stamp, ':', 1) as double) * 60 + cast(split_part(stamp, ':', 2) as double) end as minutes, speaker, said from turns")
def transcript_turns(spark, d):
    t = T.transcript(_transcripts(spark, d), "body", "conv_id")
    return t.select("conv_id", "turn", "sign", F.col("minute").alias("minutes"), "speaker", "said")


@query("transcript_segments", f"""with recursive {TURNS}, m as (select conv_id, turn, stamp, speaker, said, cast(split_part(stamp, ':', 1) as int) * 60 + cast(split_part(stamp, ':', 2) as int) t0 from turns where sign = 'timed'),
 starts(conv_id, f, block) as (select conv_id, min(t0), 0 from m group by conv_id union all select s.conv_id, (select min(t0) from m where m.conv_id = s.conv_id and t0 >= s.f + 5), s.block + 1 from starts s where exists (select 1 from m where m.conv_id = s.conv_id and t0 >= s.f + 5))
 select m.conv_id, cast(s.block as bigint) block, string_agg(speaker || ': ' || said, chr(10) order by turn) body, array_to_string(list_sort(list(distinct speaker)), ',') speakers, first(stamp order by turn) as first_stamp, last(stamp order by turn) as last_stamp
 from m asof join starts s on m.conv_id = s.conv_id and m.t0 >= s.f group by 1, 2
 union all select conv_id, 0, string_agg(said, ' ' order by turn), '', null, null from turns where sign = 'plain' group by 1""")  # fmt: skip
def transcript_segments(spark, d):
    t = T.transcript(_transcripts(spark, d), "body", "conv_id").filter("sign != 'spoken'")
    return T.segments(t, "conv_id").select("conv_id", "block", F.col("text").alias("body"), F.array_join("speakers", ",").alias("speakers"), F.col("first").alias("first_stamp"), F.col("last").alias("last_stamp"))


@query("speaker_segments", f"""with {TURNS}, t as (select *, speaker || ': ' || said line, case when speaker = lag(speaker) over (partition by conv_id order by turn) then 0 else 1 end change from turns where sign = 'spoken'),
 r as (select *, sum(change) over (partition by conv_id order by turn) run from t), g as (select conv_id, run, string_agg(line, chr(10) order by turn) body, min(turn) turn from r group by all),
 s as (select *, sum(case when length(body) >= 50 or run = 1 then 1 else 0 end) over (partition by conv_id order by run) block from g)
 select conv_id, cast(block as bigint) block, string_agg(body, chr(10) order by run) body from s group by 1, 2""")  # fmt: skip
def speaker_segments(spark, d):
    t = T.transcript(_transcripts(spark, d), "body", "conv_id").filter("sign = 'spoken'")
    return T.segments(t, "conv_id").select("conv_id", "block", F.col("text").alias("body"))


# -- chat exports: one for each turn ------------------------------------------------------------

SLACK_TS = "cast(1700000000 + conv_id * 100000 + turn * 200 as varchar) || '.5'"


def _slack(spark, d):
    c = V.table(spark, d, "conversations")
    ts = lambda turn: F.concat((1700000000 + F.col("conv_id") * 100000 + turn * 200).cast("string"), F.lit(".5"))
    m = F.struct(
        F.concat(F.lit("U"), "role").alias("user"), F.concat(F.lit("<@Ubob> "), "text").alias("text"), ts(F.col("turn")).alias("ts"), F.when(F.col("conv_id") % 2 == 0, ts(F.lit(0))).alias("thread_ts"),
        F.when(F.col("turn") % 7 == 6, "channel_join").when(F.col("turn") % 7 == 5, "bot_message").alias("subtype"), F.array(F.struct(F.lit("ok").alias("name"), F.col("turn").cast("int").alias("count"))).alias("reactions"),
    )
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("channel"), F.to_json(F.when(F.col("turn") % 2 == 0, F.array(m))).alias("a"), F.to_json(F.struct(F.array(m).alias("messages"))).alias("b")).select("channel", F.coalesce("a", "b").alias("export"))


@query("slack_messages", f"select 'c' || conv_id channel, {SLACK_TS} message_id, case when conv_id % 2 = 0 and turn > 0 then cast(1700000000 + conv_id * 100000 as varchar) || '.5' end reply_to, case role when 'user' then 'Una' else 'U' || role end author, '<@Ubob> ' || text body, cast(1700000000 + conv_id * 100000 + turn * 200 + 0.5 as double) ts, turn % 7 = 5 is_bot, 'Ubob' mentions, cast(turn as int) reactions from conversations where turn % 7 <> 6")
def slack_messages(spark, d):
    m = chat.slack(_slack(spark, d), "export", "channel", users={"Uuser": "Una"})
    return m.select("channel", "message_id", "reply_to", "author", F.col("text").alias("body"), "ts", "is_bot", F.array_join("mentions", ",").alias("mentions"), "reactions")


@query("slack_threads", f"""with recursive m as (select 'c' || conv_id channel, conv_id, 1700000000 + conv_id * 100000 + turn * 200 t0, turn from conversations where turn % 7 <> 6), alone as (select * from m where conv_id % 2 = 1),
 starts(channel, f, block) as (select channel, min(t0), 0 from alone group by 1 union all select s.channel, (select min(t0) from alone a where a.channel = s.channel and t0 > s.f + 300), s.block + 1 from starts s where exists (select 1 from alone a where a.channel = s.channel and t0 > s.f + 300))
 select channel || '|' || (1700000000 + conv_id * 100000) || '.5' thread, count(*) messages from m where conv_id % 2 = 0 group by 1
 union all select a.channel || '#' || s.block, count(*) from alone a asof join starts s on a.channel = s.channel and a.t0 >= s.f group by 1""")  # fmt: skip
def slack_threads(spark, d):
    return chat.threaded(chat.slack(_slack(spark, d), "export", "channel"), "channel").groupBy("thread").agg(F.count(F.lit(1)).alias("messages"))


def _iso(at):
    return F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ssXXX")


def _discord(spark, d):
    c = V.table(spark, d, "conversations")
    m = F.struct(
        F.concat_ws("-", F.lit("m"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("content"), _iso(1700000000 + F.col("conv_id") * 100000 + F.col("turn")).alias("timestamp"),
        F.struct(F.col("role").alias("name"), (F.col("turn") % 9 == 8).alias("isBot")).alias("author"), F.when(F.col("turn") % 3 > 0, F.struct(F.concat_ws("-", F.lit("m"), (F.col("turn") - 1).cast("string")).alias("messageId"))).alias("reference"),
        F.array(F.struct(F.struct(F.lit("up").alias("name")).alias("emoji"), F.lit(2).alias("count"))).alias("reactions"), F.array(F.struct(F.lit("bo").alias("username"))).alias("mentions"), F.array(F.struct(F.lit("f.txt").alias("fileName"))).alias("attachments"),
    )
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("channel"), F.to_json(F.struct(F.array(m).alias("messages"))).alias("export"))


@query("discord_messages", "select 'c' || conv_id channel, 'm-' || turn message_id, case when turn % 3 > 0 then 'm-' || (turn - 1) end reply_to, role author, text body, cast(1700000000 + conv_id * 100000 + turn as double) ts, turn % 9 = 8 is_bot, 'bo' mentions, 2 reactions, 'f.txt' attachments from conversations")
def discord_messages(spark, d):
    m = chat.discord(_discord(spark, d), "export", "channel")
    return m.select("channel", "message_id", "reply_to", "author", F.col("text").alias("body"), "ts", "is_bot", F.array_join("mentions", ",").alias("mentions"), "reactions", F.array_join("attachments", ",").alias("attachments"))


@query("discord_threads", "select 'c' || conv_id || '|m-' || (turn - turn % 3) thread, count(*) messages, string_agg(role || ': ' || text, chr(10) order by turn) thread_text from conversations where turn % 9 <> 8 group by conv_id, turn - turn % 3 having count(*) >= 2")
def discord_threads(spark, d):
    t = chat.ingested(chat.replied(chat.discord(_discord(spark, d), "export", "channel"), "channel"))
    return t.select("thread", "messages", "thread_text")


@query("teams_messages", "select 'c' || conv_id channel, 't' || turn message_id, case when turn % 2 = 1 then 't' || (turn - 1) when turn % 10 = 8 then 'gone' end reply_to, role author, trim(regexp_replace(case when turn % 2 = 0 then text else '<p>' || text || '</p>' end, case when turn % 2 = 0 then '^$' else '<[^>]+>|\\s+' end, case when turn % 2 = 0 then '' else ' ' end, 'g')) body, cast(1700000000 + turn as double) ts, turn % 11 = 10 is_bot, 'Ann B' mentions, case when turn % 5 = 0 then 'high' else 'normal' end importance from conversations")
def teams_messages(spark, d):
    m = chat.teams(_teams(spark, d), "export", "channel")
    return m.select("channel", "message_id", "reply_to", "author", F.col("text").alias("body"), "ts", "is_bot", F.array_join("mentions", ",").alias("mentions"), "importance")


def _teams(spark, d):
    c, html = V.table(spark, d, "conversations"), F.col("turn") % 2 == 1
    m = F.struct(
        F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.struct(F.when(html, "html").otherwise("text").alias("contentType"), F.when(html, F.concat(F.lit("<p>"), "text", F.lit("</p>"))).otherwise(F.col("text")).alias("content")).alias("body"),
        F.struct(F.struct(F.col("role").alias("displayName")).alias("user"), F.when(F.col("turn") % 11 == 10, F.struct(F.lit("app").alias("id"))).alias("application")).alias("from"), _iso(1700000000 + F.col("turn")).alias("createdDateTime"),
        F.when(html, F.concat(F.lit("t"), (F.col("turn") - 1).cast("string"))).when(F.col("turn") % 10 == 8, "gone").alias("replyToId"), F.array(F.struct(F.struct(F.struct(F.lit("Ann B").alias("displayName")).alias("user")).alias("mentioned"))).alias("mentions"),
        F.when(F.col("turn") % 5 == 0, "high").alias("importance"),
    )
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("channel"), F.to_json(F.struct(F.array(m).alias("value"))).alias("export"))


@query("teams_threads", "select 'c' || conv_id || '|t' || (turn - turn % 2) thread, count(*) messages from conversations group by 1")
def teams_threads(spark, d):
    return chat.replied(chat.teams(_teams(spark, d), "export", "channel"), "channel").groupBy("thread").agg(F.count(F.lit(1)).alias("messages"))


@query("chat_edges", f"""with who as (select distinct conv_id, role from conversations), {LINES}, f as (select id // 1000 conv_id, {_found([*T.CHAT_ACTIONS, *T.ACTIONS])} from l)
 select role src, cast(conv_id as varchar) dst, 'participated_in' edge_type from who union select a.role, b.role, 'communicates_with' from who a join who b on a.conv_id = b.conv_id and a.role < b.role
 union select role, 'channel ' || (conv_id % 5), 'member_of' from who union select cast(conv_id as varchar), left(said, 80), 'has_action' from f where said <> ''""")  # fmt: skip
def chat_edges(spark, d):
    c = V.table(spark, d, "conversations").withColumn("channel", F.concat(F.lit("channel "), (F.col("conv_id") % 5).cast("string")))
    actions = T.action_items(_notes(spark, d), "body", "id", T.CHAT_ACTIONS).withColumn("conv_id", F.floor(F.col("id") / 1000))
    return T.chat_edges(c, actions, "conv_id", "role", "channel")


@query("participant_pairs", "with m as (select distinct cast(epoch_us(ts) // 3600000000 as bigint) hr, user_id u from events) select a.u p1, b.u p2, count(*) conversations from m a join m b on a.hr = b.hr and a.u < b.u group by all")
def participants(spark, d):
    e = V.table(spark, d, "events").select(F.floor(V.micros(F.col("ts")) / 3_600_000_000).alias("hour"), "user_id")
    return T.participant_pairs(e, "hour", "user_id")


@query("correlations", "with m as (select distinct l_orderkey g, 'supplier:' || l_suppkey e from lineitem) select a.e a, b.e b, count(*) weight, round(least(0.9, 0.4 + 0.1 * count(*)), 6) confidence from m a join m b on a.g = b.g and a.e < b.e group by 1, 2 having count(*) >= 2")
def correlations(spark, d):
    return V.suppliers_named(R.correlations(V.table(spark, d, "lineitem"), "l_orderkey", "l_suppkey"))


# -- mail ---------------------------------------------------------------------------------------


def _mails(spark, d):
    c = V.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.regexp_replace("text", "\n+", " ").alias("t"))
    raw = F.concat(F.lit("From: "), "role", F.lit(" <"), "role", F.lit("@x.org>\r\nTo: a@x.org, b@x.org\r\nSubject: about\r\n "), F.col("id").cast("string"), F.lit("\r\nDate: Mon, 1 Jan 2024\r\nMessage-ID: <"), F.col("id").cast("string"), F.lit(">\r\n\r\n"), "t", F.lit("\n\nOn Monday, Bob Dole wrote:\n> "), "t", F.lit("\n> > more"))
    parsed = F.to_json(F.struct(F.col("role").alias("from"), F.array(F.lit("a@x.org")).alias("to"), F.concat(F.lit("about "), F.col("id").cast("string")).alias("subject"), F.col("t").alias("body")))
    return c.select("id", F.when(F.col("id") % 3 > 0, raw).otherwise(parsed).alias("raw"))


MAILS = "m as (select conv_id * 1000 + turn id, role, trim(regexp_replace(text, '\\n+', ' ', 'g')) t from conversations)"


@query("mail_parse", f"with {MAILS} select id, case when id % 3 > 0 then role || ' <' || role || '@x.org>' else role end sender, case when id % 3 > 0 then 'a@x.org,b@x.org' else 'a@x.org' end recipients, 'about ' || id subject, case when id % 3 > 0 then 'Mon, 1 Jan 2024' end as mail_date, case when id % 3 > 0 then '<' || id || '>' else '' end message_id from m")
def mail_parse(spark, d):
    m = mail.emails(_mails(spark, d), "raw", "id")
    return m.select("id", "sender", F.array_join("recipients", ",").alias("recipients"), "subject", F.col("date").alias("mail_date"), "message_id")


@query("mail_threads", f"with {MAILS} select id, 0 as part, '' author, t body from m union all select id, 1, 'Dole', t || chr(10) || 'more' from m where id % 3 > 0")
def mail_threads(spark, d):
    parts = mail.thread_parts(mail.emails(_mails(spark, d), "raw", "id"), "body", "id")
    return parts.select("id", "part", F.element_at(F.split("author", " "), -1).alias("author"), F.trim("text").alias("body"))


# -- entities and names -------------------------------------------------------------------------

HOUSES = "houses as (select c_custkey k, 'We met Trading House ' || c_custkey || ' (TH' || c_custkey || ') and The ' || c_mktsegment || ' Club (clb), in ' || n_name || '.' body from customer join nation on n_nationkey = c_nationkey)"


def _houses(spark, d):
    c = V.table(spark, d, "customer").join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("k"), F.concat(F.lit("We met Trading House "), F.col("c_custkey").cast("string"), F.lit(" (TH"), F.col("c_custkey").cast("string"), F.lit(") and The "), "c_mktsegment", F.lit(" Club (clb), in "), "n_name", F.lit(".")).alias("body"))


@query("alias_discover", f"with {HOUSES}, x as (select trim(unnest(regexp_extract_all(body, '([\\pL\\pN_]+(?:\\s+[\\pL\\pN_]+)*)\\s*\\(([^)]+)\\)', 1))) a, trim(unnest(regexp_extract_all(body, '([\\pL\\pN_]+(?:\\s+[\\pL\\pN_]+)*)\\s*\\(([^)]+)\\)', 2))) b from houses) select distinct case when length(b) < length(a) then b else a end alias, case when length(b) < length(a) then a else b end canonical from x")
def alias_discover(spark, d):
    return T.aliases_in(_houses(spark, d), "body")


@query("alias_resolve", "with a as (select 'supplier ' || s_suppkey alias, s_name canonical from supplier), e as (select ' Supplier  ' || l_suppkey || ' ' entity, count(*) n from lineitem group by 1) select canonical, 'company' entity_type, n from e join a on regexp_replace(lower(trim(entity)), '\\s+', ' ', 'g') = alias")
def alias_resolve(spark, d):
    a = V.table(spark, d, "supplier").select(V.numbered("supplier ", F.col("s_suppkey")).alias("alias"), F.col("s_name").alias("canonical"), F.lit("company").alias("entity_type"))
    e = V.table(spark, d, "lineitem").groupBy(F.concat(F.lit(" Supplier  "), F.col("l_suppkey").cast("string"), F.lit(" ")).alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return T.resolved_name(e, a, "entity").select("canonical", "entity_type", "n")


DETECT = [T.Detector("house", r"House \d+"), T.Detector("code", r"TH\d+"), T.Detector("number", r"(?<=House )\d+"), T.Detector("club", r"Club")]
EXTRACT = [T.Extractor("code", "code", r"T(H)(\d+)", "{entity_type}-{group1}", 0.9), T.Extractor("any", "thing", r"[A-Z]\w+", "{match_lower}", 0.5)]


@query("entity_candidates", f"with {HOUSES} select k, 'house' detector, 'House ' || k found, strpos(body, 'House') - 1 start_at from houses union all select k, 'code', 'TH' || k, strpos(body, '(TH') from houses union all select k, 'club', 'Club', strpos(body, 'Club') - 1 from houses")
def entity_candidates(spark, d):
    found = T.detected(_houses(spark, d), "k", "body", DETECT)
    return found.select("k", "detector", F.col("match").alias("found"), F.col("start").cast("long").alias("start_at"))


@query("entity_resolved", f"with {HOUSES} select k, 'house' entity, 'thing' entity_type, 0.5 confidence, 'house' canonical from houses union all select k, 'code-' || k, 'code', 0.9, case when k % 2 = 0 then 'House of ' || k else 'code-' || k end from houses union all select k, 'club', 'thing', 0.5, 'club' from houses")
def entity_resolved(spark, d):
    named = T.extracted(T.detected(_houses(spark, d), "k", "body", DETECT), EXTRACT)
    even = V.table(spark, d, "customer").filter("c_custkey % 2 = 0")
    aliases = even.select(F.concat(F.lit(" Code-"), F.col("c_custkey").cast("string")).alias("alias"), F.concat(F.lit("House of "), F.col("c_custkey").cast("string")).alias("canonical"))
    return T.resolved(named, aliases, "k", "start").select("k", "entity", "entity_type", "confidence", "canonical")


@query("entity_unresolved", f"with {HOUSES} select 'Club' found, count(*) n from houses union all select 'House', count(*) from houses")
def entity_unresolved(spark, d):
    found = T.detected(_houses(spark, d), "k", "body", DETECT)
    left = T.unresolved(found, T.extracted(found, EXTRACT[:1]), "k", "start")
    return left.groupBy(F.element_at(F.split("match", " "), 1).alias("found")).agg(F.count(F.lit(1)).alias("n"))


@query("context_entities", "select c_custkey, array_to_string(list_sort(list_distinct(['Big House', c_name, c_mktsegment, 'vip'])), ',') entities from customer")
def context_entities(spark, d):
    c = V.table(spark, d, "customer")
    e = R.all_entities(F.lit('The "Big House" is where'), F.create_map(F.lit("user"), F.col("c_name"), F.lit("topic"), F.col("c_mktsegment"), F.lit("other"), F.lit("no")), F.array(F.lit("vip")))
    return c.select("c_custkey", F.array_join(F.array_sort(F.filter(e, lambda x: x != "The")), ",").alias("entities"))


STOP = ["the", "and", "der", "die", "das", "que", "les"]
PHRASE_SQL = "regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+\\b)+', 0)"
SINGLE_SQL = "list_filter(regexp_extract_all(text, '\\b[A-Z][a-z]{2,}\\b', 0), lambda w: lower(w) not in ('the', 'and', 'der', 'die', 'das', 'que', 'les'))"


@query("name_candidates", f"select doc_id, len(list_distinct(list_concat({PHRASE_SQL}, {SINGLE_SQL}))) candidates from documents")
def name_candidates(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.size(R.name_candidates(F.col("text"), STOP)).cast("long").alias("candidates"))


@query("known_facts", with_views("pairs", """, o as (select o_orderkey k, ['part:' || (o_orderkey % 50), 'supplier:' || (o_custkey % 10), 'part:' || (o_orderkey % 7)] c from orders), n as (select k, e, c[e + 1] entity from (select k, list_sort(list_distinct(c)) c, unnest(range(0, len(list_distinct(c)))) e from o)),
 f as (select belief_id, subject || ' ' || predicate || ' ' || object fact, unnest([subject, object]) entity from pairs), b as (select *, row_number() over (partition by entity order by belief_id) r from f qualify r <= 3),
 m as (select k, fact, min(e * 10 + r) o from n join b using (entity) group by all) select k, fact, row_number() over (partition by k order by o) n from m qualify n <= 20"""))  # fmt: skip
def known_facts(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.array(V.numbered("part:", F.col("o_orderkey") % 50), V.numbered("supplier:", F.col("o_custkey") % 10), V.numbered("part:", F.col("o_orderkey") % 7)).alias("c"))
    return S.known_facts(o, V.pair_beliefs(spark, d), "k", F.col("c"))


# -- patterns in texts --------------------------------------------------------------------------

REASONS = ["because", "led to", "Triggered", "->", "and", "hence"]
REASONED = "reasons as (select conv_id * 1000 + turn id, role || ' spoke first ' || case (conv_id + turn) % 6 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(REASONS)) + " end || ' ' || replace(text, chr(10), ' ') body from conversations)"


def _reasons(spark, d):
    c = V.table(spark, d, "conversations")
    word = F.get(F.array(*[F.lit(r) for r in REASONS]), ((F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("role", F.lit(" spoke first "), word, F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("content"), F.lit(None).cast("string").alias("outcome"))


_CAUSE = "\\b(?:because|caused|resulted in|led to|due to|therefore|hence)\\b"
_MADE = "\\b(?:made|triggered|enabled|prevented|blocked)\\b"


@query("causal_patterns", f"""with {REASONED}, p as (select id, body || ' ' b, case when regexp_matches(body, '(?i){_CAUSE}') then '(?i){_CAUSE}' when regexp_matches(body, '(?i){_MADE}') then '(?i){_MADE}' when contains(body, '->') then '->\\s*' end i from reasons),
 s as (select id, b, regexp_extract(b, i, 0) hit from p where i is not null), x as (select id, trim(left(b, strpos(b, hit) - 1)) cause, trim(substr(b, strpos(b, hit) + length(hit))) effect from s)
 select id, right(cause, 100) cause, left(effect, 100) effect from x where cause <> '' and effect <> ''""")  # fmt: skip
def causal_patterns(spark, d):
    return R.causal_patterns(_reasons(spark, d), "id").select("id", "cause", "effect")


@query("pattern_subjects", "select doc_id, coalesce(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '^[A-Z]'))[1], list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 3)[1], left(text, 30)) subject, case when length(text) > 50 then left(text, 47) || '...' else text end short from documents")
def pattern_subjects(spark, d):
    return V.table(spark, d, "documents").select("doc_id", R.subject_of(F.col("text")).alias("subject"), T.shortened(F.col("text")).alias("short"))


@query("fact_patterns", with_views("experiences", """, g as (select session_id, strftime(occurred_at, '%Y-%m-%d') dy, content, outcome from experiences), k as (select session_id || '|' || dy g, list_distinct([lower(content), lower(coalesce(outcome, content))]) e from g),
 s as (select g, count(*) size from k group by g), n as (select g, entity, count(*) n from (select g, unnest(e) entity from k) group by all having count(*) >= 2) select g, entity, size, round(0.5 + 0.05 * least(10, size), 6) confidence from n join s using (g)"""))  # fmt: skip
def fact_patterns(spark, d):
    e = V.experiences(spark, d).select(F.concat_ws("|", F.col("session_id").cast("string"), F.date_format("occurred_at", "yyyy-MM-dd")).alias("g"), F.array("content", F.coalesce("outcome", "content")).alias("e"))
    return R.fact_patterns(e, "g", F.col("e"))


@query("link_counts", "select l_suppkey, count(*) * (count(*) - 1) // 2 links from lineitem group by 1")
def link_counts(spark, d):
    return R.link_count(V.table(spark, d, "lineitem"), "l_suppkey")


@query("catch_all_group", "with g as (select distinct o_custkey k from orders) select case when g.k is null then 'all' else 'c' || (c_custkey % 3) end grp, count(*) n from customer left join g on g.k = c_custkey group by 1")
def catch_all(spark, d):
    items = V.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    grouped = V.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().join(items, "k", "left_semi").withColumn("grp", F.concat(F.lit("c"), (F.col("k") % 3).cast("string")))
    return R.catch_all(items, grouped, "k", "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


# -- answers of language models, what they read, snapshots ---------------------------------------


@query("lenient_json", "select o_orderkey k, o_orderkey id, o_orderkey || ',' || o_custkey list, case o_orderkey % 3 when 0 then o_orderpriority end title from orders")
def lenient_json(spark, d):
    o = V.table(spark, d, "orders")
    whole = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.array("o_orderkey", "o_custkey").alias("list"), F.col("o_orderpriority").alias("title")))
    # Whole in its fence, or cut off within the title.
    fenced, cut = F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```")), F.concat(F.lit("Sure! "), F.substring(whole, F.lit(1), F.length(whole) - 3 - F.col("o_orderkey") % 3))
    text = F.when(F.col("o_orderkey") % 3 == 0, fenced).otherwise(cut)
    j = F.from_json(T.lenient_json(text), "id bigint, list array<bigint>, title string")
    return o.select(F.col("o_orderkey").alias("k"), j.alias("j")).select("k", "j.id", F.array_join("j.list", ",").alias("list"), "j.title")


@query("reading_chunks", """with t as (select source, doc_id, trim(text, ' ' || chr(9) || chr(13) || chr(10)) t from documents), u as (select *, row_number() over (partition by source, left(t, 200) order by doc_id) n from t where length(t) >= 50), c as (select source, t, (row_number() over (partition by source order by doc_id) - 1) // 8 chunk from u where n = 1)
 select source, chunk, count(*) texts, least(24000, cast(sum(length(t) + 7) - 7 as bigint)) chars from c group by 1, 2""")  # fmt: skip
def reading_chunks(spark, d):
    return T.reading_chunks(V.table(spark, d, "documents"), "source", "doc_id", "text")


@query("source_labels", "with g as (select o_custkey g, list_sort(list(distinct 'Order ' || o_orderkey)) l from orders group by 1) select o_orderkey k, case o_orderkey % 3 when 0 then 'Order ' || o_orderkey when 1 then list_filter(l, lambda x: contains(lower(x), 'order ' || o_orderkey) or contains('order ' || o_orderkey, lower(x)))[1] else 'doc' end source from orders join g on g = o_custkey")
def source_labels(spark, d):
    o = V.table(spark, d, "orders")
    g = o.groupBy(F.col("o_custkey").alias("g")).agg(F.array_sort(F.collect_set(V.numbered("Order ", F.col("o_orderkey")))).alias("l"))
    label = F.when(F.col("o_orderkey") % 3 == 0, V.numbered("Order ", F.col("o_orderkey"))).when(F.col("o_orderkey") % 3 == 1, V.numbered("order ", F.col("o_orderkey"))).otherwise(F.lit("nothing known"))
    return o.join(g, F.col("o_custkey") == F.col("g")).select(F.col("o_orderkey").alias("k"), T.source_of(label, F.col("l"), F.lit("doc")).alias("source"))


@query("snapshot_summaries", "select doc_id, left('Context: ' || source || '. Working on: lang, n. Latest: ' || left(text, 200), 500) summary from documents")
def snapshot_summaries(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.snapshot_summary(F.col("source"), F.array(F.lit("lang"), F.lit("n")), F.col("text")).alias("summary"))


@query("next_steps", f"with {LINES}, s as (select id, line_no, left(trim(regexp_extract(line, '(?i)(?:TODO|NEXT|FIXME|should|need to|will)\\s*:?\\s*(.+)', 1)), 200) step from l where regexp_matches(line, '(?i)(?:TODO|NEXT|FIXME|should|need to|will)\\s*:?\\s*(.+)')), r as (select *, row_number() over (partition by id order by line_no) rn from s) select id, array_to_string(list(step order by rn), '|') steps from r where rn <= 5 group by id")
def next_steps(spark, d):
    n = _notes(spark, d).select("id", T.next_steps(F.col("body")).alias("s"))
    return n.filter(F.size("s") > 0).select("id", F.array_join("s", "|").alias("steps"))


@query("open_questions", "select conv_id * 1000 + turn id, 'What of ' || role || ' ' || turn || '?|Is it so?' questions from conversations")
def open_questions(spark, d):
    c = V.table(spark, d, "conversations")
    text = F.concat(F.lit("It is. What of "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("? Fine! Is it so? Yes."))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array_join(T.open_questions(text), "|").alias("questions"))
