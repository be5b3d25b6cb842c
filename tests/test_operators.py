"""Operators on small literal tables: edges, ties, nulls, and the engine's ordering contracts."""

import pytest
from pyspark.sql import functions as F

from lorebase.functions import access, scoring, temporal
from lorebase.memory import Memory
from lorebase.operators import beliefs as B
from lorebase.operators import governance as G
from lorebase.operators import graph, reflection
from lorebase.operators import text as T
from lorebase.sources import chat, mail


def test_recency_wins_when_time_weighs_most(spark):
    df = spark.createDataFrame([(1, 720.0), (2, 168.0), (3, 0.0)], "id int, age double")
    s = scoring.weighted({"temporal": scoring.temporal(F.col("age"), 168), "text": F.lit(1.0)}, {"temporal": 0.8, "text": 0.1})
    assert [r.id for r in scoring.top(df.withColumn("s", s), "s", "id", 3).collect()] == [3, 2, 1]


def test_entropy_orders_and_reranks(spark):
    df = spark.createDataFrame([(1, 0.99), (2, 0.5), (3, 1.0), (4, 0.0)], "id int, p double").withColumn("h", scoring.entropy(F.col("p")))
    h = {r.id: r.h for r in df.collect()}
    assert h[2] > h[1] > 0 and h[3] == h[4] == 0
    two = spark.createDataFrame([("a", 0.8, 0.05), ("b", 0.7, 0.65)], "id string, s double, e double")
    first = lambda w, d: scoring.top(two.withColumn("x", scoring.reranked(F.col("s"), F.col("e"), w, d)), "x", "id", 1).first().id
    assert first(0.5, "high") == "b" and first(0.5, "low") == "a" and first(0.0, "high") == "a"


def test_unknown_profile_is_an_error():
    with pytest.raises(KeyError):
        scoring.PROFILES["technical"]


def test_validity_bounds_are_inclusive_and_ttl_strict(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01' f, timestamp_ntz'2024-01-02' u, timestamp_ntz'2024-01-01' r")
    ok = lambda t: df.select(temporal.valid_at(df.f, df.u, t)).first()[0]
    assert ok("2024-01-01") and ok("2024-01-02") and not ok("2024-01-03")
    old = lambda ttl: df.select(temporal.expired(df.r, F.lit(ttl), "2024-01-02")).first()[0]
    assert not old(86400) and old(86399) and not old(None)


@pytest.mark.parametrize(("kind", "days", "want"), [("none", 100, 1.0), ("linear", 7, 0.5), ("linear", 100, 0.1), ("exponential", 7, 0.5), ("step", 6.9, 1.0), ("step", 7, 0.5)])
def test_decay(spark, kind, days, want):
    assert spark.range(1).select(temporal.decay(F.lit(days * 86400.0), kind)).first()[0] == pytest.approx(want)


ROWS = [("a", "u1", "t1", "private", ["u2"]), ("b", "u1", "t1", "workspace", []), ("c", "u1", "t1", "public", None), ("d", "u9", "t2", "public", []), ("e", "u9", "t2", "workspace", ["u2"]), ("f", "u9", None, "private", [])]


@pytest.mark.parametrize(("who", "want"), [(access.Principal("u1", "t1"), "abcd"), (access.Principal("u2", "t1"), "abcd"), (access.Principal("u3", "t1", ()), "cd"), (access.Principal("u3", "t1", ("admin",)), "abcdf")])
def test_row_access(spark, who, want):
    df = spark.createDataFrame(ROWS, "id string, owner string, tenant string, privacy string, shared array<string>")
    got = df.filter(access.visible(who, df.owner, df.tenant, df.privacy, df["shared"])).collect()
    assert "".join(sorted(r.id for r in got)) == want


def test_policies_by_priority_and_default_deny(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    p = [access.Policy("low", 1, F.lit(True), True), access.Policy("high", 9, F.col("x") == 1, False)]
    assert [tuple(r[0]) for r in df.select(access.decided(p)).collect()] == [(False, "high"), (True, "low")]
    assert df.select(access.decided([])).first()[0].policy == "default"


def test_two_and_three_hops_weaken_and_never_loop(spark):
    df = spark.createDataFrame([("1", "A", "p", "B", 0.9), ("2", "b", "p", "C", 0.95), ("3", "C", "p", "D", 0.9), ("4", "B", "p", "a", 0.9)], "belief_id string, subject string, predicate string, object string, confidence double")
    two = {(r.s, r.o): r.confidence for r in B.two_hop(df).collect()}
    assert two[("A", "C")] == pytest.approx(0.63) and ("A", "a") not in two
    three = {(r.s, r.o): r.confidence for r in B.three_hop(df).collect()}
    assert three[("A", "D")] == pytest.approx(0.45)


def test_contradictions_are_symmetric_and_need_different_objects(spark):
    df = spark.createDataFrame([("1", "S", "is", "red", 0.9), ("2", "s", "IS", "blue", 0.8), ("3", "s", "is", "RED", 0.7)], "belief_id string, subject string, predicate string, object string, confidence double")
    assert {(r.a_id, r.b_id) for r in B.contradiction_pairs(df).collect()} == {("1", "2"), ("2", "3")}
    assert B.contradiction_groups(df).count() == 1


@pytest.mark.parametrize(("a", "b", "want"), [("True", "false", True), ("yes", "no", True), ("not red", "red", True), ("3", "4.0", True), ("3", "3.0", False), ("red", "blue", False)])
def test_exclusive(spark, a, b, want):
    assert spark.range(1).select(B.exclusive(F.lit(a), F.lit(b))).first()[0] is want


def test_as_of_join_carries_forward(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("z", 9)], "k string, t int")
    history = spark.createDataFrame([("k", 2, "x"), ("k", 5, "y"), ("k", 7, None)], "k string, at int, v string")
    got = {(r.k, r.t): r.v for r in B.as_of_join(left, history, "k", "t", "at", ["v"]).collect()}
    assert got == {("k", 5): "y", ("k", 1): None, ("z", 9): None}


EDGES = [("s", "a", "x", 0.9), ("s", "b", "x", 0.8), ("a", "c", "y", 0.5), ("i", "j", "x", 1.0)]


def test_ppr_prefers_near_nodes_over_islands(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string, edge_type string, confidence double")
    seeds = spark.createDataFrame([("s",)], "node string")
    r = {x.node: x["rank"] for x in graph.pagerank(e, rounds=10, seeds=seeds).collect()}
    assert r["a"] > r["c"] > r["j"] == 0 and sum(r.values()) == pytest.approx(1)
    assert sum(x["rank"] for x in graph.pagerank(e, rounds=5).collect()) == pytest.approx(1)


def test_traversal(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string, edge_type string, confidence double")
    q = graph.GraphQuery(e).start("s")
    assert {(r.node, r.depth) for r in q.traverse(depth=2).execute().collect()} == {("s", 0), ("a", 1), ("b", 1), ("c", 2)}
    assert {r.node for r in q.traverse("x", depth=2).execute().collect()} == {"s", "a", "b"}
    assert {r.node for r in graph.GraphQuery(e).start("c").traverse(direction="in", depth=2).execute().collect()} == {"c", "a", "s"}
    best = graph.shortest(e, spark.createDataFrame([("s",)], "node string"), "c").first()
    assert best.nodes == ["s", "a", "c"] and best.confidence == pytest.approx(0.45)
    assert graph.communities(e, 4).filter("node in ('i', 'j')").select("community").distinct().count() == 1


def test_gap_sessions_are_inclusive(spark):
    df = spark.sql("select * from values ('u', timestamp_ntz'2024-01-01 00:00:00'), ('u', timestamp_ntz'2024-01-01 00:30:00'), ('u', timestamp_ntz'2024-01-01 01:00:01'), ('u', timestamp_ntz'2024-01-01 01:00:02') t(u, ts)")
    assert sorted(r.members for r in reflection.gap_sessions(df, "u", "ts").collect()) == [2, 2]


def test_first_wins_keeps_what_only_resembles_dropped_groups(spark):
    groups = spark.createDataFrame([(i,) for i in range(4)], "g int")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a int, b int")
    assert sorted(r.g for r in reflection.first_wins(groups, pairs, "g").collect()) == [0, 2]


def test_first_wins_settles_a_long_chain(spark):
    groups = spark.createDataFrame([(i,) for i in range(25)], "g int")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(24)], "a int, b int")
    assert sorted(r.g for r in reflection.first_wins(groups, pairs, "g").collect()) == list(range(0, 25, 2))


def test_group_first_wins_is_registered(spark):
    from lorebase import catalogue
    from tests.conftest import SF

    sets = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect():
        sets.setdefault(r.l_orderkey, set()).add(r.l_suppkey)
    kept = []
    for g in sorted(sets):
        if not any(len(sets[g] & sets[k]) / len(sets[g] | sets[k]) > 0.8 for k in kept):
            kept.append(g)
    assert sorted(r.l_orderkey for r in catalogue.queries()["group_dedupe_first_wins"](spark, SF).collect()) == kept


def test_similar_groups_equal_brute_force(spark):
    sets = {1: "abcdefghij", 2: "abcdefghi", 3: "xyz", 4: "abcdefghijk", 5: "xyz"}
    df = spark.createDataFrame([(g, c) for g, s in sets.items() for c in s], "g int, c string")
    want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) > 0.8}
    assert {(r.a, r.b) for r in reflection.similar_groups(df, "g", "c").collect()} == want


def test_forget_reaches_own_rows_only(spark):
    df = spark.createDataFrame([(1, "u1", "t1"), (2, "u2", "t1"), (3, "u9", "t2")], "id int, owner_id string, tenant_id string")
    left = lambda who, **k: sorted(r.id for r in G.forget(df, F.lit(True), who, "id", **k).filter("true").collect())
    assert left(access.Principal("u1", "t1")) == [2, 3] and left(access.Principal("u1", "t1", ("admin",))) == [3]
    assert G.forget(df, F.lit(None).cast("boolean"), access.Principal("u1"), "id").count() == 3
    assert G.forget(df, F.col("id") == 1, access.Principal("u1"), "id", hard=False).filter("deleted").count() == 1


def test_rules_do_not_overlap_and_the_surest_entity_wins(spark):
    df = spark.createDataFrame([(1, "Mail a@b.org or call 12345"), (2, None)], "id int, t string")
    found = T.detected(df, "id", "t", [T.Detector("m", r"\w+@[\w.]+"), T.Detector("w", r"\w+")])
    assert [r.match for r in found.filter("detector = 'm'").collect()] == ["a@b.org"] and found.filter("match = 'b'").count() == 0
    named = T.extracted(found, [T.Extractor("e1", "mail", "@", "{match_upper}", 0.5), T.Extractor("e2", "host", r"(\w+)@(\w+)", "{group1}", 0.9)])
    aliases = spark.createDataFrame([(" B ", "Bee")], "alias string, canonical string")
    assert [(r.entity, r.canonical) for r in T.resolved(named, aliases, "id", "start").collect()] == [("b", "Bee")]


def test_anchored_blocks_differ_from_gaps(spark):
    df = spark.createDataFrame([("c", i, float(t)) for i, t in enumerate([0, 200, 301, 500, 602])], "c string, id int, t double")
    assert [r.block for r in T.anchored(df, "c", "t", "id", 300).orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_transcript_folds_lines(spark):
    df = spark.createDataFrame([(1, "[00:01:30] Ann: Hello\nand more\nBob: Fine")], "id int, t string")
    got = [(r.minute, r.speaker, r.said) for r in T.transcript(df, "t", "id").orderBy("turn").collect()]
    assert got == [(1.5, "Ann", "Hello and more Bob: Fine")]
    spoken = spark.createDataFrame([(1, "preface\nAnn Lee: Hello\nand more\nnot a name: x\nBob: Fine"), (2, "plain one\n\nplain two")], "id int, t string")
    got = [(r.id, r.sign, r.speaker, r.said) for r in T.transcript(spoken, "t", "id").orderBy("id", "turn").collect()]
    assert got == [(1, "spoken", None, "preface"), (1, "spoken", "Ann Lee", "Hello and more not a name: x"), (1, "spoken", "Bob", "Fine"), (2, "plain", None, "plain one"), (2, "plain", None, "plain two")]


def test_segments(spark):
    long = "x" * 60
    texts = [(1, f"[0:00] Ann: a\n[4:59] Bob: b\n[5:00] Ann: c\n[9:00] Bob: d\n[10:01] Bob: e"), (2, f"Ann: {long}\nBob: short\nAnn: tiny\nBob: {long}\nBob: more"), (3, "one\ntwo")]
    got = [(r.id, r.text, r.speakers, r["first"], r["last"]) for r in T.segments(T.transcript(spark.createDataFrame(texts, "id int, t string"), "t", "id"), "id").orderBy("id", "block").collect()]
    assert got == [
        (1, "Ann: a\nBob: b", ["Ann", "Bob"], "0:00", "4:59"), (1, "Ann: c\nBob: d", ["Ann", "Bob"], "5:00", "9:00"), (1, "Bob: e", ["Bob"], "10:01", "10:01"),
        (2, f"Ann: {long}\nBob: short\nAnn: tiny", ["Ann", "Bob"], None, None), (2, f"Bob: {long}\nBob: more", ["Bob"], None, None), (3, "one two", [], None, None),
    ]


def test_reply_chains_of_any_length(spark):
    rows = [(i, i - 1 if i else None) for i in range(200)] + [(300, 999), (400, 401), (401, 400), (500, 500)]
    df = spark.createDataFrame(rows, "k int, p int")
    roots = {r.id: r.root for r in T.reply_roots(df, "k", "p").collect()}
    assert roots == {**dict.fromkeys(range(200), 0), 300: 300, 500: 500}
    assert sorted(r.k for r in T.orphaned(df, T.reply_roots(df, "k", "p"), "k").collect()) == [400, 401]


def test_plain_sections(spark):
    df = spark.createDataFrame([(1, "INTRO PART\nline one\n\nNext\n----\nline two")], "id int, t string")
    assert [(r.title, r.body) for r in T.plain_sections(df, "t", "id").orderBy("section").collect()] == [("INTRO PART", "line one"), ("Next", "line two")]
    signs = {"# A\n- b": True, "**a** [b](c)": True, "```\nx\n```": False, "# A": False, "#A\n-b ** [x] (y)": False, "": False, "  * a\n```": True}
    assert {t: spark.range(1).select(T.is_markdown(F.lit(t))).first()[0] for t in signs} == signs


def test_answers_of_language_models_are_mended():
    cut = {'x [{"a": 1, "b": [1, 2, {"c": "q': '[{"a": 1, "b": [1, 2]}]', '{"a": "b\\"c", "d": tr': '{"a": "b\\"c"}', "none": None, "[1, 2] rest": "[1, 2]", '["a", "b': '["a"]', "": None, None: None}
    assert {raw: T.mended(raw) for raw in cut} == cut


def test_templates():
    import re

    m = re.search(r"(\w+)@(\w+)", "mail Ann@Home now")
    want = {"{match}": "Ann@Home", "{match_lower}-{entity_type}": "ann@home-k", "{group1}|{group2}|{x}": "Home|{group2}|{x}", "plain": "plain"}
    assert {t: T.compiled(t, "k")(m) for t in want} == want


def test_aliases(spark):
    df = spark.createDataFrame([("The World Health Organization (WHO) and more words",), ("x " * 5000,)], "t string")
    assert [(r.alias, r.canonical) for r in T.aliases_in(df, "t").collect()] == [("WHO", "The World Health Organization")]


def test_chat_formats(spark):
    slack = '[{"user":"U1","text":"hi <@U2>","ts":"100.5","thread_ts":"100.5"},{"user":"U2","text":"yes","ts":"101","thread_ts":"100.5"},{"subtype":"channel_join","ts":"1"},{"bot_id":"B","text":"beep","ts":"x"}]'
    df = spark.createDataFrame([("c", slack), ("d", "not json")], "channel string, export string")
    m = chat.slack(df, "export", "channel")
    assert {(r.author, r.ts, r.is_bot) for r in m.collect()} == {("U1", 100.5, False), ("U2", 101.0, False), ("", 0.0, True)}
    t = chat.ingested(chat.threaded(m, "channel"))
    assert [r.thread_text for r in t.collect()] == ["U1: hi <@U2>\nU2: yes"]
    teams = '{"value":[{"id":"1","body":{"contentType":"html","content":"<p>Hi  all</p>"},"from":{"user":{"displayName":"Ann"}},"createdDateTime":"2024-01-01T00:00:00Z"}]}'
    one = chat.teams(spark.createDataFrame([("c", teams)], "channel string, export string"), "export", "channel").first()
    assert (one.author, one.text, one.ts) == ("Ann", "Hi all", 1704067200.0)
    discord = '{"messages":[{"id":"1","content":"yo","timestamp":"2024-01-01T00:00:00+00:00","author":{"name":"Bo","isBot":false}}]}'
    assert chat.discord(spark.createDataFrame([("c", discord)], "channel string, export string"), "export", "channel").first().author == "Bo"


def test_prose_that_begins_with_on_is_no_quotation(spark):
    body = "On Monday we met.\nOn the whole\nit went well.\n\nOn Tue, 2 Jan 2024, Ann Lee wrote:\n> before"
    parts = mail.thread_parts(spark.createDataFrame([(1, body)], "id int, body string"), "body", "id").orderBy("part").collect()
    assert [(r.author, r.text) for r in parts][0] == ("", "On Monday we met.\nOn the whole\nit went well.")
    assert parts[1].author.endswith("Lee") and parts[1].text == "before" and len(parts) == 2


def test_mail(spark):
    raw = "From: Ann <a@b.org>\r\nTo: x@y, z@w\r\nSubject: A long\r\n subject\r\n\r\nNew text\n\nOn Monday, Bob wrote:\n> old text\n> > more"
    parsed = '{"from": "Cy", "to": ["a@b", "c@d"], "subject": "S", "body": "B"}'
    forwarded = "To: q\n\nsee below\n\n---------- Forwarded message ----------\nold"
    m = mail.emails(spark.createDataFrame([(1, raw), (2, parsed), (3, forwarded)], "id int, raw string"), "raw", "id")
    got = {r.id: (r.sender, r.subject, r.recipients) for r in m.collect()}
    assert got == {1: ("Ann <a@b.org>", "A long subject", ["x@y", "z@w"]), 2: ("Cy", "S", ["a@b", "c@d"]), 3: ("", "", ["q"])}
    parts = [(r.id, r.author, r.date, r.text) for r in mail.thread_parts(m, "body", "id").orderBy("id", "part").collect()]
    assert parts == [(1, "", None, "New text"), (1, "Bob", "Monday", "old text\nmore"), (2, "", None, "B"), (3, "", None, "see below"), (3, "", None, "old")]


def test_memory_facade(spark, tmp_path):
    me = access.Principal("u1", "t1")
    memory = Memory(spark, str(tmp_path / "beliefs"), me, access.Preferences(blocked_topics=["secret"]))
    rows = [("1", "sky", "is", "blue", 0.9), ("2", "sky", "is", "green", 0.4), ("3", "a secret", "is", "kept", 0.9)]
    new = spark.createDataFrame(rows, "belief_id string, subject string, predicate string, object string, confidence double").withColumn("tags", F.lit(None).cast("array<string>")).withColumn("content", F.lit(None).cast("string"))
    memory.commit(new.withColumn("observed_at", F.lit("2024-01-01").cast("timestamp_ntz")), 1)
    assert memory.beliefs().count() == 2
    assert [r.belief_id for r in memory.recall("2024-02-01", ["blue"]).collect()] == ["1", "2"]
    assert memory.what_do_you_know("sky").first().contradictions == 1
    assert memory.graph().start("sky").traverse().execute().count() == 3
    assert memory.forget(F.col("belief_id") == "2", 2) == 1 and memory.beliefs().count() == 1
    assert Memory(spark, memory.path, access.Principal("u2", "t1")).beliefs().count() == 0


def test_memory_of_every_kind(spark, tmp_path):
    me = access.Principal("u1", "t1")
    memory = Memory(spark, str(tmp_path), me)
    assert memory.beliefs().count() == 0
    memory.commit(spark.createDataFrame([("b1", "sky", "is", "blue", 0.9), ("b2", "sea", "near", "sky", 0.8)], "belief_id string, subject string, predicate string, object string, confidence double"), 1)
    memory.record(spark.sql("select 'e1' experience_id, 'saw the sky' content, timestamp_ntz'2024-01-31' occurred_at, cast(null as string) causal_parent union all select 'e2', 'rain', timestamp_ntz'2024-01-30', 'e1'"), 2)
    memory.learn(spark.sql("select 'p1' procedure_id, 'watch the sky' name, '' description, '' trigger, array('look', 'wait') steps, 0.5 confidence, 3L successes, 1L failures"), 3)
    memory.decide(spark.sql("select 'd1' decision_id, 'stay in' title, 'active' status, array(struct('b1' as belief_id, 'dry' as description, 0.9 as confidence_at_decision, true as is_critical)) assumptions"), 4)
    memory.snapshot(spark.sql("select 's1' snapshot_id, 'walk' task_context, timestamp_ntz'2024-01-01' taken_at union all select 's2', 'walk', timestamp_ntz'2024-01-02'"), 5)
    assert {(r.src, r.dst, r.edge_type) for r in memory.all("edges").collect()} == {("e1", "e2", "caused"), ("d1", "b1", "assumes")}
    assert [r.node for r in memory.neighbours("e1").collect()] == ["e2"] and [r.snapshot_id for r in memory.snapshots("walk", 1).collect()] == ["s2"]
    seen = {(r.memory_type, r.id): r.content for r in memory.recall_all("2024-02-01", ["sky"], least=0.0).collect()}
    assert seen[("experience", "e1")] == "saw the sky" and seen[("procedure", "p1")] == "watch the sky: look → wait" and ("belief", "b1") in seen and ("experience", "e2") not in seen
    assert memory.context("2024-02-01", ["sky"]).startswith("Relevant memories:\n- [belief] (sky, is, blue)")
    assert memory.context("2024-02-01", ["nothing"], least=2.0) == ""
    assert memory.set_privacy("b1", "public", 6) == 1 and memory.share("b2", "u2", 7) == 1
    other = Memory(spark, memory.path, access.Principal("u2", "t1"))
    assert {r.belief_id for r in other.beliefs().collect()} == {"b1", "b2"} and other.set_privacy("b1", "private", 8) == 0
    assert memory.save_rules([T.Detector("r1", r"\d+", "numbers"), T.Extractor("r2", "host", r"@(\w+)", description="mail hosts"), T.Detector("bad", "(")], 9) == 2
    memory.delete_rule("r1", 10)
    assert [r.id for r in memory.rules()] == ["r2"] and memory.similar_rules("a host of mail").first().rule_id == "r2"
    with pytest.raises(ValueError, match="entity_id"):
        memory.forget_request(G.ForgetRequest("entity"), 11)
    assert memory.forget_request(G.ForgetRequest("entity", entity_id="b1"), 12) == "completed" and memory.get("beliefs", "b1").count() == 0
    assert [(r.action, r.severity) for r in memory.audit().collect()] == [("forget_entity", "info")]


@pytest.mark.parametrize(("request_", "problem"), [(G.ForgetRequest("session"), "session_id"), (G.ForgetRequest("time_range"), "before or after"), (G.ForgetRequest("query"), "query"), (G.ForgetRequest("topic"), "topics"), (G.ForgetRequest("x"), "unknown")])
def test_requests_to_forget_say_what_is_missing(request_, problem):
    assert problem in request_.problems()[0] and G.ForgetRequest("all").problems() == []


def test_louvain_finds_dense_groups(spark):
    """Rings of cliques with one edge between neighbours: every clique is a community, and no labels do better."""
    rows = [(f"c{c}n{i}", f"c{c}n{j}") for c in range(6) for i in range(5) for j in range(i)] + [(f"c{c}n0", f"c{(c + 1) % 6}n1") for c in range(6)]
    e = spark.createDataFrame(rows, "src string, dst string")
    found = graph.louvain(e)
    assert {frozenset(r.m) for r in found.groupBy("community").agg(F.collect_set("node").alias("m")).collect()} == {frozenset(f"c{c}n{i}" for i in range(5)) for c in range(6)}
    q = graph.modularity(e, found).first().modularity
    assert q == pytest.approx(60 / 66 - 6 * (22 / 132) ** 2) and q >= graph.modularity(e, graph.communities(e)).first().modularity
    assert graph.louvain(e.limit(0)).count() == 0


def test_shortest_paths_equal_enumeration(spark):
    import random

    rng = random.Random(4)
    for _ in range(3):
        rows = [(str(rng.randint(0, 7)), str(rng.randint(0, 7)), "x", rng.randint(1, 9) / 10) for _ in range(18)]
        e = spark.createDataFrame(rows, "src string, dst string, edge_type string, confidence double").cache()
        start = spark.createDataFrame([("0",)], "node string")
        best = {}
        for r in graph.paths(e, start, 4).collect():
            best.setdefault(r["last"], []).append((r.length, -round(r.confidence, 9), ">".join(r.nodes)))
        for end in ("3", "5"):
            got = [(r.length, -round(r.confidence, 9), ">".join(r.nodes)) for r in graph.shortest(e, start, end, 4).collect()]
            assert got == sorted(set(best.get(end, [])))[:1]
            every = [(r.length, -round(r.confidence, 9), ">".join(r.nodes)) for r in graph.all_paths(e, start, end, 4).collect()]
            assert sorted(every) == sorted(best.get(end, []))[:10]


def test_tools_dispatch_by_name(spark, tmp_path):
    from lorebase import tools

    m = Memory(spark, str(tmp_path), access.Principal("u1", "t1"), access.Preferences().blocking("secret", "SECRET", "other").allowing("Other"))
    new = spark.createDataFrame([("b1", "sky", "is", "blue", 0.9), ("b2", "sky", "is", "green", 0.6)], "belief_id string, subject string, predicate string, object string, confidence double")
    tools.memory_tool(m).invoke("commit_belief", beliefs=new, updated_us=1)
    assert tools.query_tool(m).invoke("verify", subject="Sky", object_="BLUE").first().verdict == "contested"
    assert tools.query_tool(m).invoke("entity", name="blue").count() == 1 and tools.query_tool(m).invoke("graph", start="sky", depth=1).count() == 3
    p = tools.privacy_tool(m)
    assert not p.invoke("may_remember", text="a secret") and p.invoke("may_remember", text="other")
    more = spark.createDataFrame([("b2", "sky", "is", "grey", 0.5), ("b3", "sea", "is", "blue", 0.5), (None, "x", "y", "z", 0.1)], new.schema)
    assert p.invoke("import", rows=more, updated_us=2) == {"skipped": 1, "imported": 1, "failed": 1} and p.invoke("export").count() == 3
    assert p.invoke("forget", updated_us=3, scope="query", query="GREEN") == "completed" and p.invoke("export").count() == 2
    assert [r.action for r in p.invoke("audit").collect()] == ["forget_query"] == [r.action for r in p.invoke("access_log").collect()]
    with pytest.raises(ValueError, match="known|there are"):
        p.invoke("nothing")


def test_adapters_by_name(spark):
    from lorebase.sources import adapters

    df = spark.createDataFrame([(1, "# A\n- b\ntext"), (2, "HEADING HERE\nline")], "id int, raw string")
    assert {(r.id, r.title) for r in adapters.ingest("document", df, "raw", "id").collect()} == {(1, "A"), (2, "HEADING HERE")}
    adapters.add("lines", lambda d, raw, *keep: T.lines(d, raw, *keep))
    assert "lines" in adapters.names() and adapters.ingest("lines", df, "raw", "id").count() == 5
    with pytest.raises(ValueError, match="slack"):
        adapters.ingest("fax", df, "raw", "id")


def test_providers_and_registered_functions(spark):
    from lorebase.functions import providers

    class Loud:
        def complete(self, prompts):
            return [p.upper() for p in prompts]

        def embed(self, texts):
            return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([("one\ntwo",), (None,)], "t string")
    assert [r[0] for r in df.select(providers.completed(F.col("t"))).collect()] == ["two", ""]
    assert [r[0] for r in df.select(providers.completed(F.col("t"), Loud())).collect()] == ["ONE\nTWO", ""] and df.select(providers.embedded(F.col("t"), Loud(), "q: ")).first()[0] == [10.0]
    assert set(providers.register(spark)) == {"mended_json", "posterior_mean", "text_lines"}
    assert spark.sql("select mended_json('x [1, 2')").first()[0] == "[1]"
    assert spark.sql("select posterior_mean(0.5, c) from values (1.0D), (1.0D), (0.0D) t(c)").first()[0] == pytest.approx(0.6)
    assert [r.line for r in spark.sql("select * from text_lines('a\nb')").collect()] == ["a", "b"]


def test_similar_groups_of_copies_and_large_sets_equal_brute_force(spark):
    import random

    r = random.Random(3)
    base = [r.sample(range(60), n) for n in (1, 2, 5, 6, 8, 11, 24, 25, 26, 30, 45)]
    sets = [set(s) for s in base for _ in range(4)] + [set(s[:-1]) for s in base if s[:-1]] + [{*s, 99} for s in base] + [{*s[2:], 98} for s in base]
    df = spark.createDataFrame([(g, i) for g, s in enumerate(sets) for i in s] + [(0, None), (None, 1)], "g int, i int")
    for above in (0.8, 0.5):
        alike = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > above}
        got = [(x.a, x.b) for x in reflection.similar_groups(df, "g", "i", above).collect()]
        assert len(got) == len(alike) and set(got) == alike
        kept = []
        for g in range(len(sets)):
            if not any((k, g) in alike for k in kept):
                kept.append(g)
        assert sorted(x.g for x in reflection.first_of_similar(df.filter("g is not null"), "g", "i", above).collect()) == kept


def test_copies_meet_as_one_class(spark):
    df = spark.createDataFrame([(g, i) for g in range(3000) for i in range(6)] + [(9000, i) for i in range(7)], "g int, i int")
    classes = reflection._classes(df, "g", "i")
    assert [(x.a, x.b) for x in reflection._similar_classes(classes, 0.8).collect()] == [(0, 9000)]
    assert [x.g for x in reflection.first_of_similar(df, "g", "i").collect()] == [0]
    assert reflection.similar_groups(df, "g", "i").count() == 3000 * 2999 // 2 + 3000


def test_posteriors_are_of_means_that_were_summed_once(spark):
    from lorebase import catalogue
    from tests.conftest import SF

    assert not any("lineitem" in f for f in catalogue.queries()["beta_interval"](spark, SF).inputFiles())


def _met(sets):
    from collections import Counter
    from itertools import combinations

    return Counter(p for s in sets for p in combinations(sorted(s), 2))


def test_cooccurrences_by_tiles_equal_brute_force(spark, monkeypatch):
    import random

    r = random.Random(5)
    monkeypatch.setattr(graph, "AT_ONCE", 7)
    sets = [{f"u{i}" for i in r.sample(range(90), r.choice((1, 2, 70, 90)))} for _ in range(40)]
    df = spark.createDataFrame([(g, u) for g, s in enumerate(sets) for u in s] + [(0, next(iter(sets[0]))), (0, None), (None, "u1")], "g int, u string")
    for blocks in (1, 5, 16):
        got = {(x.a, x.b): x.weight for x in graph._tiled(df.dropna().distinct(), "g", "u", blocks).collect()}
        assert got == _met(sets)
    dense = graph.cooccurrences(df, "g", "u")
    assert "_tile_counts" in dense._jdf.queryExecution().toString() and {(x.a, x.b): x.weight for x in dense.collect()} == _met(sets)
    assert graph.cooccurrences(df.limit(0), "g", "u").count() == 0


def test_tiles_shuffle_no_copies_of_members(spark):
    """Blocks lie in one table that both sides of the tiles read; what is counted needs no exchange, and rows of a tile are batches."""
    df = spark.createDataFrame([(g, u) for g in range(30) for u in range(60)], "g int, u int")
    out = graph.cooccurrences(df, "g", "u")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and out.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1"
    assert out.count() == 60 * 59 // 2 and {x.weight for x in out.collect()} == {30}
    assert len({f for f in out.inputFiles()}) > 4 and out.rdd.getNumPartitions() >= 9  # before, one file and one task


def test_cooccurrences_take_partitions_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS", 20)
    sets = [{g % 50, g % 31 + 100, g % 7 + 200} for g in range(300)]
    out = graph.cooccurrences(spark.createDataFrame([(g, u) for g, s in enumerate(sets) for u in s], "g int, u int"), "g", "u")
    assert {(x.a, x.b): x.weight for x in out.collect()} == _met(sets)
    assert out.rdd.getNumPartitions() == 46


def test_known_facts_are_ordered_in_one_row_of_a_text(spark):
    from lorebase.operators import retrieval

    texts = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["z"]), (3, None)], "k int, c array<string>")
    beliefs = spark.createDataFrame([(f"i{i}", s, "is", o) for i, (s, o) in enumerate([("b", "a"), ("a", "c"), ("a", "d"), ("a", "e"), ("b", "b")])], "belief_id string, subject string, predicate string, object string")
    out = retrieval.known_facts(texts, beliefs, "k", F.col("c"), most=4)
    assert [(r.k, r.n, r.fact) for r in out.orderBy("k", "n").collect()] == [(1, 1, "b is a"), (1, 2, "a is c"), (1, 3, "a is d"), (1, 4, "b is b")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("row_number()") <= 2  # none but the entity's


def test_small_ranges_of_exports_grow_with_the_input():
    from lorebase.sources.exports import Reader

    r = Reader({"path": "x", "split": "16"})
    of = lambda **files: r.ranges({}, files)
    assert [(x.start, x.stop) for x in of(a=40)] == [(0, 16), (16, 32), (32, 40)]
    for size in (10**6, 10**9):
        got = of(a=size, b=7)
        assert len(got) <= 514 and got[0].start == 0 and all(x.stop == y.start for x, y in zip(got[:-2], got[1:-1], strict=True)) and got[-2].stop == size
    assert max(x.stop - x.start for x in of(a=10**12)) == 32 << 20


def test_cross_reference_shuffles_no_pair_and_keeps_rows_that_share_an_id(spark):
    said = [(i % 40 if i else None, " ".join(f"w{(i * j) % 23}" for j in range(1, 4 + i % 9)) + (" Never" if i % 7 == 0 else "")) for i in range(60)]
    heard = [(i % 30, " ".join(f"W{(i + j * j) % 29}" for j in range(2 + i % 12)) + ("\nnot" if i % 5 == 0 else "")) for i in range(50)] + [(99, " "), (98, None)]
    out = B.cross_reference(spark.createDataFrame(said, "id long, text string"), spark.createDataFrame(heard, "id long, text string"))
    want = []
    for a, s in said:
        for b, t in heard:
            x, y = set(s.lower().split()), set((t or "").lower().split())
            if x and y and len(x & y) / min(len(x), len(y)) > 0.3:
                want.append((a, b, round(len(x & y) / min(len(x), len(y)), 6), "contradict" if bool(x & set(B.NEGATIONS)) != bool(y & set(B.NEGATIONS)) else "agree"))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_communities_count_votes_once_a_round(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "e")], "src string, dst string")
    near = {(a, b) for a, b in map(tuple, e.collect())} | {(b, a) for a, b in map(tuple, e.collect())}
    label = {a: a for a, _ in near}
    for _ in range(3):
        votes = {n: [label[n]] + [label[b] for a, b in near if a == n] for n in label}
        label = {n: min(v, key=lambda x, v=v: (-v.count(x), x)) for n, v in votes.items()}
    out = graph.communities(e, 3)
    assert dict(map(tuple, out.collect())) == label
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # each round is written, no lineage grows


def test_shuffle_files_go_when_a_table_is_written(spark):
    import time
    from pathlib import Path

    from lorebase.storage import materialise

    def files():
        blocks = spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()
        return {f.name for d in blocks for f in Path(d.getPath()).rglob("shuffle_*.data")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_before = files(), spark.conf.get(key, None)
    out = materialise(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count(), "shuffled")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert out.count() == 100 and spark.conf.get(key, None) == set_before


def test_blocks_tell_shares_as_expressions_would(spark):
    """Shares by blocks against the quotient and Spark's own rounding, where halves fall on the seventh place too; words meet by no loop in Python."""
    import inspect
    import random

    from lorebase.functions import overlap

    assert "for w in" not in inspect.getsource(overlap.shared)
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(r.choice((1, 3, 10, 64)))) for _ in range(50)] + [" ".join(f"w{i}" for i in range(128)), " ".join(f"w{i}" for i in range(87, 300)), "ä ß w1", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = {i: set(t.split()) for i, t in enumerate(texts) if t}
    shares = {(a, b): len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) for a in sets for b in sets}
    want = spark.createDataFrame([(*k, v) for k, v in shares.items() if v > 0.3], "a long, b long, v double").select("a", "b", F.round("v", 6).alias("v")).collect()
    got = {(x.a_id, x.b_id): x.overlap for x in B.cross_reference(rows, rows).collect()}
    assert got == {(x.a, x.b): x.v for x in want} and (50, 51) in got and got[50, 51] == 0.320313
