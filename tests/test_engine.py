"""Versions, learning, packing, answers, policies and the data source against plain versions."""

import json
import math
import random
import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorebase.functions import access
from lorebase.operators import learning, reading
from lorebase.sources.exports import Exports, Range, listed, messages
from lorebase.versions import Conflict, VersionedTable

# -- versions -----------------------------------------------------------------------------------


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), "id bigint, v string")


def rows(df):
    return sorted((r.id, r.v) for r in df.collect())


def some(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id bigint, v string")


def test_versions_stay_as_they_were(spark, table):
    assert table.version() == -1 and rows(table.read()) == []
    assert table.append(some(spark, (1, "a"), (2, "b")), 10, by="x") == 0
    assert table.upsert(some(spark, (2, "c"), (3, "d")), ["id"], 20) == 1
    assert table.delete(F.col("id") == 1, 30) == 2
    assert [rows(table.read(v)) for v in range(3)] == [[(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")], [(2, "c"), (3, "d")]]
    assert rows(table.read(moment_us=25)) == rows(table.read(1)) and rows(table.read(moment_us=5)) == []
    assert sorted((r.id, r.v, r.change) for r in table.changes(0).collect()) == [(1, "a", "removed"), (2, "b", "removed"), (2, "c", "added"), (3, "d", "added")]
    assert table.restore(0, 40) == 3 and rows(table.read()) == [(1, "a"), (2, "b")]
    assert [(r.operation, r.notes) for r in table.history().collect()] == [("append", '{"by": "x"}'), ("upsert", "{}"), ("delete", "{}"), ("restore", '{"of": "0"}')]
    with pytest.raises(ValueError):
        table.read(9)


def test_two_writers(spark, table, tmp_path):
    """Appends of both stay; what was computed from an old version is refused, or done again."""
    other = VersionedTable(spark, table.path, table.schema)
    table.append(some(spark, (1, "a")), 1)
    base = table.version()
    other.append(some(spark, (2, "b")), 2)
    with pytest.raises(Conflict):
        table.replace(some(spark, (9, "z")), 3, base)
    assert table.append(some(spark, (3, "c")), 4) == 2

    class Slow(VersionedTable):
        def _commit(self, *a):
            if not hasattr(self, "met"):
                self.met = other.append(some(spark, (4, "d")), 5)
            return super()._commit(*a)

    assert Slow(spark, table.path, table.schema).upsert(some(spark, (1, "new")), ["id"], 6) == 4
    assert rows(table.read()) == [(1, "new"), (2, "b"), (3, "c"), (4, "d")]


def test_log_summaries_and_house_keeping(spark, table, monkeypatch):
    monkeypatch.setattr("lorebase.versions.SUMMARY", 3)
    for i in range(8):
        table.append(some(spark, (i, str(i))), i)
    assert len(table.files(7)) == 8 and rows(table.read(4)) == [(i, str(i)) for i in range(5)]
    assert sum("files" in table.entry(v) for v in range(8)) == 3
    lost = table.files(7)[2]
    table.data.fs.delete(table.data._path(lost), True)
    assert table.repair(9) == [lost] and rows(table.read()) == [(i, str(i)) for i in range(8) if i != 2] and table.repair(10) == []
    orphan = table._write(some(spark, (99, "x")))
    assert table.vacuum(3) == [orphan] and len(rows(table.read())) == 7


# -- posteriors ---------------------------------------------------------------------------------


def test_posteriors_have_their_moments(spark):
    cases = [(0.5, 0.5), (1.0, 1.0), (2.0, 5.0), (30.0, 3.0), (0.2, 4.0)]
    df = spark.createDataFrame([*cases, *cases, (0.0, 1.0), (None, 2.0)], "a double, b double")
    got = {(r.a, r.b): r for r in learning.sampled_posteriors(df, "a", "b", draws=6000).collect()}
    assert sorted(got) == sorted(cases)
    for (a, b), r in got.items():
        sd = math.sqrt(a * b / (a + b) ** 2 / (a + b + 1))
        assert r.mean == pytest.approx(a / (a + b), abs=5 * sd / math.sqrt(6000)) and 0 <= r.low < r.mean < r.high <= 1
    # Beta(1/2, 1/2) has a closed form.
    assert got[0.5, 0.5].low == pytest.approx(math.sin(math.pi * 0.025 / 2) ** 2, abs=0.004)
    again = {(r.a, r.b): r for r in learning.sampled_posteriors(df.repartition(7), "a", "b", draws=6000).collect()}
    assert {k: r.low for k, r in got.items()} == {k: r.low for k, r in again.items()}


# -- words and rules ----------------------------------------------------------------------------


def test_classifier(spark):
    texts = [(i, f"good calm {'river' if i % 3 else ''} w{i}", 1) for i in range(20)] + [(50 + i, f"bad noise noise v{i}", 0) for i in range(10)] + [(90, None, 1), (91, "bad", None)]
    df = spark.createDataFrame(texts, "id bigint, text string, label int")
    weights, prior = learning.word_weights(df, "id", "text", "label")
    asked = spark.createDataFrame([(1, "a good river"), (2, "bad, NOISE!"), (3, None), (4, "never seen")], "id bigint, text string")
    got = {r.id: r for r in learning.classified_texts(asked, "id", "text", weights, prior).collect()}
    assert (got[1].label, got[2].label) == (1, 0) and got[3].log_odds == got[4].log_odds == pytest.approx(prior.first()["prior"])
    ones, zeros, known = 21, 10, [(i, set(re.findall("[a-z0-9]+", (t or "").lower())), y) for i, t, y in texts if y is not None]
    odds = math.log((ones + 1) / (zeros + 1))
    for w in {w for _, ws, _ in known for w in ws}:
        p1, p0 = (sum(w in ws for _, ws, y in known if y == k) + 1 for k in (1, 0))
        p1, p0 = p1 / (ones + 2), p0 / (zeros + 2)
        odds += math.log(p1 / p0) if w in {"a", "good", "river"} else math.log((1 - p1) / (1 - p0))
    assert got[1].log_odds == pytest.approx(odds)


def test_shapes_match_what_they_come_from(spark):
    tokens = ["AB-12", "a.b@c-d.org", "+1(234)567", "x{2}|y\\z", "Ünï9", "#1!", "a^b$c", "[q]"]
    for level in range(learning.LEVELS):
        for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", learning.shape(F.col("t"), level).alias("p")).collect():
            assert re.fullmatch(r.p, r.t), (level, r)
    wide = spark.createDataFrame([("AB-12",), ("C-3456",)], "t string").select(learning.shape(F.col("t"), 1).alias("p")).distinct()
    assert [r.p for r in wide.collect()] == [r"[A-Z]+\-[0-9]+"]


def test_rules_are_learned_and_measured(spark):
    rng = random.Random(3)
    code = lambda: ("".join(rng.choices("ABCDE", k=rng.randint(2, 4))) + "-" + str(rng.randint(10, 99999)), "code")
    word = lambda: (rng.choice(["Stone", "river", "A-b", "12", "x-1"]), None)
    spans = spark.createDataFrame([*(code() for _ in range(80)), *(word() for _ in range(300)), ("ZZ-1", None)], "token string, label string")
    rules = learning.learned_rules(spans, "token", "label")
    assert [(r.pattern, r.entity_type, r.level) for r in rules.collect()] == [(r"[A-Z]+\-[0-9]+", "code", 1)] and rules.first()["precision"] == pytest.approx(80 / 81)
    held = spark.createDataFrame([("QQQQQ-7", "code"), ("q-7", "code"), ("K-1", None), ("k", None)], "token string, label string")
    assert [(r.entity_type, r.found, r.right, r.present, r.precision, r.recall) for r in learning.rule_quality(held, "token", "label", rules).collect()] == [("code", 2, 1, 2, 0.5, 0.5)]
    assert learning.learned_rules(spans.limit(0), "token", "label").count() == 0


# -- reading ------------------------------------------------------------------------------------


@pytest.mark.parametrize("stretch", [5000, 7])
def test_packing(spark, monkeypatch, stretch):
    monkeypatch.setattr(reading, "STRETCH", stretch)
    rng = random.Random(5)
    texts = [(rng.choice(["a", "b", None]), i, rng.choice(["x", "é", "z "]).strip() * rng.randint(0, 40)) for i in range(60)] + [("b", 99, "L" * 500), ("b", None, "n"), ("a", 7, None), ("a", 8, "  ")]
    order = sorted((t for t in texts if (t[2] or "").strip()), key=lambda t: (t[0] is not None, t[0] or "", t[1] is not None, t[1] or 0, t[2]))
    want, last = [], None
    for place, (group, _, text) in enumerate(order, 1):
        text, same = text[:100], last is not None and last[0] == group and last[3] == (place - 1) // stretch
        if same and len(last[2]) + 7 + len(text) <= 100:
            last[2] += "\n\n---\n\n" + text
            last[4] += 1
        else:
            last = [group, place, text, (place - 1) // stretch, 1]
            want.append(last)
    got = reading.packed(spark.createDataFrame(texts, "g string, i bigint, t string").repartition(4), "g", ["i"], "t", cap=100).collect()
    assert sorted((r.g or "", r.first, r.chunk, r.texts, r.chars) for r in got) == sorted((w[0] or "", w[1], w[2], w[4], len(w[2])) for w in want)
    assert max(r.chars for r in got) == 100


ANSWER = {
    1: '```json\n{"facts": [{"subject": "Sun", "predicate": "is", "object": "Star", "confidence": 2}, {"subject": " ", "object": "x"}]}\n```', 2: 'Well: {"events": [{"actor": "a", "action": "b", "target": "c", "confidence": "0.4"}]} ok', 3: '[{"subject": "sun", "predicate": "IS", "object": "star"}, 5]',
    4: '{"facts": [{"subject": "cut', 5: "nothing", 6: None, 7: '{"facts": "none", "relationships": [{"entity_a": "a", "relation": null, "entity_b": "b", "confidence": "?"}]}', 8: '{"facts": [1, 2}', 9: "{}",
}


def test_answers(spark):
    good, bad = reading.extracted(spark.createDataFrame(list(ANSWER.items()), "id bigint, a string"), "id", "a")
    assert sorted((r.id, r.kind, r.subject, r.predicate or "", r.object, r.confidence) for r in good.collect()) == [(1, "facts", "Sun", "is", "Star", 0.95), (2, "events", "a", "b", "c", 0.4), (3, "facts", "sun", "IS", "star", 0.7), (7, "relationships", "a", "", "b", 0.7)]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [(1, "incomplete"), (3, "incomplete"), (4, "no json"), (5, "no json"), (6, "no json"), (8, "broken json")]
    one = {(r.kind, r.subject): (r.occurrences, r.confidence, r.evidence) for r in reading.distinct_patterns(good).collect()}
    assert one["facts", "sun"] == (2, 0.95, [1, 3]) and len(one) == 3


# -- policies -----------------------------------------------------------------------------------


def test_policies_are_rows(spark):
    def made(*rows_):
        return spark.createDataFrame(list(rows_), access.POLICIES)

    first = made(("a", 5, "x > 1", True, 1, False), ("b", 9, "x > 3", False, 1, None), ("c", 1, "y = 'k'", True, 1, False))
    data = spark.createDataFrame([(1, "k"), (2, None), (4, "k"), (None, None)], "x int, y string")
    said = lambda t: [(r.s.allowed, r.s.policy) for r in data.select(access.decided(access.policies_of(t, ["x int", "y string"])).alias("s")).collect()]
    assert said(first) == [(True, "c"), (True, "a"), (False, "b"), (False, "default")]
    assert said(first.unionByName(made(("b", 9, "x > 3", False, 2, True), ("a", 5, "x > 2", True, 2, False)))) == [(True, "c"), (False, "default"), (True, "a"), (False, "default")]
    for broken in ("x >", "x + 1", "z = 1"):
        with pytest.raises(ValueError, match="policy bad"):
            access.policies_of(made(("bad", 1, broken, True, 1, False)), ["x int", "y string"])
    assert access.policies_of(made(), ["x int"]) == []


# -- the data source ----------------------------------------------------------------------------


def mailbox(n, rng):
    return "".join(f"From {i}\nSubject: {i}\n\n" + "".join(rng.choice(["ü\n", ">From x\n", "\n", "line\n"]) for _ in range(rng.randint(0, 6))) for i in range(n))


def plain_mails(text):
    parts = re.split(r"(?m)^From .*\n", text)[1:]
    return [p.removesuffix("\n") for p in parts]


def test_ranges_of_any_size_read_each_message_once(tmp_path):
    text = "before\n" + mailbox(30, random.Random(1))
    (tmp_path / "m").write_text(text)
    size = len(text.encode())
    for split in (1, 7, 50, 10**6):
        for kind, want in (("mbox", plain_mails(text)), ("lines", [x for x in text.split("\n") if x.strip()])):
            with (tmp_path / "m").open("rb") as f:
                got = [m for a in range(0, size, split) for m in messages(f, kind, Range("m", a, min(size, a + split), size))]
            assert [raw for _, _, raw in got] == want and len({at for _, at, _ in got}) == len(got)


def test_source_in_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(Exports)
    rng, folder = random.Random(2), tmp_path / "in"
    folder.mkdir()
    one, two = mailbox(20, rng), mailbox(9, rng)
    (folder / "a").write_text(one)
    (folder / "b").write_text("")
    (folder / ".hidden").write_text(two)
    read = spark.read.format("lorebase_exports").option("path", str(folder)).option("split", 64).load()
    assert read.rdd.getNumPartitions() > 5 and sorted(r.raw for r in read.collect()) == sorted(plain_mails(one)) and listed(str(tmp_path / "none")) == {}

    def drained():
        stream = spark.readStream.format("lorebase_exports").option("path", f"file://{folder}").option("split", 64).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return Counter(r.raw for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert drained() == Counter(plain_mails(one))
    with (folder / "a").open("a") as f:
        f.write(two)
    (folder / "c").write_text(two)
    assert drained() == Counter(plain_mails(one)) + Counter(plain_mails(two)) + Counter(plain_mails(two))
    with pytest.raises(Exception, match="unknown kind"):
        spark.read.format("lorebase_exports").option("path", str(folder)).option("kind", "zip").load().count()


def test_moments(spark, table):
    """A policy table read by moment, as decisions of the past need it."""
    table.append(some(spark, (1, json.dumps({"at": str(datetime(2024, 1, 1))}))), 5)
    assert table.at(4) == -1 and table.at(5) == 0


def test_patterns_of_all_kinds_are_read_in_one_pass_and_evidence_is_the_smallest_ids(spark):
    from lorebase.operators import reading

    fact, rest = '{"subject": "A", "predicate": "p", "object": "B"}', '"events": [{"actor": "x", "action": "y", "target": "z"}], "relationships": "none"'
    rows = [(i, f'{{"facts": [{fact}, {fact.lower()}, {{"subject": "A"}}], {rest}}}') for i in range(300, 0, -1)] + [(0, f"[{fact}]"), (-1, "no")]
    good, bad = reading.extracted(spark.createDataFrame(rows, "id long, answer string"), "id", "answer")
    assert good._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r.kind: (r.subject, r.object, r.confidence, r.occurrences, r.evidence) for r in reading.distinct_patterns(good).collect()}
    assert got == {"facts": ("a", "b", 0.7, 601, list(range(10))), "events": ("x", "z", 0.7, 300, list(range(1, 11)))}
    assert bad.filter("reason = 'incomplete'").count() == 300 and bad.filter("reason = 'no json'").count() == 1
