"""Streaming jobs on small folders of files."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lorebase.streaming import jobs, late
from lorebase.streaming.ledger import Files, Ledger
from tests.conftest import SF


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:20:00"), ("u", "2024-01-01 03:00:00"), ("end", "2030-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "u string, ts string").select("u", F.to_timestamp("ts").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = jobs.sessions(stream, "u", "ts").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.members for r in spark.table("closed").collect()) == [1, 2]


def test_reflection_takes_each_row_once(spark, tmp_path):
    for i in range(2):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen, dreams = [], []
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = jobs.reflect(stream, lambda df, i: seen.append(df.count()), str(tmp_path / "c"), dreams.append, every=2)
        q.awaitTermination(60)
        q.stop()
    assert sum(seen) == 20 and dreams == [1]


def fed(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


WRITES = "owner_id string, key string, value string, at timestamp, ttl_ms bigint"


def remembered(spark, tmp_path, parts, late="1 hour"):
    """What working memory emits for parts, each fed to a stream that is started anew."""
    own = jobs.stateful(spark)
    stream, out = None, str(tmp_path / "out")
    for part in parts:
        fed(own, [(o, k, v, datetime.fromisoformat(at), ttl) for o, k, v, at, ttl in part], WRITES, str(tmp_path / "in"))
        stream = own.readStream.schema(WRITES).parquet(str(tmp_path / "in"))
        jobs.working_memory(stream, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.key or "", r.value or "", r.live) for r in spark.read.schema(jobs.LIVE).parquet(out).collect())


def test_a_value_ends_with_its_life(spark, tmp_path):
    """A value lives by event time: a key that nothing comes for any more ends when the watermark passes its end, also after a restart."""
    hour = 3_600_000
    parts = [[("u", "short", "1", "2024-01-01T00:00:00", hour), ("u", "long", "2", "2024-01-01T00:00:00", 9 * hour)], [("u", "other", "3", "2024-01-01T03:00:00", hour)]]
    assert remembered(spark, tmp_path, parts) == [("long", "2", True), ("other", "3", True), ("short", "", False), ("short", "1", True)]


def test_latest_is_by_event_time(spark, tmp_path):
    day = 86_400_000
    parts = [[("u", "k", "new", "2024-01-02T00:00:00", day), ("u", "k", "newer", "2024-01-02T00:30:00", day)], [("u", "k", "old", "2024-01-01T23:50:00", day), ("u", "k", "newest", "2024-01-02T00:40:00", day), ("u", None, "x", "2024-01-02T00:40:00", day)]]
    assert [x for x in remembered(spark, tmp_path, parts) if x[0] == "k"] == [("k", "newer", True), ("k", "newest", True)]


def test_a_batch_that_is_killed_before_its_commit_counts_once(spark, tmp_path):
    """The step writes, the driver is lost before the commit; the batch runs again; a batch that is committed runs no more."""
    ledger, killed = Ledger(spark, str(tmp_path / "l"), "q"), []

    def kill(batch_id):
        if batch_id == 1 and not killed:
            killed.append(batch_id)
            raise RuntimeError("lost")

    def start():
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return stream.writeStream.foreachBatch(ledger.run(lambda df, i: {"rows": df.withColumn("batch", F.lit(i))}, kill)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    assert ledger.table("rows", "id bigint, batch int").count() == 10 and killed == [1]
    start().awaitTermination()
    assert sorted(r.id for r in ledger.table("rows", "id bigint, batch int").collect()) == list(range(30))
    # A batch that the checkpoint forgot and the ledger has.
    ledger.run(lambda df, i: {"rows": df.withColumn("batch", F.lit(i))})(spark.range(10), 0)
    other = Ledger(spark, str(tmp_path / "l"), "other")
    other.run(lambda df, i: {"rows": df.withColumn("batch", F.lit(i))})(spark.range(5), 0)
    assert ledger.table("rows", "id bigint, batch int").count() == 30 and other.table("rows", "id bigint, batch int").count() == 5
    assert ledger.compact_log(1) == 2 and ledger.table("rows", "id bigint, batch int").count() == 30
    assert len(list((tmp_path / "l" / "q" / "rows").iterdir())) == 3


def test_only_one_creates_a_file(spark, tmp_path):
    files = Files(spark, str(tmp_path / "f"))
    assert files.create("a", "one") and not files.create("a", "two") and files.read("a") == "one" and files.names() == ["a"]


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    schema, ledger = "id bigint, at timestamp_ntz, v double", Ledger(spark, str(tmp_path / "l"), "w")
    parts = [[(1, "2024-01-01T10:10", 1.0), (2, "2024-01-01T12:00", 2.0)], [(3, "2024-01-01T10:50", 4.0), (4, "2024-01-01T11:20", 8.0), (5, None, 16.0), (6, "2024-01-01T15:00", None)]]
    step = late.parted(ledger, "at", "1 hour", "1 hour", F.col("v"), ["id"])
    for part in parts:
        fed(spark, [(i, at and datetime.fromisoformat(at), v) for i, at, v in part], schema, str(tmp_path / "in"))
        spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(ledger.run(step)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.id, r.watermark.hour) for r in ledger.table("late", "id bigint, watermark timestamp_ntz").collect()] == [(3, 11)]
    got = sorted((r.start.hour, r.n, r.total, r.closed) for r in late.counts(ledger, "1 hour").collect())
    assert got == [(10, 1, 1.0, True), (11, 1, 8.0, True), (12, 1, 2.0, True), (15, 1, None, False)]


def test_streams_meet_by_key_and_slice_of_time(spark, tmp_path):
    at = lambda *s: [(i, 1, f"2024-01-01 {x}") for i, x in enumerate(s)]
    for name, rows in (("l", at("00:00:00", "00:09:59", "01:00:00")), ("r", at("00:00:00", "00:10:00", "00:20:00", "00:59:59", "01:10:00"))):
        df = spark.createDataFrame(rows, "id int, k int, at string").withColumn("at", F.col("at").cast("timestamp"))
        df.write.parquet(str(tmp_path / name))
    left, right = (spark.readStream.schema(df.schema).parquet(str(tmp_path / n)) for n in ("l", "r"))
    out = late.joined(left, right, "k", "at", "at", "10 minutes", "1 day")
    assert out.columns == ["id", "k", "at", "r_id", "r_k", "r_at"] and "_slice" in out._jdf.queryExecution().analyzed().toString()
    got = jobs.drained(out.select("id", "r_id"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0), (0, 1), (1, 1), (2, 4)]


def test_streams_meet_by_tables_and_hold_no_state(spark, tmp_path):
    """Batches over a watermark, one of them run again, against all pairs; what can't be met any more goes."""
    rng, schema, ledger = random.Random(4), "id int, k int, at timestamp", Ledger(spark, str(tmp_path / "l"), "j")
    start, near = datetime(2024, 1, 1), timedelta(minutes=10)
    row = lambda i, m, k=None: (i, rng.choice([1, 1, 2, None]) if k is None else k, start + timedelta(seconds=m))
    given = {s: [[row(1000 * p + i, 3600 * p + rng.randrange(-600, 3600)) for i in range(60)] for p in range(3)] for s in "ab"}
    given["a"][0] += [(-1, 1, None), row(-2, 3599, 1)]
    given["b"][1] += [row(-3, 3599 + 600, 1), row(-4, 3599 + 601, 1)]
    given["b"][2] += [row(-5, 0, 1)]  # behind the watermark
    step, failing = late.meeting(ledger, "k", "at", "10 minutes", "15 minutes"), []
    for p in range(3):
        sides = []
        for s in "ab":
            fed(spark, given[s][p], schema, str(tmp_path / s))
            sides.append(spark.readStream.schema(schema).parquet(str(tmp_path / s)))

        def lost(batch_id):
            if batch_id == 1 and not failing:
                failing.append(batch_id)
                raise RuntimeError("the driver is lost")

        run = lambda: late.both(*sides).writeStream.foreachBatch(ledger.run(step, lost)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()  # noqa: B023, E731
        if p == 1:
            with pytest.raises(StreamingQueryException):
                run()
        run()
    a, b = (sum(given[s], []) for s in "ab")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] is not None and x[2] and x[2] <= y[2] <= x[2] + near and y[0] != -5)
    assert sorted((r.id, r.r_id) for r in ledger.table("met", "id int, r_id int").collect()) == want and (-2, -3) in want and (-2, -4) not in want
    mark = min(max(x[2] for x in side if x[2]) for side in (a, b)) - timedelta(minutes=15)
    held = [ledger.last(n, schema, 3).collect() for n in ("left", "right")]
    assert all(held) and min(r.at for r in held[0]) >= mark - near and min(r.at for r in held[1]) >= mark
    assert not (tmp_path / "c" / "state").exists()


def test_sales_meet_clicks_without_state(spark):
    from lorebase import catalogue

    out = catalogue.queries()["stream_join_sales"](spark, SF)
    assert not any((folder / "checkpoint" / "state").exists() for f in out.inputFiles() for folder in list(Path(f.split(":", 1)[1]).parents)[:4])


def test_keys_of_one_slot_share_a_state_and_end_each_in_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "SLOTS", 1)
    own, fed, out = jobs.stateful(spark), str(tmp_path / "in"), str(tmp_path / "out")
    schema = "owner_id string, key string, value string, ms long, ttl_ms long"
    first = [("a", "k", "1", 1000, 5000), ("b", "k", None, 1000, 5001), ("c", "k", "1", 1000, 4999), ("d", "k", "2", 1000, 9000), ("d", "k", "3", 900, 1), (None, "k", "1", 1000, 4000), ("a", None, "1", 1000, 9000)]
    for part in (first, [("e", "k", "1", 7000, 100000), ("d", "k", "1", 1000, 1)]):
        own.createDataFrame(part, schema).withColumn("at", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(fed)
        stream = own.readStream.schema("owner_id string, key string, value string, ttl_ms bigint, at timestamp").parquet(fed)
        jobs.working_memory(stream, "1 second").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = [tuple(r) for r in spark.read.schema(jobs.LIVE).parquet(out).collect()]
    live = {(a, b, c, 1_000_000, True) for a, b, c in [("a", "k", "1"), ("b", "k", None), ("c", "k", "1"), ("d", "k", "2"), (None, "k", "1"), ("a", None, "1")]} | {("e", "k", "1", 7_000_000, True)}
    assert len(rows) == 10 and set(rows) == live | {(o, "k", None, 1_000_000, False) for o in ("a", "c", None)}
