"""A sequenced change applier: out-of-order changes of many clients, applied in sequence by a stateful stream.

Every client's changes carry a number.  A change is held until its number is the next one, then
it is applied; a change whose number is held or was passed is rejected.  A client that has waited
too long for a missing number jumps to the smallest one that it holds.

Changes are cut into batches by day and fed, batch by batch, to a Structured Streaming query that
is started anew for each on one checkpoint.  Its grouping key is not the client but a hash bucket
of clients: a bucket gets one tick a batch, so that clients jump even when nothing comes for
them, and all its clients are worked on together.  One lexical sort by client and number shows
the runs of consecutive numbers; which runs a jump reaches, which rows follow on the next number
and what a field holds after each row are segmented scans over that order.  No client is looped over.

State is a MapState with a composite key of client and number.  An entry takes 0.1 to 0.25 ms to
read or write, whatever it holds, so an entry is not one row but those of a ``SLOTS``-th of the
bucket's clients and ``BAND`` numbers; the clients' own entries (next number and fields) stand
at number -1.  Only entries that a batch changes are written.

One client may have a third of all rows.  Of the rows of one client, number and batch only the
first can be held, so the others are told apart before the shuffle to the buckets and go past
the state; ranks are taken by ranges of (client, number), not by client.  What is left is a row for
each number that a client has, which have to be applied one after another.

Defined cases: rows alike in all columns are one row; a null client is a client; a null number
ranks after all others; a null change id or time leaves the row out; a null or unknown operation
takes its turn and changes nothing; a balance that is no number, infinite or beyond 9e16 counts
as null; ties in day and change id go by the other columns, null first; an empty table gives an empty
result; columns besides those used, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorebase.storage import materialise, new_folder

BATCHES, FIRST_DAY, DAYS, PATIENCE = 12, 19723, 160, 3
SLOTS, BAND = 8, 4096
#: Buckets that there are at least, and rows for which there is one more.
BUCKETS, BUCKET_ROWS = 16, 20_000
#: Days before and after all others.
NEVER, ALWAYS = -(1 << 40), 1 << 40
TICK, LEAD, LATER = 0, 1, 2
FED = "kind int, bucket int, batch int, seen bigint, client bigint, n bigint, day bigint, change_id bigint, op string, city string, balance double"
GIVEN = "change_id bigint, client_id bigint, n bigint, op string, status string, batch int, missed bigint, city string, cents bigint"
_held = pa.schema([("client", pa.int64()), ("n", pa.int64()), ("day", pa.int64()), ("change_id", pa.int64()), ("op", pa.string()), ("city", pa.string()), ("balance", pa.float64())])
_own = pa.schema([("client", pa.int64()), ("next", pa.int64()), ("city", pa.string()), ("balance", pa.float64())])


def packed(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(frame[schema.names], schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpacked(parts: list[bytes], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(p).read_all() for p in parts]
    return pa.concat_tables([schema.empty_table(), *tables]).to_pandas()


def slot(client: np.ndarray) -> np.ndarray:
    return ((client.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % SLOTS


def starts(client: np.ndarray) -> np.ndarray:
    """For each row of a sort by client, where its client begins."""
    first = np.ones(len(client), dtype=bool)
    first[1:] = client[1:] != client[:-1]
    return np.maximum.accumulate(np.where(first, np.arange(len(client)), 0)) if len(client) else np.zeros(0, np.int64)


def carried(sets: np.ndarray, values: np.ndarray, begin: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What a field holds after each row: the value of the last row of its client that sets it, else what it held before."""
    last = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), -1)) if len(sets) else np.zeros(0, np.int64)
    return np.where(last >= begin, values[np.maximum(last, 0)], before)


def stepped(own: pd.DataFrame, held: pd.DataFrame, new: pd.DataFrame, batch: int, seen: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """A batch of a bucket: the clients' entries (client, next, city, balance), what is held then, and what became of rows.

    ``new``: rows with one number of a client each; ``seen``: the largest day before the batch,
    NEVER if there is none, ALWAYS after the last batch.
    """
    held = held.sort_values(["client", "n"], ignore_index=True)
    everyone = np.unique(np.concatenate([own["client"].to_numpy(), held["client"].to_numpy(), new["client"].to_numpy()]))
    own = own.set_index("client").reindex(everyone)
    next_, city, balance = own["next"].fillna(1).to_numpy(np.int64), own["city"].to_numpy(object), own["balance"].to_numpy(np.float64)
    city = np.where(pd.isna(city), None, city)

    # Jumps: whatever a client holds up to the run with its last row that is due.
    client, n = held["client"].to_numpy(), held["n"].to_numpy()
    who, begin, place = np.searchsorted(everyone, client), starts(client), np.arange(len(held))
    new_run = (place == begin) | (np.diff(n, prepend=0) != 1)
    run = np.cumsum(new_run)
    due = held["day"].to_numpy() + PATIENCE <= seen
    last_due = np.zeros(len(everyone), np.int64)
    np.maximum.at(last_due, who[due], run[due])
    jumped = run <= last_due[who]
    before = np.where(place == begin, next_[who], np.concatenate([[0], n[:-1] + 1]) if len(n) else n)
    missed = np.where(new_run & jumped, n - before, 0)
    np.maximum.at(next_, who[jumped], n[jumped] + 1)

    # New rows: rejected if their number was passed or is held.
    waiting = held[~jumped]
    at = np.searchsorted(everyone, new["client"].to_numpy())
    alike = pd.MultiIndex.from_frame(new[["client", "n"]]).isin(pd.MultiIndex.from_frame(waiting[["client", "n"]])) if len(waiting) and len(new) else np.zeros(len(new), bool)
    rejected = (new["n"].to_numpy() < next_[at]) | alike
    waiting = pd.concat([waiting, new.loc[~rejected, held.columns]] if len(waiting) else [new.loc[~rejected, held.columns]], ignore_index=True).sort_values(["client", "n"], ignore_index=True)

    # Rows that follow on the next number one after another.
    who = np.searchsorted(everyone, waiting["client"].to_numpy())
    follows = waiting["n"].to_numpy() - (np.arange(len(waiting)) - starts(who)) == next_[who]
    np.add.at(next_, who[follows], 1)

    parts = [held[jumped].assign(missed=missed[jumped]), waiting[follows].assign(missed=0)]
    done = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True).sort_values(["client", "n"], ignore_index=True)
    who, op = np.searchsorted(everyone, done["client"].to_numpy()), done["op"].to_numpy(object)
    begin, insert, delete, update = starts(who), op == "I", op == "D", op == "U"
    to_city, to_balance = done["city"].to_numpy(object), done["balance"].to_numpy(np.float64)
    city_after = carried(insert | delete | (update & ~pd.isna(to_city)), np.where(delete | pd.isna(to_city), None, to_city), begin, city[who])
    balance_after = carried(insert | delete | (update & ~np.isnan(to_balance)), np.where(delete, np.nan, to_balance), begin, balance[who])
    ends = np.flatnonzero(np.diff(who, append=-1)) if len(who) else np.zeros(0, np.int64)
    city[who[ends]], balance[who[ends]] = city_after[ends], balance_after[ends]

    cents = pd.array(np.floor(np.where(np.isnan(balance_after), 0, balance_after) * 100 + 0.5).astype(np.int64), dtype="Int64")
    cents[np.isnan(balance_after)] = pd.NA
    applied = pd.DataFrame({"change_id": done["change_id"], "client": done["client"], "n": done["n"], "op": op, "status": "applied", "batch": batch, "missed": done["missed"].astype("int64"), "city": city_after, "cents": cents})
    no = new[rejected]
    refused = pd.DataFrame({"change_id": no["change_id"], "client": no["client"], "n": no["n"], "op": no["op"], "status": "rejected", "batch": batch, "missed": 0, "city": None, "cents": pd.array([pd.NA] * len(no), dtype="Int64")})
    both = [x for x in (applied, refused) if len(x)]
    return pd.DataFrame({"client": everyone, "next": next_, "city": city, "balance": balance}), waiting[~follows], pd.concat(both, ignore_index=True) if both else applied


class Applier(StatefulProcessor):
    """A bucket of clients over a batch's tick and rows."""

    def __init__(self, nameless: int) -> None:
        self.nameless = nameless

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "client_slot int, n_band bigint", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fed = pd.concat(list(rows), ignore_index=True)
        tick, new = fed[fed["kind"] == TICK].iloc[0], fed[fed["kind"] == LEAD]
        kept = {(int(s), int(b)): bytes(v[0]) for (s, b), v in self.rows.iterator()}
        own, held = unpacked([v for (_, b), v in kept.items() if b < 0], _own), unpacked([v for (_, b), v in kept.items() if b >= 0], _held)
        after, waiting, out = stepped(own, held, new, int(tick["batch"]), int(tick["seen"]))
        changed = np.unique(slot(out["client"].to_numpy(np.int64)[out["status"].to_numpy() == "applied"]))
        self._keep(after.assign(slot=slot(after["client"].to_numpy(np.int64)), band=np.int64(-1)), _own, {(int(s), -1) for s in changed}, kept)
        of = lambda f: list(zip(slot(f["client"].to_numpy(np.int64)).tolist(), (f["n"].to_numpy(np.int64) // BAND).tolist(), strict=True))
        touched = set(of(new)) | set(of(out[out["status"] == "applied"]))
        keys = np.array(of(waiting), np.int64).reshape(-1, 2)
        self._keep(waiting.assign(slot=keys[:, 0], band=keys[:, 1]), _held, touched, kept)
        named = key[0] != self.nameless
        out["client_id"] = pd.array(out["client"].to_numpy(np.int64), dtype="Int64") if named else pd.array([pd.NA] * len(out), dtype="Int64")
        yield out[[c.split(" ")[0] for c in GIVEN.split(", ")]]

    def _keep(self, frame: pd.DataFrame, schema: pa.Schema, touched: set[tuple[int, int]], kept: dict) -> None:
        """Write the touched entries anew; those that have no rows any more go."""
        parts = {k: part for k, part in frame.groupby(["slot", "band"], sort=False)} if touched else {}
        for k in touched:
            if k in parts:
                self.rows.updateValue(k, (packed(parts[k], schema),))
            elif k in kept:
                self.rows.removeKey(k)

    def close(self) -> None:
        pass


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with n, the dense rank of seq in its client, taken by ranges of both so that no client is in one task."""
    key = [F.col("client_id"), F.col("seq").asc_nulls_last()]
    pairs = materialise(rows.select("client_id", "seq").distinct().repartitionByRange(*key).withColumn("_range", F.spark_partition_id()), "changes-pairs")
    within = pairs.withColumn("_in", F.row_number().over(Window.partitionBy("client_id", "_range").orderBy(*key[1:])))
    runs = pairs.groupBy("client_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("client_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    # Rows only for clients that lie in several ranges: fewer than there are ranges.
    ahead = runs.withColumn("_before", before).filter("_before > 0").select(F.col("client_id").alias("_c"), F.col("_range").alias("_r"), "_before")
    numbers = within.join(ahead.hint("merge"), F.col("client_id").eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r")), "left")
    numbers = numbers.select(F.col("client_id").alias("_c"), F.col("seq").alias("_s"), (F.col("_in") + F.coalesce("_before", F.lit(0))).alias("n"))
    return rows.join(numbers.hint("merge"), F.col("client_id").eqNullSafe(F.col("_c")) & F.col("seq").eqNullSafe(F.col("_s"))).drop("_c", "_s")


def prepared(changes: DataFrame, buckets: int) -> DataFrame:
    """Rows to be fed: numbered, dated, dealt to batches and buckets, the first of a client, number and batch marked."""
    rows = changes.select(*[F.col(c).cast(kind).alias(c) for c, kind in (("change_id", "bigint"), ("client_id", "bigint"), ("seq", "bigint"), ("op", "string"), ("valid_at", "timestamp_ntz"), ("source", "string"), ("segment", "string"), ("city", "string"), ("balance", "double"))]).distinct()
    h = F.crc32(F.col("change_id").cast("string"))
    rows = ranked(rows).filter((h % 11 != 0) & F.col("valid_at").isNotNull()).withColumn("day", F.datediff(F.col("valid_at").cast("date"), F.lit("1970-01-01").cast("date")) + 9 * (h % 4))
    batch = F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / DAYS))).cast("int")
    sound = F.abs("balance") < 9e16
    bucket = F.when(F.col("client_id").isNull(), buckets).otherwise(F.pmod(F.xxhash64("client_id"), F.lit(buckets))).cast("int")
    rows = rows.withColumns({"batch": batch, "bucket": bucket, "balance": F.when(sound & ~F.isnan("balance"), F.col("balance"))})
    order = F.struct("day", "change_id", "op", "valid_at", "seq", "source", "segment", "city", "balance")
    first = rows.groupBy("client_id", "n", "batch").agg(F.min(order).alias("_first")).select(F.col("client_id").alias("_c"), F.col("n").alias("_n"), F.col("batch").alias("_b"), "_first")
    met = rows.join(first.hint("merge"), F.col("client_id").eqNullSafe(F.col("_c")) & (F.col("n") == F.col("_n")) & (F.col("batch") == F.col("_b")))
    kind = F.when(order.eqNullSafe(F.col("_first")), LEAD).otherwise(LATER)
    return met.select(kind.alias("kind"), "bucket", "batch", F.lit(NEVER).alias("seen"), F.coalesce("client_id", F.lit(0)).alias("client"), F.col("n").cast("bigint").alias("n"), F.col("day").cast("bigint").alias("day"), "change_id", "op", "city", "balance")


def session_for_state(spark: SparkSession) -> SparkSession:
    """A session of its own whose streaming state lies in RocksDB, as map state needs."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Many small stores: space taken before it is needed would be most of what they take.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    # Each batch is a run of its own with stores of its own: those of earlier runs would stay open until the next maintenance.
    own.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    return own


def apply_changes(changes: DataFrame) -> DataFrame:
    """Per distinct row with an id and a time: change_id, client_id, status, batch, missed, city, cents, current, n.

    Everything of a call lies in new folders under the shared one.
    """
    spark = changes.sparkSession
    own, fed, folder = session_for_state(spark), new_folder(spark, "changes-fed"), new_folder(spark, "changes")
    buckets = BUCKETS + changes.count() // BUCKET_ROWS
    path = f"{new_folder(spark, 'changes-prepared')}/rows"
    # By batch, so that feeding one reads no other.
    prepared(changes, buckets).repartition("batch", F.pmod("bucket", F.lit(8))).write.partitionBy("batch").parquet(path)
    rows = spark.read.schema(FED).parquet(path)
    # As many rows as batches.
    largest = {r["batch"]: r["day"] for r in rows.groupBy("batch").agg(F.max("day").alias("day")).collect()}
    later = F.col("kind") == LATER
    source = own.readStream.schema(FED).parquet(fed)
    applied = source.filter(~later).groupBy("bucket").transformWithStateInPandas(Applier(buckets), GIVEN, "append", "none")
    none = lambda kind: F.lit(None).cast(kind)
    client = F.when(F.col("bucket") != buckets, F.col("client")).alias("client_id")
    passed = source.filter(later).select("change_id", client, "n", "op", F.lit("rejected").alias("status"), "batch", F.lit(0).cast("bigint").alias("missed"), none("string").alias("city"), none("bigint").alias("cents"))
    out, seen = applied.unionByName(passed), NEVER
    # Numbers are never null in what is fed, or they would reach Python as floats.
    rest = [F.lit(0).cast("bigint").alias(c) for c in ("client", "n", "day", "change_id")] + [none("string").alias("op"), none("string").alias("city"), none("double").alias("balance")]
    for batch in range(1, BATCHES + 2):
        last = F.lit(ALWAYS if batch > BATCHES else seen).alias("seen")
        ticks = spark.range(buckets + 1).select(F.lit(TICK).alias("kind"), F.col("id").cast("int").alias("bucket"), F.lit(batch).alias("batch"), last, *rest)
        ticks.unionByName(rows.filter(F.col("batch") == batch)).write.mode("append").parquet(fed)
        query = out.writeStream.format("parquet").option("path", f"{folder}/given").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        seen = max(seen, largest.get(batch, NEVER))
    given = spark.read.schema(GIVEN).parquet(f"{folder}/given")
    last = given.filter("status = 'applied'").groupBy(F.col("client_id").alias("_c")).agg(F.max("n").alias("_n"))
    met = given.join(last.hint("merge"), F.col("client_id").eqNullSafe(F.col("_c")) & (F.col("n") == F.col("_n")) & (F.col("status") == "applied"), "left")
    current = F.col("_n").isNotNull() & ~F.col("op").eqNullSafe("D")
    return met.select("change_id", "client_id", "status", "batch", "missed", "city", "cents", current.alias("current"), "n")
