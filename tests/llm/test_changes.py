"""The sequenced change applier against one row at a time."""

import datetime
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lorebase.llm import changes

NAMES = ["change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance"]
SCHEMA = "change_id bigint, client_id bigint, seq bigint, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def plain(rows):
    """By the contract: distinct rows, batches by day, clients row by row."""
    rows = sorted({tuple(r) for r in rows}, key=repr)
    seqs = {}
    for r in rows:
        seqs.setdefault(r[1], set()).add(r[2])
    rank = {c: {s: i + 1 for i, s in enumerate(sorted(v, key=lambda s: (s is None, s)))} for c, v in seqs.items()}
    batches = {b: [] for b in range(1, 13)}
    for change, client, seq, op, at, _, _, city, balance in rows:
        h = zlib.crc32(str(change).encode())
        if change is not None and at is not None and h % 11:
            day = (at.date() - datetime.date(1970, 1, 1)).days + 9 * (h % 4)
            batches[min(12, max(1, 1 + math.floor((day - 19723) * 12 / 160)))].append((day, change, client, rank[client][seq], op, city, balance))
    state, out, seen = {}, [], -math.inf

    def settle(client, s, batch, missed=0):
        while s["next"] in s["held"]:
            day, change, _, _, op, city, balance = s["held"].pop(s["next"])
            s["next"] += 1
            if op == "I":
                s["city"], s["balance"] = city, balance
            elif op == "U":
                s["city"], s["balance"] = (s["city"] if city is None else city), (s["balance"] if balance is None else balance)
            elif op == "D":
                s["city"] = s["balance"] = None
            s["last"], missed_ = (len(out), op), missed
            out.append([change, client, "applied", batch, missed_, s["city"], None if s["balance"] is None else math.floor(100 * s["balance"] + 0.5), False])
            missed = 0

    for batch in range(1, 14):
        for client, s in state.items():
            while s["held"] and min(r[0] for r in s["held"].values()) + 3 <= (math.inf if batch == 13 else seen):
                least = min(s["held"])
                missed, s["next"] = least - s["next"], least
                settle(client, s, batch, missed)
        for row in sorted(batches.get(batch, []), key=lambda r: r[:2]):
            s = state.setdefault(row[2], {"next": 1, "held": {}, "city": None, "balance": None, "last": None})
            if row[3] in s["held"] or row[3] < s["next"]:
                out.append([row[1], row[2], "rejected", batch, 0, None, None, False])
            else:
                s["held"][row[3]] = row
                settle(row[2], s, batch)
        seen = max([seen, *(r[0] for r in batches.get(batch, []))])
    for s in state.values():
        if s["last"] and s["last"][1] != "D":
            out[s["last"][0]][-1] = True
    return Counter(map(tuple, out))


def made(n, clients, rng, nulls=False):
    rows = []
    for i in range(n):
        client, seq = min(clients - 1, int(rng.expovariate(0.5))), rng.randint(0, n // clients)
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=min(119, max(0, seq * 120 * clients / n + rng.gauss(0, 6))))
        rows.append([i, client, seq, rng.choice("IUUUUD"), at, "web", None, rng.choice([None, "Ä", "b", "c"]), rng.choice([None, -1.005, 2.5, 1e6, 0.0])])
        if nulls:
            for column in (1, 2, 3, 4):
                if rng.random() < 0.05:
                    rows[-1][column] = None
        if rng.random() < 0.05:
            rows.append(list(rows[-1]))
    return rows


def result(df):
    return Counter((r.change_id, r.client_id, r.status, r.batch, r.missed, r.city, r.cents, r.current) for r in df.collect())


def test_changes_of_skewed_clients_with_nulls(spark):
    """A client with a third of the rows, gaps, repeated numbers and rows, nulls, another order and columns of clashing names."""
    rows = made(500, 12, random.Random(1), nulls=True) + [[None, 1, 5, "U", datetime.datetime(2024, 1, 5), None, None, "z", 1.0]]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"{SCHEMA}, bucket int, kind string, n int").select("n", "kind", "bucket", *reversed(NAMES)).repartition(3)
    assert result(changes.apply_changes(df)) == plain(rows)


def test_no_changes(spark):
    assert changes.apply_changes(spark.createDataFrame([], SCHEMA)).count() == 0


def fed(rows):
    return pd.DataFrame(rows, columns=changes._held.names).astype({"city": object, "op": object})


def stepped_through(rows, buckets):
    """All batches without Spark, with state packed and unpacked as the stream does."""
    seqs, want = {}, []
    for r in rows:
        seqs.setdefault(r[1], set()).add(r[2])
    days = {}
    for change, client, seq, op, at, _, _, city, balance in sorted({tuple(r) for r in rows}, key=repr):
        h = zlib.crc32(str(change).encode())
        day = (at.date() - datetime.date(1970, 1, 1)).days + 9 * (h % 4)
        if h % 11:
            days.setdefault(min(12, 1 + (day - 19723) * 12 // 160), []).append((client, sorted(seqs[client]).index(seq) + 1, day, change, op, city, math.nan if balance is None else balance))
    own, held, seen = {}, {}, changes.NEVER
    for batch in range(1, 14):
        for bucket in range(buckets):
            new = fed(sorted([r for r in days.get(batch, []) if r[0] % buckets == bucket], key=lambda r: r[2:4])).drop_duplicates(["client", "n"])
            new = new.astype({"client": "int64", "n": "int64", "day": "int64", "change_id": "int64", "balance": "float64"})
            after, waiting, out = changes.stepped(changes.unpacked(own.get(bucket, []), changes._own), changes.unpacked(held.get(bucket, []), changes._held), new, batch, changes.ALWAYS if batch == 13 else seen)
            own[bucket], held[bucket] = [changes.packed(after, changes._own)], [changes.packed(waiting, changes._held)]
            want += [(r.change_id, r.client, r.status, r.batch, r.missed, r.city if isinstance(r.city, str) else None, None if pd.isna(r.cents) else r.cents) for r in out.itertuples()]
        seen = max([seen, *(r[2] for r in days.get(batch, []))])
    return Counter(want)


@pytest.mark.parametrize("seed", range(6))
def test_steps_of_a_bucket(seed):
    rows = made(400, 9, random.Random(seed))
    want = Counter({k[:-1]: n for k, n in plain(rows).items() if k[2] == "applied"})
    got = Counter({k: n for k, n in stepped_through(rows, 1 + seed % 3).items() if k[2] == "applied"})
    assert got == want


def test_ranks_do_not_depend_on_ranges(spark):
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.5 else rng.randint(1, 40), rng.choice([None, *range(200)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "client_id bigint, seq bigint").repartition(5)
    own = {}
    for c, s in rows:
        own.setdefault(c, set()).add(s)
    want = Counter((c, s, sorted(own[c], key=lambda s: (s is None, s)).index(s) + 1) for c, s in rows)
    assert Counter(tuple(r) for r in changes.ranked(df).select("client_id", "seq", "n").collect()) == want


def test_carried_stays_within_clients():
    sets, values = np.array([True, False, False, True, False]), np.array([1, 2, 3, 4, 5])
    assert changes.carried(sets, values, np.array([0, 0, 2, 2, 2]), np.array([9, 9, 8, 8, 8])).tolist() == [1, 1, 8, 4, 4]


def test_state_stores_do_not_outlive_their_run(spark):
    assert changes.session_for_state(spark).conf.get("spark.sql.streaming.stateStore.unloadOnCommit") == "true"
