"""The vector index against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.operators import vectors


def plain(rows, k):
    rows = [(i, np.array(v, float) / np.linalg.norm(v)) for i, v in rows]
    out = {}
    for q, v in rows:
        out[q] = sorted(((-round(float(v @ w), 6) + 0.0, i) for i, w in rows))[:k]
    return {q: [(i, -s + 0.0) for s, i in found] for q, found in out.items()}


@pytest.fixture(scope="module")
def table(spark):
    """Twelve groups of near vectors, a third of all alike, and vectors without a direction."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 8))
    rows = [(i, (middle[i % 12] + 0.15 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[5][1]) for i in range(120)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 3), (2003, [float("nan")] * 8)]
    return rows, spark.createDataFrame(rows + odd, "id bigint, v array<float>").repartition(4)


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


@pytest.mark.parametrize("part", [50_000, 7])
def test_exact_search(table, monkeypatch, part):
    rows, df = table
    monkeypatch.setattr(vectors, "PART", part)
    index = vectors.build(df, "id", "v", lists=12, dim=8, rounds=4)
    assert sum(index.parts.values()) >= len(index.parts) and (part > 7 or max(index.parts.values()) > 10)
    assert result(vectors.search(index, df, "id", "v", k=5, probes=1, exact=True)) == plain(rows, 5)


def test_probes_reach_their_recall(table):
    rows, df = table
    index = vectors.build(df, "id", "v", lists=12, dim=8, rounds=4)
    want, got = plain(rows, 10), result(vectors.search(index, df, "id", "v", k=10, probes=2))
    scores = [(sorted(s for _, s in want[q]), sorted(s for _, s in got[q])) for q in want]
    assert sum(sum(b >= a[0] for b in g) for a, g in scores) / (10 * len(want)) > 0.95


def test_a_search_reads_only_probed_lists(table):
    _, df = table
    index = vectors.build(df, "id", "v", lists=12, dim=8, rounds=4)
    plan = vectors.search(index, df.filter("id = 7"), "id", "v", k=3, probes=1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan


def test_nothing_to_index(table):
    _, df = table
    assert vectors.search(vectors.build(df.limit(0), "id", "v", dim=8), df, "id", "v").count() == 0
    index = vectors.build(df, "id", "v", lists=4, dim=8)
    assert vectors.search(index, df.filter(F.col("id") >= 2000), "id", "v").count() == 0
