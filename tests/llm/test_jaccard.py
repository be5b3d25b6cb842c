"""The n-gram Jaccard join against all pairs."""

import itertools
import random

import numpy as np
import pytest

from lorebase.llm import jaccard
from tests.llm.test_operators import by_id, lower, words


def plain_set(text, n=5):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain_components(sets, percent=80):
    """By id: the smallest id that links between sets reach."""
    root = {i: i for i in sets}

    def up(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = up(a), up(b)
            root[max(x, y)] = min(x, y)
    return {i: up(i) for i in sets}


def crowd(rng, n, words_, edits, base=None):
    """Copies of one text, each with words changed in so many places."""
    base = base or [f"w{rng.randrange(5000)}" for _ in range(words_)]
    for _ in range(n):
        text = list(base)
        for at in rng.sample(range(words_), rng.choice(edits)):
            text[at] = f"x{rng.randrange(10**6)}"
        yield " ".join(text)


def test_components(docs, rows):
    got = by_id(jaccard.jaccard_components(docs))
    sets = {r.doc_id: plain_set(r.text) for r in rows}
    assert {i: (g.n_shingles, g.component_id) for i, g in got.items()} == {i: (len(sets[i]), c) for i, c in plain_components(sets).items()}


@pytest.mark.parametrize(("short", "tile", "worth"), [(12, 128, 20), (2, 8, 1), (2, 8, 10**9), (10**6, 8, 1)])
def test_crowds_lose_no_link(spark, monkeypatch, short, tile, worth):
    """Crowds about the bound, most pairs of which are not linked; a passage in many texts; by turns, by pairs and by tiles."""
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "WORTH", worth)
    rng = random.Random(11)
    texts = [*crowd(rng, 90, 120, [0, 1, 2, 3]), *crowd(rng, 40, 60, [2, 3]), *crowd(rng, 30, 12, [0, 1])]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["", None, " \t", "one", "ONE", "one two", *texts[:5]]
    sets = {i: plain_set(t) for i, t in enumerate(texts)}
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)))
    assert {i: (g.n_shingles, g.component_id) for i, g in got.items()} == {i: (len(sets[i]), c) for i, c in plain_components(sets).items()}


def test_nulls_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i % 9973}y{i % 31}" for i in range(150_000))
    text = "a b c d e f g h i j"
    rows = [(1, text), (1, text), (1, "other words altogether here now"), (None, text), (None, "only nameless ones have this text"), (5, long), (6, long + " end"), (None, None), (7, "")]
    df = spark.createDataFrame([(*r, 1, "x", "y", 0) for r in rows], "doc_id bigint, text string, node int, digest string, token string, n int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=repr)
    n = len(plain_set(long))
    assert got == sorted([(1, 6, 1), (1, 6, 1), (1, 1, 1), (None, 6, 1), (None, 2, None), (5, n, 5), (6, len(plain_set(long + " end")), 5), (None, 0, None), (7, 0, 7)], key=repr)


def test_empty_table(docs):
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_what_is_listed_meets():
    """Sets that are just linked share at least a tenth of their size among what both list."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        common, one, two = (np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (rng.integers(1, 200), rng.integers(0, 25), rng.integers(0, 25)))
        a, b = np.union1d(common, one), np.union1d(common, two)
        if 100 * len(common) >= 80 * len(np.union1d(a, b)):
            least = max(1, -(-(min(len(a), len(b)) * 80 // 100) // 10))
            assert len(np.intersect1d(jaccard.listed(a, 80), jaccard.listed(b, 80))) >= least
