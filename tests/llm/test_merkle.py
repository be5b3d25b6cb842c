"""The Merkle manifest against trees built one node at a time."""

from collections import Counter
from hashlib import sha256

import pytest

from lorebase.llm import merkle
from lorebase.llm.merkle import F


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """Root, and for each leaf the siblings by level as (before, after)."""
    level, beside, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 3 * 3 : a // 3 * 3 + 3]
            beside[i].append((run[: a % 3], run[a % 3 + 1 :]))
        level, at = [h(*level[i : i + 3]) for i in range(0, len(level), 3)], [a // 3 for a in at]
    return level[0], beside


def plain(rows, changed):
    """rows: (doc_id, source, lang, n_chars, text); a Counter of result rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, h(*map(field, r)), h(*map(field, (*r[:4], changed(r)))), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    roots = [tree([x[2] for x in sorted(groups[s])]) for s in names]
    root, above = tree([r[0] for r in roots])
    out = Counter()
    for s, (subroot, beside), up in zip(names, roots, above, strict=True):
        for (_, _, leaf, folded, i), own in zip(sorted(groups[s]), beside, strict=True):
            steps = [*own, *up]
            for before, after in steps:
                folded = h(*before, folded, *after)
            out[i, leaf, subroot, root, h(*(x for before, after in steps for x in (*before, *after))), folded, folded == root] += 1
    return out


def result(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    """Groups of 1 to 400 rows, one with a third of all, a null one, nulls, repeated ids and rows, a text of a megabyte, clashing columns."""
    rows = [(i, f"s{i % 7}" if i % 3 else "hot", "en" if i % 5 else None, i, f"text {i}\n" * (i % 4)) for i in range(600)]
    rows += [(9, "s1", "en", 1, "again")] * 3 + [(None, None, None, None, None)] * 2 + [(None, "s2", None, 5, ""), (700, None, "x", 1, "ü\n日本"), (701, "lone", None, None, "a"), (702, "Ä", "de", 2, "b" * 1_000_000 + "\n")]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, level int, at int").repartition(5)


@pytest.mark.parametrize(("stride", "pending"), [(8, 100_000), (2, 3), (1, 100_000)])
def test_proofs(table, monkeypatch, stride, pending):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    monkeypatch.setattr(merkle, "PENDING", pending)
    lost = F.when(table["doc_id"] % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(table["text"])
    want = plain([tuple(r)[:5] for r in table.collect()], lambda r: r[4] if r[0] is None or r[0] % 2 or r[4] is None else r[4].replace("\n", ""))
    # Among rows alike in all but their id's place any order holds; these rows are alike in everything.
    assert result(merkle.proofs(table, {"text": lost})) == want


def test_manifest_names_the_group_that_differs(table):
    other = table.withColumn("text", F.when(F.col("doc_id") == 8, F.lit("changed")).otherwise(F.col("text")))
    one, two = ({r.source: (r.n, r.subroot) for r in merkle.manifest(t).collect()} for t in (table, other))
    assert len(one) == 11 and sum(n for n, _ in one.values()) == table.count()
    assert [s for s in one if one[s] != two[s]] == ["s1"]


def test_empty_and_single(spark, table):
    assert merkle.proofs(table.limit(0)).count() == 0
    one = merkle.proofs(table.filter("doc_id = 701")).collect()
    assert [(r.leaf == r.subroot == r.root == r.folded_root, r.proof_sha256, r.verified) for r in one] == [(True, h(), True)]
