"""Merkle manifest of a table: a digest for every row, a tree for every group, one root, and proofs.

A leaf is the digest of a row's columns.  The leaves of a group, in order of id, are put together
by ``ARITY`` until one node is left, the group's subroot; the subroots, in order of the groups'
names, are put together the same way to the root.

Trees grow by events, as in ``combineByKey``: a task keeps partial parents, each with the digests
of those of its children that have come, by their place.  How many it waits for follows from the
tree's size.  The last one completes it: its digest is sent on as a child of its own parent at
once, so a task climbs as far as its rows reach, and the links from the parent back to its children are
written.  The leaves lie in order, so this first pass combines nearly everything where it
lies; what is left over, the frontier at the edges of the tasks, is shuffled to the task of its
ancestor ``STRIDE`` levels up, and combined again, until only roots are left: as many rounds as
the tree has strides of eight levels.

Proofs go down the links: a child's proof is its siblings and then its parent's proof.  Going down
is dealt out the same way, by ancestors a stride up, so that a task holds the links and leaves
below one such ancestor (at most 3 ** 8 leaves) at a time, whatever the size of a group.  Places in a
group come from one range partitioning by group and id, so no group is ever in one task.

Defined cases: a null field is digested as ``-``, so null and empty differ; a null group is a
group, the first; null ids come first in their group; rows of one id go by their leaf, and rows
alike in everything take neighbouring places; a long text is digested whole, in its row; an empty
table has no rows and no root; columns besides those that are digested, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.storage import globally_ranked, materialise

ARITY, STRIDE = 3, 8
#: Partial parents that a task keeps before it passes them on as they are.
PENDING = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LINK, OPEN, TOP = 0, 1, 2
GROWN = "kind int, tree bigint, n bigint, level int, at bigint, data binary"
PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
_int, _long = pa.int32(), pa.int64()
_grown = pa.schema([("kind", _int), ("tree", _long), ("n", _long), ("level", _int), ("at", _long), ("data", pa.binary())])
_paths = pa.schema([("tree", _long), ("level", _int), ("at", _long), ("path", pa.string())])
_proof = pa.schema([("doc_id", _long), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]])


def digest(*fields: Column) -> Column:
    """SHA-256 of fields one after another, each its length in bytes, a colon and itself, or ``-`` if null."""
    own = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in own]), 256)


def together(children: list[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def depth(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    level, width = 0, 1
    while width < n:
        level, width = level + 1, width * ARITY
    return level


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(schema), schema, strict=True)], schema=schema)


def combined(rows: Iterator[tuple[int, int, int, int, bytes]], most: int | None = None) -> Iterator[tuple]:
    """From nodes (tree, n, level, at, digest): links, tops, and at the end what stays open."""
    partial: dict[tuple[int, int, int], tuple[int, dict[int, bytes]]] = {}

    def passed_on() -> Iterator[tuple]:
        for (tree, level, at), (n, children) in partial.items():
            for i, child in children.items():
                yield OPEN, tree, n, level - 1, at * ARITY + i, child
        partial.clear()

    for tree, n, level, at, own in rows:
        top = depth(n)
        while level < top:
            key = (tree, level + 1, at // ARITY)
            children = partial.setdefault(key, (n, {}))[1]
            children[at % ARITY] = own
            width = -(-n // ARITY**level)
            if len(children) < min(ARITY, width - ARITY * key[2]):
                break
            del partial[key]
            ordered = [children[i] for i in range(len(children))]
            level, at, own = level + 1, key[2], together(ordered)
            yield LINK, tree, n, level, at, b"".join(ordered)
        else:
            yield TOP, tree, n, level, at, own
        if most and len(partial) > most:
            yield from passed_on()
    yield from passed_on()


def block(stride: int) -> Column:
    """Which ancestor at the level ``STRIDE * stride`` a node lies below."""
    power = F.element_at(F.array(*[F.lit(ARITY**i).cast("bigint") for i in range(STRIDE + 1)]), F.lit(STRIDE * stride + 1) - F.col("level"))
    return F.floor((F.col("at") - F.pmod("at", power)) / power).cast("bigint")


def grown(leaves: DataFrame, label: str) -> DataFrame:
    """Links and tops of the trees of leaves (tree, n, at, digest)."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        yield from batched(combined(rows, PENDING), _grown)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        yield from batched(combined(rows), _grown)

    node = ["tree", "n", "level", "at", "data"]
    first = leaves.select("tree", "n", F.lit(0).alias("level"), "at", F.col("digest").alias("data"))
    made = materialise(first.sortWithinPartitions("tree", "at").mapInArrow(combine, GROWN), label)
    every, stride = made.filter(F.col("kind") != OPEN), 0
    while not (frontier := made.filter(F.col("kind") == OPEN)).isEmpty():
        # A frontier node below the next stride meets all others of its ancestor there; one above it waits.
        stride += 1
        low = F.col("level") < STRIDE * stride
        met = frontier.filter(low).withColumn("_block", block(stride)).repartition("tree", "_block").sortWithinPartitions("tree", "_block", "level", "at")
        made = materialise(met.select(*node).mapInArrow(merge, GROWN).unionByName(frontier.filter(~low)), label)
        every = every.unionByName(made.filter(F.col("kind") != OPEN))
    return every


def passed_down(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Paths from rows (tree, block, kind, level, at, path, data, ...) of whole blocks, each the paths above, then links from above to below, then leaves.

    Yields (row, path) of every leaf; a path is what to put beside a node on each level up, and then the subroot.
    """
    own, known = None, {}
    for row in rows:
        tree, block_, kind, level, at = row[:5]
        if own != (tree, block_):
            own, known = (tree, block_), {}
        if kind == 0:
            known[level, at] = (row[5], None)
        elif kind == 1:
            above, data = known.pop((level, at)), row[6].hex()
            children = [data[i : i + 64] for i in range(0, len(data), 64)]
            for i in range(len(children)):
                known[level - 1, at * ARITY + i] = (f"{i}{''.join(children[:i] + children[i + 1 :])}", above)
        else:
            yield row, known[level, at]


def flat(path: tuple | None) -> str:
    parts = []
    while path is not None:
        parts.append(path[0])
        path = path[1]
    return ",".join(parts)


def descended(links: DataFrame, tops: DataFrame, leaves: DataFrame, strides: int, label: str) -> DataFrame:
    """Rows of the last stride, to be passed down: leaves (tree, at, doc_id, data, other) with the links and paths above them.

    ``tops``: (tree, level, at, path) of every tree.
    """
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["tree", "_block", "kind", "level", "at", "path", "data", "other", "doc_id"]

    def rows(stride: int, paths: DataFrame, below: DataFrame) -> DataFrame:
        inside = (F.col("level") > STRIDE * (stride - 1)) & (F.col("level") <= STRIDE * stride)
        a = paths.select("tree", F.lit(0).alias("kind"), "level", "at", "path", none("binary").alias("data"), none("binary").alias("other"), none("bigint").alias("doc_id"))
        b = links.filter(inside).select("tree", F.lit(1).alias("kind"), "level", "at", none("string").alias("path"), "data", none("binary").alias("other"), none("bigint").alias("doc_id"))
        c = below.select("tree", F.lit(2).alias("kind"), "level", "at", none("string").alias("path"), "data", "other", "doc_id")
        all_ = a.unionByName(b).unionByName(c).withColumn("_block", block(stride))
        return all_.repartition("tree", "_block").sortWithinPartitions("tree", "_block", "kind", F.col("level").desc(), "at").select(*columns)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = passed_down(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        yield from batched(((r[0], r[3], r[4], flat(path)) for r, path in found), _paths, 1024)

    paths = tops.limit(0)
    for stride in range(strides, 0, -1):
        paths = paths.unionByName(tops.filter((F.col("level") <= STRIDE * stride) & (F.col("level") > (STRIDE * (stride - 1) if stride > 1 else -1))))
        if stride == 1:
            break
        # The nodes a stride further down, which are the children of links.
        lowest = links.filter(F.col("level") == STRIDE * (stride - 1) + 1).select("tree", "at", F.posexplode(F.sequence(F.lit(1), (F.octet_length("data") / 32).cast("int"))).alias("i", "_"))
        nodes = lowest.select("tree", F.lit(STRIDE * (stride - 1)).alias("level"), (F.col("at") * ARITY + F.col("i")).alias("at"), none("binary").alias("data"), none("binary").alias("other"), none("bigint").alias("doc_id"))
        paths = materialise(rows(stride, paths, nodes).mapInArrow(descend, "tree bigint, level int, at bigint, path string"), label)
    return rows(1, paths, leaves.withColumn("level", F.lit(0)))


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their tree, its size and their place in it; and the trees by source."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_any")]
    # A place within a range of the order is what monotonically_increasing_id counts there.
    dealt = materialise(leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("_any").withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    dealt = dealt.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    # As many rows as ranges and sources together.
    runs = dealt.groupBy("source", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    by = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialise(runs.withColumns({"_before": F.coalesce(F.sum("_n").over(by), F.lit(0)), "n": F.sum("_n").over(Window.partitionBy("source"))}), "merkle-runs")
    trees = materialise(globally_ranked(runs.groupBy("source").agg(F.first("n").alias("n")), F.col("source").asc_nulls_first(), name="tree"), "merkle-trees")
    named = materialise(runs.join(trees.select(F.col("source").alias("_s"), "tree"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_before", "_first", "n", "tree"), "merkle-runs")
    met = dealt.join(named, (F.col("_range") == F.col("_r")) & F.col("source").eqNullSafe(F.col("_s")))
    return met.select("tree", "n", (F.col("_before") + F.col("_at") - F.col("_first")).alias("at"), "doc_id", "leaf", "tampered"), trees


def proofs(docs: DataFrame, tampered: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A proof is what lies beside a row's node on every level up to the root; its digest is given.
    ``folded_root`` is the root that the proof gives with the row's leaf, or, if ``tampered`` changes
    columns of the row, with the leaf of the changed row; ``verified`` tells whether it is the root.
    """
    own = [docs[f] for f in fields]
    changed = [(tampered or {}).get(f, docs[f]) for f in fields]
    differs = F.lit(False)
    for a, b in zip(own, changed, strict=True):
        differs = differs | ~a.eqNullSafe(b)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[group_col].cast("string").alias("source"), F.unhex(digest(*own)).alias("leaf"), F.when(differs, F.unhex(digest(*changed))).alias("tampered"))
    leaves, trees = placed(materialise(rows.withColumn("_any", F.monotonically_increasing_id()), "merkle-leaves"))
    leaves = materialise(leaves, "merkle-placed")
    links = grown(leaves.withColumnRenamed("leaf", "digest"), "merkle-links")
    subroots = materialise(links.filter(F.col("kind") == TOP), "merkle-subroots")
    sizes = trees.agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("n")).first()
    above = grown(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.lit(sizes["trees"]).alias("n"), (F.col("tree") - 1).alias("at"), F.col("data").alias("digest")), "merkle-roots")
    strides = lambda n: max(1, -(-depth(n or 0) // STRIDE))
    top = above.filter(F.col("kind") == TOP).select("level", F.hex("data").alias("root")).first()
    root = top["root"].lower() if top else None
    none = lambda kind: F.lit(None).cast(kind)
    start = docs.sparkSession.createDataFrame([(0, top["level"], 0, "")] if top else [], "tree bigint, level int, at bigint, path string")
    between = descended(above.filter(F.col("kind") == LINK), start, subroots.select(F.lit(0).cast("bigint").alias("tree"), (F.col("tree") - 1).alias("at"), "data", none("binary").alias("other"), none("bigint").alias("doc_id")), strides(sizes["trees"]), "merkle-paths")

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = passed_down(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        yield from batched(((r[0], r[3], r[4], f"{r[6].hex()},{flat(path)}") for r, path in found), _paths, 1024)

    seeds = materialise(between.mapInArrow(descend, "tree bigint, level int, at bigint, path string"), "merkle-paths")
    tops = subroots.select("tree", "level", "at").join(seeds.select((F.col("at") + 1).alias("tree"), "path"), "tree")
    below = descended(links.filter(F.col("kind") == LINK), tops, leaves.select("tree", "at", "doc_id", F.col("leaf").alias("data"), F.col("tampered").alias("other")), strides(sizes["n"]), "merkle-paths")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = passed_down(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        yield from batched(((r[8], r[6].hex(), *proven(flat(path), r[7] or r[6], root)) for r, path in found), _proof)

    return below.mapInArrow(prove, PROOF).withColumn("verified", F.col("folded_root") == F.col("root"))


def proven(path: str, leaf: bytes, root: str) -> tuple[str, str, str, str]:
    """(subroot, root, digest of the proof, folded root) of a leaf by its path."""
    parts = path.split(",")
    # The path of a tree of one node has no part of its own before the subroot.
    cut = next(i for i, p in enumerate(parts) if len(p) == 64)
    steps, folded = [p for i, p in enumerate(parts) if i != cut and p], leaf.hex()
    for step in steps:
        place, beside = int(step[0]), step[1:]
        folded = sha256(f"{beside[: 64 * place]}{folded}{beside[64 * place :]}".encode()).hexdigest()
    return parts[cut], root, sha256("".join(s[1:] for s in steps).encode()).hexdigest(), folded


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per group: its name, number of rows and subroot; what a reader compares to find the groups that differ."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[group_col].cast("string").alias("source"), F.unhex(digest(*[docs[f] for f in fields])).alias("leaf"), F.lit(None).cast("binary").alias("tampered"))
    leaves, trees = placed(materialise(rows.withColumn("_any", F.monotonically_increasing_id()), "merkle-leaves"))
    tops = grown(leaves.withColumnRenamed("leaf", "digest"), "merkle-links").filter(F.col("kind") == TOP)
    return trees.join(tops.select("tree", F.lower(F.hex("data")).alias("subroot")), "tree").select("source", "n", "subroot")
