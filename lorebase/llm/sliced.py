"""Near copies by similarity: a positional index over slices of a text's shingles, verified exactly.

A 64-bit SimHash is one digest of all shingles: at a Jaccard similarity of 0.8 it differs in ten
bits or so, which no index by positions can look up.  So for a similarity the fingerprint is
longer and its positions are *slices*: the shingles are dealt out by their hash to about a third
as many slices, and the value at a position is the sum of that slice's hashes.  An edited word
spoils the few slices that its shingles lie in and leaves the others alike.

Texts of similarity s differ in at most (1 - s) / s of the smaller one's shingles, fewer than
there are slices, so some slices are alike for certain; of the first ``POSITIONS`` = 24, at 0.8,
each is with a probability of 0.37 to 0.61.  The number of
slices is a power of two by the number of shingles; a text is posted for the numbers that a text
similar to it may have.

The members of a list (one position, one value) are not paired up: a list offers its smallest and
its largest, and each member is compared with the ``CLOSEST`` of what its lists offer, by the
number of lists.  Lists whose members are not all of one class then offer a member of up to
``OFFERED`` of their classes, other ones each turn, until a turn links less than one in ``WORTH`` of
the pairs that it compares.  So a turn's work grows with the texts, whatever the size of a list.
What is left then are links in crowds of texts that lie about the bound from one another, such as
thousands of copies of one text, each edited elsewhere, of which few pairs reach it.  Of a pair the
shared positions are tallied: fewer than ``MATCHES``, which 2 in 10,000 pairs of similarity 0.8
miss at worst, or too different sizes, and it is dropped; the rest are verified on their sets of
shingles.

Texts with the same set of shingles are one node from the start.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.arrow import slices
from lorebase.llm.components import components
from lorebase.storage import materialise, released

POSITIONS, MATCHES, OFFERED, CLOSEST, WORTH = 24, 2, 5, 4, 100
WORDS = regex.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_posting = pa.struct([("slices", pa.int32()), ("position", pa.int32()), ("value", pa.int64())])
LIST = ["slices", "position", "value"]
NODES = "key string, node string, n int, postings array<struct<slices: int, position: int, value: bigint>>"


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles of a lower-cased text by XXH64 with seed 42, sorted; one of all words if there are fewer."""
    found = WORDS.findall(text.translate(_LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    of = xxhash.xxh64_intdigest
    return np.unique(np.array([of(joined[a:b], 42) for a, b in zip(starts, ends[min(words, len(found)) - 1 :].tolist(), strict=False)], dtype=np.uint64))


def slice_counts(n: int, least: float) -> list[int]:
    """The numbers of slices under which a text of n shingles is posted."""
    own = lambda x: 1 << max(0, int(x / 2).bit_length() - 1)
    low, high = own(int(np.ceil(n * least))), own(int(n / least))
    return [low << i for i in range((high // low).bit_length())]


def postings(h: np.ndarray, least: float) -> list[dict]:
    """What stands at the first positions, by number of slices; an empty slice isn't posted."""
    out = []
    for parts in slice_counts(len(h), least) if len(h) else ():
        at = h & np.uint64(parts - 1)
        first = at < POSITIONS
        position, order = at[first], np.argsort(at[first], kind="stable")
        if not len(position):
            continue
        mixed = (h[first] ^ h[first] >> np.uint64(29)) * _MIX
        starts = np.flatnonzero(np.diff(position[order], prepend=np.uint64(parts)))
        sums = np.add.reduceat(mixed[order], starts)
        out += [{"slices": parts, "position": int(p), "value": int(v)} for p, v in zip(position[order][starts], sums.view(np.int64), strict=True)]
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A row's identity: its id and its text."""
    return F.concat_ws(":", F.coalesce(docs[id_col].cast("string"), F.lit("-")), F.md5(F.coalesce(docs[text_col], F.lit(""))))


def similar_classes(rows: DataFrame, words: int, least: float) -> DataFrame:
    """(key, node, root) of rows (key, text): the node of a row's set of shingles, and its class.

    Classes join nodes of a Jaccard similarity of ``least`` or more.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            every = [shingles(t, words) for t in part.column(1).cast(pa.large_binary()).to_pylist()]
            nodes = [xxhash.xxh128_hexdigest(h.tobytes()) for h in every]
            yield pa.record_batch(
                [part.column(0), pa.array(nodes), pa.array([len(h) for h in every], pa.int32()), pa.array([postings(h, least) for h in every], pa.list_(_posting))], names=["key", "node", "n", "postings"]
            )

    read_ = materialise(rows.mapInArrow(read, NODES), "sliced")
    each = read_.groupBy("node").agg(F.min_by(F.struct("n", "postings"), "key").alias("p"), F.min("key").alias("key"))
    # Numbers, given once and written, are less to move than digests.
    nodes = materialise(each.select(F.monotonically_increasing_id().alias("node"), F.col("node").alias("digest"), "key", "p.n", "p.postings"), "sliced-nodes")
    posted = nodes.select("node", "n", F.explode("postings").alias("p")).select("node", "n", "p.*")
    sizes = posted.groupBy(*LIST).agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(*LIST)
    shared = materialise(posted.join(sizes, LIST), "sliced-lists")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingles(t, words).tobytes() for t in part.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(sets, pa.binary())], names=["node", "h"])

    # One row of text for each node that is in a list: these, not all, are read again.
    asked = nodes.select("node", "key").join(shared.select("node").distinct().hint("merge"), "node", "left_semi")
    once = rows.join(asked.hint("merge"), "key").groupBy("node").agg(F.any_value("text").alias("text"))
    sets = materialise(once.mapInArrow(again, "node bigint, h binary"), "sliced-sets")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(shared >= least * (len(one) + len(two) - shared) - 1e-9)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    values = materialise(nodes.join(shared.select("node").distinct().hint("merge"), "node", "left_semi").select("node", F.transform("postings", lambda p: F.xxhash64(p)).alias("v")), "sliced-values")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that are similar: tally the positions they share, verify what reaches the least number."""
        tallied = pairs.join(values.withColumnsRenamed({"node": "b", "v": "vb"}).hint("merge"), "b").join(values.withColumnsRenamed({"node": "a", "v": "va"}).hint("merge"), "a")
        tally, most = F.size(F.array_intersect("va", "vb")), F.least(F.size("va"), F.size("vb"))
        retained = tallied.filter(tally >= F.when(most >= POSITIONS, MATCHES).otherwise(1)).select("a", "b")
        both = retained.join(sets.withColumnsRenamed({"node": "b", "h": "hb"}).hint("merge"), "b").join(sets.withColumnsRenamed({"node": "a", "h": "ha"}).hint("merge"), "a")
        return materialise(both.select("a", "b", "ha", "hb").mapInArrow(verified, "a bigint, b bigint"), "sliced-links")

    def compared(met: DataFrame, seen: DataFrame | None) -> DataFrame:
        """Of members (node, n) and ends (end, m) of like sizes that were not seen before, each member's ``CLOSEST`` by the lists they share."""
        alike = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")
        pairs = met.filter(alike & (F.col("node") != F.col("end"))).groupBy("node", "end").agg(F.count(F.lit(1)).alias("lists"))
        pairs = pairs.withColumns({"a": F.least("node", "end"), "b": F.greatest("node", "end")})
        pairs = pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti")
        best = Window.partitionBy("node").orderBy(F.col("lists").desc(), "end")
        return materialise(pairs.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= CLOSEST).select("a", "b").distinct(), "sliced-pairs")

    ends = shared.groupBy(*LIST).agg(F.explode(F.array(F.min(F.struct("node", "n")), F.max(F.struct("node", "n")))).alias("e"))
    new = compared(shared.join(ends, LIST).select("node", "n", F.col("e.node").alias("end"), F.col("e.n").alias("m")), None)
    seen, found = new, linked(new)
    roots = materialise(components(found), "sliced-roots")
    turn = 0
    while found.count() * WORTH > new.count():
        turn += 1
        now = materialise(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "sliced-now")
        classes = now.groupBy(*LIST, "root").agg(F.min(F.struct("node", "n")).alias("e"))
        # Every list offers some of its classes, other ones each turn, by their smallest member there.
        offer = Window.partitionBy(*LIST).orderBy(F.xxhash64("root", F.lit(turn)), "root")
        ends = classes.withColumn("_r", F.row_number().over(offer)).filter(F.col("_r") <= OFFERED)
        several = ends.groupBy(*LIST).agg(F.max("_r").alias("c")).filter("c > 1").select(*LIST)
        ends = ends.join(several, LIST).select(*LIST, F.col("root").alias("end_root"), F.col("e.node").alias("end"), F.col("e.n").alias("m"))
        new = compared(now.join(ends, LIST).filter(F.col("root") != F.col("end_root")), seen)
        found = linked(new)
        seen = materialise(seen.unionByName(new), "sliced-seen")
        # Links join whole classes: only their roots are to be joined again.
        name = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))  # noqa: B023, E731
        between = found.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        above = components(between).select(F.col("node").alias("root"), F.col("root").alias("up"))
        every = now.select("node", "root").distinct()
        before, roots = roots, materialise(every.join(above, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "sliced-roots")
        released(before)
        released(now)
        # Shuffle files of a turn that is over go when the driver collects its garbage.
        del before, now, classes, ends, several, between, above, every
        gc.collect()
        rows.sparkSession.sparkContext._jvm.System.gc()
    named = nodes.select("node", "digest").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    out = materialise(read_.select("key", F.col("node").alias("digest")).join(named, "digest").select("key", F.col("digest").alias("node"), "root"), "sliced-classes")
    for table in (read_, nodes, shared, sets, values, seen, roots):
        released(table)
    return out
