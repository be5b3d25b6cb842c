"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes, each at its position.  Two fingerprints that differ in at
most ``MAX_BITS`` = 3 bits differ in at most three bytes, so they share at least five
(position, byte) entries of the inverted index: shared entries are tallied, pairs with fewer are
dropped by their count, and the rest are verified bit by bit.

Lists of single (position, byte) entries hold a 256th of all fingerprints each, and tallying
their pairs is quadratic.  So lists are read together, four at a time: the fourteen blocks of
four positions that form a Steiner system S(3, 4, 8).  Any three positions lie outside one of
its blocks, so every pair with five or more shared bytes meets in at least one list of four
bytes, and a list of random fingerprints is 2 ** -32 of them.

A list of more than ``LIST`` fingerprints (near copies of one text) is never paired up as a
whole.  It is split again: the bits that its members need not share are cut into four blocks,
of which three differing bits leave at least one alike.  Each split shares a quarter more of
the rest, until no list is long; members of a list that differ in at most 3 bits altogether are
one class.  Within a list only links that join something new are emitted: fewer than it has
members.

Defined cases: texts without words (null, empty, blank) have fingerprint zero and are linked
like any other; equal fingerprints are one class whatever their number; a null id gets the
class of its fingerprint and never names one, so a class of null ids has a null component; rows
of one id are rows of their own; a very long text is fingerprinted as a whole, in one row; an
empty table gives an empty result; other columns, whatever their names, are ignored, and
:func:`one_of_each` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.arrow import id_and_text, map_slices, text_or_empty
from lorebase.llm.components import components
from lorebase.llm.jaccard import similar_classes
from lorebase.llm.sliced import keyed
from lorebase.storage import materialise

MAX_BITS, SHARED_BYTES = 3, 5
#: Most members of a list whose pairs are tallied in one task.
LIST = 512
WORDS = regex.compile(rb"[^\x20\x09-\x0D]+")
#: The blocks of S(3, 4, 8): four positions whose numbers cancel out.
BLOCKS = [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
#: Row i: the bits of byte i, highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the lower-cased text over shingles of words, by XXH64 with seed 42: a bit is set if it is in over half the hashes."""
    found = WORDS.findall(text.translate(_LOWER))
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[min(words, len(found)) - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], 42) for a, b in zip(starts, last, strict=False)], dtype=">u8")
    bytes_ = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.stack([np.bincount(bytes_[:, p], minlength=256) @ _BITS for p in range(8)])
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).reshape(-1)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        fp = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = id_and_text(docs, id_col, text_col)
    kind = "string" if dict(rows.dtypes)["doc_id"] == "string" else "bigint"
    return map_slices(rows.withColumn("doc_id", F.col("doc_id").cast(kind)), work, f"doc_id {kind}, fp bigint")


def masks_below(mask: int) -> list[int]:
    """The mask with, in turn, each of four blocks of the bits that it leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k * len(free) // 4 : (k + 1) * len(free) // 4]) for k in range(4)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def joined(list_: np.ndarray) -> list[tuple[int, int]]:
    """Links within a list, as few as join what belongs together.

    Shared bytes are tallied position by position for every pair; the pairs that reach the
    guaranteed number are retained, and only those are verified.
    """
    values = list_.view(np.uint64)
    bytes_ = values.view(np.uint8).reshape(-1, 8)
    tally = np.zeros((len(values), len(values)), dtype=np.uint8)
    for entries in bytes_.T:
        tally += entries[:, None] == entries[None, :]
    left, right = np.nonzero(np.triu(tally >= SHARED_BYTES, 1))
    near = np.bitwise_count(values[left] ^ values[right]) <= MAX_BITS
    root, out = list(range(len(values))), []
    for i, j in zip(left[near].tolist(), right[near].tolist(), strict=True):
        a, b = i, j
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[b] = a
            out.append((int(list_[i]), int(list_[j])))
    return out


def _links(lists: DataFrame) -> DataFrame:
    """Links (a, b) from rows of (members: array of fingerprints, at most LIST)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [pair for m in frame["members"] for pair in joined(np.asarray(m, dtype=np.int64))]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return lists.mapInPandas(work, "a bigint, b bigint")


def _posted(rows: DataFrame, masks: Column) -> DataFrame:
    """One row for each fingerprint and mask: the list it stands in."""
    return rows.withColumn("mask", F.explode(masks)).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def links(distinct: DataFrame) -> DataFrame:
    """Links between distinct fingerprints (column fp), enough to join all that differ in at most MAX_BITS bits."""
    first = [signed(sum(0xFF << 8 * (7 - p) for p in block)) for block in BLOCKS]
    rows = _posted(distinct.select("fp"), F.array(*[F.lit(m) for m in first]))
    masks, out = {m & (1 << 64) - 1 for m in (m & (1 << 64) - 1 for m in first)}, None
    while True:
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least")).filter("n > 1")
        listed = materialise(rows.join(sizes, ["mask", "key"]), "simhash-lists")
        wide = sorted(m for m in masks if 64 - m.bit_count() <= MAX_BITS)
        alike = F.col("mask").isin([signed(m) for m in wide]) if wide else F.lit(False)
        short = listed.filter((F.col("n") <= LIST) & ~alike).groupBy("mask", "key").agg(F.collect_list("fp").alias("members"))
        found = _links(short.select("members"))
        if wide:
            found = found.unionByName(listed.filter(alike & (F.col("fp") != F.col("least"))).select(F.col("fp").alias("a"), F.col("least").alias("b")))
        out = found if out is None else out.unionByName(found)
        long_ = listed.filter((F.col("n") > LIST) & ~alike)
        hot = [r["mask"] for r in long_.select("mask").distinct().collect()]
        if not hot:
            return out.distinct()
        below = {m: masks_below(m & (1 << 64) - 1) for m in hot}
        masks = {x for xs in below.values() for x in xs}
        # As many rows as masks whose lists are long, four times as many a level at most; levels end when no bits are free.
        finer = distinct.sparkSession.createDataFrame([(m, [signed(x) for x in xs]) for m, xs in below.items()], "mask bigint, finer array<bigint>")
        rows = _posted(long_.select("fp", "mask").join(F.broadcast(finer), "mask").select("fp", "finer"), F.col("finer")).select("fp", "mask", "key").distinct()


def _classed(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row; of every fingerprint (fp, least, root): its smallest id and its component."""
    rows = materialise(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct))
    return rows, distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links)."""
    rows, classes = _classed(docs, id_col, text_col, words)
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(names, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", _digits(F.col("fp")).alias("fingerprint"), "component_id")


def _digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each component: the one that names it.

    Components join texts whose fingerprints differ in at most MAX_BITS bits or, with
    ``similarity`` (in whole hundredths), whose sets of shingles have at least that Jaccard
    similarity, by the exact join of :mod:`lorebase.llm.jaccard`: no link is capped.  A component keeps one row: that of its smallest id (null only
    if it has no other), of these the one with the smallest digest of its text, of rows alike in
    id and text any one.
    """
    key = keyed(docs, id_col, text_col)
    rows = docs.select(key.alias("key"), docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    if similarity is None:
        found, classes = _classed(rows, "key", "text", words)
        classed = found.join(classes.select("fp", "root"), "fp").select(F.col("doc_id").alias("key"), F.col("root").cast("string").alias("root"))
    else:
        classed = similar_classes(rows.select("key", "text"), words, round(100 * similarity))
    # The id leads the key.
    number = F.nullif(F.substring_index("key", ":", 1), F.lit("-")).cast("long")
    best = F.min(F.struct(number.isNull().alias("nameless"), number.alias("id"), "key"))
    kept = materialise(classed.groupBy("root").agg(best["key"].alias("_key")).select("_key"), "simhash-kept")
    twice = materialise(classed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("_twice")), "simhash-twice")
    # The kept rows grow with the documents; they are met the same way at every size.
    own, names = "_own_key", {c.lower() for c in docs.columns}
    while own in names:
        own += "_"
    marked = docs.withColumn(own, key)
    out = marked.join(kept.hint("merge"), marked[own] == kept["_key"], "left_semi")
    if not twice.isEmpty():
        single = out.join(twice.hint("merge"), out[own] == twice["_twice"], "left_anti")
        several = out.join(twice.hint("merge"), out[own] == twice["_twice"], "left_semi")
        out = single.unionByName(several.dropDuplicates([own]))
    return out.drop(own)
