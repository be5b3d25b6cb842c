"""N-gram Jaccard join by vertical partitioning: components of texts whose sets of word shingles are alike.

Two sets are linked if 100 times their overlap reaches ``percent`` times their union.  Texts of
one set are one node from the start, so copies are never paired.

**Filter.**  A set linked with another shares four fifths of its shingles with it, so it shares
at least a number of the smallest ones by hash.  Every text lists those (three tenths of its
set); the lists are cut by slices of the hash and dealt out packed; each slice tells how many of
a node's shingles other nodes list as well.  A node with too few goes.  No pair is formed for
that, and what a common shingle costs grows with the texts that hold it, not with their pairs.

**Global order.**  The shingles of the remaining nodes are ordered by the number of nodes that
hold them, then by hash.  Those of one node alone count towards its size and come first.  A linked pair
has a common shingle among the first ``n - ceil(percent * n) + 1`` of both.

**Vertical partitions.**  The order is cut at quantiles into ``FRAGMENTS``; a node is cut into
segments, one in each.  The overlap of a pair is counted fragment by fragment, separately, and
summed per pair: by fragment in tasks of their own for single pairs, one after another within a task for tiles.

**Pairs without quadratic lists.**  Nodes with a common first shingle form a list.  Only
connections are asked for, so a list's members are first compared with one of them, another each
turn, and lists whose members are all connected are done; turns go on while they connect.  Then
every list that still holds several components is compared exhaustively, but only across components: in a short
list by pairs that can still reach the bound by their sizes and places; a longer one is cut into
tiles of bounded size, pairs of tiles are dealt out, and within a task partial overlaps are
counted by fragment and summed per pair, of which only links leave the task.  So no link is lost, no list is capped,
and rows grow with the square of a list only divided by the square of a tile.

Defined cases: a null or empty text or one without words has the empty set, size 0, and is a
component by its own id; fewer words than a shingle make one shingle of all; a null id gets its
set's component and never names one; rows of one id are rows of their own; a very long text is
one row when it is read and segments after; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.arrow import slices, text_or_empty
from lorebase.llm.components import components
from lorebase.llm.sliced import shingles
from lorebase.storage import materialise, released

FRAGMENTS, SHORT, TILE = 8, 12, 512
#: Shingles of a tile's members together, about.
TILE_SHINGLES = 400_000
#: Tokens that a slice of the filter holds, and the most slices; beyond them slices grow.
SLICE_TOKENS, MOST_SLICES = 2_000_000, 1 << 16
#: Turns go on while one pair in so many is a link.
WORTH = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_sets = ["doc_id", "text_key", "digest", "n", "head", "listed"]


def required(n: Column, percent: int) -> Column:
    """The least overlap of a set of n with one that it is linked with."""
    return F.ceil(n * percent / 100)


def listed(h: np.ndarray, percent: int) -> np.ndarray:
    """The smallest shingles by hash: so many that a linked set has at least a tenth of the set's size (``shared_least``) among its own."""
    n = len(h)
    return h[: n - -(-n * percent // 100) + -(-n // 10)]


def shared_least(n: Column, percent: int) -> Column:
    """Of what a set of n lists, how many a linked set lists as well: a tenth of the smaller one's size."""
    return F.greatest(F.lit(1), F.ceil(F.floor(n * percent / 100) / 10))


def read(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text_key, digest, n, head, listed) of every row of texts (doc_id, text); head: the digest's first 8 bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            every = [shingles(t, words) for t in part.column(2).cast(pa.large_binary()).to_pylist()]
            digests = [xxhash.xxh128_digest(h.tobytes()) for h in every]
            heads = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array([len(h) for h in every], pa.int32()), pa.array(heads), pa.array([listed(h, percent).tobytes() for h in every], pa.binary())], names=_sets)

    rows = texts.select("doc_id", F.xxhash64("text").alias("text_key"), text_or_empty(F.col("text")).alias("text"))
    return rows.mapInArrow(work, f"doc_id {dict(texts.dtypes)['doc_id']}, text_key bigint, digest binary, n int, head bigint, listed binary")


def shared_counts(rows: DataFrame) -> DataFrame:
    """(head, shared): how many of the shingles that a node lists other nodes list as well."""
    total = rows.agg(F.sum(F.octet_length("listed")).alias("b")).first()["b"] or 0
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST_SLICES, max(tasks, total // 8 // SLICE_TOKENS + 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "listed", 32_000_000):
            # Rows of one set are one node.
            heads, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            lists = [np.frombuffer(batch.column(1)[int(i)].as_buffer(), np.uint64) for i in first]
            tokens = np.concatenate(lists)
            node, cut = np.repeat(np.arange(len(heads), dtype=np.uint32), [len(x) for x in lists]), (tokens * _MIX >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
            order = np.argsort(cut, kind="stable")
            tokens, node, ends = tokens[order], node[order], np.searchsorted(cut[order], np.arange(n + 1))
            some, out = np.flatnonzero(np.diff(ends)), []
            for i in some:
                own, times = np.unique(node[ends[i] : ends[i + 1]], return_counts=True)
                out.append((tokens[ends[i] : ends[i + 1]].tobytes(), heads[own].tobytes(), times.astype(np.int32).tobytes()))
            yield pa.record_batch([pa.array(some.astype(np.int32)), *[pa.array(c, pa.binary()) for c in zip(*out, strict=True)]], names=["slice", "tokens", "heads", "times"])

    def tell(group: pa.Table) -> pa.Table:
        own = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(c)])
        heads, tokens = np.repeat(own("heads", np.int64), own("times", np.int32)), own("tokens", np.uint64)
        order = np.lexsort((heads, tokens))
        heads, tokens = heads[order], tokens[order]
        again = np.zeros(len(tokens), dtype=bool)
        again[1:] = (tokens[1:] == tokens[:-1]) & (heads[1:] == heads[:-1])
        heads, tokens = heads[~again], tokens[~again]
        shared = np.zeros(len(tokens), dtype=bool)
        shared[1:] = tokens[1:] == tokens[:-1]
        shared[:-1] |= shared[1:]
        found, times = np.unique(heads[shared], return_counts=True)
        return pa.table({"head": found, "shared": times})

    dealt = rows.select("head", "listed").filter("octet_length(listed) > 0").mapInArrow(deal, "slice int, tokens binary, heads binary, times binary")
    return dealt.groupBy("slice").applyInArrow(tell, "head bigint, shared bigint").groupBy("head").agg(F.sum("shared").alias("shared"))


def order_key(item: Column) -> Column:
    """The place of a shingle (df, token) in the global order, up to ties that its hash settles."""
    return F.shiftleft(F.least(item["df"], F.lit(1 << 20)), 40) + F.shiftrightunsigned(item["token"], 24)


def ordered(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, alone, items): each node's shingles (df, token) of two nodes or more in the global order, the others only counted.

    Places repeat what df and token say and are neither sent nor kept.
    """
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    # Written, so that what was shuffled for it is gone when the tokens travel again.
    df = materialise(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "jaccard-df")
    met = tokens.join(df, "token").select("node", "n", F.struct("df", "token").alias("item"))
    placed = lambda x: F.struct(order_key(x).alias("place"), x["token"].alias("token"), x["df"].alias("df"))
    items = met.groupBy("node", "n").agg(F.transform(F.sort_array(F.transform(F.collect_list("item"), placed)), lambda x: F.struct(x["df"].alias("df"), x["token"].alias("token"))).alias("items"))
    # Of fewer shared shingles than a link needs no link can come.
    return items.withColumn("alone", F.col("n") - F.size("items")).filter(F.size("items") >= required(F.col("n"), percent))


def fragments(nodes: DataFrame) -> list[int]:
    """Where the global order is cut: quantiles of what the nodes hold."""
    cuts = nodes.select(F.explode("items").alias("item")).select(order_key(F.col("item")).alias("place")).agg(F.percentile_approx("place", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, na, nb) those that are linked: partial overlaps by fragment, summed per pair."""
    name = lambda side: segments.select(F.col("node").alias(side), "fragment", F.col("tokens").alias(f"t{side}"))
    parts = pairs.join(name("b"), "b").join(name("a"), ["a", "fragment"])
    partial = parts.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("overlap"))
    whole = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return whole.filter(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def crossing(values: np.ndarray, sizes: np.ndarray, root: np.ndarray, left: int, tokens: list[list[np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between the first ``left`` nodes and all that follow them, or among all if they are all there is, across components, as few as join what belongs together.

    ``tokens``: by fragment, each node's shingles there.
    """
    total = np.zeros((left, len(values)), dtype=np.int64)
    for segment in tokens:
        every, code = np.unique(np.concatenate(segment), return_inverse=True)
        row = np.repeat(np.arange(len(values)), [len(s) for s in segment])
        # Partial overlaps of a fragment, so many of its shingles at a time.
        for start in range(0, len(every), 4096):
            width = min(4096, len(every) - start)
            inside = (code >= start) & (code < start + width)
            holds = np.zeros((len(values), width), dtype=np.float32)
            holds[row[inside], code[inside] - start] = 1
            total += (holds[:left] @ holds.T).astype(np.int64)
    union = sizes[:left, None] + sizes[None, :] - total
    i, j = np.nonzero((100 * total >= percent * union) & (root[:left, None] != root[None, :]))
    parent, out = {}, []

    def up(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = up(int(root[a])), up(int(root[b]))
        if x != y:
            parent[y] = x
            out.append((int(values[a]), int(values[b])))
    return out


def across(lists: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links across components within lists (token, node, n, root) longer than SHORT, each cut into tiles.

    ``held``: (node, held), each node's shingles by fragment.
    """
    # How many tiles a component fills, by its members and by their shingles.
    comps = lists.groupBy("token", "root").agg((F.count(F.lit(1)) / TILE + F.sum("n") / TILE_SHINGLES).alias("c"))
    # One that fills half a tile has its own; smaller ones share tiles by their hash.
    big = F.col("c") > 0.5
    small = comps.groupBy("token").agg(F.sum(F.when(big, 0.0).otherwise(F.col("c"))).alias("rest"))
    own = F.when(big, F.concat_ws(":", "root", F.pmod(F.xxhash64("node", "token"), F.ceil("c")))).otherwise(F.concat_ws(":", F.lit("-"), F.pmod(F.xxhash64("root", "token"), F.greatest(F.lit(1), F.ceil("rest")))))
    tiled = materialise(lists.join(comps, ["token", "root"]).join(small, "token").select("token", "node", "n", "root", own.alias("tile")), "jaccard-tiles")
    tiles = tiled.groupBy("token", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    right = tiles.select("token", *[F.col(c).alias(f"_{c}") for c in ("tile", "low", "high", "r0", "r1")])
    one = (F.col("r0") == F.col("r1")) & (F.col("r0") == F.col("_r0")) & (F.col("r1") == F.col("_r1"))
    sizes = (100 * F.col("high") >= percent * F.col("_low")) & (100 * F.col("_high") >= percent * F.col("low"))
    units = tiles.join(right, "token").filter((F.col("tile") <= F.col("_tile")) & ~one & sizes).select("token", "tile", F.col("_tile").alias("other"), F.xxhash64("token", "tile", "_tile").alias("unit"))
    both = units.select("token", "unit", F.col("tile").alias("t"), F.lit(0).alias("side")).unionByName(units.filter("tile != other").select("token", "unit", F.col("other").alias("t"), F.lit(1).alias("side")))
    members = both.join(tiled.withColumnRenamed("tile", "t"), ["token", "t"]).select("unit", "side", "node", "n", "root")
    rows = members.join(held, "node")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("node", "ascending")]).combine_chunks()
        own = lambda c: group.column(c).to_numpy()
        left = int((own("side") == 0).sum())
        tokens = [list(f) for f in zip(*[[s.values.to_numpy() for s in x.values] for x in group.column("held")], strict=True)]
        found = crossing(own("node"), own("n").astype(np.int64), own("root"), left, tokens, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("unit").applyInArrow(compare, "a bigint, b bigint")


def joined(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, root) of nodes (node, n, alone, items) that are linked with others."""
    cuts = fragments(nodes)
    fragment = lambda x: sum((F.when(order_key(x) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    segment = lambda k: F.transform(F.filter("items", lambda x: fragment(x) == k), lambda x: x["token"])
    held = materialise(nodes.select("node", F.array(*[segment(k) for k in range(len(cuts) + 1)]).alias("held")), "jaccard-segments")
    segments = held.select("node", F.posexplode("held").alias("fragment", "tokens")).filter(F.size("tokens") > 0)
    # Places count from 0 in the whole order, so those that are in no other node come first.
    first = F.col("n") - required(F.col("n"), percent) + 1 - F.col("alone")
    posted = nodes.filter(first > 0).select("node", "n", "alone", F.posexplode(F.slice("items", F.lit(1), first.cast("int"))).alias("i", "item")).select("node", "n", (F.col("alone") + F.col("i")).alias("at"), F.col("item.token").alias("token"))
    several = posted.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    lists = materialise(posted.join(several, "token"), "jaccard-lists")
    alike = (100 * F.col("n") >= percent * F.col("m")) & (100 * F.col("m") >= percent * F.col("n"))
    ends = lambda: [F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"), F.when(F.col("node") < F.col("end"), F.col("n")).otherwise(F.col("m")).alias("na"), F.when(F.col("node") < F.col("end"), F.col("m")).otherwise(F.col("n")).alias("nb")]
    roots, found, seen, turn = None, None, None, 0
    while True:
        now = lists.withColumn("root", F.col("node")) if roots is None else lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = now.groupBy("token").agg(F.min("root").alias("_r0"), F.max("root").alias("_r1"), F.min_by(F.struct("node", "n", "root"), F.struct(F.xxhash64("root", F.lit(turn)), "node")).alias("e")).filter("_r0 != _r1").drop("_r0", "_r1")
        now = materialise(now.join(open_, "token"), "jaccard-open")
        # Of what its lists offer, each node is compared with what most of them offer.
        met = now.filter(F.col("root") != F.col("e.root")).select("node", "n", F.col("e.node").alias("end"), F.col("e.n").alias("m")).filter(alike).groupBy("node", "n", "end", "m").agg(F.count(F.lit(1)).alias("by"))
        met = met if seen is None else met.select(*ends(), "node", "n", "end", "m", "by").join(seen.select("a", "b"), ["a", "b"], "left_anti")
        best = met.groupBy("node", "n").agg(F.max(F.struct("by", F.xxhash64("end", F.lit(turn)).alias("h"), "end", "m")).alias("o")).select("node", "n", F.col("o.end").alias("end"), F.col("o.m").alias("m"))
        stars = materialise(best.select(*ends()).distinct(), "jaccard-stars")
        new = materialise(linked(stars, segments, percent), "jaccard-links")
        found, seen, turn = new if found is None else found.unionByName(new), stars if seen is None else seen.unionByName(stars), turn + 1
        roots = materialise(components(found), "jaccard-roots")
        if new.count() * WORTH < stars.count() or new.isEmpty():
            break
    now = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Lists with the same members are one; of the others those that hold several components.
    same = now.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").groupBy("k", "s").agg(F.min("token").alias("token"))
    rest = materialise(now.join(same.select("token", "k"), "token"), "jaccard-rest")
    # Short lists: pairs by the most that the places of their common shingle leave them.
    short = materialise(now.join(now.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("token"), "token").filter(F.col("size") <= SHORT).select("token", "node", "n", "at", "root"), "jaccard-short")
    other = short.select("token", *[F.col(c).alias(d) for c, d in (("node", "end"), ("n", "m"), ("at", "_at"), ("root", "_root"))])
    met = short.join(other, "token").filter((F.col("node") < F.col("end")) & (F.col("root") != F.col("_root")) & alike)
    bound = F.max(F.least(F.col("n") - F.col("at"), F.col("m") - F.col("_at")))
    pairs = met.groupBy("node", "end", "n", "m").agg(bound.alias("bound")).filter((100 + percent) * F.col("bound") >= percent * (F.col("n") + F.col("m"))).select(*ends())
    pairs = materialise(pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-pairs")
    links = linked(pairs, segments, percent).unionByName(across(rest.filter(F.col("size") > SHORT).select("token", "node", "n", "root"), held, percent))
    return components(materialise(found.unionByName(links), "jaccard-links"))


def similar_sets(texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of texts (doc_id, text): every row's (doc_id, text_key, digest, n, ...), and (digest, root) of the sets that are linked with others."""
    whole = materialise(read(texts, words, percent), "jaccard-sets")
    rows = materialise(whole.drop("listed"), "jaccard-rows")
    wanted = shared_counts(whole).join(rows.filter("n > 0").groupBy("digest", "head").agg(F.first("n").alias("n"), F.min(F.struct("text_key", "doc_id")).alias("of")), "head")
    kept = materialise(wanted.filter(F.col("shared") >= shared_least(F.col("n"), percent)).select(F.monotonically_increasing_id().alias("node"), "digest", "n", "of"), "jaccard-kept")
    released(whole)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingles(t, words).view(np.int64) for t in part.column(2).cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "tokens"])

    asked = kept.select("node", "n", F.col("of.text_key").alias("_text_key"), F.col("of.doc_id").alias("_doc_id"))
    keyed = texts.select(F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_k"), "text")
    once = keyed.join(asked, (F.col("_k") == F.col("_text_key")) & F.col("_i").eqNullSafe(F.col("_doc_id"))).groupBy("node", "n").agg(F.any_value("text").alias("text"))
    sets = materialise(once.mapInArrow(again, "node bigint, n int, tokens array<bigint>"), "jaccard-tokens")
    nodes = materialise(ordered(sets, percent), "jaccard-order")
    released(sets)
    return rows, kept.select("node", "digest").join(joined(nodes, percent), "node").select("digest", "root")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    rows, found = similar_sets(docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")), words, percent)
    # Copies share a digest: ids are summed up by it before they meet their component.
    named = found.withColumnRenamed("digest", "_digest")
    ids = rows.groupBy("digest").agg(F.min("doc_id").alias("least")).join(named, F.col("digest") == F.col("_digest"), "left")
    names = ids.filter("root is not null").groupBy("root").agg(F.min("least").alias("name"))
    classes = materialise(ids.join(names, "root", "left").select(F.col("digest").alias("_digest"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("name")).alias("component_id")), "jaccard-classes")
    met = rows.select("doc_id", "digest", "n").join(classes, F.col("digest") == F.col("_digest"))
    return met.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def similar_classes(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, root) of texts (key, text): classes of linked sets; texts of one set, the empty one among them, are one class."""
    rows, found = similar_sets(texts.select(F.col("key").alias("doc_id"), "text"), words, percent)
    named = found.select(F.col("digest").alias("_digest"), F.concat(F.lit("n"), "root").alias("root"))
    met = rows.select(F.col("doc_id").alias("key"), "digest").join(named, F.col("digest") == F.col("_digest"), "left")
    return met.select("key", F.coalesce("root", F.hex("digest")).alias("root"))
