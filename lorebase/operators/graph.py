"""Graph operators over an edge table (src, dst, edge_type, confidence)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.storage import bucketed, materialise, written

#: Rounds of an iteration between two written tables.
CUT = 4


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges to follow: out, in or both."""
    if direction == "out":
        return edges
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}) if direction == "in" else both_ways(edges)


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): all nodes within reach of each start, at their least depth.

    Level by level; each level is written, so that the next one reads what was visited instead of
    working it out again.
    """
    e = edges.select("src", "dst").distinct()
    reached = seeds.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct()
    frontier = reached
    for level in range(1, depth + 1):
        step = frontier.join(e, frontier.node == e.src).select("start", F.col("dst").alias("node")).distinct()
        frontier = step.join(reached.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level))
        if level < depth:
            frontier = materialise(frontier, "bfs")
        reached = reached.unionByName(frontier)
    return reached


def paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Simple paths of 1 to depth edges from the seeds: nodes, length, product of confidences."""
    e = edges.select("src", "dst", F.col("confidence").alias("c"))
    grown = seeds.select(F.array("node").alias("nodes"), F.col("node").alias("last"), F.lit(0).alias("length"), F.lit(1.0).alias("confidence"))
    out = None
    for _ in range(depth):
        step = grown.join(e, grown.last == e.src).filter(~F.array_contains("nodes", F.col("dst")))
        grown = step.select(F.array_append("nodes", F.col("dst")).alias("nodes"), F.col("dst").alias("last"), (F.col("length") + 1).alias("length"), (F.col("confidence") * F.col("c")).alias("confidence"))
        out = grown if out is None else out.unionByName(grown)
    return out


def shortest(edges: DataFrame, start: DataFrame, end: str | DataFrame, depth: int = 5, least: float = 0.0) -> DataFrame:
    """The shortest path from the starts to a node (or one of a column ``node``) over edges of at least some confidence.

    On a tie the most trusted, then the first by name.  Breadth first: a node keeps the best of the
    paths that first reach it, so a level has a row for each node and not one for each path.
    """
    e = edges.filter(F.col("confidence") >= least).groupBy("src", "dst").agg(F.max("confidence").alias("c"))
    ends = edges.sparkSession.createDataFrame([(end,)], "node string") if isinstance(end, str) else end.select("node").distinct()
    level = start.select("node", F.array("node").alias("nodes"), F.lit(0).alias("length"), F.lit(1.0).alias("confidence")).dropDuplicates(["node"])
    visited = level.select("node")
    for n in range(depth + 1):
        level = materialise(level, "shortest")
        found = level.join(ends, "node", "left_semi")
        if n == depth or not found.isEmpty():
            break
        step = level.join(e, level.node == e.src).select(F.col("dst").alias("node"), F.array_append("nodes", F.col("dst")).alias("nodes"), (F.col("length") + 1).alias("length"), (F.col("confidence") * F.col("c")).alias("confidence"))
        step = step.join(visited, "node", "left_anti")
        best = Window.partitionBy("node").orderBy(F.col("confidence").desc(), F.array_join("nodes", ">"))
        level = step.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
        visited = visited.unionByName(level.select("node"))
    return found.orderBy("length", F.col("confidence").desc(), F.array_join("nodes", ">")).limit(1).select("nodes", F.col("node").alias("last"), "length", "confidence")


def all_paths(edges: DataFrame, start: DataFrame, end: str, depth: int = 5, limit: int = 10) -> DataFrame:
    """The first simple paths to a node by length and confidence.

    Only edges that lie on a way of at most ``depth`` edges from a start to the end are followed:
    steps from the start to the edge, the edge, and steps from there to the end.
    """
    ends = edges.sparkSession.createDataFrame([(end,)], "node string")
    forth = bfs(edges, start, depth).groupBy("node").agg(F.min("depth").alias("f"))
    back = bfs(directed(edges, "in"), ends, depth).select("node", F.col("depth").alias("b"))
    useful = edges.join(forth, edges.src == forth.node).drop("node").join(back, F.col("dst") == back.node).filter(F.col("f") + 1 + F.col("b") <= depth)
    found = paths(materialise(useful.select(*edges.columns), "path-edges"), start, depth).filter(F.col("last") == end)
    return found.orderBy("length", F.col("confidence").desc(), F.array_join("nodes", ">")).limit(limit)


def profile(edges: DataFrame, entities: DataFrame, at: str | None = None) -> DataFrame:
    """Of each entity (column node): mentions, mean confidence, edges in and out, best related entity, contradicted statements.

    at: a column with an edge's time, for the first and last mention.
    """
    time = [F.col(at).alias("at")] if at else []
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "confidence", "edge_type", F.lit(1).alias("out"), *time)
    ends = ends.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "confidence", "edge_type", F.lit(0).alias("out"), *time))
    mine = ends.join(entities, "node", "left_semi")
    said = mine.filter("out = 1").groupBy("node", F.lower("edge_type").alias("p")).agg(F.count_distinct(F.lower("other")).alias("o")).groupBy("node").agg(F.count_if(F.col("o") > 1).alias("contradicted"))
    out = mine.groupBy("node").agg(
        F.count(F.lit(1)).alias("mentions"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.sum("out").alias("out_edges"), (F.count(F.lit(1)) - F.sum("out")).alias("in_edges"),
        F.count_distinct("other").alias("related"), F.max(F.struct("confidence", "other"))["other"].alias("closest"), *([F.min("at").alias("first_at"), F.max("at").alias("last_at")] if at else []),
    )
    return out.join(said, "node", "left").withColumn("contradicted", F.coalesce("contradicted", F.lit(0)))


def compared(edges: DataFrame, one: str, two: str, own: int | None = None) -> DataFrame:
    """Neighbours of two nodes: shared, of one alone (the first ``own``), and whether they are neighbours themselves (direct)."""
    near = both_ways(edges)
    a = near.filter(F.col("src") == one).select(F.lower("dst").alias("node")).distinct().withColumn("a", F.lit(True))
    b = near.filter(F.col("src") == two).select(F.lower("dst").alias("node")).distinct().withColumn("b", F.lit(True))
    kind = F.when(F.col("node").isin(one.lower(), two.lower()), "direct").when(F.col("a") & F.col("b"), "shared").when(F.col("a"), "first").otherwise("second")
    out = a.join(b, "node", "full_outer").select("node", kind.alias("kind"))
    if own is None:
        return out
    few = F.row_number().over(Window.partitionBy("kind").orderBy("node"))
    return out.withColumn("_n", few).filter((F.col("_n") <= own) | F.col("kind").isin("shared", "direct")).drop("_n")


def common_ancestors(edges: DataFrame, entities: list[str], depth: int = 3) -> DataFrame:
    """Nodes from which all entities are reached within depth, themselves among them."""
    out = None
    for e in entities:
        seeds = edges.sparkSession.createDataFrame([(e.lower(),)], "node string")
        low = edges.select(F.lower("dst").alias("src"), F.lower("src").alias("dst"))
        up = bfs(low, seeds, depth).select("node")
        out = up if out is None else out.intersect(up)
    return out


def hubs(edges: DataFrame, least: int = 3, k: int = 10) -> DataFrame:
    """The k nodes of the highest degree with at least ``least`` edges and distinct neighbours."""
    ends = both_ways(edges.select("src", "dst")).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("dst").alias("connected"))
    return ends.filter(f"degree >= {least} and connected >= {least}").orderBy(F.col("degree").desc(), "node").limit(k)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 10, seeds: DataFrame | None = None) -> DataFrame:
    """(node, rank): damped walk; the rank of nodes without a way out goes back to where walks start.

    Walks start anywhere, or at the seeds (personalised).  Ranks add up to 1.  Repeated edges count once.
    Nodes are numbered once, and edges and nodes laid out by number, so that a round shuffles only what flows, summed up
    by target before it is sent.
    """
    e = materialise(edges.select("src", "dst").distinct(), "rank-edges")
    ends = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    nodes = materialise(ends.withColumn("id", F.monotonically_increasing_id()), "rank-nodes")
    numbered = lambda df, c: df.join(nodes.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")), c).drop(c)
    if seeds is None:
        n = nodes.count()
        starts = nodes.select("id", F.lit(1.0 / n if n else 0.0).alias("s"))
    else:
        there = nodes.join(seeds.select("node").distinct(), "node", "left_semi").select("id")
        n = there.count()
        starts = there.withColumn("s", F.lit(1.0 / n if n else 0.0))
    links = bucketed(numbered(numbered(e, "src"), "dst"), "rank-links", "src_id")
    out = links.groupBy(F.col("src_id").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    home = bucketed(nodes.join(starts, "id", "left").join(out, "id", "left").select("id", "node", F.coalesce("s", F.lit(0.0)).alias("home"), "out"), "rank-home", "id")
    ranks = home.select("id", "home", "out", F.col("home").alias("rank"))
    for i in range(rounds):
        flow = ranks.filter("out is not null").select("id", (F.col("rank") / F.col("out")).alias("flow")).join(links, F.col("id") == F.col("src_id")).groupBy(F.col("dst_id").alias("id")).agg(F.sum("flow").alias("flow"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        new = damping * F.coalesce("flow", F.lit(0.0)) + (damping * F.col("lost") + (1 - damping)) * F.col("home")
        ranks = home.select("id", "home", "out").join(flow, "id", "left").crossJoin(F.broadcast(lost)).select("id", "home", "out", new.alias("rank"))  # lost is one row
        if (i + 1) % CUT == 0 and i + 1 < rounds:
            ranks = bucketed(ranks, "ranks", "id")
    return home.select("id", "node").join(ranks.select("id", "rank"), "id").select("node", "rank")


def propagated(edges: DataFrame, seeds: DataFrame, beliefs: DataFrame, confidence: float, decay: float = 0.5, depth: int = 3) -> DataFrame:
    """A change of confidence spreads over hops and fades: new = p + (confidence - p) * decay ** hop."""
    near = bfs(both_ways(edges), seeds, depth).groupBy("node").agg(F.min("depth").alias("hop"))
    factor = F.pow(F.lit(decay), F.col("hop"))
    out = near.join(beliefs.select("node", F.col("confidence").alias("previous")), "node")
    return out.withColumn("new", F.col("previous") + (confidence - F.col("previous")) * factor).withColumn("delta", F.col("new") - F.col("previous"))


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): synchronous label propagation, the most frequent label nearby wins, the smaller on a tie; own label counts once."""
    near = materialise(both_ways(edges.select("src", "dst")).distinct(), "community-edges")
    labels = near.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for i in range(rounds):
        votes = near.join(labels.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "label").unionByName(labels.select("node", "label"))
        counted = votes.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        # One pass over what is counted: a join with the best counts would count again, twice as often each round.
        best = counted.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label"))
        labels = materialise(best, "labels")
    return labels.select("node", F.col("label").alias("community"))


def louvain(edges: DataFrame, rounds: int = 12, levels: int = 4, resolution: float = 1.0) -> DataFrame:
    """(node, community): communities of high modularity, by parallel local moves and contraction.

    In a round the nodes of one half (another half each time, by a hash, so that neighbours don't
    swap places for ever) move to the community nearby that gains most: weight to it, less
    ``resolution`` times what chance would give, both without the node itself.  Ties go to the
    smaller name.  Rounds end when no node has anywhere better to go; then communities become
    nodes of the next level.  Edges are undirected; repeated ones add up.
    """
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a != b")
    near = both_ways(pairs.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w")))
    near, member = materialise(near, "louvain-edges"), None
    total = near.agg(F.sum("w").alias("w")).first()["w"] or 0.0  # twice the weight of all edges
    for level in range(levels):
        degree = materialise(near.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), "louvain-degrees")
        labels = degree.withColumn("label", F.col("node"))
        for i in range(rounds):
            half = F.pmod(F.xxhash64("node", F.lit(level * rounds + i)), F.lit(2)) == 0
            sums = labels.groupBy("label").agg(F.sum("k").alias("t"))
            # A loop is weight within a node; it stays with the node wherever it goes.
            ways = near.filter("src != dst").join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("w").alias("w"))
            home = labels.select("node", "label").withColumn("w", F.lit(0.0))
            choice = ways.unionByName(home).groupBy("node", "label").agg(F.sum("w").alias("w")).join(sums, "label").join(labels.select("node", "k", F.col("label").alias("now")), "node")
            rest = F.col("t") - F.when(F.col("label") == F.col("now"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("w") - resolution * F.col("k") * rest / total, 9)
            stay = (F.col("label") == F.col("now")).cast("int")
            best = choice.groupBy("node").agg(F.min(F.struct((-gain).alias("g"), (1 - stay).alias("s"), "label"))["label"].alias("best"))
            labels = materialise(labels.join(best, "node").select("node", "k", F.when(half, F.col("best")).otherwise(F.col("label")).alias("label"), (F.col("best") != F.col("label")).alias("open")), "louvain-labels")
            if labels.filter("open").isEmpty():
                break
            labels = labels.drop("open")
        step = labels.select("node", "label")
        member = step if member is None else member.join(step.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").select("node", F.col("up").alias("label"))
        member = materialise(member, "louvain-members")
        if step.filter("node != label").isEmpty():
            break
        to, of = step.select(F.col("node").alias("dst"), F.col("label").alias("to")), step.select(F.col("node").alias("src"), F.col("label").alias("of"))
        near = materialise(near.join(of, "src").join(to, "dst").groupBy(F.col("of").alias("src"), F.col("to").alias("dst")).agg(F.sum("w").alias("w")), "louvain-edges")
    return member.select("node", F.col("label").alias("community"))


def modularity(edges: DataFrame, member: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: how much more weight lies within communities than chance would put there."""
    pairs = both_ways(edges.select("src", "dst").filter("src != dst"))
    m = member.select(F.col("node").alias("src"), F.col("community").alias("c1")), member.select(F.col("node").alias("dst"), F.col("community").alias("c2"))
    every = pairs.join(m[0], "src").join(m[1], "dst")
    by = every.groupBy("c1").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("c1") == F.col("c2")).alias("inside"))
    total = F.broadcast(every.agg(F.count(F.lit(1)).alias("n")))  # one row
    return by.crossJoin(total).agg(F.sum(F.col("inside") / F.col("n") - resolution * F.pow(F.col("t") / F.col("n"), 2)).alias("modularity"))


def clusters(member: DataFrame, most: int = 20) -> DataFrame:
    """(community, members, links): sizes, and how many pairs their first ``most`` members form."""
    n = F.least(F.col("members"), F.lit(most))
    return member.groupBy("community").agg(F.count(F.lit(1)).alias("members")).withColumn("links", (n * (n - 1) / 2).cast("long"))


#: Items of a block, fewest blocks and memberships of a block; groups that are counted at once; pairs to a partition.
WIDE, BLOCKS, MEMBERS, AT_ONCE, PAIRS = 4096, 16, 4_000_000, 256, 500_000


def cooccurrences(members: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, weight): in how many groups two items are met together, a < b; repeated members of a group count once.

    Small groups (orders, conversations) are turned into pairs, which are counted in as many
    partitions as their number asks for.  Where groups are so large that pairs outnumber the
    members once for each block of items, blocks of items meet instead: see :func:`_tiled`.
    """
    m = materialise(members.select(group, item).dropna().distinct(), "cooccurrences")
    n = F.col("n").cast("double")
    size = m.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(BLOCKS, m.agg(F.approx_count_distinct(item)).first()[0] // WIDE + 1)
    if size[0] > size[1] * blocks:
        return _tiled(m, group, item, max(blocks, int(size[1]) // MEMBERS + 1))
    parts, usual = int(size[0] // PAIRS) + 1, int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = m.repartition(parts, group) if parts > usual else m
    a, b = dealt.withColumnRenamed(item, "a"), dealt.withColumnRenamed(item, "b")
    pairs = a.join(b, group).filter("a < b").select("a", "b")
    return (pairs.repartition(parts, "a", "b") if parts > usual else pairs).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def _tiled(m: DataFrame, group: str, item: str, blocks: int) -> DataFrame:
    """Co-occurrences by tiles: the counts of two blocks of items are one matrix in a task, and neither pairs nor copies of members are shuffled.

    A block is one row of a written table: its items, and by group which of them are members.  Blocks meet in a
    cartesian product that writes nothing; a task adds up products of incidence matrices, ``AT_ONCE`` groups each.
    """
    spark, kind = m.sparkSession, m.schema[item].dataType.simpleString()
    numbers = materialise(m.select(F.col(group).alias("g")).distinct().select("g", F.monotonically_increasing_id().alias("n")), "cooccurrences")
    rows = m.select(F.col(group).alias("g"), F.col(item).alias("item")).join(numbers, "g").select(F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), "n", "item")
    schema = f"block int, names array<{kind}>, n binary, ends binary, at binary"
    # As many files as blocks, about, so that both sides of the tiles are read by as many tasks as there are cores.
    path = written(rows.repartition(blocks, "block").groupBy("block").applyInArrow(_block, schema), "cooccurrences")
    # A session of its own for tables of large rows: a row is an Arrow batch there.
    single = spark.newSession()
    single.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        single.conf.set(name, spark.conf.get(name))
    side = lambda p: single.read.schema(schema).parquet(path).select(*[F.col(c).alias(f"{p}_{c}") for c in ("block", "names", "n", "ends", "at")])
    l, r = F.col("l_block"), F.col("r_block")
    # Of each two blocks one order, so that tasks have about as many tiles.
    met = side("l").hint("shuffle_replicate_nl").join(side("r"), (l == r) | ((l < r) == ((l + r) % 2 == 0)))
    counted = met.mapInArrow(_tile_counts, f"a {kind}, b {kind}, weight bigint")
    return counted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")


def _block(rows: pa.Table) -> pa.Table:
    """Rows (block, n, item) of a block as one: its items in order, and for each group where its members end and which they are."""
    coded = rows.column("item").combine_chunks().dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(len(order))
    n, at = rows.column("n").to_numpy(), place[coded.indices.to_numpy()]
    by = np.lexsort((at, n))
    groups, times = np.unique(n, return_counts=True)
    out = [rows.column("block").slice(0, 1).combine_chunks(), pa.array([coded.dictionary.take(order).to_pylist()], pa.list_(coded.dictionary.type))]
    out += [pa.array([x.tobytes()], pa.binary()) for x in (groups, np.cumsum(times), at[by])]
    return pa.table(out, names=["block", "names", "n", "ends", "at"])


def _tile_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two blocks a row; memory is one tile's counts and two blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c: batch.column(batch.schema.get_field_index(c))[i]  # noqa: B023, E731
            own = lambda p: [np.frombuffer(get(f"{p}_{c}").as_buffer(), np.int64) for c in ("n", "ends")] + [np.frombuffer(get(f"{p}_at").as_buffer(), np.int32)]  # noqa: B023, E731
            names, sides = (get("l_names").values, get("r_names").values), (own("l"), own("r"))
            _, *common = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
            counts = np.zeros((len(names[0]), len(names[1])), np.int32)
            for first in range(0, len(common[0]), AT_ONCE):
                x, y = (_incidence(ends, at, c[first : first + AT_ONCE], len(n)) for (_, ends, at), c, n in zip(sides, common, names, strict=True))
                counts += (x.T @ y).astype(np.int32)  # exact: single precision holds whole numbers up to 2^24
            found = np.triu(counts, 1) if get("l_block") == get("r_block") else counts
            for first in range(0, len(found), 128):
                a, b = np.nonzero(found[first : first + 128])
                weight = found[first : first + 128][a, b].astype(np.int64)
                yield pa.RecordBatch.from_arrays([names[0].take(pa.array(a + first)), names[1].take(pa.array(b)), pa.array(weight)], ["a", "b", "weight"])


def _incidence(ends: np.ndarray, at: np.ndarray, groups: np.ndarray, width: int) -> np.ndarray:
    starts = np.where(groups > 0, ends[groups - 1], 0)
    size = ends[groups] - starts
    out, row = np.zeros((len(groups), width), np.float32), np.repeat(np.arange(len(groups)), size)
    out[row, at[np.arange(len(row)) + np.repeat(starts - (np.cumsum(size) - size), size)]] = 1
    return out


def related(weights: DataFrame, item: str, least: float = 0.1, k: int = 20) -> DataFrame:
    """What is met with an item, by weight against the largest."""
    mine = weights.filter((F.col("a") == item) | (F.col("b") == item)).withColumn("other", F.when(F.col("a") == item, F.col("b")).otherwise(F.col("a")))
    best = F.broadcast(weights.agg(F.max("weight").alias("_most")))  # one row
    return mine.crossJoin(best).withColumn("strength", F.round(F.col("weight") / F.col("_most"), 6)).filter(F.col("strength") >= least).orderBy(F.col("strength").desc(), "other").limit(k).select("other", "strength")


@dataclass(frozen=True)
class GraphQuery:
    """An immutable traversal: start, traverse, filter, limit."""

    edges: DataFrame
    starts: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    direction: str = "out"
    depth: int = 1
    least: float = 0.0
    predicate: Column | None = None
    most: int | None = None
    kinds: tuple[str, ...] = ()
    nodes: DataFrame | None = None

    def start(self, *entities: str) -> GraphQuery:
        return replace(self, starts=self.starts + entities)

    def traverse(self, *types: str, direction: str = "out", depth: int = 1) -> GraphQuery:
        return replace(self, types=types, direction=direction, depth=depth)

    def filter(self, least: float = 0.0, predicate: Column | None = None, node_types: tuple[str, ...] = (), nodes: DataFrame | None = None) -> GraphQuery:
        """node_types: kinds of node to return, as (node, node_type) of ``nodes`` says; any node may be passed through."""
        return replace(self, least=least, predicate=predicate, kinds=node_types, nodes=nodes)

    def limit(self, n: int) -> GraphQuery:
        return replace(self, most=n)

    def _edges(self) -> DataFrame:
        e = self.edges.filter(F.col("confidence") >= self.least)
        e = e.filter(F.col("edge_type").isin(list(self.types))) if self.types else e
        return directed(e, self.direction)

    def _seeds(self) -> DataFrame:
        return self.edges.sparkSession.createDataFrame([(s,) for s in self.starts], "node string")

    def execute(self) -> DataFrame:
        found = bfs(self._edges(), self._seeds(), self.depth)
        if self.kinds:
            found = found.join(self.nodes.filter(F.col("node_type").isin(*self.kinds)).select("node").distinct(), "node", "left_semi")
        found = found.filter(self.predicate) if self.predicate is not None else found
        return found if self.most is None else found.orderBy("depth", "node", "start").limit(self.most)

    def invoke(self, action: str, **how) -> DataFrame:
        """The traversals by name, for tools: traverse, paths, shortest, profile, compare."""
        known = {
            "traverse": lambda: self.execute(), "paths": lambda: self.with_paths(), "shortest": lambda end: shortest(self._edges(), self._seeds(), end, self.depth),
            "profile": lambda: profile(self._edges(), self._seeds()), "compare": lambda: compared(self._edges(), *self.starts),
        }
        if action not in known:
            raise ValueError(f"unknown action {action!r}; there are {', '.join(known)}")
        return known[action](**how)

    def with_paths(self) -> DataFrame:
        return paths(self._edges(), self._seeds(), self.depth)
