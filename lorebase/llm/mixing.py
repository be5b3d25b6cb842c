"""Mixing sources to target weights by subset-sum budget fitting.

1.  Size every document in words, sum by source, and share the budget by weight: a source's
    target stops at ``max_epochs`` times its size and the excess is shared again.
2.  Whole epochs first: each document of a source is taken ``floor(target / size)`` times.
    What remains is a budget for one more copy of some documents.
3.  Count documents by exact length, fill the budget evenly over lengths, then close the last
    gap with a bounded-knapsack dynamic program over the lengths still free.
4.  The plan says only how many documents of each length get the extra copy.  Which ones is
    decided by a seeded hash: documents of one (source, length) lie in ``BUCKETS`` slices of
    the hash range, the slices are filled in order, and only inside the slice at the border
    are documents ranked.  So no group is ever gathered, even if a third of all rows share
    one source and one length.

The plan for a source reads one row for each distinct length, not for each document.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its
own, the last one; a null id is an id like any other; rows alike in id, source and text share
one hash, so which of them is taken is arbitrary and the result the same multiset (if they differ
in a kept column, that column may differ); a very long text is taken like any other, and the
knapsack's memory stays bounded by ``EXACT``; an empty table gives an empty result; other
columns, whatever their names, are ignored or, if kept, carried inside one column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.arrow import text_or_empty
from lorebase.storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Slices of the hash range within one source and length.
BUCKETS = 4096
#: Most words that are left to the knapsack: its memory is eight bytes for each, a few times.
EXACT = 1 << 22


def n_words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float], budget_share: float, max_epochs: float) -> dict[str | None, float]:
    """Target words by source: the budget shared by weight, each at most max_epochs times its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = budget_share * sum(sizes.values()), list(order), {}
    while open_:
        share = sum(weight[s] for s in open_)
        full = [s for s in open_ if max_epochs * sizes[s] < left * weight[s] / share]
        if not full:
            out |= {s: left * weight[s] / share for s in open_}
            break
        for s in full:
            out[s] = float(max_epochs * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths come as near to budget as can be, from below.

    An even share of every length first, so that the mix keeps the source's spread of lengths;
    the longest free documents next, until less than the longest length (or EXACT) remains; then
    the bounded knapsack.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    whole = int((lengths * counts).sum())
    if budget <= 0 or whole == 0:
        return np.zeros_like(counts)
    if budget >= whole:
        return counts.copy()
    take = np.array([int(c) * budget // whole for c in counts], dtype=np.int64)
    left = budget - int((take * lengths).sum())
    # Free room for the knapsack to choose in: it should not be left with a few odd lengths.
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] and left > min(lengths.max(), EXACT):
            more = min(int(counts[i] - take[i]), left // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    fits = int(((counts - take) * lengths)[lengths <= left].sum())
    return take + knapsack(lengths, counts - take, min(left, fits))


def knapsack(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the sum nearest to budget from below, as counts by length.

    reached[s]: which length made sum s first reachable (-1: not reachable).  For one length the
    sums s, s - L, s - 2 L, ... form a chain, along which a sum is reachable if a sum reached
    before lies at most ``free`` steps back.  Memory grows with the budget alone, and it stops
    as soon as the budget itself is met.
    """
    reached = np.full(budget + 1, -1, dtype=np.int64)
    reached[0] = len(lengths)
    for i in np.argsort(lengths, kind="stable"):
        step, most = int(lengths[i]), int(min(free[i], budget // lengths[i] if lengths[i] else 0))
        if not step or not most:
            continue
        rows = -(-(budget + 1) // step)
        table = np.full(rows * step, -1, dtype=np.int64)
        table[: budget + 1] = reached
        table = table.reshape(rows, step)
        at = np.where(table >= 0, np.arange(rows)[:, None], -(rows + most + 1))
        last = np.maximum.accumulate(at, axis=0)
        new = (table < 0) & (np.arange(rows)[:, None] - last <= most)
        table[new] = i
        reached = table.reshape(-1)[: budget + 1]
        if reached[budget] >= 0:
            break
    take, s = np.zeros(len(lengths), dtype=np.int64), int(np.flatnonzero(reached >= 0)[-1])
    while s:
        i = reached[s]
        take[i] += 1
        s -= int(lengths[i])
    return take


def _plan(histogram: DataFrame) -> DataFrame:
    """From one row a (source, size) with its count, source size and target: copies for all, and documents that get one more."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        source_size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        epochs = int(target // source_size) if source_size else 0
        extra = fit(rows["size"].to_numpy(), rows["n"].to_numpy(), round(target) - epochs * source_size)
        return pd.DataFrame({"source_key": rows["source_key"], "size": rows["size"], "epochs": epochs, "extra": extra})

    return histogram.groupBy("source_key").applyInPandas(work, "source_key string, size bigint, epochs bigint, extra bigint")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget_share: float = 1.5,
    max_epochs: float = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and how often to take it (copies).

    keep: columns of ``docs`` to carry along, as one column ``row``.  The
    number of sources is taken to be small (their names and sums are planned on the driver);
    documents and lengths are not.
    """
    own = [F.struct(*[docs[c] for c in keep]).alias("row")] if keep else []
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        docs[source_col].alias("source"),
        n_words(docs[text_col]).alias("size"),
        F.xxhash64(docs[text_col]).alias("text_hash"),
        *own,
    ).withColumn("source_key", source_key(F.col("source")))
    rows = rows.withColumn("slice", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("source_key"), F.col("size"), F.col("text_hash")))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("slice", 20), F.lit(BUCKETS)).cast("int"))
    if not own:
        rows = materialise(rows, "mix-sizes")
    counts = materialise(rows.groupBy("source_key", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sums = {r["source_key"]: int(r["s"] or 0) for r in counts.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()}
    wanted = targets({name(k): v for k, v in sums.items()}, weights, budget_share, max_epochs)
    spark = docs.sparkSession
    goals = spark.createDataFrame([(k, v, float(wanted[name(k)])) for k, v in sums.items()], "source_key string, source_size bigint, target double")
    goals = F.broadcast(goals) if len(sums) <= 10_000 else goals  # its size is checked; otherwise AQE splits hot sources
    histogram = counts.groupBy("source_key", "size").agg(F.sum("n").alias("n")).join(goals, "source_key")
    plan = _plan(histogram)
    before = Window.partitionBy("source_key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = counts.join(plan, ["source_key", "size"]).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    quota = quota.select("source_key", "size", "bucket", "epochs", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("earlier"))).alias("quota"), "n")
    quota = materialise(quota, "mix-quota")
    rank = Window.partitionBy("source_key", "size", "bucket").orderBy("slice", F.col("doc_id").asc_nulls_last())
    # The quota grows with the data; when whole rows are carried, they are met the same way at every size.
    chosen = rows.join(quota.hint("merge") if own else quota, ["source_key", "size", "bucket"])
    border = (F.col("quota") > 0) & (F.col("quota") < F.col("n"))
    whole = chosen.filter(~border).withColumn("copies", F.col("epochs") + (F.col("quota") > 0).cast("long"))
    part = chosen.filter(border).withColumn("copies", F.col("epochs") + (F.row_number().over(rank) <= F.col("quota")).cast("long"))
    out = whole.unionByName(part).join(goals, "source_key")
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", *["row"] * bool(own)
    )


def source_key(source: Column) -> Column:
    """A source as a key that is never null: null and names can't meet."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def name(key: str) -> str | None:
    return None if key == "-" else key[1:]


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).drop("copy")


def words_by_source(mixed: DataFrame) -> Iterator:
    """A report of the mix: target and taken words by source."""
    return mixed.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"))
