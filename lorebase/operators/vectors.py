"""Nearest neighbours by an inverted file over coarse centroids.

Unit vectors are stored once, in a table partitioned by the list of their nearest centroid; a
search reads only the lists that it probes.  Centroids are learned by k-means on a bounded
sample: nearest centroids in Arrow batches, means by aggregates.  Their number is a parameter, so
they are few whatever the table's size and travel with the tasks.

A list with many vectors is cut into parts by a hash of the id (``PART`` vectors each), so a
list of a third of all rows is as many tasks as it needs.  A part scores the queries that probe it
by one matrix product and hands on each query's best ``k``.

Scores are exact cosines; only which lists are probed is approximate.  With ``exact`` the lists
that could hold something better than a query's k-th best are probed as well: by the triangle
inequality on the sphere, a list whose members lie within an angle r of its centroid holds nothing
nearer than the query's angle to the centroid less r.

Defined cases: a null vector, one of another length or of length zero is in no list and asks for nothing;
ties go to the smaller id; ids are taken to be unique; an empty table finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.scoring import dot, unit
from lorebase.storage import materialise, new_folder

#: Vectors of a part, decimals of a score.
PART, DECIMALS = 50_000, 6


def sound(v: Column, dim: int) -> Column:
    """Whether a vector has a direction."""
    square = dot(v, v)
    return v.isNotNull() & (F.size(v) == dim) & (square > 0) & ~F.isnan(square) & (square < float("inf"))


def nearest(centroids: np.ndarray, n: int) -> Column:
    """A function of a unit vector: the n nearest centroids, and the cosine with each."""

    @F.pandas_udf("array<struct<list: int, cosine: double>>")
    def of(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        cosines = np.stack(vectors.to_numpy()) @ centroids.T
        best = np.argsort(-cosines, axis=1, kind="stable")[:, :n]
        return pd.Series([[{"list": int(j), "cosine": float(c[j])} for j in b] for b, c in zip(best, cosines, strict=True)])

    return of


def centroids(units: DataFrame, lists: int, dim: int, rounds: int, sample: int) -> np.ndarray:
    """k-means of unit vectors (id, v) on ``sample`` of them, the smallest by a hash of the id; fewer centroids if there are fewer vectors."""
    chosen = materialise(units.orderBy(F.xxhash64("id"), "id").limit(sample), "index-sample")
    first = [r["v"] for r in chosen.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(lists).collect()]
    means = np.array(first, dtype=np.float64).reshape(-1, dim)
    for _ in range(rounds if len(means) else 0):
        near = chosen.select("v", nearest(means, 1)("v")[0]["list"].alias("list"))
        sums = near.groupBy("list").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(dim)]).alias("s")).collect()
        for r in sums:
            s = np.array(r["s"])
            means[r["list"]] = s / (np.linalg.norm(s) or 1.0)
    return means


@dataclass
class VectorIndex:
    """An index: where its vectors lie (list, part, id, v), its centroids, and how many parts and what radius a list has."""

    path: str
    means: np.ndarray
    parts: dict[int, int]
    radius: dict[int, float]
    dim: int

    def vectors(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.read.schema("part int, id bigint, v array<double>, list int").parquet(self.path)


def build(df: DataFrame, id_col: str, vector_col: str, lists: int = 64, dim: int = 64, rounds: int = 8, sample: int = 20_000) -> VectorIndex:
    """Index every sound vector of ``df``."""
    spark = df.sparkSession
    units = df.filter(sound(F.col(vector_col), dim)).select(F.col(id_col).cast("bigint").alias("id"), unit(F.col(vector_col)).alias("v"))
    means = centroids(units, lists, dim, rounds, sample)
    if not len(means):
        return VectorIndex("", means, {}, {}, dim)
    placed = materialise(units.select("id", "v", nearest(means, 1)("v")[0].alias("near")).select("id", "v", "near.*"), "index-placed")
    # As many rows as lists.
    found = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("c")).collect()
    parts = {r["list"]: -(-r["n"] // PART) for r in found}
    radius = {r["list"]: float(np.arccos(np.clip(r["c"], -1, 1))) for r in found}
    count = F.element_at(F.create_map(*[F.lit(x) for k, n in parts.items() for x in (k, n)]), F.col("list"))
    cut = placed.select("list", F.pmod(F.xxhash64("id"), count).cast("int").alias("part"), "id", "v")
    path = f"{new_folder(spark, 'vector-index')}/lists"
    cut.repartition("list", "part").write.partitionBy("list").parquet(path)
    return VectorIndex(path, means, parts, radius, dim)


def _probed(index: VectorIndex, asked: DataFrame, k: int) -> DataFrame:
    """The best k of every part that is asked: (query_id, id, score) of asked (query_id, q, list)."""
    parts = F.element_at(F.create_map(*[F.lit(x) for c, n in index.parts.items() for x in (c, n)]), F.col("list"))
    each = asked.select("query_id", "q", "list", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            vectors = np.stack(left.column("v").to_numpy())
            ids = left.column("id").to_numpy()
            for start in range(0, right.num_rows, 256):
                some = right.slice(start, 256)
                scores = np.round(np.stack(some.column("q").to_numpy()) @ vectors.T, DECIMALS) + 0.0
                for query, row in zip(some.column("query_id").to_pylist(), scores, strict=True):
                    reach = np.flatnonzero(row >= (np.partition(row, -k)[-k] if len(row) > k else -np.inf))
                    first = reach[np.lexsort((ids[reach], -row[reach]))[:k]]
                    out.append((np.full(len(first), query), ids[first], row[first]))
        columns = [np.concatenate(c) if out else np.zeros(0, kind) for c, kind in zip(zip(*out, strict=True) if out else [()] * 3, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table({"query_id": columns[0], "id": columns[1], "score": columns[2]})

    # At most as many as lists: partitions that no query probes are not read.
    wanted = [r["list"] for r in asked.select("list").distinct().collect()]
    lists = index.vectors(asked).filter(F.col("list").isin(wanted))
    found = lists.groupBy("list", "part").cogroup(each.groupBy("list", "part")).applyInArrow(best, "query_id bigint, id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k nearest of each query among the lists it probes, with ``exact`` among all."""
    if not index.parts:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    asked = queries.filter(sound(F.col(vector_col), index.dim)).select(F.col(id_col).cast("bigint").alias("query_id"), unit(F.col(vector_col)).alias("q"))
    near = materialise(asked.select("query_id", "q", nearest(index.means, len(index.means))("q").alias("near")), "index-queries")
    held = F.array(*[F.lit(c) for c in index.parts])
    lists = F.filter("near", lambda x: F.array_contains(held, x["list"]))
    first = near.select("query_id", "q", F.explode(F.slice(lists, 1, probes)).alias("x")).select("query_id", "q", "x.list")
    found = _probed(index, first, k)
    if not exact:
        return found.select("query_id", "rank", "id", "score")
    found = materialise(found, "index-first")
    least = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    radius = F.element_at(F.create_map(*[F.lit(x) for c, r in index.radius.items() for x in (c, r)]), F.col("x.list"))
    rest = near.join(least, "query_id", "left").select("query_id", "q", "least", F.explode(F.slice(lists, probes + 1, len(index.means))).alias("x"))
    bound = F.cos(F.greatest(F.lit(0.0), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x.cosine")))) - radius))
    rest = rest.filter(F.col("least").isNull() | (bound >= F.col("least") - 2 * 10.0**-DECIMALS)).select("query_id", "q", "x.list")
    both = found.unionByName(_probed(index, rest, k)).drop("rank")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
