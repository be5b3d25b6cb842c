"""Connected components of a large graph, by large and small stars.

Each round points every node at the smallest node it has seen among its neighbours (first for
larger neighbours, then for smaller ones); the rounds needed grow with the logarithm of the
longest path.  Only minima and joins are used, no node's neighbours are ever gathered, and
each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.storage import materialise, released


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of comparable ids: (node, root) for every node of an edge, root the smallest node it is linked with.

    Loops, repeated edges and both directions are allowed; null ends are dropped.
    """
    edges = edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, state = materialise(edges, "edges"), None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not now["n"] or (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
        # Large star: what is larger than a node goes to the smallest of the node and its neighbours.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, materialise(small.filter("u != v").distinct(), "edges")
        released(before)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
