"""Signals of retrieval and how they are fused."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.storage import globally_ranked, materialise

LN2 = 0.693


@dataclass(frozen=True)
class Profile:
    """Weights of a retrieval profile; entropy direction is ``high`` or ``low``."""

    vector: float = 0.3
    text: float = 0.1
    temporal: float = 0.15
    half_life_days: float = 30
    confidence: float = 0.2
    graph: float = 0.15
    entropy: float = 0.1
    direction: str = "low"

    def weights(self) -> dict[str, float]:
        """The weights of the fused signals; a weight of 0 leaves the signal out."""
        return {k: w for k in ("vector", "text", "temporal", "confidence", "graph") if (w := getattr(self, k))}


#: The presets.
PROFILES = {
    "decision_support": Profile(0.3, 0.1, 0.15, 30, 0.25, 0.15, 0.05, "low"),
    "exploration": Profile(0.4, 0.2, 0.05, 365, 0.1, 0.1, 0.15, "high"),
    "context_recall": Profile(0.2, 0.1, 0.3, 7, 0.1, 0.25, 0.05, "low"),
}


#: The signals that a weight can be given to.
SIGNALS = ("vector", "text", "temporal", "confidence", "graph")


def usable_weights(weights: dict[str, float]) -> dict[str, float]:
    """The weights of known signals, without those of none."""
    return {k: w for k, w in weights.items() if k in SIGNALS and w}


def query_terms(query: str) -> list[str]:
    """The terms of a query as :func:`bm25` knows them, each once."""
    return list(dict.fromkeys(t for t in re.split("[^a-z0-9]+", query.lower()) if t))


def entropy(p: Column, bits: bool = False) -> Column:
    """Bernoulli entropy of a probability; 0 at 0 and 1."""
    h = -(p * F.log(p) + (1 - p) * F.log(1 - p))
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(h / F.log(F.lit(2.0)) if bits else h)


def reranked(score: Column, entropy_nats: Column, weight: float, direction: str = "low") -> Column:
    """Score mixed with certainty (low) or uncertainty (high); weight 0 changes nothing."""
    e = F.least(entropy_nats / LN2, F.lit(1.0))
    return score * (1 - weight) + (e if direction == "high" else 1 - e) * weight


def recency(age_hours: Column, span_hours: float = 168) -> Column:
    return F.greatest(F.lit(0.0), 1 - age_hours / span_hours)


def temporal(age_hours: Column, half_life_hours: float) -> Column:
    return F.exp(-0.6931471805599453 * age_hours / half_life_hours)


def dot(x: Column, y: Column) -> Column:
    """Inner product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(x: Column) -> Column:
    """An array of length one in doubles, to be stored once so that a cosine is a single inner product."""
    return F.transform(x, lambda v: v.cast("double") / F.sqrt(dot(x, x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in doubles."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def weighted(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of weight times signal over the signals that weigh anything."""
    out = F.lit(0.0)
    for name, w in weights.items():
        if w and name in signals:
            out = out + w * F.coalesce(signals[name], F.lit(0.0))
    return out


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best rows: score down, key up."""
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(key).asc_nulls_last()).limit(k)


def fuse_ranks(ranked: dict[str, DataFrame], key: str, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of lists of (key, score): the sum of weight / (k + rank) by key."""
    parts = []
    for name, df in ranked.items():
        placed = globally_ranked(df, F.col("score").desc(), F.col(key))
        parts.append(placed.select(key, ((weights or {}).get(name, 1.0) / (k + F.col("rank"))).alias("part")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("part").alias("score"))


def bm25(docs: DataFrame, terms: list[str], key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of every document that holds a query term; words are lower-cased runs of letters and digits.

    Terms are filtered before anything is exploded, so only their postings are counted.
    """
    # The text is read once: its length and the terms that it has go to a table, from which everything else is counted.
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    read = docs.select(F.col(key), words.alias("words")).select(key, F.size("words").alias("dl"), F.filter("words", lambda w: w.isin(terms)).alias("hits"))
    lengths = materialise(read, "bm25-lengths")
    corpus = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    postings = lengths.filter(F.size("hits") > 0).select(key, "dl", F.explode("hits").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = postings.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))  # df has a row a query term, corpus one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return scored.groupBy(key).agg(F.sum(part).alias("score"))
