"""Retrieval over several memories: signals from the graph, seeds, back-fill, one list of memories."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lorebase.functions import scoring, temporal
from lorebase.operators.graph import both_ways, pagerank

MEMORIES = "memory_type", "id", "score", "content"


def nearness(edges: DataFrame, seeds: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, near): personalised rank of each node from the seeds, by undirected edges, against the highest (so in [0, 1])."""
    ranks = pagerank(both_ways(edges.select("src", "dst")), rounds=rounds, seeds=seeds)
    best = F.broadcast(ranks.agg(F.max("rank").alias("_best")))  # one row
    return ranks.crossJoin(best).select("node", F.when(F.col("_best") > 0, F.col("rank") / F.col("_best")).otherwise(0.0).alias("near"))


def seeded(scored: DataFrame, node: str, key: str, k: int = 5) -> DataFrame:
    """(node): where a query begins in the graph, the subjects of the k beliefs that answer it best."""
    return scoring.top(scored, "score", key, k).select(F.col(node).alias("node")).distinct()


def with_topic(terms: list[str], topic: str | None) -> list[str]:
    """A query's terms and those of the topic at hand."""
    return list(dict.fromkeys([*terms, *scoring.query_terms(topic or "")]))


def newest(df: DataFrame, at: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.col(at).desc(), F.col(key).desc()).limit(k)


def back_filled(found: DataFrame, beliefs: DataFrame, terms: list[str], k: int, key: str = "belief_id") -> DataFrame:
    """What a search found, and then beliefs that name a term as subject or object, until there are k.

    found: (key, score); back-filled beliefs have their confidence as score and come after all found.
    """
    low = [t.lower() for t in terms]
    named = beliefs.filter(F.lower("subject").isin(low) | F.lower("object").isin(low))
    rest = named.join(found.select(key), key, "left_anti").select(key, F.col("confidence").alias("score"), F.lit(1).alias("_later"))
    every = found.select(key, "score", F.lit(0).alias("_later")).unionByName(rest)
    return every.orderBy("_later", F.col("score").desc(), key).limit(k).select(key, "score", (F.col("_later") == 1).alias("back_filled"))


def remembered_beliefs(scored: DataFrame, key: str = "belief_id") -> DataFrame:
    """Beliefs as memories; without content their statement is shown."""
    said = F.coalesce(F.nullif("content", F.lit("")), F.format_string("(%s, %s, %s)", "subject", "predicate", "object")) if "content" in scored.columns else F.format_string("(%s, %s, %s)", "subject", "predicate", "object")
    return scored.select(F.lit("belief").alias("memory_type"), F.col(key).cast("string").alias("id"), "score", said.alias("content"))


def remembered_experiences(e: DataFrame, as_of: str, key: str = "experience_id") -> DataFrame:
    """Experiences as memories, by how recent they are: what happened, and what came of it."""
    score = scoring.recency(temporal.age_seconds(F.col("occurred_at"), as_of) / 3600)
    return e.select(F.lit("experience").alias("memory_type"), F.col(key).cast("string").alias("id"), score.alias("score"), F.concat("content", F.coalesce(F.concat(F.lit(" → "), "outcome"), F.lit(""))).alias("content"))


def remembered_procedures(p: DataFrame, key: str = "procedure_id") -> DataFrame:
    """Procedures as memories, by confidence times success: name and steps."""
    score = F.col("confidence") * success_rate(F.col("successes"), F.col("failures"))
    return p.select(F.lit("procedure").alias("memory_type"), F.col(key).cast("string").alias("id"), score.alias("score"), F.concat("name", F.lit(": "), F.array_join("steps", " → ")).alias("content"))


def remembered_working(w: DataFrame) -> DataFrame:
    """Live entries of working memory as memories; they are all at hand."""
    return w.select(F.lit("working").alias("memory_type"), F.col("key").alias("id"), F.lit(1.0).alias("score"), F.concat("key", F.lit(" = "), F.col("value").cast("string")).alias("content"))


def success_rate(successes: Column, failures: Column) -> Column:
    n = F.coalesce(successes, F.lit(0)) + F.coalesce(failures, F.lit(0))
    return F.when(n == 0, 0.5).otherwise(F.coalesce(successes, F.lit(0)) / n)


def evidence_ratio(positive: Column, negative: Column) -> Column:
    """Share of the evidence that speaks for a belief, 0.5 without any."""
    return success_rate(F.size(positive), F.size(negative))


def classified(answer: Column) -> Column:
    """(kind, confidence) of a memory as a classifier answers; without an answer it is a belief at 0.5.

    answer: such a struct or null, from a rule or a language model's UDF.
    """
    return F.coalesce(answer, F.struct(F.lit("belief").alias("kind"), F.lit(0.5).alias("confidence")))


def limited(memories: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The best of each kind of memory, each kind by its own limit."""
    out = None
    for kind, n in limits.items():
        best = scoring.top(memories.filter(F.col("memory_type") == kind), "score", "id", n)
        out = best if out is None else out.unionByName(best)
    return out


def unified(beliefs: DataFrame, experiences: DataFrame, procedures: DataFrame, terms: list[str], as_of: str, limits: tuple[int, int, int]) -> DataFrame:
    """One list of memories: scored beliefs, and the experiences and procedures that name a term."""
    named = lambda *c: F.arrays_overlap(F.split(F.lower(F.concat_ws(" ", *c)), "[^a-z0-9]+"), F.array(*[F.lit(t.lower()) for t in terms])) if terms else F.lit(True)
    every = remembered_beliefs(beliefs).unionByName(remembered_experiences(experiences.filter(named("content", "outcome")), as_of)).unionByName(remembered_procedures(procedures.filter(named("name", "description", "trigger"))))
    return limited(every, dict(zip(("belief", "experience", "procedure"), limits, strict=True)))


def context_text(memories: Iterable[Row], title: str = "Relevant memories") -> str:
    """Memories as text to put before a conversation; empty without any."""
    rows = sorted(memories, key=lambda r: (r.memory_type, -r.score, r.id))
    return "\n".join([f"{title}:", *(f"- [{r.memory_type}] {r.content} ({r.score:.2f})" for r in rows)]) if rows else ""


def assumed(decisions: DataFrame, key: str = "decision_id") -> DataFrame:
    """(src, dst, edge_type, weight): from each decision to the beliefs that it assumes."""
    a = decisions.select(F.col(key).alias("src"), F.explode("assumptions").alias("a"))
    return a.select("src", F.col("a.belief_id").alias("dst"), F.lit("assumes").alias("edge_type"), F.col("a.confidence_at_decision").alias("weight"))


def known_facts(texts: DataFrame, beliefs: DataFrame, key: str, candidates: Column, most_entities: int = 15, per_entity: int = 3, most: int = 20) -> DataFrame:
    """(key, n, fact): what is already known of the entities that a text names, the first few of each, in order of entity.

    candidates: an array of names by text.
    """
    named = texts.select(key, F.posexplode(F.slice(F.array_sort(F.array_distinct(candidates)), 1, most_entities)).alias("e", "entity"))
    facts = beliefs.select("belief_id", F.concat_ws(" ", "subject", "predicate", "object").alias("fact"), F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"))
    best = facts.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy("belief_id"))).filter(F.col("r") <= per_entity)
    best = best.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "fact"))), lambda f: f["fact"]).alias("facts"))
    # A text's entities and their facts are few: they travel once, as lists, and are put in order in one row.
    met = named.join(best, "entity").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("e", "facts"))).alias("met"))
    first = F.slice(F.array_distinct(F.flatten(F.transform("met", lambda m: m["facts"]))), 1, most)
    return met.select(key, F.posexplode(first).alias("n", "fact")).select(key, (F.col("n") + 1).alias("n"), "fact")
