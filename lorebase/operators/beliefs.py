"""Belief algebra: contradictions, support, inference, proofs, as-of states, updates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lorebase.functions import overlap
from lorebase.storage import materialise


def by_entity(beliefs: DataFrame, entity: str, each: int | None = None, key: str = "belief_id") -> DataFrame:
    """Beliefs with the entity as subject or object, by exact case, each once.

    each: at most so many on either side, subjects first; then with the column ``place``.
    """
    named = beliefs.filter((F.col("subject") == entity) | (F.col("object") == entity))
    if each is None:
        return named
    side = F.when(F.col("subject") == entity, 0).otherwise(1)
    best = named.withColumn("_side", side).withColumn("place", F.row_number().over(Window.partitionBy("_side").orderBy(key)))
    return best.filter(F.col("place") <= each).withColumn("place", F.col("place") + F.col("_side") * each).drop("_side")


def scan(triples: DataFrame, subject: str | None = None, object_: str | None = None, least: float = 0.0, k: int = 100, key: str = "belief_id") -> DataFrame:
    """Triples by subject, object and least probability (null counts as 1), the k most probable."""
    sure = F.coalesce("confidence", F.lit(1.0))
    out = triples.filter(sure >= least)
    out = out if subject is None else out.filter(F.col("subject") == subject)
    out = out if object_ is None else out.filter(F.col("object") == object_)
    return out.orderBy(sure.desc(), key).limit(k)


def contradiction_groups(beliefs: DataFrame) -> DataFrame:
    """Subjects and predicates with more than one object: one row a group, never a pair."""
    g = beliefs.groupBy(F.lower("subject").alias("subject"), F.lower("predicate").alias("predicate"))
    return g.agg(F.count_distinct(F.lower("object")).alias("objects"), F.count(F.lit(1)).alias("beliefs"), F.max("confidence").alias("top_confidence")).filter("objects > 1")


def contradiction_pairs(beliefs: DataFrame) -> DataFrame:
    """Pairs of beliefs with one subject and predicate and different objects, smaller id first.

    Meant for a bounded set of beliefs; contradiction_groups tells the same without pairs.
    """
    side = lambda p: beliefs.select(F.lower("subject").alias("s"), F.lower("predicate").alias("p"), F.col("belief_id").alias(f"{p}_id"), F.lower("object").alias(f"{p}_object"), F.col("confidence").alias(f"{p}_confidence"))
    pairs = side("a").join(side("b"), ["s", "p"]).filter("a_id < b_id and a_object != b_object")
    score = contradiction_score(F.col("a_confidence"), F.col("b_confidence"))
    return pairs.select("a_id", "b_id", F.col("s").alias("subject"), score.alias("score"))


def two_hop(beliefs: DataFrame, factor: float = 0.7, least: float = 0.3) -> DataFrame:
    """A-B and B-C give A-C, at the weaker confidence times factor; loops and weak links are dropped."""
    a = beliefs.select(F.col("belief_id").alias("id1"), F.col("subject").alias("s"), F.lower("object").alias("mid"), F.col("predicate").alias("p1"), F.col("confidence").alias("c1"))
    b = beliefs.select(F.col("belief_id").alias("id2"), F.lower("subject").alias("mid"), F.col("object").alias("o"), F.col("predicate").alias("p2"), F.col("confidence").alias("c2"))
    out = a.join(b, "mid").filter((F.col("id1") != F.col("id2")) & (F.lower("s") != F.lower("o")))
    return out.withColumn("confidence", F.least("c1", "c2") * factor).filter(F.col("confidence") >= least)


def three_hop(beliefs: DataFrame, factor: float = 0.5, least: float = 0.3) -> DataFrame:
    """One link more than a surviving two-hop chain, at the weakest confidence times factor."""
    two = two_hop(beliefs).select("id1", "id2", "s", F.lower("o").alias("mid2"), F.least("c1", "c2").alias("c"))
    c = beliefs.select(F.col("belief_id").alias("id3"), F.lower("subject").alias("mid2"), F.col("object").alias("o"), F.col("confidence").alias("c3"))
    out = two.join(c, "mid2").filter("id3 != id1 and id3 != id2").filter(F.lower("s") != F.lower("o"))
    return out.withColumn("confidence", F.least("c", "c3") * factor).filter(F.col("confidence") >= least).select("id1", "id2", "id3", "s", "o", "confidence")


def best_inferred(inferred: DataFrame) -> DataFrame:
    """One inferred belief for each pair of ends: the most trusted."""
    w = Window.partitionBy(F.lower("s"), F.lower("o")).orderBy(F.col("confidence").desc(), "id1", "id2")
    return inferred.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def backward_counts(beliefs: DataFrame, fresh: DataFrame) -> DataFrame:
    """What new beliefs say of each old one: same statement, another object, or a statement about its object.

    New beliefs are counted by statement first; all that an old one needs of a subject and
    predicate is their number and how many name its own object.
    """
    old = beliefs.select("belief_id", F.lower("subject").alias("s"), F.lower("predicate").alias("p"), F.lower("object").alias("o"))
    said = fresh.groupBy(F.lower("subject").alias("s"), F.lower("predicate").alias("p"), F.lower("object").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    every = said.groupBy("s", "p").agg(F.sum("n").alias("every"))
    about = said.groupBy(F.col("s").alias("o")).agg(F.sum("n").alias("about"))
    out = old.join(every, ["s", "p"], "left").join(said.withColumnRenamed("n", "confirmed"), ["s", "p", "o"], "left").join(about, "o", "left")
    out = out.select("belief_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("confirmed", "every", "about")]).filter("every + about > 0")
    return out.select("belief_id", "confirmed", (F.col("every") - F.col("confirmed")).alias("denied"), "about")


def exclusive(a: Column, b: Column) -> Column:
    """Whether two objects can't both hold: true/false, yes/no, X/not X, or different numbers."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    pair = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    negated = (a == F.concat(F.lit("not "), b)) | (b == F.concat(F.lit("not "), a))
    x, y = a.try_cast("double"), b.try_cast("double")
    return pair("true", "false") | pair("yes", "no") | negated | F.coalesce(x != y, F.lit(False))


def judged(candidates: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Candidates against beliefs on the same subject and predicate: how many support and contradict each.

    Beliefs are counted by statement and candidates met by statement, so a pair is made for each
    two different statements and not for each two rows.
    """
    c = candidates.select("candidate_id", F.lower("subject").alias("s"), F.lower("predicate").alias("p"), F.lower("object").alias("co"))
    b = beliefs.groupBy(F.lower("subject").alias("s"), F.lower("predicate").alias("p"), F.lower("object").alias("bo")).agg(F.count(F.lit(1)).alias("n"))
    both = c.select("s", "p", "co").distinct().join(b, ["s", "p"])
    support = F.contains("co", F.col("bo")) | F.contains("bo", F.col("co"))
    against = exclusive(F.col("co"), F.col("bo")) & ~support
    verdicts = both.groupBy("s", "p", "co").agg(F.sum(F.when(support, F.col("n")).otherwise(0)).alias("supports"), F.sum(F.when(against, F.col("n")).otherwise(0)).alias("contradicts"))
    out = c.join(verdicts, ["s", "p", "co"], "left")
    return out.select("candidate_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("supports", "contradicts")])


def conflicts(ranked: DataFrame) -> DataFrame:
    """Pairs of a bounded result set that contradict each other."""
    return contradiction_pairs(ranked).select("a_id", "b_id", "subject")


def contradiction_score(one: Column, two: Column) -> Column:
    """How far two exclusive statements are held at once: what their probabilities exceed 1 by."""
    return F.greatest(F.lit(0.0), one + two - 1)


def knowledge_proof(ranked: DataFrame, by_status: str = "status") -> DataFrame:
    """One row over ranked beliefs: number, sources, mean confidence, contested, contradictory subjects."""
    split = contradiction_groups(ranked).agg(F.count(F.lit(1)).alias("contradictions"))
    return ranked.agg(
        F.count(F.lit(1)).alias("beliefs"), F.count_distinct("source_id").alias("sources"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.count_if(F.col(by_status) == "contested").alias("contested"),
    ).crossJoin(F.broadcast(split))


def full_proof(ranked: DataFrame, as_of: str, key: str = "belief_id", **how) -> DataFrame:
    """:func:`knowledge_proof` of a bounded result set with each belief's validity, the evidence for and against, and the mean of what confidence is left."""
    from lorebase.functions import temporal

    v = temporal.validity(F.col("confidence"), F.col("observed_at"), F.col("valid_from"), F.col("valid_until"), F.col("ttl_seconds"), as_of, **how)
    judged_ = ranked.withColumn("_v", v)
    more = judged_.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("_v.reason"))))).alias("validity"), F.count_if("_v.is_valid").alias("valid"),
        F.avg("_v.confidence").alias("mean_left"), F.count_if(F.col("status") == "validated").alias("evidence_for"), F.count_if(F.col("status") != "validated").alias("evidence_against"),
    )
    return knowledge_proof(ranked).crossJoin(F.broadcast(more))  # both are one row


def brief(facts: DataFrame, precedents: DataFrame, unsure: float = 0.5) -> DataFrame:
    """One row: facts found, those that are unsure, their mean confidence and entropy, and earlier decisions."""
    f = facts.agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("confidence") < unsure).alias("uncertain"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.round(F.avg(1 - F.col("confidence")), 6).alias("avg_uncertainty"))
    return f.crossJoin(F.broadcast(precedents.agg(F.count(F.lit(1)).alias("precedents"))))  # both are one row


def snapshot(beliefs: DataFrame, chosen: DataFrame, snapshot_id: str, key: str = "belief_id") -> DataFrame:
    """An immutable copy of the chosen beliefs, to be appended to a snapshot table."""
    return beliefs.join(chosen.select(key).distinct(), key, "left_semi").withColumn("snapshot_id", F.lit(snapshot_id))


def verdict(claims: DataFrame) -> Column:
    """Of the columns contradictions, best (confidence or null): what is known of a claim."""
    return (
        F.when(F.col("contradictions") > 0, "contested").when(F.col("best").isNull(), "unknown").when(F.col("best") >= 0.7, "supported").when(F.col("best") >= 0.5, "weakly_supported").otherwise("unsupported")
    )


def as_of(history: DataFrame, key: str, at: str, when: Column) -> DataFrame:
    """The latest state of each key at or before a moment; later entries of one instant win by entry id."""
    past = history.filter(F.col(at) <= when)
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col("entry_id").desc())
    return past.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def as_of_join(left: DataFrame, history: DataFrame, key: str, left_at: str, at: str, values: list[str]) -> DataFrame:
    """To each left row the latest history of its key at or before it, in one pass: union, sort, carry forward.

    No pairs are made, whatever the number of entries of a key.
    """
    mine = left.select("*", F.lit(1).alias("_side"), F.col(left_at).alias("_at"), *[F.lit(None).cast(history.schema[v].dataType).alias(v) for v in values], F.lit(None).cast("boolean").alias("_has"))
    theirs = history.select(key, *values, F.col(at).alias("_at")).withColumns({"_side": F.lit(0), "_has": F.lit(True)})
    every = mine.unionByName(theirs, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_has"), F.struct(*values)), ignorenulls=True).over(w)
    return every.withColumn("_s", seen).filter("_side = 1").select(*left.columns, *[F.col(f"_s.{v}").alias(v) for v in values])


def drift(assumptions: DataFrame, now: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Active decisions whose critical assumptions have moved by more than threshold: assumption's subject against its confidence now."""
    held = assumptions.filter("critical")
    held = held.filter(F.col("status") == "active") if "status" in held.columns else held
    moved = held.join(now.select("subject", F.col("confidence").alias("confidence_now")), "subject")
    moved = moved.withColumn("drift", F.abs(F.col("confidence_now") - F.col("confidence_then")))
    return moved.groupBy("decision_id").agg(F.max("drift").alias("max_drift")).filter(F.col("max_drift") > threshold).withColumn("status", F.lit("revisit_suggested"))


def bayes(prior: Column, confirmed: Column, denied: Column) -> Column:
    """(mean, low, high): Beta posterior of a prior worth two observations; the interval is the normal one at 95 %."""
    a, b = 2 * prior + confirmed, 2 * (1 - prior) + denied
    mean = a / (a + b)
    half = 1.96 * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return F.struct(mean.alias("mean"), F.greatest(F.lit(0.0), mean - half).alias("low"), F.least(F.lit(1.0), mean + half).alias("high"))


#: Words that turn a statement round (fixed values).
NEGATIONS = ("not", "no", "never", "incorrect", "wrong", "false")


def cross_reference(internal: DataFrame, external: DataFrame, least: float = 0.3) -> DataFrame:
    """Texts of two sides that share words: shared / smaller > least; agreement unless just one side negates.

    Most pairs of texts share some word, so none are shuffled: texts lie in blocks, and every block
    meets every other within a task, by a cartesian product that writes nothing and holds one
    partition of blocks.  Rows with one id, or none, are rows like any other.
    """
    spark = internal.sparkSession

    def side(df: DataFrame, p: str) -> DataFrame:
        words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[\t\n\f\r ]+"), lambda w: w != ""))
        sets = df.select("id", words.alias("w")).filter(F.size("w") > 0).withColumn("mark", F.exists("w", lambda w: w.isin(*NEGATIONS)))
        schema = overlap.block_schema(p, df.schema["id"].dataType.simpleString())
        # Dealt to all cores, as the partitions of both sides' blocks are what tasks are made of.
        return materialise(sets.repartition(spark.sparkContext.defaultParallelism).mapInArrow(overlap.blocked(p, _arrow(schema)), schema), "cross-reference")

    a, b = side(internal, "a"), side(external, "b")
    schema = f"a_id {internal.schema['id'].dataType.simpleString()}, b_id {external.schema['id'].dataType.simpleString()}, overlap double, differ boolean"
    full = a.hint("shuffle_replicate_nl").crossJoin(b).mapInArrow(overlap.pairs(least, _arrow(schema)), schema)
    return full.select("a_id", "b_id", "overlap", F.when(F.col("differ"), "contradict").otherwise("agree").alias("kind"))


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def candidate_confidence(confidence: Column, evidence: Column, occurrences: Column) -> Column:
    return F.least(F.lit(0.95), confidence + F.least(F.lit(0.2), 0.02 * evidence) + F.least(F.lit(0.2), 0.02 * occurrences))


def generalised(beliefs: DataFrame, *keys: str, other: str, least: int = 3) -> DataFrame:
    """Groups of ``least`` beliefs or more that agree in keys: how many, how sure, and their first members."""
    g = beliefs.groupBy(*[F.lower(k).alias(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("members"), F.avg("confidence").alias("avg_confidence"), F.count_distinct(other).alias("distinct_members"), F.min(other).alias("first_member"))
    g = g.filter(F.col("members") >= least)
    return g.withColumn("confidence", F.round(F.least(F.lit(0.9), F.col("avg_confidence") + 0.1), 6)).withColumn("avg_confidence", F.round("avg_confidence", 6))
