"""Texts for a language model to read, and what is made of its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.temporal import clamped
from lorebase.storage import globally_ranked, materialise

#: Texts that are packed one after another; a chunk never goes beyond such a stretch.
STRETCH = 5_000
#: Parts that the ids of one pattern are dealt to.
PARTS = 64


def packed(items: DataFrame, group: str, order: list[str], text: str, cap: int = 24_000, between: str = "\n\n---\n\n") -> DataFrame:
    """(group, first, texts, chars, chunk): texts packed next-fit, in order, into chunks of at most ``cap`` characters.

    A text goes to the current chunk if it fits, with ``between`` before it unless it is the first; else it begins the next one; a
    longer text than ``cap`` is cut there.  Chunks end with their group, and with each
    stretch of ``STRETCH`` places in the order of all rows, so no task holds more than a
    stretch however large a group is.  ``first`` is the place of a chunk's first text.  Null and blank
    texts are left out; null groups are a group; ties in ``order`` go by the text.
    """
    rows = items.select(F.col(group).alias("_g"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.substring(F.col(text), 1, cap).alias("_t")).filter(F.trim("_t") != "")
    placed = globally_ranked(rows, F.col("_g").asc_nulls_first(), *[F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))], F.col("_t"), name="_place")
    held = materialise(placed.select("_g", "_place", F.floor((F.col("_place") - 1) / STRETCH).alias("_s"), F.length("_t").alias("_n"), "_t"), "packed")
    # One pass over a stretch: the place where each text's chunk begins.
    sizes = held.groupBy("_g", "_s").agg(F.array_sort(F.collect_list(F.struct("_place", "_n"))).alias("x"))
    start = F.struct(F.lit(0).cast("bigint").alias("first"), F.lit(0).alias("used"), F.array().cast("array<struct<place: bigint, first: bigint>>").alias("out"))
    gap = len(between)

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] > 0) & (acc["used"] + gap + x["_n"] <= cap)
        first = F.when(fits, acc["first"]).otherwise(x["_place"].cast("bigint"))
        return F.struct(first.alias("first"), F.when(fits, acc["used"] + gap + x["_n"]).otherwise(x["_n"]).cast("int").alias("used"), F.concat(acc["out"], F.array(F.struct(x["_place"].cast("bigint").alias("place"), first.alias("first")))).alias("out"))

    dealt = sizes.select(F.explode(F.aggregate("x", start, step)["out"]).alias("o")).select(F.col("o.place").alias("_place"), F.col("o.first").alias("first"))
    chunks = held.join(dealt, "_place").groupBy("_g", "first").agg(F.array_sort(F.collect_list(F.struct("_place", "_t"))).alias("x"))
    whole = F.array_join(F.transform("x", lambda x: x["_t"]), between)
    return chunks.select(F.col("_g").alias(group), "first", F.size("x").cast("bigint").alias("texts"), F.length(whole).cast("bigint").alias("chars"), whole.alias("chunk"))


# -- answers ------------------------------------------------------------------------------------

#: What an answer may hold, by kind: the fields that name a pattern's subject, predicate and object.
KINDS = {
    "facts": ("subject", "predicate", "object"), "relationships": ("entity_a", "relation", "entity_b"),
    "arguments": ("claim", "stance", "topic"), "events": ("actor", "action", "target"),
}


def answer_json(answer: Column) -> Column:
    """The JSON of an answer: without the fence around it, from the first brace to the last, or of an array from bracket to bracket."""
    bare = F.regexp_replace(F.trim(answer), r"\A```[a-zA-Z]*\n|\n?```\s*\z", "")
    return F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)\A[^\[{]*(\{.*\})", 1), F.lit("")), F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), F.lit("")))


def extracted(answers: DataFrame, id_col: str, answer_col: str) -> tuple[DataFrame, DataFrame]:
    """Patterns of answers, and the answers that hold none.

    Patterns: (id, kind, subject, predicate, object, confidence), one for each typed item; a bare
    array holds facts.  Confidence is bounded, and 0.7 if it can't be read.  An item without a subject or
    object, or of a wrong form, is rejected alone.  Rejected: (id, reason, item): ``no json``, ``broken json`` with
    the whole answer, ``incomplete`` with the item's JSON.
    """
    read = answers.select(F.col(id_col).alias("id"), F.col(answer_col).alias("answer"), answer_json(F.col(answer_col)).alias("_j"))
    parsed = materialise(read.withColumn("_v", F.try_parse_json("_j")).withColumn("_is", F.schema_of_variant("_v")).select("id", "answer", "_j", "_v", F.col("_is").startswith("ARRAY").alias("_bare")), "answers")
    # The items of all kinds in one pass.
    of_kind = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x"))
    lists, none_ = [], F.array().cast("array<struct<kind: string, x: variant>>")
    for kind in KINDS:
        whole = F.try_variant_get("_v", f"$.{kind}", "array<variant>")
        listed = F.when(F.col("_bare"), F.try_variant_get("_v", "$", "array<variant>")).otherwise(whole) if kind == "facts" else whole
        lists.append(F.coalesce(F.transform(listed, of_kind(kind)), none_))
    each = parsed.filter("_v is not null").select("id", F.explode(F.concat(*lists)).alias("_e")).select("id", "_e.kind", "_e.x")

    def field(place: int) -> Column:
        by_kind = F.coalesce(*[F.when(F.col("kind") == kind, F.try_variant_get("x", f"$.{names[place]}", "string")) for kind, names in KINDS.items()])
        return F.nullif(F.trim(by_kind), F.lit(""))

    items = each.select("id", "kind", field(0).alias("subject"), field(1).alias("predicate"), field(2).alias("object"), clamped(F.try_variant_get("x", "$.confidence", "string")).alias("confidence"), F.to_json("x").alias("item"))
    good = F.col("subject").isNotNull() & F.col("object").isNotNull()
    none = parsed.filter("_v is null").select("id", F.when(F.col("_j").isNull(), "no json").otherwise("broken json").alias("reason"), F.col("answer").alias("item"))
    return items.filter(good).drop("item"), none.unionByName(items.filter(~good).select("id", F.lit("incomplete").alias("reason"), "item"))


def distinct_patterns(patterns: DataFrame, most: int = 10) -> DataFrame:
    """Patterns that say the same in any case of letters as one: the highest confidence, how often, and up to ``most`` ids, the smallest first."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    key = ["kind", "subject", "predicate", "object"]
    said = patterns.select("kind", *[low(F.col(c)).alias(c) for c in key[1:]], "id", "confidence", F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("_part"))
    # The smallest ids of each part of a pattern's ids, then of its parts: no pattern gathers all of its ids, and none lies in one task.
    ranked = said.withColumn("_r", F.dense_rank().over(Window.partitionBy(*key, "_part").orderBy("id")))
    parts = ranked.groupBy(*key, "_part").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("_r") <= most, F.col("id"))).alias("ids"))
    evidence = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most)
    return parts.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.sum("n").alias("occurrences"), evidence.alias("evidence"))
