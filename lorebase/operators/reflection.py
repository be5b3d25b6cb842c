"""Reflection: group experiences, find patterns, weigh what matters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.plans.views import micros
from lorebase.storage import globally_ranked, materialise, released


def gap_sessions(events: DataFrame, by: str, at: str, gap_seconds: int = 1800, least: int = 2) -> DataFrame:
    """Sessions of events at most a gap apart (inclusive), with at least ``least`` members: bounds and size."""
    order = Window.partitionBy(by).orderBy(at)
    new = (micros(F.col(at)) - micros(F.lag(at).over(order))) > gap_seconds * 1_000_000
    marked = events.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    run = marked.withColumn("session", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    g = run.groupBy(by, "session").agg(F.count(F.lit(1)).alias("members"), F.min(at).alias("start"), F.max(at).alias("end"))
    return g.filter(F.col("members") >= least)


def session_groups(experiences: DataFrame, least: int = 2) -> DataFrame:
    g = experiences.groupBy("session_id").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("outcome") == "success").alias("successes"), F.count_distinct("content").alias("kinds"))
    return g.filter(F.col("members") >= least)


#: A capitalised phrase between ASCII word boundaries, and a quoted one.
CAPITALISED, QUOTED = r"(?<![A-Za-z0-9_])[A-Z][a-z]++(?![A-Za-z0-9_])(?: [A-Z][a-z]++(?![A-Za-z0-9_]))*+", r'"([^"]+)"'


def entities_in(text: Column) -> Column:
    """Capitalised and quoted phrases of a text, each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0)), F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))))


#: Keys of an experience's context that name entities, and words that name none (fixed values).
NAMING = ("entity", "subject", "topic", "user", "name")


def all_entities(text: Column, context: Column, tags: Column) -> Column:
    """Phrases of a text, what its context names, and its tags, each once; context is a map of strings."""
    named = F.filter(F.transform(F.array(*[F.lit(k) for k in NAMING]), lambda k: context[k]), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(entities_in(text), F.coalesce(named, F.array().cast("array<string>")), F.coalesce(tags, F.array().cast("array<string>"))))


#: Phrases of two capitalised words or more, and single ones of three letters or more.
PHRASE, SINGLE = r"(?<![A-Za-z0-9_])[A-Z][a-z]++(?:\s++[A-Z][a-z]++(?![A-Za-z0-9_]))++", r"(?<![A-Za-z0-9_])[A-Z][a-z]{2,}+(?![A-Za-z0-9_])"


def name_candidates(text: Column, stop_words: Sequence[str]) -> Column:
    """What may be names in a text, in order: phrases, and single words that are no stop words."""
    single = F.filter(F.regexp_extract_all(text, F.lit(SINGLE), F.lit(0)), lambda w: ~F.lower(w).isin(list(stop_words)))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)), single)))


def entity_groups(items: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """Inverted index of entities by lower case: how many items name each."""
    named = items.select(key, F.explode(F.array_distinct(F.transform(entities_in(F.col(text)), F.lower))).alias("entity"))
    return named.groupBy("entity").agg(F.count(F.lit(1)).alias("items")).filter(F.col("items") >= least)


def common_tags(groups: DataFrame, group: str, tag: str) -> DataFrame:
    """Tags that at least two and at least half (rounded down) of a group's rows carry."""
    size = groups.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    tags = groups.groupBy(group, tag).agg(F.count(F.lit(1)).alias("uses"))
    return tags.join(size, group).filter(F.col("uses") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2))).select(group, tag, "uses")


def session_profiles(events: DataFrame, session: str, at: str, tag: str, entities: Column, least: int = 2) -> DataFrame:
    """Sessions of ``least`` members or more: size, bounds, their common tags, and the number of entities that two members name.

    A common tag is on half of the rows at least, so a session has few of them, whatever its size.
    """
    size = events.groupBy(session).agg(F.count(F.lit(1)).alias("members"), F.min(at).alias("start"), F.max(at).alias("end")).filter(F.col("members") >= least)
    tags = common_tags(events, session, tag).groupBy(session).agg(F.array_sort(F.collect_list(tag)).alias("tags"))
    named = events.select(session, F.explode(F.array_distinct(F.transform(entities, F.lower))).alias("e")).groupBy(session, "e").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    shared = named.groupBy(session).agg(F.count(F.lit(1)).alias("entities"))
    out = size.join(tags, session, "left").join(shared, session, "left")
    return out.select(session, "members", "start", "end", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("entities", F.lit(0)).alias("entities"))


#: Sets of up to ``SMALL`` members meet by ``TOGETHER`` of their rarer members at once, larger ones by one.
SMALL, TOGETHER = 24, 3
#: Groups of one class that travel in a row.
BLOCK = 1024


def _classes(members: DataFrame, group: str, item: str) -> DataFrame:
    """(group, class, place, s, n): the smallest group with just the same items, the place among those, and the first one's items from the rarest on."""
    m = members.select(F.col(group).alias("group"), F.col(item).alias("item")).dropna().distinct()
    m = m.join(m.groupBy("item").agg(F.count(F.lit(1)).alias("f")), "item")
    sets = m.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("f", "item")))["item"].alias("s"))
    w = Window.partitionBy("s").orderBy("group")
    placed = sets.select("group", F.first("group").over(w).alias("class"), F.row_number().over(w).alias("place"), "s")
    return materialise(placed.select("group", "class", "place", F.when(F.col("place") == 1, F.col("s")).alias("s"), F.size("s").alias("n")), "similar-groups")


def _similar_classes(classes: DataFrame, above: float) -> DataFrame:
    """(a, b, jaccard): pairs of different sets, a < b, whose Jaccard exceeds a threshold.

    Prefix filter: similar sets share ``least`` items, so with items in order of rarity they share
    k of the first ``n - least + k``.  Where a set has few items those are taken ``TOGETHER``, so
    that what meets does not grow with how often an item is used.
    """
    sets = classes.filter("place = 1").select("class", "s", "n").filter(F.col("n") / (F.col("n") + 1) > above)
    under = F.floor(above * F.col("n"))
    sets = sets.withColumn("least", F.when(under / F.col("n") > above, under).otherwise(under + 1).cast("int"))
    sets = sets.withColumn("small", (F.col("n") <= SMALL) & (F.col("least") >= TOGETHER))
    first = lambda k: F.slice("s", F.lit(1), F.least(F.col("n"), F.col("n") - F.col("least") + k))

    several = sets.filter("small").select("class", "n", first(TOGETHER).alias("p"), F.lit(0).alias("at"), F.array().cast(classes.schema["s"].dataType).alias("key"))
    for _ in range(TOGETHER):
        rest = F.slice("p", F.col("at") + 1, F.greatest(F.lit(0), F.size("p") - F.col("at")))
        several = several.select("class", "n", "p", "at", "key", F.posexplode(rest).alias("i", "x")).select("class", "n", "p", (F.col("at") + F.col("i") + 1).alias("at"), F.concat("key", F.array("x")).alias("key"))
    one = sets.select("class", "n", "small", F.explode(first(1)).alias("key"))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        few, many = F.least("an", "bn"), F.greatest("an", "bn")
        best = F.when(few == many, (few - 1) / (few + 1)).otherwise(few / many)  # they are not the same set
        a, b = (x.select("key", F.col("class").alias(p), F.col("n").alias(f"{p}n")) for x, p in ((left, "a"), (right, "b")))
        return a.join(b, "key").filter((F.col("a") != F.col("b")) & (best > above)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    pairs = met(several, several).unionByName(met(one.filter("not small"), one)).distinct()
    full = pairs.join(sets.select(F.col("class").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("class").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    jaccard = shared / (F.size("sa") + F.size("sb") - shared)
    return full.select("a", "b", jaccard.alias("jaccard")).filter(F.col("jaccard") > above)


def similar_groups(members: DataFrame, group: str, item: str, above: float = 0.8) -> DataFrame:
    """Pairs of groups whose members' Jaccard exceeds a threshold (below 1).

    Groups with just the same items are a class and only classes are compared; pairs of groups
    come of them last, from rows that hold up to ``BLOCK`` groups of a class, and are not shuffled.
    """
    classes = _classes(members, group, item)
    blocks = classes.groupBy("class", F.floor((F.col("place") - 1) / BLOCK).alias("block")).agg(F.collect_list("group").alias("groups"))
    several = classes.filter("place = 2").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("jaccard"))
    pairs = _similar_classes(classes, above).unionByName(several)
    side = lambda p: blocks.select(F.col("class").alias(p), F.col("block").alias(f"{p}_block"), F.col("groups").alias(f"{p}_groups"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").filter("a != b or a_block <= b_block")
    each = full.select("jaccard", ((F.col("a") == F.col("b")) & (F.col("a_block") == F.col("b_block"))).alias("own"), F.explode("a_groups").alias("x"), "b_groups")
    each = each.select("jaccard", "own", "x", F.explode("b_groups").alias("y")).filter("x < y or not own")
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("jaccard", 6).alias("jaccard"))


def first_of_similar(members: DataFrame, group: str, item: str, above: float = 0.8) -> DataFrame:
    """Groups that stay when each is dropped if it resembles an earlier one that stays; see :func:`first_wins`.

    Of groups with just the same items none but the first can stay, as what drops the first drops
    them all; so pairs of different sets are enough.
    """
    classes = _classes(members, group, item)
    groups = members.select(group).distinct().join(classes.filter("place > 1").select(F.col("group").alias(group)), group, "left_anti")
    return first_wins(groups, _similar_classes(classes, above), group)


def first_wins(groups: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """Groups that stay when each is dropped if it resembles an earlier one that stays; pairs are (a, b), a the earlier.

    A group is settled as soon as all earlier ones that it resembles are: rounds grow with the
    longest chain of resemblance, not with the number of groups.  Each settles the earliest open
    group at least, so all get settled.
    """
    pairs = materialise(pairs.select("a", "b").filter("a < b"), "first-wins-pairs")
    state = materialise(groups.select(F.col(group).alias("g")).withColumn("kept", F.lit(None).cast("boolean")), "first-wins")
    while True:
        earlier = pairs.join(state.select(F.col("g").alias("a"), F.col("kept").alias("k")), "a").groupBy(F.col("b").alias("g"))
        seen = earlier.agg(F.coalesce(F.max(F.col("k")), F.lit(False)).alias("hit"), F.count_if(F.col("k").isNull()).alias("open"))
        new = F.when(F.col("hit"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        before, state = state, materialise(state.join(seen, "g", "left").select("g", F.coalesce("kept", new).alias("kept")), "first-wins")
        released(before)
        if state.filter("kept is null").isEmpty():
            break
    return state.filter("kept").select(F.col("g").alias(group))


def consecutive(events: DataFrame, session: str, at: str, key: str, kind: str, least: int = 2) -> DataFrame:
    """Pairs of kinds of event that follow each other within a session, and how often."""
    w = Window.partitionBy(session).orderBy(at, key)
    return events.select(F.col(kind).alias("first"), F.lead(kind).over(w).alias("then")).filter("then is not null").groupBy("first", "then").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= least)


# What says that one thing came of another, by kind and in order; and how an outcome is told.
CAUSES = (r"\b(?:because|caused|resulted in|led to|due to|therefore|hence)\b", r"\b(?:made|triggered|enabled|prevented|blocked)\b", r"->\s*")
GOOD = (r"\b(?:success|worked|completed|solved|fixed|resolved)\b", r"\b(?:good|great|excellent|perfect)\b")


def causal_split(text: Column, indicators: Sequence[str] = CAUSES) -> Column:
    """(cause, effect): up to 100 characters on either side of an indicator, in any case of letters.

    The first kind of indicator that a text has is the one it is parted at; null without one, or
    if a side is empty.
    """
    out = None
    for p in indicators:
        parts = F.split(text, f"(?i){p}", 2)
        cause, effect = F.trim(parts[0]), F.trim(F.try_element_at(parts, F.lit(2)))
        both = F.struct(F.substring(cause, F.greatest(F.length(cause) - 99, F.lit(1)), F.lit(100)).alias("cause"), F.substring(effect, 1, 100).alias("effect"))
        found = F.when((cause != "") & (effect != ""), both)
        out = F.when(text.rlike(f"(?i){p}"), found) if out is None else out.when(text.rlike(f"(?i){p}"), found)
    return out


def causal_patterns(experiences: DataFrame, key: str) -> DataFrame:
    """Experiences that tell what caused what: the texts on both sides and what they are about."""
    text = F.concat("content", F.lit(" "), F.coalesce("outcome", F.lit("")))
    p = experiences.select(key, causal_split(text).alias("p")).filter("p is not null").select(key, "p.cause", "p.effect")
    return p.withColumns({"subject": subject_of(F.col("cause")), "object": subject_of(F.col("effect")), "confidence": F.lit(0.6)})


def fact_patterns(groups: DataFrame, group: str, entity: str, least: int = 2) -> DataFrame:
    """Entities that at least ``least`` experiences of a group name: (group, entity, size, confidence .5 + .05 min(10, size))."""
    size = groups.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    named = groups.select(group, F.explode(F.array_distinct(F.transform(entity, F.lower))).alias("entity")).groupBy(group, "entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return named.join(size, group).select(group, "entity", "size", F.round(0.5 + 0.05 * F.least(F.lit(10), F.col("size")), 6).alias("confidence"))


def catch_all(items: DataFrame, grouped: DataFrame, key: str, group: str, name: str = "all") -> DataFrame:
    """(key, group): the groups of items, and one more for all items that are in none."""
    rest = items.join(grouped.select(key), key, "left_anti").select(key, F.lit(name).alias(group))
    return grouped.select(key, F.col(group).cast("string").alias(group)).unionByName(rest)


def link_count(groups: DataFrame, group: str) -> DataFrame:
    """(group, links): how many pairs a group's members form."""
    return groups.groupBy(group).agg(F.count(F.lit(1)).alias("n")).select(group, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("links"))


def outcome_generalisation(experiences: DataFrame, by: str, share: float = 0.7, least: int = 3) -> DataFrame:
    """Groups whose known outcomes are mostly of one kind."""
    g = experiences.filter("outcome is not null").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "success").alias("good")).filter(F.col("n") >= least)
    up = F.col("good") / F.col("n")
    return g.withColumn("tendency", F.when(up >= share, "positive").when(1 - up >= share, "negative")).filter("tendency is not null").withColumn("share", F.round(F.greatest(up, 1 - up), 6)).drop("good")


def correlations(members: DataFrame, group: str, entity: str, least: int = 2) -> DataFrame:
    """Entities met together in groups: confidence min(.9, .4 + .1 n)."""
    from lorebase.operators.graph import cooccurrences

    n = cooccurrences(members, group, entity).filter(F.col("weight") >= least)
    return n.withColumn("confidence", F.round(F.least(F.lit(0.9), 0.4 + 0.1 * F.col("weight")), 6))


def merged_patterns(patterns: DataFrame, most: int = 10) -> DataFrame:
    """Patterns of one type and statement as one: best confidence, occurrences and evidence (the first ``most``) together."""
    by = ("type", "subject", "predicate", "object")
    each = patterns.select(*by, F.explode("evidence").alias("e")).distinct()
    each = each.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("e"))).filter(F.col("_n") <= most)
    evidence = each.groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("evidence"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in by])
    sums = patterns.groupBy(*by).agg(F.max("confidence").alias("confidence"), F.sum("occurrences").alias("occurrences"))
    return sums.join(evidence, same(sums, evidence), "left").select(*[sums[c] for c in by], "confidence", "occurrences", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def candidates(patterns: DataFrame, least: float = 0.5, k: int = 50) -> DataFrame:
    """Merged patterns as candidate beliefs, the k surest: evidence and occurrences add to a pattern's confidence."""
    from lorebase.operators.beliefs import candidate_confidence

    c = candidate_confidence(F.col("confidence"), F.size("evidence"), F.col("occurrences"))
    verb = F.when(F.col("type") == "causal", "causes").when(F.col("type") == "temporal", "precedes").when(F.col("type") == "correlation", "correlates with").otherwise(F.col("predicate"))
    out = patterns.select("type", "subject", verb.alias("predicate"), "object", F.round(c, 6).alias("confidence")).filter(F.col("confidence") >= least)
    return out.orderBy(F.col("confidence").desc(), "type", "subject", "predicate", "object").limit(k)


def strength(confidence: Column, occurrences: Column) -> Column:
    return confidence * (0.5 + 0.5 * F.least(F.lit(1.0), occurrences / 10))


def fading(scores: DataFrame, cap: int = 100) -> DataFrame:
    """(id, score) below the upper median, lowest first, at most ``cap``; ranks are dealt out by range of score."""
    ranked = globally_ranked(scores, F.col("score"), F.col("id"))
    middle = F.broadcast(scores.agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("_m")))  # one row
    median = F.broadcast(ranked.crossJoin(middle).filter(F.col("rank") == F.col("_m")).agg(F.min("score").alias("median")))  # one row
    return scores.crossJoin(median).filter("score < median").orderBy("score", "id").limit(cap).select("id", "score")


def strongest(scores: DataFrame, cap: int = 50) -> DataFrame:
    """The top tenth by (score, id), at least one and at most ``cap``."""
    return scores.orderBy(F.col("score").desc(), "id").limit(min(cap, max(scores.count() // 10, 1)))


def subject_of(text: Column) -> Column:
    """What a text is about: its first capitalised word, else its first word of over three letters, else its first 30 characters."""
    words = F.split(text, r"\s+")
    return F.coalesce(F.try_element_at(F.filter(words, lambda w: w.rlike("^[A-Z]")), F.lit(1)), F.try_element_at(F.filter(words, lambda w: F.length(w) > 3), F.lit(1)), F.substring(text, 1, 30))
